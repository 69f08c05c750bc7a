"""Token ids of whole texts by public tokenizer files, with a memory of units that recur."""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Units remembered in one worker, about 150 MB; later ones are encoded again in each batch where they occur.
REMEMBERED = 700_000
#: New units encoded in one text, and characters of texts that are looked through for them together.
TOGETHER, LOOKED_THROUGH = 200, 4 << 20


class _Units(dict):
    """Unit -> its ids as little-endian unsigned 32-bit integers; ``prefix`` stands before each unit when encoding.

    A comma or full stop after a letter is a pre-token of its own before white space or the end, so a new unit that
    ends so is put together from the unit without it. ``folded``: the tokenizer lowers its text itself.
    """

    def __init__(self, tokenizer, prefix: str, folded: bool = False):
        super().__init__()
        self.tokenizer, self.prefix, self.folded = tokenizer, prefix, folded
        self.marks = {m: self._encoded(m) for m in ",."}

    def _encoded(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4").tobytes()

    def learn(self, units: set[str], between: str) -> None:
        """Remember new units, many encoded in one text: ``between`` is a pre-token of its own wherever it stands and has
        one id that no unit has, so the ids are cut there."""
        stems = {u[:-1] if u[-1:] in self.marks and u[-2:-1].isalpha() else u for u in units}
        new = [u for u in stems if u and u not in self][:max(0, REMEMBERED - len(self))]
        cut = np.frombuffer(self._encoded(between), "<u4")
        for at in range(0, len(new), TOGETHER):
            part = new[at:at + TOGETHER]
            ids = self._encoded(between.join(self.prefix + u for u in part))
            ends = 4 * np.flatnonzero(np.frombuffer(ids, "<u4") == cut[0]) if len(cut) == 1 else cut
            if len(ends) == len(part) - 1:
                for unit, a, b in zip(part, [0, *(ends + 4).tolist()], [*ends.tolist(), len(ids)], strict=True):
                    self[unit] = ids[a:b]

    def __missing__(self, unit: str | bytes) -> bytes:
        text = unit.decode() if isinstance(unit, bytes) else unit
        if self.folded and isinstance(unit, bytes) and unit.lower() != unit:
            out = self[unit.lower()]
        elif text[-1:] in self.marks and text[-2:-1].isalpha():
            out = self[unit[:-1]] + self.marks[text[-1]]
        else:
            out = self._encoded(self.prefix + text) if self.prefix or text else b""
        if len(self) < REMEMBERED:
            self[unit] = out
        return out


def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class _Added:
    """Finds texts that may hold a token added to the vocabulary, in any case of ASCII letters: units are encoded
    folded. Such texts must be encoded as a whole."""

    def __init__(self, tokenizer):
        self.tokenizer, tokens = tokenizer, tokenizer.get_added_tokens_decoder().values()
        self.tokens = [t.content.encode().lower() for t in tokens]
        self.normalized = tokenizer.normalizer is not None and any(t.normalized for t in tokens)

    def __call__(self, data: bytes) -> bool:
        low = data.lower()
        if self.normalized and any(t in self.tokenizer.normalizer.normalize_str(data.decode()).encode().lower() for t in self.tokens):
            return True
        return any(t in low for t in self.tokens)


def _whole(tokenizer, text: str) -> bytes:
    return np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


class ByteLevelIds:
    """Encoder for byte-level BPE files of the ``tokenizers`` library.

    A pre-token starts at every single space before a visible character and on both sides of a single line break
    between visible characters, so texts whose white space is of these two kinds only are encoded unit by unit. All
    other texts, and those that hold an added token, are encoded as a whole.
    """

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        self.first, self.rest, self.added = _Units(self.tokenizer, ""), _Units(self.tokenizer, " "), _Added(self.tokenizer)

    def _by_unit(self, text: str) -> bool:
        return " ".join(text.split()) == text.replace("\n", " ") and not self.added(text.encode())

    def __call__(self, text: str) -> bytes:
        return self._joined(text) if self._by_unit(text) else _whole(self.tokenizer, text)

    def _joined(self, text: str) -> bytes:
        out, line_break, get = [], self.first["\n"], self.rest.__getitem__
        for k, line in enumerate(text.split("\n")):
            head, *tail = line.split(" ")
            if k:
                out.append(line_break)
            out.append(self.first[head])
            out.extend(map(get, tail))
        return b"".join(out)

    def many(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text; new units of many texts are encoded together."""
        held, size = [], 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size > LOOKED_THROUGH:
                yield from self._many(held)
                held, size = [], 0
        yield from self._many(held)

    def _many(self, texts: list[str]) -> Iterator[bytes]:
        by_unit = [self._by_unit(text) for text in texts]
        joined = self._joined_many([text for text, plain in zip(texts, by_unit, strict=True) if plain])
        for text, plain in zip(texts, by_unit, strict=True):
            yield next(joined) if plain else _whole(self.tokenizer, text)

    def _joined_many(self, texts: list[str]) -> Iterator[bytes]:
        """``_joined`` of many texts: units are numbered, each different one is looked up once, and the ids of all
        occurrences are gathered together. A unit that begins a line has no space before it and is another one."""
        if not texts:
            return
        split = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " \n "), " ")
        coded = split.flatten().dictionary_encode()
        known, code = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
        begins = np.concatenate(([True], code[:-1] == known.index("\n") if "\n" in known else np.zeros(len(code) - 1, bool)))
        ends = split.offsets.to_numpy()[1:].astype(np.int64)
        begins[ends[:-1]] = True
        key = 2 * code + begins
        used = np.flatnonzero(np.bincount(key, minlength=2 * len(known)))
        at = np.zeros(2 * len(known), np.int64)
        at[used] = np.arange(len(used))
        line_break = self.first["\n"]
        self.first.learn({known[k >> 1] for k in used.tolist() if k & 1} - {"\n"}, "\n")
        self.rest.learn({known[k >> 1] for k in used.tolist() if not k & 1} - {"\n"}, "\n")
        parts = [line_break if known[k >> 1] == "\n" else (self.first if k & 1 else self.rest)[known[k >> 1]] for k in used.tolist()]
        lengths = np.array([len(p) // 4 for p in parts], np.int64)
        starts, each = np.cumsum(lengths) - lengths, at[key]
        sizes = lengths[each]
        done = np.cumsum(sizes)
        ids = np.frombuffer(b"".join(parts), "<u4")[np.repeat(starts[each] - (done - sizes), sizes) + np.arange(done[-1])]
        bounds = done[ends - 1].tolist()
        for start, end in zip([0, *bounds[:-1]], bounds, strict=True):
            yield ids[start:end].tobytes()


class WordIds:
    """Encoder for BPE files with word ends, whose pre-tokenizer drops white space: each word is encoded by itself, texts
    that hold an added token as a whole."""

    def __init__(self, path: str):
        self.words = _Units(_tokenizer(path), "", folded=True)
        self.added = _Added(self.words.tokenizer)

    def __call__(self, text: str) -> bytes:
        data = text.encode()
        if self.added(data):
            return _whole(self.words.tokenizer, text)
        return b"".join(map(self.words.__getitem__, data.split()))


@lru_cache
def byte_level(path: str) -> ByteLevelIds:
    return ByteLevelIds(path)


@lru_cache
def word_level(path: str) -> WordIds:
    return WordIds(path)


@lru_cache
def rank_encoding(path: str, pattern: str):
    """A tiktoken encoding over a file of base64 tokens and their ranks, and the tokens by rank."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return encoding, {rank: str(rank) for rank in ranks.values()}
