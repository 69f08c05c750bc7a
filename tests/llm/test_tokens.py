import hashlib
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import byte_bpe, packing, token_files
from tessera.llm.files import shared_folder
from tessera.llm.tokenizing import byte_level, rank_encoding, word_level

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
TEXTS = [
    None, "", " ", "\n", "a", "a b", "The  two   gaps \n\n and\ttabs\r\n", "it's 'sb we'll x'd", "Zoë und　Ünï",
    "<|endoftext|> in text", "a\x1cb \x85 c", "é ́x", "line one\nline two\n\nline four", "12345 67 8.9, (ok)!!",
    "日本語 のテキスト 😀😀 end", "same row", "same row", " lead", "trail ", "x" * 3000, "word and more " * 4000, "word and more " * 4000,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None if k == 3 else 7 if k in (15, 16) else 5 if k > 19 else 100 - k, t, k) for k, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, start long").repartition(3)


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab'sA.1 \n\té \x1c😀!", max_size=40))
def test_units_equal_whole_text(text):
    for encode in (byte_level(BYTE), word_level(WORD)):
        tokenizer = encode.words.tokenizer if hasattr(encode, "words") else encode.tokenizer
        assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize(("path", "make"), [(BYTE, byte_level), (WORD, word_level)])
def test_added_tokens_as_in_the_file(path, make):
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(path)
    for text in ["a <|endoftext|> b", "a <|startoftext|> b", "x<|endoftext|>y.", "<|endoftext|>", "A <|ENDOFTEXT|> b", "<|EndOfText|>.",
                 "<|endoftext|><|startoftext|>\n<|endoftext|>", "a  <|endoftext|>\t", "<|endoftext|", "a <|endoftext|\u226f b", "plain words, only."]:
        assert np.frombuffer(make(path)(text), "<u4").tolist() == fresh.encode(text, add_special_tokens=False).ids, text


@given(st.lists(st.lists(st.sampled_from([0, 1, 255, 256, 65535, 65536, 2**24, 2**32 - 1]), max_size=700), max_size=5))
@settings(max_examples=50, deadline=None)
def test_token_file_round_trip(documents):
    flat = np.array([x for d in documents for x in d], "<u4")
    held = token_files.TokenFile(token_files.encode_file(flat, [None, *range(1, len(documents))][:len(documents)], list(map(len, documents))))
    assert held.tokens(0, held.size).tolist() == flat.tolist()
    assert [held.document(k).tolist() for k in range(len(documents))] == documents
    for i in range(0, len(flat), 37):
        assert held.token(i) == flat[i]
        assert held.tokens(i, min(i + 600, len(flat))).tolist() == flat[i:i + 600].tolist()


def test_token_files_hold_all_documents(spark, docs, no_docs, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_IDS", 50)
    files = token_files.write_token_files(docs, BYTE, 2, shared_folder(spark, "t"))
    got = sorted(token_files.read_token_files(files).collect(), key=lambda r: r["start"])
    tokenizer = byte_level(BYTE).tokenizer
    want = Counter()
    for r in docs.collect():
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        want[r["doc_id"], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    keys = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in got]
    assert keys == sorted(keys)
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    assert token_files.read_token_files(token_files.write_token_files(no_docs, BYTE, 2, shared_folder(spark, "t"))).count() == 0


def test_files_are_read_in_parts(monkeypatch):
    """However long a file and its documents are, no more than ``READ_IDS`` ids are held at once."""
    documents, asked, read = [[7] * n for n in (0, 3, 9, 1, 40, 2, 10, 11, 0, 0)], [], token_files.TokenFile.tokens
    monkeypatch.setattr(token_files, "READ_IDS", 10)
    monkeypatch.setattr(token_files.TokenFile, "tokens", lambda held, a, b: asked.append(b - a) or read(held, a, b))
    flat = np.array([300 * x + k for k, x in enumerate(x for d in documents for x in d)], "<u4")
    lengths = [len(d) for d in documents]
    held = token_files.TokenFile(token_files.encode_file(flat, list(range(len(documents))), lengths))
    got = [r for batch in token_files.file_rows(held, 1000) for r in batch.to_pylist()]
    starts = np.cumsum([0, *lengths]).tolist()
    assert [tuple(r.values()) for r in got] == [
        (k, 1000 + starts[k], n, zlib.crc32(flat[starts[k]:starts[k] + n].tobytes())) for k, n in enumerate(lengths)]
    assert max(asked) == 10 and len(asked) < 2 * len(documents)


@pytest.mark.parametrize(("chunk", "overlap"), [(50, 20), (700, 100), (16_384, 512)])
def test_stitched_chunks_equal_whole_text(docs, chunk, overlap):
    encoding, _ = rank_encoding(RANKS, PATTERN)
    want = Counter()
    for r in docs.collect():
        ids = encoding.encode_ordinary(r["text"] or "")
        want[r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
             hashlib.sha256((r["text"] or "").encode()).hexdigest()] += 1
    got = byte_bpe.encode_digests(docs, RANKS, PATTERN, chunk, overlap)
    assert Counter(tuple(r) for r in got.collect()) == want


def test_chunks_are_cut_where_they_resynchronise(spark):
    text = "resync'll work " * 200 + "x" * 500 + "\n\n  gap " * 100
    texts = spark.createDataFrame([("r", text)], "row_id string, text string")
    pieces = sorted(byte_bpe.encode_long(texts, RANKS, PATTERN, 60, 30).collect(), key=lambda r: r["number"])
    assert len(pieces) > 20 and b"".join(bytes(r["decoded"]) for r in pieces) == text.encode()
    ids = " ".join(r["ids"] for r in pieces)
    assert ids == " ".join(map(str, rank_encoding(RANKS, PATTERN)[0].encode_ordinary(text)))


def test_encoding_of_an_empty_table(no_docs):
    assert byte_bpe.encode_digests(no_docs, RANKS, PATTERN).count() == 0


def fewest(lengths, capacity):
    """Fewest sequences, by trying all."""
    best = [len(lengths)]

    def place(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(rooms)
            return
        for i in {r: i for i, r in enumerate(rooms)}.values():
            if rooms[i] >= lengths[k]:
                place(k + 1, [*rooms[:i], rooms[i] - lengths[k], *rooms[i + 1:]])
        place(k + 1, [*rooms, capacity - lengths[k]])

    place(0, [])
    return best[0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=8))
def test_dominance_keeps_the_fewest_sequences(lengths):
    fixed, rest = packing.reduce_by_dominance(Counter(lengths), 20)
    assert Counter(lengths) == Counter({w: n for w, n in rest.items()}) + sum(
        (Counter({w: c * n for w, c in Counter(ws).items()}) for ws, n in fixed), Counter())
    left = sorted(Counter(rest).elements(), reverse=True)
    assert sum(n for _, n in fixed) + fewest(left, 20) == fewest(sorted(lengths, reverse=True), 20)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 30), max_size=12))
def test_best_fit_by_counts_equals_piece_by_piece(counts):
    rooms = []
    for w in sorted(Counter(counts).elements(), reverse=True):
        fits = [r for r in rooms if r >= w]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - w)
        else:
            rooms.append(50 - w)
    plan = packing.best_fit(counts, 50)
    assert Counter({50 - sum(ws): n for ws, n in plan if n}) or not counts
    got = Counter()
    for ws, n in plan:
        got[50 - sum(ws)] += n
    assert got == Counter(rooms)


def test_packing_holds_every_id_once(spark, docs, no_docs, monkeypatch):
    monkeypatch.setattr(packing, "RANKED_TOGETHER", 2)
    many = docs.unionByName(spark.range(60).selectExpr("id + 200 as doc_id", "repeat('word ', cast(id * 37 % 90 as int)) as text", "0L as start"))
    got = packing.pack_documents(many, WORD, 1, 64).collect()
    tokenizer = word_level(WORD).words.tokenizer
    want = Counter()
    for r in many.collect():
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), 64)):
            part = ids[at:at + 64]
            want[r["doc_id"], piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    rooms = defaultdict(list)
    for r in got:
        rooms[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in rooms.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(r["length"] for r in got)
    assert len(rooms) <= 1.03 * -(-total // 64) + 1
    assert packing.pack_documents(no_docs, WORD).count() == 0
    assert not [1 for a, b in combinations([sum(n for _, n in p) for p in rooms.values()], 2) if a + b <= 64]
