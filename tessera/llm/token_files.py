"""Token ids in files of directly addressable codes: chunk levels, continuation bitmaps and rank directories."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.files import new_file, read_file, shared_folder
from tessera.llm.registry import query, table
from tessera.llm.tokenizing import byte_level
from tessera.session import materialize

MAGIC = b"DACTOK01"
CHUNK_BITS = 8
#: Bits between two entries of a rank directory.
RANK_BLOCK = 512
#: Ids after which a task starts a new file, and ids read together; both bound memory, not content.
FILE_IDS, READ_IDS = 2_000_000, 500_000
#: Tasks that read files, at most; more files share tasks.
MOST_READERS = 20_000


def encode_file(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int]) -> bytes:
    """A self-contained file of the documents' ids, in the given order.

    Header: magic, documents, ids, levels. Then document ids with a presence byte each, lengths, and per level its
    size, the chunks (one byte each), the continuation bitmap and the rank directory (set bits before each block). A
    chunk holds eight bits, lowest first; its bit says that the next level goes on with the same id.
    """
    levels, rest = [], ids.astype("<u4")
    while True:
        more = rest >= (1 << CHUNK_BITS)
        levels.append(((rest & 255).astype(np.uint8), more))
        if not more.any():
            break
        rest = rest[more] >> CHUNK_BITS
    out = [MAGIC, np.array([len(doc_ids), len(ids), len(levels)], "<u8").tobytes(),
           np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(),
           bytes(d is not None for d in doc_ids), np.array(lengths, "<u8").tobytes()]
    for chunks, more in levels:
        bitmap = np.packbits(more, bitorder="little")
        counts = np.add.reduceat(more, np.arange(0, len(more), RANK_BLOCK), dtype=np.uint64) if len(more) else np.zeros(0, np.uint64)
        ranks = np.concatenate(([0], np.cumsum(counts)[:-1])) if len(counts) else counts
        out += [np.array([len(chunks)], "<u8").tobytes(), chunks.tobytes(), bitmap.tobytes(), ranks.astype("<u8").tobytes()]
    return b"".join(out)


class TokenFile:
    """Reader of one file: single ids and ranges by position, documents by number; nothing is decoded in blocks."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        docs, self.size, n_levels = (int(x) for x in np.frombuffer(data, "<u8", 3, 8))
        at = 32
        ids = np.frombuffer(data, "<i8", docs, at)
        present = np.frombuffer(data, np.uint8, docs, at + 8 * docs)
        self.doc_ids = [int(d) if p else None for d, p in zip(ids, present, strict=True)]
        self.lengths = np.frombuffer(data, "<u8", docs, at + 9 * docs).astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        at += 17 * docs
        self.levels = []
        for _ in range(n_levels):
            n = int(np.frombuffer(data, "<u8", 1, at)[0])
            at += 8
            chunks, bits, blocks = np.frombuffer(data, np.uint8, n, at), -(-n // 8), -(-n // RANK_BLOCK)
            bitmap = np.frombuffer(data, np.uint8, bits, at + n)
            ranks = np.frombuffer(data, "<u8", blocks, at + n + bits)
            self.levels.append((chunks, bitmap, ranks))
            at += n + bits + 8 * blocks

    def token(self, i: int) -> int:
        """Id at position ``i``: at each level one chunk, one bit, and one rank of the directory plus one block."""
        value = shift = 0
        for chunks, bitmap, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if not bitmap[i >> 3] >> (i & 7) & 1:
                break
            first = i // RANK_BLOCK * RANK_BLOCK
            before = np.unpackbits(bitmap[first >> 3:(i >> 3) + 1], bitorder="little")[:i - first]
            i, shift = int(ranks[i // RANK_BLOCK]) + int(before.sum()), shift + CHUNK_BITS
        return value

    def tokens(self, start: int, stop: int) -> np.ndarray:
        """Ids of a range: the range of each deeper level begins at the rank of its first position."""
        out = np.zeros(max(0, stop - start), dtype="<u4")
        where, shift = np.arange(len(out)), 0
        for chunks, bitmap, ranks in self.levels:
            if not len(where):
                break
            out[where] |= chunks[start:stop].astype("<u4") << shift
            first = start // RANK_BLOCK * RANK_BLOCK
            bits = np.unpackbits(bitmap[first >> 3:(stop + 7) >> 3], bitorder="little")
            rank = int(ranks[start // RANK_BLOCK]) + int(bits[:start - first].sum(dtype=np.int64))
            more = bits[start - first:stop - first].astype(bool)
            where = where[more]
            start, stop, shift = rank, rank + len(where), shift + CHUNK_BITS
        return out

    def document(self, k: int) -> np.ndarray:
        return self.tokens(int(self.starts[k]), int(self.starts[k] + self.lengths[k]))


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str) -> DataFrame:
    """Encode ``docs(doc_id, text)`` and write the files; returns the written table ``(part, number, path, n_ids)``.

    Files of ascending ``(part, number)`` hold documents of ascending ``doc_id`` (nulls first, repeated ids in the
    order of a text hash). Every document ends with ``end_id``; null and empty texts are that id alone. A file ends
    with the document that fills it, so a very long document makes one large file. Files of failed or repeated task
    attempts are not in the table.
    """

    def run(batches):
        encode, part, number, held, size = byte_level(tokenizer_path), TaskContext.get().partitionId(), 0, [], 0
        end = np.array([end_id], "<u4").tobytes()

        def flush():
            ids = np.frombuffer(b"".join(x for _, x in held), "<u4")
            stream, path = new_file(folder, f"tokens-{part:06d}-{number:04d}")
            with stream:
                stream.write(encode_file(ids, [d for d, _ in held], [len(x) // 4 for _, x in held]))
            return pa.RecordBatch.from_pylist(
                [{"part": part, "number": number, "path": path, "n_ids": len(ids)}],
                schema=pa.schema([("part", pa.int32()), ("number", pa.int32()), ("path", pa.string()), ("n_ids", pa.int64())]))

        for batch in batches:
            texts = (text.as_py() or "" for text in batch.column(1))
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode.many(texts), strict=True):
                held.append((doc_id, ids + end))
                size += len(held[-1][1])
                if size >= 4 * FILE_IDS:
                    yield flush()
                    held, number, size = [], number + 1, 0
        if held:
            yield flush()

    ordered = (
        docs.select(F.col("doc_id").cast("long"), "text")
        .repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    )
    return materialize(ordered.mapInArrow(run, "part int, number int, path string, n_ids long"), "token-files")


def file_rows(held: TokenFile, before: int) -> Iterator[pa.RecordBatch]:
    """``(doc_id, start, n_tokens, ids_crc32)`` of the documents of one file, ``before`` ids after the first of all.

    Documents of ``READ_IDS`` ids together are read at a time; a longer one is read in parts of that size.
    """
    first = 0
    while first < len(held.lengths):
        begin = int(held.starts[first])
        last = max(first + 1, int(np.searchsorted(held.starts + held.lengths, begin + READ_IDS, "right")))
        starts, lengths = held.starts[first:last].tolist(), held.lengths[first:last].tolist()
        if last == first + 1:
            sums = [0]
            for at in range(begin, begin + lengths[0], READ_IDS):
                sums[0] = zlib.crc32(held.tokens(at, min(at + READ_IDS, begin + lengths[0])), sums[0])
        else:
            ids = memoryview(held.tokens(begin, starts[-1] + lengths[-1]))
            sums = [zlib.crc32(ids[s - begin:s - begin + n]) for s, n in zip(starts, lengths, strict=True)]
        yield pa.RecordBatch.from_arrays([
            pa.array(held.doc_ids[first:last], pa.int64()), pa.array([before + s for s in starts], pa.int64()),
            pa.array(lengths, pa.int64()), pa.array(sums, pa.int64()),
        ], names=["doc_id", "start", "n_tokens", "ids_crc32"])
        first = last


def read_token_files(files: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, from the files alone.

    ``start`` counts the ids of all documents before it: those of the files before (one row each in the only window
    without a key) and those before it in its file.
    """

    def run(batches):
        byte_level.cache_clear()  # a worker that wrote files before needs its remembered units no more
        for batch in batches:
            for path, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield from file_rows(TokenFile(read_file(path)), before)

    order = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.select("path", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("before"))
    placed = materialize(placed, "placed")
    # a row is a path of a few bytes that stands for a file: the number of tasks follows the files
    spread = placed.repartition(max(1, min(placed.count(), MOST_READERS)), "path")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


@query("op8_token_files")
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, written and read back; no SQL: tests compare with the library and check round trips."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    files = write_token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), 2, shared_folder(spark, "tokens"))
    return read_token_files(files)
