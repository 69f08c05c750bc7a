"""Byte-level BPE by overlapping chunks: pre-tokenise in parallel, stitch at common boundaries, encode, decode."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.graphs import with_few
from tessera.llm.registry import query, table
from tessera.llm.tokenizing import rank_encoding
from tessera.session import materialize

#: Code points of a chunk, and of what two neighbours share.
CHUNK = 16_384
OVERLAP = 512


@lru_cache
def _splitter(pattern: str):
    import regex

    return regex.compile(pattern)


def boundaries(chunk: str, pattern: str) -> list[int]:
    """Starts of pre-tokens in a chunk at which a text may be cut: after a visible character and before a single
    space. What is read before such a place does not depend on what follows it, and the reverse."""
    return [
        at for at in (m.start() for m in _splitter(pattern).finditer(chunk))
        if 0 < at < len(chunk) - 1 and chunk[at] == " " and not chunk[at - 1].isspace() and not chunk[at + 1].isspace()
    ]


def _cut(texts: DataFrame, spans) -> DataFrame:
    """``(row_id, number, first, body)`` for ``texts(row_id, text, ...)`` with ``spans(row)`` giving code point ranges."""

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                row = {name: batch.column(k)[r].as_py() for k, name in enumerate(batch.schema.names)}
                found = list(enumerate(spans(row)))
                for at in range(0, len(found), 64):
                    some = found[at:at + 64]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([row["row_id"]] * len(some)), pa.array([k for k, _ in some], pa.int32()),
                        pa.array([s for _, (s, _) in some], pa.int64()), pa.array([row["text"][s:e] for _, (s, e) in some]),
                    ], names=["row_id", "number", "first", "body"])

    return texts.mapInArrow(run, "row_id string, number int, first long, body string")


def cut_points(chunks: DataFrame, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """``(row_id, cuts)``: where to cut each long text, ascending.

    Neighbouring chunks read the shared stretch independently. The first place that both see as a boundary is where
    they resynchronise; from there on they would read alike. Where they share none (one pre-token fills the stretch,
    say) there is no cut, and both chunks are encoded as one piece.
    """

    def run(batches):
        for batch in batches:
            rows, seen = [], batch.to_pylist()
            for r in seen:
                at = boundaries(r["body"], pattern)
                head = [r["first"] + b for b in at if b < overlap]
                tail = [r["first"] + b for b in at if chunk <= b]
                rows.append({"row_id": r["row_id"], "seam": r["number"], "at": head, "side": 1})
                rows.append({"row_id": r["row_id"], "seam": r["number"] + 1, "at": tail, "side": 0})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([
                ("row_id", pa.string()), ("seam", pa.int32()), ("at", pa.list_(pa.int64())), ("side", pa.int32())]))

    seams = chunks.mapInArrow(run, "row_id string, seam int, at array<long>, side int")
    met = seams.groupBy("row_id", "seam").agg(
        F.first(F.expr("if(side = 0, at, null)"), ignorenulls=True).alias("tail"),
        F.first(F.expr("if(side = 1, at, null)"), ignorenulls=True).alias("head"))
    cuts = met.select("row_id", F.array_min(F.array_intersect("tail", "head")).alias("cut")).where("cut is not null")
    return cuts.groupBy("row_id").agg(F.sort_array(F.collect_list("cut")).alias("cuts"))


def encode_pieces(pieces: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``pieces(row_id, number, first, body)`` -> count, ids as decimals joined by spaces, decoded bytes of each."""

    def run(batches):
        encoding, decimals = rank_encoding(ranks_path, pattern)
        name = decimals.__getitem__
        for batch in batches:
            ids = [encoding.encode_ordinary(body.as_py()) for body in batch.column(3)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([len(x) for x in ids], pa.int64()),
                pa.array([" ".join(map(name, x)) for x in ids], pa.string()),
                pa.array([encoding.decode_bytes(x) for x in ids], pa.binary()),
            ], names=["row_id", "number", "n_tokens", "ids", "decoded"])

    return pieces.mapInArrow(run, "row_id string, number int, n_tokens long, ids string, decoded binary")


def _digests_of_short(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Texts of one chunk: one piece each, encoded and decoded where they are read."""

    def run(batches):
        encoding, decimals = rank_encoding(ranks_path, pattern)
        name = decimals.__getitem__
        for batch in batches:
            counts, ids_sha, raw_sha = [], [], []
            for text in batch.column(1):
                ids = encoding.encode_ordinary(text.as_py() or "")
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join(map(name, ids)).encode()).hexdigest())
                raw_sha.append(hashlib.sha256(encoding.decode_bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(raw_sha, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def with_row_id(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, row_id)``; rows of the same id and text share a ``row_id``."""
    return docs.select(
        F.col("doc_id").cast("long"), "text",
        F.concat_ws("-", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.sha2("text", 256)).alias("row_id"))


def encode_long(texts: DataFrame, ranks_path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``(row_id, number, n_tokens, ids, decoded)``: the pieces of each of ``texts(row_id, text)``; in order of
    ``number`` they are its encoding; rows that repeat a ``row_id`` repeat its pieces. Chunks and pieces are dealt over tasks, so many tasks read one very long text.
    Empty texts have no pieces."""
    steps = lambda row: [(s, s + chunk + overlap) for s in range(0, len(row["text"]), chunk)]
    chunks = _cut(texts.select("row_id", "text"), steps).repartition("row_id", "number")
    cuts = materialize(cut_points(chunks, pattern, chunk, overlap), "cuts")

    def between(row):
        bounds = [0, *(row["cuts"] or []), len(row["text"])]
        return [(s, e) for s, e in zip(bounds, bounds[1:], strict=False) if s < e]

    pieces = _cut(with_few(texts.select("row_id", "text"), cuts, "row_id", "left"), between).repartition("row_id", "number")
    return encode_pieces(pieces, ranks_path, pattern)


def encode_digests(docs: DataFrame, ranks_path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of every row of ``docs(doc_id, text)``.

    Texts of up to one chunk are a single piece. Null and empty texts have no ids (digests of nothing). Repeated rows
    and rows without ``doc_id`` stay; other columns are ignored.
    """
    is_long = F.coalesce(F.length("text"), F.lit(0)) > chunk
    short = _digests_of_short(docs.select(F.col("doc_id").cast("long"), "text").where(~is_long), ranks_path, pattern)
    rows = with_row_id(docs).where(is_long)
    pieces = encode_long(rows, ranks_path, pattern, chunk, overlap)
    # a set: rows that share a row_id have the same pieces
    ordered = F.sort_array(F.collect_set(F.struct("number", "n_tokens", "ids", F.hex("decoded").alias("raw"))))
    digests = pieces.groupBy("row_id").agg(ordered.alias("p")).select(
        "row_id", F.aggregate("p.n_tokens", F.lit(0).cast("long"), lambda total, n: total + n).alias("n_tokens"), F.sha2(F.array_join("p.ids", " "), 256).alias("ids_sha256"),
        F.sha2(F.unhex(F.array_join("p.raw", "")), 256).alias("decoded_sha256"))
    long_rows = rows.select("doc_id", "row_id").join(digests, "row_id")
    return short.unionByName(long_rows.drop("row_id"))


@query("op9_byte_bpe")
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded bytes of every document; no SQL: tests compare with the library on whole texts."""
    import public_tokenizers

    return encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                          public_tokenizers.PATTERN)
