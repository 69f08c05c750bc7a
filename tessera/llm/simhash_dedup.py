"""Near-duplicate documents by SimHash, found through a byte-position inverted index with count filtering."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.graphs import bucket_components
from tessera.llm.registry import query, table
from tessera.session import materialize

SHINGLE = 4
SEED = 42
MAX_BITS = 4
BYTES = 8
#: Differing bits lie in at most as many bytes, so a linked pair shares this many positional bytes at least.
MIN_MATCHES = BYTES - MAX_BITS


def position_triples() -> list[tuple[int, int, int]]:
    """Triples of byte positions such that any four positions hold one of them.

    Positions fall into three groups; taken are triples within a group, and pairs of a group with a member of the next.
    """
    groups = [[p for p in range(BYTES) if p // 3 == g] for g in range(3)]
    out = []
    for g, own in enumerate(groups):
        out += combinations(own, 3)
        out += [(a, b, c) for a, b in combinations(own, 2) for c in groups[(g + 1) % 3]]
    return out


def text_fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of the word shingles of a whole text; 0 without words."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z are lowered, only ASCII white space splits
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[min(shingle, len(words)) - 1:]
    digest = xxhash.xxh64_intdigest
    ones, total = np.zeros(64, np.int64), len(last)
    bounds = list(zip(starts[:total].tolist(), last.tolist(), strict=True))
    for at in range(0, total, 1 << 16):
        hashes = np.array([digest(joined[s:e], SEED) for s, e in bounds[at:at + (1 << 16)]], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    packed = np.packbits(ones * 2 > total, bitorder="little")
    return int(packed.view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp)`` of every row; no shuffle, one text in memory at a time beside its batch."""

    def run(batches):
        for batch in batches:
            fps = [text_fingerprint(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def _byte(fp: Column, position: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * position).bitwiseAND(F.lit(255))


def shared_bytes(a: Column, b: Column) -> Column:
    """The tally: positions at which both fingerprints have the same byte."""
    same = [F.when(_byte(a.bitwiseXOR(b), p) == 0, 1).otherwise(0) for p in range(BYTES)]
    return sum(same[1:], same[0])


def linked(a: Column, b: Column) -> Column:
    return (shared_bytes(a, b) >= MIN_MATCHES) & (F.bit_count(a.bitwiseXOR(b)) <= MAX_BITS)


def postings(fps: DataFrame) -> DataFrame:
    """Inverted index rows: the triple number above the three bytes found at its positions."""
    keys = [
        F.lit(k << 24) + F.shiftleft(_byte(F.col("fp"), a), 16) + F.shiftleft(_byte(F.col("fp"), b), 8) + _byte(F.col("fp"), c)
        for k, (a, b, c) in enumerate(position_triples())
    ]
    return fps.select(F.explode(F.array(*keys)).alias("key"), F.col("fp").alias("node"), F.col("fp").alias("print"))


def simhash_components(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp, component_id)`` of every row of ``docs(doc_id, text)``.

    Fingerprints with at most four differing bits are linked; a component has the smallest ``doc_id`` reachable.
    Equal fingerprints are one node, so exact copies never meet as pairs. Index lists are kept by three bytes at a
    time: two fingerprints that share four positional bytes share one of the twenty triples. In each list the shared
    bytes of a pair are tallied, pairs below four are dropped, the rest is verified by counting bits.

    Null and wordless texts have fingerprint zero and are linked like any other. Repeated rows stay; rows without
    ``doc_id`` are kept and do not count for the smallest one. Other columns are ignored; an empty table gives no rows.
    """
    prints = materialize(fingerprints(docs), "prints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "nodes")
    labels = bucket_components(postings(nodes), linked)
    named = materialize(
        nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left")
        .select("fp", F.coalesce("component", "fp").alias("component"), "doc_id"), "named")
    ids = materialize(named.groupBy("component").agg(F.min("doc_id").alias("component_id")), "ids")
    classes = materialize(named.join(ids, "component").select("fp", "component_id"), "classes")
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component: that with the component's ``doc_id``.

    Rows that repeat a ``doc_id`` count as one document and stay together; rows without ``doc_id`` stay.
    """
    gone = simhash_components(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(materialize(gone, "gone"), "doc_id", "left_anti").select(docs.columns)


@query("op6_simhash_dedup")
def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of every document; no SQL: duckdb has no XXH64. Tests compare with all pairs of a small set."""
    return simhash_components(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
