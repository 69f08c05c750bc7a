"""Best-fit packing of tokenised documents, after Martello-Toth dominance reduction."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.registry import query, table
from tessera.llm.tokenizing import word_level
from tessera.session import materialize

CAPACITY = 4096
#: Pieces that are ranked in one task at most, about.
RANKED_TOGETHER = 50_000


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``: each document's ids and ``end_id``, cut only where longer than
    ``capacity``. Null and empty texts are the end id alone; repeated rows are documents of their own."""

    def run(batches):
        encode, end = word_level(tokenizer_path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = ([], [], [], [], [])
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    for column, value in zip(rows, (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class _Stock:
    """Counts by length with the lengths in order."""

    def __init__(self, counts: dict[int, int]):
        self.counts = {w: n for w, n in counts.items() if n}
        self.order = sorted(self.counts)

    def take(self, length: int, n: int) -> None:
        self.counts[length] -= n
        if not self.counts[length]:
            del self.counts[length]
            del self.order[bisect_left(self.order, length)]

    def largest_up_to(self, limit: int) -> int | None:
        k = bisect_left(self.order, limit + 1)
        return self.order[k - 1] if k else None


def reduce_by_dominance(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Fix sequences that some best packing holds, and return them as ``(lengths, times)`` with the remaining counts.

    With ``w`` a piece, from long to short, and ``gap`` what it leaves:

    * no piece fits the gap: ``w`` is a sequence by itself;
    * a piece fills the gap exactly, or at most one more piece fits beside ``w``: ``w`` goes with the longest that
      fits, since any other filling could be exchanged against that one piece;
    * at most two fit beside ``w`` and no two that fit together are longer than the longest single one: likewise.

    A set dominates if each other filling of the gap splits into groups that its pieces can replace. Pieces of the same
    length are fixed together, so the work depends on the number of different lengths only.
    """
    stock, fixed = _Stock(counts), []
    w = stock.largest_up_to(capacity)
    while w is not None:
        partner = stock.largest_up_to(capacity - w)
        if partner == w and stock.counts[w] < 2:
            partner = stock.largest_up_to(w - 1)
        if partner is None:
            n = stock.counts[w]
            fixed.append(((w,), n))
            stock.take(w, n)
        elif _dominates(stock, w, partner, capacity - w):
            n = stock.counts[w] // 2 if partner == w else min(stock.counts[w], stock.counts[partner])
            fixed.append(((w, partner), n))
            stock.take(w, n)
            stock.take(partner, n)
        else:
            w = stock.largest_up_to(w - 1)
            continue
        w = stock.largest_up_to(w)
    return fixed, dict(stock.counts)


def _dominates(stock: _Stock, w: int, partner: int, gap: int) -> bool:
    if partner == gap:
        return True
    least = stock.order[0]
    second = least if stock.counts[least] > 1 else stock.order[1] if len(stock.order) > 1 else gap + 1
    if least + second > gap:
        return True
    return least + 2 * second > gap and _best_pair(stock.order, gap) <= partner


def _best_pair(order: list[int], gap: int) -> int:
    """Largest sum up to ``gap`` of two lengths (a length may be taken twice: an upper bound)."""
    best, high = 0, len(order) - 1
    for low in range(len(order)):
        while high >= low and order[low] + order[high] > gap:
            high -= 1
        if high < low:
            break
        best = max(best, order[low] + order[high])
    return best


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit-decreasing over counts by length; equal sequences are kept as ``(lengths, times)``."""
    rooms: dict[int, Counter] = defaultdict(Counter)  # gap -> contents -> times
    gaps: list[int] = []

    def put(gap: int, contents: tuple[int, ...], times: int) -> None:
        if gap not in rooms or not rooms[gap]:
            insort(gaps, gap)
        rooms[gap][contents] += times

    for w in sorted(counts, reverse=True):
        left = counts[w]
        while left:
            k = bisect_left(gaps, w)
            gap = gaps[k] if k < len(gaps) else capacity
            if k < len(gaps):
                contents = min(rooms[gap])
                times = rooms[gap].pop(contents)
                if not rooms[gap]:
                    del gaps[k]
            else:
                contents, times = (), -(-left // (capacity // w))
            each = gap // w
            full = min(times, left // each)
            if full:
                put(gap - each * w, contents + (w,) * each, full)
                left -= full * each
            if full < times:
                if left:
                    put(gap - left * w, contents + (w,) * left, 1)
                    left, full = 0, full + 1
                if full < times and contents:
                    put(gap, contents, times - full)
    return [(contents, times) for gap in rooms for contents, times in rooms[gap].items() if contents]


def packing_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Dominant sets first, then best fit for what they leave. Deterministic."""
    fixed, rest = reduce_by_dominance(counts, capacity)
    return fixed + sorted(best_fit(rest, capacity), reverse=True)


def _slots(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per length: first rank, first sequence and offset of each run of equal slots."""
    ranks: Counter = Counter()
    slots = defaultdict(list)
    sequence = 0
    for lengths, times in plan:
        offset = 0
        for w in lengths:
            slots[w].append((ranks[w], sequence, offset))
            ranks[w] += times
            offset += w
        sequence += times
    return {w: tuple(np.array(c, np.int64) for c in zip(*runs, strict=True)) for w, runs in slots.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to ``pieces(doc_id, piece, start, length, ids_crc32)``.

    Only the counts by length (``capacity`` rows at most) reach the driver, and the plan made of them has a size
    bounded by the number of lengths. Pieces of one length are interchangeable: each gets its rank among them and with
    it a slot. Ranks are counted in hash buckets, each a bounded number of pieces, so that one frequent length is
    split over tasks. Which of several pieces of one length gets which slot carries no meaning.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = _slots(packing_plan(counts, capacity))
    buckets = max(1, -(-max(counts.values(), default=1) // RANKED_TOGETHER)) * 16
    spread = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    sizes = spread.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = materialize(
        sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "firsts")
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = spread.withColumn("rank", F.row_number().over(inside) - 1).join(firsts, ["length", "bucket"])
    shared = pieces.sparkSession.sparkContext.broadcast(slots)

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 5))
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for w in np.unique(length):
                own = np.flatnonzero(length == w)
                first, sequences, offsets = shared.value[int(w)]
                run = np.searchsorted(first, rank[own], side="right") - 1
                sequence[own], offset[own] = sequences[run] + rank[own] - first[run], offsets[run]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    rows = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))
    return rows.mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """Sequences of at most ``capacity`` ids over all ``docs(doc_id, text)``; an empty table gives no rows."""
    return pack(materialize(token_pieces(docs, tokenizer_path, end_id, capacity), "pieces"), capacity)


@query("op10_best_fit_packing")
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece; no SQL: tests check the ids against the library and the packing against its bounds."""
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
