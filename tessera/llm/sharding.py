"""Shards of nearly equal bytes: range partitions between splitters sampled by size, overfull ranges subdivided."""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.registry import query, table
from tessera.session import materialize

#: Bytes that a row counts besides those of its text.
ROW_BYTES = 8
#: Ranges for each shard, and keys sampled for each range, about.
RANGES, SAMPLED = 8, 64
#: Ranges with more bytes, or with so many times the mean of all ranges, are subdivided.
RANGE_BYTES, OVERFULL = 64 << 20, 2
#: Rows larger than this part of a mean shard are dealt one by one; there are at most so many of them for each shard.
LARGE_PART = 50


def row_size(text: Column) -> Column:
    """Bytes of the text in UTF-8 (null: none) and ``ROW_BYTES``."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES


def keyed_rows(docs: DataFrame) -> DataFrame:
    """``(row, at, key, size)``, written: the whole row of ``docs``, a number of its own, the hash of its text (equal
    texts share a key) and its size. Written once, so that every later pass sees the same numbers."""
    return materialize(docs.select(
        F.struct("*").alias("row"), F.monotonically_increasing_id().alias("at"), F.xxhash64("text").alias("key"),
        row_size(F.col("text")).alias("size")), "keyed-rows")


def deal_large(sizes: list[tuple[int, int]], shards: int) -> tuple[list[tuple[int, int, int]], list[int]]:
    """``(at, shard, place)`` of rows ``(at, size)``, the largest first, each to the shard with the fewest bytes; and the
    bytes of each shard."""
    loads, places, out = [(0, s) for s in range(shards)], [0] * shards, []
    for size, at in sorted(((size, at) for at, size in sizes), reverse=True):
        load, shard = heapq.heappop(loads)
        out.append((at, shard, places[shard]))
        places[shard] += 1
        heapq.heappush(loads, (load + size, shard))
    return out, [load for load, _ in sorted(loads, key=lambda x: x[1])]


def boundaries(loads: list[int], rest: int) -> list[int]:
    """Bytes of the other rows that lie before the end of each shard, so that with ``loads`` the fullest shard is as
    small as it can be: shards are filled up to one level."""
    order, left, level = sorted(loads), rest, 0
    for k, load in enumerate(order):
        upper = order[k + 1] if k + 1 < len(order) else None
        room = None if upper is None else (upper - load) * (k + 1)
        if room is None or left <= room:
            level = load + left / (k + 1)
            break
        left -= room
    out, total = [], 0.0
    for load in loads:
        total += max(0.0, level - load)
        out.append(round(total))
    out[-1] = rest
    return out


def splitters(rows: DataFrame, total: int, ranges: int, sampled: int = SAMPLED) -> list[int]:
    """Keys that cut ``rows(at, key, size)`` of ``total`` bytes into about ``ranges`` ranges of equal bytes.

    A row is drawn with a chance in proportion to its size by a hash of its own number (repeated rows are drawn
    independently), about ``ranges * sampled`` rows whatever the input; the splitters are quantiles of the draw.
    """
    chance = F.shiftrightunsigned(F.xxhash64("at", F.lit(11)), 11) / F.lit(float(1 << 53))
    drawn = rows.where(chance * F.lit(float(total)) < F.col("size") * F.lit(float(ranges * sampled))).select("key")
    keys = sorted(r["key"] for r in drawn.collect())
    return sorted({keys[k * len(keys) // ranges] for k in range(1, ranges)}) if keys else []


def _above(value: Column, cuts: list[int]) -> Column:
    """How many of the sorted ``cuts`` are at most ``value``: a binary search in one expression."""
    steps, step = [], 1
    while step <= len(cuts):
        steps.insert(0, step)
        step *= 2
    if not steps:
        return F.lit(0)
    held, wide = F.array(*[F.lit(c).cast("long") for c in cuts]), F.array(*[F.lit(s) for s in steps])
    further = lambda n, s: (n + s <= len(cuts)) & (F.get(held, n + s - 1) <= value)
    return F.aggregate(wide, F.lit(0), lambda n, s: F.when(F.coalesce(further(n, s), F.lit(False)), n + s).otherwise(n))


def place_rows(docs: DataFrame, shards: int, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``(row, shard, slot)``: every row of ``docs`` with its shard (0 to ``shards - 1``) and its place there, gapless
    from 0. Shards hold nearly equal bytes (``row_size``).

    Rows are ordered by the range of their key, the part of the range, and key. Ranges lie between ``splitters``; a
    range with more than ``range_bytes``, or ``OVERFULL`` times the mean, such as a group of equal texts, is subdivided by a
    hash of the row numbers into as many parts as it needs. Bytes before each part and inside it give every row a position, and shards are
    sections of the positions. Rows larger than 1/``LARGE_PART`` of a mean shard would unbalance any section: they are
    dealt before, and the sections level out what they leave. So the fullest and the emptiest shard differ by about 2%
    of a mean shard, or by one row if a row is larger than that and no smaller rows can level it.

    Nulls and empty texts are rows of ``ROW_BYTES``. Repeated rows are rows of their own. An empty table gives no rows.
    Columns of ``docs`` are carried as one struct, whatever their names. The driver sees at most ``LARGE_PART`` rows a
    shard, about ``RANGES * SAMPLED`` keys a shard and one sum a range.
    """
    spark, held = docs.sparkSession, keyed_rows(docs)
    total = held.agg(F.sum("size")).first()[0] or 0
    most = max(ROW_BYTES, total // (shards * LARGE_PART))
    large = held.where(F.col("size") > most)
    dealt, loads = deal_large([(r["at"], r["size"]) for r in large.select("at", "size").collect()], shards)
    small = held.where(F.col("size") <= most)
    rest = total - sum(loads)
    cuts = splitters(small.select("at", "key", "size"), rest, RANGES * shards) if rest else []
    ranged = small.withColumn("range", _above(F.col("key"), cuts))
    sums = {r["range"]: r["size"] for r in ranged.groupBy("range").agg(F.sum("size").alias("size")).collect()}
    full = max(1, min(range_bytes, OVERFULL * rest // (RANGES * shards)))
    before, parts, seen = [], [], 0
    for k in range(len(cuts) + 1):
        before.append(seen)
        parts.append(-(-sums.get(k, 0) // full) or 1)
        seen += sums.get(k, 0)
    of_range = lambda values: F.get(F.array(*[F.lit(v).cast("long") for v in values]), F.col("range"))
    parted = ranged.withColumn("part", F.pmod(F.xxhash64("at", F.lit(13)), of_range(parts)))

    part, earlier = ["range", "part"], (Window.unboundedPreceding, -1)
    by_part = Window.partitionBy("range").orderBy("part").rowsBetween(*earlier)
    starts = materialize(
        parted.groupBy(part).agg(F.sum("size").alias("size"))
        .select(*part, (of_range(before) + F.coalesce(F.sum("size").over(by_part), F.lit(0))).alias("start")), "part-starts")

    def sharded(rows: DataFrame) -> DataFrame:
        inside = Window.partitionBy(*part).orderBy("key", "at").rowsBetween(*earlier)
        middle = F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0)) + F.expr("size div 2")
        return rows.join(starts, part).withColumn("shard", _above(middle, boundaries(loads, rest)[:-1]))

    counts = sharded(parted.select(*part, "key", "at", "size")).groupBy("shard", *part).agg(F.count("*").alias("n"))
    in_shard = Window.partitionBy("shard").orderBy(*part).rowsBetween(*earlier)
    firsts = materialize(
        counts.select("shard", *part, "n", F.coalesce(F.sum("n").over(in_shard), F.lit(0)).alias("first")), "shard-firsts")
    filled = defaultdict(int, {r["shard"]: r["n"] for r in firsts.groupBy("shard").agg(F.sum("n").alias("n")).collect()})
    own = Window.partitionBy(*part, "shard").orderBy("key", "at")
    sections = (
        sharded(parted).join(firsts.drop("n"), [*part, "shard"])
        .select("row", "shard", (F.col("first") + F.row_number().over(own) - 1).alias("slot")))
    singles = spark.createDataFrame([(at, s, filled[s] + k) for at, s, k in dealt], "at long, shard int, slot long")
    return sections.unionByName(large.join(F.broadcast(singles), "at").select("row", "shard", "slot"))


def write_shards(docs: DataFrame, shards: int, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Write ``place_rows`` to ``folder``, one directory ``shard=K`` for each shard with the columns ``row`` and
    ``slot``, and return it as read back."""
    place_rows(docs, shards, range_bytes).write.partitionBy("shard").parquet(folder)
    schema = f"row {docs.schema.simpleString()}, slot long, shard int"
    return docs.sparkSession.read.schema(schema).parquet(folder)


@query("op11_sampled_splitters")
def op11_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document; no SQL: duckdb has no XXH64. Tests check the law and a plain version."""
    placed = place_rows(table(spark, sf_dir, "documents"), 24)
    return placed.select(
        F.col("row.doc_id").cast("long").alias("doc_id"), row_size(F.col("row.text")).alias("size"),
        F.crc32(F.coalesce(F.col("row.text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
