"""Tiles as row spans, and the set algebra on them.

A *span frame* has ``lake, table_name, tile_id, row_lo, row_hi, cols``: rows ``row_lo <= r < row_hi``
of the columns at positions ``cols``. A contiguous tile is one span, a scattered one has a span per
run of rows. All spans of a tile carry the same ``cols``.

Overlaps never build cells: a row cover holds one bit mask per row and block of 62 columns, merged
with ``bit_or`` (combined map-side) and compared with ``bit_count``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = 62
BLOCK = 65_536
TABLE = ["lake", "table_name"]
_UNIT = "single_rows"


def explode_range(df: DataFrame, count: Column, out: str, spread: bool = True, block: int = BLOCK) -> DataFrame:
    """One output row per number 0..count-1.

    With ``spread`` ranges are cut into blocks, and the blocks are distributed before they are
    unrolled, so a single input row never makes one task produce an unbounded number of rows. The
    partition count is explicit: block rows are tiny, and sizing by bytes would put them together
    again. Pass ``spread=False`` where ranges are known to be short.
    """
    zero = F.lit(0).cast("long")
    tagged = df.withColumn("_n", count.cast("long")).filter("_n > 0")
    if not spread:
        return tagged.withColumn(out, F.explode(F.sequence(zero, F.col("_n") - 1))).drop("_n")
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = tagged.withColumn("_start", F.explode(F.sequence(zero, F.col("_n") - 1, F.lit(block).cast("long"))))
    placed = blocks.repartition(tasks, F.xxhash64("_start", *df.columns))
    last = F.least(F.col("_start") + block, F.col("_n")) - 1
    return placed.withColumn(out, F.explode(F.sequence(F.col("_start"), last))).drop("_n", "_start")


def _has_unit_spans(spans: DataFrame) -> bool:
    return bool(spans.schema["row_lo"].metadata.get(_UNIT))


def expand_rows(spans: DataFrame) -> DataFrame:
    """Span frame to one row per covered table row (``row_id``); nothing is moved for spans made of single rows."""
    rows = explode_range(spans, F.col("row_hi") - F.col("row_lo"), "_i", spread=not _has_unit_spans(spans))
    return rows.withColumn("row_id", F.col("row_lo") + F.col("_i")).drop("_i", "row_lo", "row_hi")


def rows_to_spans(rows: DataFrame) -> DataFrame:
    """One span per ``row_id``. The column is marked, so that expanding it again needs no distribution."""
    low = F.col("row_id").alias("row_lo", metadata={_UNIT: True})
    others = [c for c in rows.columns if c != "row_id"]
    return rows.select(*others, low, (F.col("row_id") + 1).alias("row_hi"))


def column_words(cols: Column) -> Column:
    """Column positions as an array of (word, mask): 62 columns per word."""
    words = F.array_distinct(F.transform(cols, lambda c: (c / WORD).cast("int")))
    return F.transform(
        words,
        lambda w: F.struct(
            w.alias("word"),
            F.aggregate(
                F.filter(cols, lambda c: (c / WORD).cast("int") == w),
                F.lit(0).cast("long"),
                lambda acc, c: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), c % WORD)),
            ).alias("mask"),
        ),
    )


def _row_masks(spans: DataFrame, group: Sequence[str]) -> DataFrame:
    worded = spans.select(*group, "row_lo", "row_hi", F.inline(column_words(F.col("cols"))))
    return expand_rows(worded).select(*group, "row_id", "word", "mask")


def row_cover(spans: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, lake, table_name, row_id, word, mask): what a set of tiles covers, each cell once."""
    group = list(dict.fromkeys([*keys, *TABLE]))
    return _row_masks(spans, group).groupBy(*group, "row_id", "word").agg(F.bit_or("mask").alias("mask"))


def paired_covers(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The covers of two sets side by side, as ``mask`` and ``other`` (null where a set has no tile): one aggregation of
    both instead of a join of two, so that no side is sorted."""
    group = list(dict.fromkeys([*keys, *TABLE]))
    none = F.lit(None).cast("long")
    sides = _row_masks(a, group).withColumn("other", none).unionByName(
        _row_masks(b, group).select(*group, "row_id", "word", none.alias("mask"), F.col("mask").alias("other")))
    return sides.groupBy(*group, "row_id", "word").agg(F.bit_or("mask").alias("mask"), F.bit_or("other").alias("other"))


def covered_cells(spans: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Number of cells covered per key, overlaps counted once."""
    cover = row_cover(spans, keys)
    return cover.groupBy(*keys).agg(F.sum(F.bit_count("mask")).cast("long").alias("num_cells"))


def tile_set_overlap(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key: cells of set ``a`` that are in set ``b`` of the same key (``num_in``), and that are not (``num_out``)."""
    covers = paired_covers(a, b, keys).filter("mask IS NOT NULL")
    both = F.bit_count(F.col("mask").bitwiseAND(F.coalesce(F.col("other"), F.lit(0).cast("long"))))
    joined = covers.select(*keys, both.alias("hit"), F.bit_count("mask").alias("own"))
    return joined.groupBy(*keys).agg(
        F.sum("hit").cast("long").alias("num_in"), F.sum(F.col("own") - F.col("hit")).cast("long").alias("num_out")
    )


def tile_hits(tiles: DataFrame, truths: DataFrame, tile_keys: Sequence[str], truth_keys: Sequence[str]) -> DataFrame:
    """Per (tile, truth) that share a cell: the number of shared cells. Pairs without one are not built."""
    left = row_cover(tiles, tile_keys)
    right = row_cover(truths, truth_keys).withColumnRenamed("mask", "other")
    shared = F.bit_count(F.col("mask").bitwiseAND(F.col("other")))
    # unrolled tiles are many times what the planner takes them for: they must not be sent to all tasks
    joined = left.hint("merge").join(right, [*TABLE, "row_id", "word"]).withColumn("hit", shared).filter("hit > 0")
    group = list(dict.fromkeys([*tile_keys, *truth_keys, "lake"]))
    return joined.groupBy(*group).agg(F.sum("hit").cast("long").alias("num_in"))


def rect_overlap(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One rectangle per key and table on each side: common rows times common columns, no covers.

    Row sets are counted by an equi-join on the row id; the column intersection is done once per
    rectangle, not once per row.
    """
    on = list(dict.fromkeys([*keys, *TABLE]))
    cols_a = a.select(*on, F.col("cols").alias("_ca")).distinct()
    cols_b = b.select(*on, F.col("cols").alias("_cb")).distinct()
    common_cols = cols_a.join(cols_b, on).select(*on, F.size(F.array_intersect("_ca", "_cb")).alias("n_common_cols"))
    rows_a = expand_rows(a.select(*on, "row_lo", "row_hi"))
    rows_b = expand_rows(b.select(*on, "row_lo", "row_hi"))
    common_rows = rows_a.join(rows_b, [*on, "row_id"]).groupBy(*on).agg(F.count(F.lit(1)).alias("n_common_rows"))
    return common_cols.join(common_rows, on).select(
        *on, (F.col("n_common_rows") * F.col("n_common_cols")).alias("num_in")
    )


def intersect(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key and table the common rows (one span each) of the common columns, in the order of ``a``'s columns."""
    on = list(dict.fromkeys([*keys, *TABLE]))
    cols_b = b.select(*on, F.col("cols").alias("_cb")).distinct()
    common = a.select(*on, "cols").distinct().join(cols_b, on).select(*on, F.array_intersect("cols", "_cb").alias("cols"))
    rows_a = expand_rows(a.select(*on, "row_lo", "row_hi"))
    rows_b = expand_rows(b.select(*on, "row_lo", "row_hi"))
    rows = rows_a.join(rows_b, [*on, "row_id"], "left_semi")
    return rows_to_spans(rows.join(common.filter(F.size("cols") > 0), on))


def union_columns(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Union of the column sets per key, in table order (never longer than the table is wide)."""
    exploded = spans.select(*keys, "cols").distinct().select(*keys, F.explode("cols").alias("col"))
    return exploded.groupBy(*keys).agg(F.array_sort(F.collect_set("col")).alias("cols"))


def union_rows(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Union of the row sets per key as (keys, row_id)."""
    return expand_rows(spans.select(*keys, "row_lo", "row_hi")).distinct()


def merge_closure(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key and table the smallest rectangle that holds all tiles: rows united, columns united."""
    on = list(dict.fromkeys([*keys, *TABLE]))
    cols = union_columns(spans, on)
    rows = union_rows(spans, on)
    return rows_to_spans(rows.join(cols, on)).withColumn("tile_id", F.concat(F.lit("result/"), F.col("table_name")))


def merge_none(spans: DataFrame) -> DataFrame:
    return spans


def coverage_mask(spans: DataFrame, tables: DataFrame) -> DataFrame:
    """Per tile row the explicit boolean column mask over the whole table width."""
    rows = expand_rows(spans).join(tables.select(*TABLE, "n_cols"), TABLE)
    mask = F.transform(F.sequence(F.lit(0), F.col("n_cols") - 1), lambda c: F.array_contains(F.col("cols"), c))
    return rows.withColumn("mask", mask)


def covering_tiles(spans: DataFrame, ordinal: str) -> DataFrame:
    """Per covered cell the sorted ordinals of the tiles over it, as (…, row_id, col_pos, tiles)."""
    rows = expand_rows(spans.select(*TABLE, "row_lo", "row_hi", "cols", ordinal))
    cells = rows.select(*TABLE, "row_id", F.explode("cols").alias("col_pos"), ordinal)
    return cells.groupBy(*TABLE, "row_id", "col_pos").agg(F.array_sort(F.collect_set(ordinal)).alias("tiles"))
