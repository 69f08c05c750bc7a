"""Slicers whose tiles form a grid: none, cell, row-wise, column-wise.

Such a slicing is two strides per table. Everything about it (tile of a row, tile sizes, which
tiles touch a ground truth) is arithmetic on row ids, so whole sweeps over slicers and budgets run
in one plan without building a tile.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.rectangles import TABLE, explode_range
from tessera.sources.lake import lake_sizes

NONE, CELL, ROWWISE, COLWISE = "none", "cell", "rowwise", "colwise"
SLICERS = (NONE, CELL, ROWWISE, COLWISE)
CONFIG = ["slicer", "tpt"]


def with_configs(tables: DataFrame, configs: Sequence[tuple[str, int]]) -> DataFrame:
    """Every table once per (slicer, tiles per table)."""
    unknown = {s for s, _ in configs} - set(SLICERS)
    if unknown:
        raise ValueError(f"unknown slicers: {sorted(unknown)}")
    rows = [F.struct(F.lit(s).alias("slicer"), F.lit(t).alias("tpt")) for s, t in configs]
    return tables.select("*", F.inline(F.array(*rows)))


def tile_budget(tables: DataFrame, tpt: Column, distribution: str = "cell-based") -> DataFrame:
    """Add ``n_tables``, ``lake_cells`` and ``budget``: ``tpt`` for every table, or that average shared out by table size."""
    if distribution not in ("table-based", "cell-based"):
        raise ValueError(f"unknown tile distribution: {distribution}")
    sized = tables.join(lake_sizes(tables.select("lake", "table_name", "num_cells").distinct()), "lake")
    if distribution == "table-based":
        return sized.withColumn("budget", tpt.cast("long"))
    # tiles * tables * cells can pass 2^63: integer division of decimals stays exact
    extra = F.expr(
        "(cast(_tiles - 1 as decimal(10,0)) * cast(n_tables as decimal(10,0)) * cast(num_cells as decimal(18,0)))"
        " div lake_cells"
    )
    return sized.withColumn("_tiles", tpt).withColumn("budget", F.lit(1).cast("long") + extra).drop("_tiles")


def grid(tables: DataFrame, configs: Sequence[tuple[str, int]], distribution: str = "cell-based") -> DataFrame:
    """Row and column stride of every table under every configuration."""
    budgeted = tile_budget(with_configs(tables, configs), F.col("tpt"), distribution)
    per_tile = lambda n: F.ceil(F.col(n) / F.col("budget")).cast("long")
    n_rows, n_cols = F.col("n_rows").cast("long"), F.col("n_cols").cast("long")
    slicer = F.col("slicer")
    one = F.lit(1).cast("long")
    return budgeted.withColumn(
        "row_stride", F.when(slicer == CELL, one).when(slicer == ROWWISE, per_tile("n_rows")).otherwise(n_rows)
    ).withColumn("col_stride", F.when(slicer == CELL, one).when(slicer == COLWISE, per_tile("n_cols")).otherwise(n_cols))


def block_of(position: Column, stride: Column) -> Column:
    return F.floor(position / stride).cast("long")


def grid_tiles(strides: DataFrame) -> DataFrame:
    """The tiles of a grid as a span frame (one span per tile)."""
    row_blocks = explode_range(strides, F.ceil(F.col("n_rows") / F.col("row_stride")), "row_block")
    blocks = explode_range(row_blocks, F.ceil(F.col("n_cols") / F.col("col_stride")), "col_block", spread=False)
    row_lo = F.col("row_block") * F.col("row_stride")
    row_hi = F.least(row_lo + F.col("row_stride"), F.col("n_rows"))
    col_lo = F.col("col_block") * F.col("col_stride")
    col_hi = F.least(col_lo + F.col("col_stride"), F.col("n_cols").cast("long"))
    return blocks.select(
        *TABLE,
        *CONFIG,
        F.concat_ws("/", "table_name", "row_block", "col_block").alias("tile_id"),
        F.lit("slice-tile").alias("kind"),
        row_lo.alias("row_lo"),
        row_hi.alias("row_hi"),
        F.transform(F.sequence(col_lo, col_hi - 1), lambda c: c.cast("int")).alias("cols"),
        ((row_hi - row_lo) * (col_hi - col_lo)).alias("num_cells"),
    )


def assign_to_grid(cells: DataFrame, strides: DataFrame) -> DataFrame:
    """Add the tile of every cell: (slicer, tpt, row_block, col_block)."""
    keyed = cells.join(strides.select(*TABLE, *CONFIG, "row_stride", "col_stride"), TABLE)
    return (
        keyed.withColumn("row_block", block_of(F.col("row_id"), F.col("row_stride")))
        .withColumn("col_block", block_of(F.col("col_pos"), F.col("col_stride")))
        .drop("row_stride", "col_stride")
    )


def grid_confusion(strides: DataFrame, truth_rows: DataFrame, truth_cols: DataFrame) -> DataFrame:
    """Confusion of returning every grid tile that touches the truth, per (lake, gt_name, slicer, tpt).

    A truth is one rectangle per table: ``truth_rows (lake, gt_name, table_name, row_id)`` and
    ``truth_cols (lake, gt_name, table_name, cols)``. Tiles touched are (touched row blocks) x
    (touched column blocks), so two small sums per table give all counts; truth rows are combined
    per row block before they are shuffled.
    """
    key = ["lake", "gt_name", "table_name", *CONFIG]
    by_stride = ["lake", "gt_name", "table_name", "row_stride"]
    # many configurations share a stride: rows meet each different one once, and configurations meet the sums
    rows = truth_rows.join(strides.select(*TABLE, "row_stride", "n_rows").distinct(), TABLE)
    per_block = rows.groupBy(*by_stride, block_of(F.col("row_id"), F.col("row_stride")).alias("block")).agg(
        F.count(F.lit(1)).alias("hits"), F.first("n_rows").alias("n_rows")
    )
    block_rows = F.least(F.col("row_stride"), F.col("n_rows") - F.col("block") * F.col("row_stride"))
    sums = per_block.groupBy(*by_stride).agg(F.sum("hits").alias("truth_rows"), F.sum(block_rows).alias("touched_rows"))
    row_side = sums.join(strides.select(*TABLE, *CONFIG, "row_stride"), [*TABLE, "row_stride"]).drop("row_stride")

    stride = F.col("col_stride")
    blocks = F.array_distinct(F.transform("cols", lambda c: F.floor(c / stride).cast("long")))
    touched = F.aggregate(
        blocks,
        F.lit(0).cast("long"),
        lambda acc, b: acc + F.least(stride, F.col("n_cols").cast("long") - b * stride),
    )
    col_side = truth_cols.join(strides.select(*TABLE, *CONFIG, "col_stride", "n_cols"), TABLE).select(
        *key, F.size("cols").alias("truth_cols"), touched.alias("touched_cols")
    )
    # left: a truth without rows touches nothing and still counts
    per_table = col_side.join(row_side, key, "left").select(
        *key,
        F.coalesce(F.col("truth_rows") * F.col("truth_cols"), F.lit(0)).alias("tp"),
        F.coalesce(F.col("touched_rows") * F.col("touched_cols"), F.lit(0)).alias("touched"),
    )
    sizes = strides.select("lake", "lake_cells").distinct()
    return (
        per_table.groupBy("lake", "gt_name", *CONFIG)
        .agg(F.sum("tp").alias("TP"), F.sum(F.col("touched") - F.col("tp")).alias("FP"))
        .join(sizes, "lake")
        .select(
            "lake", "gt_name", *CONFIG, "TP", "FP",
            (F.col("lake_cells") - F.col("TP") - F.col("FP")).alias("TN"),
            F.lit(0).cast("long").alias("FN"),
        )
    )


def grid_hits(strides: DataFrame, truth_rows: DataFrame, truth_cols: DataFrame) -> DataFrame:
    """Cells each touched grid tile shares with each truth: (lake, gt_name, config, tile_id, num_in).

    Counted as (truth rows of the row block) x (truth columns of the column block). Tiles are not
    expanded, and untouched ones do not appear.
    """
    key = ["lake", "gt_name", "table_name", *CONFIG]
    rows = truth_rows.join(strides.select(*TABLE, *CONFIG, "row_stride"), TABLE)
    per_row_block = rows.groupBy(*key, block_of(F.col("row_id"), F.col("row_stride")).alias("row_block")).agg(
        F.count(F.lit(1)).alias("_rows")
    )
    cols = truth_cols.join(strides.select(*TABLE, *CONFIG, "col_stride"), TABLE).withColumn("_col", F.explode("cols"))
    per_col_block = cols.groupBy(*key, block_of(F.col("_col"), F.col("col_stride")).alias("col_block")).agg(
        F.count(F.lit(1)).alias("_cols")
    )
    return per_row_block.join(per_col_block, key).select(
        "lake", "gt_name", "table_name", *CONFIG,
        F.concat_ws("/", "table_name", "row_block", "col_block").alias("tile_id"),
        (F.col("_rows") * F.col("_cols")).alias("num_in"),
    )


def tile_confusion(
    tile_sizes: DataFrame, hits: DataFrame, lake_cells: DataFrame, truths: DataFrame, config: Sequence[str] = ()
) -> DataFrame:
    """The same for arbitrary tiles: ``hits`` holds num_in per touched (tile, truth), see ``tile_hits``.

    ``truths (lake, gt_name, config)`` lists all ground truths; one that touches no tile counts too.
    """
    keys = ["lake", "gt_name", *config]
    touched = hits.join(tile_sizes, ["lake", *config, "tile_id"])
    counts = touched.groupBy(*keys).agg(F.sum("num_in").alias("TP"), F.sum(F.col("num_cells") - F.col("num_in")).alias("FP"))
    return (
        truths.select(*keys)
        .distinct()
        .join(counts, keys, "left")
        .fillna(0, ["TP", "FP"])
        .join(lake_cells, "lake")
        .select(
            *keys, "TP", "FP",
            (F.col("lake_cells") - F.col("TP") - F.col("FP")).alias("TN"),
            F.lit(0).cast("long").alias("FN"),
        )
    )
