"""Look-ups, filters and checks on tiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.positions import dense_positions, hash_order
from tessera.operators.rectangles import TABLE, expand_rows, explode_range
from tessera.sources.lake import Lake, melt_table


def tiles_of_kind(tiles: DataFrame, kind: str | Sequence[str] | None = None) -> DataFrame:
    """Tiles of one kind, of several kinds, or (None) all."""
    if kind is None:
        return tiles
    return tiles.filter(F.col("kind").isin([kind] if isinstance(kind, str) else list(kind)))


def distinct_members(
    tiles: DataFrame, level: str, lake: str | None = None, table: str | None = None, kind: str | None = None
) -> DataFrame:
    """Distinct lakes, tables, tiles or kinds (``level``) of a tile set under optional filters."""
    columns = {"lake": ["lake"], "table": TABLE, "tile": [*TABLE, "tile_id"], "kind": ["kind"]}[level]
    chosen = tiles_of_kind(tiles, kind)
    if lake is not None:
        chosen = chosen.filter(F.col("lake") == lake)
    if table is not None:
        chosen = chosen.filter(F.col("table_name") == table)
    return chosen.select(*columns).distinct()


def tile_cells(spans: DataFrame, cells: DataFrame) -> DataFrame:
    """The cells inside each tile: an equi-join on the row, then a column test."""
    rows = expand_rows(spans.select(*TABLE, "tile_id", "row_lo", "row_hi", "cols"))
    inside = cells.join(rows, [*TABLE, "row_id"]).filter(F.array_contains("cols", F.col("col_pos")))
    return inside.drop("cols")


def tile_cells_of_rows(spans: DataFrame, rows: DataFrame) -> DataFrame:
    """The same from whole rows (``names``, ``values``): rows are joined first, and only the tile's cells are unrolled."""
    members = expand_rows(spans.select(*TABLE, "tile_id", "row_lo", "row_hi", "cols"))
    joined = rows.join(members, [*TABLE, "row_id"]).withColumn("col_pos", F.explode("cols"))
    at = F.col("col_pos") + 1
    return joined.select(
        *TABLE, "tile_id", "row_id", "col_pos", F.element_at("names", at).alias("col_name"), F.element_at("values", at).alias("value")
    )


def tile_sizes(spans: DataFrame, keys: Sequence[str] = ("lake", "table_name", "tile_id")) -> DataFrame:
    """Cells per tile (spans of one tile do not overlap)."""
    return spans.groupBy(*keys).agg(F.sum((F.col("row_hi") - F.col("row_lo")) * F.size("cols")).alias("num_cells"))


def remove_tiles(spans: DataFrame, removed: DataFrame) -> DataFrame:
    return spans.join(removed.select(*TABLE, "tile_id").distinct(), [*TABLE, "tile_id"], "left_anti")


def invalid_tiles(spans: DataFrame, tables: DataFrame) -> DataFrame:
    """Tiles that name a table, row or column the lake does not have, with the first reason."""
    joined = spans.join(tables.select(*TABLE, "n_rows", "n_cols"), TABLE, "left")
    # numbers in the order of the texts: they are combined by hashing, texts would be sorted
    reason = (
        F.when(F.col("n_rows").isNull(), 3)
        .when((F.col("row_lo") < 0) | (F.col("row_hi") > F.col("n_rows")), 2)
        .when(F.exists("cols", lambda c: (c < 0) | (c >= F.col("n_cols"))), 1)
    )
    bad = joined.withColumn("_reason", reason).filter("_reason IS NOT NULL")
    first = bad.groupBy(*TABLE, "tile_id").agg(F.min("_reason").alias("_reason"))
    texts = F.array(F.lit("no such column"), F.lit("no such row"), F.lit("no such table"))
    return first.select(*TABLE, "tile_id", F.element_at(texts, F.col("_reason")).alias("reason"))


def wrong_embeddings(vectors: DataFrame, dim: int, key: Sequence[str], expected: DataFrame) -> DataFrame:
    """Keys whose vectors have another length than ``dim`` or another number than ``expected (key, n_expected)``."""
    counted = vectors.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_vectors"),
        F.count_if(F.coalesce(F.size("vec"), F.lit(-1)) != dim).alias("n_wrong_length"),
    )
    joined = expected.join(counted, list(key), "left")
    n = F.coalesce("n_vectors", F.lit(0))
    wrong = F.coalesce("n_wrong_length", F.lit(0))
    return joined.select(*key, "n_expected", n.alias("n_vectors"), wrong.alias("n_wrong_length")).filter(
        (F.col("n_vectors") != F.col("n_expected")) | (F.col("n_wrong_length") > 0)
    )


def order_by_owner(spans: DataFrame, tables: DataFrame, ordinal: str) -> tuple[DataFrame, DataFrame]:
    """New row and column order of each table: rows by the tile in the first column, then columns by the tile in the new first row.

    Later tiles overwrite earlier ones, cells without a tile come last, ties keep table order.
    Returns ``(table, row_id, owner, new_row)`` and ``(table, col_pos, owner, new_col)``.
    """
    first_col = spans.filter(F.array_contains("cols", 0))
    owners = expand_rows(first_col.select(*TABLE, "row_lo", "row_hi", ordinal)).groupBy(*TABLE, "row_id").agg(
        F.max(ordinal).alias("owner")
    )
    all_rows = expand_rows(tables.select(*TABLE, F.lit(0).cast("long").alias("row_lo"), F.col("n_rows").alias("row_hi")))
    rows = all_rows.join(owners, [*TABLE, "row_id"], "left").withColumn("_free", F.col("owner").isNull())
    rows = dense_positions(rows, ["_free", "owner", "row_id"], TABLE, out="new_row").drop("_free")

    top = rows.filter("new_row = 0").select(*TABLE, F.col("row_id").alias("_top"))
    over_top = spans.join(top, TABLE).filter((F.col("row_lo") <= F.col("_top")) & (F.col("_top") < F.col("row_hi")))
    col_owner = over_top.select(*TABLE, F.explode("cols").alias("col_pos"), ordinal).groupBy(*TABLE, "col_pos").agg(
        F.max(ordinal).alias("owner")
    )
    all_cols = tables.select(*TABLE, F.explode(F.sequence(F.lit(0), F.col("n_cols") - 1)).alias("col_pos"))
    cols = all_cols.join(col_owner, [*TABLE, "col_pos"], "left").withColumn("_free", F.col("owner").isNull())
    cols = dense_positions(cols, ["_free", "owner", "col_pos"], TABLE, out="new_col").drop("_free")
    return rows, cols


def cells_at(lake: Lake, rows: DataFrame, cols: DataFrame) -> DataFrame:
    """The cells of a lake at new places ``(lake, table_name, row_id, new_row)`` and ``(lake, table_name, col_pos, new_col)``:
    ``(lake, table_name, new_row, new_col, value)``. Whole rows meet their places as they are stored; only then are they
    unrolled into cells and texts."""
    parts = []
    for name, df in lake.tables.items():
        # a table may have a column of any name
        place, at = "_new_row", "_at_row"
        while {place, at} & set(df.columns):
            place, at = "_" + place, "_" + at
        own = rows.filter((F.col("lake") == lake.name) & (F.col("table_name") == name)).select(F.col("row_id").alias(at), F.col("new_row").alias(place))
        moved = df.join(own, df["row_id"] == own[at]).drop(at)
        parts.append(melt_table(moved, lake.name, name, [place]).select(*TABLE, "col_pos", "value", F.col(place).alias("new_row")))
    cells = parts[0]
    for part in parts[1:]:
        cells = cells.unionByName(part)
    return cells.join(cols.select(*TABLE, "col_pos", "new_col"), [*TABLE, "col_pos"]).select(*TABLE, "new_row", "new_col", "value")


def shuffle_positions(positions: DataFrame, seed: int, key: str, out: str) -> DataFrame:
    """Seeded permutation per table of ``positions (lake, table_name, key)``: new position = rank of a hash."""
    keyed = positions.withColumn("_hash", hash_order(seed, F.col("lake"), F.col("table_name"), F.col(key)))
    return dense_positions(keyed, ["_hash", key], TABLE, out=out).drop("_hash")


def shuffle_maps(tables: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """Seeded permutations of the rows and of the columns of every table of a catalog: ``(lake, table_name, row_id,
    new_row)`` and ``(lake, table_name, col_pos, new_col)``. Swap the last two columns for the way back."""
    rows = explode_range(tables.select(*TABLE, "n_rows"), F.col("n_rows"), "row_id").drop("n_rows")
    cols = explode_range(tables.select(*TABLE, "n_cols"), F.col("n_cols"), "col_pos", spread=False).drop("n_cols")
    return shuffle_positions(rows, seed, "row_id", "new_row"), shuffle_positions(cols, seed + 1, "col_pos", "new_col")


def inverse_map(moved: DataFrame) -> DataFrame:
    """The permutation back: old and new position change their names."""
    *keys, old, new = moved.columns
    return moved.select(*keys, F.col(new).alias(old), F.col(old).alias(new))


def shuffle_cells(cells: DataFrame, rows: DataFrame, cols: DataFrame) -> DataFrame:
    """Cells at their new places."""
    moved = cells.join(rows, [*TABLE, "row_id"]).join(cols, [*TABLE, "col_pos"])
    place = {"row_id": F.col("new_row"), "col_pos": F.col("new_col").cast("int")}
    return moved.select(*[place[c].alias(c) if c in place else F.col(c) for c in cells.columns])


#: Rows of a table among which neighbouring ones are joined to runs.
RUN_BLOCK = 65_536


def shuffle_spans(spans: DataFrame, rows: DataFrame, cols: DataFrame) -> DataFrame:
    """Tiles at their new places. Rows that became neighbours form one span; a run ends at every ``RUN_BLOCK`` rows, so
    that a tile of any size stays spread over tasks."""
    keys = [c for c in spans.columns if c not in ("row_lo", "row_hi", "cols")]
    group = list(dict.fromkeys([*TABLE, *keys]))
    sets = spans.select(*group, "cols").distinct()
    named = sets.withColumn("col_pos", F.explode("cols")).join(cols.withColumn("col_pos", F.col("col_pos").cast("int")), [*TABLE, "col_pos"])
    new_cols = named.groupBy(*group, F.col("cols").alias("_old")).agg(F.array_sort(F.collect_list(F.col("new_col").cast("int"))).alias("cols"))
    moved = expand_rows(spans.select(*group, F.col("cols").alias("_old"), "row_lo", "row_hi")).join(rows, [*TABLE, "row_id"])
    block = Window.partitionBy(*group, "_old", F.floor(F.col("new_row") / RUN_BLOCK)).orderBy("new_row")
    runs = moved.withColumn("_run", F.col("new_row") - F.row_number().over(block)).withColumn("_block", F.floor(F.col("new_row") / RUN_BLOCK))
    joined = runs.groupBy(*group, "_old", "_block", "_run").agg(F.min("new_row").alias("row_lo"), (F.max("new_row") + 1).alias("row_hi"))
    return joined.join(new_cols, [*group, "_old"]).select(*spans.columns)


def limit_per_lake(items: DataFrame, n: int | None, seed: int, key: str) -> DataFrame:
    """A seeded sample of ``n`` items per lake; ranking stops at n inside every task before the shuffle."""
    if n is None:
        return items
    window = Window.partitionBy("lake").orderBy("_hash", key)
    ranked = items.withColumn("_hash", hash_order(seed, F.col(key))).withColumn("_rank", F.row_number().over(window))
    return ranked.filter(F.col("_rank") <= n).drop("_hash", "_rank")


def assign_partitions(lakes: DataFrame, n_val: int, seed: int) -> DataFrame:
    """test lakes stay; of the suitable others, the first ``n_val`` in hash order are val, the rest train.

    ``lakes (lake, is_test, suitable)``. The first n are found by a top-n, so no task sees all lakes.
    """
    usable = lakes.filter("suitable")
    pool = usable.filter("NOT is_test")
    val = pool.orderBy(hash_order(seed, F.col("lake")), "lake").limit(n_val).select("lake", F.lit(True).alias("_val"))
    marked = usable.join(val, "lake", "left")
    name = F.when(F.col("is_test"), "test").when(F.col("_val"), "val").otherwise("train")
    return marked.select("lake", name.alias("partition"))
