"""Embedding operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.vectors import l2_normalize as unit, mean_vector, vector_columns, weighted_mean
from tessera.operators import embedding, provenance, slicing
from tessera.plans.corpus import (
    BLOCKS, DIM, EMBEDDER, STAR, SQL_CHAT_CELLS, chat_cells, star_lake, sql_catalog, sql_cells, sql_hash, sql_name, sql_tables,
    sql_truth_cols, sql_truth_rows, table,
)
from tessera.plans.registry import query
from tessera.sources.lake import catalog, melt

R = range(DIM)
VEC = ", ".join(f"v{i}" for i in R)


def _rounded(prefix: str = "v") -> str:
    return ", ".join(f"round({prefix}{i}, 6) + 0.0 as v{i}" for i in R)


def _out(df, *keys):
    return df.select(*keys, *[(F.round(F.col("vec")[i], 6) + 0.0).alias(f"v{i}") for i in R])


# all parts of every cell of the star lake: value (c), column name (n), table name (t)
_CELL_PARTS = (
    f"{sql_tables(STAR)}, {sql_cells(STAR, 'star')}, parts as (select table_name, row_id, col_pos, "
    + ", ".join(f"{sql_hash('value_or_nan', i)} as c{i}" for i in R) + ", "
    + ", ".join(f"{sql_hash(sql_name('col_name'), i)} as n{i}" for i in R) + ", "
    + ", ".join(f"{sql_hash(sql_name('table_name'), i)} as t{i}" for i in R)
    + " from cells)"
).replace("value_or_nan", "coalesce(value, 'nan')")


@query("embed_text_hash", f"with {SQL_CHAT_CELLS} select lake, table_name, row_id, col_pos, " + ", ".join(f"{sql_hash('value', i)} as v{i}" for i in R) + " from cells")
def embed_text_hash(spark, sf_dir):
    costly = embedding.Embedder(model=EMBEDDER.model, dim=DIM, costly=True)
    vectors = embedding.embed_texts(chat_cells(spark, sf_dir), F.col("value"), "vec", costly)
    return vectors.select("lake", "table_name", "row_id", "col_pos", *vector_columns("vec", DIM, digits=None))


@query(
    "embed_zero",
    f"with {SQL_CHAT_CELLS} select lake, table_name, row_id, col_pos, 10 as dim, 0.0::double as total from cells",
)
def embed_zero(spark, sf_dir):
    vectors = embedding.embed_zero(chat_cells(spark, sf_dir), ["lake", "table_name", "row_id", "col_pos"])
    total = F.aggregate("vec", F.lit(0.0), lambda s, x: s + F.abs(x))
    return vectors.select("lake", "table_name", "row_id", "col_pos", F.size("vec").alias("dim"), total.alias("total"))


@query("embed_table_cells", f"with {_CELL_PARTS} select table_name, row_id, col_pos, " + ", ".join(f"(c{i} + n{i}) / 2 as v{i}" for i in R) + " from parts")
def embed_table_cells(spark, sf_dir):
    lake = star_lake(spark, sf_dir, STAR, "star")
    vectors = embedding.embed_table(melt(lake), "table-cells", EMBEDDER, embedding.name_vectors(lake, EMBEDDER))
    return vectors.select("table_name", "row_id", "col_pos", *vector_columns("vec", DIM, digits=None))


@query("embed_table_rows", f"with {_CELL_PARTS}, p as (select table_name, row_id, " + ", ".join(f"avg(c{i}) as v{i}" for i in R) + f" from parts group by all) select table_name, row_id, {_rounded()} from p")
def embed_table_rows(spark, sf_dir):
    return _out(embedding.embed_wide_rows(star_lake(spark, sf_dir, STAR, "star"), EMBEDDER), "table_name", "row_id")


@query("embed_table_rows_of_cells", f"with {_CELL_PARTS}, p as (select table_name, row_id, " + ", ".join(f"avg(c{i}) as v{i}" for i in R) + f" from parts group by all) select table_name, row_id, {_rounded()} from p")
def embed_table_rows_of_cells(spark, sf_dir):
    return _out(embedding.embed_table(melt(star_lake(spark, sf_dir, STAR, "star")), "table-rows", EMBEDDER), "table_name", "row_id")


@query("embed_table_cols", f"with {_CELL_PARTS}, p as (select table_name, col_pos, " + ", ".join(f"avg(c{i} + n{i}) / 2 as v{i}" for i in R) + f" from parts group by table_name, col_pos) select table_name, col_pos, {_rounded()} from p")
def embed_table_cols(spark, sf_dir):
    lake = star_lake(spark, sf_dir, STAR, "star")
    return _out(embedding.embed_table(melt(lake), "table-cols", EMBEDDER, embedding.name_vectors(lake, EMBEDDER)), "table_name", "col_pos")


_SQL_TABLE = "tab as (select table_name, " + ", ".join(f"avg(2 * t{i} + n{i} + c{i}) / 4 as v{i}" for i in R) + " from parts group by table_name)"


@query("embed_table", f"with {_CELL_PARTS}, {_SQL_TABLE} select table_name, {_rounded()} from tab")
def embed_table(spark, sf_dir):
    lake = star_lake(spark, sf_dir, STAR, "star")
    return _out(embedding.embed_table(melt(lake), "table", EMBEDDER, embedding.name_vectors(lake, EMBEDDER)), "table_name")


def _value_vectors(spark, sf_dir):
    return embedding.embed_texts(melt(star_lake(spark, sf_dir, STAR, "star")), F.col("value"), "vec", EMBEDDER)


def _pool_sql(keys: str) -> str:
    return f"with {_CELL_PARTS}, p as (select {keys}, " + ", ".join(f"avg(c{i}) as v{i}" for i in R) + f" from parts group by {keys}) select {keys}, {_rounded()} from p"


@query("pool_rows", _pool_sql("table_name, row_id"))
def pool_rows(spark, sf_dir):
    return _out(mean_vector(_value_vectors(spark, sf_dir), ["table_name", "row_id"], "vec", DIM), "table_name", "row_id")


@query("pool_cols", _pool_sql("table_name, col_pos"))
def pool_cols(spark, sf_dir):
    return _out(mean_vector(_value_vectors(spark, sf_dir), ["table_name", "col_pos"], "vec", DIM), "table_name", "col_pos")


@query("pool_table", _pool_sql("table_name"))
def pool_table(spark, sf_dir):
    return _out(mean_vector(_value_vectors(spark, sf_dir), ["table_name"], "vec", DIM), "table_name")


@query("vec_mean_by_label", "select label, pos, round(avg(x), 6) + 0.0 as mean from (select label, unnest(embedding)::double as x, unnest(range(0, 64)) as pos from embeddings) group by all")
def vec_mean_by_label(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("vec"))
    means = mean_vector(vectors, ["label"], "vec", 64)
    return means.select("label", F.posexplode("vec").alias("pos", "x")).select("label", "pos", (F.round("x", 6) + 0.0).alias("mean"))


@query("l2_normalize", "select vec_id, pos, round(x / sqrt(sq), 6) + 0.0 as x from (select vec_id, unnest(embedding)::double as x, unnest(range(0, 64)) as pos, list_sum(list_transform(embedding, lambda v: v::double * v::double)) as sq from embeddings)")
def l2_normalize(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", unit(F.col("embedding").cast("array<double>")).alias("vec"))
    return vectors.select("vec_id", F.posexplode("vec").alias("pos", "x")).select("vec_id", "pos", (F.round("x", 6) + 0.0).alias("x"))


@query("weighted_combine", f"with {_CELL_PARTS} select table_name, row_id, col_pos, " + ", ".join(f"round((4 * t{i} + n{i} + 2 * c{i}) / 7, 6) + 0.0 as v{i}" for i in R) + " from parts")
def weighted_combine(spark, sf_dir):
    lake = star_lake(spark, sf_dir, STAR, "star")
    texts = embedding.component_texts(melt(lake)).join(embedding.name_vectors(lake, EMBEDDER), ["lake", "table_name", "col_pos"])
    cells = texts.withColumn("_cell", EMBEDDER.model(F.col("cell_text")))
    parts = [(F.col("_table_name"), 4.0), (F.col("_col_name"), 1.0), (F.col("_cell"), 2.0)]
    return _out(cells.withColumn("vec", weighted_mean(parts, DIM)), "table_name", "row_id", "col_pos")


# ---- tiles -----------------------------------------------------------------------------------------

_TPT = 50


def sql_grid_tiles(tiles_per_table: int, lake: str = "star") -> str:
    """``cellmean``: sums of the parts of row-wise tiles, and ``g``: rows of a tile of each table."""
    return (
        f"{_CELL_PARTS.replace(sql_cells(STAR, 'star'), sql_cells(STAR, lake))}, {sql_catalog(STAR, lake)}, g as (select table_name, ceil(n_rows / (1 + ({tiles_per_table - 1} * (select count(*) from tables) * num_cells) // (select cast(sum(num_cells) as bigint) from tables)))::bigint as s from tables),"
        " a as (select parts.*, row_id // s as b from parts join g using (table_name)), cellmean as (select table_name, b, "
        + ", ".join(f"avg(4 * t{i} + n{i} + c{i}) as o{i}, avg(c{i}) as r{i}" for i in R) + " from a group by table_name, b)"
    )


@query(
    "tile_embedding",
    f"with {sql_grid_tiles(_TPT)} select table_name, table_name || '/' || b || '/0' as tile_id, "
    + ", ".join(f"round((o{i} + 2 * r{i}) / 8, 6) + 0.0 as v{i}" for i in R) + " from cellmean",
)
def tile_embedding(spark, sf_dir):
    lake = star_lake(spark, sf_dir, STAR, "star")
    strides = slicing.grid(catalog(lake), [("rowwise", _TPT)])
    return _out(embedding.embed_grid_tiles(melt(lake), strides, EMBEDDER, embedding.name_vectors(lake, EMBEDDER)), "table_name", "tile_id")


_SQL_TRUTH_CELLS = (
    f"{_CELL_PARTS}, {sql_truth_rows(BLOCKS, 'star')}, {sql_truth_cols(BLOCKS, 'star')},"
    " inside as (select gt_name, parts.* from truth_rows join truth_cols using (gt_name, table_name) join parts using (table_name, row_id, col_pos)),"
    " rv as (select table_name, row_id, " + ", ".join(f"avg(c{i}) as r{i}" for i in R) + " from parts group by table_name, row_id)"
)


def _truth_vectors(spark, sf_dir, component):
    lake = star_lake(spark, sf_dir, STAR, "star")
    spans = provenance.ground_truth_tiles(lake, BLOCKS)
    found = embedding.embed_tiles(melt(lake), spans, component, EMBEDDER, embedding.name_vectors(lake, EMBEDDER))
    return found.withColumn("gt_name", F.regexp_extract("tile_id", "^ground-truth-(.*)/", 1))


@query(
    "truth_tile_embedding",
    f"with {_SQL_TRUTH_CELLS} select gt_name, table_name, " + ", ".join(f"round(avg(4 * t{i} + n{i} + c{i} + 2 * r{i}) / 8, 6) + 0.0 as v{i}" for i in R)
    + " from inside join rv using (table_name, row_id) group by gt_name, table_name",
)
def truth_tile_embedding(spark, sf_dir):
    return _out(_truth_vectors(spark, sf_dir, "tile"), "gt_name", "table_name")


@query(
    "tile_rows_embedding",
    f"with {_SQL_TRUTH_CELLS} select gt_name, table_name, row_id, " + ", ".join(f"round(avg(c{i}), 6) + 0.0 as v{i}" for i in R) + " from inside group by gt_name, table_name, row_id",
)
def tile_rows_embedding(spark, sf_dir):
    return _out(_truth_vectors(spark, sf_dir, "tile-rows"), "gt_name", "table_name", "row_id")


@query(
    "tile_cols_embedding",
    f"with {_SQL_TRUTH_CELLS} select gt_name, table_name, col_pos, " + ", ".join(f"round(avg(c{i} + n{i}) / 2, 6) + 0.0 as v{i}" for i in R) + " from inside group by gt_name, table_name, col_pos",
)
def tile_cols_embedding(spark, sf_dir):
    return _out(_truth_vectors(spark, sf_dir, "tile-cols"), "gt_name", "table_name", "col_pos")


@query(
    "tile_cells_embedding",
    f"with {_SQL_TRUTH_CELLS} select gt_name, table_name, row_id, col_pos, " + ", ".join(f"round((t{i} + n{i} + 2 * c{i}) / 4, 6) + 0.0 as v{i}" for i in R) + " from inside",
)
def tile_cells_embedding(spark, sf_dir):
    return _out(_truth_vectors(spark, sf_dir, "tile-cells"), "gt_name", "table_name", "row_id", "col_pos")


@query(
    "incremental_embed",
    f"with {SQL_CHAT_CELLS}, todo as (select * from cells where not (row_id < 2 and table_name in (select 'conv-' || conv_id from conversations where turn = 3)))"
    " select table_name, row_id, col_pos, " + ", ".join(f"{sql_hash('value', i)} as v{i}" for i in R) + " from todo",
)
def incremental_embed(spark, sf_dir):
    cells = chat_cells(spark, sf_dir)
    keys = ["lake", "table_name", "row_id", "col_pos"]
    deep = cells.filter("row_id = 3").select("lake", "table_name").distinct()
    early = cells.filter("row_id < 2").join(deep, ["lake", "table_name"], "left_semi")
    others = cells.filter("row_id >= 2").select(*keys, F.lit("another model").alias("embedder_id"))
    done = early.select(*keys, F.lit(EMBEDDER.name).alias("embedder_id")).unionByName(others)
    todo = embedding.missing_embeddings(cells, done, keys, EMBEDDER)
    vectors = embedding.embed_texts(todo, F.col("value"), "vec", EMBEDDER)
    return vectors.select("table_name", "row_id", "col_pos", *vector_columns("vec", DIM, digits=None))
