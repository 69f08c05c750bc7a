"""Retrieval of tiles per question."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.vectors import mean_vector
from tessera.operators import embedding, retrieval, slicing
from tessera.operators.provenance import provenance_columns, provenance_rows
from tessera.plans.corpus import (
    BLOCKS, DIM, EMBEDDER, sql_catalog, sql_hash, sql_tables, sql_truth_cols, sql_truth_rows, star_lake, table,
)
from tessera.plans.registry import query
from tessera.session import materialize
from tessera.sources.lake import catalog


# every embedding is a tile of one lake; the questions are the means of the labels
_SQL_VECTORS = (
    "vecs as (select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings),"
    " q as (select label, list(m order by pos) as q from (select label, pos, avg(x) as m from (select label, unnest(e) as x, unnest(range(0, 64)) as pos from vecs) group by all) group by label),"
    " pairs as (select 'all' as lake, 'label-' || q.label as gt_name, 'vec-' || vec_id as tile_id, list_dot_product(e, q) as ip,"
    " list_dot_product(e, q) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q))) as cos from vecs, q)"
)


def _questions(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("vec"))
    return mean_vector(vectors, ["label"], "vec", 64).select(
        F.lit("all").alias("lake"), F.concat(F.lit("label-"), F.col("label")).alias("gt_name"), "vec"
    )


def _tiles(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        F.lit("all").alias("lake"), F.concat(F.lit("vec-"), F.col("vec_id")).alias("tile_id"), F.col("embedding").cast("array<double>").alias("vec")
    )


@query("retrieve_cosine", f"with {_SQL_VECTORS} select gt_name, tile_id, round(round(greatest(0, least(2, 1 - cos)), 10), 6) + 0.0 as distance from pairs")
def retrieve_cosine(spark, sf_dir):
    found = retrieval.retrieve(_questions(spark, sf_dir), _tiles(spark, sf_dir), k=None)
    return found.select("gt_name", "tile_id", (F.round("distance", 6) + 0.0).alias("distance"))


@query("retrieve_threshold", f"with {_SQL_VECTORS} select gt_name, tile_id, round(round(greatest(0, least(2, 1 - cos)), 10), 6) + 0.0 as distance from pairs where round(1 - cos, 10) <= 0.9")
def retrieve_threshold(spark, sf_dir):
    found = retrieval.retrieve(_questions(spark, sf_dir), _tiles(spark, sf_dir), k=None, threshold=0.9)
    return found.select("gt_name", "tile_id", (F.round("distance", 6) + 0.0).alias("distance"))


@query(
    "retrieve_topk",
    f"with {_SQL_VECTORS} select gt_name, tile_id, rank from (select gt_name, tile_id, row_number() over (partition by gt_name order by round(1 - cos, 10), tile_id) as rank from pairs) where rank <= 50",
)
def retrieve_topk(spark, sf_dir):
    return retrieval.retrieve(_questions(spark, sf_dir), _tiles(spark, sf_dir), k=50).select("gt_name", "tile_id", "rank")


@query(
    "retrieve_inner_product",
    f"with {_SQL_VECTORS}, m as (select gt_name, tile_id, ip, avg(ip) over (partition by gt_name) as mean from pairs),"
    " s as (select *, max(abs(ip - mean)) over (partition by gt_name) as spread from m)"
    " select gt_name, tile_id, round(1 - ((round(ip, 10) - mean) / spread / 2 + 0.5), 6) + 0.0 as distance from s",
)
def retrieve_inner_product(spark, sf_dir):
    found = retrieval.retrieve(_questions(spark, sf_dir), _tiles(spark, sf_dir), retrieval.INNER_PRODUCT, k=None)
    return found.select("gt_name", "tile_id", (F.round("distance", 6) + 0.0).alias("distance"))


# questions asked of the documents of a source, both embedded by their text
_SQL_DOCS = (
    "d as (select source as lake, 'doc-' || doc_id as tile_id, " + ", ".join(f"{sql_hash('text', i)} as v{i}" for i in range(DIM)) + " from documents),"
    " b as (select 'src' || (item_id % 20) as lake, 'question-' || item_id as gt_name, " + ", ".join(f"{sql_hash('text', i)} as w{i}" for i in range(DIM)) + " from benchmark),"
    " dist as (select d.lake, gt_name, tile_id, round(1 - ("
    + " + ".join(f"v{i} * w{i}" for i in range(DIM)) + ") / (sqrt(" + " + ".join(f"v{i} * v{i}" for i in range(DIM)) + ") * sqrt("
    + " + ".join(f"w{i} * w{i}" for i in range(DIM)) + ")), 10) as distance from d join b using (lake))"
)


def document_questions(spark, sf_dir):
    """Every benchmark text, asked of one source."""
    asked = table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("src"), F.col("item_id") % 20).alias("lake"), F.concat(F.lit("question-"), F.col("item_id")).alias("gt_name"), "text"
    )
    return embedding.embed_questions(asked, EMBEDDER, "text")


def document_tiles(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("lake"), F.concat(F.lit("doc-"), F.col("doc_id")).alias("tile_id"), "text")
    return embedding.embed_texts(docs, F.col("text"), "vec", EMBEDDER)


def ranked_documents(spark, sf_dir, k=retrieval.LIMIT):
    return retrieval.retrieve(document_questions(spark, sf_dir), document_tiles(spark, sf_dir).drop("text"), k=k)


SQL_RANKED = (
    f"{_SQL_DOCS}, ranked as (select lake, gt_name, tile_id, distance, row_number() over (partition by lake, gt_name order by distance, tile_id) as rank from dist)"
)


@query("rank_documents", f"with {SQL_RANKED} select lake, gt_name, tile_id, rank from ranked where rank <= 2000")
def rank_documents(spark, sf_dir):
    return ranked_documents(spark, sf_dir).select("lake", "gt_name", "tile_id", "rank")


def sql_perfect(tiles_per_table: int) -> str:
    """Ranking ``d (gt_name, tile_id, distance)`` of row-wise tiles by the share of their cells outside the truth."""
    return (
        f"{sql_tables()}, {sql_truth_rows()}, {sql_truth_cols()}, {sql_catalog()}, g as (select table_name, n_rows, n_cols, ceil(n_rows / (1 + ({tiles_per_table - 1} * (select count(*) from tables) * num_cells)"
        " // (select cast(sum(num_cells) as bigint) from tables)))::bigint as s from tables),"
        " t as (select table_name, n_rows, n_cols, s, unnest(range(0, ceil(n_rows / s)::bigint)) as b from g),"
        " sizes as (select table_name || '/' || b || '/0' as tile_id, (least((b + 1) * s, n_rows) - b * s) * n_cols as num_cells from t),"
        " hits as (select gt_name, table_name || '/' || (row_id // s) || '/0' as tile_id, count(*) as num_in from truth_rows join truth_cols using (gt_name, table_name) join g using (table_name) group by all),"
        " names as (select distinct gt_name from truth_cols), d as (select gt_name, tile_id, 1.0::double - coalesce(num_in, 0) / num_cells as distance from names cross join sizes left join hits using (gt_name, tile_id))"
    )


@query(
    "retrieve_perfect",
    f"with {sql_perfect(100)} select * from (select gt_name, tile_id, round(distance, 9) as distance, row_number() over (partition by gt_name order by distance, tile_id) as rank from d) where rank <= 2000",
)
def retrieve_perfect(spark, sf_dir):
    lake = star_lake(spark, sf_dir)
    strides = slicing.grid(catalog(lake), [("rowwise", 100)])
    tiles = slicing.grid_tiles(strides).select("lake", "tile_id", "num_cells")
    truth_cols = provenance_columns(lake, BLOCKS)
    hits = materialize(slicing.grid_hits(strides, provenance_rows(lake, BLOCKS), truth_cols), "hits")
    found = retrieval.retrieve_perfect(hits, tiles, truth_cols)
    return found.select("gt_name", "tile_id", F.round("distance", 9).alias("distance"), "rank")


