"""Sources, sinks and lake-level operators."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from tessera.functions.text import normalize_name, truncate_value
from tessera.operators import embedding, profiling, provenance, tiles
from tessera.operators.rectangles import expand_rows
from tessera.plans.corpus import (
    BLOCKS, EMBEDDER, SQL_CHAT_CELLS, STAR, STAR_COLUMNS, chat_cells, sql_catalog, sql_cells, sql_name,
    sql_tables, sql_truth_cols, sql_truth_rows, star_lake, table,
)
from tessera.plans.registry import query
from tessera.session import checkpoint_dir
from tessera.sources import ground_truth, lake as lakes, stages
from tessera.sources.tables import number_rows, read_table, table_name_of


@query(
    "scan_parquet_table",
    "select 'customer' as table_name, row_number() over () - 1 as row_id, * from customer",
)
def scan_parquet_table(spark, sf_dir):
    path = f"{sf_dir}/customer.parquet"
    return read_table(spark, path).select(F.lit(table_name_of(path)).alias("table_name"), "*")


@query(
    "scan_csv_roundtrip",
    "select row_number() over () - 1 as row_id, * from part",
)
def scan_csv_roundtrip(spark, sf_dir):
    path = os.path.join(checkpoint_dir(spark), f"part-{uuid.uuid4().hex}.csv")
    table(spark, sf_dir, "part").write.option("header", True).option("escape", '"').csv(path)
    return read_table(spark, path, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double")


_OTHERS = {"benchmark": 2, "conversations": 4, "documents": 5, "embeddings": 3, "labels": 3, "pages": 3}


@query(
    "lake_catalog",
    f"with {sql_catalog()} select lake, table_name, n_rows, n_cols, num_cells from tables"
    + "".join(f" union all select 'star', '{t}', count(*), {n}, count(*) * {n} from {t}" for t, n in _OTHERS.items()),
)
def lake_catalog(spark, sf_dir):
    """Every table of the folder."""
    return lakes.catalog(lakes.lake_from_directory(spark, "star", sf_dir))


@query(
    "lake_from_catalog",
    "select 'catalog' as lake, table_name, n_rows, n_cols, num_cells from (" + sql_catalog(STAR, "catalog")[len("tables as ("):-1] + ")",
)
def lake_from_catalog(spark, sf_dir):
    """The catalog is read before the database is dropped; its tables are external, so dropping them keeps the files."""
    tag = f"lc{uuid.uuid4().hex[:12]}"
    spark.sql(f"CREATE DATABASE {tag} LOCATION '{os.path.join(checkpoint_dir(spark), tag)}'")
    try:
        for name in STAR:
            spark.sql(f"CREATE TABLE {tag}.{name} USING parquet LOCATION '{sf_dir}/{name}.parquet'")
        return lakes.catalog(lakes.lake_from_catalog(spark, "catalog", tag))
    finally:
        spark.sql(f"DROP DATABASE {tag} CASCADE")


_CHAT_RECORDS = (
    "select 'page title: ' || first_role || ', section title: ' || n || ', caption: ' || len as composed, conv_id from ("
    "select conv_id, min_by(role, turn) as first_role, count(*) as n, max(length(text)) // 500 as len from conversations group by conv_id)"
)


def _chat_titles(spark, sf_dir):
    """The titles of a conversation, as a corpus record would have them."""
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.min_by("role", "turn").alias("page_title"),
        F.count(F.lit(1)).cast("string").alias("section_title"),
        F.floor(F.max(F.length("text")) / 500).cast("string").alias("caption"),
    )


def _chat_corpus(spark, sf_dir):
    """Conversations as corpus records; a long one is several records of 1000 turns with their first row."""
    turns = table(spark, sf_dir, "conversations").withColumn("first_row", F.floor(F.col("turn") / 1000) * 1000)
    pairs = F.array_sort(F.collect_list(F.struct("turn", F.array("role", "text").alias("r"))))
    return turns.groupBy("conv_id", "first_row").agg(
        F.array(F.lit("role"), F.lit("text")).alias("header"), F.transform(pairs, lambda x: x["r"]).alias("rows")
    )


@query("corpus_tables_to_cells", f"with {SQL_CHAT_CELLS} select 'corpus' as lake, table_name, row_id, col_pos, col_name, value from cells")
def corpus_tables_to_cells(spark, sf_dir):
    path = os.path.join(checkpoint_dir(spark), f"tables-{uuid.uuid4().hex}.json")
    _chat_corpus(spark, sf_dir).withColumn("name", F.concat(F.lit("conv-"), F.col("conv_id"))).write.json(path)
    records = spark.read.schema("name string, first_row long, header array<string>, rows array<array<string>>").json(path)
    return lakes.corpus_to_cells(records, "corpus", "name", "first_row")


@query(
    "dedupe_table_names",
    f"select conv_id, case when conv_id = min(conv_id) over (partition by composed) then composed"
    f" else composed || ' ' || conv_id end as table_name from ({_CHAT_RECORDS})",
)
def dedupe_table_names(spark, sf_dir):
    records = _chat_titles(spark, sf_dir).withColumn("composed", lakes.composed_name("page_title", "section_title", "caption"))
    return lakes.disambiguate_names(records, "composed", "conv_id", "conv_id").select("conv_id", "table_name")


@query(
    "ground_truth_load",
    "select lake, gt_name, partition, information_need, md5(data) as data_md5 from (select source as lake, 'ground-truth-' ||"
    " (row_number() over (partition by lang = 'en' order by doc_id) - 1) as gt_name, case when lang = 'en' then 'train-or-val' else 'test' end as partition,"
    " lang || ' ' || n_chars as information_need, '{\"db_id\":\"' || source || '\",\"lang\":\"' || lang ||"
    " '\",\"query\":\"select ' || doc_id || '\",\"question\":\"' || lang || ' ' || n_chars || '\"}' as data from documents)",
)
def ground_truth_load(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        F.col("source").alias("db_id"), F.concat_ws(" ", "lang", "n_chars").alias("question"),
        F.concat(F.lit("select "), F.col("doc_id")).alias("query"), "lang", "doc_id",
    )
    root = os.path.join(checkpoint_dir(spark), f"questions-{uuid.uuid4().hex}")
    for name, part in (("train", docs.filter("lang = 'en'")), ("dev", docs.filter("lang <> 'en'"))):
        part.sort("doc_id").drop("doc_id").write.json(f"{root}/{name}")
    groups = {"train-or-val": f"{root}/train", "test": f"{root}/dev"}
    loaded = ground_truth.load_ground_truths(spark, groups)
    return loaded.select("lake", "gt_name", "partition", "information_need", F.md5("data").alias("data_md5"))


_SQL_ROUNDTRIP = (
    f"with {sql_tables(STAR)}, {sql_cells(STAR, 'star')}, {sql_truth_rows()}, {sql_truth_cols()}"
    " select 'cells' as frame, table_name, row_id, col_name as name, value from cells"
    " union all select 'truths', table_name, row_id, gt_name, string_agg(col_pos::varchar, ',' order by col_pos) from truth_rows join truth_cols using (gt_name, table_name) group by all"
    " union all select 'vectors', table_name, -1, 'table', '8' from (select distinct table_name from cells)"
)


@query("lake_roundtrip", _SQL_ROUNDTRIP)
def lake_roundtrip(spark, sf_dir):
    """Cells, ground-truth tiles and table vectors of the lake written as one version and read back."""
    lake = star_lake(spark, sf_dir)
    root = os.path.join(checkpoint_dir(spark), f"versions-{uuid.uuid4().hex}")
    cells = lakes.melt(lake)
    stages.save_version({
        "cells": cells, "truths": provenance.ground_truth_tiles(lake, BLOCKS), "catalog": lakes.catalog(lake),
        "vectors": embedding.embed_table(cells, "table", EMBEDDER)}, root)
    read = stages.load_version(spark, root)
    shown = [
        read["cells"].select(F.lit("cells").alias("frame"), "table_name", "row_id", F.col("col_name").alias("name"), "value"),
        read["truths"].select(F.lit("truths").alias("frame"), "table_name", F.col("row_lo").alias("row_id"), F.col("gt_name").alias("name"), F.array_join("cols", ",").alias("value")),
        read["vectors"].join(read["catalog"].select("lake", "table_name"), ["lake", "table_name"]).select(
            F.lit("vectors").alias("frame"), "table_name", F.lit(-1).cast("long").alias("row_id"), F.lit("table").alias("name"), F.size("vec").cast("string").alias("value")),
    ]
    return shown[0].unionByName(shown[1]).unionByName(shown[2])


@query("melt_cells", f"with {sql_tables()}, {sql_cells()} select table_name, row_id, col_pos, value from cells")
def melt_cells(spark, sf_dir):
    return lakes.melt(star_lake(spark, sf_dir)).select("table_name", "row_id", "col_pos", "value")


@query(
    "unmelt_cells",
    "with t_part as (select *, row_number() over () - 1 as row_id from part) select row_id, "
    + ", ".join(f"cast({c} as varchar) as {c}" for c in STAR_COLUMNS["part"]) + " from t_part",
)
def unmelt_cells(spark, sf_dir):
    lake = star_lake(spark, sf_dir, ["part"])
    return lakes.unmelt(lakes.melt(lake), STAR_COLUMNS["part"]).drop("lake", "table_name")


@query("num_cells", f"with {sql_catalog()} select lake, count(*) as n_tables, cast(sum(num_cells) as bigint) as lake_cells from tables group by lake")
def num_cells(spark, sf_dir):
    return lakes.lake_sizes(lakes.require_cells(lakes.catalog(star_lake(spark, sf_dir))))


_SQL_ORDER_TABLES = (
    "order_tables as (select o_orderpriority as lake, 'order-' || o_orderkey as table_name, count(l_orderkey) as n_rows,"
    " count(l_orderkey) * 11 as num_cells from orders left join lineitem on l_orderkey = o_orderkey group by all)"
)


def _order_tables(spark, sf_dir):
    heads = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("lake"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    n_rows = F.coalesce("n", F.lit(0).cast("long"))
    return heads.join(lines, "k", "left").select(
        "lake", F.concat(F.lit("order-"), F.col("k")).alias("table_name"), n_rows.alias("n_rows"), (n_rows * 11).alias("num_cells")
    )


_SQL_CUSTOMER_LAKES = (
    "customer_tables as (select 'c' || c_custkey as lake, 'order-' || o_orderkey as table_name, count(l_orderkey) * 11 as num_cells"
    " from customer join orders on o_custkey = c_custkey left join lineitem on l_orderkey = o_orderkey group by all)"
)


def _customer_tables(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.concat(F.lit("order-"), F.col("o_orderkey")).alias("table_name"))
    sized = _order_tables(spark, sf_dir).select("table_name", "num_cells")
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"))
    joined = orders.join(known, "o_custkey", "left_semi").join(sized, "table_name")
    return joined.select(F.concat(F.lit("c"), F.col("o_custkey")).alias("lake"), "table_name", "num_cells")


@query(
    "drop_lakes_with_empty_table",
    f"with {_SQL_CUSTOMER_LAKES} select lake, table_name, num_cells from customer_tables"
    " where lake not in (select lake from customer_tables where num_cells = 0)",
)
def drop_lakes_with_empty_table(spark, sf_dir):
    return lakes.drop_lakes_with_empty_table(_customer_tables(spark, sf_dir))


@query(
    "corpus_catalog",
    f"with {_SQL_CUSTOMER_LAKES} select lake, table_name, num_cells // 11 as n_rows, 11 as n_cols, num_cells, lake in (select lake from customer_tables where num_cells = 0) as dropped from customer_tables",
)
def corpus_catalog(spark, sf_dir):
    """Orders as corpus records, those without lines included; lakes with such a table are dropped."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.collect_list(F.array(*[F.col(c).cast("string") for c in STAR_COLUMNS["lineitem"]])).alias("rows"))
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"))
    records = table(spark, sf_dir, "orders").join(known, "o_custkey", "left_semi").join(lines, "o_orderkey", "left").select(
        F.concat(F.lit("c"), F.col("o_custkey")).alias("lake"), F.concat(F.lit("order-"), F.col("o_orderkey")).alias("table_name"),
        F.array(*[F.lit(c) for c in STAR_COLUMNS["lineitem"]]).alias("header"), "rows")
    tables = lakes.corpus_catalog(records, F.col("lake"))
    left = lakes.drop_lakes_with_empty_table(tables).select("lake").distinct().withColumn("dropped", F.lit(False))
    return tables.join(left, "lake", "left").withColumn("dropped", F.coalesce("dropped", F.lit(True)))


@query(
    "skip_large_lakes",
    f"with {_SQL_CUSTOMER_LAKES} select lake, table_name, num_cells from customer_tables"
    " where lake in (select lake from customer_tables group by lake having sum(num_cells) <= 412)",
)
def skip_large_lakes(spark, sf_dir):
    return lakes.skip_large_lakes(_customer_tables(spark, sf_dir), 412)


@query(
    "largest_tables",
    f"with {_SQL_ORDER_TABLES} select lake, table_name, num_cells from order_tables order by num_cells desc, table_name limit 300",
)
def largest_tables(spark, sf_dir):
    return lakes.largest_tables(_order_tables(spark, sf_dir).select("lake", "table_name", "num_cells"), 300)


@query(
    "remove_table_cascade",
    f"with {sql_tables()}, {sql_truth_rows()}, {sql_catalog()}, keep as (select table_name from tables where num_cells > 1000)"
    " select 'table' as what, table_name, 0 as n from keep union all"
    " select 'tile row', table_name, count(*) from truth_rows where table_name in (select table_name from keep) group by table_name",
)
def remove_table_cascade(spark, sf_dir):
    lake = star_lake(spark, sf_dir)
    catalog = lakes.catalog(lake)
    frames = {"tables": catalog, "tiles": provenance.provenance_rows(lake, BLOCKS)}
    left = lakes.remove_tables(frames, catalog.filter("num_cells <= 1000"))
    kept = left["tables"].select(F.lit("table").alias("what"), "table_name", F.lit(0).cast("long").alias("n"))
    rows = left["tiles"].groupBy("table_name").agg(F.count(F.lit(1)).alias("n"))
    return kept.unionByName(rows.select(F.lit("tile row").alias("what"), "table_name", "n"))


@query(
    "row_ids",
    "select l_orderkey, l_partkey, l_suppkey, l_linenumber, row_number() over (order by "
    + ", ".join(STAR_COLUMNS["lineitem"]) + ") - 1 as row_id from lineitem",
)
def row_ids(spark, sf_dir):
    numbered = number_rows(table(spark, sf_dir, "lineitem"), STAR_COLUMNS["lineitem"])
    return numbered.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "row_id")


_SQL_SHUFFLED = (
    "all_rows as (" + " union all ".join(f"select '{t}' as table_name, row_id from t_{t}" for t in STAR) + "),"
    " all_cols as (select table_name, unnest(range(0, n_cols)) as col_pos from tables),"
    " rows_new as (select table_name, row_id, row_number() over (partition by table_name order by md5('7|star|' || table_name || '|' || row_id), row_id) - 1 as new_row from all_rows),"
    " cols_new as (select table_name, col_pos, row_number() over (partition by table_name order by md5('8|star|' || table_name || '|' || col_pos), col_pos) - 1 as new_col from all_cols)"
)


@query(
    "shuffle_remap",
    f"with {sql_tables()}, {sql_truth_rows()}, {sql_truth_cols()}, {sql_catalog()}, {_SQL_SHUFFLED}"
    " select gt_name, table_name, new_row, string_agg(new_col::varchar, ',' order by new_col) as cols from truth_rows"
    " join truth_cols using (gt_name, table_name) join rows_new using (table_name, row_id) join cols_new using (table_name, col_pos) group by all",
)
def shuffle_remap(spark, sf_dir):
    """Rows and columns of every table shuffled; the ground-truth tiles as they lie afterwards."""
    lake = star_lake(spark, sf_dir)
    rows, cols = tiles.shuffle_maps(lakes.catalog(lake), 7)
    moved = tiles.shuffle_spans(provenance.ground_truth_tiles(lake, BLOCKS), rows, cols)
    return expand_rows(moved).select("gt_name", "table_name", F.col("row_id").alias("new_row"), F.array_join("cols", ",").alias("cols"))


@query(
    "limit_gt_per_lake",
    "select lake, gt_name from (select source as lake, 'ground-truth-' || doc_id as gt_name, row_number() over (partition by source"
    " order by md5('11|ground-truth-' || doc_id), 'ground-truth-' || doc_id) as r from documents) where r <= 20",
)
def limit_gt_per_lake(spark, sf_dir):
    truths = table(spark, sf_dir, "documents").select(
        F.col("source").alias("lake"), F.concat(F.lit("ground-truth-"), F.col("doc_id")).alias("gt_name")
    )
    return tiles.limit_per_lake(truths, 20, 11, "gt_name")


@query(
    "assign_partitions",
    "with lakes as (select 'u' || user_id as lake, bool_or(event_type = 'signup' and value > 100) as is_test, count(*) >= 3 as suitable"
    " from events group by user_id) select lake, case when is_test then 'test' when row_number() over (partition by is_test order by"
    " md5('13|' || lake), lake) <= 100 then 'val' else 'train' end as partition from lakes where suitable",
)
def assign_partitions(spark, sf_dir):
    per_user = table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.max((F.col("event_type") == "signup") & (F.col("value") > 100)).alias("is_test"), (F.count(F.lit(1)) >= 3).alias("suitable")
    )
    found = per_user.select(F.concat(F.lit("u"), F.col("user_id")).alias("lake"), "is_test", "suitable")
    return tiles.assign_partitions(found, 100, 13)


@query("lake_profile", f"with {_SQL_ORDER_TABLES} select lake, count(*) as n_tables, cast(sum(num_cells) as bigint) as lake_cells, min(n_rows) as min_rows,"
       " max(n_rows) as max_rows, avg(n_rows) as avg_rows, 11 as max_cols, max(num_cells) as max_cells from order_tables group by lake")
def lake_profile(spark, sf_dir):
    return profiling.lake_profile(_order_tables(spark, sf_dir).withColumn("n_cols", F.lit(11)))


@query(
    "result_profile",
    f"with {sql_tables()}, {sql_truth_rows()}, {sql_truth_cols()}, per_table as (select gt_name, table_name, count(*) as n from truth_rows group by all),"
    " widths as (select gt_name, table_name, count(*) as w from truth_cols group by all)"
    " select 'star' as lake, gt_name, count(*) as n_tables, cast(sum(n * w) as bigint) as num_cells from per_table join widths using (gt_name, table_name) group by gt_name",
)
def result_profile(spark, sf_dir):
    from tessera.operators.rectangles import covered_cells

    spans = provenance.ground_truth_tiles(star_lake(spark, sf_dir), BLOCKS)
    return profiling.result_profile(covered_cells(spans, ["lake", "gt_name"]), spans)


def _histogram_sql(log: bool) -> str:
    values = "vals as (select count(*) * 2 as v from conversations group by conv_id)" if not log else "vals as (select n_chars as v from documents)"
    if log:
        bins = (
            "bins as (select b, case when b = 0 then 0.0 else 10.0 ** (b - 1) end as bin_lo, 10.0 ** b as bin_hi"
            " from (select unnest(range(0, (select length(max(v)::varchar) - 1 + 3 from vals))) as b))"
        )
        hit = "case when v = 0 then 0 else length(v::varchar) end"
    else:
        bins = (
            "ends as (select min(v) as lo, max(v) as hi from vals), bins as (select b, (lo + b)::double as bin_lo, (lo + b + 1)::double as bin_hi"
            " from ends, (select unnest(range(0, (select hi - lo from ends))) as b))"
        )
        hit = "least(v - (select lo from ends), (select hi - lo - 1 from ends))"
    return (
        f"with {values}, {bins}, hits as (select {hit} as b, count(*) as n from vals group by 1)"
        " select bin_lo::double as bin_lo, bin_hi::double as bin_hi, coalesce(n, 0) as n from bins left join hits using (b)"
    )


@query("profile_histogram_linear", _histogram_sql(False))
def profile_histogram_linear(spark, sf_dir):
    sizes = lakes.catalog_of_cells(chat_cells(spark, sf_dir))
    return profiling.histogram(sizes, "num_cells")


@query("profile_histogram_log", _histogram_sql(True))
def profile_histogram_log(spark, sf_dir):
    return profiling.histogram(table(spark, sf_dir, "documents"), "n_chars", log=True)


@query(
    "normalize_names",
    f"select lang || '-' || source || '_' || doc_id as name, {sql_name("lang || '-' || source || '_' || doc_id")} as normalized from documents",
)
def normalize_names(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    name = F.concat(F.col("lang"), F.lit("-"), F.col("source"), F.lit("_"), F.col("doc_id"))
    return docs.select(name.alias("name"), normalize_name(name).alias("normalized"))


@query("truncate_values", f"with {SQL_CHAT_CELLS} select lake, table_name, row_id, col_name, substr(value, 1, 30) as value from cells")
def truncate_values(spark, sf_dir):
    return chat_cells(spark, sf_dir).select("lake", "table_name", "row_id", "col_name", truncate_value(F.col("value")).alias("value"))


@query(
    "component_texts",
    f"with {sql_tables(STAR)}, {sql_cells()} select table_name, row_id, col_pos, coalesce(value, 'nan') as cell_text,"
    f" {sql_name('col_name')} as col_text, {sql_name('table_name')} as table_text from cells",
)
def component_texts(spark, sf_dir):
    return embedding.component_texts(lakes.melt(star_lake(spark, sf_dir))).drop("lake")
