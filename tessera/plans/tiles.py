"""Tile look-ups, checks and rectangle algebra."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import rectangles, slicing, tiles
from tessera.operators.packing import wide_rows
from tessera.operators.provenance import Block, ground_truth_tiles
from tessera.plans.corpus import (
    BLOCKS, STAR, sql_catalog, sql_cells, sql_tables, sql_truth_cols, sql_truth_rows, star_lake, table,
)
from tessera.plans.registry import query
from tessera.session import materialize
from tessera.sources.lake import catalog

# results of a search: several overlapping tiles per question, named <question>#<ordinal>
RESULTS = [
    Block("builders#1", "customer", "c_nationkey < 10", ("c_custkey", "c_name", "c_mktsegment")),
    Block("builders#2", "customer", "c_acctbal < 1000", ("c_mktsegment", "c_acctbal")),
    Block("debtors#1", "customer", "c_acctbal < 500", ("c_acctbal",)),
    Block("large-parts#1", "part", "p_size > 40", ("p_partkey", "p_size", "p_brand")),
    Block("large-parts#2", "part", "p_size > 30 AND p_type = 'ECONOMY'", ("p_name", "p_size")),
    Block("large-parts#3", "supplier", "s_acctbal > 9500", ("s_name",)),
    Block("large-orders#1", "orders", "o_totalprice > 300000", ("o_orderkey", "o_totalprice")),
    Block("large-orders#2", "orders", "o_orderpriority = '1-URGENT'", ("o_totalprice", "o_orderpriority")),
    Block("returned#1", "lineitem", "l_quantity > 45", ("l_orderkey", "l_quantity")),
    Block("returned#2", "lineitem", "l_returnflag = 'R'", ("l_returnflag", "l_discount")),
    Block("errors#1", "events", "event_type <> 'view'", ("event_id", "event_type", "value")),
]
FIRST = [b for b in RESULTS if b.gt_name.endswith("#1")]


def result_spans(spark, sf_dir, blocks=RESULTS):
    spans = ground_truth_tiles(star_lake(spark, sf_dir), blocks).withColumnRenamed("gt_name", "name")
    return spans.select(
        "lake", "table_name", F.col("name").alias("tile_id"), "row_lo", "row_hi", "cols",
        F.substring_index("name", "#", 1).alias("gt_name"), F.substring_index("name", "#", -1).cast("int").alias("ordinal"),
    )


def truth_spans(spark, sf_dir):
    return ground_truth_tiles(star_lake(spark, sf_dir), BLOCKS)


SQL_RESULTS = (
    f"{sql_tables()}, {sql_truth_rows(RESULTS).replace('truth_rows', 'named_rows')}, {sql_truth_cols(RESULTS).replace('truth_cols', 'named_cols')},"
    " result_rows as (select lake, gt_name as tile_id, string_split(gt_name, '#')[1] as gt_name, string_split(gt_name, '#')[2]::int as ordinal, table_name, row_id from named_rows),"
    " result_cols as (select gt_name as tile_id, col_pos from named_cols),"
    " tile_cells as (select lake, gt_name, tile_id, ordinal, table_name, row_id, col_pos from result_rows join result_cols using (tile_id)),"
    " result_cells as (select distinct lake, gt_name, table_name, row_id, col_pos from tile_cells)"
)
SQL_TRUTH = f"{sql_truth_rows()}, {sql_truth_cols()}, truth_cells as (select lake, gt_name, table_name, row_id, col_pos from truth_rows join truth_cols using (lake, gt_name, table_name))"


@query(
    "tile_extract",
    f"with {SQL_RESULTS}, {sql_cells()} select tile_id, row_id, col_pos, value from tile_cells join cells using (table_name, row_id, col_pos)",
)
def tile_extract(spark, sf_dir):
    lake = star_lake(spark, sf_dir)
    used = lake.only(sorted({b.table for b in RESULTS}))
    return tiles.tile_cells_of_rows(result_spans(spark, sf_dir), wide_rows(used)).select("tile_id", "row_id", "col_pos", "value")


def _mixed(spark, sf_dir):
    """Ground-truth tiles and row-wise slices in one tile set."""
    strides = slicing.grid(catalog(star_lake(spark, sf_dir)), [("rowwise", 100)])
    columns = ["lake", "table_name", "tile_id", "kind"]
    return truth_spans(spark, sf_dir).select(*columns).distinct().unionByName(slicing.grid_tiles(strides).select(*columns))


_SQL_MIXED = (
    f"{sql_tables()}, {sql_truth_rows()}, {sql_catalog()}, b as (select table_name, n_rows, ceil(n_rows / (1 + (99 * (select count(*) from tables) * num_cells)"
    " // (select cast(sum(num_cells) as bigint) from tables)))::bigint as s from tables),"
    " mixed as (select distinct 'ground-truth-' || gt_name as kind, table_name, 'ground-truth-' || gt_name || '/' || table_name as tile_id from truth_rows"
    " union all select 'slice-tile', table_name, table_name || '/' || unnest(range(0, ceil(n_rows / s)::bigint)) || '/0' from b)"
)


@query(
    "tiles_by_kind",
    f"with {_SQL_MIXED} select kind, table_name, tile_id from mixed where kind in ('slice-tile', 'ground-truth-debtors')",
)
def tiles_by_kind(spark, sf_dir):
    return tiles.tiles_of_kind(_mixed(spark, sf_dir), ["slice-tile", "ground-truth-debtors"]).select("kind", "table_name", "tile_id")


@query(
    "tileset_distinct",
    f"with {_SQL_MIXED} select 'lake' as level, 1 as n union all select 'table', count(distinct table_name) from mixed where kind = 'slice-tile'"
    " union all select 'tile', count(distinct tile_id) from mixed where table_name = 'customer' union all select 'kind', count(distinct kind) from mixed",
)
def tileset_distinct(spark, sf_dir):
    mixed = materialize(_mixed(spark, sf_dir), "tiles")
    parts = [
        ("lake", tiles.distinct_members(mixed, "lake")),
        ("table", tiles.distinct_members(mixed, "table", lake="star", kind="slice-tile")),
        ("tile", tiles.distinct_members(mixed, "tile", table="customer")),
        ("kind", tiles.distinct_members(mixed, "kind")),
    ]
    counted = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(level).alias("level"), "n") for level, df in parts]
    return counted[0].unionByName(counted[1]).unionByName(counted[2]).unionByName(counted[3])


@query(
    "invalid_tiles",
    f"with {sql_catalog(['part', 'supplier'])}, t as (select case l_linenumber % 3 when 0 then 'part' when 1 then 'supplier' else 'nope' end as table_name,"
    " 'line-' || l_orderkey || '-' || l_linenumber as tile_id, l_partkey - l_suppkey as row_lo, l_linenumber as col from lineitem),"
    " r as (select t.table_name, tile_id, case when n_rows is null then 'no such table' when row_lo < 0 or row_lo + 1 > n_rows then 'no such row'"
    " when col >= n_cols then 'no such column' end as reason from t left join tables on t.table_name = tables.table_name)"
    " select table_name, tile_id, min(reason) as reason from r where reason is not null group by all",
)
def invalid_tiles(spark, sf_dir):
    k = F.col("l_linenumber") % 3
    name = F.when(k == 0, "part").when(k == 1, "supplier").otherwise("nope")
    low = F.col("l_partkey") - F.col("l_suppkey")
    spans = table(spark, sf_dir, "lineitem").select(
        F.lit("star").alias("lake"), name.alias("table_name"), F.concat_ws("-", F.lit("line"), "l_orderkey", "l_linenumber").alias("tile_id"),
        low.alias("row_lo"), (low + 1).alias("row_hi"), F.array("l_linenumber").alias("cols"),
    )
    return tiles.invalid_tiles(spans, catalog(star_lake(spark, sf_dir, ["part", "supplier"]))).drop("lake")


@query(
    "embedding_shape_check",
    "select label, count(*) + label % 2 as n_expected, count(*) as n_vectors, case when label % 3 = 0 then count(*) else 0 end as n_wrong_length"
    " from embeddings group by label having label % 2 = 1 or label % 3 = 0",
)
def embedding_shape_check(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    short = F.slice("embedding", F.lit(1), F.when(F.col("label") % 3 == 0, 63).otherwise(64))
    expected = vectors.groupBy("label").agg((F.count(F.lit(1)) + F.any_value("label") % 2).alias("n_expected"))
    return tiles.wrong_embeddings(vectors.select("label", short.alias("vec")), 64, ["label"], expected)


@query("covered_cells", f"with {SQL_RESULTS} select gt_name, count(*) as num_cells from result_cells group by gt_name")
def covered_cells(spark, sf_dir):
    return rectangles.covered_cells(result_spans(spark, sf_dir), ["gt_name"])


@query(
    "tileset_overlap",
    f"with {SQL_RESULTS}, {SQL_TRUTH} select r.gt_name, count(t.row_id) as num_in, count(*) - count(t.row_id) as num_out"
    " from result_cells r left join truth_cells t using (gt_name, table_name, row_id, col_pos) group by r.gt_name",
)
def tileset_overlap(spark, sf_dir):
    return rectangles.tile_set_overlap(result_spans(spark, sf_dir), truth_spans(spark, sf_dir), ["gt_name"])


@query(
    "rect_overlap",
    f"with {SQL_RESULTS}, {SQL_TRUTH} select r.gt_name, r.table_name, count(*) as num_in"
    " from (select * from tile_cells where ordinal = 1) r join truth_cells t using (gt_name, table_name, row_id, col_pos) group by all",
)
def rect_overlap(spark, sf_dir):
    found = rectangles.rect_overlap(result_spans(spark, sf_dir, FIRST), truth_spans(spark, sf_dir), ["gt_name"])
    return found.filter("num_in > 0").select("gt_name", "table_name", "num_in")


@query("merge_none", f"with {SQL_RESULTS} select tile_id, table_name, row_id from result_rows")
def merge_none(spark, sf_dir):
    return rectangles.merge_none(result_spans(spark, sf_dir)).select("tile_id", "table_name", F.col("row_lo").alias("row_id"))


@query(
    "merge_closure",
    f"with {SQL_RESULTS}, c as (select gt_name, table_name, string_agg(col_pos::varchar, ',' order by col_pos) as cols from (select distinct gt_name, table_name, col_pos from tile_cells) group by all)"
    " select gt_name, table_name, row_id, cols from (select distinct gt_name, table_name, row_id from tile_cells) join c using (gt_name, table_name)",
)
def merge_closure(spark, sf_dir):
    merged = rectangles.merge_closure(result_spans(spark, sf_dir), ["gt_name"])
    return merged.select("gt_name", "table_name", F.col("row_lo").alias("row_id"), F.array_join("cols", ",").alias("cols"))


@query(
    "tile_union",
    f"with {SQL_RESULTS} select gt_name, table_name, count(distinct row_id) as n_rows, string_agg(distinct col_pos::varchar, ',' order by col_pos::varchar) as cols from tile_cells group by all",
)
def tile_union(spark, sf_dir):
    spans = result_spans(spark, sf_dir)
    rows = rectangles.union_rows(spans, ["gt_name", "table_name"]).groupBy("gt_name", "table_name").agg(F.count(F.lit(1)).alias("n_rows"))
    cols = rectangles.union_columns(spans, ["gt_name", "table_name"])
    return rows.join(cols, ["gt_name", "table_name"]).select("gt_name", "table_name", "n_rows", F.array_join("cols", ",").alias("cols"))


@query(
    "tile_intersect",
    f"with {SQL_RESULTS}, {SQL_TRUTH} select r.gt_name, r.table_name, count(distinct r.row_id) as n_rows, string_agg(distinct r.col_pos::varchar, ',' order by r.col_pos::varchar) as cols"
    " from (select * from tile_cells where ordinal = 1) r join truth_cells t using (gt_name, table_name, row_id, col_pos) group by all",
)
def tile_intersect(spark, sf_dir):
    both = rectangles.intersect(result_spans(spark, sf_dir, FIRST), truth_spans(spark, sf_dir), ["gt_name"])
    return both.groupBy("gt_name", "table_name").agg(
        F.count(F.lit(1)).alias("n_rows"), F.first(F.array_join("cols", ",")).alias("cols")
    )


@query(
    "coverage_mask",
    f"with {SQL_RESULTS}, {sql_catalog()}"
    " select r.tile_id, row_id, array_to_string(list_transform(range(0, n_cols), lambda p: case when list_contains(cs, p) then '1' else '0' end), '') as mask"
    " from result_rows r join tables using (table_name) join (select tile_id, list(col_pos) as cs from result_cols group by all) x using (tile_id)",
)
def coverage_mask(spark, sf_dir):
    masks = rectangles.coverage_mask(result_spans(spark, sf_dir), catalog(star_lake(spark, sf_dir)))
    text = F.array_join(F.transform("mask", lambda m: F.when(m, "1").otherwise("0")), "")
    return masks.select("tile_id", "row_id", text.alias("mask"))


@query(
    "cell_tile_annotation",
    f"with {SQL_RESULTS} select table_name, row_id, col_pos, string_agg(distinct ordinal::varchar, ',' order by ordinal::varchar) as tiles from tile_cells group by all",
)
def cell_tile_annotation(spark, sf_dir):
    cells = rectangles.covering_tiles(result_spans(spark, sf_dir), "ordinal")
    return cells.select("table_name", "row_id", "col_pos", F.array_join("tiles", ",").alias("tiles"))


@query(
    "sort_cells_by_tile",
    f"with {SQL_RESULTS}, {sql_cells()}, first_col as (select table_name, row_id, max(ordinal) as owner from tile_cells where col_pos = 0 group by all),"
    " all_rows as (" + " union all ".join(f"select '{t}' as table_name, row_id from t_{t}" for t in STAR) + "),"
    " rows_new as (select table_name, row_id, row_number() over (partition by table_name order by owner nulls last, row_id) - 1 as new_row from all_rows left join first_col using (table_name, row_id)),"
    " top as (select table_name, row_id from rows_new where new_row = 0),"
    " col_owner as (select table_name, col_pos, max(ordinal) as owner from tile_cells join top using (table_name, row_id) group by all),"
    " all_cols as (select distinct table_name, col_pos from cells),"
    " cols_new as (select table_name, col_pos, row_number() over (partition by table_name order by owner nulls last, col_pos) - 1 as new_col from all_cols left join col_owner using (table_name, col_pos))"
    " select table_name, new_row, new_col, value from cells join rows_new using (table_name, row_id) join cols_new using (table_name, col_pos)",
)
def sort_cells_by_tile(spark, sf_dir):
    lake = star_lake(spark, sf_dir)
    spans = result_spans(spark, sf_dir)
    rows, cols = tiles.order_by_owner(spans, catalog(lake), "ordinal")
    return tiles.cells_at(lake, rows.drop("owner"), cols.drop("owner")).select("table_name", "new_row", "new_col", "value")


