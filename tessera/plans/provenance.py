"""Ground truths: resolution, rows, columns and answers."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from tessera.functions.text import answer_columns, answer_text, list_answer
from tessera.operators import provenance, resolution
from tessera.plans.corpus import (
    BLOCKS, sql_tables, sql_truth_cols, sql_truth_rows, star_lake, table,
)
from tessera.plans.registry import query
from tessera.session import checkpoint_dir
from tessera.sources import ground_truth, stages

_PLAIN = [b for b in BLOCKS if "{" not in b.predicate]
_NESTED = [b for b in BLOCKS if "{" in b.predicate]


@query("provenance_rows", f"with {sql_tables()}, {sql_truth_rows(_PLAIN)} select gt_name, table_name, row_id from truth_rows")
def provenance_rows(spark, sf_dir):
    return provenance.provenance_rows(star_lake(spark, sf_dir), _PLAIN).drop("lake")


@query("provenance_rows_subquery", f"with {sql_tables()}, {sql_truth_rows(_NESTED)} select gt_name, table_name, row_id from truth_rows")
def provenance_rows_subquery(spark, sf_dir):
    return provenance.provenance_rows(star_lake(spark, sf_dir), _NESTED).drop("lake")


@query(
    "provenance_union",
    f"with {sql_tables()}, {sql_truth_rows()} select gt_name, table_name, count(*) as n_rows, cast(sum(row_id) as bigint) as row_sum from truth_rows group by all",
)
def provenance_union(spark, sf_dir):
    rows = provenance.provenance_rows(star_lake(spark, sf_dir), BLOCKS)
    return rows.groupBy("gt_name", "table_name").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("row_id").alias("row_sum"))


@query(
    "provenance_tile",
    f"with {sql_tables()}, {sql_truth_rows()}, {sql_truth_cols()}, w as (select gt_name, table_name,"
    " string_agg(col_pos::varchar, ',' order by col_pos) as cols from truth_cols group by all)"
    " select 'ground-truth-' || gt_name as kind, table_name, row_id, cols from truth_rows join w using (gt_name, table_name)",
)
def provenance_tile(spark, sf_dir):
    spans = provenance.ground_truth_tiles(star_lake(spark, sf_dir), BLOCKS)
    return spans.select("kind", "table_name", F.col("row_lo").alias("row_id"), F.array_join("cols", ",").alias("cols"))


_ANSWERS = {
    "orders-per-priority": "SELECT o_orderpriority, count(*) AS n FROM {orders} GROUP BY o_orderpriority",
    "asia-nations": "SELECT n_name FROM {nation} WHERE n_regionkey IN (SELECT r_regionkey FROM {region} WHERE r_name = 'ASIA')",
    "parts-of-brand": "SELECT p_brand, p_type, max(p_size) AS largest FROM {part} GROUP BY p_brand, p_type",
    "big-spenders": "SELECT c_custkey, count(*) AS n FROM {customer} JOIN {orders} ON o_custkey = c_custkey WHERE o_totalprice > 450000 GROUP BY c_custkey",
    "last-customers": "SELECT c_custkey, c_name FROM {customer} ORDER BY c_name DESC LIMIT 10",
}
_ORDERED = {"last-customers": "c_name DESC"}
_ANSWER_COLUMNS = {
    "orders-per-priority": ["o_orderpriority", "n"], "asia-nations": ["n_name"], "parts-of-brand": ["p_brand", "p_type", "largest"],
    "big-spenders": ["c_custkey", "n"], "last-customers": ["c_custkey", "c_name"],
}


def _answer_sql() -> str:
    parts = []
    for gt, q in _ANSWERS.items():
        plain = q.replace("{", "").replace("}", "")
        cols = _ANSWER_COLUMNS[gt]
        for i, c in enumerate(cols):
            parts.append(
                f"select '{gt}' as gt_name, {i} as col_pos, '{c}' as col_name, row_number() over (order by {_ORDERED.get(gt, ', '.join(cols))}) - 1 as pos,"
                f" {c}::varchar as value from ({plain})"
            )
    return " union all ".join(parts)


@query("answer_table", _answer_sql())
def answer_table(spark, sf_dir):
    return provenance.answer_table(star_lake(spark, sf_dir), _ANSWERS, _ORDERED)


_SQL_FIELD = "case when {x} is null then '' when regexp_matches({x}, '[\",\\r\\n]') then '\"' || replace({x}, '\"', '\"\"') || '\"' else {x} end"


@query(
    "answer_texts",
    f"with a as ({_answer_sql()}), lines as (select gt_name, pos, string_agg({_SQL_FIELD.format(x='value')}, ',' order by col_pos) as line from a group by all),"
    " heads as (select gt_name, string_agg(col_name, ',' order by col_pos) as header, string_agg(col_name, ', ' order by col_pos) as answer_columns from (select distinct gt_name, col_pos, col_name from a) group by all)"
    " select gt_name, answer_columns, header || chr(10) || string_agg(line, chr(10) order by pos) || chr(10) as answer from lines join heads using (gt_name) group by gt_name, answer_columns, header",
)
def answer_texts(spark, sf_dir):
    """Answers as maps, and from them the column list and the CSV text of a request."""
    maps = provenance.answer_maps(provenance.answer_table(star_lake(spark, sf_dir), _ANSWERS, _ORDERED))
    return maps.select("gt_name", answer_columns(F.col("answer_table")).alias("answer_columns"), answer_text(F.col("answer_table")).alias("answer"))


# every part is a query: its type names a table of the lake of its brand, its name a column
_SQL_PART_LAKE = (
    "cols as (select distinct p_brand as lake, p_type as table_name, p_name as col_name from part),"
    " tabs as (select distinct lake, table_name from cols)"
)


def _part_columns(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("lake"), F.col("p_type").alias("table_name"), F.col("p_name").alias("col_name")
    ).distinct()


def _part_queries(spark, sf_dir):
    gt = F.concat(F.lit("size-"), F.col("p_size")).alias("gt_name")
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("lake"), gt, "p_type", "p_name", "p_partkey")


_SQL_TABLE_REFS = (
    "refs as (select distinct p_brand as lake, 'size-' || p_size as gt_name, case when p_retailprice < 910 then 'Missing' else lower(p_type) end as ref from part)"
)


def _table_references(spark, sf_dir):
    ref = F.when(F.col("p_retailprice") < 910, F.lit("Missing")).otherwise(F.lower("p_type"))
    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("lake"), F.concat(F.lit("size-"), F.col("p_size")).alias("gt_name"), ref.alias("ref")
    )


_SQL_RESOLVED = (
    f"{_SQL_PART_LAKE}, {_SQL_TABLE_REFS}, res as (select r.lake, gt_name, ref, count(t.table_name) as n_matches,"
    " case when count(t.table_name) = 1 then min(t.table_name) end as table_name from refs r left join tabs t"
    " on t.lake = r.lake and lower(t.table_name) = lower(ref) group by all)"
)


@query("resolve_tables", f"with {_SQL_RESOLVED} select lake, gt_name, ref, n_matches, table_name from res")
def resolve_tables(spark, sf_dir):
    tables = _part_columns(spark, sf_dir).select("lake", "table_name").distinct()
    return resolution.resolve_tables(_table_references(spark, sf_dir), tables)


@query(
    "resolve_columns",
    f"with {_SQL_RESOLVED}, crefs as (select distinct p_brand as lake, 'size-' || p_size as gt_name, case when p_partkey % 4 = 0 then lower(p_type) || '.' ||"
    " upper(p_name) when p_partkey % 4 = 1 then 'db.' || p_type || '.' || p_name when p_partkey % 4 = 2 then 'no such column' else upper(p_name) end as ref from part),"
    " q as (select c.lake, c.gt_name, c.ref, len(string_split(c.ref, '.')) as n, string_split(c.ref, '.') as p from crefs c),"
    " m as (select q.lake, q.gt_name, q.ref, q.n, r.table_name, cols.col_name from q"
    " left join res r on r.lake = q.lake and r.gt_name = q.gt_name and r.table_name is not null and (q.n = 1 or (q.n = 2 and r.ref = q.p[1]))"
    " left join cols on cols.lake = q.lake and cols.table_name = r.table_name and lower(cols.col_name) = lower(q.p[case when q.n = 2 then 2 else 1 end])),"
    " a as (select lake, gt_name, ref, n, count(table_name) as t, count(col_name) as c, min(case when col_name is not null then table_name end) as tn,"
    " min(col_name) as cn from m group by all) select lake, gt_name, ref, c as n_matches, case when n > 2 then 'bad-name' when n = 2 and t = 0 then 'no-table'"
    " when c = 0 then 'no-match' when c > 1 then 'ambiguous' else 'ok' end as status, case when n <= 2 and c = 1 then tn end as table_name,"
    " case when n <= 2 and c = 1 then cn end as col_name from a",
)
def resolve_columns(spark, sf_dir):
    columns = _part_columns(spark, sf_dir)
    tables = resolution.resolve_tables(_table_references(spark, sf_dir), columns.select("lake", "table_name").distinct())
    k = F.col("p_partkey") % 4
    ref = (
        F.when(k == 0, F.concat(F.lower("p_type"), F.lit("."), F.upper("p_name")))
        .when(k == 1, F.concat(F.lit("db."), F.col("p_type"), F.lit("."), F.col("p_name")))
        .when(k == 2, F.lit("no such column"))
        .otherwise(F.upper("p_name"))
    )
    references = _part_queries(spark, sf_dir).select("lake", "gt_name", ref.alias("ref"))
    return resolution.resolve_columns(references, tables, columns)


@query(
    "gt_table_join",
    "select 'ground-truth-' || (row_number() over (order by l.doc_id) - 1) as gt_name, d.source as lake, 'doc ' || d.doc_id as table_name, l.doc_id || '?' as information_need,"
    " 'select ' || l.quality as sql_query, l.quality || ',' || l.toxic as answer from labels l join documents d using (doc_id)",
)
def gt_table_join(spark, sf_dir):
    """Questions that name their table, written as JSON and joined with the tables of the lakes."""
    path = os.path.join(checkpoint_dir(spark), f"questions-{uuid.uuid4().hex}")
    labels = table(spark, sf_dir, "labels")
    labels.sort("doc_id").select(
        F.concat(F.lit("t"), "doc_id").alias("original_table_id"), F.concat("doc_id", F.lit("?")).alias("question"), F.concat(F.lit("select "), "quality").alias("sql"),
        F.array(F.col("quality").cast("string"), F.col("toxic").cast("string")).alias("answer")).write.json(path)
    docs = table(spark, sf_dir, "documents")
    tables = docs.select(F.concat(F.lit("t"), "doc_id").alias("original_table_id"), F.col("source").alias("lake"), F.concat(F.lit("doc "), "doc_id").alias("table_name"))
    loaded = ground_truth.load_table_questions(spark, {"train": path}, tables)
    return loaded.select("gt_name", "lake", "table_name", "information_need", "sql_query", list_answer(F.col("answer_list")).alias("answer"))


@query(
    "gt_semi_anti",
    "select status, source, count(*) as n from (select d.source, case when l.doc_id is null then 'filtered out' else 'kept' end as status"
    " from documents d left join (select distinct doc_id from labels) l using (doc_id)) group by all",
)
def gt_semi_anti(spark, sf_dir):
    kept, gone = ground_truth.keep_ground_truths_of(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")
    both = kept.select(F.lit("kept").alias("status"), "source").unionByName(gone.select(F.lit("filtered out").alias("status"), "source"))
    return both.groupBy("status", "source").agg(F.count(F.lit(1)).alias("n"))


@query(
    "gt_kind_join",
    "select lang, count(*) as n, cast(sum(n_chars) as bigint) as chars from documents group by lang",
)
def gt_kind_join(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    name = F.concat(F.lit("ground-truth-"), F.col("doc_id"))
    truths = docs.select(name.alias("gt_name"), "lang")
    tiles = docs.select(ground_truth.tile_kind(name).alias("kind"), "n_chars")
    joined = tiles.withColumn("gt_name", ground_truth.gt_name_of_kind(F.col("kind"))).join(truths, "gt_name")
    return joined.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("gt_contains_where", "select conv_id, turn, contains(lower(text), 'where') as has_where from conversations")
def gt_contains_where(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", ground_truth.contains_where(F.col("text")).alias("has_where")
    )


_CHECKS = [
    ("contains *", "text LIKE '%*%'"),
    ("result is empty", "n_chars < 20"),
    ("no matching table", "lang NOT IN ('en', 'de', 'fr')"),
    ("no row index", "source = 'src3'"),
]


@query(
    "gt_skip_reasons",
    "select skip_reason, count(*) as n from (select case "
    + " ".join(f"when {cond} then '{name}'" for name, cond in _CHECKS)
    + " end as skip_reason from documents) group by skip_reason",
)
def gt_skip_reasons(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("skip_reason", provenance.first_failing_check(_CHECKS))
    return provenance.count_reasons(docs)


@query("concat_runs", "select 'a' as run, doc_id, n_chars, null as quality from documents union all by name select 'b' as run, doc_id, quality from labels")
def concat_runs(spark, sf_dir):
    """Two runs with different columns, written as CSV and united by name when they are read."""
    root = os.path.join(checkpoint_dir(spark), f"runs-{uuid.uuid4().hex}")
    stages.save_run(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), root, "run=a")
    stages.save_run(table(spark, sf_dir, "labels").select("doc_id", "quality"), root, "run=b")
    return stages.load_runs(spark, root, "run string, doc_id long, n_chars long, quality int")


