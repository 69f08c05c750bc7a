"""Resolve table and column names of queries against a lake, ignoring case."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERY = ["lake", "gt_name"]


def resolve_tables(references: DataFrame, tables: DataFrame) -> DataFrame:
    """Match ``references (lake, gt_name, ref)`` with ``tables (lake, table_name)``.

    One row per distinct reference: number of matches and, if there is exactly one, the table.
    """
    wanted = references.select(*QUERY, "ref").distinct().withColumn("_key", F.lower("ref"))
    # matches are counted per name on the lake's side, before they meet the references
    names = tables.groupBy("lake", F.lower("table_name").alias("_key")).agg(
        F.count(F.lit(1)).alias("n_matches"), F.min("table_name").alias("_name")
    )
    joined = wanted.join(names, ["lake", "_key"], "left")
    n = F.coalesce(F.col("n_matches"), F.lit(0))
    return joined.select(*QUERY, "ref", n.alias("n_matches"), F.when(n == 1, F.col("_name")).alias("table_name"))


def resolve_columns(references: DataFrame, resolved_tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Match column references of queries.

    ``references (lake, gt_name, ref)``: ``table.column`` is searched in that table only, a plain
    name in all tables of its query. ``resolved_tables`` is the result of :func:`resolve_tables`,
    ``columns (lake, table_name, col_name)`` the lake's columns. One row per reference with its
    match count, status (``ok``, ``bad-name``, ``no-table``, ``no-match``, ``ambiguous``) and target.
    """
    parts = F.split("ref", r"\.")
    wanted = (
        references.select(*QUERY, "ref")
        .distinct()
        .withColumn("_n", F.size(parts))
        .withColumn("_table_ref", F.when(F.size(parts) == 2, parts[0]))
        .withColumn("_key", F.lower(F.when(F.size(parts) == 2, parts[1]).when(F.size(parts) == 1, parts[0])))
    )
    usable = resolved_tables.filter("table_name IS NOT NULL").select(*QUERY, F.col("ref").alias("_table_ref"), "table_name")
    names = columns.groupBy("lake", "table_name", F.lower("col_name").alias("_key")).agg(
        F.count(F.lit(1)).alias("_same"), F.min("col_name").alias("_col")
    )

    qualified = (
        wanted.filter("_n = 2")
        .join(usable, [*QUERY, "_table_ref"], "left")
        .join(names, ["lake", "table_name", "_key"], "left")
        .select(
            *QUERY, "ref", "table_name", F.col("_col").alias("col_name"),
            F.coalesce("_same", F.lit(0)).alias("n_matches"),
            F.col("table_name").isNull().alias("_no_table"),
            F.lit(False).alias("_bad"),
        )
    )
    per_query = usable.select(*QUERY, "table_name").distinct().join(names, ["lake", "table_name"])
    in_query = per_query.groupBy(*QUERY, "_key").agg(
        F.sum("_same").alias("_same"), F.min(F.struct("table_name", "_col")).alias("_hit")
    )
    plain = (
        wanted.filter("_n <> 2")
        .join(in_query, [*QUERY, "_key"], "left")
        .select(
            *QUERY, "ref", F.col("_hit.table_name").alias("table_name"), F.col("_hit._col").alias("col_name"),
            F.coalesce("_same", F.lit(0)).alias("n_matches"),
            F.lit(False).alias("_no_table"),
            (F.col("_n") > 2).alias("_bad"),
        )
    )
    status = (
        F.when(F.col("_bad"), "bad-name")
        .when(F.col("_no_table"), "no-table")
        .when(F.col("n_matches") == 0, "no-match")
        .when(F.col("n_matches") > 1, "ambiguous")
        .otherwise("ok")
    )
    united = qualified.unionByName(plain).withColumn("status", status)
    ok = F.col("status") == "ok"
    return united.select(
        *QUERY, "ref", "n_matches", "status",
        F.when(ok, F.col("table_name")).alias("table_name"), F.when(ok, F.col("col_name")).alias("col_name"),
    )


def unresolved_queries(resolved: DataFrame) -> DataFrame:
    """Queries to reject: those with a reference that is not matched exactly once."""
    return resolved.filter("n_matches <> 1").select(*QUERY).distinct()
