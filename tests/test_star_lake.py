"""Queries over the star lake read every table of it."""

from pyspark.sql import functions as F


def test_divisive_confusion_is_of_all_tables(spark, tmp_path):
    from tessera.plans import QUERIES
    from tessera.plans.corpus import BLOCKS, STAR_COLUMNS

    texts = {"r_name", "n_name", "c_name", "c_mktsegment", "s_name", "p_name", "p_brand", "p_type", "o_orderstatus", "o_orderpriority",
             "l_returnflag", "l_linestatus", "event_type", "props", "o_orderdate", "l_shipdate", "ts"}
    values = {"c_mktsegment": "BUILDING", "l_returnflag": "R", "event_type": "error", "r_name": "ASIA"}
    n_rows, total = {"lineitem": 12, "events": 7, "orders": 9}, 0
    for name, columns in STAR_COLUMNS.items():
        n = n_rows.get(name, 4)
        total += n * len(columns)
        made = [F.lit(values[c]).alias(c) if c in values else F.concat(F.lit("x"), F.col("id")).alias(c) if c in texts
                else (F.col("id") * 13 + k).cast("double" if "price" in c or "acctbal" in c or c in ("value", "l_discount", "l_tax") else "long").alias(c)
                for k, c in enumerate(columns)]
        spark.range(0, n, 1, 1).select(*made).write.parquet(str(tmp_path / f"{name}.parquet"))
    rows = QUERIES["slice_divisive_confusion"](spark, str(tmp_path)).collect()
    assert {r["gt_name"] for r in rows} == {b.gt_name for b in BLOCKS}
    assert {r["total"] for r in rows} == {total}
    hits = {r["gt_name"]: r["TP"] for r in rows}
    assert hits["errors"] == 14 and hits["returned"] == 3 * sum(13 * i + 4 > 40 for i in range(12))


def test_rows_of_an_order_are_moved_once(spark, tmp_path):
    """Means of rows that are together equal those of rows moved by table; their texts are not shuffled."""
    from tessera.operators import divisive
    from tessera.plans.corpus import DIM, EMBEDDER, ORDER_COLUMNS, order_rows
    from tessera.operators.embedding import embed_rows

    lines = spark.range(0, 90, 1, 4).select(*[
        (F.col("id") % 17 if c == "l_orderkey" else F.concat(F.lit(c), F.col("id")) if k > 7 else F.col("id") * k).alias(c) for k, c in enumerate(ORDER_COLUMNS)])
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    heads = spark.createDataFrame([(i % 12, "HIGH" if i < 12 else "LOW") for i in range(15)], "o_orderkey long, o_orderpriority string")
    heads.write.parquet(str(tmp_path / "orders.parquet"))
    embed = lambda rows: embed_rows(rows, EMBEDDER, ORDER_COLUMNS)
    found = {}
    for together in (False, True):
        rows = order_rows(spark, str(tmp_path), together=together)
        means = divisive.table_means(rows, embed, DIM, together=together)
        found[together] = sorted(map(str, means.collect()))
        assert ("REPARTITION_BY_COL" in means._jdf.queryExecution().toString()) is not together
    assert found[True] == found[False] and len({r.split("axis")[0] for r in found[True]}) == 15
    parts = order_rows(spark, str(tmp_path), together=True).select("table_name", F.spark_partition_id().alias("p")).distinct()
    assert parts.count() == 12
