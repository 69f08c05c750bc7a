"""Ground truths (question, query, answer) from JSON records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.positions import dense_positions

GT_PREFIX = "ground-truth-"


def load_ground_truths(
    spark: SparkSession, groups: dict[str, str], schema: str | None = None, multi_line: bool = False
) -> DataFrame:
    """Question files (partition name -> glob) as ground truths, numbered per partition in file order.

    ``multi_line`` reads files that hold one JSON array each; otherwise a line is a record. Without ``schema`` all
    fields of the records are found and kept in ``data``. A file that cannot be read as such fails the query.
    """
    parts = []
    for partition, path in groups.items():
        reader = spark.read.option("multiLine", multi_line).option("mode", "FAILFAST")
        records = (reader.schema(schema) if schema else reader).json(path)
        tagged = records.withColumn("_file", F.col("_metadata.file_path")).withColumn(
            "_arrival", F.monotonically_increasing_id()
        )
        parts.append(name_ground_truths(tagged, partition, ["_file", "_arrival"]))
    united = parts[0]
    for part in parts[1:]:
        united = united.unionByName(part)
    return united


def name_ground_truths(records: DataFrame, partition: str, order_by: list[str]) -> DataFrame:
    """(lake, gt_name, partition, information_need, sql_query, data) with names ``ground-truth-<position>``."""
    fields = [c for c in records.columns if not c.startswith("_") and c not in order_by]
    numbered = dense_positions(records, order_by, out="_ix")
    return numbered.select(
        F.col("db_id").alias("lake"),
        F.concat(F.lit(GT_PREFIX), F.col("_ix").cast("string")).alias("gt_name"),
        F.lit(partition).alias("partition"),
        F.col("question").alias("information_need"),
        F.col("query").alias("sql_query"),
        F.to_json(F.struct(*fields)).alias("data"),
    )


TABLE_QUESTION = "original_table_id string, question string, sql string, answer array<string>"


def load_table_questions(
    spark: SparkSession, groups: dict[str, str], tables: DataFrame, schema: str = TABLE_QUESTION, multi_line: bool = False
) -> DataFrame:
    """Question files of the layout that names one table per question, as ground truths with ``lake``, ``table_name`` and
    ``answer_list``, numbered per partition in file order.

    ``tables (original_table_id, lake, table_name)`` are the tables of the lakes. Questions about other tables are left
    out after they were numbered.
    """
    parts = []
    for partition, path in groups.items():
        reader = spark.read.option("multiLine", multi_line).option("mode", "FAILFAST").schema(schema)
        records = reader.json(path).withColumn("_file", F.col("_metadata.file_path")).withColumn("_arrival", F.monotonically_increasing_id())
        fields = [c for c in records.columns if not c.startswith("_")]
        numbered = dense_positions(records, ["_file", "_arrival"], out="_ix")
        parts.append(numbered.select(
            "original_table_id", F.concat(F.lit(GT_PREFIX), F.col("_ix").cast("string")).alias("gt_name"), F.lit(partition).alias("partition"),
            F.col("question").alias("information_need"), F.col("sql").alias("sql_query"), F.col("answer").alias("answer_list"),
            F.to_json(F.struct(*fields)).alias("data")))
    united = parts[0]
    for part in parts[1:]:
        united = united.unionByName(part)
    return united.join(tables.select("original_table_id", "lake", "table_name"), "original_table_id")


def tile_kind(gt_name):
    """The kind of the tiles of a ground truth: the prefix again, in front of a name that has it already."""
    return F.concat(F.lit(GT_PREFIX), gt_name)


def gt_name_of_kind(kind):
    return F.substring(kind, len(GT_PREFIX) + 1, 1_000_000)


def contains_where(sql_query):
    return F.lower(sql_query).contains("where")


def keep_ground_truths_of(ground_truths: DataFrame, tables: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(ground truths whose table is there, ground truths whose table was filtered out)."""
    keys = tables.select(key).distinct()
    return ground_truths.join(keys, key, "left_semi"), ground_truths.join(keys, key, "left_anti")
