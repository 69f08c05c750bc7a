"""One table of a lake: read a file or catalog table with the row ids of its storage order."""

from __future__ import annotations

import posixpath
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.positions import dense_positions
from tessera.session import local_frame

ROW_ID = "row_id"


def table_name_of(path: str) -> str:
    """File name without its last extension."""
    base = posixpath.basename(path.rstrip("/"))
    return base.rsplit(".", 1)[0] if "." in base else base


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A parquet or CSV table with ``row_id`` = position in file order (files by path)."""
    if path.endswith(".parquet"):
        return _parquet_with_row_ids(spark, path)
    if path.endswith(".csv"):
        return _csv_with_row_ids(spark, path, schema)
    raise TypeError(f"not a parquet or CSV table: {path}")


def _parquet_with_row_ids(spark: SparkSession, path: str) -> DataFrame:
    return rows_of_files(spark.read.parquet(path))


def rows_of_files(df: DataFrame) -> DataFrame:
    """A frame straight from parquet files with its row ids. Row positions come from the parquet reader itself, so no
    shuffle and no sort.

    With several files, each file's start is the row count of the files before it; the counts are
    read from the footers, one row per file that the driver has listed anyway.
    """
    spark = df.sparkSession
    if len(df.inputFiles()) <= 1:
        return df.select(F.col("_metadata.row_index").alias(ROW_ID), *df.columns)
    counts = df.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n"))
    starts = _starts([(r["file"], r["n"]) for r in counts.collect()])
    start_df = local_frame(spark, starts, "_file string, _start long")
    tagged = df.select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_index"), *df.columns
    )
    placed = tagged.join(start_df, "_file")
    return placed.select((F.col("_start") + F.col("_index")).alias(ROW_ID), *df.columns)


def _csv_with_row_ids(spark: SparkSession, path: str, schema: str | None) -> DataFrame:
    """Text files carry no row index: number the rows of each input split, then shift by the splits before it."""
    reader = spark.read.option("header", True).option("escape", '"')
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    tagged = df.select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_mid"),
        *df.columns,
    )
    splits = tagged.groupBy("_file", "_block").agg(F.min("_mid").alias("low"), F.count("*").alias("n"))
    rows = splits.collect()  # one row per input split
    starts = dict(_starts([((r["_file"], r["_block"]), r["n"]) for r in rows]))
    shifts = [(r["_file"], r["_block"], starts[(r["_file"], r["_block"])] - r["low"]) for r in rows]
    shift_df = local_frame(spark, shifts, "_file string, _block long, _shift long")
    placed = tagged.join(shift_df, ["_file", "_block"])
    return placed.select((F.col("_mid") + F.col("_shift")).alias(ROW_ID), *df.columns)


def _starts(counts: Sequence[tuple]) -> list[tuple]:
    total, out = 0, []
    for key, n in sorted(counts):
        out.append((key, total))
        total += n
    return out


def number_rows(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """Row ids by key order, for sources without a storage order (catalog, JDBC)."""
    return dense_positions(df, order_by, out=ROW_ID).select(ROW_ID, *df.columns)


def read_jdbc_table(spark: SparkSession, url: str, table: str, order_by: Sequence[str], **options: str) -> DataFrame:
    """A database table through JDBC; the driver jar must be on the class path."""
    return number_rows(spark.read.format("jdbc").options(url=url, dbtable=table, **options).load(), order_by)
