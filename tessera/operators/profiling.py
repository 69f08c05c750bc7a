"""Shape of lakes and ground truths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.rectangles import explode_range


def lake_profile(tables: DataFrame) -> DataFrame:
    """Per lake: tables, cells, and smallest, mean and largest table."""
    return tables.groupBy("lake").agg(
        F.count(F.lit(1)).alias("n_tables"),
        F.sum("num_cells").alias("lake_cells"),
        F.min("n_rows").alias("min_rows"), F.max("n_rows").alias("max_rows"), F.avg("n_rows").alias("avg_rows"),
        F.max("n_cols").alias("max_cols"), F.max("num_cells").alias("max_cells"),
    )


def result_profile(covered: DataFrame, tiles: DataFrame) -> DataFrame:
    """Per ground truth: tables touched and cells covered (``covered`` from ``covered_cells``)."""
    touched = tiles.groupBy("lake", "gt_name").agg(F.countDistinct("table_name").alias("n_tables"))
    return touched.join(covered, ["lake", "gt_name"])


def histogram(values: DataFrame, value: str, log: bool = False) -> DataFrame:
    """(bin_lo, bin_hi, n) of a non-negative integer column, empty bins included.

    Linear: unit bins from min to max, the last one closed on both sides. Log: [0,1), [1,10),
    [10,100), ... up to two powers past the largest. One distinct value: a single bin of +-0.1.
    """
    counted = values.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("long").alias("v")).agg(F.count(F.lit(1)).alias("_n"))
    ends = counted.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    # digits of the largest value give the power exactly; log10 of a double might not
    power = F.length(F.greatest("hi", F.lit(1)).cast("string")) - 1
    single = F.col("lo") == F.col("hi")
    if log:
        n_bins = F.when(single, 1).otherwise(power + 3)
        bin_of = F.when(F.col("v") == 0, 0).otherwise(F.length(F.col("v").cast("string")))
    else:
        n_bins = F.when(single, 1).otherwise(F.col("hi") - F.col("lo"))
        bin_of = F.least(F.col("v") - F.col("lo"), F.col("hi") - F.col("lo") - 1)
    bins = explode_range(ends, n_bins, "bin")
    # ``ends`` is one row by construction
    placed = counted.join(F.broadcast(ends), F.col("v").between(F.col("lo"), F.col("hi")))
    hits = placed.groupBy(F.when(single, 0).otherwise(bin_of).cast("long").alias("bin")).agg(F.sum("_n").alias("n"))
    i = F.col("bin")
    if log:
        low, high = F.when(i == 0, 0.0).otherwise(F.pow(F.lit(10.0), i - 1)), F.pow(F.lit(10.0), i)
    else:
        low, high = (F.col("lo") + i).cast("double"), (F.col("lo") + i + 1).cast("double")
    return bins.join(hits, "bin", "left").select(
        F.when(single, F.col("lo") - 0.1).otherwise(low).alias("bin_lo"),
        F.when(single, F.col("lo") + 0.1).otherwise(high).alias("bin_hi"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"),
    )
