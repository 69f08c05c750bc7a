"""Scores of slicing, retrieval and answers, and their summaries over configurations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.scores import accuracy_aggregates, add_confusion_scores
from tessera.operators.rectangles import paired_covers

QUESTION = ["lake", "gt_name"]
#: Configuration columns of a result row.
QA_CONFIG = ["embedder", "slicer", "index", "merger", "TpT", "tok"]


def retrieval_confusion(result: DataFrame, truth: DataFrame, lake_cells: DataFrame) -> DataFrame:
    """Cell-level TP, FP, FN, TN and scores per question.

    ``result`` and ``truth`` are span frames with ``gt_name``; ``lake_cells (lake, lake_cells)``.
    """
    covers = paired_covers(result, truth, QUESTION)
    none = F.lit(0).cast("long")
    got, wanted = F.coalesce("mask", none), F.coalesce("other", none)
    both = F.bit_count(got.bitwiseAND(wanted))
    sums = covers.select(*QUESTION, both.alias("both"), F.bit_count(got).alias("got"), F.bit_count(wanted).alias("wanted")).groupBy(*QUESTION).agg(
        F.sum("both").cast("long").alias("TP"), F.sum("got").cast("long").alias("_got"), F.sum("wanted").cast("long").alias("_wanted"))
    counts = sums.join(lake_cells, "lake").select(
        *QUESTION, "TP", (F.col("_got") - F.col("TP")).alias("FP"),
        (F.col("lake_cells") - F.col("_got") - F.col("_wanted") + F.col("TP")).alias("TN"), (F.col("_wanted") - F.col("TP")).alias("FN"))
    return add_confusion_scores(counts)


def sum_confusion(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Merged confusion per key, scored."""
    return add_confusion_scores(df.groupBy(*keys).agg(*[F.sum(c).cast("long").alias(c) for c in ("TP", "FP", "TN", "FN")]))


def score_answers(instances: DataFrame, responses: DataFrame, key: str = "request_hash") -> DataFrame:
    """Join responses by request and compare answer and prediction as text."""
    joined = instances.join(responses.select(key, "prediction"), key, "left")
    return joined.withColumn("is_correct", F.coalesce(F.col("answer") == F.col("prediction"), F.lit(False)))


def answer_accuracy(scored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return scored.groupBy(*keys).agg(*accuracy_aggregates(F.col("is_correct")))


def mean_by_config(results: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    return results.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in metrics])


def pivot_metric(results: DataFrame, rows: str, columns: str, values: Sequence, metric: str, prefix: str = "") -> DataFrame:
    """Mean of ``metric`` with one column per value; the value list is given, so one pass is enough."""
    cells = [F.avg(F.when(F.col(columns) == v, F.col(metric))).alias(f"{prefix}{v}") for v in values]
    return results.groupBy(rows).agg(*cells)


def prediction_rollup(results: DataFrame, keys: Sequence[str], run: str, texts: Sequence[str], numbers: Sequence[str]) -> DataFrame:
    """Per key: texts of all runs strung together in run order, numbers added up (one row per run)."""
    joined = [
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(run, F.coalesce(t, F.lit("")).alias("_t")))), lambda x: x["_t"]), "").alias(t)
        for t in texts
    ]
    return results.groupBy(*keys).agg(*joined, *[F.sum(n).alias(n) for n in numbers])
