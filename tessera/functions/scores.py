"""Confusion and accuracy scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def precision(tp: Column, fp: Column) -> Column:
    """TP / (TP + FP), 1 if nothing was returned."""
    return F.coalesce(F.try_divide(tp.cast("double"), tp + fp), F.lit(1.0))


def recall(tp: Column, fn: Column) -> Column:
    """TP / (TP + FN), 0 if nothing was relevant."""
    return F.coalesce(F.try_divide(tp.cast("double"), tp + fn), F.lit(0.0))


def f1(p: Column, r: Column) -> Column:
    """Harmonic mean, 0 if both are 0."""
    return F.coalesce(F.try_divide(F.lit(2.0) * p * r, p + r), F.lit(0.0))


def add_confusion_scores(df: DataFrame) -> DataFrame:
    """Add precision, recall, f1_score and total to a frame with TP, FP, TN, FN."""
    tp, fp, tn, fn = (F.col(c) for c in ("TP", "FP", "TN", "FN"))
    scored = df.withColumn("precision", precision(tp, fp)).withColumn("recall", recall(tp, fn))
    return scored.withColumn("f1_score", f1(F.col("precision"), F.col("recall"))).withColumn("total", tp + fp + tn + fn)


def accuracy_aggregates(is_correct: Column) -> list[Column]:
    """Aggregates correct, incorrect, total and accuracy of a boolean column."""
    hit = F.count_if(F.coalesce(is_correct, F.lit(False)))
    total = F.count(F.lit(1))
    return [
        hit.alias("correct"),
        (total - hit).alias("incorrect"),
        total.alias("total"),
        F.try_divide(hit.cast("double"), total).alias("accuracy"),
    ]
