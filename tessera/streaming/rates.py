"""Request rate per model over sliding windows of a request log, as a stream or as a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.requests import with_model

WINDOW = "70 seconds"
SLIDE = "10 seconds"
SHARE = 0.3


def windowed_rate(log: DataFrame, window: str = WINDOW, slide: str = SLIDE, lateness: str | None = None) -> DataFrame:
    """(model, window_start, n_requests, n_tokens) of ``log (model, ts, tokens)``.

    Sums are combined before the shuffle, so a busy model costs one row per window and task. With
    ``lateness`` (needed for streams in append mode) state is dropped behind the watermark.
    """
    timed = log.withColumn("ts", F.col("ts").cast("timestamp"))
    if lateness is not None:
        timed = timed.withWatermark("ts", lateness)
    rates = timed.groupBy(F.window("ts", window, slide).alias("_w"), "model").agg(
        F.count(F.lit(1)).alias("n_requests"), F.sum("tokens").alias("n_tokens")
    )
    return rates.select("model", F.col("_w.start").alias("window_start"), "n_requests", "n_tokens")


def flag_limits(rates: DataFrame, share: float = SHARE) -> DataFrame:
    """Mark windows above the given share of the model's limits; an unknown model fails the query."""
    return with_model(rates).select(
        *rates.columns,
        (F.col("n_requests") > F.col("max_rpm") * share).alias("over_rpm"),
        (F.col("n_tokens") > F.col("max_tpm") * share).alias("over_tpm"),
    )


def start_rate_stream(log: DataFrame, path: str, checkpoint: str, lateness: str = "70 seconds") -> StreamingQuery:
    """Append closed windows of a streaming request log to a parquet folder, then stop at the end of the input."""
    return (
        windowed_rate(log, lateness=lateness)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
