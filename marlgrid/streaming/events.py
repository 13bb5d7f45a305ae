"""Live quality of an event stream: the windowed counts of the batch operator, with a watermark.  An extra of this engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def live_quality(events: DataFrame, keys: list[str], ok: Column, metric: Column, window: str = "1 hour", late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """By window and key: n, n_ok and the metric's mean.  Events later than `late` are dropped; a window is final once the watermark passes it."""
    timed = events.withColumn("_at", F.col(ts).cast("timestamp")).withWatermark("_at", late)
    counted = timed.groupBy(F.window("_at", window).alias("w"), *keys).agg(F.count("*").alias("n"), F.count_if(ok).alias("n_ok"), F.avg(metric).alias("mean_metric"))
    return counted.select(F.col("w.start").alias("window_start"), *keys, "n", "n_ok", "mean_metric")
