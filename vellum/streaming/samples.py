"""Step metrics over a stream of samples: an extension, as a batch roll-up has no late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_metrics(samples: DataFrame, step: str = "event_type", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(step, start, end, samples, mean, peak) of tumbling windows over (ts, step, value); rows later than ``late`` are left out by the watermark."""
    timed = samples.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    agg = timed.groupBy(F.window("ts", window), step).agg(F.count("*").alias("samples"), F.avg("value").alias("mean"), F.max("value").alias("peak"))
    return agg.select(step, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "samples", "mean", "peak")
