"""The roll-up and the windows over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly_stream(posts: DataFrame, late: str = "2 hours", at: str = "ts") -> DataFrame:
    """Hourly rows of a stream of posts (channel, ts, author, score); authors are estimated, as streams can't count them exactly."""
    w = F.window(at, "1 hour")
    kept = posts.where(F.col("channel").isNotNull()).withWatermark(at, late)
    return kept.groupBy("channel", w.alias("w")).agg(F.count("score").alias("post_count"), F.approx_count_distinct("author").alias("unique_authors"), F.avg("score").alias("mean_score")).select("channel", F.col("w.start").alias("hour"), "post_count", "unique_authors", "mean_score")


def session_stream(anomalies: DataFrame, gap_hours: int = 6, late: str = "12 hours", at: str = "hour") -> DataFrame:
    """Anomaly windows of a stream of anomalous hours."""
    s = F.session_window(at, f"{gap_hours} hours")
    return anomalies.withWatermark(at, late).groupBy("channel", s.alias("s")).agg(F.min(at).alias("window_start"), F.max(at).alias("window_end"), F.count(F.lit(1)).alias("anomaly_hours"), F.max("z").alias("peak_z")).drop("s")


def score_batches(baseline: DataFrame, sink) -> object:
    """A function for foreachBatch: hourly rows against a stored baseline (channel, mean, std), written by sink(frame, batch id)."""

    def each(batch: DataFrame, batch_id: int) -> None:
        z = F.when(F.col("std") > 0, (F.col("post_count") - F.col("mean")) / F.col("std")).otherwise(F.lit(0.0))
        sink(batch.join(baseline, "channel", "left").withColumn("z", F.coalesce(z, F.lit(0.0))).drop("mean", "std"), batch_id)

    return each
