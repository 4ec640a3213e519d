"""Anomalous hours against a rolling baseline, and their windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulse.functions.calendar import HOUR, hours_between
from pulse.functions.stats import guarded_z
from pulse.session import DEFAULTS


def rolling_z(hours: DataFrame, baseline_hours: int = DEFAULTS.baseline_hours, min_baseline: int = 0) -> DataFrame:
    """Adds baseline_mean, baseline_std (population) and z against the hours before, the own hour left out.

    z is 0 without baseline or spread; with min_baseline also where the
    baseline has fewer rows.
    """
    w = Window.partitionBy("channel").orderBy("hour").rangeBetween(-baseline_hours * HOUR, -1)
    out = hours.withColumn("baseline_mean", F.avg("post_count").over(w)).withColumn("baseline_std", F.stddev_pop("post_count").over(w))
    z = guarded_z(F.col("post_count"), F.col("baseline_mean"), F.col("baseline_std"))
    if min_baseline:
        z = F.when(F.count(F.lit(1)).over(w) >= min_baseline, z).otherwise(F.lit(0.0))
    return out.withColumn("z", z)


def anomalous(scored: DataFrame, threshold: float = DEFAULTS.z_threshold) -> DataFrame:
    return scored.where(F.col("z") > threshold)


def sessions(anomalies: DataFrame, gap_hours: int = DEFAULTS.merge_gap_hours) -> DataFrame:
    """Adds window_id, channel_n from 1: a gap of over gap_hours begins a new window, one of just gap_hours doesn't."""
    order = Window.partitionBy("channel").orderBy("hour")
    before = F.lag("hour").over(order)
    new = F.when(before.isNull() | (F.col("hour") - before > gap_hours * HOUR), 1).otherwise(0)
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return anomalies.withColumn("__new", new).withColumn("window_id", F.concat_ws("_", "channel", F.sum("__new").over(running).cast("string"))).drop("__new")


def windows(marked: DataFrame) -> DataFrame:
    return marked.groupBy("window_id", "channel").agg(
        F.min("hour").alias("window_start"),
        F.max("hour").alias("window_end"),
        F.max("z").alias("peak_z"),
        F.avg("z").alias("mean_z"),
        F.count(F.lit(1)).alias("anomaly_hours"),
        F.max("post_count").alias("peak_post_count"),
        F.avg("post_count").alias("mean_post_count"),
    ).withColumn("duration_hours", hours_between(F.col("window_start"), F.col("window_end")))


def detect(hours: DataFrame, threshold: float = DEFAULTS.z_threshold, gap_hours: int = DEFAULTS.merge_gap_hours, baseline_hours: int = DEFAULTS.baseline_hours) -> DataFrame:
    """Hourly rows to anomaly windows: one shuffle by channel serves baseline, gaps and windows."""
    return windows(sessions(anomalous(rolling_z(hours, baseline_hours), threshold), gap_hours))
