"""Clusters of windows that lie near each other in time, and how they spread."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulse.functions.calendar import HOUR, day_of_week, hours_between
from pulse.operators.graph import connected_components
from pulse.operators.intervals import near_links
from pulse.session import DEFAULTS


def clusters(wins: DataFrame, radius_hours: int = DEFAULTS.cooccurrence_hours, include_singletons: bool = False) -> DataFrame:
    """window_id, cluster_id (the smallest window id of the component). Windows of one channel mustn't overlap."""
    found = connected_components(near_links(wins, radius_hours * HOUR), "a", "b").select(F.col("node").alias("window_id"), F.col("component").alias("cluster_id"))
    if include_singletons:
        return wins.select("window_id").join(found, "window_id", "left").select("window_id", F.coalesce("cluster_id", "window_id").alias("cluster_id"))
    return found


def size_percentiles(volume: DataFrame) -> DataFrame:
    """Median and third quartile of channel sizes, 0 without channels."""
    return volume.agg(F.coalesce(F.percentile_approx("total_posts", 0.5), F.lit(0)).alias("p50"), F.coalesce(F.percentile_approx("total_posts", 0.75), F.lit(0)).alias("p75"))


def members(wins: DataFrame, cluster_map: DataFrame, volume: DataFrame) -> DataFrame:
    """Windows with cluster and channel size; sizes are one row per channel, so nothing is doubled."""
    return wins.join(cluster_map, "window_id").join(volume, "channel", "left").withColumn("total_posts", F.coalesce("total_posts", F.lit(0)))


def profile(rows: DataFrame, volume: DataFrame, within_hours: int = DEFAULTS.simultaneous_hours) -> DataFrame:
    """One row per cluster: its channels in order, first mover, share that starts within within_hours, and the type of spread."""
    first = rows.groupBy("cluster_id").agg(F.min("window_start").alias("first_detection"))
    own = rows.join(first, "cluster_id")
    order = F.struct("window_start", "channel", "window_id")
    agg = own.groupBy("cluster_id", "first_detection").agg(
        F.count(F.lit(1)).alias("num_windows"),
        F.countDistinct("channel").alias("num_channels"),
        F.max("window_end").alias("last_end"),
        F.avg(F.when(F.col("window_start") - F.col("first_detection") <= within_hours * HOUR, 1.0).otherwise(0.0)).alias("share_within"),
        F.min_by("total_posts", order).alias("first_mover_size"),
        F.array_sort(F.collect_list(F.struct("window_start", "channel", "window_id"))).alias("m"),
    )
    p = size_percentiles(volume)
    agg = agg.crossJoin(F.broadcast(p))  # one row
    size = F.col("first_mover_size")
    kind = F.when(F.col("share_within") > 0.5, "simultaneous").when(size < F.col("p50"), "niche_to_mainstream").when(size >= F.col("p75"), "top_down").otherwise("niche_to_mainstream")
    return agg.select(
        "cluster_id",
        F.array_join(F.transform("m", lambda x: x["channel"]), "|").alias("channel_sequence"),
        kind.alias("propagation_type"),
        "num_windows",
        "num_channels",
        hours_between(F.col("first_detection"), F.col("last_end")).alias("total_duration_hours"),
        "first_detection",
        "share_within",
        "first_mover_size",
    )


def offsets(rows: DataFrame) -> DataFrame:
    """Hours of each window after its cluster's first."""
    w = Window.partitionBy("cluster_id")
    return rows.select("cluster_id", "window_id", "channel", "total_posts", hours_between(F.min("window_start").over(w), F.col("window_start")).alias("offset_hours"))


def order_of(rows: DataFrame) -> DataFrame:
    """Each window's place in its cluster by its start."""
    by = Window.partitionBy("cluster_id").orderBy("window_start", "channel", "window_id")
    return rows.select("cluster_id", "window_id", F.row_number().over(by).cast("long").alias("place"))


def by_weekend(profiles: DataFrame) -> DataFrame:
    """How long and wide clusters are by whether they begin on a weekend."""
    weekend = (day_of_week(F.col("first_detection")) >= 5).cast("long").alias("is_weekend")
    return profiles.groupBy(weekend).agg(F.count(F.lit(1)).alias("n"), F.avg("total_duration_hours").alias("avg_propagation_hours"), F.avg("num_channels").alias("avg_num_channels"))
