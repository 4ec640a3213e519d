"""Hourly and daily roll-ups of posts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulse.functions.calendar import DAY, HOUR, start_of

GRAINS = ("mixed", "per_type", "summed")


def hourly(activity: DataFrame, grain: str = "summed") -> DataFrame:
    """channel, hour, post_count, unique_authors, mean_score (and data_type unless summed).

    Posts without channel are left out, posts without score aren't counted,
    authors that are null don't count. ``mixed`` keeps a row for each data type
    under one channel; ``per_type`` makes channel and type one channel.
    """
    if grain not in GRAINS:
        raise ValueError(f"grain is one of {GRAINS}")
    rows = activity.where(F.col("channel").isNotNull()).withColumn("hour", start_of(F.col("sec"), HOUR))
    if grain == "per_type":
        rows = rows.withColumn("channel", F.concat_ws(":", "channel", "data_type"))
    keys = ["channel", "hour"] + ["data_type"] * (grain != "summed")
    return rows.groupBy(*keys).agg(F.count("score").alias("post_count"), F.countDistinct("author").alias("unique_authors"), F.avg("score").alias("mean_score"))


def daily(hours: DataFrame) -> DataFrame:
    """Daily sums of hourly rows: authors are summed over hours, and the mean is that of the hours' means."""
    keys = ["channel", "day"] + ["data_type"] * ("data_type" in hours.columns)
    return hours.withColumn("day", start_of(F.col("hour"), DAY)).groupBy(*keys).agg(F.sum("post_count").alias("post_count"), F.sum("unique_authors").alias("unique_authors"), F.avg("mean_score").alias("mean_score"))


def daily_exact(activity: DataFrame) -> DataFrame:
    """Daily rows from posts: authors counted once a day, means over posts."""
    rows = activity.where(F.col("channel").isNotNull()).withColumn("day", start_of(F.col("sec"), DAY))
    return rows.groupBy("channel", "day").agg(F.count("score").alias("post_count"), F.countDistinct("author").alias("unique_authors"), F.avg("score").alias("mean_score"))


def channel_stats(hours: DataFrame) -> DataFrame:
    keys = ["channel"] + ["data_type"] * ("data_type" in hours.columns)
    return hours.groupBy(*keys).agg(
        F.sum("post_count").alias("total_posts"),
        F.count("post_count").alias("total_hours_active"),
        F.avg("post_count").alias("mean_hourly_posts"),
        F.max("post_count").alias("max_hourly_posts"),
        F.stddev_samp("post_count").alias("std_hourly_posts"),
        F.avg("unique_authors").alias("mean_unique_authors"),
        F.avg("mean_score").alias("overall_mean_score"),
    )


def channel_volume(hours: DataFrame) -> DataFrame:
    return hours.groupBy("channel").agg(F.sum("post_count").alias("total_posts"))


def top_channels(hours: DataFrame, n: int) -> DataFrame:
    """The n channels of most posts, ties by name."""
    return channel_volume(hours).orderBy(F.desc("total_posts"), "channel").limit(n)


def keep_channels(rows: DataFrame, channels: DataFrame) -> DataFrame:
    return rows.join(channels.select("channel"), "channel", "left_semi")
