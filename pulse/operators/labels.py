"""Known events and the three ways of matching windows to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulse.functions.calendar import DAY, day_of_week, hour_of_day, start_of


def event_channels(catalogue: DataFrame) -> DataFrame:
    return catalogue.select("event_id", "day_sec", "name", "category", F.explode(F.split("relevant_channels", r"\|")).alias("channel"))


def match_first(wins: DataFrame, catalogue: DataFrame, days: int = 1) -> DataFrame:
    """Windows of an event's channel that overlap its day +- days; a window keeps its first event in catalogue order."""
    e = event_channels(catalogue)
    met = wins.select("window_id", "channel", "window_start", "window_end").join(e, "channel").where((F.col("window_start") <= F.col("day_sec") + days * DAY) & (F.col("window_end") >= F.col("day_sec") - days * DAY))
    order = Window.partitionBy("window_id").orderBy("event_id")
    return met.withColumn("__n", F.row_number().over(order)).where("__n = 1").select("window_id", "event_id", "name", "category")


def match_band(wins: DataFrame, catalogue: DataFrame, days: int = 2) -> DataFrame:
    """Every window and event of a channel whose days differ by at most days."""
    e = event_channels(catalogue)
    gap = F.abs(start_of(F.col("window_start"), DAY) - F.col("day_sec")) / DAY
    return wins.select("window_id", "channel", "window_start").join(e, "channel").withColumn("day_gap", gap.cast("long")).where(F.col("day_gap") <= days).select("window_id", "event_id", "category", "day_gap")


def coverage(wins: DataFrame, catalogue: DataFrame) -> DataFrame:
    """For each event, whether and how windows of its channels overlap its time +- 24 hours."""
    e = event_channels(catalogue)
    met = e.join(wins.select("channel", "window_id", "window_start", "window_end", "peak_z"), "channel").where((F.col("window_start") <= F.col("day_sec") + DAY) & (F.col("window_end") >= F.col("day_sec") - DAY))
    per = met.groupBy("event_id").agg(F.count(F.lit(1)).alias("n_windows"), F.countDistinct("channel").alias("n_channels"), F.max("peak_z").alias("max_peak_z"))
    out = catalogue.select("event_id", "name", "category").join(per, "event_id", "left")
    return out.select("event_id", "name", "category", F.col("n_windows").isNotNull().alias("matched"), F.coalesce("n_windows", F.lit(0)).alias("n_windows"), F.coalesce("n_channels", F.lit(0)).alias("n_channels"), "max_peak_z")


def coverage_by_category(covered: DataFrame) -> DataFrame:
    return covered.groupBy("category").agg(F.sum(F.col("matched").cast("long")).alias("matched"), F.count(F.lit(1)).alias("total"))


def events_by_weekday(catalogue: DataFrame) -> DataFrame:
    return event_channels(catalogue).groupBy("category", day_of_week(F.col("day_sec")).alias("day_of_week")).agg(F.countDistinct("event_id").alias("n_events"))


def quiet_days(days: DataFrame, catalogue: DataFrame, margin: int = 3) -> DataFrame:
    """Days that no event is within margin days of."""
    near = catalogue.select(F.explode(F.sequence(F.col("day_sec") - margin * DAY, F.col("day_sec") + margin * DAY, F.lit(DAY).cast("long"))).alias("day"))
    return days.join(near, "day", "left_anti")


def labelled_matrix(wins: DataFrame, engaged: DataFrame, catalogue: DataFrame, days: int = 2, long_hours: float = 12.0) -> DataFrame:
    """Features of windows near a known event, one row per window and event; sustained: longer than long_hours."""
    day = day_of_week(F.col("window_start"))
    own = wins.select(
        "window_id", "channel", "peak_z", "mean_z", "duration_hours", "anomaly_hours", "peak_post_count", "mean_post_count", hour_of_day(F.col("window_start")).alias("hour_of_day"), day.alias("day_of_week"), (day >= 5).cast("long").alias("is_weekend"),
        (F.col("duration_hours") > long_hours).cast("long").alias("sustained"),
    )
    return own.join(engaged, "window_id").join(match_band(wins, catalogue, days).drop("day_gap"), "window_id")
