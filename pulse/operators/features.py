"""Features of windows and events for the models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulse.functions.calendar import DAY, HOUR, day_of_week, hour_of_day
from pulse.operators.intervals import slice_series
from pulse.operators.labels import event_channels
from pulse.session import DEFAULTS


def baselines(hours: DataFrame) -> DataFrame:
    return hours.groupBy("channel").agg(
        F.median("post_count").alias("median_count"), F.avg("post_count").alias("mean_count"), F.coalesce(F.stddev_samp("post_count"), F.lit(1.0)).alias("std_count"), F.median("unique_authors").alias("median_authors"), F.median("mean_score").alias("median_score")
    )


def sustain_label(wins: DataFrame, hours: DataFrame, min_streak: int = DEFAULTS.sustain_hours, factor: float = DEFAULTS.sustain_factor, monitor: int = DEFAULTS.monitor_hours) -> DataFrame:
    """window_id, longest_streak, sustain_label: consecutive rows within monitor hours of the start over factor x the channel's median; without rows or median decayed."""
    w = wins.select("window_id", "channel", "window_start", F.col("window_start").alias("e"))
    rows = slice_series(w, hours.select("channel", "hour", "post_count"), 0, monitor * HOUR, "window_start", "e").join(baselines(hours).select("channel", "median_count"), "channel")
    high = rows.withColumn("hi", (F.col("post_count") > factor * F.col("median_count")) & (F.col("median_count") > 0))
    by = Window.partitionBy("window_id").orderBy("hour")
    run = high.withColumn("island", F.row_number().over(by) - F.row_number().over(Window.partitionBy("window_id", "hi").orderBy("hour")))
    streaks = run.where("hi").groupBy("window_id", "island").agg(F.count(F.lit(1)).alias("n")).groupBy("window_id").agg(F.max("n").alias("longest_streak"))
    out = wins.select("window_id").join(streaks, "window_id", "left").withColumn("longest_streak", F.coalesce("longest_streak", F.lit(0)))
    return out.withColumn("sustain_label", F.when(F.col("longest_streak") >= min_streak, "sustained").otherwise("decayed"))


def concurrent_channels(wins: DataFrame, hours: DataFrame, early: int = DEFAULTS.early_hours) -> DataFrame:
    """How many other channels have a mean in the window's first hours over twice the median of those means; 0 if the median of the window's own channel is 0.

    Means are taken once for every hour at which windows start, joined by hour.
    """
    starts = wins.select("window_start").distinct().withColumn("hour", F.explode(F.sequence("window_start", F.col("window_start") + early * HOUR, F.lit(HOUR).cast("long"))))
    means = starts.join(hours.select("hour", F.col("channel").alias("other"), "post_count"), "hour").groupBy("window_start", "other").agg(F.avg("post_count").alias("m"))
    own = wins.select("window_id", "channel", "window_start").join(baselines(hours).where("median_count > 0").select("channel"), "channel", "left_semi")
    others = own.join(means, "window_start").where("channel <> other")
    mid = others.groupBy("window_id").agg(F.median("m").alias("mid"))
    got = others.join(mid, "window_id").groupBy("window_id").agg(F.sum(F.when(F.col("m") > 2 * F.col("mid"), 1).otherwise(0)).alias("concurrent_channels"))
    return wins.select("window_id").join(got, "window_id", "left").select("window_id", F.coalesce("concurrent_channels", F.lit(0)).alias("concurrent_channels"))


def early_features(wins: DataFrame, hours: DataFrame, early: int = DEFAULTS.early_hours, sentiment: DataFrame | None = None) -> DataFrame:
    """Eleven features of the first hours of each window."""
    w = wins.select("window_id", "channel", "window_start", F.col("window_start").alias("e"))
    rows = slice_series(w, hours.select("channel", "hour", "post_count", "unique_authors", "mean_score"), 0, early * HOUR, "window_start", "e")
    n = F.count(F.lit(1))
    pace = lambda c: F.when(n >= 2, (F.max_by(c, "hour") - F.min_by(c, "hour")) / (n - 1)).otherwise(0.0)
    agg = rows.groupBy("window_id", "channel", "window_start").agg(
        pace("post_count").alias("velocity"), (F.sum("unique_authors") / F.greatest(F.sum("post_count"), F.lit(1))).alias("author_diversity"), pace("mean_score").alias("score_acceleration"), F.max("post_count").alias("peak_count"), F.avg("mean_score").alias("mean_score")
    )
    out = agg.join(baselines(hours).select("channel", F.col("median_count").alias("baseline")), "channel").join(concurrent_channels(wins, hours, early), "window_id")
    if sentiment is not None:
        out = out.join(sentiment.select("window_id", F.abs("mean").alias("s")), "window_id", "left").withColumn("sentiment_intensity", F.coalesce("s", F.lit(0.0)))
    else:
        out = out.withColumn("sentiment_intensity", F.lit(0.0))
    return out.select(
        "window_id", "velocity", "author_diversity", "concurrent_channels", "sentiment_intensity", "score_acceleration", "peak_count", "mean_score", (F.col("peak_count") / F.greatest("baseline", F.lit(1))).alias("spike_ratio"), "baseline",
        hour_of_day(F.col("window_start")).alias("hour_of_day"), (day_of_week(F.col("window_start")) >= 5).cast("long").alias("is_weekend"),
    )


def precursor_series(events: DataFrame, hours: DataFrame, window: int = DEFAULTS.precursor_hours, lead: int = 0) -> DataFrame:
    """event_id, pos, i (0-based), and the hourly values of the event's channels in the window before it, channel after channel in the event's order."""
    e = events.select("event_id", F.posexplode(F.split("relevant_channels", r"\|")).alias("pos", "channel"), (F.col("day_sec") - lead * HOUR - window * HOUR).alias("s"), (F.col("day_sec") - lead * HOUR - 1).alias("e"))
    rows = slice_series(e, hours.select("channel", "hour", "post_count", "unique_authors", "mean_score"), 0, 0, "s", "e")
    by = Window.partitionBy("event_id").orderBy("pos", "hour")
    return rows.withColumn("i", (F.row_number().over(by) - 1).cast("long")).withColumn("last12", F.col("hour") >= F.col("e") + 1 - 12 * HOUR)


def gini_of(rows: DataFrame, key: str = "event_id", value: str = "unique_authors") -> DataFrame:
    from pulse.functions.stats import gini

    return gini(rows, key, value)


def acceleration(rows: DataFrame) -> DataFrame:
    """Mean second difference of each event's series, 0 under four values: ((x_n - x_n-1) - (x_2 - x_1)) / (n - 2)."""
    n = F.count(F.lit(1))
    at = lambda k: F.max(F.when(F.col("i") == k, F.col("post_count")))
    counted = rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("event_id")))
    return counted.groupBy("event_id").agg(F.when(n > 3, ((at(F.col("n") - 1) - at(F.col("n") - 2)) - (at(F.lit(1)) - at(F.lit(0)))) / (n - 2)).otherwise(0.0).alias("acceleration"))


def half_ratio(rows: DataFrame) -> DataFrame:
    """Mean of the second half over that of the first (1 at least), halves by number of rows; 1 for a single row."""
    counted = rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("event_id")))
    first = F.col("i") < F.floor(F.col("n") / 2)
    ratio = F.avg(F.when(~first, F.col("post_count"))) / F.greatest(F.avg(F.when(first, F.col("post_count"))), F.lit(1.0))
    return counted.groupBy("event_id").agg(F.when(F.count(F.lit(1)) > 1, ratio).otherwise(1.0).alias("volume_ratio"))


def precursor_features(events: DataFrame, hours: DataFrame, window: int = DEFAULTS.precursor_hours, lead: int = 0) -> DataFrame:
    """Fifteen features of the hours before each event; events without any hour are left out."""
    rows = precursor_series(events, hours, window, lead)
    n = F.count(F.lit(1))
    slope = lambda c: F.when(n > 2, F.coalesce(F.regr_slope(c, "i"), F.lit(0.0))).otherwise(0.0)
    agg = rows.groupBy("event_id").agg(
        slope("post_count").alias("trend"), slope("mean_score").alias("score_trend"), slope("unique_authors").alias("author_growth"), F.avg("post_count").alias("mean_activity"), F.stddev_pop("post_count").alias("std_activity"), F.max("post_count").alias("peak_activity"),
        F.avg("unique_authors").alias("mean_authors"), F.avg("mean_score").alias("mean_score"), n.alias("n_hours"),
    )
    spread = F.greatest("std_activity", F.lit(1.0))
    agg = agg.withColumn("z_mean", F.lit(0.0)).withColumn("z_max", F.when(F.col("std_activity") > 0, (F.col("peak_activity") - F.col("mean_activity")) / spread).otherwise(0.0))
    own = rows.groupBy("event_id", "channel").agg(F.avg(F.when(F.col("last12"), F.col("post_count"))).alias("late"))
    mean = hours.groupBy("channel").agg(F.avg("post_count").alias("mean_count"))
    k = event_channels(events).groupBy("event_id").agg(F.count(F.lit(1)).alias("k"))
    crossing = own.join(mean, "channel").groupBy("event_id").agg(F.sum(F.when(F.col("late") > 1.5 * F.col("mean_count"), 1).otherwise(0)).alias("c")).join(k, "event_id").select("event_id", (F.col("c") / F.greatest("k", F.lit(1))).alias("cross_posting_rate"))
    return agg.join(crossing, "event_id").join(gini_of(rows), "event_id").join(acceleration(rows), "event_id").join(half_ratio(rows), "event_id")


def _quiet_order():
    return ((F.col("hour") / HOUR * 7919 + F.length("channel") * 104729) % 10007).cast("long")


def negative_candidates(hours: DataFrame, events: DataFrame, per_event: int = 3, margin: int = 3) -> DataFrame:
    """(channel, hour) far from every event's day, per_event for each event, in the order of a fixed hash."""
    from pulse.operators.labels import quiet_days

    grid = hours.select("channel", "hour").distinct().withColumn("day", (F.floor(F.col("hour") / DAY) * DAY).cast("long"))
    free = quiet_days(grid, events, margin)
    ranked = free.withColumn("o", _quiet_order()).orderBy("o", "channel", "hour")
    return ranked.select("channel", "hour").limit(per_event * events.count())


def forecast_examples(hours: DataFrame, events: DataFrame, per_event: int = 3, margin: int = 3, tries: int = 10, channels: int = 50) -> DataFrame:
    """Precursor features of every event (label 1) and of per_event quiet hours for each event (label 0).

    The quiet hours come from the largest channels, in the order of a fixed
    hash; up to tries times as many are looked at, and those without any row
    before them are passed over. Negatives have event ids from the events'
    largest on. Nulls and values that aren't finite become 0.
    """
    n, top = (r := events.agg(F.count(F.lit(1)), F.max("event_id")).first())[0], r[1] or 0
    large = hours.groupBy("channel").agg(F.sum("post_count").alias("__n")).orderBy(F.desc("__n"), "channel").limit(channels)
    tried = negative_candidates(hours.join(F.broadcast(large), "channel", "left_semi"), events, per_event * tries, margin)
    order = Window.orderBy(_quiet_order(), "channel", "hour")  # of the few that were taken
    negatives = tried.select((F.row_number().over(order) + top).cast("long").alias("event_id"), F.col("hour").alias("day_sec"), F.lit("non_event").alias("name"), F.lit("non_event").alias("category"), F.col("channel").alias("relevant_channels"))
    every = events.select(*negatives.columns).unionByName(negatives)
    found = precursor_features(every, hours).join(every.select("event_id", "name", "category"), "event_id").withColumn("label", (F.col("event_id") <= top).cast("double"))
    kept = found.withColumn("__r", F.row_number().over(Window.partitionBy("label").orderBy("event_id"))).where((F.col("label") == 1) | (F.col("__r") <= per_event * n)).drop("__r")
    return kept.select(*[F.when(F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf")), 0.0).otherwise(F.col(c)).alias(c) if k == "double" and c != "label" else F.col(c) for c, k in kept.dtypes])


def window_matrix(wins: DataFrame, entity: DataFrame, sentiment: DataFrame, topics: DataFrame, volume: DataFrame, matches: DataFrame) -> DataFrame:
    """One row per window with the features of every step, nulls as 0, and the matched category."""
    out = wins.select("window_id", "channel", "peak_z", "mean_z", "anomaly_hours", "duration_hours", "peak_post_count", hour_of_day(F.col("window_start")).alias("hour_of_day"), day_of_week(F.col("window_start")).alias("day_of_week"), (day_of_week(F.col("window_start")) >= 5).cast("long").alias("is_weekend"))
    out = out.join(entity, "window_id", "left").join(sentiment.select("window_id", F.col("mean").alias("mean_sentiment"), F.col("std").alias("std_sentiment")), "window_id", "left")
    out = out.join(topics.select("window_id", "n_topics_present"), "window_id", "left").join(volume.select("channel", F.col("total_posts").alias("post_count")), "channel", "left")
    return out.fillna(0).join(matches.select("window_id", "event_id", "category"), "window_id", "left").withColumn("is_labeled", F.col("category").isNotNull())
