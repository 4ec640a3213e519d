"""Roll-up, anomaly and calendar queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulse.functions.calendar import month_of
from pulse.functions.stats import bernoulli
from pulse.operators import anomaly, rollup, temporal
from pulse.plans.common import ACT5, ACT12, DETECT5, DETECT12, HOURLY, HOURLY_MIXED, HOURLY_TYPED, MARKED, SCORED, VOLUME, WINDOWS, Catalogue, hours5, hours12, sql, windows5, windows12
from pulse.sources import activity

C = Catalogue()
_H12, _M12 = f"{ACT12}, {HOURLY}", f"{ACT12}, {HOURLY_MIXED}"
_DAILY = "sum(post_count)::bigint AS post_count, sum(unique_authors)::bigint AS unique_authors, round(avg(mean_score), 6) AS mean_score"
_WIN = "SELECT window_id, channel, window_start, window_end, round(peak_z, 6) AS peak_z, round(mean_z, 6) AS mean_z, anomaly_hours, peak_post_count, round(mean_post_count, 6) AS mean_post_count, round(duration_hours, 6) AS duration_hours FROM wins"


@C.add(sql(_M12, "SELECT channel, hour, data_type, post_count, unique_authors, round(mean_score, 6) AS mean_score FROM hourly"))
def hourly_counts(spark, sf_dir):
    return hours12(spark, sf_dir, "mixed")


@C.add(sql(_M12, f"SELECT channel, hour - hour % 86400 AS day, data_type, {_DAILY} FROM hourly GROUP BY ALL"))
def daily_counts(spark, sf_dir):
    return rollup.daily(hours12(spark, sf_dir, "mixed"))


@C.add(sql(ACT12, "SELECT channel, sec - sec % 86400 AS day, count(score)::bigint AS post_count, count(DISTINCT author)::bigint AS unique_authors, round(avg(score), 6) AS mean_score FROM act GROUP BY ALL"))
def daily_counts_exact(spark, sf_dir):
    return rollup.daily_exact(activity.by_user(spark, sf_dir))


@C.add(sql(_M12, "SELECT channel, data_type, sum(post_count)::bigint AS total_posts, count(*)::bigint AS total_hours_active, round(avg(post_count), 6) AS mean_hourly_posts, max(post_count) AS max_hourly_posts, round(stddev_samp(post_count), 6) AS std_hourly_posts, round(avg(unique_authors), 6) AS mean_unique_authors, round(avg(mean_score), 6) AS overall_mean_score FROM hourly GROUP BY ALL"))
def channel_stats(spark, sf_dir):
    return rollup.channel_stats(hours12(spark, sf_dir, "mixed"))


@C.add(sql(f"{_H12}, {VOLUME}", "SELECT * FROM volume ORDER BY total_posts DESC, channel LIMIT 5"))
def top_channels(spark, sf_dir):
    return rollup.top_channels(hours12(spark, sf_dir), 5)


@C.add(sql(f"{_H12}, {VOLUME}", "SELECT channel, hour, post_count, unique_authors, round(mean_score, 6) AS mean_score FROM hourly WHERE channel IN (SELECT channel FROM volume ORDER BY total_posts DESC, channel LIMIT 5)"))
def hourly_top_filtered(spark, sf_dir):
    hours = hours12(spark, sf_dir)
    return rollup.keep_channels(hours, rollup.top_channels(hours, 5))


@C.add(sql(_M12, "SELECT count(*)::bigint AS n_rows, count(DISTINCT channel)::bigint AS n_channels, min(hour) AS first_hour, max(hour) AS last_hour, (sum(post_count) FILTER (data_type = 'comments'))::bigint AS comments, (sum(post_count) FILTER (data_type = 'submissions'))::bigint AS submissions FROM hourly"))
def source_totals(spark, sf_dir):
    total = lambda k: F.sum(F.when(F.col("data_type") == k, F.col("post_count"))).alias(k)
    return hours12(spark, sf_dir, "mixed").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("channel").alias("n_channels"), F.min("hour").alias("first_hour"), F.max("hour").alias("last_hour"), total("comments"), total("submissions"))


@C.add(sql(f"{_H12}, {SCORED}", "SELECT channel, hour, post_count, round(baseline_mean, 6) AS baseline_mean, round(baseline_std, 6) AS baseline_std, round(z, 6) AS z FROM scored"))
def rolling_zscore(spark, sf_dir):
    return anomaly.rolling_z(hours12(spark, sf_dir)).select("channel", "hour", "post_count", "baseline_mean", "baseline_std", "z")


@C.add(sql(f"{_H12}, {SCORED}", "SELECT channel, hour, post_count, round(z, 6) AS z FROM scored WHERE z > 3"))
def anomalous_hours(spark, sf_dir):
    return anomaly.anomalous(anomaly.rolling_z(hours12(spark, sf_dir))).select("channel", "hour", "post_count", "z")


@C.add(sql(f"{_H12}, {SCORED}, {MARKED}", "SELECT window_id, channel, hour FROM marked"))
def anomaly_sessions(spark, sf_dir):
    return anomaly.sessions(anomaly.anomalous(anomaly.rolling_z(hours12(spark, sf_dir)))).select("window_id", "channel", "hour")


@C.add(sql(DETECT5, _WIN))
def anomaly_windows(spark, sf_dir):
    return windows5(spark, sf_dir)


@C.add(sql(DETECT12, _WIN))
def anomaly_windows_summed(spark, sf_dir):
    return windows12(spark, sf_dir)


@C.add(sql(f"{ACT12}, {HOURLY_TYPED}, {SCORED}, {MARKED}, {WINDOWS}", _WIN))
def anomaly_windows_per_type(spark, sf_dir):
    return anomaly.detect(hours12(spark, sf_dir, "per_type"))


@C.add(sql(f"{ACT12}, {HOURLY_MIXED}, {SCORED}, {MARKED}, {WINDOWS}", _WIN))
def anomaly_windows_mixed(spark, sf_dir):
    return anomaly.detect(hours12(spark, sf_dir, "mixed"))


@C.add(sql(DETECT5, "SELECT window_id, channel, round(peak_z, 6) AS peak_z FROM wins ORDER BY wins.peak_z DESC, window_id LIMIT 20"))
def top_windows(spark, sf_dir):
    return windows5(spark, sf_dir).select("window_id", "channel", "peak_z").orderBy(F.desc("peak_z"), "window_id").limit(20)


@C.add(
    sql(
        DETECT5,
        "SELECT count(*)::bigint AS n_windows, count(DISTINCT channel)::bigint AS n_channels, round(avg(duration_hours), 6) AS mean_duration, round(median(duration_hours), 6) AS median_duration, round(max(peak_z), 6) AS max_peak, round(median(peak_z), 6) AS median_peak, round(quantile_cont(peak_z, 0.95), 6) AS p95_peak, round(avg(peak_z), 6) AS mean_peak, round(avg(anomaly_hours), 6) AS mean_hours FROM wins",
    )
)
def window_summary(spark, sf_dir):
    w = windows5(spark, sf_dir)
    return w.agg(
        F.count(F.lit(1)).alias("n_windows"), F.countDistinct("channel").alias("n_channels"), F.avg("duration_hours").alias("mean_duration"), F.median("duration_hours").alias("median_duration"), F.max("peak_z").alias("max_peak"),
        F.median("peak_z").alias("median_peak"), F.percentile("peak_z", 0.95).alias("p95_peak"), F.avg("peak_z").alias("mean_peak"), F.avg("anomaly_hours").alias("mean_hours"),
    )


@C.add(sql(DETECT5, "SELECT strftime(make_timestamp(window_start * 1000000), '%Y-%m') AS month, count(*)::bigint AS n FROM wins GROUP BY ALL"))
def monthly_windows(spark, sf_dir):
    return windows5(spark, sf_dir).groupBy(month_of(F.col("window_start")).alias("month")).agg(F.count(F.lit(1)).alias("n"))


@C.add(sql(DETECT12, "SELECT least(floor(least(peak_z, 30) / 30 * 80), 79)::bigint AS bin, count(*)::bigint AS n FROM wins GROUP BY ALL"))
def z_histogram(spark, sf_dir):
    bin_ = F.least(F.floor(F.least(F.col("peak_z"), F.lit(30.0)) / 30 * 80), F.lit(79)).cast("long")
    return windows12(spark, sf_dir).groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@C.add(sql(DETECT12, "SELECT channel, window_start, window_end, anomaly_hours FROM wins"))
def session_window_equiv(spark, sf_dir):
    """The windows by Spark's session_window instead of gaps and islands."""
    a = anomaly.anomalous(anomaly.rolling_z(hours12(spark, sf_dir)))
    s = a.groupBy("channel", F.session_window(F.timestamp_seconds("hour"), "6 hours").alias("w")).agg(F.min("hour").alias("window_start"), F.max("hour").alias("window_end"), F.count(F.lit(1)).alias("anomaly_hours"))
    return s.drop("w")


_DOW, _HOD = "(({0} // 86400) + 3) % 7", "({0} // 3600) % 24"
_BASE = f"SELECT {_HOD.format('hour')} AS hour_of_day, {_DOW.format('hour')} AS day_of_week, round(avg(post_count), 6) AS avg_post_count, round(avg(unique_authors), 6) AS avg_unique_authors, sum(post_count)::bigint AS total_post_count, count(*)::bigint AS num_observations FROM hourly GROUP BY ALL"
_ANOM = f"SELECT {_HOD.format('window_start')} AS hour_of_day, {_DOW.format('window_start')} AS day_of_week, count(*)::bigint AS anomaly_count, round(avg(peak_z), 6) AS avg_peak_z FROM wins GROUP BY ALL"


@C.add(sql(_H12, _BASE))
def baseline_profile(spark, sf_dir):
    return temporal.baseline_profile(hours12(spark, sf_dir))


@C.add(sql(DETECT12, _ANOM))
def anomaly_profile(spark, sf_dir):
    return temporal.anomaly_profile(windows12(spark, sf_dir))


@C.add(sql(f"{DETECT12}, b AS ({_BASE}), a AS ({_ANOM})", "SELECT b.*, coalesce(anomaly_count, 0) AS anomaly_count, avg_peak_z FROM b LEFT JOIN a USING (hour_of_day, day_of_week)"))
def temporal_patterns(spark, sf_dir):
    return temporal.patterns(temporal.baseline_profile(hours12(spark, sf_dir)), temporal.anomaly_profile(windows12(spark, sf_dir)))


@C.add(sql(DETECT12, f"SELECT {_DOW.format('window_start')} >= 5 AS is_weekend, count(*)::bigint AS n, round(avg(peak_z), 6) AS avg_peak_z, round(avg(duration_hours), 6) AS avg_duration_hours FROM wins GROUP BY ALL"))
def weekday_weekend(spark, sf_dir):
    return temporal.weekday_weekend(windows12(spark, sf_dir))


_CELLS = ", ".join(f"(count(*) FILTER ({_HOD.format('window_start')} = {h}))::bigint AS h{h:02d}" for h in range(24))


@C.add(sql(DETECT12, f"SELECT d.day_of_week, {_CELLS} FROM (SELECT unnest(range(7)) AS day_of_week) d LEFT JOIN wins ON {_DOW.format('window_start')} = d.day_of_week GROUP BY d.day_of_week"))
def heatmap_pivot(spark, sf_dir):
    return temporal.heatmap(windows12(spark, sf_dir))


@C.add(sql(DETECT12, f"SELECT h.hour_of_day, count(window_id)::bigint AS n FROM (SELECT unnest(range(24)) AS hour_of_day) h LEFT JOIN wins ON {_HOD.format('window_start')} = h.hour_of_day GROUP BY h.hour_of_day"))
def hour_radial(spark, sf_dir):
    return temporal.by_hour(windows12(spark, sf_dir))


@C.add(sql(f"{DETECT12}, a AS ({_ANOM})", "SELECT day_of_week, hour_of_day, anomaly_count FROM a ORDER BY anomaly_count DESC, day_of_week, hour_of_day LIMIT 1"))
def peak_slot(spark, sf_dir):
    return temporal.peak_slot(temporal.anomaly_profile(windows12(spark, sf_dir)))


@C.add(sql(f"{DETECT5}", "SELECT channel, count(*)::bigint AS n FROM wins GROUP BY channel ORDER BY n DESC, channel LIMIT 3"))
def top_window_channels(spark, sf_dir):
    return windows5(spark, sf_dir).groupBy("channel").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "channel").limit(3)


@C.add()
def z_sample(spark, sf_dir):
    """A report: about 500,000 of the hours with their z, for a histogram."""
    z = anomaly.rolling_z(hours12(spark, sf_dir)).select("channel", "hour", "z")
    return bernoulli(z, 500_000, ["channel", "hour"])
