"""Queries on how windows spread, what shape they have, and known events."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from pulse.functions.stats import average_rank, t_pvalue
from pulse.functions.storage import stored
from pulse.operators import labels, profile, propagation, rollup
from pulse.operators.intervals import near_pairs
from pulse.plans.common import DETECT12, VOLUME, Catalogue, detected, hours12, sql, windows12
from pulse.sources.activity import catalogue, catalogue_sql

C = Catalogue()
_PAIRS = "pairs AS (SELECT a.window_id AS a, b.window_id AS b FROM wins a JOIN wins b ON a.channel < b.channel AND a.window_end >= b.window_start - 172800 AND b.window_end >= a.window_start - 172800)"
_PAIRS6 = _PAIRS.replace("172800", "21600")
_CLUSTERS = "both_ways AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a), clusters AS (SELECT a AS window_id, least(min(b), a) AS cluster_id FROM reach GROUP BY a)"
#: The queries on clusters use six hours: with 48 nearly all windows of the small tables are one cluster.
_MEMBERS = f"{DETECT12.replace('act AS', 'RECURSIVE act AS', 1)}, {VOLUME}, {_PAIRS6}, {_CLUSTERS}, members AS (SELECT w.*, c.cluster_id, v.total_posts FROM wins w JOIN clusters c USING (window_id) LEFT JOIN volume v USING (channel)), p AS (SELECT quantile_disc(total_posts, 0.5) AS p50, quantile_disc(total_posts, 0.75) AS p75 FROM volume)"
_PROFILE = f"""{_MEMBERS}, first AS (SELECT cluster_id, min(window_start) AS first_detection FROM members GROUP BY cluster_id),
prof AS (SELECT cluster_id, string_agg(channel, '|' ORDER BY window_start, channel, window_id) AS channel_sequence, count(*)::bigint AS num_windows, count(DISTINCT channel)::bigint AS num_channels,
 (max(window_end) - any_value(first_detection)) / 3600.0::double AS total_duration_hours, any_value(first_detection) AS first_detection,
 avg(CASE WHEN window_start - first_detection <= 7200 THEN 1.0::double ELSE 0.0 END) AS share_within, arg_min(total_posts, (window_start, channel, window_id)) AS first_mover_size
 FROM members JOIN first USING (cluster_id) GROUP BY cluster_id),
typed AS (SELECT prof.*, CASE WHEN share_within > 0.5 THEN 'simultaneous' WHEN first_mover_size < p50 THEN 'niche_to_mainstream' WHEN first_mover_size >= p75 THEN 'top_down' ELSE 'niche_to_mainstream' END AS propagation_type FROM prof, p)"""


def _members(spark, sf_dir, radius=6):
    wins, hours = detected(spark, sf_dir)
    wins = stored(wins)
    volume = rollup.channel_volume(hours)
    return propagation.members(wins, propagation.clusters(wins, radius), volume), volume


@C.add(sql(f"{DETECT12}, {_PAIRS}", "SELECT a, b FROM pairs"))
def cooccurring_pairs(spark, sf_dir):
    return near_pairs(windows12(spark, sf_dir), 48 * 3600)


@C.add(sql(_MEMBERS, "SELECT window_id, cluster_id FROM clusters"))
def event_clusters(spark, sf_dir, radius=6):
    return propagation.clusters(stored(windows12(spark, sf_dir)), radius)


@C.add(sql(_PROFILE, "SELECT cluster_id, channel_sequence, propagation_type, num_windows, num_channels, round(total_duration_hours, 6) AS total_duration_hours, first_detection, round(share_within, 6) AS share_within, first_mover_size FROM typed"))
def cluster_profile(spark, sf_dir, radius=6):
    return propagation.profile(*_members(spark, sf_dir, radius))


@C.add(sql(_PROFILE, "SELECT propagation_type, count(*)::bigint AS n, max(num_channels) AS max_channels, round(avg(total_duration_hours), 6) AS avg_duration FROM typed GROUP BY propagation_type"))
def propagation_type(spark, sf_dir, radius=6):
    return propagation.profile(*_members(spark, sf_dir, radius)).groupBy("propagation_type").agg(F.count(F.lit(1)).alias("n"), F.max("num_channels").alias("max_channels"), F.avg("total_duration_hours").alias("avg_duration"))


@C.add(sql(_MEMBERS, "SELECT p50, p75 FROM p"))
def size_percentiles(spark, sf_dir):
    return propagation.size_percentiles(rollup.channel_volume(hours12(spark, sf_dir)))


@C.add(sql(_MEMBERS, "SELECT cluster_id, window_id, channel, total_posts, round((window_start - min(window_start) OVER (PARTITION BY cluster_id)) / 3600.0::double, 6) AS offset_hours FROM members"))
def cluster_offsets(spark, sf_dir, radius=6):
    return propagation.offsets(_members(spark, sf_dir, radius)[0])


@C.add(sql(_PROFILE, "SELECT cluster_id, num_windows FROM typed ORDER BY num_windows DESC, cluster_id LIMIT 10"))
def largest_clusters(spark, sf_dir, radius=6):
    return propagation.profile(*_members(spark, sf_dir, radius)).select("cluster_id", "num_windows").orderBy(F.desc("num_windows"), "cluster_id").limit(10)


# The same with the operator's own radius of 48 hours.
for _f in (event_clusters, cluster_profile, propagation_type, cluster_offsets, largest_clusters):
    C.add(name=f"{_f.__name__}_48h")(partial(_f, radius=48))
    C.sql[f"{_f.__name__}_48h"] = C.sql[_f.__name__].replace(_PAIRS6, _PAIRS)


_PROFILE48 = _PROFILE.replace(_PAIRS6, _PAIRS)
_TOP = f"{_PROFILE48}, top AS (SELECT cluster_id FROM typed ORDER BY num_windows DESC, cluster_id LIMIT 10)"


def _largest(rows):
    return rows.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "cluster_id").limit(10).select("cluster_id")


@C.add(sql(_TOP, "SELECT a, b, cluster_id FROM pairs JOIN clusters ON window_id = a WHERE cluster_id IN (SELECT cluster_id FROM top)"))
def largest_cluster_edges(spark, sf_dir):
    """The graph of the ten largest clusters."""
    wins = stored(windows12(spark, sf_dir))
    pairs, found = near_pairs(wins, 48 * 3600), stored(propagation.clusters(wins))
    return pairs.join(found.withColumnRenamed("window_id", "a"), "a").join(F.broadcast(_largest(found)), "cluster_id", "left_semi").select("a", "b", "cluster_id")


@C.add(sql(_TOP, "SELECT * FROM (SELECT cluster_id, window_id, channel, total_posts, round((window_start - min(window_start) OVER (PARTITION BY cluster_id)) / 3600.0::double, 6) AS offset_hours FROM members) WHERE cluster_id IN (SELECT cluster_id FROM top)"))
def largest_cluster_offsets(spark, sf_dir):
    rows = stored(_members(spark, sf_dir, 48)[0])
    return propagation.offsets(rows).join(F.broadcast(_largest(rows)), "cluster_id", "left_semi")


@C.add(sql(_PROFILE48, "SELECT cluster_id, window_id, row_number() OVER (PARTITION BY cluster_id ORDER BY window_start, channel, window_id)::bigint AS place FROM members"))
def cluster_order(spark, sf_dir):
    return propagation.order_of(_members(spark, sf_dir, 48)[0])


@C.add(sql(_PROFILE48, "SELECT ((first_detection // 86400 + 3) % 7 >= 5)::bigint AS is_weekend, count(*)::bigint AS n, round(avg(total_duration_hours), 6) AS avg_propagation_hours, round(avg(num_channels), 6) AS avg_num_channels FROM typed GROUP BY 1"))
def weekend_propagation(spark, sf_dir):
    return propagation.by_weekend(propagation.profile(*_members(spark, sf_dir, 48)))


_SERIES = f"{DETECT12}, series AS (SELECT w.window_id, w.window_start, w.window_end, h.hour, h.post_count, h.unique_authors, h.mean_score FROM wins w JOIN hourly h ON h.channel = w.channel AND h.hour BETWEEN w.window_start - 86400 AND w.window_end + 259200)"
_SCALED = f"{_SERIES}, arr AS (SELECT window_id, list(post_count::double ORDER BY hour) AS v FROM series GROUP BY window_id), norm AS (SELECT window_id, v, list_min(v) AS lo, list_max(v) AS hi FROM arr), scaled AS (SELECT *, CASE WHEN hi - lo >= 1e-9 THEN list_transform(v, lambda x: (x - lo) / (hi - lo)) END AS s FROM norm)"


def _series(spark, sf_dir):
    return profile.series(*detected(spark, sf_dir))


@C.add(sql(_SERIES, "SELECT window_id, hour, post_count, unique_authors, round(mean_score, 6) AS mean_score FROM series"))
def window_series(spark, sf_dir):
    return _series(spark, sf_dir).drop("window_start", "window_end")


_ENG = f"""{_SERIES}, eng AS (SELECT window_id, coalesce(avg(mean_score) FILTER (hour > window_end), 0.0) AS post_spike_avg_score, coalesce(avg(unique_authors) FILTER (hour > window_end), 0.0) AS post_spike_unique_authors, coalesce(avg(mean_score) FILTER (hour < window_start), 0.0) AS baseline_avg_score FROM series GROUP BY window_id),
joined AS (SELECT e.*, w.peak_z, w.channel FROM eng e JOIN wins w USING (window_id))"""


@C.add(sql(_ENG, "SELECT window_id, round(post_spike_avg_score, 6) AS post_spike_avg_score, round(post_spike_unique_authors, 6) AS post_spike_unique_authors, round(baseline_avg_score, 6) AS baseline_avg_score, round(CASE WHEN baseline_avg_score > 0 THEN post_spike_avg_score / baseline_avg_score END, 6) AS engagement_ratio FROM eng"))
def engagement(spark, sf_dir):
    return profile.engagement(_series(spark, sf_dir))


@C.add(sql(_SCALED, "SELECT window_id, lo, hi, len(v)::bigint AS n, round(list_sum(s), 6) AS total FROM scaled"))
def series_normalised(spark, sf_dir):
    n = profile.normalised(profile.arrays(_series(spark, sf_dir)))
    return n.select("window_id", "lo", "hi", F.size("v").cast("long").alias("n"), F.aggregate("s", F.lit(0.0), lambda a, x: a + x).alias("total"))


_PEAKS = f"""{_SCALED}, pk AS (SELECT *, list_position(s, list_max(s)) AS p FROM scaled WHERE s IS NOT NULL)"""


@C.add(
    sql(
        _PEAKS,
        "SELECT window_id, (p - 1)::bigint AS peak_index, greatest(p - 25, 0)::bigint AS time_to_peak, list_min(list_filter(list_transform(range(1, len(s) - p + 1), lambda i: CASE WHEN s[p + i] <= s[p] / 2 THEN i END), lambda i: i IS NOT NULL))::bigint AS half_decay, "
        "len(list_filter(s[25:], lambda x: x >= greatest(2 * list_avg(s[1:24]), 0.3)))::bigint AS sustained FROM pk",
    )
)
def peak_features(spark, sf_dir):
    return profile.peak_features(profile.normalised(profile.arrays(_series(spark, sf_dir))))


@C.add()
def spike_shape(spark, sf_dir):
    return profile.shapes(profile.arrays(_series(spark, sf_dir)))


@C.add()
def shape_distribution(spark, sf_dir):
    s = profile.shapes(profile.arrays(_series(spark, sf_dir)))
    counts = s.groupBy("spike_shape").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("spike_shape", "n", (100.0 * F.col("n") / F.col("total")).alias("percent"))


def _joined(spark, sf_dir):
    wins, hours = detected(spark, sf_dir)
    e = profile.engagement(profile.series(wins, hours)).join(wins.select("window_id", "peak_z"), "window_id")
    return e.where(F.col("post_spike_avg_score") > 0)


@C.add(sql(_ENG, "SELECT count(*)::bigint AS n, CASE WHEN count(*) > 5 THEN round(corr(peak_z, post_spike_avg_score), 6) END AS r FROM joined WHERE post_spike_avg_score > 0"))
def corr_pearson(spark, sf_dir):
    return _joined(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.corr("peak_z", "post_spike_avg_score").alias("r")).select("n", F.when(F.col("n") > 5, F.col("r")).alias("r"))


@C.add()
def corr_pearson_p(spark, sf_dir):
    one = corr_pearson(spark, sf_dir)
    t = F.col("r") * F.sqrt((F.col("n") - 2) / (1 - F.col("r") * F.col("r")))
    return one.select("n", "r", t_pvalue(t, (F.col("n") - 2).cast("double")).alias("p"))


@C.add(sql(f"{_ENG}, e AS (SELECT round(peak_z, 9) AS peak_z, round(post_spike_avg_score, 9) AS post_spike_avg_score FROM joined WHERE post_spike_avg_score > 0), ranks AS (SELECT rank() OVER (ORDER BY peak_z) + (count(*) OVER (PARTITION BY peak_z) - 1) / 2.0 AS rx, rank() OVER (ORDER BY post_spike_avg_score) + (count(*) OVER (PARTITION BY post_spike_avg_score) - 1) / 2.0 AS ry FROM e)", "SELECT count(*)::bigint AS n, round(corr(rx, ry), 6) AS rho FROM ranks"))
def corr_spearman(spark, sf_dir):
    """Ties are values that are equal to nine places, so that the order of sums doesn't part them."""
    e = stored(_joined(spark, sf_dir).select("window_id", *[F.round(c, 9).alias(c) for c in ("peak_z", "post_spike_avg_score")]))
    r = average_rank(average_rank(e, "peak_z", "rx"), "post_spike_avg_score", "ry")
    return r.agg(F.count(F.lit(1)).alias("n"), F.corr("rx", "ry").alias("rho"))


@C.add()
def corr_spearman_p(spark, sf_dir):
    """With the two-sided p; both null for five windows or fewer."""
    one = corr_spearman(spark, sf_dir).withColumn("rho", F.when(F.col("n") > 5, F.col("rho")))
    t = F.col("rho") * F.sqrt((F.col("n") - 2) / (1 - F.col("rho") * F.col("rho")))
    return one.select("n", "rho", t_pvalue(t, (F.col("n") - 2).cast("double")).alias("p"))


@C.add(sql(_ENG, "SELECT round(regr_slope(post_spike_avg_score, peak_z), 6) AS slope, round(regr_intercept(post_spike_avg_score, peak_z), 6) AS intercept FROM joined WHERE post_spike_avg_score > 0"))
def ols_line(spark, sf_dir):
    return _joined(spark, sf_dir).agg(F.regr_slope("post_spike_avg_score", "peak_z").alias("slope"), F.regr_intercept("post_spike_avg_score", "peak_z").alias("intercept"))


@C.add(sql(_ENG, "SELECT round(avg(r), 6) AS mean_ratio, round(median(r), 6) AS median_ratio FROM (SELECT CASE WHEN baseline_avg_score > 0 THEN post_spike_avg_score / baseline_avg_score END AS r FROM eng)"))
def engagement_ratio_summary(spark, sf_dir):
    return profile.engagement(_series(spark, sf_dir)).agg(F.avg("engagement_ratio").alias("mean_ratio"), F.median("engagement_ratio").alias("median_ratio"))


_EV = f"{catalogue_sql()}, ev AS (SELECT event_id, day_sec, name, category, unnest(string_split(relevant_channels, '|')) AS channel FROM catalogue)"


@C.add(sql(_EV, "SELECT * FROM ev"))
def event_channels(spark, sf_dir):
    return labels.event_channels(catalogue(spark))


@C.add(sql(f"{DETECT12}, {_EV}", "SELECT window_id, event_id, name, category FROM (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY event_id) AS n FROM wins JOIN ev USING (channel) WHERE window_start <= day_sec + 86400 AND window_end >= day_sec - 86400) WHERE n = 1"))
def match_first(spark, sf_dir):
    return labels.match_first(windows12(spark, sf_dir), catalogue(spark))


@C.add(sql(f"{DETECT12}, {_EV}", "SELECT window_id, event_id, category, abs(window_start // 86400 - day_sec // 86400)::bigint AS day_gap FROM wins JOIN ev USING (channel) WHERE abs(window_start // 86400 - day_sec // 86400) <= 2"))
def match_band(spark, sf_dir):
    return labels.match_band(windows12(spark, sf_dir), catalogue(spark))


_ML = f"{_ENG}, {_EV}"


@C.add(sql(_ML, "SELECT window_id, w.channel, round(w.peak_z, 6) AS peak_z, round(mean_z, 6) AS mean_z, round(duration_hours, 6) AS duration_hours, anomaly_hours, peak_post_count, round(mean_post_count, 6) AS mean_post_count, (window_start // 3600) % 24 AS hour_of_day, (window_start // 86400 + 3) % 7 AS day_of_week, ((window_start // 86400 + 3) % 7 >= 5)::bigint AS is_weekend, round(post_spike_avg_score, 6) AS post_spike_avg_score, round(post_spike_unique_authors, 6) AS post_spike_unique_authors, round(baseline_avg_score, 6) AS baseline_avg_score, round(CASE WHEN baseline_avg_score > 0 THEN post_spike_avg_score / baseline_avg_score END, 6) AS engagement_ratio, event_id, category, (duration_hours > 12)::bigint AS sustained FROM wins w JOIN eng USING (window_id) JOIN ev ON ev.channel = w.channel AND abs(window_start // 86400 - day_sec // 86400) <= 2"))
def labelled_matrix(spark, sf_dir):
    wins, hours = detected(spark, sf_dir)
    return labels.labelled_matrix(wins, profile.engagement(profile.series(wins, hours)), catalogue(spark))


_COVER = f"{DETECT12}, {_EV}, met AS (SELECT event_id, count(*)::bigint AS n_windows, count(DISTINCT channel)::bigint AS n_channels, max(peak_z) AS max_peak_z FROM ev JOIN wins USING (channel) WHERE window_start <= day_sec + 86400 AND window_end >= day_sec - 86400 GROUP BY event_id), covered AS (SELECT event_id, name, category, n_windows IS NOT NULL AS matched, coalesce(n_windows, 0) AS n_windows, coalesce(n_channels, 0) AS n_channels, round(max_peak_z, 6) AS max_peak_z FROM catalogue LEFT JOIN met USING (event_id))"


@C.add(sql(_COVER, "SELECT * FROM covered"))
def event_coverage(spark, sf_dir):
    return labels.coverage(windows12(spark, sf_dir), catalogue(spark))


@C.add(sql(_COVER, "SELECT category, (count(*) FILTER (matched))::bigint AS matched, count(*)::bigint AS total FROM covered GROUP BY category"))
def coverage_by_category(spark, sf_dir):
    return labels.coverage_by_category(labels.coverage(windows12(spark, sf_dir), catalogue(spark)))


@C.add(sql(_EV, "SELECT category, (day_sec // 86400 + 3) % 7 AS day_of_week, count(DISTINCT event_id)::bigint AS n_events FROM ev GROUP BY ALL"))
def events_by_dow(spark, sf_dir):
    return labels.events_by_weekday(catalogue(spark))
