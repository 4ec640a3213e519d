"""Queries on forecasting events from the hours before them, on predictions, and their reports."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from pulse.functions.storage import stored
from pulse.operators import features as feats
from pulse.operators import learning, texts
from pulse.plans import content
from pulse.plans.common import Catalogue, detected, hours12, sql
from pulse.sources.activity import FORECAST_CATALOGUE, catalogue, catalogue_sql

C = Catalogue()

FEATURES = ["trend", "cross_posting_rate", "gini", "z_mean", "z_max", "acceleration", "volume_ratio", "score_trend", "author_growth", "mean_activity", "std_activity", "peak_activity", "mean_authors", "mean_score", "n_hours"]

#: Positives and the quiet hours that are looked at, as one catalogue, before the features.
_EVERY = (
    f"{catalogue_sql(FORECAST_CATALOGUE, 'known')}, near AS (SELECT day_sec + d * 86400 AS day FROM known, (SELECT unnest(range(-3, 4)) AS d)), large AS (SELECT channel FROM hourly GROUP BY channel ORDER BY sum(post_count) DESC, channel LIMIT 50), "
    "quiet AS (SELECT channel, hour, row_number() OVER (ORDER BY (hour // 3600 * 7919 + length(channel) * 104729) % 10007, channel, hour) AS r FROM hourly WHERE channel IN (SELECT channel FROM large) AND hour - hour % 86400 NOT IN (SELECT day FROM near)), "
    "catalogue AS (SELECT * FROM known UNION ALL SELECT (SELECT max(event_id) FROM known) + r, hour, 'non_event', 'non_event', channel FROM quiet WHERE r <= 30 * (SELECT count(*) FROM known))"
)
_EXAMPLES = content._FEATURES.replace(catalogue_sql(), _EVERY, 1) + (
    ", ex AS (SELECT pf.*, cross_posting_rate, gini, acceleration, volume_ratio, name, category, (event_id <= (SELECT max(event_id) FROM known))::double AS label, CASE WHEN std_activity > 0 THEN (peak_activity - mean_activity) / greatest(std_activity, 1.0) ELSE 0.0 END AS z_max"
    " FROM pf JOIN cr USING (event_id) JOIN gi USING (event_id) JOIN ac USING (event_id) JOIN hr USING (event_id) JOIN catalogue USING (event_id)), kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY event_id) AS r FROM ex) WHERE label = 1 OR r <= 3 * (SELECT count(*) FROM known))"
)


def _examples(spark, sf_dir):
    return feats.forecast_examples(stored(hours12(spark, sf_dir)), catalogue(spark, FORECAST_CATALOGUE))


@C.add(sql(_EXAMPLES, "SELECT event_id, name, category, label, peak_activity, n_hours, 0.0::double AS z_mean, " + ", ".join(f"round({c}::double, 6) AS {c}" for c in FEATURES if c not in ("peak_activity", "n_hours", "z_mean")) + " FROM kept"))
def forecast_examples(spark, sf_dir):
    """Known events and quiet hours with the fifteen features of the 48 hours before them."""
    return _examples(spark, sf_dir)


def _held_out(spark, sf_dir):
    """Out-of-fold probabilities in stratified folds, five or as many as there are events."""
    rows = stored(_examples(spark, sf_dir))
    k = min(5, rows.where("label = 1").count())
    return rows, stored(learning.cross_validate(rows, FEATURES, "event_id", k, 200, 8, scale=True, balanced=True))


@C.add()
def forecast_folds(spark, sf_dir):
    return learning.fold_metrics(_held_out(spark, sf_dir)[1])


@C.add()
def forecast_metrics(spark, sf_dir):
    return learning.binary_metrics(_held_out(spark, sf_dir)[1])


@C.add()
def forecast_importance(spark, sf_dir):
    rows = learning.balanced_weights(stored(_examples(spark, sf_dir)), "label")
    return spark.createDataFrame(learning.importance(learning.forest(FEATURES, "label", 300, 10, True, "weight").fit(rows), FEATURES), "feature string, importance double")


def _events(spark, sf_dir):
    rows, held = _held_out(spark, sf_dir)
    return held.join(rows.where("label = 1").select("event_id", "name", "category"), "event_id").select("event_id", "name", "category", "probability")


@C.add()
def forecast_events(spark, sf_dir):
    """Held-out probability of every known event."""
    return _events(spark, sf_dir)


@C.add()
def forecast_extremes(spark, sf_dir):
    """A report of the eight best and the eight worst known events."""
    return learning.extremes(_events(spark, sf_dir), "probability", "event_id", 8)


@C.add()
def forecast_by_category(spark, sf_dir):
    return _events(spark, sf_dir).groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.avg("probability").alias("mean_probability"))


@C.add(
    sql(
        f"{content._PRED}, b AS (SELECT score, sum(actual)::double AS p, sum(1 - actual)::double AS n FROM pr GROUP BY score), r AS (SELECT *, sum(p) OVER d AS rp, sum(n) OVER d AS rn FROM b WINDOW d AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)), t AS (SELECT sum(actual)::double AS tall, sum(guess)::double AS said, sum(actual * guess)::double AS tp FROM pr)",
        "SELECT (sum(p) + sum(n))::bigint AS n, sum(p)::bigint AS positives, round(sum(n * (rp - p / 2)) / (sum(p) * sum(n)), 6) AS auc, round(sum(p * rp / (rp + rn)) / sum(p), 6) AS average_precision, round(any_value(tp / said), 6) AS precision, round(any_value(tp / tall), 6) AS recall, round(any_value(2 * (tp / said) * (tp / tall) / (tp / said + tp / tall)), 6) AS f1 FROM r, t",
    )
)
def binary_metrics(spark, sf_dir):
    return learning.binary_metrics(content._fixed_predictions(spark, sf_dir), "score", "actual", "guess")


@C.add(sql(f"{content._PRED}, ranked AS (SELECT DISTINCT score FROM pr)", "SELECT * FROM (SELECT 'high' AS side, score FROM ranked ORDER BY score DESC LIMIT 3) UNION ALL SELECT * FROM (SELECT 'low' AS side, score FROM ranked ORDER BY score LIMIT 3)"))
def extremes(spark, sf_dir):
    return learning.extremes(content._fixed_predictions(spark, sf_dir).select("score").distinct(), "score", "score", 3).select("side", "score")


@C.add()
def sustain_metrics(spark, sf_dir, min_streak=24):
    """The model of sustained windows, taught by the earlier ones, on the later ones; on stratified rows where time would leave one class only."""
    rows = content._sustain(spark, sf_dir, min_streak)
    train, test = learning.time_or_stratified_split(rows, "window_start", "label", "window_id")
    return learning.binary_metrics(stored(learning.predicted(train, test, content._E, 300, 10, True, True)))


C.add(name="sustain_metrics_2h")(partial(sustain_metrics, min_streak=2))


@C.add()
def predict_windows(spark, sf_dir):
    """The category of every window: out of fold where it is known, by the model of all known ones elsewhere."""
    return learning.predict_unlabelled(stored(content._matrix(spark, sf_dir)), content._F, "window_id")


@C.add(sql(content._SHIFT, "SELECT count(*)::bigint AS n_windows, round(avg(shift), 6) AS mean_shift, count(*) FILTER (shift > 0)::bigint AS n_more_positive, count(*) FILTER (shift < 0)::bigint AS n_more_negative FROM (SELECT CASE WHEN n1 >= 2 AND n2 >= 2 THEN m1 - m2 END AS shift FROM j)"))
def sentiment_summary(spark, sf_dir):
    return texts.shift_summary(content._shift(spark, sf_dir))


@C.add()
def significant_shifts(spark, sf_dir):
    return texts.significance(content._shift(spark, sf_dir)).agg(F.count(F.lit(1)).alias("n_windows"), F.count(F.when(F.col("significant"), 1)).alias("n_significant"))


_DIST = (
    f"{content._MATRIX}, dm AS (SELECT w.window_id, coalesce(arg_max(topic, (n, -topic)) FILTER (topic <> -1), -1) AS topic FROM wins w LEFT JOIN cnt USING (window_id) GROUP BY ALL), "
    + content._SUSTAIN.replace(content.DETECT12 + ", ", "", 1)
    + ", sl AS (SELECT CASE WHEN coalesce(longest, 0) >= 24 THEN 'sustained' ELSE 'decayed' END AS v FROM wins LEFT JOIN st USING (window_id))"
)


@C.add(sql(_DIST, "SELECT 'topic' AS kind, topic::varchar AS value, count(*)::bigint AS n FROM dm GROUP BY topic UNION ALL SELECT 'category', category, count(*)::bigint FROM mt GROUP BY category UNION ALL SELECT 'sustain', v, count(*)::bigint FROM sl GROUP BY v"))
def label_distributions(spark, sf_dir):
    """How many windows have each dominant topic, matched category and sustain label (24 hours over twice the median)."""
    from pulse.operators import labels

    wins, hours = detected(spark, sf_dir)
    wins = stored(wins)
    parts = (
        ("topic", texts.dominant_topic(content._assigned(spark, sf_dir), wins), "dominant_topic"),
        ("category", labels.match_first(wins, catalogue(spark)), "category"),
        ("sustain", feats.sustain_label(wins, hours), "sustain_label"),
    )
    out = None
    for kind, rows, col in parts:
        one = rows.groupBy(F.col(col).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "value", "n")
        out = one if out is None else out.unionByName(one)
    return out


@C.add(sql(content._MATRIX, "SELECT 'posts' AS stage, count(*)::bigint AS n FROM act UNION ALL SELECT 'hours', count(*)::bigint FROM hourly UNION ALL SELECT 'windows', count(*)::bigint FROM wins UNION ALL SELECT 'texts', count(*)::bigint FROM nt UNION ALL SELECT 'entities', count(*)::bigint FROM c0 UNION ALL SELECT 'matches', count(*)::bigint FROM mt"))
def stage_funnel(spark, sf_dir):
    """Rows that each step hands on."""
    from pulse.operators import labels
    from pulse.sources import activity

    wins, hours = detected(spark, sf_dir)
    wins = stored(wins)
    near = texts.window_texts(wins, activity.texts(spark, sf_dir), -86400, 86400)
    steps = {"posts": activity.by_user(spark, sf_dir), "hours": hours, "windows": wins, "texts": near, "entities": texts.entity_totals(texts.entities(near)), "matches": labels.match_first(wins, catalogue(spark))}
    out = None
    for stage, rows in steps.items():
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(stage).alias("stage"), "n")
        out = one if out is None else out.unionByName(one)
    return out
