"""What the query modules share: frames over the tables and the same steps as SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from pulse.functions.stats import rounded
from pulse.functions.storage import stored
from pulse.operators import anomaly, rollup
from pulse.sources import activity


@dataclass
class Catalogue:
    """Queries by name with their SQL."""

    queries: dict[str, Callable[[SparkSession, str], DataFrame]] = field(default_factory=dict)
    sql: dict[str, str] = field(default_factory=dict)

    def add(self, sql: str | None = None, name: str | None = None):
        def register(f: Callable[[SparkSession, str], DataFrame]):
            key = name or f.__name__
            self.queries[key] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
            if sql is not None:
                self.sql[key] = sql.replace(", 6)", " + 1e-10, 6)")  # as rounded() does
            return f

        return register


def hours12(spark: SparkSession, sf_dir: str, grain: str = "summed") -> DataFrame:
    return rollup.hourly(activity.by_user(spark, sf_dir), grain)


def hours5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.hourly(activity.by_type(spark, sf_dir))


def windows12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomaly.detect(hours12(spark, sf_dir))


def windows5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomaly.detect(hours5(spark, sf_dir))


def detected(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Windows and hours of the twelve channels; posts are read once, for hours that are written to the shared folder."""
    hours = stored(hours12(spark, sf_dir))
    return anomaly.detect(hours), hours


ACT5 = "act AS (SELECT event_type AS channel, 'comments' AS data_type, floor(epoch(ts))::bigint AS sec, user_id AS author, value AS score FROM events)"
ACT12 = "act AS (SELECT 'ch' || (user_id % 12) AS channel, CASE WHEN event_type IN ('signup', 'purchase') THEN 'submissions' ELSE 'comments' END AS data_type, floor(epoch(ts))::bigint AS sec, user_id AS author, value AS score FROM events)"
_COUNTS = "count(score)::bigint AS post_count, count(DISTINCT author)::bigint AS unique_authors, avg(score) AS mean_score"
HOURLY = f"hourly AS (SELECT channel, sec - sec % 3600 AS hour, {_COUNTS} FROM act WHERE channel IS NOT NULL GROUP BY ALL)"
HOURLY_MIXED = f"hourly AS (SELECT channel, sec - sec % 3600 AS hour, data_type, {_COUNTS} FROM act WHERE channel IS NOT NULL GROUP BY ALL)"
HOURLY_TYPED = f"hourly AS (SELECT channel || ':' || data_type AS channel, sec - sec % 3600 AS hour, data_type, {_COUNTS} FROM act WHERE channel IS NOT NULL GROUP BY ALL)"
SCORED = (
    "base AS (SELECT *, avg(post_count) OVER w AS baseline_mean, stddev_pop(post_count) OVER w AS baseline_std FROM hourly WINDOW w AS (PARTITION BY channel ORDER BY hour RANGE BETWEEN 604800 PRECEDING AND 1 PRECEDING)), "
    "scored AS (SELECT *, CASE WHEN baseline_std > 0 THEN (post_count - baseline_mean) / baseline_std ELSE 0.0 END AS z FROM base)"
)
MARKED = (
    "fresh AS (SELECT *, CASE WHEN lag(hour) OVER o IS NULL OR hour - lag(hour) OVER o > 21600 THEN 1 ELSE 0 END AS new FROM scored WHERE z > 3 WINDOW o AS (PARTITION BY channel ORDER BY hour)), "
    "marked AS (SELECT *, channel || '_' || sum(new) OVER (PARTITION BY channel ORDER BY hour ROWS UNBOUNDED PRECEDING)::bigint AS window_id FROM fresh)"
)
WINDOWS = (
    "wins AS (SELECT window_id, channel, min(hour) AS window_start, max(hour) AS window_end, max(z) AS peak_z, avg(z) AS mean_z, count(*)::bigint AS anomaly_hours, max(post_count) AS peak_post_count, avg(post_count) AS mean_post_count, (max(hour) - min(hour)) / 3600.0::double AS duration_hours FROM marked GROUP BY ALL)"
)
DETECT5 = ", ".join((ACT5, HOURLY, SCORED, MARKED, WINDOWS))
DETECT12 = ", ".join((ACT12, HOURLY, SCORED, MARKED, WINDOWS))
VOLUME = "volume AS (SELECT channel, sum(post_count)::bigint AS total_posts FROM hourly GROUP BY channel)"


def sql(ctes: str, body: str) -> str:
    return f"WITH {ctes} {body}"
