"""Canonical frames: posts as (channel, data_type, sec, author, score), texts as (channel, sec, text_id, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulse.functions.calendar import seconds
from pulse.functions.text import usable

FIRST = 1704067200  # 2024-01-01


def from_posts(df: DataFrame, data_type: str, channel: str = "channel", created: str = "created_utc") -> DataFrame:
    """Raw posts with epoch seconds."""
    return df.select(F.col(channel).alias("channel"), F.lit(data_type).alias("data_type"), F.col(created).cast("long").alias("sec"), "author", "score")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five channels: the event types."""
    e = _table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("channel"), F.lit("comments").alias("data_type"), seconds(F.col("ts")).alias("sec"), F.col("user_id").alias("author"), F.col("value").alias("score"))


def by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve channels of two data types."""
    e = _table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type").isin("signup", "purchase"), "submissions").otherwise("comments")
    return e.select(F.concat(F.lit("ch"), (F.col("user_id") % 12).cast("string")).alias("channel"), kind.alias("data_type"), seconds(F.col("ts")).alias("sec"), F.col("user_id").alias("author"), F.col("value").alias("score"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents")
    return d.select(F.concat(F.lit("ch"), (F.col("doc_id") % 12).cast("string")).alias("channel"), (F.lit(FIRST) + (F.col("doc_id") * 7 % 720) * 3600).alias("sec"), F.col("doc_id").alias("text_id"), "text")


def union_texts(*frames: DataFrame) -> DataFrame:
    """Texts of several kinds in one frame, without nulls, blanks and placeholders."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.where(usable(F.col("text")))


#: A small catalogue of known events: id, day of January 2024, name, category, channels.
CATALOGUE = (
    (1, 3, "launch", "technology", "ch0|ch3"),
    (2, 5, "final", "sports", "ch1|ch4|ch7"),
    (3, 8, "storm", "breaking_news", "ch2"),
    (4, 10, "verdict", "politics", "ch5|ch6"),
    (5, 12, "premiere", "entertainment", "ch8|ch9"),
    (6, 15, "outage", "technology", "ch10|ch11|ch0"),
    (7, 17, "transfer", "sports", "ch1|ch2"),
    (8, 20, "quake", "breaking_news", "ch3|ch4|ch5"),
    (9, 23, "debate", "politics", "ch6"),
    (10, 26, "awards", "entertainment", "ch7|ch8"),
    (11, 28, "recall", "breaking_news", "ch9|ch10"),
)


#: Another whole catalogue, for the forecast: its events are close together, so that the tables' month has quiet days.
FORECAST_CATALOGUE = (
    (1, 5, "launch", "technology", "ch0|ch3"),
    (2, 6, "final", "sports", "ch1|ch4|ch7"),
    (3, 6, "storm", "breaking_news", "ch2"),
    (4, 7, "verdict", "politics", "ch5|ch6"),
    (5, 8, "premiere", "entertainment", "ch8|ch9"),
    (6, 8, "outage", "technology", "ch10|ch11|ch0"),
    (7, 27, "transfer", "sports", "ch1|ch2"),
    (8, 28, "quake", "breaking_news", "ch3|ch4|ch5"),
)


def catalogue(spark: SparkSession, known: tuple = CATALOGUE) -> DataFrame:
    rows = [(i, FIRST + (d - 1) * 86400, n, c, ch) for i, d, n, c, ch in known]
    return spark.createDataFrame(rows, "event_id bigint, day_sec bigint, name string, category string, relevant_channels string")


def catalogue_sql(known: tuple = CATALOGUE, name: str = "catalogue") -> str:
    rows = ", ".join(f"({i}::bigint, {FIRST + (d - 1) * 86400}::bigint, '{n}', '{c}', '{ch}')" for i, d, n, c, ch in known)
    return f"{name}(event_id, day_sec, name, category, relevant_channels) AS (VALUES {rows})"
