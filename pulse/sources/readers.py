"""Scans and sinks."""

from __future__ import annotations

import json
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.IntegerType()),
        T.StructField("date", T.DateType()),
        T.StructField("name", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("relevant_channels", T.StringType()),
    ]
)


def read_posts(spark: SparkSession, base: str, columns: list[str], months: list[tuple[int, int]] | None = None, channels: list[str] | None = None, channel_col: str = "channel") -> DataFrame:
    """A parquet tree partitioned by yyyy and mm: only the columns, months and channels asked for are read."""
    df = spark.read.parquet(base)
    if months is not None:
        df = df.where(_in_months(months))
    if channels is not None:
        df = df.where(F.col(channel_col).isin(channels))
    return df.select(*columns)


def read_local_first(spark: SparkSession, name: str, *roots: str) -> DataFrame:
    """The parquet table of this name in the first root that has it."""
    hadoop = spark._jsc.hadoopConfiguration()
    for root in roots:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        if path.getFileSystem(hadoop).exists(path):
            return spark.read.parquet(f"{root}/{name}")
    raise FileNotFoundError(f"{name} is in none of {', '.join(roots)}")


def read_optional(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table, or an empty one of the schema where there is none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def read_event_catalogue(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENT_SCHEMA).csv(path, header=True)


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def write_months(df: DataFrame, path: str) -> None:
    """Replaces the months that df holds, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("yyyy", "mm").parquet(path)
    spark = df.sparkSession
    mark = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")  # which a dynamic overwrite doesn't leave
    mark.getFileSystem(spark._jsc.hadoopConfiguration()).create(mark, True).close()


def cached_texts(spark: SparkSession, path: str, texts: Callable[[], DataFrame], months: list[tuple[int, int]], at: str = "sec") -> DataFrame:
    """Texts of the months asked for, from tables by month below path.

    Months that are not there yet are taken from texts() and written, in one
    pass; a month is there once its folder's mark is, also when it has no text.
    """
    hadoop, Path = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    mark = lambda y, m: Path(f"{path}/done/{y:04d}-{m:02d}")
    fs = Path(path).getFileSystem(hadoop)
    missing = [ym for ym in sorted(set(months)) if not fs.exists(mark(*ym))]
    if missing:
        when = F.timestamp_seconds(F.col(at))
        new = texts().withColumn("yyyy", F.year(when)).withColumn("mm", F.month(when))
        write_months(new.where(_in_months(missing)), f"{path}/months")
        for ym in missing:
            fs.create(mark(*ym)).close()
    found = read_optional(spark, f"{path}/months", T.StructType([*texts().schema.fields, T.StructField("yyyy", T.IntegerType()), T.StructField("mm", T.IntegerType())]))
    return found.where(_in_months(months)).drop("yyyy", "mm")


def _in_months(months: list[tuple[int, int]]):
    wanted = F.lit(False)
    for y, m in months:
        wanted = wanted | ((F.col("yyyy") == y) & (F.col("mm") == m))
    return wanted


def is_done(spark: SparkSession, *paths: str) -> bool:
    """Whether all tables were written to their end."""
    hadoop = spark._jsc.hadoopConfiguration()
    for p in paths:
        mark = spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")
        if not mark.getFileSystem(hadoop).exists(mark):
            return False
    return True


def write_summary(row: DataFrame, path: str) -> dict:
    """A frame of one row as a JSON file of the driver."""
    first = row.limit(1).collect()
    out = first[0].asDict(recursive=True) if first else {}
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w") as f:
        json.dump(out, f, default=str, indent=2)
    return out
