"""Joins on time ranges by buckets."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RANGES = 256  # of time, into which a sweep is cut


def near_pairs(wins: DataFrame, radius: int, width: int | None = None) -> DataFrame:
    """a, b: ids of windows of different channels, a's channel first, that lie within radius seconds of each other.

    The left side is filed under every bucket of its range widened by the
    radius, the right side under those of its own range, so that the join is
    an equi-join; a pair is only taken in the first bucket that both have.
    """
    width = width or max(radius, 1)
    at = lambda s: F.floor(s / width)
    a = wins.select(F.col("window_id").alias("a"), F.col("channel").alias("ca"), F.col("window_start").alias("sa"), F.col("window_end").alias("ea"))
    b = wins.select(F.col("window_id").alias("b"), F.col("channel").alias("cb"), F.col("window_start").alias("sb"), F.col("window_end").alias("eb"))
    a = a.withColumn("k", F.explode(F.sequence(at(F.col("sa") - radius), at(F.col("ea") + radius))))
    b = b.withColumn("k", F.explode(F.sequence(at(F.col("sb")), at(F.col("eb")))))
    met = (F.col("ca") < F.col("cb")) & (F.col("ea") >= F.col("sb") - radius) & (F.col("eb") >= F.col("sa") - radius)
    first = F.greatest(at(F.col("sa") - radius), at(F.col("sb")))
    return a.join(b, "k").where(met & (F.col("k") == first)).select("a", "b")


class Furthest:
    """The furthest end so far, and the furthest of another channel than that one's."""

    def __init__(self, seen=()):
        self.top: list[tuple[int, str, str]] = []
        for x in seen:
            self.add(*x)

    def add(self, end: int, window_id: str, channel: str) -> None:
        others = [t for t in self.top if t[2] != channel]
        own = max([(end, window_id, channel), *(t for t in self.top if t[2] == channel)])
        self.top = sorted([own, *others], reverse=True)[:2]

    def besides(self, channel: str) -> tuple[int, str, str] | None:
        return next((t for t in self.top if t[2] != channel), None)


def near_links(wins: DataFrame, radius: int) -> DataFrame:
    """a, b: some of the pairs of near_pairs() and of windows of one channel that have a partner in common, two a window at most, which connect the same windows as all pairs do.

    Windows of one channel mustn't overlap. Swept by start, a window is linked
    to the one before it, of another channel, that ends last. Windows that
    follow each other in a channel are linked if a window of another channel
    is near both. Time is cut into ranges; each begins with the furthest ends
    of the ranges before, two rows each.
    """
    own = wins.select("window_id", "channel", F.col("window_start").alias("start"), F.col("window_end").alias("end"))
    follow = Window.partitionBy("channel").orderBy("start", "window_id")
    after = own.select("*", F.lead("window_id").over(follow).alias("other"), F.lead("start").over(follow).alias("other_start")).where("other IS NOT NULL")
    none = F.lit(None)
    marks = own.select(F.col("start").alias("t"), F.lit(0).alias("kind"), "window_id", "channel", "end", none.cast("string").alias("other"), (F.col("start") - radius).cast("long").alias("least"))
    marks = marks.unionByName(after.select((F.col("end") + radius).cast("long").alias("t"), F.lit(1).alias("kind"), "window_id", "channel", "end", "other", (F.col("other_start") - radius).cast("long").alias("least")))
    cuts = sorted(set(own.approxQuantile("start", [i / RANGES for i in range(1, RANGES)], 0.001)))
    part = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col("t"))) if cuts else F.lit(0)
    marks = marks.withColumn("part", part.cast("int"))

    ends = F.struct("end", "window_id", "channel")
    best = marks.where("kind = 0").groupBy("part", "channel").agg(F.max(ends).alias("m")).withColumn("r", F.row_number().over(Window.partitionBy("part").orderBy(F.desc("m"))))
    held, before = Furthest(), {}
    for r in best.where("r <= 2").orderBy("part", "r").collect():  # two rows for each range
        before.setdefault(r["part"], list(held.top))
        held.add(r["m"]["end"], r["m"]["window_id"], r["m"]["channel"])
    known, last = sorted(before), list(held.top)

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, seen = None, Furthest()
        for batch in batches:
            a, b = [], []
            for part, kind, window_id, channel, end, other, least in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != at:
                    k = bisect_left(known, part)
                    at, seen = part, Furthest(before[known[k]] if k < len(known) else last)
                far = seen.besides(channel)
                if far is not None and far[0] >= least:
                    a.append(window_id)
                    b.append(other if kind else far[1])
                if not kind:
                    seen.add(end, window_id, channel)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], ["a", "b"])

    dealt = marks.repartition("part").sortWithinPartitions("part", "t", "kind", "window_id")
    return dealt.select("part", "kind", "window_id", "channel", "end", "other", "least").mapInArrow(sweep, "a string, b string")


def slice_series(wins: DataFrame, rows: DataFrame, before: int, after: int, start: str = "window_start", end: str = "window_end", at: str = "hour", width: int = 7 * 86400, same_channel: bool = True) -> DataFrame:
    """Each window with the rows of its channel (or all others) with start - before <= at <= end + after.

    Keyed by channel and bucket, so one channel's history is spread over
    tasks. Columns of rows that the window has too get the prefix ``row_``.
    """
    bucket = lambda s: F.floor(s / width)
    low, high = F.col(start) - before, F.col(end) + after
    left = wins.withColumn("__k", F.explode(F.sequence(bucket(low), bucket(high))))
    names = {c: f"row_{c}" if c in wins.columns else c for c in rows.columns}
    right = rows.select(*[F.col(c).alias(n) for c, n in names.items()], bucket(F.col(at)).alias("__k"))
    time, channel = F.col(names[at]), F.col(names.get("channel", "channel"))
    keys = left["__k"] == right["__k"]
    if same_channel:
        on = keys & (left["channel"] == channel)
    else:
        on = keys & (left["channel"] != channel)
    return left.join(right, on & (time >= low) & (time <= high)).drop("__k")
