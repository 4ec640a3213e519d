"""Shapes of spikes and the engagement around them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulse.functions.calendar import HOUR
from pulse.functions.stats import guarded_ratio
from pulse.operators.intervals import slice_series
from pulse.session import DEFAULTS

FLAT = 1e-9


def series(wins: DataFrame, hours: DataFrame, before: int = DEFAULTS.before_hours, after: int = DEFAULTS.after_hours) -> DataFrame:
    """window_id, hour, post_count, unique_authors, mean_score of the hours around each window."""
    return slice_series(wins.select("window_id", "channel", "window_start", "window_end"), hours.select("channel", "hour", "post_count", "unique_authors", "mean_score"), before * HOUR, after * HOUR).select("window_id", "window_start", "window_end", "hour", "post_count", "unique_authors", "mean_score")


def arrays(rows: DataFrame) -> DataFrame:
    """window_id and its counts in order of time."""
    return rows.groupBy("window_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("hour", "post_count"))), lambda x: x["post_count"].cast("double")).alias("v"))


def normalised(series_arrays: DataFrame) -> DataFrame:
    """Adds lo, hi and the series scaled to 0..1; null where it is flat."""
    out = series_arrays.withColumn("lo", F.array_min("v")).withColumn("hi", F.array_max("v"))
    scaled = F.transform("v", lambda x: (x - F.col("lo")) / (F.col("hi") - F.col("lo")))
    return out.withColumn("s", F.when(F.col("hi") - F.col("lo") >= FLAT, scaled))


def peak_features(scaled: DataFrame, lead: int = 24) -> DataFrame:
    """peak_index, time_to_peak, half_decay (values from the peak to the first at most half of it; null without one), sustained (values from lead on over twice the lead's mean, 0.3 at least)."""
    p = (F.array_position("s", F.array_max("s")) - 1).cast("long")
    tail = F.expr("slice(s, cast(peak_index AS int) + 2, size(s))")
    low = F.expr("filter(transform(sequence(0, greatest(size(tail) - 1, 0)), i -> CASE WHEN tail[i] <= s[cast(peak_index AS int)] / 2 THEN cast(i + 1 AS bigint) END), x -> x IS NOT NULL)")
    out = scaled.where(F.col("s").isNotNull()).withColumn("peak_index", p).withColumn("tail", tail)
    out = out.withColumn("half_decay", F.when(F.size("tail") > 0, F.get(low, F.lit(0))))
    head = F.slice("s", 1, lead)
    mean = F.aggregate(head, F.lit(0.0), lambda a, x: a + x) / F.size(head)
    out = out.withColumn("bar", F.greatest(2 * mean, F.lit(0.3)))
    rest = F.when(F.size("s") > lead, F.expr(f"slice(s, {lead + 1}, size(s))")).otherwise(F.array().cast("array<double>"))
    sustained = F.size(F.filter(rest, lambda x: x >= F.col("bar"))).cast("long")
    return out.select("window_id", "peak_index", F.greatest(F.col("peak_index") - lead, F.lit(0)).alias("time_to_peak"), "half_decay", sustained.alias("sustained"))


def find_peaks(x: np.ndarray, distance: int = 3, prominence: float = 0.2) -> np.ndarray:
    """Local maxima (a plateau counts at its middle), at least distance apart (higher ones first), that stand out by prominence."""
    peaks, i, n = [], 1, len(x)
    while i < n - 1:
        if x[i] > x[i - 1]:
            j = i
            while j < n - 1 and x[j + 1] == x[i]:
                j += 1
            if j < n - 1 and x[j + 1] < x[i]:
                peaks.append((i + j) // 2)
            i = j + 1
        else:
            i += 1
    keep = np.ones(len(peaks), bool)
    at = np.array(peaks, int)
    for k in np.argsort(x[at], kind="stable")[::-1] if len(at) else []:
        if keep[k]:
            near = np.abs(at - at[k]) < distance
            near[k] = False
            keep &= ~near
    out = []
    for p in at[keep]:
        left = x[p]
        for v in x[p::-1]:
            if v > x[p]:
                break
            left = min(left, v)
        right = x[p]
        for v in x[p:]:
            if v > x[p]:
                break
            right = min(right, v)
        if x[p] - max(left, right) >= prominence:
            out.append(p)
    return np.array(out, int)


def shape(values, lead: int = 24) -> str:
    """sharp_spike, sustained_plateau, slow_burn or double_peak."""
    # Fixed values of the decision: its thresholds, and the order of its rules.
    v = np.asarray(values, float)
    v = v[~np.isnan(v)]
    if not len(v):
        return "sharp_spike"
    if v.max() - v.min() < FLAT or v.max() == 0:
        return "sustained_plateau"
    s = (v - v.min()) / (v.max() - v.min())
    p = int(s.argmax())
    to_peak = max(p - lead, 0)
    below = np.flatnonzero(s[p + 1 :] <= s[p] / 2)
    decay = int(below[0]) + 1 if len(below) else math.inf  # a peak without a fall to half is never sharp
    bar = max(2 * s[:lead].mean(), 0.3)
    held = int((s[lead:] >= bar).sum())
    peaks = find_peaks(s)
    for a, b in zip(peaks, peaks[1:], strict=False):
        mean = (s[a] + s[b]) / 2
        if mean > 0 and (mean - s[a : b + 1].min()) / mean > 0.2:
            return "double_peak"
    if to_peak < 4 and decay < 8:
        return "sharp_spike"
    if held > 24:
        return "sustained_plateau"
    if to_peak > 12:
        return "slow_burn"
    return "sharp_spike" if decay < 12 else "sustained_plateau"


def shapes(series_arrays: DataFrame) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"window_id": f["window_id"], "spike_shape": [shape(v) for v in f["v"]]})

    return series_arrays.select("window_id", "v").mapInPandas(run, "window_id string, spike_shape string")


def engagement(rows: DataFrame, before: int = DEFAULTS.before_hours, after: int = DEFAULTS.after_hours) -> DataFrame:
    """Means after the window and before it; windows without any hour are left out, a mean without rows is 0."""
    post = (F.col("hour") > F.col("window_end")) & (F.col("hour") <= F.col("window_end") + after * HOUR)
    pre = (F.col("hour") >= F.col("window_start") - before * HOUR) & (F.col("hour") < F.col("window_start"))
    mean = lambda c, cond: F.coalesce(F.avg(F.when(cond, F.col(c))), F.lit(0.0))
    out = rows.groupBy("window_id").agg(mean("mean_score", post).alias("post_spike_avg_score"), mean("unique_authors", post).alias("post_spike_unique_authors"), mean("mean_score", pre).alias("baseline_avg_score"))
    return out.withColumn("engagement_ratio", guarded_ratio(F.col("post_spike_avg_score"), F.col("baseline_avg_score")))
