"""Statistics as column expressions and small frames."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def guarded_z(x: Column, mean: Column, std: Column) -> Column:
    """(x - mean) / std; 0 where std is null or not over 0."""
    return F.when(std > 0, (x - mean) / std).otherwise(F.lit(0.0))


def guarded_ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is not over 0."""
    return F.when(b > 0, a / b)


def bernoulli(df: DataFrame, rows: int, idents: list[str], seed: int = 42) -> DataFrame:
    """Each row with a chance of rows / (rows of df), 1 at most, by a hash of its identifying columns: the same on every run."""
    total = df.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("__n"))  # one row
    draw = F.pmod(F.xxhash64(F.lit(seed), *idents), F.lit(1 << 53)) / F.lit(float(1 << 53))
    return df.crossJoin(F.broadcast(total)).where(draw < F.lit(float(rows)) / F.col("__n")).drop("__n")


def running_totals(df: DataFrame, order: str, values: list[str], descending: bool = False, ranges: int = 256) -> DataFrame:
    """Adds run_<value>, the sum of a value over all rows up to this one in the order of a number that is never null.

    The rows are cut into ranges at approximate quantiles; each range sums its
    own rows and adds what the ranges before it hold, a table of at most
    ``ranges`` rows. No task gets all rows.
    """
    cuts = sorted(set(df.approxQuantile(order, [i / ranges for i in range(1, ranges)], 0.001)))
    below = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col(order))) if cuts else F.lit(0)
    marked = df.withColumn("__range", -below if descending else below)
    sums = marked.groupBy("__range").agg(*[F.sum(v).alias(f"__sum_{v}") for v in values])
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    held = sums.select("__range", *[F.coalesce(F.sum(f"__sum_{v}").over(before), F.lit(0)).alias(f"__before_{v}") for v in values])
    own = Window.partitionBy("__range").orderBy(F.desc(order) if descending else F.asc(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = marked.join(F.broadcast(held), "__range")
    return out.select(*df.columns, *[(F.col(f"__before_{v}") + F.sum(v).over(own)).alias(f"run_{v}") for v in values])


def average_rank(df: DataFrame, value: str, name: str) -> DataFrame:
    """Adds 1-based ranks, ties sharing their mean; null for null.

    Ranks come from counts of distinct values, so equal values are aggregated
    before anything is ordered.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("__n"))
    ranks = running_totals(counts, value, ["__n"]).select(value, (F.col("run___n") - (F.col("__n") - 1) / 2.0).alias(name))
    return df.join(ranks, value, "left")


def welch(n1: Column, m1: Column, v1: Column, n2: Column, m2: Column, v2: Column) -> tuple[Column, Column]:
    """t and degrees of freedom for unequal variances; null where a side has under two values or both have no variance."""
    e1, e2 = v1 / n1, v2 / n2
    ok = (n1 >= 2) & (n2 >= 2) & (e1 + e2 > 0)
    t = F.when(ok, (m1 - m2) / F.sqrt(e1 + e2))
    df = F.when(ok, (e1 + e2) * (e1 + e2) / (e1 * e1 / (n1 - 1) + e2 * e2 / (n2 - 1)))
    return t, df


def beta_fraction(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_fraction(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 400):
        for up in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + up * d, 1 + up / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            total *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * total


def t_tail(t: float | None, df: float | None) -> float | None:
    """Two-sided p of Student's t."""
    if t is None or df is None or df <= 0:
        return None
    return beta_fraction(df / 2, 0.5, df / (df + t * t))


def t_pvalue(t: Column, df: Column) -> Column:
    """Two-sided p as a column, in Arrow batches."""
    @F.pandas_udf("double")
    def p(ts: pd.Series, dfs: pd.Series) -> pd.Series:
        return pd.Series([t_tail(None if pd.isna(a) else a, None if pd.isna(b) else b) for a, b in zip(ts, dfs, strict=True)], dtype="float64")

    return p(t, df)


def gini(df: DataFrame, key: str, value: str) -> DataFrame:
    """key, gini: 0 for up to one value or a sum not over 0, else within 0 and 1."""
    order = Window.partitionBy(key).orderBy(value)
    ranked = df.select(key, value, F.row_number().over(order).alias("i"))
    g = ranked.groupBy(key).agg(F.sum(F.col("i") * F.col(value)).alias("s"), F.sum(value).alias("t"), F.count(F.lit(1)).alias("n"))
    raw = (2.0 * F.col("s") - (F.col("n") + 1) * F.col("t")) / (F.col("n") * F.col("t"))
    return g.select(key, F.when((F.col("n") > 1) & (F.col("t") > 0), F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))).otherwise(F.lit(0.0)).alias("gini"))


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """All doubles rounded, after a step of 1e-10 up: a tie goes the same way in any engine, whatever the order of its sums."""
    return df.select(*[F.round(F.col(c) + F.lit(1e-10), places).alias(c) if k in ("double", "float") else F.col(c) for c, k in df.dtypes])
