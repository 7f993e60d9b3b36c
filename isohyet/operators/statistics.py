"""Statistics over groups: trends, tests, weighted moments, regressions.

What Catalyst has built-in aggregates for is composed from them. Tail
probabilities come from numpy functions applied to whole columns of already
aggregated rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def beta_inc(a: np.ndarray, b: float, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function, by its continued fraction."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    swap = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    tiny = 1e-300
    c, d = np.ones_like(z), 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 300):
        for num in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d, c = 1 + num * d, 1 + num / c
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
    lg = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(divide="ignore"):
        front = np.exp(lg(p + q) - lg(p) - lg(q) + p * np.log(z) + q * np.log1p(-z)) / p
    return np.where(swap, 1 - front * h, front * h)


@F.pandas_udf(T.DoubleType())
def t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p-value of Student's t."""
    ok = t.notna() & df.notna() & (df > 0)
    out = pd.Series(np.nan, index=t.index)
    tt, n = t[ok].to_numpy(float), df[ok].to_numpy(float)
    out[ok] = beta_inc(n / 2, 0.5, n / (n + tt * tt)) if len(tt) else []
    return out.where(ok, None)


def trend(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Slope, intercept, r, n of a least-squares line, and t of the slope."""
    out = df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(x, y).alias("r"), F.regr_count(F.col(y), F.col(x)).alias("n"))
    return out.withColumn("t", F.col("r") * F.sqrt(F.try_divide(F.col("n") - 2, 1 - F.col("r") * F.col("r"))))


def welch(a: str, b: str) -> tuple[Column, Column]:
    """t and degrees of freedom from aggregates m_, v_, n_ of two samples."""
    va, vb = F.col(f"v_{a}") / F.col(f"n_{a}"), F.col(f"v_{b}") / F.col(f"n_{b}")
    t = F.try_divide(F.col(f"m_{a}") - F.col(f"m_{b}"), F.sqrt(va + vb))
    return t, F.try_divide(F.pow(va + vb, 2), va * va / (F.col(f"n_{a}") - 1) + vb * vb / (F.col(f"n_{b}") - 1))


def inversions(a: np.ndarray) -> int:
    """Pairs of places whose values fall, by merging sorted runs."""
    ranks = np.unique(a, return_inverse=True)[1].astype(np.int64)
    n, total, width = len(ranks), 0, 1
    if n < 2:
        return 0
    top = int(ranks.max()) + 1
    ranks = np.append(ranks, np.full((1 << (n - 1).bit_length()) - n, top - 1))
    while width < n:
        runs = ranks.reshape(-1, 2 * width)
        base = np.arange(len(runs))[:, None]
        left, right = (runs[:, :width] + base * top).ravel(), (runs[:, width:] + base * top).ravel()
        total += int((np.searchsorted(right, left, "left") - np.repeat(np.arange(len(runs)) * width, width)).sum())
        ranks = np.sort(runs, axis=1).ravel()
        width *= 2
    return total


def pairs_of(*columns: np.ndarray) -> int:
    """Pairs of places with equal values in all columns."""
    n = np.unique(np.column_stack(columns), axis=0, return_counts=True)[1].astype(np.int64)
    return int((n * (n - 1) // 2).sum())


def sen_slope(x: np.ndarray, y: np.ndarray, direct: int = 1000) -> float:
    """Median of the slopes between places of different ``x``, which ascends.
    Beyond ``direct`` places it is halved in on by counting smaller slopes: those
    of pairs whose order turns when the slope is taken off."""
    n = len(x)
    if n <= direct:
        i, j = np.triu_indices(n, 1)
        apart = x[j] > x[i]
        return float(np.median((y[j] - y[i])[apart] / (x[j] - x[i])[apart])) if apart.any() else np.nan
    many = n * (n - 1) // 2 - pairs_of(x)
    if not many:
        return np.nan
    first = np.flatnonzero(np.diff(x, prepend=x[0] - 1))
    low, high = np.minimum.reduceat(y, first), np.maximum.reduceat(y, first)
    steps = np.diff(x[first])
    span = ((low[1:] - high[:-1]) / steps).min(), ((high[1:] - low[:-1]) / steps).max()

    def smaller(s: float) -> int:
        # Pairs of equal x ascend in y, so they never turn.
        rest = y - s * x
        return inversions(rest[np.lexsort((rest, x))])

    def nth(k: int) -> float:
        a, b = span
        for _ in range(100):
            middle = (a + b) / 2
            if not a < middle < b:
                break
            a, b = (a, middle) if smaller(middle) > k else (middle, b)
        return (a + b) / 2

    k = (many - 1) // 2
    return nth(k) if many % 2 else (nth(k) + nth(k + 1)) / 2


def mann_kendall(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """S, its z (no tie correction), and Theil-Sen's slope of each group. A series
    is one row and is counted by merging, n log n; pairs of equal ``x`` count
    neither in S nor among the slopes."""
    s = F.sort_array(F.collect_list(F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))))
    known = F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(F.col(y).cast("double"))
    rows = df.where(known).groupBy(*by).agg(s.alias("s")).select(*by, F.col("s.x").alias("_x"), F.col("s.y").alias("_y"))
    schema = T.StructType([*rows.select(*by).schema.fields, T.StructField("n", T.IntegerType()), *[T.StructField(c, T.DoubleType()) for c in ("S", "sen")]])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for a, b in zip(pdf["_x"], pdf["_y"], strict=True):
                a, b = np.asarray(a, float), np.asarray(b, float)
                untied = len(a) * (len(a) - 1) // 2 - pairs_of(a) - pairs_of(b) + pairs_of(a, b)
                out.append((len(a), float(untied - 2 * inversions(b)), sen_slope(a, b)))
            yield pdf.drop(columns=["_x", "_y"]).assign(n=[o[0] for o in out], S=[o[1] for o in out], sen=[o[2] for o in out])

    rows = rows.mapInPandas(count, schema)
    n = F.col("n").cast("double")
    var = n * (n - 1) * (2 * n + 5) / 18
    z = F.when(F.col("S") > 0, (F.col("S") - 1) / F.sqrt(var)).when(F.col("S") < 0, (F.col("S") + 1) / F.sqrt(var)).otherwise(0.0)
    return rows.select(*by, "n", "S", z.alias("z"), "sen")


def weighted_mean(x: str | Column, w: str | Column) -> Column:
    x, w = (F.col(c) if isinstance(c, str) else c for c in (x, w))
    known = x.isNotNull()
    return F.try_divide(F.sum(x * w), F.sum(F.when(known, w)))


def weighted_corr(df: DataFrame, by: Sequence[str], x: str, y: str, w: str, name: str) -> DataFrame:
    """Weighted correlation of each group. Values are taken from their weighted
    mean first: raw sums of products would cancel where means are large."""
    over = Window.partitionBy(*by)
    mean = lambda c: F.sum(F.col(c) * F.col(w)).over(over) / F.sum(w).over(over)
    rows = df.withColumns({"_dx": F.col(x) - mean(x), "_dy": F.col(y) - mean(y)})
    dot = lambda a, b: F.sum(F.col(a) * F.col(b) * F.col(w))
    return rows.groupBy(*by).agg(F.try_divide(dot("_dx", "_dy"), F.sqrt(dot("_dx", "_dx") * dot("_dy", "_dy"))).alias(name))


def average_rank(value: str, by: Sequence[str]) -> Column:
    w = Window.partitionBy(*by)
    return F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2


def weighted_quantile(df: DataFrame, by: Sequence[str], value: str, weight: str, q: float) -> DataFrame:
    """Linear interpolation of the value at ``q`` of the cumulative share of
    weight, the least value below the first share, the greatest above the last."""
    w = Window.partitionBy(*by).orderBy(value, weight)
    total = F.sum(weight).over(Window.partitionBy(*by))
    rows = df.where(F.col(value).isNotNull() & (F.col(weight) > 0)).withColumn("p", F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, 0)) / total)
    rows = rows.withColumns({"p0": F.lag("p").over(w), "v0": F.lag(value).over(w)})
    at = F.when(F.col("p0").isNull(), F.col(value)).otherwise(F.col("v0") + (F.col(value) - F.col("v0")) * F.try_divide(q - F.col("p0"), F.col("p") - F.col("p0")))
    inside = F.min_by(at, F.struct("p", value)).alias("_a")
    first = rows.where(F.col("p") >= q).groupBy(*by).agg(inside)
    last = rows.groupBy(*by).agg(F.max(value).alias("_b"))
    return last.join(first, list(by), "left").select(*by, F.coalesce("_a", "_b").alias("quantile"))


def gradient(value: str, coordinate: str, by: Sequence[str]) -> Column:
    """Second-order differences inside (unequal steps allowed), first-order at
    the ends, as np.gradient."""
    w = Window.partitionBy(*by).orderBy(coordinate)
    f0, f1, f2 = F.lag(value).over(w), F.col(value), F.lead(value).over(w)
    h1, h2 = F.col(coordinate) - F.lag(coordinate).over(w), F.lead(coordinate).over(w) - F.col(coordinate)
    inner = (h1 * h1 * f2 + (h2 * h2 - h1 * h1) * f1 - h2 * h2 * f0) / (h1 * h2 * (h1 + h2))
    return F.when(f0.isNull(), (f2 - f1) / h2).when(f2.isNull(), (f1 - f0) / h1).otherwise(inner)


def ols(df: DataFrame, by: Sequence[str], y: str, x1: str, x2: str) -> DataFrame:
    """Two-predictor least squares from covariances."""
    cov = lambda a, b: F.covar_pop(a, b)
    g = df.groupBy(*by).agg(cov(x1, x1).alias("a"), cov(x1, x2).alias("b"), cov(x2, x2).alias("d"), cov(x1, y).alias("p"), cov(x2, y).alias("q"), F.avg(y).alias("my"), F.avg(x1).alias("m1"), F.avg(x2).alias("m2"))
    det = F.col("a") * F.col("d") - F.col("b") * F.col("b")
    b1, b2 = F.try_divide(F.col("p") * F.col("d") - F.col("q") * F.col("b"), det), F.try_divide(F.col("q") * F.col("a") - F.col("p") * F.col("b"), det)
    return g.select(*by, b1.alias("b1"), b2.alias("b2"), (F.col("my") - b1 * F.col("m1") - b2 * F.col("m2")).alias("b0"))
