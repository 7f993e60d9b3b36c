"""Limits of estimates: resampling, spectra against red noise, correlations at
lags and of weighted fields."""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared


def normal_cdf(x: Column) -> Column:
    """Normal distribution function, to 1.5e-7, by a rational approximation of
    the error function."""
    z = F.abs(x) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * z)
    series = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    tail = series * F.exp(-z * z) / 2
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def draw(k: Column, b: Column, n: Column) -> Column:
    """The row, 0 to ``n`` - 1, that place ``k`` of sample ``b`` takes: by a hash,
    so that samples repeat on any machine, in any split."""
    digest = F.substring(F.md5(F.concat_ws(":", b, k)), 1, 8)
    return F.pmod(F.conv(digest, 16, 10).cast("long"), n)


def bca(df: DataFrame, by: Sequence[str], order: Sequence[str], statistic: Column, draws: int = 200, level: float = 0.95, blocks: int = 100) -> DataFrame:
    """Bias-corrected and accelerated bootstrap interval of any ``statistic`` (an
    aggregate over the columns of ``df``) of each group: estimate, low, high, and
    the bias and acceleration.

    Rows are resampled as a whole, ``draws`` times; the statistic of all samples
    of all groups is one grouping. The acceleration is from a jackknife that
    leaves out one row at a time, or one of ``blocks`` parts where a group has
    more rows; so the work is linear in the rows. A group of one row, or one whose
    statistic does not vary, has null limits."""
    w = Window.partitionBy(*by)
    rows = shared(df.withColumns({"_at": F.row_number().over(w.orderBy(*order)) - 1, "_n": F.count("*").over(w)}))
    whole = rows.groupBy(*by).agg(statistic.alias("estimate"), F.max("_n").alias("_n"))
    places = whole.select(*by, "_n", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("_b"), F.sequence(F.lit(0).cast("long"), F.col("_n") - 1).alias("_k"))
    places = places.select(*by, "_b", F.explode("_k").alias("_k"), "_n").select(*by, "_b", draw(F.col("_k"), F.col("_b"), F.col("_n")).alias("_at"))
    stars = places.join(rows.drop("_n"), [*by, "_at"]).groupBy(*by, "_b").agg(statistic.alias("_star"))
    stars = stars.join(whole.select(*by, "estimate"), list(by)).groupBy(*by).agg(
        F.sort_array(F.collect_list("_star")).alias("_stars"),  # one number a draw
        F.sum(F.when(F.col("_star") < F.col("estimate"), 2).when(F.col("_star") == F.col("estimate"), 1).otherwise(0)).alias("_below"),
    )
    parts = F.least(F.col("_n"), F.lit(blocks))
    left = rows.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).where(F.col("_part") != F.col("_at") % parts)
    left = left.groupBy(*by, "_part").agg(statistic.alias("_without"))
    gap = F.avg("_without").over(w) - F.col("_without")
    skew = left.withColumn("_gap", gap).groupBy(*by).agg(F.try_divide(F.sum(F.pow("_gap", F.lit(3))), 6 * F.pow(F.sum(F.pow("_gap", F.lit(2))), F.lit(1.5))).alias("acceleration"))
    # The bias depends on a count of 0 to 2 * draws only.
    table = F.array(*[F.lit(NormalDist().inv_cdf(k / (2 * draws))) if 0 < k < 2 * draws else F.lit(None).cast("double") for k in range(2 * draws + 1)])
    out = whole.join(stars, list(by)).join(skew, list(by)).withColumn("bias", F.get(table, F.col("_below").cast("int")))
    bound = {}
    for name, q in (("low", (1 - level) / 2), ("high", (1 + level) / 2)):
        z = F.col("bias") + NormalDist().inv_cdf(q)
        place = normal_cdf(F.col("bias") + F.try_divide(z, 1 - F.col("acceleration") * z)) * (draws - 1)
        under = F.floor(place).cast("int")
        a, b = F.get("_stars", under), F.get("_stars", F.least(under + 1, F.lit(draws - 1)))
        bound[name] = a + (b - a) * (place - under)
    return out.select(*by, "estimate", *[x.alias(k) for k, x in bound.items()], "bias", "acceleration")


def chi_square_cdf(x: float, df: float) -> float:
    """By the series of the lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, z, term, total, k = df / 2, x / 2, 1.0, 1.0, 0
    while term > 1e-17 * total and k < 10_000:
        k += 1
        term *= z / (a + k)
        total += term
    return min(1.0, math.exp(a * math.log(z) - z - math.lgamma(a + 1)) * total)


def chi_square_quantile(q: float, df: float) -> float:
    low, high = 0.0, df + 20 * math.sqrt(2 * df) + 50
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_cdf(mid, df) < q else (low, mid)
    return (low + high) / 2


def daniell(smooth: int) -> np.ndarray:
    """Weights of a running mean of ``smooth`` (odd) places, half at its ends."""
    if smooth < 3:
        return np.ones(1)
    w = np.full(smooth, 1.0 / (smooth - 1))
    w[[0, -1]] /= 2
    return w


def spectrum_freedom(smooth: int, taper: float) -> float:
    """Degrees of freedom of a tapered, smoothed spectrum."""
    loss = 0.5 * (128 - 93 * taper) / (8 - 5 * taper) ** 2
    return 2 / (loss * float((daniell(smooth) ** 2).sum()))


def tapered(x: np.ndarray, share: float) -> np.ndarray:
    """Split cosine bell over ``share`` of the series, half at each end."""
    m = int(share * len(x) / 2 + 0.5)
    w = np.ones(len(x))
    bell = 0.5 * (1 - np.cos(np.pi * (np.arange(m) + 0.5) / max(m, 1)))
    w[:m] *= bell
    w[len(x) - m :] *= bell[::-1]
    return x * w


def red_noise_spectrum(df: DataFrame, by: Sequence[str], order: str, value: str, smooth: int = 9, taper: float = 0.1, detrend: bool = False, limits: tuple[float, float] = (0.05, 0.95)) -> DataFrame:
    """Spectrum of each group's complete, evenly spaced series, and the red noise
    of its lag-one correlation with limits: k, frequency, power, red, low, high.

    The series without its mean (or line) is tapered, its periodogram smoothed by
    a modified Daniell window, mirrored at its ends, and scaled so that the area
    under it is the variance. The red curve has the same sum; the limits are its
    product with chi-square quantiles over the degrees of freedom. A series that
    is shorter than the window, or constant, has no rows. One task a series."""
    n_free = spectrum_freedom(smooth, taper)
    low, high = (chi_square_quantile(q, n_free) / n_free for q in limits)
    weights, names = daniell(smooth), list(by)
    half = len(weights) // 2

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(order)[value].to_numpy(float)
        n, empty = len(x), pd.DataFrame(columns=[*names, "k", "frequency", "power", "red", "low", "high"])
        if n // 2 < smooth or not np.isfinite(x).all():
            return empty
        t = np.arange(n) - (n - 1) / 2
        x = x - x.mean()
        x = x - t * (t @ x) / (t @ t) if detrend else x
        variance = (x * x).mean()
        if variance == 0:
            return empty
        lag = (x[1:] @ x[:-1]) / (x @ x)
        power = np.abs(np.fft.rfft(tapered(x, taper))[1:]) ** 2
        power = np.convolve(np.pad(power, half, mode="symmetric"), weights, "valid")
        ends = np.ones(len(power))
        ends[[0, -1]] = 0.5
        power *= variance / ((power * ends).sum() / n)
        f = np.arange(1, len(power) + 1) / n
        red = 1 / (1 + lag * lag - 2 * lag * np.cos(2 * np.pi * f))
        red *= power.sum() / red.sum()
        out = pd.DataFrame({"k": np.arange(1, len(power) + 1), "frequency": f, "power": power, "red": red, "low": red * low, "high": red * high})
        for c in names:
            out[c] = pdf[c].iloc[0]
        return out[empty.columns]

    schema = T.StructType([*df.select(*by).schema.fields, T.StructField("k", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in ("frequency", "power", "red", "low", "high")]])
    return df.groupBy(*by).applyInPandas(each, schema)


def lead_lag(cells: DataFrame, index: DataFrame, by: Sequence[str], time: str, value: str, series: str, most: int) -> DataFrame:
    """Correlation of each cell's ``value`` with the index ``series`` ``lag`` steps
    of the integer ``time`` later, -most to most, for all cells and lags in one
    grouping: lag, n, r, and the effective number of samples and t of *that* lag,
    by both autocorrelations there. The index has a row a step."""

    def own(rows: DataFrame, keys: Sequence[str], c: str, name: str) -> DataFrame:
        """Autocorrelation at 0 to ``most`` steps, over the sum of squares."""
        x = rows.withColumn("_d", F.col(c) - F.avg(c).over(Window.partitionBy(*keys)))
        later = x.select(*keys, F.col(time).alias("_t"), F.col("_d").alias("_e"))
        pairs = x.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(most)))).withColumn("_t", F.col(time) + F.col("_k")).join(later, [*keys, "_t"])
        sums = pairs.groupBy(*keys, "_k").agg(F.sum(F.col("_d") * F.col("_e")).alias("_s"))
        total = F.max(F.when(F.col("_k") == 0, F.col("_s"))).over(Window.partitionBy(*keys))
        return sums.select(*keys, "_k", F.try_divide("_s", total).alias(name))

    lags = cells.withColumn("lag", F.explode(F.sequence(F.lit(-most), F.lit(most)))).withColumn("_t", F.col(time) + F.col("lag"))
    pairs = lags.join(index.select(F.col(time).alias("_t"), series), "_t")
    out = pairs.groupBy(*by, "lag").agg(F.count("*").alias("n"), F.corr(value, series).alias("r")).withColumn("_k", F.abs("lag"))
    one = index.select(time, series).withColumn("_all", F.lit(1))
    out = out.join(own(cells, by, value, "_a"), [*by, "_k"]).join(own(one, ["_all"], series, "_b").drop("_all"), "_k")
    both = F.col("_a") * F.col("_b")
    # At no lag both are 1: then all samples count.
    out = out.withColumn("effective_n", F.when(F.col("lag") == 0, F.col("n")).otherwise(F.try_divide(F.col("n") * (1 - both), 1 + both)))
    t = F.col("r") * F.sqrt(F.try_divide(F.greatest(F.col("effective_n") - 2, F.lit(0.0)), 1 - F.col("r") * F.col("r")))
    z = F.abs(F.atanh(F.col("r"))) * F.sqrt(F.greatest(F.col("n") - 3, F.lit(0)))
    return out.select(*by, "lag", "n", "r", "effective_n", t.alias("t"), (2 * (1 - normal_cdf(z))).alias("p"))


def weighted_pearson(df: DataFrame, by: Sequence[str], x: str, y: str, weight: str, level: float = 0.95) -> DataFrame:
    """Weighted correlation of two fields about their weighted means, the ratio of
    their amplitudes (y over x), Kish's effective number of cells, and Fisher's
    interval. Cells without both values or a positive weight take no part."""
    ok = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & (F.col(weight) > 0))
    w = Window.partitionBy(*by)
    mean = lambda c: F.sum(F.col(weight) * F.col(c)).over(w) / F.sum(weight).over(w)
    rows = ok.withColumns({"_x": F.col(x) - mean(x), "_y": F.col(y) - mean(y)})
    moment = lambda a, b: F.sum(F.col(weight) * F.col(a) * F.col(b))
    g = rows.groupBy(*by).agg(moment("_x", "_x").alias("_xx"), moment("_y", "_y").alias("_yy"), moment("_x", "_y").alias("_xy"), (F.pow(F.sum(weight), F.lit(2)) / F.sum(F.pow(weight, F.lit(2)))).alias("effective_n"))
    g = g.withColumns({"r": F.try_divide("_xy", F.sqrt(F.col("_xx") * F.col("_yy"))), "amplitude_ratio": F.sqrt(F.try_divide("_yy", "_xx"))})
    z = F.atanh(F.greatest(F.least(F.col("r"), F.lit(0.999999)), F.lit(-0.999999)))
    reach = NormalDist().inv_cdf((1 + level) / 2) / F.sqrt(F.greatest(F.col("effective_n") - 3, F.lit(1.0)))
    return g.select(*by, "r", "amplitude_ratio", "effective_n", F.tanh(z - reach).alias("low"), F.tanh(z + reach).alias("high"))
