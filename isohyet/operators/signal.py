"""Whole-series kernels of one entity at a time, in numpy.

Recursive filters and transforms need a complete, ordered series; each entity's
is one group of ``applyInPandas``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def butterworth(order: int, low: float | None, high: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of a pass between cut-offs in units of the Nyquist frequency;
    without ``low`` all slower waves pass, without ``high`` all faster ones.
    Analogue low-pass poles, moved to the band, through the bilinear transform."""
    if low is None and high is None:
        raise ValueError("a filter needs a cut-off")
    k = np.arange(1, order + 1)
    poles = np.exp(1j * np.pi * (2 * k + order - 1) / (2 * order))
    w1, w2 = (4 * np.tan(np.pi * w / 2) if w is not None else None for w in (low, high))
    if low is None:
        poles, gain, zeros = poles * w2, w2**order, -np.ones(order)
    elif high is None:
        poles, gain, zeros = w1 / poles, 4.0**order, np.ones(order)
    else:
        width, centre = w2 - w1, np.sqrt(w1 * w2)
        half = poles * width / 2
        poles = np.concatenate([half + np.sqrt(half**2 - centre**2), half - np.sqrt(half**2 - centre**2)])
        gain, zeros = (4 * width) ** order, np.concatenate([np.ones(order), -np.ones(order)])
    return np.real(gain / np.prod(4 - poles)) * np.poly(zeros), np.real(np.poly((4 + poles) / (4 - poles)))


@lru_cache(maxsize=8)
def blocks(b: tuple[float, ...], a: tuple[float, ...], size: int) -> tuple[np.ndarray, ...]:
    """What a filter makes of ``size`` samples and of its state, as matrices: the
    output from both, and the next state from both."""
    n, wide = len(a) - 1, size + len(a) - 1
    unit, z = np.eye(wide), np.zeros((n + 1, wide))
    z[:n] = unit[size:]
    y = np.empty((size, wide))
    for i in range(size):
        y[i] = b[0] * unit[i] + z[0]
        z[:-1] = z[1:] + np.outer(b[1:], unit[i]) - np.outer(a[1:], y[i])
    return y[:, :size], y[:, size:], z[:n, :size], z[:n, size:]


def lfilter(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray, size: int = 64) -> np.ndarray:
    """Direct form II transposed, from an initial state, ``size`` samples a step."""
    y, z = np.empty(len(x)), state
    for at in range(0, len(x), size):
        part = x[at : at + size]
        from_x, from_z, next_x, next_z = blocks(tuple(b), tuple(a), len(part))
        y[at : at + size] = from_x @ part + from_z @ z
        z = next_x @ part + next_z @ z
    return y


def resting(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The state that an endless series of ones leaves."""
    n = len(a) - 1
    m = np.eye(n) - np.column_stack([-a[1:], np.vstack([np.eye(n - 1), np.zeros(n - 1)])])
    return np.linalg.solve(m, b[1:] - a[1:] * b[0])


def filtfilt(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forward and backward, with odd extensions at both ends."""
    pad = 3 * max(len(a), len(b))
    if len(x) <= pad:
        return np.full(len(x), np.nan)
    start = resting(b, a)
    ext = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    y = lfilter(b, a, ext, start * ext[0])[::-1]
    return lfilter(b, a, y, start * y[0])[::-1][pad:-pad]


def harmonics(df: DataFrame, by: Sequence[str], position: str, value: str, k: int, name: str) -> DataFrame:
    """The mean and the first ``k`` harmonics of each group, as a new column.

    ``position`` counts the evenly spaced rows of a group. The coefficients are
    sums, so a long series, or many, is one grouping and never a task's own; nulls
    add nothing to them. Groups with a null key have none.
    """
    n = df.groupBy(*by).agg(F.count("*").alias("_n"))
    rows = df.join(n, list(by))
    turn = lambda j: 2 * math.pi * ((F.col(position) * j) % F.col("_n")) / F.col("_n")
    v = F.col(value).cast("double")
    sums = [F.sum(v * f(turn(j))).alias(f"_{c}{j}") for j in range(1, k + 1) for c, f in (("c", F.cos), ("s", F.sin))]
    waves = rows.groupBy(*by).agg(F.avg(v).alias("_mean"), *sums)
    # The fastest wave is counted once, those beyond it not at all.
    share = lambda j: F.when(F.col("_n") > 2 * j, 2 / F.col("_n")).when(F.col("_n") == 2 * j, 1 / F.col("_n")).otherwise(0.0)
    fit = sum(((F.col(f"_c{j}") * F.cos(turn(j)) + F.col(f"_s{j}") * F.sin(turn(j))) * share(j) for j in range(1, k + 1)), F.col("_mean"))
    return rows.join(waves, list(by)).select(*df.columns, fit.alias(name))


def per_series(df: DataFrame, by: Sequence[str], order: str, value: str, name: str | Sequence[str], fn: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``fn`` of every entity's ordered values, as a new column, or as several of
    a matrix's columns where ``name`` has several."""
    names = [name] if isinstance(name, str) else list(name)
    schema = df.select(*by, order, value).schema
    for c in names:
        schema = schema.add(c, "double")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        found = np.asarray(fn(pdf[value].to_numpy(float))).reshape(len(pdf), len(names))
        return pdf.assign(**{c: found[:, i] for i, c in enumerate(names)})

    return df.select(*by, order, value).groupBy(*by).applyInPandas(one, schema)


def spectrum(df: DataFrame, by: Sequence[str], order: str, value: str) -> DataFrame:
    """Power by frequency of each detrended, cosine-tapered series."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(order)[value].to_numpy(float)
        n, t = len(x), np.arange(len(x))
        if n < 4:
            return pd.DataFrame(columns=[*by, "frequency", "power"])
        x = x - np.polyval(np.polyfit(t, x, 1), t)
        taper = np.ones(n)
        m = max(1, n // 20)
        taper[:m] = 0.5 * (1 - np.cos(np.pi * (np.arange(m) + 0.5) / m))
        taper[-m:] = taper[:m][::-1]
        f = np.abs(np.fft.rfft(x * taper)) ** 2 / n
        return pd.DataFrame({**{c: pdf[c].iloc[0] for c in by}, "frequency": np.fft.rfftfreq(n)[1:], "power": f[1:]})

    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*by).schema)
    return df.groupBy(*by).applyInPandas(one, f"{keys}, frequency double, power double")
