"""Intervals, spectra and lagged correlations against numpy and known values."""

from __future__ import annotations

import hashlib
import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from isohyet.operators import inference as inf


def test_chi_square_and_normal(spark):
    # Percentage points as printed in tables.
    for q, df, want in ((0.95, 10, 18.307), (0.05, 10, 3.940), (0.95, 2, 5.991), (0.975, 100, 129.561), (0.5, 1, 0.455)):
        assert inf.chi_square_quantile(q, df) == pytest.approx(want, abs=6e-4)
    xs = [-6.0, -1.96, -0.3, 0.0, 1e-9, 0.7, 2.5, 8.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(inf.normal_cdf(F.col("x"))).collect()
    for x, (p,) in zip(xs, got, strict=True):
        assert p == pytest.approx(0.5 * math.erfc(-x / math.sqrt(2)), abs=2e-7)


def brute_bca(x, fn, draws, level, blocks):
    n = len(x)
    at = lambda b, k: int(hashlib.md5(f"{b}:{k}".encode()).hexdigest()[:8], 16) % n
    estimate = fn(x)
    stars = np.array([fn(x[[at(b, k) for k in range(n)]]) for b in range(draws)])
    z0 = NormalDist().inv_cdf(((stars < estimate).sum() + 0.5 * (stars == estimate).sum()) / draws)
    parts = min(n, blocks)
    left = np.array([fn(x[np.arange(n) % parts != p]) for p in range(parts)])
    d = left.mean() - left
    a = (d**3).sum() / (6 * (d**2).sum() ** 1.5)
    out = []
    for q in ((1 - level) / 2, (1 + level) / 2):
        z = z0 + NormalDist().inv_cdf(q)
        out.append(np.quantile(stars, NormalDist().cdf(z0 + z / (1 - a * z))))
    return estimate, *out, z0, a


@pytest.mark.parametrize("blocks", [100, 7])
def test_bca_by_brute_force(spark, blocks):
    rng = np.random.default_rng(1)
    series = {"skewed": rng.exponential(size=30), "even": rng.normal(size=21)}
    df = spark.createDataFrame([(g, i, float(v)) for g, x in series.items() for i, v in enumerate(x)] + [("lone", 0, 1.0)], "g string, i int, v double").repartition(3)
    for statistic, fn in ((F.avg("v"), np.mean), (F.stddev_samp("v"), lambda x: x.std(ddof=1))):
        got = {r["g"]: r for r in inf.bca(df, ["g"], ["i"], statistic, 90, 0.9, blocks).collect()}
        for g, x in series.items():
            r = got[g]
            assert [r[c] for c in ("estimate", "low", "high", "bias", "acceleration")] == pytest.approx(brute_bca(x, fn, 90, 0.9, blocks), rel=1e-4)
            assert r["low"] < r["estimate"] < r["high"]
        assert "lone" not in got or got["lone"]["low"] is None


def test_spectrum_limits(spark):
    """A wave stands out of its noise; of red noise alone about a tenth of the
    places are outside limits of a tenth; the area is the variance."""
    rng = np.random.default_rng(2)
    n = 400
    red = np.zeros(n)
    for i in range(1, n):
        red[i] = 0.6 * red[i - 1] + rng.normal()
    wave = red + 1.5 * np.cos(2 * np.pi * 50 * np.arange(n) / n)
    rows = [(g, i, float(v)) for g, x in (("red", red), ("wave", wave), ("short", red[:9]), ("flat", np.ones(50))) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "g string, i int, v double")
    got = inf.red_noise_spectrum(df, ["g"], "i", "v", 7, 0.1).toPandas().sort_values(["g", "k"])
    assert set(got["g"]) == {"red", "wave"} and (got.groupby("g").size() == n // 2).all()
    for g, x in (("red", red), ("wave", wave)):
        s = got[got["g"] == g]
        ends = np.ones(len(s))
        ends[[0, -1]] = 0.5
        assert (s["power"] * ends).sum() / n == pytest.approx(x.var())
        assert s["red"].sum() == pytest.approx(s["power"].sum())
    wave_at = got[(got["g"] == "wave") & (got["k"] == 50)].iloc[0]
    assert wave_at["power"] > 2 * wave_at["high"]
    alone = got[got["g"] == "red"]
    assert 0.02 < ((alone["power"] < alone["low"]) | (alone["power"] > alone["high"])).mean() < 0.25
    # As many degrees of freedom as the window has places, less the taper's loss.
    assert inf.spectrum_freedom(7, 0.0) == pytest.approx(2 / (5 / 36 + 2 / 144))
    assert inf.spectrum_freedom(7, 0.1) < inf.spectrum_freedom(7, 0.0)


def test_lead_lag_finds_the_shift(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=90)
    cells = [(c, t, float(x[t + 3] if c == 1 else rng.normal())) for c in (1, 2) for t in range(87)]
    df = spark.createDataFrame(cells, "c int, t int, v double")
    index = spark.createDataFrame([(t, float(v)) for t, v in enumerate(x)], "t int, s double")
    got = {(r["c"], r["lag"]): r for r in inf.lead_lag(df, index, ["c"], "t", "v", "s", 4).collect()}
    assert len(got) == 18 and max(got, key=lambda k: got[k]["r"] or 0) == (1, 3)
    assert got[1, 3]["n"] == 87 and got[1, -4]["n"] == 83 and got[1, 3]["p"] < 1e-6 < got[2, 0]["p"]
    a = x[3:] - x[3:].mean()
    acf = (a[:-2] @ a[2:]) / (a @ a)
    b = x - x.mean()
    both = acf * (b[:-2] @ b[2:]) / (b @ b)
    assert got[1, 2]["effective_n"] == pytest.approx(got[1, 2]["n"] * (1 - both) / (1 + both))
    assert got[1, 2]["r"] == pytest.approx(np.corrcoef(x[3:], x[2:-1])[0, 1])


def test_weighted_pearson(spark):
    rng = np.random.default_rng(4)
    x, w = rng.normal(size=40), rng.uniform(0.1, 1, 40)
    y = 2 * x + rng.normal(size=40)
    rows = [(1, float(a), float(b), float(c)) for a, b, c in zip(x, y, w, strict=True)] + [(1, None, 9.0, 1.0), (1, 5.0, 5.0, 0.0)]
    r = inf.weighted_pearson(spark.createDataFrame(rows, "g int, x double, y double, w double"), ["g"], "x", "y", "w").first()
    c = np.cov(x, y, aweights=w, ddof=0)
    want = c[0, 1] / math.sqrt(c[0, 0] * c[1, 1])
    n = w.sum() ** 2 / (w**2).sum()
    assert r["r"] == pytest.approx(want) and r["amplitude_ratio"] == pytest.approx(math.sqrt(c[1, 1] / c[0, 0])) and r["effective_n"] == pytest.approx(n)
    assert r["low"] == pytest.approx(math.tanh(math.atanh(want) - 1.959963985 / math.sqrt(n - 3)))
