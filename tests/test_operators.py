"""Operators against pandas, numpy and hand-made cases."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from isohyet.functions import air
from isohyet.operators import backtest, frames, joins, learning, market, physics, signal, sphere, statistics
from isohyet.operators.windows import Ordered, ewm, interpolated, islands, merged_intervals, rank_of_last, ranked_last, ranked_pct

S = Ordered(["k"], ["t"])


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"k": np.repeat(["a", "b"], 40), "t": np.tile(np.arange(40), 2), "v": rng.normal(size=80).round(3)})
    pdf.loc[[3, 4, 5, 20, 41, 79], "v"] = np.nan
    rows = [(k, int(t), None if v != v else float(v)) for k, t, v in pdf.itertuples(index=False)]
    return pdf, spark.createDataFrame(rows, "k string, t int, v double")


def same(df, pdf, column, want):
    got = df.toPandas().sort_values(["k", "t"])[column].to_numpy(float)
    np.testing.assert_allclose(got, np.asarray(want, float), rtol=1e-9, atol=1e-12)


def by_key(pdf, fn):
    return np.concatenate([fn(g["v"]).to_numpy(float) for _, g in pdf.groupby("k")])


def test_rolling_as_pandas(series):
    pdf, df = series
    same(df.withColumn("x", S.mean("v", 5)), pdf, "x", by_key(pdf, lambda v: v.rolling(5).mean()))
    same(df.withColumn("x", S.mean("v", 5, 2)), pdf, "x", by_key(pdf, lambda v: v.rolling(5, min_periods=2).mean()))
    same(df.withColumn("x", S.std("v", 6, 3)), pdf, "x", by_key(pdf, lambda v: v.rolling(6, min_periods=3).std()))
    same(df.withColumn("x", S.centred_mean("v", 4, 1)), pdf, "x", by_key(pdf, lambda v: v.rolling(4, min_periods=1, center=True).mean()))


def test_fills_as_pandas(series):
    pdf, df = series
    same(df.withColumn("x", S.ffill("v")), pdf, "x", by_key(pdf, lambda v: v.ffill()))
    same(interpolated(df, ["k"], "t", "v", "x"), pdf, "x", by_key(pdf, lambda v: v.interpolate(limit_area="inside")))
    same(interpolated(df, ["k"], "t", "v", "x", limit=1), pdf, "x", by_key(pdf, lambda v: v.interpolate(limit=1, limit_area="inside")))


def test_ewm_and_rank_as_pandas(series):
    pdf, df = series
    same(ewm(df, ["k"], ["t"], "v", 0.2, "x", 3), pdf, "x", by_key(pdf, lambda v: v.ewm(alpha=0.2, adjust=False, ignore_na=True, min_periods=3).mean().where(v.notna() | v.notna().cumsum().ge(3))))
    same(ranked_pct(df, ["k"], "v", "x"), pdf, "x", by_key(pdf, lambda v: v.rank(pct=True, na_option="bottom")))


def test_rank_of_last(series):
    pdf, df = series

    def last(x):
        x = x[~np.isnan(x)]
        return pd.Series(x).rank(pct=True).iloc[-1] if len(x) >= 4 else np.nan

    same(ranked_last(df, ["k"], ["t"], [("x", "v", 8, 4)]), pdf, "x", by_key(pdf, lambda v: v.rolling(8, min_periods=1).apply(last, raw=True)))
    x = np.random.default_rng(1).integers(0, 9, 300).astype(float)
    for n, block in ((1, 7), (5, 7), (400, 64)):
        want = pd.Series(x).rolling(n, min_periods=1).rank(pct=True).to_numpy()
        assert np.allclose(rank_of_last(x, n, 1, block), want)
    assert len(rank_of_last(np.empty(0), 5, 1)) == 0


def test_mann_kendall_by_all_pairs(spark):
    rng = np.random.default_rng(2)
    rows = []
    for g, n, levels in (("one", 1, 9), ("two", 2, 9), ("ties", 40, 3), ("flat", 10, 1), ("odd", 33, 1000), ("same", 6, 50)):
        x = np.zeros(n) if g == "same" else rng.integers(0, 30, n) if g == "ties" else rng.permutation(n)
        rows += [(g, int(a), float(b)) for a, b in zip(x, rng.integers(0, levels, n), strict=True)]
    df = spark.createDataFrame([*rows, ("odd", 99, None), ("odd", None, 1.0), ("odd", 98, float("nan"))], "g string, x int, y double").repartition(4)
    got = {r["g"]: r for r in statistics.mann_kendall(df, ["g"], "x", "y").collect()}
    for g in {r[0] for r in rows}:
        p = [(a, b) for k, a, b in rows if k == g]
        s = sum(np.sign(c - a) * np.sign(d - b) for i, (a, b) in enumerate(p) for c, d in p[:i])
        k = [(d - b) / (c - a) for i, (a, b) in enumerate(p) for c, d in p[:i] if c != a]
        assert (got[g]["n"], got[g]["S"]) == (len(p), s)
        assert got[g]["sen"] == (pytest.approx(np.median(k)) if k else None)
    assert statistics.mann_kendall(df.where("false"), ["g"], "x", "y").count() == 0


def test_sen_slope_by_counting():
    rng = np.random.default_rng(3)
    for n, ties in ((2, False), (31, False), (40, True), (120, False)):
        x = np.sort(rng.integers(0, n // 2, n).astype(float)) if ties else np.arange(n, dtype=float)
        y = 0.3 * x + rng.normal(size=n).round(1 if ties else 9)
        y = y[np.lexsort((y, x))]
        assert statistics.sen_slope(x, y, direct=1) == pytest.approx(statistics.sen_slope(x, y), rel=1e-9, abs=1e-12)
    long = np.arange(20000.0)
    assert statistics.sen_slope(long, 2 * long + rng.normal(size=20000)) == pytest.approx(2, abs=1e-3)
    falls = rng.integers(0, 50, 500)
    assert statistics.inversions(falls) == sum(int((falls[i] > falls[i + 1 :]).sum()) for i in range(500))


def test_runs_and_intervals(spark):
    df = spark.createDataFrame([("a", i, i in (1, 2, 3, 6)) for i in range(8)], "k string, t int, f boolean")
    assert [tuple(r) for r in islands(df, ["k"], "t", "f").orderBy("start").collect()] == [("a", 1, 3, 3), ("a", 6, 6, 1)]
    assert islands(df, ["k"], "t", "f", 3).count() == 1
    iv = spark.createDataFrame([("a", 1, 4), ("a", 2, 3), ("a", 4, 5), ("a", 7, 9)], "k string, s int, e int")
    assert [tuple(r) for r in merged_intervals(iv, ["k"], "s", "e").orderBy("s").collect()] == [("a", 1, 5, 3), ("a", 7, 9, 1)]


def test_asof_at_equal_times(spark):
    left = spark.createDataFrame([("a", 1), ("a", 5), ("b", 5)], "k string, t int")
    right = spark.createDataFrame([("a", 1, 10), ("a", 5, 50)], "k string, t int, v int")
    run = lambda *a, **b: {(r.k, r.t): r.v for r in joins.asof(left, right, ["k"], "t", ["v"], *a, **b).collect()}
    assert run() == {("a", 1): 10, ("a", 5): 50, ("b", 5): None}
    assert run(strict=True) == {("a", 1): None, ("a", 5): 10, ("b", 5): None}
    assert run("forward", strict=True) == {("a", 1): 50, ("a", 5): None, ("b", 5): None}


def test_geometry(spark):
    p = spark.createDataFrame([(0.0, 179.0), (0.0, -179.0), (0.0, 10.0)], "lat double, lon double")
    assert [r[0] for r in p.select(joins.in_box(F.col("lat"), F.col("lon"), -1, 1, 170, -170)).collect()] == [True, True, False]
    assert p.select(joins.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0))).first()[0] == pytest.approx(math.pi / 2 * joins.EARTH_KM)
    ring = [(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)]
    q = spark.createDataFrame([(1.0, 1.0), (3.0, 2.0)], "lat double, lon double")
    assert [r[0] for r in q.select(joins.in_ring(F.col("lat"), F.col("lon"), ring)).collect()] == [True, False]


def test_gradient_as_numpy(spark):
    x, y = [0.0, 1.0, 3.0, 4.0, 8.0], [1.0, 2.0, 0.0, 5.0, 3.0]
    df = spark.createDataFrame([("a", a, b) for a, b in zip(x, y)], "k string, x double, y double")
    got = [r[0] for r in df.withColumn("g", statistics.gradient("y", "x", ["k"])).orderBy("x").select("g").collect()]
    np.testing.assert_allclose(got, np.gradient(y, x))


def test_tail_probabilities():
    # Known quantiles of Student's t.
    p = lambda t, n: float(statistics.beta_inc(np.array([n / 2]), 0.5, np.array([n / (n + t * t)]))[0])
    assert p(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert p(12.706205, 1) == pytest.approx(0.05, abs=1e-6)
    assert p(1.959964, 1e7) == pytest.approx(0.05, abs=1e-5)
    assert p(0.0, 5) == pytest.approx(1.0)


def test_butterworth_response():
    b, a = signal.butterworth(3, 0.1, 0.25)
    gain = lambda w: abs(np.polyval(b, np.exp(1j * np.pi * w)) / np.polyval(a, np.exp(1j * np.pi * w)))
    assert gain(0.1) == pytest.approx(2**-0.5, rel=1e-6) and gain(0.25) == pytest.approx(2**-0.5, rel=1e-6)
    assert gain(0.16) == pytest.approx(1, rel=1e-2) and gain(0.01) < 1e-3 and gain(0.9) < 1e-3
    t = np.arange(400)
    wave = np.sin(np.pi * 0.16 * t)
    y = signal.filtfilt(b, a, wave + 5 + 0.01 * t)
    assert np.abs(y - wave)[100:300].max() < 0.05
    x = np.random.default_rng(0).normal(size=150)
    for n in (1, 7, 64, 150):
        z = np.linspace(-1, 1, 6)
        assert np.allclose(signal.lfilter(b, a, x[:n], z), signal.lfilter(b, a, x[:n], z, size=1))


def test_low_and_high_pass():
    for low, high in ((None, 0.2), (0.2, None)):
        b, a = signal.butterworth(4, low, high)
        gain = lambda w: abs(np.polyval(b, np.exp(1j * np.pi * w)) / np.polyval(a, np.exp(1j * np.pi * w)))  # noqa: B023, E731
        assert gain(0.2) == pytest.approx(2**-0.5, rel=1e-6)
        assert (gain(0.0), gain(1.0)) == pytest.approx((1, 0) if low is None else (0, 1), abs=1e-6)
    with pytest.raises(ValueError):
        signal.butterworth(4, None, None)


def test_resampled(spark):
    rows = [("a", 10.0, 1.0), ("a", 30.0, 5.0), ("a", 30.0, 7.0), ("a", 350.0, 3.0), ("a", None, 9.0), ("a", 20.0, None), ("one", 5.0, 2.0), ("none", 1.0, None)]
    df = spark.createDataFrame(rows, "k string, x double, v double")
    at = [0.0, 10.0, 20.0, 190.0, 355.0]
    for period in (None, 360.0):
        got = {(r["k"], r["x"]): r["v"] for r in sphere.resampled(df, "x", at, "v", ["k"], period).collect()}
        assert len(got) == 10
        for t in at:
            assert got["a", t] == pytest.approx(np.interp(t, [10, 30, 350], [1, 6, 3], period=period)) and got["one", t] == 2
    assert sphere.resampled(df.where("false"), "x", at, "v", ["k"]).count() == 0


def test_harmonics(spark):
    rng = np.random.default_rng(5)
    series = {"even": rng.normal(size=12), "odd": rng.normal(size=9), "short": rng.normal(size=3), "one": np.array([2.0])}
    df = spark.createDataFrame([(g, i, float(v)) for g, x in series.items() for i, v in enumerate(x)] + [("gap", 0, 1.0), ("gap", 1, None)], "g string, i int, v double").repartition(3)
    got = signal.harmonics(df, ["g"], "i", "v", 3, "fit")
    assert got.columns == [*df.columns, "fit"] and got.count() == df.count()
    pdf = got.toPandas().sort_values(["g", "i"])
    for g, x in series.items():
        f = np.fft.rfft(x)
        f[4:] = 0
        assert pdf[pdf["g"] == g]["fit"].to_numpy() == pytest.approx(np.fft.irfft(f, len(x)))
    assert signal.harmonics(df.where("false"), ["g"], "i", "v", 3, "fit").count() == 0


def test_folds_and_performance(spark):
    df = spark.createDataFrame([("a", i, v, 0.1) for i, v in enumerate([0.5, 0.55, 0.61, 0.5, 0.2])], "k string, t int, x double, b double")
    got = [r.position for r in backtest.band_hysteresis(df, ["k"], "t", "x", "b").orderBy("t").collect()]
    assert got == [0.5, 0.5, 0.61, 0.5, 0.2]
    r = spark.createDataFrame([("a", i, v) for i, v in enumerate([0.1, -0.5, 0.2])], "k string, t int, r double")
    p = backtest.performance(r, ["k"], "t", "r", 12).first()
    assert p.total_return == pytest.approx(1.1 * 0.5 * 1.2 - 1) and p.max_drawdown == pytest.approx(-0.5)


def test_zigzag_and_barriers(spark):
    from datetime import date

    price = [10, 11, 13, 12, 9, 8, 9, 12, 14]
    bars = spark.createDataFrame([("s", date(2024, 1, i + 1), float(p), float(p), float(p), float(p), 1.0, i + 1) for i, p in enumerate(price)], "symbol string, date date, open double, high double, low double, close double, volume double, t int")
    swings = [(r.price, r.kind) for r in market.zigzag(bars, 0.2).orderBy("date").collect()]
    assert swings == [(10.0, "low"), (13.0, "high"), (8.0, "low")]
    out = market.barrier_exits(bars, bars.where("t in (1, 3, 5)"), 0.2, 0.3, 4).orderBy("date").collect()
    assert [(r.bars_held, r.reason) for r in out] == [(2, "take"), (2, "stop"), (3, "take")]
    # A bar that sets an extreme does not confirm it, and lows come first.
    jumps = [(10, 10), (20, 10), (21, 20)]
    bars = spark.createDataFrame([("s", date(2024, 1, i + 1), float(h), float(low), i + 1) for i, (h, low) in enumerate(jumps)], "symbol string, date date, high double, low double, t int")
    assert [(r.t, r.price, r.kind) for r in market.zigzag(bars, 1 / 3).collect()] == [(1, 10.0, "low")]


def test_trend_signal(spark):
    """Rows with a known answer: gap, gap before, threshold, signal, and the
    position that follows the target by bands of a tenth."""
    known = [(3.513333, 2.826667, -8.006667, 1), (5.763333, 3.513333, -8.006667, 1), (-6.916667, -6.653333, -3.7, -1), (-7.016667, -6.916667, -3.930667, -1), (-5.0, -6.0, -3.7, 0), (1.0, 1.0, 0.0, -1), (1.0, 0.0, None, 0)]
    d = spark.createDataFrame(known, "gap double, before double, thr double, want int")
    assert d.where(backtest.trend_signal(F.col("gap"), F.col("before"), F.col("thr")) != F.col("want")).count() == 0
    path = spark.createDataFrame([("a", 1, 0.96, 0.1), ("a", 2, 0.873, 0.1), ("a", 3, 0.85, 0.1), ("a", 4, 0.8, 0.1), ("b", 1, 0.0, 0.1)], "k string, t int, target double, band double")
    got = [(r.k, r.t, r.position) for r in backtest.band_hysteresis(path, ["k"], "t", "target", "band").orderBy("k", "t").collect()]
    assert got == [("a", 1, 0.96), ("a", 2, 0.96), ("a", 3, 0.85), ("a", 4, 0.85), ("b", 1, 0.0)]


def test_ewm_is_linear(spark):
    """Ten times the series takes about ten times as long, not a hundred."""
    import time

    took = []
    for n in (20_000, 200_000):
        df = spark.range(n).select(F.lit("a").alias("k"), "id", F.rand(1).alias("v"))
        began = time.perf_counter()
        assert ewm(df, ["k"], ["id"], "v", 0.1, "m").agg(F.max("m")).first()[0] < 1
        took.append(time.perf_counter() - began)
    assert took[1] < 30 * max(took[0], 0.2)


def test_nearest_by_brute_force(spark):
    rng = np.random.default_rng(5)
    pts = [(i, float(a), float(b)) for i, (a, b) in enumerate(np.c_[rng.uniform(-90, 90, 60), rng.uniform(-180, 180, 60)])] + [(60, 89.9, 10.0), (61, 0.0, 179.99)]
    sites = [(i, float(a), float(b)) for i, (a, b) in enumerate(np.c_[rng.uniform(-90, 90, 300), rng.uniform(-180, 180, 300)])]
    km = lambda a, b, c, d: 2 * 6371.0088 * np.arcsin(np.sqrt(np.sin(np.radians(c - a) / 2) ** 2 + np.cos(np.radians(a)) * np.cos(np.radians(c)) * np.sin(np.radians(d - b) / 2) ** 2))
    want = {(p, k + 1): s for p, a, b in pts for k, (_, s) in enumerate(sorted((km(a, b, c, d), s) for s, c, d in sites)[:3])}
    got = joins.nearest(spark.createDataFrame(pts, "p long, lat double, lon double"), spark.createDataFrame(sites, "s long, slat double, slon double"), "p", "s", 3)
    assert {(r.p, r.place): r.s for r in got.collect()} == want
    few = joins.nearest(spark.createDataFrame(pts, "p long, lat double, lon double"), spark.createDataFrame(sites[:2], "s long, slat double, slon double"), "p", "s", 3)
    assert few.count() == 2 * len(pts)


def test_nearest_of_many_at_one_place(spark, monkeypatch):
    """Places are compared, not every row at them with every other."""
    compared, plain = spark.sparkContext.accumulator(0), joins.haversine

    def counted(*where):
        seen = F.udf(lambda x: compared.add(1) or x, "double")
        return plain(*where[:3], seen(where[3]))

    monkeypatch.setattr(joins, "haversine", counted)
    pts = spark.range(300).union(spark.range(300, 302)).union(spark.range(301, 302)).select(F.col("id").alias("p"), F.lit(10.0).alias("lat"), (F.col("id") % 2 * 30.0).alias("lon"))
    sites = spark.range(600).select(F.col("id").alias("s"), F.lit(10.5).alias("slat"), (F.col("id") % 2 * 30.0).alias("slon"))
    got = joins.nearest(pts, sites, "p", "s", 3).collect()
    assert compared.value < 1000
    # Point 301 is there twice: its nearest site counts twice.
    assert sorted((r.p, r.place, r.s) for r in got if r.p != 301) == [(p, k + 1, 2 * k + p % 2) for p in range(301) for k in range(3)]
    assert sorted((r.place, r.s) for r in got if r.p == 301) == [(1, 1), (2, 1), (3, 3)]


def test_nearest_over_the_date_line_and_at_the_poles(spark):
    """26,000 sites made 161 columns of cells, and 360 / (360 / 161) is above 161."""
    sites = spark.range(26_000).select(F.col("id").alias("s"), (F.col("id") % 130 * 0.5 - 32).alias("slat"), (F.floor(F.col("id") / 130) * 1.79 - 178.5).alias("slon"))
    sites = sites.union(spark.createDataFrame([(30_000, 0.1, 179.9), (30_001, 89.0, -170.0)], "s long, slat double, slon double"))
    pts = spark.createDataFrame([(1, 0.1, -179.9), (2, 89.5, 10.0), (3, -89.9, 0.0)], "p long, lat double, lon double")
    got = {r.p: (r.s, r.km) for r in joins.nearest(pts, sites, "p", "s", 1).collect()}
    pairs = pts.crossJoin(sites).withColumn("km", joins.haversine(F.col("lat"), F.col("lon"), F.col("slat"), F.col("slon")))
    assert got == {r.p: (r.b.s, r.b.km) for r in pairs.groupBy("p").agg(F.min(F.struct("km", "s")).alias("b")).collect()}
    assert got[1][0] == 30_000 and got[2][0] == 30_001


def test_weighted_statistics(spark):
    d = spark.createDataFrame([("a", 1e9 + i, 1e9 + i, 1.0 + i) for i in range(5)], "k string, x double, y double, w double")
    assert statistics.weighted_corr(d, ["k"], "x", "y", "w", "r").first().r == pytest.approx(1.0)
    q = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 1.0), ("a", 3.0, 2.0)], "k string, v double, w double")
    for at in (0.1, 0.25, 0.4, 0.6, 1.0):
        assert statistics.weighted_quantile(q, ["k"], "v", "w", at).first()["quantile"] == pytest.approx(np.interp(at, [0.25, 0.5, 1.0], [1, 2, 3]))


def test_frames(spark):
    df = spark.createDataFrame([("1", "x", float("nan"), 1), (None, "2024-01-31", 99.99, 2)], "`a (m)` string, d string, v double, n int")
    assert frames.without_units(df).columns == ["a", "d", "v", "n"]
    assert [r.v for r in frames.missing_to_null(df).collect()] == [None, None]
    rates = {r.column: (r.dates, r.numbers) for r in frames.parse_rates(df, ["yyyy-MM-dd"]).collect()}
    assert rates == {"a (m)": (0.0, 1.0), "d": (0.5, 0.0)}
    assert frames.numeric_columns(df) == ["v", "n"] and frames.first_existing(df, ["x", " D"]) == "d" and frames.fuzzy_column(df, ["m"]) == "a (m)"
    old = spark.createDataFrame([("a", 1, 10), ("a", 2, 20)], "k string, t int, v int")
    new = spark.createDataFrame([("a", 2, 21), ("a", 3, 30)], "k string, t int, v int")
    assert sorted(tuple(r) for r in frames.increment(old, new, ["k"], "t").collect()) == [("a", 1, 10), ("a", 2, 21), ("a", 3, 30)]
    g = spark.createDataFrame([(0.0, 1), (180.0, 2)], "lon double, v int")
    assert sorted(tuple(r) for r in frames.cyclic_point(g).collect()) == [(0.0, 1), (180.0, 2), (360.0, 1)]


def test_physics(spark):
    df = spark.createDataFrame([(90.0, 10.0), (None, 1.0)], "d double, s double")
    u, v = physics.wind_uv(F.col("d"), F.col("s"))
    row = df.select(u.alias("u"), v.alias("v"), physics.wind_direction(u, v).alias("back"), physics.clip(F.col("d"), 0, 50).alias("c")).collect()
    assert row[0].u == pytest.approx(-10) and row[0].v == pytest.approx(0, abs=1e-12) and row[0].back == pytest.approx(90) and row[0].c == 50 and row[1].c is None


def test_bootstrap_repeats(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(50)], "k string, t int, v double")
    one, two = (learning.bootstrap_mean(df, ["k"], ["t"], "v", 300, 0.95).first() for _ in range(2))
    assert one == two and one.low < one["mean"] < one.high
    at = lambda b, k: int(hashlib.md5(f"{b}:{k}".encode()).hexdigest()[:8], 16) % 50
    means = sorted(sum(at(b, k) for k in range(50)) / 50 for b in range(300))
    assert (one.low, one.high) == (means[7], means[292])


def test_leading_patterns(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(40, 7)) + np.outer(rng.normal(size=40) * 3, np.sin(np.arange(7)))
    known = rng.random(x.shape) > 0.1
    rows = [(c, 2000 + t, float(x[c, t])) for c in range(40) for t in range(7) if known[c, t]] + [(99, 2001, None)]
    df = spark.createDataFrame(rows, "c int, t int, v double").repartition(5)
    got = learning.leading_patterns(df, ["c"], "t", "v", F.lit(1.0), 2).toPandas().sort_values(["mode", "t"])
    a = np.where(known, x - np.nanmean(np.where(known, x, np.nan), axis=1, keepdims=True), 0.0)
    u, s, _ = np.linalg.svd(a.T)
    for i in range(2):
        v, g = u[:, i] * s[i], got[got["mode"] == i + 1]
        assert g["score"].to_numpy() == pytest.approx(v * np.sign(v[np.argmax(np.abs(v))]))
        assert g["share"].iloc[0] == pytest.approx(s[i] ** 2 / (s**2).sum())
    assert learning.leading_patterns(df.where("false"), ["c"], "t", "v", F.lit(1.0), 2).count() == 0


def test_stores(spark, tmp_path):
    from isohyet.sources import stores, text

    spark.sparkContext.setCheckpointDir(str(tmp_path / "c"))
    old = spark.createDataFrame([("a", 1, 10, 2020), ("b", 1, 5, 2021)], "k string, t int, v int, y int")
    stores.save(old, str(tmp_path / "t"), ["y"], units={"v": "mm"})
    stores.append_increment(spark, str(tmp_path / "t"), spark.createDataFrame([("a", 1, 11, 2020)], "k string, t int, v int, y int"), ["k"], "t", "y")
    assert sorted((r.k, r.v) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [("a", 11), ("b", 5)]
    (tmp_path / "w.txt").write_text("head\nhead\n1948 0.5 99.99\n\n 1949  -99.99 2\n")
    got = text.whitespace_table(spark, str(tmp_path / "w.txt"), ["y", "a", "b"], skip=2).orderBy("y").collect()
    assert [tuple(r) for r in got] == [(1948.0, 0.5, None), (1949.0, None, 2.0)]
    wide = spark.createDataFrame([("1950", 1.0, 2.0)], "y string, jan double, feb double")
    assert [(r.year, r.month, r.value) for r in text.year_by_month(wide, "y", ["jan", "feb"]).orderBy("month").collect()] == [(1950, 1, 1.0), (1950, 2, 2.0)]


def test_streams_resume(spark, tmp_path):
    from datetime import datetime, timedelta

    from isohyet.streaming import incremental as inc

    def put(n, start):
        rows = [(i, datetime(2024, 1, 1) + timedelta(hours=i), 1, "click", float(i), "{}") for i in range(start, start + n)]
        spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    put(10, 0)
    stream = lambda: inc.last_target(spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in")), 3.0)
    assert inc.run_once(stream(), str(tmp_path / "out"), str(tmp_path / "state")).count() == 10
    put(5, 10)
    got = inc.run_once(stream(), str(tmp_path / "out"), str(tmp_path / "state")).orderBy("event_id").collect()
    assert [r.target for r in got] == [0, 0, 0, 3, 3, 3, 6, 6, 6, 9, 9, 9, 12, 12, 12]


def test_targets_of_all_events(spark):
    from conftest import SF
    from isohyet.plans import catalogue

    got = {r.event_id: (r.event_type, r.target, r.moved) for r in catalogue.QUERIES["stream_state_target"](spark, SF).collect()}
    held, want = {}, {}
    for e in spark.read.parquet(f"{SF}/events.parquet").toPandas().sort_values(["ts", "event_id"]).itertuples():
        moved = e.event_type not in held or abs(e.value - held[e.event_type]) >= 20
        held[e.event_type] = e.value if moved else held[e.event_type]
        want[e.event_id] = (e.event_type, held[e.event_type], moved)
    assert got == want


def test_exits_of_all_breakouts(spark):
    from conftest import SF
    from isohyet.plans import base, catalogue

    panel = {k: g.sort_values("t").reset_index(drop=True) for k, g in base.bars(spark, SF).toPandas().groupby("symbol")}
    got = {(x.symbol, x.date): (x.bars_held, x.reason, x.ret) for x in catalogue.QUERIES["barrier_exit"](spark, SF).collect()}
    want = {}
    for s, d in catalogue.QUERIES["breakout_signals"](spark, SF).select("symbol", "date").collect():
        g = panel[s]
        i = g.index[g["date"] == d][0]
        entry, later = g.close[i], g.iloc[i + 1 : i + 21]
        out = (len(later), "time", later.close.iloc[-1] if len(later) else entry)
        for k, b in enumerate(later.itertuples(), 1):
            if b.low <= entry * 0.9 or b.high >= entry * 1.2:
                out = (k, "stop", entry * 0.9) if b.low <= entry * 0.9 else (k, "take", entry * 1.2)
                break
        want[s, d] = (*out[:2], pytest.approx(out[2] / entry - 1, abs=2e-6))
    assert want and got == want


def test_open_exits_close_at_the_last_bar(spark):
    bars = spark.createDataFrame([("a", i, 10.0, 10.0 + i / 10, 9.9, 10.0 + i / 10) for i in range(1, 7)], "symbol string, t int, open double, high double, low double, close double").withColumn("date", F.col("t"))
    out = market.barrier_exits(bars, bars.where("t in (1, 4, 6)"), 0.2, 0.3, 4).orderBy("date").collect()
    assert [(x.date, x.bars_held, x.reason, round(x.ret, 6)) for x in out] == [(1, 4, "time", round(10.5 / 10.1 - 1, 6)), (4, 2, "time", round(10.6 / 10.4 - 1, 6)), (6, 0, "time", 0.0)]


def test_sphere(spark):
    """Known fields: solid rotation has no divergence, and twice its rate as
    vorticity; a missing cell makes its neighbours null; smoothers keep sums."""
    a, rate = 6.371e6, 1e-5
    cells = [(i, j, -50.0 + 10 * i) for i in range(11) for j in range(36)]
    rows = [(i, j, lat, rate * a * math.cos(math.radians(lat)), 0.0, float(i * 36 + j)) for i, j, lat in cells]
    d = spark.createDataFrame(rows, "i int, j int, lat double, u double, v double, z double")
    div, vor = sphere.divergence_vorticity(d, "u", "v", 10.0, 36)
    got = d.select("i", "lat", div.alias("d"), vor.alias("z")).collect()
    for r in got:
        if r.i in (0, 10):
            assert r.d is None and r.z is None
        else:
            assert abs(r.d) < 1e-18 and r.z == pytest.approx(2 * rate * math.sin(math.radians(r.lat)), abs=2e-7)
    east, _ = sphere.differences(d.where("j <> 5"), "z", 10.0, 36)
    assert {r.j for r in d.where("j <> 5").select("j", east.alias("e")).where("e is null").collect()} == {4, 6}
    smooth = {(r.i, r.j): r.s for r in sphere.with_nine_point(d, "z", "s", 36).collect()}
    assert smooth[5, 10] == pytest.approx(5 * 36 + 10) and smooth[0, 3] == 3.0
    z = np.array([x[5] for x in rows]).reshape(11, 36)
    k = np.exp(-np.arange(-4, 5) ** 2 / 2)
    pad = np.pad(z, ((4, 4), (0, 0)), mode="symmetric")
    want = sum(w * pad[n : n + 11] for n, w in enumerate(k / k.sum()))
    for r in sphere.gaussian(d, "z", "i", 11, 1.0, ["i", "j"]).collect():
        assert r.z == pytest.approx(want[r.i, r.j])


def test_air(spark):
    one = spark.range(1)
    lcl, w = air.lcl_temperature(F.lit(300.0), F.lit(100.0)), air.mixing_ratio(F.lit(1000.0), F.lit(293.15), F.lit(100.0))
    r = one.select(lcl.alias("lcl"), w.alias("w"), air.coriolis(F.lit(30.0)).alias("f"), air.true_wind(F.lit(3.0), F.lit(90.0), F.lit(0.0), F.lit(0.0))[1].alias("d"), air.direction_from(F.lit(0.0), F.lit(-5.0)).alias("n"), air.kelvin(F.lit(20.0), F.lit(18.0)).alias("k"), air.enso_phase(F.lit(-0.6)).alias("p")).first()
    assert r.lcl == pytest.approx(300) and r.w == pytest.approx(0.01487, abs=2e-4) and r.f == pytest.approx(7.292e-5)
    assert (r.d, r.n, r.k, r.p) == (pytest.approx(90), pytest.approx(0, abs=1e-9), 293.15, "cold")


def test_names_are_resolved_in_order(spark):
    names = ["Tide Gauge 2", "tide", "Salt_01"]
    assert frames.resolve_name(names, "tide") == "tide"
    assert frames.resolve_name(names, "Gauge") == "Tide Gauge 2"
    assert frames.resolve_name(names, "TIDE") == "tide"
    assert frames.resolve_name(names, "salt-7") == "Salt_01"
    assert frames.resolve_name(names, "wind") is None
    assert frames.resolve_name(names, "12") is None and frames.resolve_name([], "tide") is None
    df = spark.range(1).selectExpr("0 as month", "1 as `M2 balance yoy`", "1 as `M2 yoy`", "1 as `M1-M2 yoy`", "1 as `M12 yoy`")
    assert frames.marked_column(df, "m2", ["m1"], ["YoY"]) == "M2 yoy"
    assert frames.marked_column(df, "m1", ["m2"], ["yoy"]) is None


def test_flags_guards_and_grids(spark):
    df = spark.createDataFrame([(1, 9, 1.0, 2.0), (3, 9, None, 2.0), (4, 3, float("nan"), 2.0), (1, None, 3.0, 3.0)], "a int, b int, x double, y double")
    row = df.select(frames.overall_flag([F.col("a"), F.col("b")]).alias("f"), frames.if_complete(F.col("y") + 1, [F.col("x"), F.col("y")]).alias("v"), frames.spaced(F.col("y"), F.lit(4.0), 3).alias("s")).collect()
    assert [r.f for r in row] == [9, 3, 4, 1]
    assert [r.v for r in row] == [3.0, None, None, 4.0]
    assert row[0].s == [2.0, 3.0, 4.0]
    assert [r.x for r in spark.createDataFrame([("a",), ("z",), (None,)], "c string").select(frames.labelled(F.col("c"), {"a": "first"}, "none").alias("x")).collect()] == ["first", "none", "none"]


def test_pairs_within_windows_at_their_ends(spark):
    day = lambda a, b, names: spark.createDataFrame([(1, *p) for p in zip(a, b, strict=True)], "k int, a string, b string").selectExpr("k", f"date(a) as {names[0]}", f"date(b) as {names[1]}")
    pairs = day(["2020-01-01", "2020-01-02", "2020-03-01", "2020-02-29"], ["2020-01-05", None, "2020-03-02", "2020-03-02"], ("first", "last"))
    windows = day(["2020-01-01", "2020-02-29", "2020-05-01"], ["2020-01-05", "2020-03-01", "2020-04-01"], ("start", "stop"))
    for days in (1, 7, 400):
        assert [str(r["first"]) for r in joins.pairs_within(pairs, windows, ["k"], days).collect()] == ["2020-01-01"]
    assert joins.pairs_within(pairs.limit(0), windows, ["k"], 7).count() == 0


def test_evapotranspiration_of_crops(spark):
    args = [F.lit(x) for x in (12.0, 20.0, 2.0, 100000.0, 50.0)]
    grass, alfalfa = physics.penman_monteith(*args), physics.penman_monteith(*args, crop="alfalfa")
    got = spark.range(1).select(*grass, *alfalfa).first()
    es = 0.6108 * math.exp(17.27 * 20 / 257.3)
    slope, gamma = 4098 * es / 257.3**2, 1.004e-3 * 100000 / (1000 * 2.45 * 0.622)
    for i, (above, below) in enumerate([(900, 0.34), (1600, 0.38)]):
        whole = slope + gamma * (1 + below * 2)
        assert got[2 * i] == pytest.approx(0.408 * slope * 12 / whole)
        assert got[2 * i + 1] == pytest.approx(gamma * above * 2 * 0.5 * es / 293 / whole)


def test_best_tracks_of_parts_and_blocks(spark, tmp_path, monkeypatch):
    """A file in parts is one file; storms go on over the blocks of lines that
    tasks count, and so do their points."""
    from isohyet.sources import text

    monkeypatch.setattr(text, "BLOCK", 3)
    point = "2024010100 2 150 1300 990 30"
    lines = ["no storm yet", "66666 0000 4 0001 7,8 1 6 ONE(-1) 20240101", point, "", point, point, point, "66666 0000 2 0001 9 1 6 TWO 20240102", *["bad"] * 2500, point]
    for part, some in enumerate((lines[:3], lines[3:9], lines[9:])):
        (tmp_path / "f=a").mkdir(exist_ok=True)
        (tmp_path / "f=a" / f"part-{part}.txt").write_text("\n".join(some) + "\n")
    (tmp_path / "f=b").mkdir()
    (tmp_path / "f=b" / "part-0.txt").write_text("66666 0000 0 0001 5 1 6 NIL 20240103\n")
    numbered = text.numbered_lines(spark, str(tmp_path), lambda p: F.regexp_extract(p, "f=(.)", 1))
    assert [r.value for r in numbered.where("file = 'a'").orderBy("line").collect()] == lines
    assert sorted(r.line for r in numbered.where("file = 'a'").collect()) == list(range(1, len(lines) + 1))
    storms, tracks, issues = text.best_tracks(numbered)
    assert sorted((r.file, r.storm, r.cn_id, r.name) for r in storms.collect()) == [("a", 1, "7", "ONE"), ("a", 2, "9", "TWO"), ("b", 1, "5", "NIL")]
    assert sorted((r.file, r.storm, r.record_no) for r in tracks.collect()) == [("a", 1, 1), ("a", 1, 2), ("a", 1, 3), ("a", 1, 4), ("a", 2, 1)]
    got = {(r.file, r.storm, r.issue): r["count"] for r in issues.groupBy("file", "storm", "issue").count().collect()}
    assert got == {("a", 1, "composite id"): 1, ("a", 2, "record count"): 1, ("a", 2, "malformed point"): 2500}


def test_exits_read_bars_once(spark, monkeypatch):
    from conftest import SF
    from isohyet.plans import base, panel

    one, calls = base.bars(spark, SF).localCheckpoint(), spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        calls.add(1)
        return x

    monkeypatch.setattr(panel, "bars", lambda spark, sf_dir: one.withColumn("close", counted("close")))
    panel.barrier_exit(spark, SF).collect()
    assert calls.value == one.count()


def test_flag_files_are_written_by_all_tasks(spark, tmp_path):
    """No task takes a whole flag: as many parts as the input has."""
    from pathlib import Path

    from conftest import SF
    from isohyet.plans import files
    from isohyet.session import shared_root

    spark.read.parquet(f"{SF}/lineitem.parquet").repartition(3).write.parquet(str(tmp_path / "lineitem.parquet"))
    root = Path(shared_root(spark).removeprefix("file:"))
    before = set(root.glob("flags-*"))
    assert files.files_with_malformed_rows(spark, str(tmp_path)).count() == 3
    (new,) = set(root.glob("flags-*")) - before
    assert len(list((new / "mode=A").glob("part-*.csv"))) > 1
