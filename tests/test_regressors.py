"""Ridge by evidence and boosted counts against plain loops over the rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from isohyet.operators import regressors as reg


def plain_ridge(x, y, rounds=300, tolerance=1e-3, a=1e-4, b=1e-6):
    centre, scale, base = x.mean(0), x.std(0), y.mean()
    scale[scale == 0] = 1
    z, t = (x - centre) / scale, y - base
    noise, strength, before = 1 / (t.var() + np.finfo(float).eps), 1.0, None
    fit = lambda: np.linalg.solve(z.T @ z + strength / noise * np.eye(z.shape[1]), z.T @ t)
    for i in range(rounds):
        w = fit()
        cov = np.linalg.inv(strength * np.eye(z.shape[1]) + noise * z.T @ z)
        used = z.shape[1] - strength * np.trace(cov)
        strength, noise = (used + 2 * a) / (w @ w + 2 * b), (len(t) - used + 2 * a) / (((t - z @ w) ** 2).sum() + 2 * b)
        if i and np.abs(w - before).sum() < tolerance:
            break
        before = w
    return centre, scale, base, fit(), noise, strength, np.linalg.inv(strength * np.eye(z.shape[1]) + noise * z.T @ z)


def test_ridge_by_evidence(spark):
    rng = np.random.default_rng(3)
    frames = []
    for g, (n, slope) in {"steep": (60, 4.0), "weak": (25, 0.2), "none": (12, 0.0)}.items():
        x = rng.normal(size=(n, 3)) * [1, 10, 0.1] + [0, 1e5, 3]
        if g == "none":
            x[:, 2] = 7.0
        frames.append(pd.DataFrame({"g": g, "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": slope * x[:, 0] + rng.normal(size=n) + 100}))
    frames.append(pd.DataFrame({"g": ["lone", None, None], "a": [1.0, 2.0, 3.0], "b": [1.0, 5.0, 2.0], "c": [0.0, 1.0, 1.0], "y": [1.0, 2.0, 5.0]}))
    pdf = pd.concat(frames)
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None).values.tolist(), "g string, a double, b double, c double, y double").repartition(3)
    df = df.union(spark.createDataFrame([("steep", None, 1.0, 1.0, 9.0), ("steep", 1.0, float("nan"), 1.0, 9.0)], df.schema))
    models = reg.bayesian_ridge(df, ["g"], ["a", "b", "c"], "y")
    got = {m["g"]: m for m in models.collect()}
    assert set(got) == {"steep", "weak", "none", None}
    for g in ("steep", "weak", "none"):
        p = pdf[pdf["g"] == g]
        centre, scale, base, w, noise, strength, cov = plain_ridge(p[["a", "b", "c"]].to_numpy(), p["y"].to_numpy())
        m = got[g]
        assert m["n"] == len(p) and m["base"] == pytest.approx(base)
        for name, want in (("centre", centre), ("scale", scale), ("weights", w), ("spread", cov.ravel())):
            assert m[name] == pytest.approx(want, rel=1e-5, abs=1e-7)
        assert (m["noise"], m["strength"]) == pytest.approx((noise, strength), rel=1e-5)
    assert abs(got["steep"]["weights"][0]) > 3 > 0.5 > abs(got["none"]["weights"][0])
    out = reg.with_ridge(df, models, ["g"], ["a", "b", "c"])
    assert out.columns == [*df.columns, "prediction", "doubt"] and out.count() == df.count()
    sure = out.where("g = 'steep' and abs(y - prediction) < 2 * doubt").count()
    assert sure >= 50 and out.where("g = 'lone' and prediction is null").count() == 1
    assert out.where("g is null and prediction is not null").count() == 2
    assert reg.bayesian_ridge(df.where("false"), ["g"], ["a"], "y").count() == 0


def plain_boosting(x, y, keys, *, rounds, depth, bins, rate, ridge, lasso, least_gain, least_weight, max_step, rows):
    """Every split tried on the rows themselves; returns the expected counts."""
    cuts = []
    for j in range(x.shape[1]):
        v = np.sort(x[~np.isnan(x[:, j]), j])
        cuts.append(sorted({v[max(0, math.ceil(i / bins * len(v)) - 1)] for i in range(1, bins)}) if len(v) else [])
    f = np.full(len(y), math.log(y.mean()))

    def weight(g, h):
        return max(-max_step, min(max_step, -math.copysign(max(abs(g) - lasso, 0.0), g) / (h + ridge)))

    def won(g, h):
        w = weight(g, h)
        return -(2 * (g * w + lasso * abs(w)) + (h + ridge) * w * w)

    import hashlib

    for m in range(rounds):
        part = np.array([int(hashlib.md5(f"{m}:{k}".encode()).hexdigest()[:6], 16) % 1000 < round(rows * 1000) for k in keys])
        g, h = np.exp(f) - y, np.exp(f + max_step)
        step = np.zeros(len(y))

        def grow(at, level):
            own = at & part
            best = (least_gain, None)
            if level < depth:
                for j in range(x.shape[1]):
                    for null_left in (True, False):
                        for c in cuts[j]:
                            left = np.where(np.isnan(x[:, j]), null_left, x[:, j] <= c)
                            a, b = own & left, own & ~left
                            if h[a].sum() < least_weight or h[b].sum() < least_weight:
                                continue
                            gain = round(won(g[a].sum(), h[a].sum()) + won(g[b].sum(), h[b].sum()) - won(g[own].sum(), h[own].sum()), 9)
                            if gain > best[0]:
                                best = (gain, left)
            if best[1] is None:
                step[at] = rate * weight(g[own].sum(), h[own].sum()) if own.any() else 0.0
            else:
                grow(at & best[1], level + 1)
                grow(at & ~best[1], level + 1)

        grow(np.ones(len(y), bool), 0)
        f = f + step
    return np.exp(f)


@pytest.mark.parametrize("rows", [1.0, 0.7])
def test_boosted_counts(spark, rows):
    rng = np.random.default_rng(4)
    n = 300
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 4, size=n).astype(float), np.full(n, 5.0)])
    x[rng.random(n) < 0.2, 0] = np.nan
    y = rng.poisson(np.exp(0.5 + np.where(np.isnan(x[:, 0]), 1.0, 0.8 * (x[:, 0] > 0.3)) + 0.3 * x[:, 1]))
    data = [(i, *[None if v != v and i % 2 else float(v) for v in x[i]], int(y[i])) for i in range(n)]
    df = spark.createDataFrame(data, "id int, a double, b double, c double, y int").repartition(4)
    p = {"rounds": 5, "depth": 3, "bins": 6, "rate": 0.3, "ridge": 1.0, "lasso": 0.1, "least_gain": 0.1, "least_weight": 3.0, "max_step": 0.7, "rows": rows}
    model = reg.poisson_boosting(df, ["a", "b", "c"], "y", "id", **p, write_every=2)
    got = df.select("id", model.expected().alias("e")).toPandas().sort_values("id")["e"].to_numpy()
    assert got == pytest.approx(plain_boosting(x, y.astype(float), range(n), **p), rel=1e-9)
    gains = model.gains()
    assert gains["a"] > 0 and gains["b"] > 0 and gains["c"] == 0


def test_boosted_counts_at_the_edges(spark):
    schema = "id int, a double, y double"
    fit = lambda rows, **p: reg.poisson_boosting(spark.createDataFrame(rows, schema), ["a"], "y", "id", rounds=2, **p)
    one = spark.createDataFrame([(0, 1.0, 1.0)], schema)
    expected = lambda m: one.select(m.expected()).first()[0]
    assert expected(fit([])) == 0 and expected(fit([(1, 1.0, 0.0), (2, 2.0, 0.0)])) == 0
    known = [(i, None, 4.0) for i in range(20)] + [(99, 1.0, None), (98, 1.0, -3.0), (None, 1.0, float("nan"))]
    assert expected(fit(known)) == pytest.approx(4.0)
    assert len(fit(known, columns=0.1).trees) == 2
    with pytest.raises(ValueError):
        reg.poisson_boosting(one, [], "y", "id")


def test_columns_and_rows_are_drawn_alike(spark):
    names = [f"f{i}" for i in range(10)]
    drawn = [reg.columns_drawn(names, m, 0.3) for m in range(30)]
    assert all(len(d) == 3 for d in drawn) and {i for d in drawn for i in d} == set(range(10))
    df = spark.range(4000).withColumn("id", F.col("id"))
    share = df.where(reg.drawn("id", 1, 0.8)).count() / 4000
    assert 0.77 < share < 0.83 and share == df.repartition(7).where(reg.drawn("id", 1, 0.8)).count() / 4000


def test_boosted_rows_are_computed_once(spark, monkeypatch):
    """Cuts and bins come from one evaluation: the sums of another may end in
    another bit."""
    from isohyet.plans import regressors as plans

    calls = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def price(i):
        calls.add(1)
        return i % 7 / 3

    rows = spark.range(120).select((F.col("id") % 6).cast("int").alias("unit"), (F.lit(plans.SPLIT - 10) + F.floor(F.col("id") / 6)).cast("int").alias("t"), (F.col("id") % 7 + 1).cast("double").alias("y"), price("id").alias("price"), (F.col("id") % 3 / 3).alias("urgent"))
    monkeypatch.setattr(plans, "unit_months", lambda spark, sf_dir: rows)
    assert plans.poisson_boosting(spark, "").count() == 60 and calls.value == 120
    assert plans.boosting_gains(spark, "").count() > 0 and calls.value == 2 * 120 - 60
