"""Contraction flags against a search that begins anew on every bar's window."""

from __future__ import annotations

import math

import numpy as np
import pytest

from isohyet.operators import patterns


def series(seed, n):
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
    high, low = np.round(close * (1 + rng.uniform(0, 0.02, n)), 1), np.round(close * (1 - rng.uniform(0, 0.02, n)), 1)  # rounded: equal extremes
    return [(f"s{seed}", t + 1, float(high[t]), float(low[t]), float(np.round(close[t], 1)), float(rng.integers(1, 100))) for t in range(n)]


def known(bars, window):
    """Swings by place, half a window after the bar that is one."""
    half, out = window // 2, {}
    for i in range(half, len(bars) - half):
        around = bars[i - half : i + half + 1]
        if i + half < len(bars):
            out[i + half] = (bars[i][2] if bars[i][2] == max(b[2] for b in around) else None, bars[i][3] if bars[i][3] == min(b[3] for b in around) else None)
    return out


def anew(bars, swings, end, lookback, lo, hi, least, need, less, rise, atr):
    legs, top = [], None
    for i in range(max(0, end - lookback + 1), end + 1):
        h, low = swings.get(i, (None, None))
        if h is not None:
            top = (i, h)
        if top and low is not None and i - top[0] >= least:
            drop = (top[1] - low) / top[1]
            if top[1] > low and lo <= drop <= hi:
                legs.append((top, (i, low), drop))
            top = None
    if len(legs) < need:
        return None
    for a, b in zip(legs[-need:], legs[-need + 1 :], strict=False):
        margin = {"abs": rise[1], "pct": rise[1] * a[1][1], "atr": rise[1] * atr[b[1][0]]}[rise[0]]
        if not (a[2] > b[2] + less and b[1][1] - a[1][1] > margin):
            return None
    return legs[-1][0]


@pytest.mark.parametrize("rise", [("abs", 0.0), ("pct", 0.005), ("atr", 0.2)])
def test_flags_as_if_searched_anew(spark, rise):
    sets = [series(1, 260), series(2, 150), series(3, 9)]
    df = spark.createDataFrame([r for s in sets for r in s], "symbol string, t int, high double, low double, close double, volume double").repartition(3)
    for lookback, need in ((60, 2), (25, 2), (120, 3)):
        got = {(r["symbol"], r["t"]): r for r in patterns.contraction_flags(df, 5, lookback, 0.01, 0.4, 4, need, 0.0, rise, 6).collect()}
        assert len(got) == sum(map(len, sets))
        flagged = 0
        for bars in sets:
            swings = known(bars, 5)
            tr = [max(b[2] - b[3], abs(b[2] - p[4]), abs(b[3] - p[4])) if p else b[2] - b[3] for p, b in zip([None, *bars], bars, strict=False)]
            atr = [sum(tr[max(0, i - 5) : i + 1]) / (i - max(0, i - 5) + 1) for i in range(len(tr))]
            for i, b in enumerate(bars):
                want = anew(bars, swings, i, lookback, 0.01, 0.4, 4, need, 0.0, rise, atr)
                r = got[b[0], b[1]]
                assert r["vcp_ok"] == (want is not None)
                assert (r["pivot_t"], r["pivot"]) == ((want[0] + 1, want[1]) if want else (None, None))
                flagged += want is not None
        assert flagged or need == 3


def test_first_breakouts(spark):
    bars = series(4, 200)
    df = spark.createDataFrame(bars, "symbol string, t int, high double, low double, close double, volume double").repartition(3)
    pivots = [("s4", t, float(bars[t - 1][2])) for t in range(1, 201, 3)]
    got = {r["pivot_t"]: r["t"] for r in patterns.first_breakouts(df, spark.createDataFrame(pivots, "symbol string, pivot_t int, pivot double"), 7, 1.1, 10, 5, 0.5).collect()}
    want = {}
    for _, t, price in pivots:
        for b in bars[t : t + 7]:
            past = [x[5] for x in bars[max(0, b[1] - 10) : b[1]]]
            wick = (b[2] - b[4]) / (b[2] - b[3]) if b[2] > b[3] else math.inf
            if b[4] > price and len(past) >= 5 and b[5] > 1.1 * np.mean(past) and wick <= 0.5:
                want[t] = b[1]
                break
    assert got == want and want
