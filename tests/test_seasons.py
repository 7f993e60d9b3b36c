"""Seasons from cumulated anomalies, within a year and over its turn."""

from __future__ import annotations

import pytest

from isohyet.plans.seasons import rain_seasons


def test_seasons_of_both_hemispheres(spark):
    rows = [("north", k, 10.0) for k in range(4, 8)] + [("south", k, 6.0) for k in (10, 11, 0, 1)] + [("even", k, 2.0) for k in range(12)]
    got = {r["g"]: r for r in rain_seasons(spark.createDataFrame(rows, "g string, k int, v double").repartition(3), ["g"], "k", "v", 12).collect()}
    # Places without rows have no rain.
    n, s, e = got["north"], got["south"], got["even"]
    assert (n["onset"], n["withdrawal"], n["length"], n["total"], n["intensity"]) == (4, 7, 4, 40.0, 10.0)
    assert (s["onset"], s["withdrawal"], s["length"], s["total"]) == (10, 1, 4, pytest.approx(24.0))
    assert e["length"] == 0 and e["intensity"] is None
    assert rain_seasons(spark.createDataFrame([], "g string, k int, v double"), ["g"], "k", "v", 12).count() == 0
