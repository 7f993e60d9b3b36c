"""Points in polygons against the test of every point with every edge."""

from __future__ import annotations

import math
import random

import pytest

from isohyet.operators import regions


def brute(points, rings):
    out = set()
    for i, lat, lon in points:
        for name, parts in rings.items():
            for turn in (-360, 0, 360):
                odd = False
                for ring in parts:
                    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
                        if y1 != y2 and (y1 > lat) != (y2 > lat) and lon + turn < x1 + (lat - y1) * (x2 - x1) / (y2 - y1):
                            odd = not odd
                if odd:
                    out.add((i, name))
    return sorted(out)


@pytest.mark.parametrize("size", [1.0, 10.0, 90.0])
def test_points_in_polygons(spark, size):
    rng = random.Random(6)
    star = lambda x, y, r, n: [(x + r * rng.uniform(0.3, 1) * math.cos(2 * math.pi * k / n), y + r * rng.uniform(0.3, 1) * math.sin(2 * math.pi * k / n)) for k in range(n)]
    rings = {f"p{k}": [star(rng.uniform(-180, 180), rng.uniform(-60, 60), rng.uniform(2, 30), rng.randint(3, 20))] for k in range(25)}
    rings["line"] = [[(170.0, -10.0), (200.0, -10.0), (200.0, 10.0), (170.0, 10.0)], [(178.0, -2.0), (182.0, -2.0), (182.0, 2.0), (178.0, 2.0)]]  # over the date line, with a hole
    rings["belt"] = [[(-180.0, 70.0), (180.0, 70.0), (180.0, 80.0), (-180.0, 80.0)]]
    points = [(i, rng.uniform(-85, 85), rng.uniform(-180, 180)) for i in range(800)] + [(900, 0.0, 179.0), (901, 0.0, -179.0), (902, 5.0, -175.0), (903, 75.0, 0.0), (904, -10.0, 175.0), (905, 10.0, 175.0)]
    vertices = [(name, k, j, x, y) for name, parts in rings.items() for k, ring in enumerate(parts) for j, (x, y) in enumerate(ring)]
    edges = regions.ring_edges(spark.createDataFrame(vertices, "polygon string, ring int, nth int, lon double, lat double"), "polygon", "ring", "nth")
    df = spark.createDataFrame([*points, (906, None, 1.0)], "id int, lat double, lon double").repartition(3)
    got = regions.points_in_polygons(df, edges, "id", "polygon", size)
    want = brute(points, rings)
    assert sorted((r["id"], r["polygon"]) for r in got.collect()) == want
    assert {(902, "line"), (903, "belt"), (904, "line")} <= set(want) and not {(900, "line"), (901, "line"), (905, "line")} & set(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
