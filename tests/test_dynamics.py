"""Flux, heat budget and surfaces on fields with known answers."""

from __future__ import annotations

import math

import numpy as np
import pytest

from isohyet.operators import sphere
from isohyet.plans import dynamics


def test_flux_of_a_zonal_wave(spark):
    """A wave along latitude circles, whose stream-function is A sin(k x), in a
    westerly: centred differences turn k into sin(k d) / d, and the flux points
    east with the square of that."""
    n, k, amplitude = 24, 3, 2.0e6
    step = 360.0 / n
    rows = []
    for level, p in ((1, 850.0), (2, 500.0), (3, 250.0)):
        for i in range(5):
            lat = 25.0 + 10 * i
            f = 4 * math.pi / 86400 * math.sin(math.radians(lat))
            for j in range(n):
                psi = amplitude * math.sin(k * math.radians(j * step))
                rows.append((i, j, lat, level, p, psi * f / sphere.FALL, 20.0, 0.0, 280.0 - 25.0 * level))
    df = spark.createDataFrame(rows, "i int, j int, lat double, level int, p double, za double, u double, v double, t double")
    got = sphere.wave_activity_flux(df, "za", "u", "v", "t", step, n).collect()
    d = math.radians(step)
    kk = math.sin(k * d) / d
    assert len(got) == len(rows)
    for g in got:
        want = amplitude**2 * kk**2 * g["p"] / 1000 / (2 * sphere.RADIUS**2 * math.cos(math.radians(g["lat"])))
        assert g["fx"] == pytest.approx(want, rel=1e-9)
        assert abs(g["fy"]) < 1e-9 * want and abs(g["fz"]) < 1e-6 * want


def test_flux_tilts_with_height(spark):
    """A wave that tilts west with height carries activity upwards; easterlies
    and the tropics have none."""
    n, k = 24, 2
    rows = []
    for level, p in ((1, 900.0), (2, 700.0), (3, 500.0), (4, 300.0)):
        for i, lat in enumerate((5.0, 35.0, 45.0, 55.0)):
            f = 4 * math.pi / 86400 * math.sin(math.radians(lat))
            for j in range(n):
                psi = 1e6 * math.sin(k * math.radians(15.0 * j) + 0.2 * level)
                rows.append((i, j, lat, level, p, psi * f / sphere.FALL, 20.0 if i < 3 else -3.0, 0.0, 290.0 - 10.0 * level))
    df = spark.createDataFrame(rows, "i int, j int, lat double, level int, p double, za double, u double, v double, t double")
    for g in sphere.wave_activity_flux(df, "za", "u", "v", "t", 15.0, n).collect():
        if g["i"] in (1, 2):
            assert g["fx"] > 0 and g["fz"] > 0
        else:
            assert g["fx"] is None and g["fz"] is None


def test_heat_budget_of_linear_fields(spark):
    """Potential temperature and moisture that are linear in time, both axes and
    pressure have exact differences."""
    a = {"s": 2e-6, "x": 3e-6, "y": -4e-6, "p": -0.05}
    rows, k = [], dynamics.GAS / dynamics.CP
    for i in range(3):
        for j in range(4):
            for level in range(1, 4):
                for year in range(3):
                    lat, lon, p = 10.0 + 2 * i, 3.0 * j, 1000.0 - 200 * level
                    x, y, s = lon * dynamics.DEGREE * math.cos(math.radians(lat)), lat * dynamics.DEGREE, year * 100.0
                    theta = 300 + a["s"] * s + a["x"] * x + a["y"] * y + a["p"] * p
                    rows.append((i, j, lat, lon, level, year, p, theta * (p / 1000) ** k, 5.0, -2.0, 0.3, theta / 1e5))
    df = spark.createDataFrame(rows, "i int, j int, lat double, lon double, level int, year int, p double, t double, u double, v double, omega double, q double")
    # Along a meridian x changes too: the northward difference has both parts.
    for g in dynamics.heat_budget(df, "year", 100.0).collect():
        lift = dynamics.CP * (g["p"] / 1000) ** k
        assert g["change"] == pytest.approx(lift * a["s"], rel=1e-6)
        assert g["vertical"] == pytest.approx(lift * 0.003 * a["p"], rel=1e-6)
        if g["j"] == 0:
            assert g["advection"] == pytest.approx(lift * (5 * a["x"] - 2 * a["y"]), rel=1e-6)
        assert g["q1"] == pytest.approx(g["change"] + g["advection"] + g["vertical"])
        assert g["q2"] == pytest.approx(-dynamics.EVAPORATION * g["q1"] / lift / 1e5, rel=1e-6)


def test_surfaces_of_a_profile_that_turns_back(spark):
    theta = [290.0, 300.0, 295.0, 295.0, 310.0, None]
    df = spark.createDataFrame([(1, k, t, 1000.0 - 100 * k) for k, t in enumerate(theta)], "unit int, level int, theta double, p double")
    got = {r["target"]: r["p"] for r in dynamics.on_surfaces(df, ["unit"], "level", "theta", ["p"], [289.0, 290.0, 296.0, 300.0, 305.0, 311.0]).collect()}
    assert got == {290.0: 1000.0, 296.0: pytest.approx(940.0), 300.0: 900.0, 305.0: pytest.approx(np.interp(305, [295, 310], [700, 600]))}
