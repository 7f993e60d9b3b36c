"""Scalar formulas of the air and the sea surface, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GRAVITY, EARTH_M, OMEGA, R_DRY, KAPPA = 9.81, 6.371e6, 7.292e-5, 287.0, 0.2854


def kelvin(t: Column, median: Column) -> Column:
    """To kelvin, if the field's median says that it is in degrees Celsius."""
    return F.when(median > 200, t).otherwise(t + 273.15)


def coriolis(lat: Column) -> Column:
    return 2 * OMEGA * F.sin(F.radians(lat))


def lcl_temperature(t: Column, rh: Column) -> Column:
    """Temperature (K) at the lifting condensation level, from t in K and the
    relative humidity in per cent."""
    return 1 / (1 / (t - 55) - F.log(rh / 100) / 2840) + 55


def mixing_ratio(p: Column, t: Column, rh: Column) -> Column:
    """kg/kg, from hPa, K and per cent."""
    e = rh / 100 * 6.112 * F.exp(17.67 * (t - 273.15) / (t - 29.65))
    return 0.622 * e / (p - e)


def equivalent_potential_temperature(p: Column, t: Column, w: Column, lcl: Column) -> Column:
    dry = t * F.pow(1000 / p, 0.2854 * (1 - 0.28 * w))
    return dry * F.exp((3.376 / lcl - 0.00254) * 1000 * w * (1 + 0.81 * w))


def omega_to_w(omega: Column, p: Column, t: Column) -> Column:
    """Vertical speed (m/s) from Pa/s, Pa and K."""
    return -omega * R_DRY * t / (p * GRAVITY)


def true_wind(speed: Column, direction: Column, ship_speed: Column, heading: Column) -> tuple[Column, Column]:
    """Speed and direction of the wind, from what a moving ship (km/h) sees."""
    ship = ship_speed * 0.2777
    u = speed * F.sin(F.radians(direction)) + ship * F.sin(F.radians(heading))
    v = speed * F.cos(F.radians(direction)) + ship * F.cos(F.radians(heading))
    return F.sqrt(u * u + v * v), F.pmod(F.degrees(F.atan2(u, v)), F.lit(360.0))


def direction_from(u: Column, v: Column) -> Column:
    return F.pmod(270 - F.degrees(F.atan2(v, u)), F.lit(360.0))


def enso_phase(anomaly: Column, limit: float = 0.5) -> Column:
    return F.when(anomaly >= limit, "warm").when(anomaly <= -limit, "cold").otherwise("neutral")
