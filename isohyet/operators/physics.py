"""Scalar formulas of meteorology and calendars, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, low: float, high: float) -> Column:
    """Null stays null (greatest and least alone would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def wind_uv(direction: Column, speed: Column) -> tuple[Column, Column]:
    """Components of a wind given by the direction it comes from."""
    return -speed * F.sin(F.radians(direction)), -speed * F.cos(F.radians(direction))


def wind_direction(u: Column, v: Column) -> Column:
    return F.pmod(F.degrees(F.atan2(-u, -v)) + 360, F.lit(360.0))


def wrap_longitude(lon: Column, west: float = -180.0) -> Column:
    """To [west, west + 360)."""
    return F.pmod(lon - west, F.lit(360.0)) + west


def vapour_pressure(t_celsius: Column) -> Column:
    """Saturation vapour pressure in hPa."""
    return 6.112 * F.exp(17.67 * t_celsius / (t_celsius + 243.5))


def relative_humidity(t: Column, dew: Column) -> Column:
    return clip(100 * vapour_pressure(dew) / vapour_pressure(t), 0.0, 100.0)


def specific_humidity(e: Column, p: Column) -> Column:
    return 0.622 * e / (p - 0.378 * e)


def potential_temperature(t_kelvin: Column, p: Column) -> Column:
    return t_kelvin * F.pow(1000.0 / p, 0.2854)


def moist_static_energy(t_kelvin: Column, geopotential: Column, q: Column) -> Column:
    return 1004.0 * t_kelvin + geopotential + 2.5e6 * q


def wind_at_2m(u: Column, height: float = 10.0) -> Column:
    return u * (4.87 / F.log(F.lit(67.8 * height - 5.42)))


#: Megajoules a day of a watt; specific heat of air in MJ/(kg K) and
#: latent heat of water in MJ/kg; by reference crop, factor of the wind above and below.
DAY_MJ, SPECIFIC_HEAT, LATENT_HEAT = 0.0864, 1.004e-3, 2.45
CROPS = {"grass": (900.0, 0.34), "alfalfa": (1600.0, 0.38)}


def net_radiation(sensible: Column, latent: Column) -> Column:
    """MJ/m2/day that leave as heat fluxes (W/m2, upwards)."""
    return DAY_MJ * (sensible + latent)


def penman_monteith(rn: Column, t: Column, u2: Column, pressure: Column, rh: Column, crop: str = "grass") -> tuple[Column, Column]:
    """Reference evapotranspiration in mm a day, its radiation and its advection
    part: MJ/m2/day, Celsius, m/s at two metres, Pa and per cent."""
    above, below = CROPS[crop]
    saturated = 0.6108 * F.exp(17.27 * t / (t + 237.3))
    slope, gamma = 4098 * saturated / F.pow(t + 237.3, 2), SPECIFIC_HEAT * pressure / (1000 * LATENT_HEAT * 0.622)
    whole = slope + gamma * (1 + below * u2)
    return 0.408 * slope * rn / whole, gamma * above * u2 * (1 - rh / 100) * saturated / (t + 273) / whole


def piecewise_weight(x: Column, low: float, high: float, top: float) -> Column:
    """``top`` up to ``low``, 0 from ``high`` on, linear between."""
    return F.when(x <= low, F.lit(top)).when(x >= high, F.lit(0.0)).otherwise(top * (high - x) / (high - low))


def is_leap(year: Column) -> Column:
    return ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)


def monthly_rate(annual: Column) -> Column:
    return F.pow(1 + annual, 1 / 12) - 1
