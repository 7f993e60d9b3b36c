"""Finite differences and smoothers on a regular grid of latitudes and
longitudes: a row a cell, with integer places ``i`` (latitude) and ``j``
(longitude, of ``columns``, the last beside the first).

Neighbours are values of window frames a place wide, so a missing cell is a null
neighbour and not the next one there is. One shuffle an axis, whatever the number
of fields; other dimensions go into ``by``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.air import EARTH_M, GRAVITY, coriolis


def shifted(value: str, axis: str, k: int, by: Sequence[str], columns: int | None = None) -> Column:
    """The value ``k`` places on along ``axis``; around, with ``columns``."""
    other = "i" if axis == "j" else "j"
    w = Window.partitionBy(*by, other).orderBy(axis)
    near = F.max(value).over(w.rangeBetween(k, k))
    if columns is None:
        return near
    around = F.max(value).over(w.rangeBetween(k - columns if k > 0 else k + columns, k - columns if k > 0 else k + columns))
    return F.coalesce(near, around)


def differences(df: DataFrame, value: str, step: float, columns: int, by: Sequence[str] = ()) -> tuple[Column, Column]:
    """Eastward and northward derivative in a metre; ``lat`` in degrees and
    ``step`` the degrees of a place. Null beside a missing cell."""
    metre = 2 * math.radians(step) * EARTH_M
    east = (shifted(value, "j", 1, by, columns) - shifted(value, "j", -1, by, columns)) / (metre * F.cos(F.radians("lat")))
    north = (shifted(value, "i", 1, by) - shifted(value, "i", -1, by)) / metre
    return east, north


def divergence_vorticity(df: DataFrame, u: str, v: str, step: float, columns: int, by: Sequence[str] = ()) -> tuple[Column, Column]:
    """By centred differences, with the terms of converging meridians."""
    ux, uy = differences(df, u, step, columns, by)
    vx, vy = differences(df, v, step, columns, by)
    bend = F.tan(F.radians("lat")) / EARTH_M
    return ux + vy - F.col(v) * bend, vx - uy + F.col(u) * bend


def geostrophic_wind(df: DataFrame, height: str, step: float, columns: int, by: Sequence[str] = ()) -> tuple[Column, Column]:
    east, north = differences(df, height, step, columns, by)
    f = coriolis(F.col("lat"))
    return -GRAVITY * north / f, GRAVITY * east / f


def with_nine_point(df: DataFrame, value: str, name: str, columns: int, by: Sequence[str] = ()) -> DataFrame:
    """A quarter of the cell, an eighth of each cell beside it, a sixteenth of
    each across; the cell itself where one of them is missing."""
    rows = df.withColumns({"_e": shifted(value, "j", 1, by, columns), "_w": shifted(value, "j", -1, by, columns)})
    rows = rows.withColumn("_row", (F.col("_e") + F.col("_w")) / 2 + F.col(value))
    up, down = shifted("_row", "i", 1, by), shifted("_row", "i", -1, by)
    return rows.withColumn(name, F.coalesce((F.col("_row") + (up + down) / 2) / 4, F.col(value))).drop("_e", "_w", "_row")


def gaussian(df: DataFrame, value: str, axis: str, size: int, sigma: float, keys: Sequence[str]) -> DataFrame:
    """``keys`` and the Gaussian mean along an axis of ``size`` places, mirrored
    at its ends, to four sigma. Each place looks up its neighbours by a join on
    the place; where a cell is missing the weights of the others count."""
    half = int(4 * sigma + 0.5)
    k = F.col("_k")
    at = F.pmod(F.col(axis) + k, F.lit(2 * size))
    want = df.select(*keys, F.explode(F.sequence(F.lit(-half), F.lit(half))).alias("_k"))
    want = want.select(*[F.col(c).alias(f"_{c}") if c == axis else F.col(c) for c in keys], F.exp(-k * k / (2.0 * sigma * sigma)).alias("_g"), F.when(at < size, at).otherwise(2 * size - 1 - at).cast("int").alias(axis))
    out = want.join(df.select(*keys, value), list(keys)).groupBy(*[F.col(f"_{c}").alias(c) if c == axis else F.col(c) for c in keys])
    return out.agg((F.sum(F.col("_g") * F.col(value)) / F.sum("_g")).alias(value))


def slope(value: str, axis: str, step: float, by: Sequence[str], columns: int | None = None) -> Column:
    """Derivative along an axis in units of ``step`` a place: centred, one-sided
    beside an end or a missing cell, null without a neighbour."""
    ahead, behind = shifted(value, axis, 1, by, columns), shifted(value, axis, -1, by, columns)
    places = ahead.isNotNull().cast("int") + behind.isNotNull().cast("int")
    return F.try_divide(F.coalesce(ahead, F.col(value)) - F.coalesce(behind, F.col(value)), places * F.lit(step))


def slope_up(value: str, height: str, by: Sequence[str], order: str) -> Column:
    """Derivative along ``height`` between the rows above and below in ``order``,
    one-sided at the ends."""
    w = Window.partitionBy(*by).orderBy(order)
    near = lambda c, fn: F.coalesce(fn(c).over(w), F.col(c))
    return F.try_divide(near(value, F.lead) - near(value, F.lag), near(height, F.lead) - near(height, F.lag))


#: Constants of the flux: gas constant, gravity, scale height, radius, as fixed values.
GAS, FALL, SCALE_HEIGHT, RADIUS = 290.0, 9.80665, 8000.0, 6378388.0


def wave_activity_flux(df: DataFrame, anomaly: str, u: str, v: str, temperature: str, step: float, columns: int, level: str = "level", pressure: str = "p", tropics: float = 10.0, westerly: float = 5.0) -> DataFrame:
    """``df`` with fx, fy and fz, the flux of stationary wave activity on the
    sphere: the products of first and second derivatives of the stream-function
    of the height ``anomaly``, projected on the basic wind (u, v).

    Rows have i, j, ``lat``, ``level`` (upwards) and ``pressure`` in hPa. Null in
    the ``tropics``, where the basic wind is no westerly of the given strength,
    and where stratification (from ``temperature``) is not stable. Three shuffles:
    one an axis, whatever the number of derivatives."""
    p, lat = F.col(pressure), F.radians("lat")
    f = F.when(F.abs("lat") >= tropics, 4 * math.pi / 86400 * F.sin(lat))
    rows = df.withColumns({"_f": f, "_psi": F.col(anomaly) * FALL / f, "_h": -SCALE_HEIGHT * F.log(p / 1000), "_theta": F.col(temperature) * F.pow(1000 / p, 0.286)})
    turn, on = math.radians(step), [level]
    rows = rows.withColumn("_x", slope("_psi", "j", turn, on, columns)).withColumn("_xx", slope("_x", "j", turn, on, columns))
    rows = rows.withColumns({"_y": slope("_psi", "i", turn, on), "_xy": slope("_x", "i", turn, on)}).withColumn("_yy", slope("_y", "i", turn, on))
    up = lambda c: slope_up(c, "_h", ["i", "j"], level)
    rows = rows.withColumns({"_z": up("_psi"), "_xz": up("_x"), "_yz": up("_y"), "_tz": up("_theta")})
    c = {k: F.col(f"_{k}") for k in ("psi", "x", "xx", "y", "xy", "yy", "z", "xz", "yz")}
    xu, xv, yv = c["x"] * c["x"] - c["psi"] * c["xx"], c["x"] * c["y"] - c["psi"] * c["xy"], c["y"] * c["y"] - c["psi"] * c["yy"]
    zu, zv = c["x"] * c["z"] - c["psi"] * c["xz"], c["y"] * c["z"] - c["psi"] * c["yz"]
    stability = GAS * F.pow(p / 1000, 0.286) / SCALE_HEIGHT * F.col("_tz")
    stable = F.when(stability > 0, stability)
    speed, cos, wind, cross = F.sqrt(F.col(u) * F.col(u) + F.col(v) * F.col(v)), F.cos(lat), F.col(u), F.col(v)
    flat = p / 1000 / (2 * speed * RADIUS * RADIUS)
    fluxes = {
        "fx": flat * (wind / cos * xu + cross * xv),
        "fy": flat * (wind * xv + cos * cross * yv),
        "fz": F.try_divide(p / 1000 * F.col("_f") * F.col("_f") * (wind * zu + cos * cross * zv), 2 * speed * stable * RADIUS),
    }
    rows = rows.withColumns({k: F.when(F.col(u) >= westerly, x) for k, x in fluxes.items()})
    return rows.drop("_f", "_h", "_theta", "_tz", *[f"_{k}" for k in c])


def resampled(df: DataFrame, axis: str, targets: Sequence[float], value: str, by: Sequence[str], period: float | None = None) -> DataFrame:
    """Each line along ``axis``, drawn straight between its known points, at
    ``targets``; rows are ``by``, ``axis`` and ``value``. Beyond its ends a line
    keeps its end value; with a ``period`` its last point is followed by its first
    one. Points without a value or place do not count, a line without any has no
    rows, and of points at one place the mean counts.

    A leg between two points lists the targets on it and no others, so the work
    is the points and the results, whatever the number of targets.
    """
    x, v = F.col(axis).cast("double"), F.col(value).cast("double")
    points = df.where(x.isNotNull() & v.isNotNull()).groupBy(*by, x.alias("_x0")).agg(F.avg(v).alias("_v0"))
    w = Window.partitionBy(*by).orderBy("_x0")
    legs = points.withColumns({"_x1": F.lead("_x0").over(w), "_v1": F.lead("_v0").over(w), "_f": F.first("_x0").over(w), "_fv": F.first("_v0").over(w)})
    at = F.array(*[F.lit(float(t)) for t in targets])
    if period:
        legs = legs.withColumns({"_x1": F.coalesce("_x1", F.col("_f") + period), "_v1": F.coalesce("_v1", "_fv")})
        turn = lambda t: F.col("_f") + F.pmod(t - F.col("_f"), F.lit(float(period)))
        on = F.filter(at, lambda t: (turn(t) >= F.col("_x0")) & (turn(t) < F.col("_x1")))
        place = turn(F.col("_t"))
        flat = F.lit(False)
    else:
        before = (F.col("_x0") == F.col("_f"))
        on = F.filter(at, lambda t: ((t >= F.col("_x0")) & (F.col("_x1").isNull() | (t < F.col("_x1")))) | (before & (t < F.col("_x0"))))
        place = F.col("_t")
        flat = (place < F.col("_x0")) | F.col("_x1").isNull()
    straight = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (place - F.col("_x0")) / (F.col("_x1") - F.col("_x0"))
    return legs.withColumn("_t", F.explode(on)).select(*by, F.col("_t").alias(axis), F.when(flat, F.col("_v0")).otherwise(straight).alias(value))
