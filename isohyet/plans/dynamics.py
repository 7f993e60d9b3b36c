"""Queries on a field in three dimensions: order priorities are its levels, cells
of customers its places."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import sphere, statistics as st
from .atmosphere import gradient_sql
from .base import query, r, table

SPACE = """
sp as (
  select cast(o_custkey % 6 as integer) as i, cast((o_custkey // 6) % 8 as integer) as j, 20.0 + 7.0 * (o_custkey % 6) as lat, cast(substr(o_orderpriority, 1, 1) as integer) as level,
         1050.0 - 150 * cast(substr(o_orderpriority, 1, 1) as integer) as p, avg(o_totalprice) / 100 as z, avg(o_totalprice) / 12000 as u, avg(o_totalprice * case when o_orderstatus = 'F' then 1 else -1 end) / 20000 as v,
         300 - avg(o_totalprice) / 50000 - 6.0 * cast(substr(o_orderpriority, 1, 1) as integer) as t
  from orders group by 1, 2, 3, 4, 5)
"""
LEVEL = "cast(substr(o_orderpriority, 1, 1) as int)"


def space(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, sign, i, level = F.col("o_totalprice"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(-1), F.col("o_custkey") % 6, F.expr(LEVEL)
    cell = [i.cast("int").alias("i"), (F.floor(F.col("o_custkey") / 6) % 8).cast("int").alias("j"), (20.0 + 7.0 * i).alias("lat"), level.alias("level"), (1050.0 - 150 * level).alias("p")]
    g = table(spark, sf_dir, "orders").groupBy(*cell).agg(F.avg(price).alias("_m"), (F.avg(price * sign) / 20000).alias("v"))
    return g.withColumns({"z": F.col("_m") / 100, "u": F.col("_m") / 12000, "t": 300 - F.col("_m") / 50000 - 6.0 * F.col("level")}).drop("_m")


def shift_sql(value: str, axis: str, k: int, columns: int = 0) -> str:
    w = f"partition by level, {'i' if axis == 'j' else 'j'} order by {axis}"
    frame = lambda n: f"range between {abs(n)} {'following' if n > 0 else 'preceding'} and {abs(n)} {'following' if n > 0 else 'preceding'}"
    near = f"max({value}) over ({w} {frame(k)})"
    return f"coalesce({near}, max({value}) over ({w} {frame(k - columns if k > 0 else k + columns)}))" if columns else near


def slope_sql(value: str, axis: str, step: str, columns: int = 0) -> str:
    a, b = shift_sql(value, axis, 1, columns), shift_sql(value, axis, -1, columns)
    return f"(coalesce({a}, {value}) - coalesce({b}, {value})) / nullif((cast({a} is not null as int) + cast({b} is not null as int)) * {step}, 0)"


def up_sql(value: str) -> str:
    w = "(partition by i, j order by level)"
    return f"(coalesce(lead({value}) over {w}, {value}) - coalesce(lag({value}) over {w}, {value})) / nullif(coalesce(lead(h) over {w}, h) - coalesce(lag(h) over {w}, h), 0)"


TURN = "radians(7.0)"


@query(f"""with {SPACE}, a as (select *, z - avg(z) over (partition by level, i) as za, 4 * pi() / 86400 * sin(radians(lat)) as f, -8000 * ln(p / 1000) as h, t * pow(1000 / p, 0.286) as theta from sp),
b as (select *, za * 9.80665 / f as psi from a), b1 as (select *, {slope_sql("psi", "j", TURN, 8)} as x, {slope_sql("psi", "i", TURN)} as y, {up_sql("psi")} as zz, {up_sql("theta")} as tz from b),
b2 as (select *, {slope_sql("x", "j", TURN, 8)} as xx, {slope_sql("x", "i", TURN)} as xy, {slope_sql("y", "i", TURN)} as yy, {up_sql("x")} as xz, {up_sql("y")} as yz from b1),
c as (select *, sqrt(u * u + v * v) as speed, case when 290 * pow(p / 1000, 0.286) / 8000 * tz > 0 then 290 * pow(p / 1000, 0.286) / 8000 * tz end as nn, cos(radians(lat)) as cosine from b2)
select i, j, level, case when u >= 5 then round(p / 1000 / (2 * speed * 6378388.0 * 6378388.0) * (u / cosine * (x * x - psi * xx) + v * (x * y - psi * xy)), 5) end as fx,
case when u >= 5 then round(p / 1000 / (2 * speed * 6378388.0 * 6378388.0) * (u * (x * y - psi * xy) + cosine * v * (y * y - psi * yy)), 5) end as fy,
case when u >= 5 then round(100 * p / 1000 * f * f / (2 * speed * nn * 6378388.0) * (u * (x * zz - psi * xz) + cosine * v * (y * zz - psi * yz)), 5) end as fz from c""")
def wave_flux(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flux of stationary wave activity of the departures from zonal means."""
    rows = space(spark, sf_dir).withColumn("za", F.col("z") - F.avg("z").over(Window.partitionBy("level", "i")))
    rows = sphere.wave_activity_flux(rows, "za", "u", "v", "t", 7.0, 8)
    return rows.select("i", "j", "level", r("fx", 5).alias("fx"), r("fy", 5).alias("fy"), r(100 * F.col("fz"), 5).alias("fz"))


AIR = """
air as (
  select cast(o_custkey % 4 as integer) as i, cast((o_custkey // 4) % 6 as integer) as j, 10.0 + 5.0 * (o_custkey % 4) as lat, 5.0 * ((o_custkey // 4) % 6) as lon, cast(substr(o_orderpriority, 1, 1) as integer) as level, cast(year(o_orderdate) as integer) as year,
         1050.0 - 150 * cast(substr(o_orderpriority, 1, 1) as integer) as p, 220 + avg(o_totalprice) / 5000 + 5.0 * cast(substr(o_orderpriority, 1, 1) as integer) as t, avg(o_totalprice) / 20000 as u,
         avg(o_totalprice * case when o_orderstatus = 'F' then 1 else -1 end) / 20000 as v, avg(o_totalprice * case when o_orderstatus = 'O' then 1 else -1 end) / 1000000 as omega, avg(o_totalprice) / 20000000 as q
  from orders group by 1, 2, 3, 4, 5, 6, 7)
"""


def air_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field over years, levels and places, of temperature, wind and moisture."""
    price, i, j, level = F.col("o_totalprice"), F.col("o_custkey") % 4, F.floor(F.col("o_custkey") / 4) % 6, F.expr(LEVEL)
    signed = lambda s: F.avg(price * F.when(F.col("o_orderstatus") == s, 1).otherwise(-1))
    cell = [i.cast("int").alias("i"), j.cast("int").alias("j"), (10.0 + 5.0 * i).alias("lat"), (5.0 * j).alias("lon"), level.alias("level"), F.year("o_orderdate").alias("year"), (1050.0 - 150 * level).alias("p")]
    g = table(spark, sf_dir, "orders").groupBy(*cell).agg(F.avg(price).alias("_m"), (signed("F") / 20000).alias("v"), (signed("O") / 1000000).alias("omega"))
    return g.withColumns({"t": 220 + F.col("_m") / 5000 + 5.0 * F.col("level"), "u": F.col("_m") / 20000, "q": F.col("_m") / 20000000}).drop("_m")


#: Metres of a degree, specific heat, gas constant and heat of evaporation.
DEGREE, CP, GAS, EVAPORATION = math.radians(1) * 6371000.0, 1004.0, 287.0, 2.5e6


def heat_budget(rows: DataFrame, time: str, seconds: float) -> DataFrame:
    """Apparent heat source and moisture sink, in W a kg, and the terms of the
    first: change with ``time`` (steps of so many ``seconds``), advection along
    both axes in metres, and vertical transport. Rows have i, j, lat, lon, level,
    p (hPa), t, u, v, omega (Pa a second) and q (kg a kg). Differences are of
    second order, one-sided at the ends; one shuffle a dimension."""
    kappa = GAS / CP
    lift = F.pow(F.col("p") / 1000, kappa)
    rows = rows.withColumns({"_s": F.col(time) * F.lit(float(seconds)), "_x": F.col("lon") * DEGREE * F.cos(F.radians("lat")), "_y": F.col("lat") * DEGREE, "theta": F.col("t") / lift})
    for axis, by in (("_s", ["i", "j", "level"]), ("_x", ["i", "level", time]), ("_y", ["j", "level", time]), ("p", ["i", "j", time])):
        rows = rows.withColumns({f"{v}{axis}": st.gradient(v, axis, by) for v in ("theta", "q")})
    flow = lambda c: F.col("u") * F.col(f"{c}_x") + F.col("v") * F.col(f"{c}_y")
    rise = lambda c: F.col("omega") / 100 * F.col(f"{c}p")
    change, carried, raised = CP * lift * F.col("theta_s"), CP * lift * flow("theta"), CP * lift * rise("theta")
    return rows.withColumns({"change": change, "advection": carried, "vertical": raised, "q1": change + carried + raised, "q2": -EVAPORATION * (F.col("q_s") + flow("q") + rise("q"))})


MONTH = 30 * 24 * 3600


@query(f"""with {AIR}, a as (select *, t * pow(1000 / p, 287.0 / 1004) as theta, year * {MONTH}.0 as s, radians(lon) * 6371000 * cos(radians(lat)) as x, radians(lat) * 6371000 as y from air),
g as (select *, {gradient_sql("theta", "s", "i, j, level")} as ts, {gradient_sql("theta", "x", "i, level, year")} as tx, {gradient_sql("theta", "y", "j, level, year")} as ty, {gradient_sql("theta", "p", "i, j, year")} as tp,
 {gradient_sql("q", "s", "i, j, level")} as qs, {gradient_sql("q", "x", "i, level, year")} as qx, {gradient_sql("q", "y", "j, level, year")} as qy, {gradient_sql("q", "p", "i, j, year")} as qp from a),
h as (select i, j, level, year, 1004 * pow(p / 1000, 287.0 / 1004) * ts as change, 1004 * pow(p / 1000, 287.0 / 1004) * (u * tx + v * ty) as advection, 1004 * pow(p / 1000, 287.0 / 1004) * omega / 100 * tp as vertical, -2.5e6 * (qs + u * qx + v * qy + omega / 100 * qp) as q2 from g)
select i, j, level, year, round(1000 * change, 4) as change, round(1000 * advection, 4) as advection, round(1000 * vertical, 4) as vertical, round(1000 * (change + advection + vertical), 4) as q1, round(1000 * q2, 4) as q2 from h""")
def heat_budget_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apparent heat source and moisture sink in three dimensions, in mW a kg."""
    rows = heat_budget(air_columns(spark, sf_dir), "year", MONTH)
    return rows.select("i", "j", "level", "year", *[r(1000 * F.col(c), 4).alias(c) for c in ("change", "advection", "vertical", "q1", "q2")])


def on_surfaces(rows: DataFrame, by: list[str], order: str, coordinate: str, values: list[str], targets: list[float]) -> DataFrame:
    """``values`` where ``coordinate`` takes each of ``targets``, linear between
    neighbours in ``order``. A profile may turn back: the first crossing counts.
    No row for a target outside the profile."""
    w = Window.partitionBy(*by).orderBy(order)
    rows = rows.dropna(subset=[coordinate]).withColumns({f"_{c}": F.lead(c).over(w) for c in (coordinate, *values)})
    a, b = F.col(coordinate), F.col(f"_{coordinate}")
    hit = F.filter(F.array(*map(F.lit, targets)), lambda x: (x >= F.least(a, b)) & (x <= F.greatest(a, b)) & b.isNotNull())
    rows = rows.withColumn("target", F.explode(hit)).withColumn("_share", F.coalesce(F.try_divide(F.col("target") - a, b - a), F.lit(0.0)))
    first = F.min(F.struct(F.col(order).alias("o"), *[(F.col(c) + (F.col(f"_{c}") - F.col(c)) * F.col("_share")).alias(c) for c in values]))
    return rows.groupBy(*by, "target").agg(first.alias("_first")).select(*by, "target", *[F.col(f"_first.{c}").alias(c) for c in values])


SURFACES = [250.0, 262.0, 275.0, 290.0, 310.0]


@query(f"""with {AIR}, a as (select i, j, year, level, p, u, v, t * pow(1000 / p, 0.286) as theta from air), k as (select *, lead(theta) over w as theta1, lead(p) over w as p1, lead(u) over w as u1, lead(v) over w as v1 from a window w as (partition by i, j, year order by level)),
s as (select unnest({SURFACES}) as target), m as (select *, case when theta1 = theta then 0 else (target - theta) / (theta1 - theta) end as share, row_number() over (partition by i, j, year, target order by level) as nth from k join s on target between least(theta, theta1) and greatest(theta, theta1))
select i, j, year, cast(target as double) as target, round(p + (p1 - p) * share, 4) as p, round(u + (u1 - u) * share, 5) as u, round(v + (v1 - v) * share, 5) as v from m where nth = 1""")
def isentropic_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pressure and wind on surfaces of potential temperature, the lowest where a
    surface is crossed more than once."""
    rows = air_columns(spark, sf_dir).withColumn("theta", F.col("t") * F.pow(1000 / F.col("p"), 0.286))
    out = on_surfaces(rows, ["i", "j", "year"], "level", "theta", ["p", "u", "v"], SURFACES)
    return out.select("i", "j", "year", "target", r("p", 4).alias("p"), r("u", 5).alias("u"), r("v", 5).alias("v"))
