"""Queries on a wind and height field (cells of the customers of orders) and on
vertical profiles (line numbers as pressure levels)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import air
from ..operators import sphere, statistics as st
from .base import query, r, table

WIND = """
w as (
  select cast(o_custkey % 12 as integer) as i, cast((o_custkey // 12) % 24 as integer) as j, -57.5 + 10.0 * (o_custkey % 12) as lat,
         avg(o_totalprice) / 10000 as u, avg(o_totalprice * case when o_orderstatus = 'F' then 1 else -1 end) / 10000 as v, avg(o_totalprice) / 20 as z
  from orders group by 1, 2, 3),
nb as (
  select a.*, e.u as ue, e.v as ve, e.z as ze, x.u as uw, x.v as vw, x.z as zw, n.u as un, n.v as vn, n.z as zn, s.u as us, s.v as vs, s.z as zs
  from w a left join w e on e.i = a.i and e.j = (a.j + 1) % 24 left join w x on x.i = a.i and x.j = (a.j + 23) % 24
  left join w n on n.j = a.j and n.i = a.i + 1 left join w s on s.j = a.j and s.i = a.i - 1)
"""
#: Metres of two places of ten degrees northward; of fifteen eastward.
DY, DX = "(2 * radians(10.0) * 6.371e6)", "(2 * radians(10.0) * 6.371e6 * cos(radians(lat)))"


def wind(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, sign = F.col("o_totalprice"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(-1)
    i = F.col("o_custkey") % 12
    cell = [i.cast("int").alias("i"), (F.floor(F.col("o_custkey") / 12) % 24).cast("int").alias("j"), (-57.5 + 10.0 * i).alias("lat")]
    return table(spark, sf_dir, "orders").groupBy(*cell).agg((F.avg(price) / 10000).alias("u"), (F.avg(price * sign) / 10000).alias("v"), (F.avg(price) / 20).alias("z"))


@query(f"""with {WIND} select i, j, round(1e6 * ((ue - uw) / {DX} + (vn - vs) / {DY} - v * tan(radians(lat)) / 6.371e6), 5) as divergence, round(1e6 * ((ve - vw) / {DX} - (un - us) / {DY} + u * tan(radians(lat)) / 6.371e6), 5) as vorticity from nb""")
def divergence_vorticity(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = wind(spark, sf_dir)
    div, vor = sphere.divergence_vorticity(w, "u", "v", 10.0, 24)
    return w.select("i", "j", r(1e6 * div, 5).alias("divergence"), r(1e6 * vor, 5).alias("vorticity"))


@query(f"""with {WIND} select i, j, round(1e6 * (ue - uw) / {DX}, 5) as east, round(1e6 * (un - us) / {DY}, 5) as north from nb""")
def lat_lon_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = wind(spark, sf_dir)
    east, north = sphere.differences(w, "u", 10.0, 24)
    return w.select("i", "j", r(1e6 * east, 5).alias("east"), r(1e6 * north, 5).alias("north"))


@query(f"""with {WIND} select i, j, round(1e4 * 2 * 7.292e-5 * sin(radians(lat)), 6) as f, round(-9.81 * ((zn - zs) / {DY}) / (2 * 7.292e-5 * sin(radians(lat))), 4) as ug, round(9.81 * ((ze - zw) / {DX}) / (2 * 7.292e-5 * sin(radians(lat))), 4) as vg from nb""")
def geostrophic_wind(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = wind(spark, sf_dir)
    u, v = sphere.geostrophic_wind(w, "z", 10.0, 24)
    return w.select("i", "j", r(1e4 * air.coriolis(F.col("lat"))).alias("f"), r(u, 4).alias("ug"), r(v, 4).alias("vg"))


@query(f"""with {WIND}, d as (select a.i, a.j, a.z, a.z / 4 + (b.e + b.x + b.n + b.s) / 8 + (b.ne + b.nw + b.se + b.sw) / 16 as m from w a left join
 (select a.i, a.j, e.z as e, x.z as x, n.z as n, s.z as s, ne.z as ne, nw.z as nw, se.z as se, sw.z as sw from w a left join w e on e.i = a.i and e.j = (a.j + 1) % 24 left join w x on x.i = a.i and x.j = (a.j + 23) % 24
  left join w n on n.i = a.i + 1 and n.j = a.j left join w s on s.i = a.i - 1 and s.j = a.j left join w ne on ne.i = a.i + 1 and ne.j = (a.j + 1) % 24 left join w nw on nw.i = a.i + 1 and nw.j = (a.j + 23) % 24
  left join w se on se.i = a.i - 1 and se.j = (a.j + 1) % 24 left join w sw on sw.i = a.i - 1 and sw.j = (a.j + 23) % 24) b on b.i = a.i and b.j = a.j)
select i, j, round(coalesce(m, z), 3) as smooth from d""")
def nine_point_smoother(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sphere.with_nine_point(wind(spark, sf_dir), "z", "smooth", 24).select("i", "j", r("smooth", 3).alias("smooth"))


@query(f"""with {WIND}, k as (select unnest(generate_series(-4, 4)) as k), a as (select w.i, w.j, exp(-k * k / 2.0) as g, ((w.i + k) % 24 + 24) % 24 as t from w, k), b as (select a.i, a.j, sum(g * w.z) / sum(g) as z from a join w on w.j = a.j and w.i = case when t < 12 then t else 23 - t end group by 1, 2),
c as (select b.i, b.j, exp(-k * k / 2.0) as g, ((b.j + k) % 48 + 48) % 48 as t from b, k) select c.i, c.j, round(sum(g * b.z) / sum(g), 3) as smooth from c join b on b.i = c.i and b.j = case when t < 24 then t else 47 - t end group by 1, 2""")
def gaussian_smoother(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sphere.gaussian(wind(spark, sf_dir), "z", "i", 12, 1.0, ["i", "j"])
    return sphere.gaussian(rows, "z", "j", 24, 1.0, ["i", "j"]).select("i", "j", r("z", 3).alias("smooth"))


PROFILE = """
pr as (
  select cast(l_suppkey % 10 as integer) as unit, cast(l_linenumber as integer) as level, 1100.0 - 100 * l_linenumber as p, cast(year(l_shipdate) as integer) as year,
         220 + avg(l_quantity) + 8 * (7 - l_linenumber) as t, avg(l_discount) * 200 as u, avg(l_tax) / 10 as q, avg(l_discount - l_tax) as omega
  from lineitem group by l_suppkey % 10, l_linenumber, year(l_shipdate)),
mean as (select unit, level, p, avg(t) as t, avg(u) as u, avg(q) as q, avg(omega) as omega from pr group by 1, 2, 3)
"""


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 10).cast("int").alias("unit"), n.cast("int").alias("level"), F.year("l_shipdate").alias("year"))
    rows = rows.agg(F.avg("l_quantity").alias("_t"), (F.avg("l_discount") * 200).alias("u"), (F.avg("l_tax") / 10).alias("q"), F.avg(F.col("l_discount") - F.col("l_tax")).alias("omega"))
    return rows.withColumns({"p": 1100.0 - 100 * F.col("level"), "t": 220 + F.col("_t") + 8 * (7 - F.col("level"))}).drop("_t")


def mean_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles(spark, sf_dir).groupBy("unit", "level", "p").agg(*[F.avg(c).alias(c) for c in ("t", "u", "q", "omega")])


def gradient_sql(value: str, coordinate: str, by: str) -> str:
    w = f"(partition by {by} order by {coordinate})"
    f0, f2, h1, h2 = f"lag({value}) over {w}", f"lead({value}) over {w}", f"({coordinate} - lag({coordinate}) over {w})", f"(lead({coordinate}) over {w} - {coordinate})"
    return f"case when {f0} is null then ({f2} - {value}) / {h2} when {f2} is null then ({value} - {f0}) / {h1} else ({h1} * {h1} * {f2} + ({h2} * {h2} - {h1} * {h1}) * {value} - {h2} * {h2} * {f0}) / ({h1} * {h2} * ({h1} + {h2})) end"


@query(f"""with {PROFILE}, x as (select *, t * pow(1000 / p, 0.286) as theta from pr), g as (select unit, level, year, p, u, omega, {gradient_sql("t", "year", "unit, level")} as tt, {gradient_sql("t", "unit", "level, year")} as tx, {gradient_sql("theta", "p", "unit, year")} as tp, {gradient_sql("q", "year", "unit, level")} as qt, {gradient_sql("q", "unit", "level, year")} as qx, {gradient_sql("q", "p", "unit, year")} as qp from x)
select unit, level, year, round(1.004 * (tt + u * tx + pow(p / 1000, 0.286) * omega * tp), 4) as q1, round(-2500 * (qt + u * qx + omega * qp), 4) as q2 from g""")
def heat_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apparent heat source and moisture sink: local change, advection along one
    axis, and the vertical term."""
    rows = profiles(spark, sf_dir).withColumn("theta", F.col("t") * F.pow(1000 / F.col("p"), 0.286))
    d = lambda v, c, by: st.gradient(v, c, by)
    rows = rows.withColumns({"tt": d("t", "year", ["unit", "level"]), "tx": d("t", "unit", ["level", "year"]), "tp": d("theta", "p", ["unit", "year"]), "qt": d("q", "year", ["unit", "level"]), "qx": d("q", "unit", ["level", "year"]), "qp": d("q", "p", ["unit", "year"])})
    q1 = 1.004 * (F.col("tt") + F.col("u") * F.col("tx") + F.pow(F.col("p") / 1000, 0.286) * F.col("omega") * F.col("tp"))
    q2 = -2500 * (F.col("qt") + F.col("u") * F.col("qx") + F.col("omega") * F.col("qp"))
    return rows.select("unit", "level", "year", r(q1, 4).alias("q1"), r(q2, 4).alias("q2"))


@query(f"""with {PROFILE}, x as (select *, lead(p) over w as p1, lead(q) over w as q1, lead(u) over w as u1 from mean window w as (partition by unit order by level))
select unit, round(sum((q + q1) / 2 * (p - p1)) * 100 / 9.81, 4) as water, round(sum((q * u + q1 * u1) / 2 * (p - p1)) * 100 / 9.81, 3) as flux from x where p1 is not null group by 1""")
def column_integral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trapezoids between pressure levels (hPa)."""
    w = Window.partitionBy("unit").orderBy("level")
    nxt = {f"{c}1": F.lead(c).over(w) for c in ("p", "q", "u")}
    rows = mean_profiles(spark, sf_dir).withColumns(nxt).where("p1 is not null")
    depth = (F.col("p") - F.col("p1")) * 100 / air.GRAVITY
    return rows.groupBy("unit").agg(r(F.sum((F.col("q") + F.col("q1")) / 2 * depth), 4).alias("water"), r(F.sum((F.col("q") * F.col("u") + F.col("q1") * F.col("u1")) / 2 * depth), 3).alias("flux"))


@query(f"""with {PROFILE}, x as (select *, lead(p) over w as p1, lead(t) over w as t1 from mean window w as (partition by unit order by level)), g as (select unnest([950.0, 850.0, 725.0, 455.0]) as target)
select unit, cast(target as double) as target, round(t + (t1 - t) * ln(target / p) / ln(p1 / p), 5) as t from x, g where target < p and target >= p1""")
def pressure_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear in the log of pressure; no row outside a profile. Levels are looked
    up by windows, not by pairs."""
    w = Window.partitionBy("unit").orderBy("level")
    rows = mean_profiles(spark, sf_dir).withColumns({"p1": F.lead("p").over(w), "t1": F.lead("t").over(w)}).where("p1 is not null")
    rows = rows.withColumn("target", F.explode(F.filter(F.array(*map(F.lit, [950.0, 850.0, 725.0, 455.0])), lambda x: (x < F.col("p")) & (x >= F.col("p1")))))
    return rows.select("unit", "target", r(F.col("t") + (F.col("t1") - F.col("t")) * F.log(F.col("target") / F.col("p")) / F.log(F.col("p1") / F.col("p")), 5).alias("t"))


@query(f"""with {PROFILE}, x as (select *, lag(p) over w as p0, lag(u) over w as u0 from mean window w as (partition by unit order by level desc))
select unit, level, round(sum(coalesce((u + u0) / 2 * (p - p0) * 100, 0)) over (partition by unit order by level desc rows unbounded preceding) * 2 * pi() * 6.371e6 * cos(radians(unit * 8.0)) / 9.81 / 1e10, 5) as psi from x""")
def mass_streamfunction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative transport from the top down."""
    w = Window.partitionBy("unit").orderBy(F.desc("level"))
    rows = mean_profiles(spark, sf_dir).withColumns({"p0": F.lag("p").over(w), "u0": F.lag("u").over(w)})
    layer = F.coalesce((F.col("u") + F.col("u0")) / 2 * (F.col("p") - F.col("p0")) * 100, F.lit(0.0))
    rows = rows.withColumn("layer", layer).withColumn("sum", F.sum("layer").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    import math

    return rows.select("unit", "level", r(F.col("sum") * (2 * math.pi * air.EARTH_M) * F.cos(F.radians(F.col("unit") * 8.0)) / air.GRAVITY / 1e10, 5).alias("psi"))


@query(f"""with {PROFILE}, x as (select *, ln(t * pow(1000 / p, 0.2854)) as lt from mean), g as (select unit, level, p, t, u, {gradient_sql("lt", "p", "unit")} as s, {gradient_sql("t", "unit", "level")} as ty, {gradient_sql("u", "unit", "level")} as uy, 2 * 7.292e-5 * sin(radians(unit * 8.0 + 4)) as f from x)
select unit, level, round(-t * s, 6) as static_stability, round(-287.0 / f * ln(1000.0 / 850) * ty / (radians(8.0) * 6.371e6), 4) as thermal_wind, round(-9.81 * (f - uy / (radians(8.0) * 6.371e6)) * (s * t * pow(1000 / p, 0.2854)) / 100 * 1e6, 4) as pv from g""")
def stability_thermal_wind_pv(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mean_profiles(spark, sf_dir).withColumn("lt", F.log(F.col("t") * F.pow(1000 / F.col("p"), air.KAPPA)))
    rows = rows.withColumns({"s": st.gradient("lt", "p", ["unit"]), "ty": st.gradient("t", "unit", ["level"]), "uy": st.gradient("u", "unit", ["level"]), "f": air.coriolis(F.col("unit") * 8.0 + 4)})
    import math

    metre = math.radians(8.0) * air.EARTH_M
    thermal = -air.R_DRY / F.col("f") * math.log(1000.0 / 850) * F.col("ty") / metre
    pv = -air.GRAVITY * (F.col("f") - F.col("uy") / metre) * (F.col("s") * F.col("t") * F.pow(1000 / F.col("p"), air.KAPPA)) / 100 * 1e6
    return rows.select("unit", "level", r(-F.col("t") * F.col("s")).alias("static_stability"), r(thermal, 4).alias("thermal_wind"), r(pv, 4).alias("pv"))


@query("""with x as (select p_partkey, 255.0 + p_size as t, 20.0 + p_size * 1.5 as rh, 1000.0 - p_size * 5 as p, p_size * 7.0 as dir, p_retailprice / 100.0 as spd, p_size / 2.0 as ship, (p_partkey * 11) % 360 as heading, p_size / 10.0 - 2.5 as anomaly from part),
y as (select *, rh / 100 * 6.112 * exp(17.67 * (t - 273.15) / (t - 29.65)) as e, 1 / (1 / (t - 55) - ln(rh / 100) / 2840) + 55 as lcl, spd * sin(radians(dir)) + ship * 0.2777 * sin(radians(heading)) as tu, spd * cos(radians(dir)) + ship * 0.2777 * cos(radians(heading)) as tv from x), z as (select *, 0.622 * e / (p - e) as w from y)
select p_partkey, round(lcl, 5) as lcl, round(w, 8) as mixing_ratio, round(t * pow(1000 / p, 0.2854 * (1 - 0.28 * w)) * exp((3.376 / lcl - 0.00254) * 1000 * w * (1 + 0.81 * w)), 4) as theta_e, round(-0.5 * 287.0 * t / (p * 100 * 9.81), 7) as w_up, round(sqrt(tu * tu + tv * tv), 5) as true_speed,
round(((degrees(atan2(tu, tv)) % 360) + 360) % 360, 3) as true_direction, round((((270 - degrees(atan2(tv, tu))) % 360) + 360) % 360, 3) as from_direction, case when anomaly >= 0.5 then 'warm' when anomaly <= -0.5 then 'cold' else 'neutral' end as phase, round(case when median(t - 273.15) over () > 200 then t - 273.15 else t - 273.15 + 273.15 end, 4) as kelvin from z""")
def thermodynamics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, key = F.col("p_size"), F.col("p_partkey")
    x = table(spark, sf_dir, "part").select("p_partkey", (255.0 + s).alias("t"), (20.0 + s * 1.5).alias("rh"), (1000.0 - s * 5).alias("p"), (s * 7.0).alias("dir"), (F.col("p_retailprice") / 100).alias("spd"), (s / 2).alias("ship"), ((key * 11) % 360).alias("heading"), (s / 10 - 2.5).alias("anomaly"))
    median = x.agg(F.median(F.col("t") - 273.15).alias("median"))  # one row
    t, p, rh = F.col("t"), F.col("p"), F.col("rh")
    w, lcl = air.mixing_ratio(p, t, rh), air.lcl_temperature(t, rh)
    speed, direction = air.true_wind(F.col("spd"), F.col("dir"), F.col("ship"), F.col("heading"))
    tu = F.col("spd") * F.sin(F.radians("dir")) + F.col("ship") * 0.2777 * F.sin(F.radians("heading"))
    tv = F.col("spd") * F.cos(F.radians("dir")) + F.col("ship") * 0.2777 * F.cos(F.radians("heading"))
    return x.join(F.broadcast(median)).select(
        "p_partkey", r(lcl, 5).alias("lcl"), r(w, 8).alias("mixing_ratio"), r(air.equivalent_potential_temperature(p, t, w, lcl), 4).alias("theta_e"), r(air.omega_to_w(F.lit(0.5), p * 100, t), 7).alias("w_up"), r(speed, 5).alias("true_speed"),
        r(direction, 3).alias("true_direction"), r(air.direction_from(tu, tv), 3).alias("from_direction"), air.enso_phase(F.col("anomaly")).alias("phase"), r(air.kelvin(t - 273.15, F.col("median")), 4).alias("kelvin"),
    )
