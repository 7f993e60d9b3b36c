"""Gridded-field queries: trends, tests, climatologies, calculus."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import signal, sphere, statistics as st
from ..operators.windows import Ordered
from .base import BARS, CELL_YEAR, GRID, MONTHLY, bars, by_cell_year, grid, query, r, table

CELL = ["lat", "lon"]


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    m = o.groupBy(F.trunc("o_orderdate", "month").alias("month")).agg(F.avg("o_totalprice").alias("value"), F.count("*").alias("n"))
    return m.withColumn("t", F.row_number().over(Window.orderBy("month")))  # a row a month


@query(f"""with {CELL_YEAR} select lat, lon, round(regr_slope(value, year), 4) as slope, round(corr(value, year), 6) as r, count(*) as n from cells group by 1, 2""")
def trend_slope_r(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.trend(by_cell_year(spark, sf_dir), CELL, "year", "value").select("lat", "lon", r("slope", 4).alias("slope"), r("r").alias("r"), "n")


# The t distribution of whole degrees of freedom is a finite sum of powers of cosines.
@query(f"""with {CELL_YEAR}, f as (select lat, lon, regr_slope(value, year) as k, corr(value, year) as r, count(*) - 2 as nu from cells group by 1, 2), a as (select *, case when nu > 0 and r * r < 1 then atan(abs(r) / sqrt(1 - r * r)) end as h from f),
s as (select *, list_sum(list_transform(range(0, (nu - nu % 2) // 2), lambda i: pow(cos(h), 2 * i) * coalesce(list_product(list_transform(range(1, i + 1), lambda j: case when nu % 2 = 1 then 2.0 * j / (2 * j + 1) else (2.0 * j - 1) / (2 * j) end)), 1.0))) as total from a)
select lat, lon, round(k, 4) as slope, round(1 - case when nu % 2 = 1 then 2 / pi() * (h + sin(h) * cos(h) * coalesce(total, 0.0)) else sin(h) * total end, 6) as p from s""")
def trend_pvalue(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = st.trend(by_cell_year(spark, sf_dir), CELL, "year", "value")
    return t.select("lat", "lon", r("slope", 4).alias("slope"), r(st.t_two_sided("t", (F.col("n") - 2).cast("double"))).alias("p"))


@query(f"""with {CELL_YEAR}, f as (select lat, lon, regr_slope(value, year) as k, regr_intercept(value, year) as b from cells group by 1, 2)
select lat, lon, year, round(value - (k * year + b), 4) as residual from cells join f using (lat, lon)""")
def detrend(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy(*CELL)
    line = F.regr_intercept("value", "year").over(w) + F.regr_slope("value", "year").over(w) * F.col("year")
    return by_cell_year(spark, sf_dir).select("lat", "lon", "year", r(F.col("value") - line, 4).alias("residual"))


@query(f"""with {GRID}, s as (select lat, lon, avg(value) filter (month < '1998-01-01') as ma, avg(value) filter (month >= '1998-01-01') as mb, var_samp(value) filter (month < '1998-01-01') as va, var_samp(value) filter (month >= '1998-01-01') as vb,
 count(value) filter (month < '1998-01-01') as na, count(value) filter (month >= '1998-01-01') as nb from grid group by 1, 2)
select lat, lon, round(ma - mb, 4) as diff, round((ma - mb) / sqrt(va / na + vb / nb), 6) as t, round(pow(va / na + vb / nb, 2) / (pow(va / na, 2) / (na - 1) + pow(vb / nb, 2) / (nb - 1)), 4) as df from s where na > 1 and nb > 1 and va + vb > 0""")
def welch_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    early = F.col("month") < "1998-01-01"
    part = lambda fn, c: fn(F.when(c, F.col("value")))
    s = grid(spark, sf_dir).groupBy(*CELL).agg(*[part(fn, c).alias(f"{k}_{p}") for p, c in (("a", early), ("b", ~early)) for k, fn in (("m", F.avg), ("v", F.var_samp), ("n", F.count))])
    t, df = st.welch("a", "b")
    return s.where("n_a > 1 and n_b > 1 and v_a + v_b > 0").select("lat", "lon", r(F.col("m_a") - F.col("m_b"), 4).alias("diff"), r(t).alias("t"), r(df, 4).alias("df"))


@query(f"""with {CELL_YEAR}, d as (select a.lat, a.lon, a.value - b.value as d from cells a join cells b on a.lat = b.lat and a.lon = b.lon and b.year = a.year - 1)
select lat, lon, count(*) as n, round(avg(d), 4) as mean_diff, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 6) as t from d group by 1, 2""")
def paired_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = by_cell_year(spark, sf_dir)
    b = a.select("lat", "lon", (F.col("year") + 1).alias("year"), F.col("value").alias("before"))
    d = a.join(b, [*CELL, "year"]).withColumn("d", F.col("value") - F.col("before"))
    t = F.try_divide(F.avg("d"), F.stddev_samp("d") / F.sqrt(F.count("*")))
    return d.groupBy(*CELL).agg(F.count("*").alias("n"), r(F.avg("d"), 4).alias("mean_diff"), r(t).alias("t"))


@query(f"""with {CELL_YEAR}, p as (select a.lat, a.lon, sign(b.value - a.value) as g, (b.value - a.value) / (b.year - a.year) as k from cells a join cells b on a.lat = b.lat and a.lon = b.lon and b.year > a.year),
n as (select lat, lon, count(*) as n from cells group by 1, 2), s as (select lat, lon, sum(g) as s, median(k) as sen from p group by 1, 2)
select lat, lon, cast(n as integer) as n, cast(s as double) as s, round(case when s > 0 then (s - 1) / sqrt(n * (n - 1) * (2 * n + 5) / 18.0) when s < 0 then (s + 1) / sqrt(n * (n - 1) * (2 * n + 5) / 18.0) else 0.0 end, 6) as z, round(sen, 4) as sen from s join n using (lat, lon)""")
def mann_kendall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.mann_kendall(by_cell_year(spark, sf_dir), CELL, "year", "value").select("lat", "lon", "n", F.col("S").alias("s"), r("z").alias("z"), r("sen", 4).alias("sen")).where("n > 1")


AREA = "cos(radians(lat * 5.0))"


@query(f"""with {GRID} select month, round(sum(value * {AREA}) / sum({AREA}), 4) as area_mean, round(avg(value) filter (lat < 6), 4) as south, round(stddev_pop(value), 4) as spread from grid group by 1""")
def area_weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.cos(F.radians(F.col("lat") * 5.0))
    return grid(spark, sf_dir).groupBy("month").agg(r(st.weighted_mean("value", w), 4).alias("area_mean"), r(F.avg(F.when(F.col("lat") < 6, F.col("value"))), 4).alias("south"), r(F.stddev_pop("value"), 4).alias("spread"))


PAIR = f"{CELL_YEAR}, pair as (select a.lat, a.lon, a.value as x, b.value as y, cos(radians(a.lat * 10.0)) as w, a.year from cells a join cells b using (lat, lon) where b.year = a.year + 1)"


def _pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = by_cell_year(spark, sf_dir).withColumnRenamed("value", "x")
    b = by_cell_year(spark, sf_dir).select("lat", "lon", (F.col("year") - 1).alias("year"), F.col("value").alias("y"))
    return a.join(b, [*CELL, "year"]).withColumn("w", F.cos(F.radians(F.col("lat") * 10.0)))


@query(f"""with {PAIR}, k as (select *, rank() over (partition by year order by x) + (count(*) over (partition by year, x) - 1) / 2.0 as rx, rank() over (partition by year order by y) + (count(*) over (partition by year, y) - 1) / 2.0 as ry from pair),
f as (select year, sum(w) as n, sum(x * w) / sum(w) as mx, sum(y * w) / sum(w) as my, sum(rx * w) / sum(w) as mrx, sum(ry * w) / sum(w) as mry from k group by 1)
select year, round(sum(w * (x - mx) * (y - my)) / sqrt(sum(w * (x - mx) * (x - mx)) * sum(w * (y - my) * (y - my))), 5) as pearson,
 round(sum(w * (rx - mrx) * (ry - mry)) / sqrt(sum(w * (rx - mrx) * (rx - mrx)) * sum(w * (ry - mry) * (ry - mry))), 5) as spearman, round(sum(w) * sum(w) / sum(w * w), 4) as n_eff from k join f using (year) group by 1""")
def weighted_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _pair(spark, sf_dir)
    k = k.withColumns({"rx": st.average_rank("x", ["year"]), "ry": st.average_rank("y", ["year"])})
    eff = F.sum("w") * F.sum("w") / F.sum(F.col("w") * F.col("w"))
    out = k.groupBy("year").agg(r(eff, 4).alias("n_eff"))
    for x, y, name in (("x", "y", "pearson"), ("rx", "ry", "spearman")):
        out = out.join(st.weighted_corr(k, ["year"], x, y, "w", name).withColumn(name, r(name, 5)), "year")
    return out


@query(f"""with {CELL_YEAR}, x as (select year, value, cos(radians(lat * 10.0)) as w from cells), p as (select year, value, sum(w) over (partition by year order by value, w rows unbounded preceding) / sum(w) over (partition by year) as p, w from x),
q as (select *, lag(p) over (partition by year order by value, w) as p0, lag(value) over (partition by year order by value, w) as v0 from p)
select year, round(min(struct_pack(p := p, v := case when p0 is null then value else v0 + (value - v0) * (0.75 - p0) / (p - p0) end)).v, 4) as q75 from q where p >= 0.75 group by 1""")
def weighted_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = by_cell_year(spark, sf_dir).withColumn("w", F.cos(F.radians(F.col("lat") * 10.0)))
    return st.weighted_quantile(x, ["year"], "value", "w", 0.75).select("year", r("quantile", 4).alias("q75"))


@query(f"""with {PAIR} select lat, corr(x, y) * 0 + round((corr(x, y) - corr(x, year) * corr(y, year)) / sqrt((1 - corr(x, year) * corr(x, year)) * (1 - corr(y, year) * corr(y, year))), 5) as partial_r, round(corr(x, y), 6) as r from pair group by 1""")
def partial_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    xy, xz, yz = F.corr("x", "y"), F.corr("x", "year"), F.corr("y", "year")
    return _pair(spark, sf_dir).groupBy("lat").agg(r((xy - xz * yz) / F.sqrt((1 - xz * xz) * (1 - yz * yz)), 5).alias("partial_r"), r(xy).alias("r"))


@query(f"""with {MONTHLY}, c as (select avg(value) as m, count(*) as n from monthly), a as (select k, sum((x.value - m) * (y.value - m)) as s from (select unnest(generate_series(0, 5)) as k) g, c, monthly x join monthly y on y.t = x.t + k group by 1)
select cast(k as integer) as lag, round(s / (select s from a where k = 0), 6) as acf from a""")
def autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = monthly(spark, sf_dir)
    x = m.select("t", (F.col("value") - F.avg("value").over(Window.partitionBy())).alias("d"))
    lags = x.select("d", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("lag"), "t").withColumn("t", F.col("t") + F.col("lag"))
    s = lags.join(x.withColumnRenamed("d", "e"), "t").groupBy("lag").agg(F.sum(F.col("d") * F.col("e")).alias("s"))
    return s.select("lag", r(F.col("s") / F.max(F.when(F.col("lag") == 0, F.col("s"))).over(Window.partitionBy())).alias("acf"))


@query(f"""with {GRID}, c as (select lat, lon, month(month) as m, avg(value) as clim from grid group by 1, 2, 3)
select lat, lon, cast(m as integer) as m, round(clim, 4) as clim from c""")
def monthly_climatology(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid(spark, sf_dir).groupBy("lat", "lon", F.month("month").alias("m")).agg(r(F.avg("value"), 4).alias("clim"))


@query(f"""with {GRID}, c as (select lat, lon, month(month) as m, avg(value) as clim, avg(value) filter (year(month) in (1996, 1998)) as early, avg(value) filter (year(month) in (1997, 1999)) as late from grid group by 1, 2, 3)
select lat, lon, cast(m as integer) as m, round(early - clim, 4) as early_anomaly, round(late - clim, 4) as late_anomaly, sign(early - clim) = sign(late - clim) as agree from c""")
def composite_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda *y: F.avg(F.when(F.year("month").isin(*y), F.col("value")))
    c = grid(spark, sf_dir).groupBy("lat", "lon", F.month("month").alias("m")).agg(F.avg("value").alias("c"), pick(1996, 1998).alias("e"), pick(1997, 1999).alias("l"))
    e, late = F.col("e") - F.col("c"), F.col("l") - F.col("c")
    return c.select("lat", "lon", "m", r(e, 4).alias("early_anomaly"), r(late, 4).alias("late_anomaly"), (F.signum(e) == F.signum(late)).alias("agree"))


@query(f"""with {GRID}, o as (select lat, year(month) as y, min(month) as onset from (select lat, month, avg(value) as v from grid group by 1, 2) where v > 100000 group by 1, 2)
select cast(date_diff('month', onset, month) as integer) as rel, round(avg(value), 4) as value, count(*) as n from grid join o on o.lat = grid.lat and year(month) = y where date_diff('month', onset, month) between -2 and 4 group by 1""")
def event_relative_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid(spark, sf_dir)
    rows = g.groupBy("lat", "month").agg(F.avg("value").alias("v")).where("v > 100000")
    onset = rows.groupBy("lat", F.year("month").alias("y")).agg(F.min("month").alias("onset"))
    both = g.withColumn("y", F.year("month")).join(onset, ["lat", "y"]).withColumn("rel", F.months_between("month", "onset").cast("int"))
    return both.where("rel between -2 and 4").groupBy("rel").agg(r(F.avg("value"), 4).alias("value"), F.count("*").alias("n"))


@query("""select cast(year(o_orderdate) as integer) as year, cast(least((dayofyear(o_orderdate) - 1) // 5, 72) as integer) as pentad, round(avg(o_totalprice), 4) as value, count(*) as n from orders group by 1, 2""")
def pentad_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    pentad = F.least(F.floor((F.dayofyear("o_orderdate") - 1) / 5), F.lit(72)).cast("int")
    return table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year"), pentad.alias("pentad")).agg(r(F.avg("o_totalprice"), 4).alias("value"), F.count("*").alias("n"))


@query(f"""with {MONTHLY}, s as (select year(month) as y, avg(value) filter (month(month) in (10, 11, 12)) as ond, count(value) filter (month(month) in (10, 11, 12)) as n, avg(value) filter (month(month) in (6, 7, 8)) as jja from monthly group by 1)
select cast(a.y as integer) as year, round(case when b.n >= 2 then b.ond end, 4) as before_ond, round(a.jja, 4) as jja from s a left join s b on b.y = a.y - 1""")
def cross_year_season(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda fn, *m: fn(F.when(F.month("month").isin(*m), F.col("value")))
    s = monthly(spark, sf_dir).groupBy(F.year("month").alias("year")).agg(pick(F.avg, 10, 11, 12).alias("ond"), pick(F.count, 10, 11, 12).alias("n"), pick(F.avg, 6, 7, 8).alias("jja"))
    before = s.select((F.col("year") + 1).alias("year"), F.when(F.col("n") >= 2, F.col("ond")).alias("before_ond"))
    return s.join(before, "year", "left").select("year", r("before_ond", 4).alias("before_ond"), r("jja", 4).alias("jja"))


@query(f"""with {GRID}, z as (select lat, lon, avg(value) as v from grid group by 1, 2), n as (select *, lag(v) over w as a, lead(v) over w as b from z window w as (partition by lon order by lat))
select lat, lon, round(case when a is null then b - v when b is null then v - a else (b - a) / 2 end, 4) as dy from n""")
def gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = grid(spark, sf_dir).groupBy("lat", "lon").agg(F.avg("value").alias("v"))
    return z.select("lat", "lon", r(st.gradient("v", "lat", ["lon"]), 4).alias("dy"))


@query(f"""with {GRID}, z as (select lon, lat, 1000 - 80 * lat as p, avg(value) as v from grid group by 1, 2, 3), d as (select *, p - lead(p) over w as dp, (v + lead(v) over w) / 2 as m from z window w as (partition by lon order by lat))
select lon, round(sum(m * dp) * 100 / 9.81, 2) as integral from d group by 1""")
def vertical_integral(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = grid(spark, sf_dir).groupBy("lon", (1000 - 80 * F.col("lat")).alias("p")).agg(F.avg("value").alias("v"))
    s = Ordered(["lon"], [F.desc("p")])
    d = z.select("lon", (F.col("p") - s.lag("p", -1)).alias("dp"), ((F.col("v") + s.lag("v", -1)) / 2).alias("m"))
    return d.groupBy("lon").agg(r(F.sum(F.col("m") * F.col("dp")) * 100 / 9.81, 2).alias("integral"))


@query(f"""with {MONTHLY}, w as (select unnest(generate_series(-12, 12)) as k), lz as (select cast(k as integer) as k, case when k = 0 then 2 * (1 / 4.0 - 1 / 20.0) else (sin(2 * pi() * k / 4.0) - sin(2 * pi() * k / 20.0)) / (pi() * k) * sin(pi() * k / 13.0) / (pi() * k / 13.0) end as wt from w)
select x.month, round(sum(y.value * wt), 4) as band from monthly x, lz join monthly y on y.t = x.t + k group by x.month having count(*) = 25""")
def lanczos_bandpass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lanczos band-pass of 25 weights between periods of 20 and 4 months."""
    n = 12
    sinc = lambda x: 1.0 if x == 0 else math.sin(math.pi * x) / (math.pi * x)
    weights = [(2 / 4.0 * sinc(2 * k / 4.0) - 2 / 20.0 * sinc(2 * k / 20.0)) * sinc(k / (n + 1)) for k in range(-n, n + 1)]
    s = Ordered([], ["month"])
    band = sum((s.lag("value", -k) * w for k, w in zip(range(-n, n + 1), weights, strict=True)), F.lit(0.0))
    return monthly(spark, sf_dir).select("month", r(band, 4).alias("band")).dropna()


@query(f"""with {GRID}, z as (select lat, lon, avg(value) as v from grid group by 1, 2), t as (select unnest([0.0, 1.5, 3.25, 7.75, 11.0, 15.0]) as x), q as (select lon, x, min(lat) as lo, max(lat) as hi from z, t group by 1, 2),
c as (select lon, x, least(greatest(x, lo), hi) as pos from q), n as (select c.lon, c.x, c.pos, max(z.lat) filter (z.lat <= c.pos) as i, min(z.lat) filter (z.lat >= c.pos) as j from c join z on z.lon = c.lon group by 1, 2, 3)
select lon, cast(x as double) as x, round(case when i = j then a.v else a.v + (b.v - a.v) * (pos - i) / (j - i) end, 4) as v from n join z a using (lon) join z b using (lon) where a.lat = i and b.lat = j""")
def interp1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values at given latitudes, clamped at the ends of each column; where a
    latitude is missing its neighbours count."""
    z = grid(spark, sf_dir).groupBy("lat", "lon").agg(F.avg("value").alias("v"))
    s = Ordered(["lon"], ["lat"])
    legs = z.select("lon", "lat", "v", s.lag("lat", -1).alias("lat1"), s.lag("v", -1).alias("v1"), F.min("lat").over(Window.partitionBy("lon")).alias("lo"), F.max("lat").over(Window.partitionBy("lon")).alias("hi"))
    legs = legs.withColumn("x", F.explode(F.array(*map(F.lit, [0.0, 1.5, 3.25, 7.75, 11.0, 15.0]))))
    at = F.least(F.greatest("x", F.col("lo").cast("double")), F.col("hi").cast("double"))
    inside = ((at >= F.col("lat")) & (at < F.col("lat1"))) | (F.col("lat1").isNull() & (at == F.col("lat")))
    v = F.when(F.col("lat1").isNull(), F.col("v")).otherwise(F.col("v") + (F.col("v1") - F.col("v")) * (at - F.col("lat")) / (F.col("lat1") - F.col("lat")))
    return legs.where(inside).select("lon", "x", r(v, 4).alias("v"))


@query(f"""with {GRID}, z as (select lat, lon, avg(value) as v from grid group by 1, 2), t as (select cast(unnest(generate_series(0, 21)) as integer) as i), u as (select cast(unnest(generate_series(0, 45)) as integer) as j)
select i / 2.0 as lat, j / 2.0 as lon, round((case when i % 2 = 0 and j % 2 = 0 then a.v when i % 2 = 0 then (a.v + b.v) / 2 when j % 2 = 0 then (a.v + c.v) / 2 else (a.v + b.v + c.v + d.v) / 4 end), 4) as v
from t, u join z a on a.lat = i // 2 and a.lon = j // 2 join z b on b.lat = i // 2 and b.lon = j // 2 + 1 join z c on c.lat = i // 2 + 1 and c.lon = j // 2 join z d on d.lat = i // 2 + 1 and d.lon = j // 2 + 1""")
def regrid_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import joins

    z = grid(spark, sf_dir).groupBy("lat", "lon").agg(F.avg("value").alias("value"))
    fine = spark.range(22).select((F.col("id") / 2).alias("lat")).crossJoin(spark.range(46).select((F.col("id") / 2).alias("lon")))
    return joins.bilinear(fine, z, 1.0, "value").where("value is not null").select("lat", "lon", r("value", 4).alias("v"))


@query(f"""with {MONTHLY}, k as (select unnest([1, 2, 3]) as j), m as (select month, t, value, count(*) over () as p, avg(value) over () as mean from monthly),
w as (select j, sum(value * cos(2 * pi() * ((j * t) % p) / p)) as c, sum(value * sin(2 * pi() * ((j * t) % p) / p)) as s from m, k group by 1)
select month, round(max(mean) + sum((c * cos(2 * pi() * ((j * t) % p) / p) + s * sin(2 * pi() * ((j * t) % p) / p)) * 2 / p), 4) as smooth from m, w where p > 6 group by 1""")
def harmonics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = monthly(spark, sf_dir).withColumn("k", F.lit(1))
    return signal.harmonics(m, ["k"], "t", "value", 3, "smooth").select("month", r("smooth", 4).alias("smooth"))


BAND = signal.butterworth(3, 2 / 20, 2 / 8)


def filter_sql(name: str, coefficients: tuple, source: str = "l") -> str:
    """Both passes of a filter over the list ``x`` of each symbol, with odd
    extensions, each from the state that a constant series at its first value
    would have left; ``name`` has the list of results."""
    b, a = ([repr(float(v)) for v in c] for c in coefficients)
    pad, start = 3 * len(a), signal.resting(*coefficients)
    first = ", ".join(f"{float(v)!r} * x[1] as z{i}" for i, v in enumerate(start))
    step = ", ".join(f"{f'z{i + 1} + ' if i + 1 < len(start) else ''}{b[i + 1]} * v - {a[i + 1]} * ({b[0]} * v + z0)" for i in range(len(start)))
    out = [f"{name}_0 as materialized (select symbol, list_concat(list_transform(range({pad + 1}, 1, -1), lambda i: 2 * x[1] - x[i]), x, list_transform(range(1, {pad + 1}), lambda i: 2 * x[-1] - x[-1 - i])) as x from {source} where len(x) > {pad})"]
    for k in (1, 2):
        now, before = f"{name}_{k}", f"{name}_{k - 1}"
        out.append(f"""{now}_i as (select symbol, 0 as i, 0.0::double as y, {first} from {before} union all
 select symbol, i + 1, {b[0]} * v + z0, {step} from (select {now}_i.*, x[i + 1] as v from {now}_i join {before} using (symbol) where i < len(x)))""")
        out.append(f"{now} as materialized (select symbol, list(y order by i desc) as x from {now}_i where i > 0 group by 1)")
    out.append(f"{name} as materialized (select symbol, list_slice(x, {pad + 1}, len(x) - {pad}) as x from {name}_2)")
    return ",\n".join(out)


SERIES = f"{BARS}, l as materialized (select symbol, list(close order by date) as x from bars group by 1)"


@query(f"""with recursive {SERIES}, {filter_sql("band", BAND)} select b.symbol, b.date, round(k.x[t], 4) as band from bars b left join band k on k.symbol = b.symbol""")
def butter_bandpass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.per_series(bars(spark, sf_dir), ["symbol"], "date", "close", "band", lambda x: signal.filtfilt(*BAND, x)).select("symbol", "date", r("band", 4).alias("band"))


SLOW, FAST = signal.butterworth(4, None, 2 / 30), signal.butterworth(4, 2 / 10, None)


@query(f"""with recursive {SERIES}, {filter_sql("slow", SLOW)}, {filter_sql("fast", FAST)}
select b.symbol, b.date, round(s.x[t], 2) as slow, round(f.x[t], 2) as fast from bars b left join slow s on s.symbol = b.symbol left join fast f on f.symbol = b.symbol""")
def butter_low_high(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waves of more than 30 days, and of less than 10; one pass over each series."""
    pair = lambda x: np.column_stack([signal.filtfilt(*c, x) for c in (SLOW, FAST)])
    return signal.per_series(bars(spark, sf_dir), ["symbol"], "date", "close", ("slow", "fast"), pair).select("symbol", "date", r("slow", 2).alias("slow"), r("fast", 2).alias("fast"))


AXES = ("level", (150.0, 300.0, 850.0, 1100.0), None), ("lat", (-5.0, 5.0, 12.5, 50.0), None), ("lon", (0.0, 22.5, 100.0, 350.0), 360.0)


def axis_sql(name: str, source: str, axis: str, targets: tuple, period: float | None) -> str:
    keys = ", ".join(c for c in ("year", "level", "lat", "lon") if c != axis)
    legs = f"select {keys}, {axis} as x0, v as v0, lead({axis}) over w as x1, lead(v) over w as v1, first_value({axis}) over w as f, first_value(v) over w as fv from {source} window w as (partition by {keys} order by {axis})"
    if period:
        legs = f"select * replace (coalesce(x1, f + {period}) as x1, coalesce(v1, fv) as v1) from ({legs})"
        return f"""{name} as (select {keys}, t as {axis}, v0 + (v1 - v0) * (case when t < f then t + {period} else t end - x0) / (x1 - x0) as v from ({legs}), (select unnest({list(targets)}) as t)
 where case when t < f then t + {period} else t end >= x0 and case when t < f then t + {period} else t end < x1)"""
    return f"""{name} as (select {keys}, t as {axis}, case when t < x0 or x1 is null then v0 else v0 + (v1 - v0) * (t - x0) / (x1 - x0) end as v from ({legs}), (select unnest({list(targets)}) as t)
 where (t >= x0 and (x1 is null or t < x1)) or (t < x0 and x0 = f))"""


@query(f"""with f0 as (select cast(year(o_orderdate) as integer) as year, cast(left(o_orderpriority, 1) as integer) * 200.0::double as level, (o_custkey % 6) * 10.0::double as lat, ((o_custkey // 6) % 8) * 45.0::double as lon, avg(o_totalprice) as v from orders group by 1, 2, 3, 4),
{", ".join(axis_sql(f"f{i + 1}", f"f{i}", *a) for i, a in enumerate(AXES))} select year, level, lat, lon, round(v, 3) as v from f3""")
def grid_resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of four dimensions on other levels, latitudes and longitudes."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_custkey")
    f = o.groupBy(F.year("o_orderdate").alias("year"), (F.substring("o_orderpriority", 1, 1).cast("int") * 200.0).alias("level"), (k % 6 * 10.0).alias("lat"), (F.floor(k / 6) % 8 * 45.0).alias("lon")).agg(F.avg("o_totalprice").alias("v"))
    for axis, targets, period in AXES:
        f = sphere.resampled(f, axis, targets, "v", [c for c in ("year", "level", "lat", "lon") if c != axis], period)
    return f.select("year", "level", "lat", "lon", r("v", 3).alias("v"))


@query(f"""with {BARS}, l as (select symbol, count(*) as n, regr_slope(close, t - 1) as k, regr_intercept(close, t - 1) as c, greatest(1, count(*) // 20) as m from bars group by 1 having count(*) >= 4),
x as (select b.symbol, n, t - 1 as i, (close - (c + k * (t - 1))) * case when least(t - 1, n - t) < m then 0.5 * (1 - cos(pi() * (least(t - 1, n - t) + 0.5) / m)) else 1.0 end as x from bars b join l using (symbol)),
f as (select symbol, n, unnest(range(1, n // 2 + 1)) as j from l), s as (select symbol, f.n, j, sum(x * cos(2 * pi() * ((i * j) % f.n) / f.n)) as re, sum(x * sin(2 * pi() * ((i * j) % f.n) / f.n)) as im from f join x using (symbol) group by 1, 2, 3)
select symbol, round(j / n, 9) as frequency, round((re * re + im * im) / n / 1e6, 3) as power from s""")
def power_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Power in millions, by days of trading."""
    s = signal.spectrum(bars(spark, sf_dir).select("symbol", "date", "close"), ["symbol"], "date", "close")
    return s.select("symbol", r("frequency", 9).alias("frequency"), r(F.col("power") / 1e6, 3).alias("power"))


@query("""select l_returnflag, cast(count_if(l_quantity > 45) as bigint) as hot, round(avg(cast(l_quantity > 45 as int)), 6) as frequency, cast(count_if(l_quantity > 10 and l_quantity < 20) as bigint) as wet from lineitem group by 1""")
def hot_day_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    hot, wet = F.col("l_quantity") > 45, (F.col("l_quantity") > 10) & (F.col("l_quantity") < 20)
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count_if(hot).alias("hot"), r(F.avg(hot.cast("int"))).alias("frequency"), F.count_if(wet).alias("wet"))
