"""Queries on yearly cells, ensembles and daily series of orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.windows import Ordered
from .base import CELL_YEAR, GRID, by_cell_year, grid, query, r, table

CELL = ["lat", "lon"]

EXPERIMENTS = """
ex as (
  select cast(o_custkey % 6 as integer) as lat, cast((o_custkey // 6) % 8 as integer) as lon, cast(o_orderkey // 32 % 2 as integer) as run, cast(year(o_orderdate) as integer) as year, avg(o_totalprice) as value
  from orders group by 1, 2, 3, 4)
"""


@query(f"""with {EXPERIMENTS}, g as (select lat, lon, run, count(*) as n, regr_slope(value, year) as b, regr_sxx(value, year) as sxx, regr_syy(value, year) as syy, regr_sxy(value, year) as sxy from ex group by 1, 2, 3 having count(*) >= 3),
h as (select *, sqrt(greatest(syy - b * sxy, 0) / (n - 2) / sxx) as se from g)
select a.lat, a.lon, round(b.b - a.b, 3) as difference, round((b.b - a.b) / sqrt(a.se * a.se + b.se * b.se), 4) as t, a.n + b.n - 4 as df from h a join h b on a.lat = b.lat and a.lon = b.lon and a.run = 0 and b.run = 1""")
def trend_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slopes of two experiments in one grouping, and how far they are apart."""
    o = table(spark, sf_dir, "orders")
    run = (F.floor(F.col("o_orderkey") / 32) % 2).cast("int").alias("run")
    cell = [(F.col("o_custkey") % 6).cast("int").alias("lat"), (F.floor(F.col("o_custkey") / 6) % 8).cast("int").alias("lon")]
    x = o.groupBy(*cell, run, F.year("o_orderdate").alias("year")).agg(F.avg("o_totalprice").alias("value"))
    aggs = []
    for k in (0, 1):
        y = F.when(F.col("run") == k, F.col("value"))
        aggs += [F.count(y).alias(f"n{k}"), F.regr_slope(y, F.col("year")).alias(f"b{k}"), F.regr_sxx(y, F.col("year")).alias(f"sxx{k}"), F.regr_syy(y, F.col("year")).alias(f"syy{k}"), F.regr_sxy(y, F.col("year")).alias(f"sxy{k}")]
    g = x.groupBy(*CELL).agg(*aggs).where("n0 >= 3 and n1 >= 3")
    error = lambda k: F.greatest(F.col(f"syy{k}") - F.col(f"b{k}") * F.col(f"sxy{k}"), F.lit(0.0)) / (F.col(f"n{k}") - 2) / F.col(f"sxx{k}")
    d = F.col("b1") - F.col("b0")
    return g.select(*CELL, r(d, 3).alias("difference"), r(F.try_divide(d, F.sqrt(error(0) + error(1))), 4).alias("t"), (F.col("n0") + F.col("n1") - 4).alias("df"))


MODELS = """
models as (
  select o_orderpriority as model, cast(o_custkey % 6 as integer) as lat, cast(year(o_orderdate) as integer) as year, avg(o_totalprice) as value
  from orders where not (o_custkey % 6 = 5 and o_orderpriority = '1-URGENT') group by 1, 2, 3)
"""


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat = F.col("o_custkey") % 6
    o = table(spark, sf_dir, "orders").where(~((lat == 5) & (F.col("o_orderpriority") == "1-URGENT")))
    return o.groupBy(F.col("o_orderpriority").alias("model"), lat.cast("int").alias("lat"), F.year("o_orderdate").alias("year")).agg(F.avg("o_totalprice").alias("value"))


@query(f"""with {MODELS} select lat, year, count(*) as members, round(avg(value), 3) as mean, round(case when count(*) = 5 then avg(value) end, 3) as strict_mean, round(stddev_samp(value), 3) as spread, round(avg(value) filter (model like '%HIGH%' or model like '%URGENT%'), 3) as high_group,
round(100 * greatest(count_if(value > 150000), count_if(value <= 150000)) / count(*), 3) as agreement from models group by 1, 2""")
def ensemble_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over the members there are, and over all or none."""
    v = F.col("value")
    high = F.when(F.col("model").contains("HIGH") | F.col("model").contains("URGENT"), v)
    above = F.count_if(v > 150000)
    return models(spark, sf_dir).groupBy("lat", "year").agg(
        F.count("*").alias("members"), r(F.avg(v), 3).alias("mean"), r(F.when(F.count("*") == 5, F.avg(v)), 3).alias("strict_mean"), r(F.stddev_samp(v), 3).alias("spread"), r(F.avg(high), 3).alias("high_group"),
        r(100 * F.greatest(above, F.count("*") - above) / F.count("*"), 3).alias("agreement"),
    )


@query(f"""with {CELL_YEAR}, x as (select year, value, cos(radians(lat * 10.0)) as w from cells), m as (select year, sum(w * value) / sum(w) as m from x group by 1)
select year, round(sqrt(sum(w * pow(value - m, 2)) / sum(w)), 3) as std, round(any_value(m), 3) as mean from x join m using (year) group by 1""")
def weighted_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the weighted mean of each year, not from sums of squares."""
    w = Window.partitionBy("year")
    x = by_cell_year(spark, sf_dir).withColumn("w", F.cos(F.radians(F.col("lat") * 10.0)))
    x = x.withColumn("m", F.sum(F.col("w") * F.col("value")).over(w) / F.sum("w").over(w))
    return x.groupBy("year").agg(r(F.sqrt(F.sum(F.col("w") * F.pow(F.col("value") - F.col("m"), 2)) / F.sum("w")), 3).alias("std"), r(F.max("m"), 3).alias("mean"))


DAYS = """
days as (select cast(o_orderdate as date) as date, cast(year(o_orderdate) as integer) as year, cast(month(o_orderdate) as integer) as month, cast(day(o_orderdate) as integer) as day,
  cast(date_diff('day', cast(year(o_orderdate) || '-01-01' as date), cast(o_orderdate as date)) as integer) as doy, avg(o_totalprice) as value from orders group by 1, 2, 3, 4, 5)
"""


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    date = F.to_date("o_orderdate").alias("date")
    g = table(spark, sf_dir, "orders").groupBy(date).agg(F.avg("o_totalprice").alias("value"))
    return g.select("date", F.year("date").alias("year"), F.month("date").alias("month"), F.day("date").alias("day"), (F.dayofyear("date") - 1).alias("doy"), "value")


@query(f"""with {DAYS} select date, round(avg(value) over d, 3) as climatology, round(value - avg(value) over d, 3) as anomaly, round((value - min(value) over d) / nullif(max(value) over d - min(value) over d, 0), 5) as scaled from days window d as (partition by month, day)""")
def daily_climatology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means by calendar day over all years, distances and shares of the range."""
    w = Window.partitionBy("month", "day")
    v, low, high = F.col("value"), F.min("value").over(w), F.max("value").over(w)
    return days(spark, sf_dir).select("date", r(F.avg("value").over(w), 3).alias("climatology"), r(v - F.avg("value").over(w), 3).alias("anomaly"), r(F.try_divide(v - low, high - low), 5).alias("scaled"))


@query(f"""with {DAYS}, k as (select unnest(generate_series(-7, 7)) as k), x as (select days.doy + k as doy, value from days, k where year <= 1997 and month between 6 and 9 and days.doy + k between 158 and 265)
select cast(doy as integer) as doy, count(*) as n, round(quantile_cont(value, 0.9), 3) as threshold from x group by 1""")
def centred_day_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentile of 15-day windows over all reference years. Each day is sent
    to the 15 days that it counts for, which makes the windows one grouping."""
    x = days(spark, sf_dir).where("year <= 1997 and month between 6 and 9").select("value", F.explode(F.sequence(F.col("doy") - 7, F.col("doy") + 7)).alias("doy"))
    return x.where(F.col("doy").between(158, 265)).groupBy("doy").agg(F.count("*").alias("n"), r(F.percentile("value", 0.9), 3).alias("threshold"))


RAIN = "n * (20 + 140 * (lat % 4))"


@query(f"""with {GRID}, y as (select month(month) as m, count(distinct year(month)) as years from grid group by 1), c as (select lat, lon, month(month) as m, sum({RAIN}) as rain from grid group by 1, 2, 3), d as (select lat, lon, m, rain / years as rain from c join y using (m)),
s as (select lat, lon, coalesce(sum(rain) filter (m between 5 and 9), 0) as warm, coalesce(sum(rain) filter (m in (11, 12, 1, 2, 3)), 0) as cold, sum(rain) as annual from d group by 1, 2),
h as (select lat, lon, annual, case when lat >= 6 then warm else cold end as summer, case when lat >= 6 then cold else warm end as winter from s)
select lat, lon, round(summer, 2) as summer, round(summer - winter, 2) as difference, round(summer / annual, 5) as share, summer - winter > 300 and summer / annual > 0.55 as monsoon, summer < 150 as arid from h""")
def hemisphere_seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monsoon and arid areas of a mean year: summers of each hemisphere that
    exceed the winter by a margin and hold most of the *whole* year's rain, and
    summers with little. A calendar month's mean is over the years that have it,
    a month without rows in a cell counting as nothing."""
    rows = grid(spark, sf_dir).withColumn("m", F.month("month"))
    years = rows.groupBy("m").agg(F.countDistinct(F.year("month")).alias("years"))
    rain = rows.groupBy(*CELL, "m").agg(F.sum(F.expr(RAIN)).alias("rain")).join(F.broadcast(years), "m").withColumn("rain", F.col("rain") / F.col("years"))  # twelve rows
    of = lambda months: F.coalesce(F.sum(F.when(months, F.col("rain"))), F.lit(0.0))
    s = rain.groupBy(*CELL).agg(of(F.col("m").between(5, 9)).alias("warm"), of(F.col("m").isin(11, 12, 1, 2, 3)).alias("cold"), F.sum("rain").alias("annual"))
    north = F.col("lat") >= 6
    s = s.withColumns({"summer": F.when(north, F.col("warm")).otherwise(F.col("cold")), "winter": F.when(north, F.col("cold")).otherwise(F.col("warm"))})
    more, share = F.col("summer") - F.col("winter"), F.col("summer") / F.col("annual")
    return s.select(*CELL, r("summer", 2).alias("summer"), r(more, 2).alias("difference"), r(share, 5).alias("share"), ((more > 300) & (share > 0.55)).alias("monsoon"), (F.col("summer") < 150).alias("arid"))


@query(f"""with {DAYS}, x as (select *, avg(value) over w as m5, count(*) over w as n5, avg(value) over nxt as m5_next, count(*) over nxt as n5_next, avg(value) filter (doy < 30) over (partition by year) as january, (value - min(value) over (partition by year)) / nullif(max(value) over (partition by year) - min(value) over (partition by year), 0) as share
 from days window w as (partition by year order by date rows between current row and 4 following), nxt as (partition by year order by date rows between 5 following and 9 following)),
y as (select *, min(share) over (partition by year order by date rows between current row and 2 following) as held, count(*) over (partition by year order by date rows between current row and 2 following) as n3 from x)
select year, min(doy) filter (month >= 3 and n5 = 5 and m5 - january > 5000) as onset, min(doy + 5) filter (doy between 150 and 339 and n5 = 5 and n5_next = 5 and m5 - january >= 5000 and m5_next - january <= 5000) as withdrawal, min(doy) filter (doy >= 70 and n3 = 3 and held >= 0.618) as onset_normalised from y group by 1""")
def onset_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First five days above the mean of the year's first thirty by a threshold;
    the end of the first five days from day 150 on that are above it while the
    next five are not; and, from day 70 on, the first of three days at the golden
    share of the year's range or over. Null where a rule is never met."""
    s, year = Ordered(["year"], ["date"]), Window.partitionBy("year")
    five = lambda at: s.guarded(F.avg("value"), "value", s.rows(at, at + 4), 5)
    low, high = F.min("value").over(year), F.max("value").over(year)
    x = days(spark, sf_dir).withColumns({"m5": five(0), "next": five(5), "january": F.avg(F.when(F.col("doy") < 30, F.col("value"))).over(year), "share": F.try_divide(F.col("value") - low, high - low)})
    x = x.withColumn("held", s.guarded(F.min("share"), "share", s.rows(0, 2), 3))
    over, after = F.col("m5") - F.col("january"), F.col("next") - F.col("january")
    first = lambda cond, day="doy": F.min(F.when(cond, F.expr(day)))
    return x.groupBy("year").agg(
        first((F.col("month") >= 3) & (over > 5000)).alias("onset"), first(F.col("doy").between(150, 339) & (over >= 5000) & (after <= 5000), "doy + 5").alias("withdrawal"),
        first((F.col("doy") >= 70) & (F.col("held") >= 0.618)).alias("onset_normalised"),
    )


@query(f"""with {CELL_YEAR}, k as (select unnest(generate_series(0, 3)) as k) select lat, lon, cast(year - k as integer) as start, count(*) as n, round(regr_slope(value, year), 3) as slope from cells, k where year - k between 1992 and 1995 group by 1, 2, 3 having count(*) >= 3""")
def sliding_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trends of all windows of four years: each year is sent to its windows."""
    x = by_cell_year(spark, sf_dir).withColumn("start", F.explode(F.sequence(F.col("year") - 3, F.col("year")))).where(F.col("start").between(1992, 1995))
    return x.groupBy(*CELL, "start").agg(F.count("*").alias("n"), r(F.regr_slope("value", "year"), 3).alias("slope")).where("n >= 3")


@query(f"""with {DAYS}, m as (select cast(date_trunc('month', o_orderdate) as date) as month, cast(o_custkey % 6 as integer) as lat, avg(o_totalprice) as value from orders group by 1, 2), i as (select month, avg(value) as idx from m group by 1),
x as (select lat, month, value, idx, value - avg(value) over (partition by lat) as dv, idx - avg(idx) over (partition by lat) as di from m join i using (month)),
a as (select *, lag(dv) over (partition by lat order by month) as dv1, lag(di) over (partition by lat order by month) as di1 from x),
g as (select lat, count(*) as n, corr(value, idx) as r, sum(dv * dv1) / sum(dv * dv) as av, sum(di * di1) / sum(di * di) as ai from a group by 1),
h as (select *, n * (1 - av * ai) / (1 + av * ai) as ne from g) select lat, n, round(r, 5) as r, round(ne, 4) as effective_n, round(r * sqrt((ne - 2) / (1 - r * r)), 3) as t from h""")
def effective_sample_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of each cell with an index, and its t by the number of samples
    that remain independent."""
    o = table(spark, sf_dir, "orders")
    m = o.groupBy(F.trunc("o_orderdate", "month").alias("month"), (F.col("o_custkey") % 6).cast("int").alias("lat")).agg(F.avg("o_totalprice").alias("value"))
    m = m.withColumn("idx", F.avg("value").over(Window.partitionBy("month")))
    w, s = Window.partitionBy("lat"), Ordered(["lat"], ["month"])
    x = m.withColumns({"dv": F.col("value") - F.avg("value").over(w), "di": F.col("idx") - F.avg("idx").over(w)})
    x = x.withColumns({"dv1": s.lag("dv"), "di1": s.lag("di")})
    own = lambda c: F.sum(F.col(c) * F.col(f"{c}1")) / F.sum(F.col(c) * F.col(c))
    g = x.groupBy("lat").agg(F.count("*").alias("n"), F.corr("value", "idx").alias("r"), own("dv").alias("av"), own("di").alias("ai"))
    both = F.col("av") * F.col("ai")
    g = g.withColumn("ne", F.col("n") * (1 - both) / (1 + both))
    return g.select("lat", "n", r("r", 5).alias("r"), r("ne", 4).alias("effective_n"), r(F.col("r") * F.sqrt((F.col("ne") - 2) / (1 - F.col("r") * F.col("r"))), 3).alias("t"))


VARIABLES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" union all ".join(f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 6) as r from lineitem" for a in VARIABLES for b in VARIABLES))
def correlation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of variables in one pass."""
    pairs = [(a, b) for a in VARIABLES for b in VARIABLES]
    g = table(spark, sf_dir, "lineitem").agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), r(F.corr(a, b)).alias("r")) for a, b in pairs]).alias("_m"))
    return g.select(F.inline("_m"))


MASK = "lsm as (select cast(n_nationkey // 5 as integer) as mi, cast(n_nationkey % 5 as integer) as mj, (n_nationkey * 7 % 10) / 10.0 as land from nation)"


@query(f"""with {GRID}, {MASK}, g as (select lat, lon, avg(value) as value from grid group by 1, 2), k as (select g.*, land from g left join lsm on mi = cast(least(floor(lat / 2.4 ), 4) as integer) and mj = cast(least(floor(lon / 4.8), 4) as integer))
select lat, count(*) as cells, count(*) filter (land < 0.5) as ocean_cells, round(avg(value) filter (land < 0.5), 3) as ocean_mean, round(avg(value) filter (land >= 0.5), 3) as land_mean, round(avg(value) filter (land >= 0.5) - avg(value) filter (land < 0.5), 3) as contrast from k group by 1""")
def land_sea_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A coarser mask, taken to the grid by its cells, and means of each latitude
    over ocean and land. The mask has a row a cell of its own grid."""
    g = grid(spark, sf_dir).groupBy(*CELL).agg(F.avg("value").alias("value"))
    k = F.col("n_nationkey")
    mask = table(spark, sf_dir, "nation").select(F.floor(k / 5).cast("int").alias("mi"), (k % 5).cast("int").alias("mj"), ((k * 7 % 10) / 10).alias("land"))
    at = lambda c, size: F.least(F.floor(F.col(c) / size), F.lit(4)).cast("int")
    x = g.withColumns({"mi": at("lat", 2.4), "mj": at("lon", 4.8)}).join(mask, ["mi", "mj"], "left")
    sea, land = F.when(F.col("land") < 0.5, F.col("value")), F.when(F.col("land") >= 0.5, F.col("value"))
    return x.groupBy("lat").agg(F.count("*").alias("cells"), F.count(sea).alias("ocean_cells"), r(F.avg(sea), 3).alias("ocean_mean"), r(F.avg(land), 3).alias("land_mean"), r(F.avg(land) - F.avg(sea), 3).alias("contrast"))


@query(f"""with {GRID}, g as (select lat, lon, avg(value) as value from grid group by 1, 2), a as (select distinct lat from g), t as (select unnest([1.2, 5.5, 10.9]) as want), n as (select want, min(struct_pack(d := abs(lat - want), v := lat)).v as lat from t, a group by 1),
s as (select cast(want as double) as want, lat, lon, value, row_number() over (partition by want order by lon) - 1 as place, abs(lon - 7.6) as far from n join g using (lat) where value is not null)
select want, lat, round(max(case when place = 2 then value end), 3) as third, round(min(struct_pack(f := far, l := lon, v := value)).v, 3) as nearest_value, min(lon) filter (lon >= 3.4) as snapped_west, max(lon) filter (lon <= 15.7) as snapped_east from s group by 1, 2""")
def nearest_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows at the latitude nearest to each of a few wanted ones, the third along
    them, the value nearest to a longitude, and a box snapped to the grid."""
    g = grid(spark, sf_dir).groupBy(*CELL).agg(F.avg("value").alias("value"))
    lats = g.select("lat").distinct().withColumn("want", F.explode(F.array(*map(F.lit, [1.2, 5.5, 10.9]))))
    near = lats.groupBy("want").agg(F.min(F.struct(F.abs(F.col("lat") - F.col("want")).alias("d"), "lat"))["lat"].alias("lat"))
    s = g.join(F.broadcast(near), "lat").withColumn("place", F.row_number().over(Window.partitionBy("want").orderBy("lon")) - 1)  # a row a wanted latitude
    return s.groupBy("want", "lat").agg(
        r(F.max(F.when(F.col("place") == 2, F.col("value"))), 3).alias("third"), r(F.min(F.struct(F.abs(F.col("lon") - 7.6).alias("f"), "lon", "value"))["value"], 3).alias("nearest_value"),
        F.min(F.when(F.col("lon") >= 3.4, F.col("lon"))).alias("snapped_west"), F.max(F.when(F.col("lon") <= 15.7, F.col("lon"))).alias("snapped_east"),
    )


@query(f"""with {CELL_YEAR}, x as (select lat, lon, value, avg(value) over (partition by lat) as m, stddev_samp(value) over (partition by lat) as s from cells where year = 1996)
select lat, lon, round(s * exp(-0.5 * pow((value - m) / s, 2)) / (s * s * sqrt(2 * pi())) * 1e5, 5) as pdf, round(rank() over (partition by lat order by value) + count(*) over (partition by lat, value) - 1.0, 6) / count(*) over (partition by lat) as ecdf from x""")
def normal_pdf_ecdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    import math

    w = Window.partitionBy("lat")
    x = by_cell_year(spark, sf_dir).where("year = 1996").withColumns({"m": F.avg("value").over(w), "s": F.stddev_samp("value").over(w)})
    pdf = F.exp(-0.5 * F.pow((F.col("value") - F.col("m")) / F.col("s"), 2)) / (F.col("s") * math.sqrt(2 * math.pi))
    return x.select(*CELL, r(pdf * 1e5, 5).alias("pdf"), F.cume_dist().over(w.orderBy("value")).alias("ecdf"))
