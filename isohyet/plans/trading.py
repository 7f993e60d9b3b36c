"""Back-tests with costs, order emission, weekly confirmation, validation of
models, calendars, and comparisons of fields with stations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import market
from ..operators.windows import Ordered
from .base import BARS, GRID, bars, grid, query, r, table
from .climate import DAYS, days
from .panel import WEEKLY
from .strategies import FEATURES, features

MONTH_END = """
me as (select symbol, last_day(date) as month_end, max(struct_pack(d := date, v := close)).v as close from bars group by 1, 2),
mr as (select *, close / lag(close) over w - 1 as ret, case when count(close) over (partition by symbol order by month_end rows between 5 preceding and current row) = 6 then avg(close) over (partition by symbol order by month_end rows between 5 preceding and current row) end as ma from me window w as (partition by symbol order by month_end)),
ps as (select *, case when ma is null then 0.0 when close > ma then 1.0 else 0.4 end as pos from mr),
rt as (select symbol, month_end, ret, pos, lag(pos) over w as held, abs(pos - coalesce(lag(pos) over w, 0)) as turnover from ps window w as (partition by symbol order by month_end)),
net as (select *, held * ret + (1 - held) * 0.002 - 0.001 * turnover as net from rt where held is not null)
"""


def monthly_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months of each symbol: a position by the average of six months, held from
    the next month on, what it earns beside cash, and what turning it costs."""
    s = Ordered(["symbol"], ["month_end"])
    m = bars(spark, sf_dir).groupBy("symbol", F.last_day("date").alias("month_end")).agg(F.max_by("close", "date").alias("close"))
    m = m.withColumns({"ret": s.pct_change("close"), "ma": s.mean("close", 6)})
    m = m.withColumn("pos", F.when(F.col("ma").isNull(), 0.0).when(F.col("close") > F.col("ma"), 1.0).otherwise(0.4))
    m = m.withColumns({"held": s.lag("pos"), "turnover": F.abs(F.col("pos") - F.coalesce(s.lag("pos"), F.lit(0.0)))}).where("held is not null")
    return m.withColumn("net", F.col("held") * F.col("ret") + (1 - F.col("held")) * 0.002 - 0.001 * F.col("turnover"))


@query(f"""with {BARS}, {MONTH_END} select symbol, count(*) as months, round(sum(turnover), 4) as turnover, round(0.001 * sum(turnover), 7) as cost, round(exp(sum(ln(1 + net))) - 1, 4) as total, round(exp(sum(ln(1 + ret))) - 1, 4) as benchmark, round(avg(net) * 12 / (stddev_samp(net) * sqrt(12)), 5) as sharpe, round(avg(cast(net > ret as integer)), 5) as better from net group by 1 having count(*) >= 12""")
def backtest_with_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Net of costs, beside holding all the time; symbols of under a year go."""
    total = lambda c: F.exp(F.sum(F.log1p(F.col(c)))) - 1
    g = monthly_net(spark, sf_dir).groupBy("symbol").agg(
        F.count("*").alias("months"), r(F.sum("turnover"), 4).alias("turnover"), r(0.001 * F.sum("turnover"), 7).alias("cost"), r(total("net"), 4).alias("total"), r(total("ret"), 4).alias("benchmark"),
        r(F.avg("net") * 12 / (F.stddev_samp("net") * F.sqrt(F.lit(12.0))), 5).alias("sharpe"), r(F.avg((F.col("net") > F.col("ret")).cast("int")), 5).alias("better"),
    )
    return g.where("months >= 12")


@query(f"""with {BARS}, {MONTH_END}, g as (select symbol, avg(net) * 12 / (stddev_samp(net) * sqrt(12)) as sharpe, exp(sum(ln(1 + net))) - 1 as total, min(net) as worst from net group by 1 having count(*) >= 12),
x as (select 'sharpe' as metric, symbol, sharpe as value, sharpe as k from g union all select 'total', symbol, total, total from g union all select 'worst', symbol, worst, worst from g)
select metric, symbol, round(value, 5) as value from (select *, row_number() over (partition by metric order by k desc, symbol) as place from x) where place = 1""")
def best_by_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best symbol by each of several metrics: one grouping, no sort."""
    g = monthly_net(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("n"), (F.avg("net") * 12 / (F.stddev_samp("net") * F.sqrt(F.lit(12.0)))).alias("sharpe"), (F.exp(F.sum(F.log1p("net"))) - 1).alias("total"), F.min("net").alias("worst")).where("n >= 12")
    long = g.unpivot(["symbol"], ["sharpe", "total", "worst"], "metric", "value").dropna()
    best = long.groupBy("metric").agg(F.min(F.struct((-F.col("value")).alias("k"), "symbol")).alias("x"))
    return best.select("metric", "x.symbol", r(-F.col("x.k"), 5).alias("value"))


@query(f"""with {BARS}, {MONTH_END}, l as (select symbol, max(struct_pack(m := month_end, p := pos, c := close)) as x, count(*) as n from ps group by 1), o as (select symbol, x.p as target, (n % 5) / 5.0 as held, x.c as price from l)
select symbol, round(target, 4) as target, round(held, 4) as held, case when target > held then 'buy' when target < held then 'sell' end as side, cast(floor(abs(target - held) * 1000000 / price) as bigint) as shares from o where abs(target - held) >= 0.1""")
def rebalance_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders from the last target of each symbol to what is held, where they
    differ by the band or more."""
    s = Ordered(["symbol"], ["month_end"])
    m = bars(spark, sf_dir).groupBy("symbol", F.last_day("date").alias("month_end")).agg(F.max_by("close", "date").alias("close")).withColumn("ma", s.mean("close", 6))
    m = m.withColumn("pos", F.when(F.col("ma").isNull(), 0.0).when(F.col("close") > F.col("ma"), 1.0).otherwise(0.4))
    o = m.groupBy("symbol").agg(F.max_by("pos", "month_end").alias("target"), F.max_by("close", "month_end").alias("price"), F.count("*").alias("n")).withColumn("held", F.col("n") % 5 / 5)
    gap = F.col("target") - F.col("held")
    o = o.where(F.abs(gap) >= 0.1)
    return o.select("symbol", r("target", 4).alias("target"), r("held", 4).alias("held"), F.when(gap > 0, "buy").otherwise("sell").alias("side"), F.floor(F.abs(gap) * 1000000 / F.col("price")).alias("shares"))


@query(f"""with {BARS}, {WEEKLY}, v as (select symbol, week_end, volume, case when count(volume) over w >= 5 then avg(volume) over w end as usual from weekly window w as (partition by symbol order by week_end rows between 10 preceding and 1 preceding)),
p as (select symbol, date, close, date + cast((12 - isodow(date)) % 7 as integer) as week_end, sum(volume) over (partition by symbol, date + cast((12 - isodow(date)) % 7 as integer) order by date rows unbounded preceding) as so_far, case when count(high) over b >= 20 then max(high) over b end as pv from bars window b as (partition by symbol order by date rows between 20 preceding and 1 preceding)),
l as (select max(date) as now from bars)
select symbol, date, week_end, round(so_far / usual, 5) as partial_ratio, round(v.volume / usual, 5) as closed_ratio, so_far >= 1.2 * usual as partial_week, v.volume >= 1.2 * usual as week_close, date_diff('day', date, now) <= 15 as recent from p join v using (symbol, week_end), l where close > pv and usual is not null""")
def weekly_confirmation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily breakouts, confirmed by their week's volume as far as it has come
    (known that day) and as it closed (known at its end), and whether they are
    at most 15 days old."""
    rows = bars(spark, sf_dir)
    weeks = Ordered(["symbol"], ["week_end"])
    usual = weeks.guarded(F.avg("volume"), "volume", weeks.rows(-10, -1), 5)
    v = market.weekly(rows).select("symbol", "week_end", F.col("volume").alias("whole"), usual.alias("usual")).where("usual is not null")
    s = Ordered(["symbol"], ["date"])
    p = rows.withColumns({"week_end": F.next_day(F.date_sub("date", 1), "FRI"), "pivot": s.guarded(F.max("high"), "high", s.rows(-20, -1), 20)})
    p = p.withColumn("so_far", F.sum("volume").over(Window.partitionBy("symbol", "week_end").orderBy("date"))).where("close > pivot")
    now = rows.agg(F.max("date").alias("now"))  # one row
    x = p.join(v, ["symbol", "week_end"]).join(F.broadcast(now))
    part, whole = F.col("so_far") / F.col("usual"), F.col("whole") / F.col("usual")
    return x.select("symbol", "date", "week_end", r(part, 5).alias("partial_ratio"), r(whole, 5).alias("closed_ratio"), (F.col("so_far") >= 1.2 * F.col("usual")).alias("partial_week"), (F.col("whole") >= 1.2 * F.col("usual")).alias("week_close"), (F.datediff("now", "date") <= 15).alias("recent"))


@query(f"""with {BARS}, x as (select symbol, date, t, close, volume, close > lag(close) over w as up, case when t >= 20 then regr_slope(close, t) over f end as slope, case when t >= 20 then regr_slope(volume, t) over f end as volume_slope, case when t >= 5 then avg(close) over (partition by symbol order by date rows between 4 preceding and current row) end as a, case when t >= 20 then avg(close) over f end as b, case when t >= 20 then avg(volume) over f end as mv from bars window w as (partition by symbol order by date), f as (partition by symbol order by date rows between 19 preceding and current row)),
y as (select *, coalesce(a > b and lag(a) over w <= lag(b) over w, false) as crossed, sum(cast(up as integer)) over (partition by symbol order by date rows between 19 preceding and current row) as ups from x window w as (partition by symbol order by date))
select symbol, date, round(slope, 3) as slope, round(volume_slope, 4) as volume_slope, round(ups / 20.0, 4) as positive_ratio, crossed, round(volume / mv, 5) as volume_ratio, cast(coalesce(slope > 1e-9, false) as integer) * 2 + cast(coalesce(volume_slope > 1e-9, false) as integer) + cast(coalesce(volume > mv and up, false) as integer) as score from y where t >= 21""")
def index_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slopes of price and volume, share of rising days, crossings, and a score
    of conditions; one sort for all of them."""
    s = Ordered(["symbol"], ["date"])
    x = bars(spark, sf_dir).withColumns({"up": F.col("close") > s.lag("close"), "slope": s.slope("close", 20, "t"), "volume_slope": s.slope("volume", 20, "t"), "a": s.mean("close", 5), "b": s.mean("close", 20), "mv": s.mean("volume", 20)})
    x = x.withColumns({"crossed": s.crossed("a", "b"), "ups": F.sum(F.col("up").cast("int")).over(s.rows(-19))}).where("t >= 21")
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    score = yes(F.col("slope") > 1e-9) * 2 + yes(F.col("volume_slope") > 1e-9) + yes((F.col("volume") > F.col("mv")) & F.col("up"))
    return x.select("symbol", "date", r("slope", 3).alias("slope"), r("volume_slope", 4).alias("volume_slope"), r(F.col("ups") / 20, 4).alias("positive_ratio"), "crossed", r(F.col("volume") / F.col("mv"), 5).alias("volume_ratio"), score.alias("score"))


@query("""select p_partkey, p_retailprice / p_size as pe, p_size > 0 and p_retailprice / p_size between 25 and 60 and p_retailprice > 1000 as passes, (case when p_retailprice / p_size < 60 then 0.5 else 0 end + case when p_retailprice > 1000 then 0.3 else 0 end + case when p_brand like '%1' then 0.2 else 0 end) as score from part""")
def fundamental_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, size = F.col("p_retailprice"), F.col("p_size")
    pe = price / size
    points = F.when(pe < 60, 0.5).otherwise(0.0) + F.when(price > 1000, 0.3).otherwise(0.0) + F.when(F.col("p_brand").endswith("1"), 0.2).otherwise(0.0)
    return table(spark, sf_dir, "part").select("p_partkey", pe.alias("pe"), ((size > 0) & pe.between(25, 60) & (price > 1000)).alias("passes"), points.alias("score"))


PENALTIES = (0.0, 0.5, 2.0)


@query(f"""with {FEATURES}, f as (select unit, year, x1 / 100000 as x, y from feat where x1 is not null), k as (select unnest([1995, 1996, 1997]) as upto), l as (select unnest([0.0, 0.5, 2.0]) as penalty),
fit as (select upto, penalty, avg(x) as mx, avg(y) as my, sum((x - m0) * (y - n0)) / (sum((x - m0) * (x - m0)) + penalty) as b, pow(corr(x, y), 2) as r2 from (select f.*, upto, avg(x) over (partition by upto) as m0, avg(y) over (partition by upto) as n0 from f, k where year <= upto), l group by 1, 2),
sc as (select upto, penalty, r2, sqrt(avg(pow(f.y - (my + b * (f.x - mx)), 2))) as rmse from fit join f on f.year = upto + 1 group by 1, 2, 3)
select cast(sc.penalty as double) as penalty, count(*) as folds, round(avg(rmse), 5) as rmse, round(max(r2), 5) as train_r2, max(r2) > 0.5 as overfit, row_number() over (order by avg(rmse), sc.penalty) = 1 as best from sc group by sc.penalty""")
def time_series_grid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folds that train on all years up to one and test on the next, for each of
    a grid of ridge penalties; both are rows, not loops. Fits that explain too
    much of what they were trained on are marked."""
    f = features(spark, sf_dir).where("x1 is not null").select("year", (F.col("x1") / 100000).alias("x"), "y")
    folds = F.array(*map(F.lit, (1995, 1996, 1997)))
    train = f.withColumn("upto", F.explode(F.filter(folds, lambda u: u >= F.col("year"))))
    n, grid_ = F.count("*"), F.explode(F.array(*map(F.lit, PENALTIES)))
    fit = train.groupBy("upto").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), (F.covar_pop("x", "y") * n).alias("sxy"), (F.var_pop("x") * n).alias("sxx"), F.pow(F.corr("x", "y"), 2).alias("r2"))
    fit = fit.withColumn("penalty", grid_).withColumn("b", F.col("sxy") / (F.col("sxx") + F.col("penalty")))
    # A row a fold and penalty: the bound of this broadcast.
    sc = f.withColumn("upto", F.col("year") - 1).join(F.broadcast(fit), "upto")
    sc = sc.groupBy("upto", "penalty", "r2").agg(F.sqrt(F.avg(F.pow(F.col("y") - F.col("my") - F.col("b") * (F.col("x") - F.col("mx")), 2))).alias("rmse"))
    g = sc.groupBy("penalty").agg(F.count("*").alias("folds"), F.avg("rmse").alias("e"), F.max("r2").alias("r2"))
    best = g.agg(F.min(F.struct("e", "penalty"))["penalty"].alias("at"))
    return g.join(F.broadcast(best)).select("penalty", "folds", r("e", 5).alias("rmse"), r("r2", 5).alias("train_r2"), (F.col("r2") > 0.5).alias("overfit"), (F.col("penalty") == F.col("at")).alias("best"))


@query(f"""with {FEATURES}, f as (select * from feat where x1 is not null and x2 is not null), d as (select a.unit, a.year, a.y, b.y as near_y, row_number() over (partition by a.unit, a.year order by pow(a.x1 - b.x1, 2) + pow(a.x2 - b.x2, 2), b.year) as place from f a join f b on a.unit = b.unit and a.year <> b.year)
select unit, year, y, round(avg(near_y), 5) as predicted from d where place <= 3 group by 1, 2, 3""")
def knn_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the three nearest other years of the unit; years bound the pairs."""
    f = features(spark, sf_dir).dropna()
    b = f.select("unit", F.col("year").alias("year_b"), F.col("x1").alias("u1"), F.col("x2").alias("u2"), F.col("y").alias("near_y"))
    far = F.pow(F.col("x1") - F.col("u1"), 2) + F.pow(F.col("x2") - F.col("u2"), 2)
    d = f.join(b, "unit").where("year <> year_b").withColumn("place", F.row_number().over(Window.partitionBy("unit", "year").orderBy(far, "year_b")))
    return d.where("place <= 3").groupBy("unit", "year", "y").agg(r(F.avg("near_y"), 5).alias("predicted"))


@query(f"""with {DAYS}, n as (select *, doy + 1 - case when (year % 4 = 0 and year % 100 <> 0 or year % 400 = 0) and month > 2 then 1 else 0 end as d365 from days where not (month = 2 and day = 29))
select cast((d365 - 1) // 5 + 1 as integer) as pentad, count(*) as n, round(avg(value), 3) as mean, cast(min(least((d365 - 1) * 360 // 365 + 1, 360)) as integer) as first_day_360 from n group by 1""")
def pentad_climatology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calendars without leap days: 73 pentads, and days of a 360-day year."""
    leap = ((F.col("year") % 4 == 0) & (F.col("year") % 100 != 0)) | (F.col("year") % 400 == 0)
    n = days(spark, sf_dir).where("not (month = 2 and day = 29)").withColumn("d", F.col("doy") + 1 - F.when(leap & (F.col("month") > 2), 1).otherwise(0))
    return n.groupBy((F.floor((F.col("d") - 1) / 5) + 1).cast("int").alias("pentad")).agg(F.count("*").alias("n"), r(F.avg("value"), 3).alias("mean"), F.min(F.least(F.floor((F.col("d") - 1) * 360 / 365) + 1, F.lit(360))).cast("int").alias("first_day_360"))


@query(f"""with {DAYS}, m as (select cast(date_trunc('month', o_orderdate) as date) as month, cast(o_custkey % 6 as integer) as lat, avg(o_totalprice) as value from orders group by 1, 2), i as (select month, avg(value) filter (lat < 3) as a, avg(value) filter (lat = 5) as b from m group by 1),
k as (select regr_slope(a, b) as s, regr_intercept(a, b) as c from i), e as (select month, a - (s * b + c) as rest from i, k) select lat, round(regr_slope(value, rest), 5) as slope, round(corr(value, rest), 5) as r from m join e using (month) group by 1""")
def regression_without_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields on an index from which what another index explains was taken."""
    o = table(spark, sf_dir, "orders")
    m = o.groupBy(F.trunc("o_orderdate", "month").alias("month"), (F.col("o_custkey") % 6).cast("int").alias("lat")).agg(F.avg("o_totalprice").alias("value"))
    i = m.groupBy("month").agg(F.avg(F.when(F.col("lat") < 3, F.col("value"))).alias("a"), F.avg(F.when(F.col("lat") == 5, F.col("value"))).alias("b"))
    k = i.agg(F.regr_slope("a", "b").alias("s"), F.regr_intercept("a", "b").alias("c"))  # one row
    e = i.join(F.broadcast(k)).select("month", (F.col("a") - F.col("s") * F.col("b") - F.col("c")).alias("rest"))
    return m.join(e, "month").groupBy("lat").agg(r(F.regr_slope("value", "rest"), 5).alias("slope"), r(F.corr("value", "rest"), 5).alias("r"))


@query(f"""with {GRID}, g as (select lat, lon, avg(value) as value from grid group by 1, 2), s as (select c_nationkey as station, c_acctbal as obs, cast(floor((c_custkey % 110) / 10.0 + 0.5) as integer) as lat, cast(floor((c_custkey % 230) / 10.0 + 0.5) as integer) as lon from customer)
select station, count(*) as n, round(sqrt(avg(pow(value / 20 - obs, 2))), 3) as rmse, round(avg(value / 20 - obs), 3) as bias from s join g using (lat, lon) group by 1""")
def station_rmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field against observations, each at the nearest cell: an equi-join on
    the rounded place."""
    g = grid(spark, sf_dir).groupBy("lat", "lon").agg(F.avg("value").alias("value"))
    at = lambda n: F.floor(F.col("c_custkey") % n / 10 + 0.5).cast("int")
    s = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("station"), F.col("c_acctbal").alias("obs"), at(110).alias("lat"), at(230).alias("lon"))
    d = F.col("value") / 20 - F.col("obs")
    return s.join(g, ["lat", "lon"]).groupBy("station").agg(F.count("*").alias("n"), r(F.sqrt(F.avg(d * d)), 3).alias("rmse"), r(F.avg(d), 3).alias("bias"))


@query(f"""with {GRID}, z as (select lat, month, avg(value) as value from grid group by 1, 2), g as (select month, lat, (lead(value) over w - lag(value) over w) / (2 * radians(10.0) * 6.371) as slope, value from z window w as (partition by month order by lat))
select month, round(avg(slope) filter (lat between 5 and 6), 4) as gradient_index, max(struct_pack(v := value, l := lat)).l as warmest_lat, round(avg(value) filter (lat between 4 and 7), 3) as crossing_flow, bool_or(slope is null) as any_null, bool_and(value > 0) as all_positive from g group by 1""")
def meridional_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By month: the northward gradient across the equator, the warmest latitude,
    the flow in a band, and whether any or all values fulfil a test."""
    import math

    w = Window.partitionBy("month").orderBy("lat")
    z = grid(spark, sf_dir).groupBy("lat", "month").agg(F.avg("value").alias("value"))
    z = z.withColumn("slope", (F.lead("value").over(w) - F.lag("value").over(w)) / (2 * math.radians(10.0) * 6.371))
    inside = lambda a, b, c: F.avg(F.when(F.col("lat").between(a, b), F.col(c)))
    return z.groupBy("month").agg(r(inside(5, 6, "slope"), 4).alias("gradient_index"), F.max(F.struct("value", "lat"))["lat"].alias("warmest_lat"), r(inside(4, 7, "value"), 3).alias("crossing_flow"), F.bool_or(F.col("slope").isNull()).alias("any_null"), F.bool_and(F.col("value") > 0).alias("all_positive"))


@query("""select event_id, ts - interval 8 hour as utc, timestamp '1950-01-01' + to_hours(event_id * 6) as decoded, date_diff('hour', timestamp '1950-01-01', ts) as coded, make_timestamp(cast(year(ts) as bigint), cast(month(ts) as bigint), cast(day(ts) as bigint), cast(hour(ts) as bigint), 30, 0.0) as assembled from events""")
def time_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local time to UTC, counts since a date and back, and components."""
    ts, origin = F.col("ts"), F.lit("1950-01-01 00:00:00").cast("timestamp_ntz")
    return table(spark, sf_dir, "events").select(
        "event_id", (ts - F.expr("interval 8 hours")).alias("utc"), F.timestamp_add("HOUR", F.col("event_id") * 6, origin).alias("decoded"), F.timestamp_diff("HOUR", origin, F.date_trunc("hour", ts).cast("timestamp_ntz")).alias("coded"),
        F.make_timestamp_ntz(F.year(ts), F.month(ts), F.day(ts), F.hour(ts), F.lit(30), F.lit(0)).alias("assembled"),
    )
