"""Event-series queries: joins in time and space, gaps, runs, calendars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import joins
from ..operators.windows import Ordered, interpolated, islands, merged_intervals
from .base import DAILY, GRID, daily, grid, query, r, table


@query("""select a.event_id, a.user_id, a.ts, b.ts as error_ts, b.value as error_value
from (select * from events where event_type = 'purchase') a asof left join
(select user_id, ts, max(value) as value from events where event_type = 'error' group by 1, 2) b on a.user_id = b.user_id and a.ts >= b.ts""")
def asof_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'error'").select("user_id", "ts", F.col("ts").alias("error_ts"), F.col("value").alias("error_value"))
    return joins.asof(left, right, ["user_id"], "ts", ["error_ts", "error_value"])


@query("""select a.event_id, a.user_id, b.ts as next_ts from (select * from events where event_type = 'click') a asof left join
(select distinct user_id, ts from events where event_type = 'purchase') b on a.user_id = b.user_id and a.ts < b.ts""")
def asof_forward_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    left = e.where("event_type = 'click'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'purchase'").select("user_id", "ts", F.col("ts").alias("next_ts"))
    return joins.asof(left, right, ["user_id"], "ts", ["next_ts"], "forward", strict=True).select("event_id", "user_id", "next_ts")


@query("""with m as (select last_day(o_orderdate) as month_end, avg(o_totalprice) as v from orders group by 1),
q as (select distinct cast(o_orderdate as date) as d from orders)
select d, month_end as known_month, round(v, 4) as v from (select d, last_day(d - interval 1 month) as lim from q) x asof left join m on x.lim >= m.month_end""")
def asof_publication_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d"), "o_totalprice")
    months = o.groupBy(F.last_day("d").alias("at")).agg(F.avg("o_totalprice").alias("v")).select(F.lit(1).alias("k"), "at", F.col("at").alias("known_month"), "v")
    days = o.select("d").distinct().select(F.lit(1).alias("k"), "d", F.last_day(F.add_months("d", -1)).alias("at"))
    return joins.asof(days, months, ["k"], "at", ["known_month", "v"]).select("d", "known_month", r("v", 4).alias("v"))


@query("""select event_id, cast(ts as date) + cast((12 - isodow(ts)) % 7 as integer) as week_end, last_day(ts) as month_end,
cast(least((dayofyear(ts) - 1) // 5, 72) as integer) as pentad, cast(quarter(ts) as integer) as quarter, date_trunc('minute', ts + interval 30 second) as minute from events""")
def calendar_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", F.next_day(F.date_sub(F.to_date("ts"), 1), "FRI").alias("week_end"), F.last_day("ts").alias("month_end"),
        F.least(F.floor((F.dayofyear("ts") - 1) / 5), F.lit(72)).cast("int").alias("pentad"), F.quarter("ts").alias("quarter"),
        F.date_trunc("minute", F.col("ts") + F.expr("interval 30 seconds")).cast("timestamp_ntz").alias("minute"),
    )


@query(f"""with {DAILY}, f as (select event_type, date from daily where value > 55)
select distinct d.event_type, d.date, d.n from daily d join f on d.event_type = f.event_type and d.date between f.date + 1 and f.date + 3""")
def interval_join_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = daily(spark, sf_dir)
    opened = d.where("value > 55").select("event_type", F.date_add("date", 1).alias("start"), F.date_add("date", 3).alias("end"))
    return joins.in_intervals(d, opened, ["event_type"], "date", "start", "end").select("event_type", "date", "n")


INTERVALS = """
ivs as (select user_id, event_id, cast(ts as date) as s, cast(ts as date) + cast(event_id % 4 as integer) as e, event_type from events)
"""


@query(f"""with {INTERVALS} select a.user_id, a.event_id as a_id, b.event_id as b_id, greatest(a.s, b.s) as start, least(a.e, b.e) as "end"
from ivs a join ivs b on a.user_id = b.user_id where a.event_type = 'purchase' and b.event_type = 'error' and greatest(a.s, b.s) <= least(a.e, b.e)""")
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", F.to_date("ts").alias("s"), F.expr("date_add(to_date(ts), int(event_id % 4))").alias("e"))
    a = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("a_id"), F.col("s").alias("a_start"), F.col("e").alias("a_end"))
    b = e.where("event_type = 'error'").select("user_id", F.col("event_id").alias("b_id"), F.col("s").alias("b_start"), F.col("e").alias("b_end"))
    return joins.overlaps(a, b, ["user_id"]).select("user_id", "a_id", "b_id", "start", "end")


@query(f"""with {INTERVALS}, x as (select user_id, s, e, max(e) over (partition by user_id order by s, e rows between unbounded preceding and 1 preceding) as before from ivs where event_type = 'signup'),
y as (select *, sum(case when before is null or s > before then 1 else 0 end) over (partition by user_id order by s, e rows unbounded preceding) as island from x)
select user_id, min(s) as s, max(e) as e, count(*) as n from y group by user_id, island""")
def merge_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type = 'signup'").select("user_id", F.to_date("ts").alias("s"), F.expr("date_add(to_date(ts), int(event_id % 4))").alias("e"))
    return merged_intervals(e, ["user_id"], "s", "e")


@query("select c.c_custkey, c.c_name from customer c where exists (select 1 from orders o where o.o_custkey = c.c_custkey and o.o_totalprice > 200000)")
def semi_join_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(big, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("select c.c_custkey, c.c_name from customer c where not exists (select 1 from orders o where o.o_custkey = c.c_custkey and year(o.o_orderdate) = 1996)")
def anti_join_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").where(F.year("o_orderdate") == 1996).select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey", "c_name")


@query(f"""with {DAILY}, a as (select date, n as click from daily where event_type = 'click'), b as (select date, n as view_ from daily where event_type = 'view' and n % 2 = 0), c as (select date, n as error from daily where event_type = 'error')
select date, click, view_, error from a join b using (date) join c using (date)""")
def multi_series_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = daily(spark, sf_dir)
    one = lambda kind, name: d.where(F.col("event_type") == kind).select("date", F.col("n").alias(name))
    return one("click", "click").join(one("view", "view_").where("view_ % 2 = 0"), "date").join(one("error", "error"), "date")


@query(f"""with {DAILY}, a as (select date, n from daily where event_type = 'click' and n % 2 = 0), b as (select date, n from daily where event_type = 'view' and n % 3 = 0)
select coalesce(a.date, b.date) as date, a.n as click, b.n as view_, coalesce(a.n, b.n) as first_n from a full join b on a.date = b.date""")
def outer_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = daily(spark, sf_dir)
    a = d.where("event_type = 'click' and n % 2 = 0").select("date", F.col("n").alias("click"))
    b = d.where("event_type = 'view' and n % 3 = 0").select("date", F.col("n").alias("view_"))
    return a.join(b, "date", "full").withColumn("first_n", F.coalesce("click", "view_"))


SPARSE = f"""{DAILY}, ends as (select event_type, min(date) as a, max(date) as b from daily group by 1),
days as (select event_type, cast(unnest(generate_series(a, b, interval 1 day)) as date) as date from ends),
sparse as (select days.event_type, days.date, case when dayofyear(days.date) % 5 not in (2, 3) then value end as value, date_diff('day', a, days.date) as x
 from days join ends using (event_type) left join daily using (event_type, date))"""


def sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily means on a full calendar with holes of two days in five."""
    d = daily(spark, sf_dir).select("event_type", "date", F.col("value").alias("v"))
    rows = joins.completed(d, joins.days_between(d, ["event_type"], "date"), ["event_type", "date"], {})
    first = F.min("date").over(Window.partitionBy("event_type"))
    return rows.select("event_type", "date", F.when(~(F.dayofyear("date") % 5).isin(2, 3), F.col("v")).alias("value"), F.datediff("date", first).alias("x"))


@query(f"""with {SPARSE}, y as (select *, max(case when value is not null then x end) over (partition by event_type order by x rows unbounded preceding) as x0,
 min(case when value is not null then x end) over (partition by event_type order by x rows between current row and unbounded following) as x1 from sparse),
z as (select y.*, p.value as v0, q.value as v1 from y left join sparse p on p.event_type = y.event_type and p.x = y.x0 left join sparse q on q.event_type = y.event_type and q.x = y.x1)
select event_type, date, round(coalesce(value, v0 + (v1 - v0) * (x - x0) / nullif(x1 - x0, 0)), 6) as filled, round(coalesce(value, case when x - x0 <= 1 then v0 + (v1 - v0) * (x - x0) / nullif(x1 - x0, 0) end), 6) as filled_one from z""")
def interpolate_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = interpolated(interpolated(sparse(spark, sf_dir), ["event_type"], "x", "value", "filled"), ["event_type"], "x", "value", "filled_one", limit=1)
    return rows.select("event_type", "date", r("filled").alias("filled"), r("filled_one").alias("filled_one"))


@query(f"""with {SPARSE} select event_type, date, round(last_value(value ignore nulls) over (w rows unbounded preceding), 6) as forward, round(first_value(value ignore nulls) over (w rows between current row and unbounded following), 6) as backward,
round(coalesce(value, case when count(value) over (w rows between 3 preceding and 3 following) >= 2 then avg(value) over (w rows between 3 preceding and 3 following) end), 6) as centred from sparse window w as (partition by event_type order by x)""")
def ffill_bfill_centred(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Ordered(["event_type"], ["x"])
    filled = F.coalesce("value", s.centred_mean("value", 7, 2))
    return sparse(spark, sf_dir).select("event_type", "date", r(s.ffill("value")).alias("forward"), r(s.bfill("value")).alias("backward"), r(filled).alias("centred"))


@query(f"""with {DAILY}, x as (select *, value > 50 as hot from daily), y as (select *, sum(case when hot is distinct from before then 1 else 0 end) over (partition by event_type order by date rows unbounded preceding) as run
 from (select *, lag(hot) over (partition by event_type order by date) as before from x))
select event_type, min(date) as start, max(date) as "end", count(*) as length from y where hot group by event_type, run""")
def gaps_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return islands(daily(spark, sf_dir), ["event_type"], "date", F.col("value") > 50)


@query(f"""with {DAILY}, x as (select *, value > 48 as hot from daily), y as (select *, sum(case when hot is distinct from before then 1 else 0 end) over (partition by event_type order by date rows unbounded preceding) as run
 from (select *, lag(hot) over (partition by event_type order by date) as before from x)), z as (select event_type, count(*) as length from y where hot group by event_type, run having count(*) >= 3)
select event_type, count(*) as waves, round(avg(length), 6) as mean_length, max(length) as longest from z group by 1""")
def heatwave_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = islands(daily(spark, sf_dir), ["event_type"], "date", F.col("value") > 48, min_length=3)
    return runs.groupBy("event_type").agg(F.count("*").alias("waves"), r(F.avg("length")).alias("mean_length"), F.max("length").alias("longest"))


@query(f"""with {DAILY}, x as (select *, row_number() over (partition by event_type order by date) as d, avg(value) over a5 as m5, count(*) over a5 as c5, sum(cast(value > 49 as int)) over a20 as p20, avg(value) over a20 as m20, count(*) over a20 as c20 from daily
 window a5 as (partition by event_type order by date rows between current row and 4 following), a20 as (partition by event_type order by date rows between current row and 19 following))
select event_type, min(d) as onset from x where value >= 49 and c5 = 5 and c20 = 20 and m5 >= 49 and p20 >= 10 and m20 > 49.5 group by 1""")
def monsoon_onset_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First day that reaches a value, as do the five from it on in the mean and
    enough of twenty each by itself, the twenty being over another in the mean."""
    s = Ordered(["event_type"], ["date"])
    ahead = lambda agg, n: s.guarded(agg, "value", s.rows(0, n - 1), n)
    rows = daily(spark, sf_dir).withColumns({"d": F.row_number().over(s.spec()).cast("long"), "m5": ahead(F.avg("value"), 5), "p20": ahead(F.sum((F.col("value") > 49).cast("int")), 20), "m20": ahead(F.avg("value"), 20)})
    return rows.where("value >= 49 and m5 >= 49 and p20 >= 10 and m20 > 49.5").groupBy("event_type").agg(F.min("d").alias("onset"))


@query(f"""with {DAILY}, a as (select date, value as v from daily where event_type = 'click'), b as (select date, value as w from daily where event_type = 'view'), h as (select unnest(generate_series(-3, 3)) as lag)
select cast(lag as integer) as lag, count(*) as n, round(corr(v, w), 6) as r from h join a on true join b on b.date = a.date + cast(lag as integer) group by 1""")
def lagged_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = daily(spark, sf_dir)
    a = d.where("event_type = 'click'").select("date", F.col("value").alias("v"))
    lags = a.withColumn("lag", F.explode(F.sequence(F.lit(-3), F.lit(3)))).select("v", "lag", F.expr("date_add(date, lag)").alias("date"))
    b = d.where("event_type = 'view'").select("date", F.col("value").alias("w"))
    return lags.join(b, "date").groupBy("lag").agg(F.count("*").alias("n"), r(F.corr("v", "w")).alias("r"))


@query(f"""with {DAILY}, x as (select event_type, date, value, list(value) over (partition by event_type order by date range between interval 9 days preceding and current row) as held from daily)
select event_type, date, round(case when len(held) >= 5 then len(list_filter(held, lambda v: v <= value)) / cast(len(held) as double) end, 6) as share from x""")
def calendar_range_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = daily(spark, sf_dir).withColumn("day", F.datediff("date", F.lit("1970-01-01").cast("date")))
    w = Window.partitionBy("event_type").orderBy("day").rangeBetween(-9, 0)
    held = F.collect_list("value").over(w)
    share = F.size(F.filter(held, lambda v: v <= F.col("value"))) / F.size(held)
    return d.select("event_type", "date", r(F.when(F.size(held) >= 5, share)).alias("share"))


@query("""with s as (select user_id, event_id, ts, cast(sum(case when ts - before <= interval 12 hour then 0 else 1 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as bigint) as sess
 from (select *, lag(ts) over (partition by user_id order by ts, event_id) as before from events))
select user_id, sess as session, min(ts) as start, max(ts) as "end", count(*) as n from s group by 1, 2""")
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Ordered(["user_id"], ["ts", "event_id"])
    gap = F.coalesce((F.col("ts") - s.lag("ts") > F.expr("interval 12 hours")).cast("int"), F.lit(1))
    rows = table(spark, sf_dir, "events").withColumn("new", gap)
    rows = rows.withColumn("session", s.cumulative(F.sum("new")))
    return rows.groupBy("user_id", "session").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("n"))


COORD = "(({k} * 37) % 140) - 70.0 + ({k} % 7) * 0.1", "(({k} * 53) % 360) - 180.0 + ({k} % 11) * 0.1"


def coords(k: str) -> tuple[str, str]:
    return tuple(c.format(k=k) for c in COORD)


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat, lon = coords("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", F.expr(lat).cast("double").alias("lat"), F.expr(lon).cast("double").alias("lon"))


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat, lon = coords("s_suppkey")
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.expr(lat).cast("double").alias("slat"), F.expr(lon).cast("double").alias("slon"))


POINTS = "pts as (select c_custkey, cast({} as double) as lat, cast({} as double) as lon from customer), sites as (select s_suppkey, cast({} as double) as slat, cast({} as double) as slon from supplier)".format(*coords("c_custkey"), *coords("s_suppkey"))
KM = "2 * 6371.0088 * asin(sqrt(least(pow(sin(radians(slat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(slat)) * pow(sin(radians(slon - lon) / 2), 2), 1.0)))"


@query(f"""with {POINTS}, d as (select c_custkey, s_suppkey, {KM} as km from pts, sites)
select c_custkey, cast(place as integer) as place, s_suppkey, round(km, 4) as km from (select *, row_number() over (partition by c_custkey order by km, s_suppkey) as place from d) where place <= 3""")
def knn_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.nearest(_points(spark, sf_dir), _sites(spark, sf_dir), "c_custkey", "s_suppkey", 3).withColumn("km", r("km", 4))


@query(f"""with {POINTS} select c_custkey, (lat between -30 and 40 and (lon >= 150 or lon <= -120)) as pacific,
(lat between 0 and 60 and lon between -20 and 50) as box from pts""")
def bbox_dateline(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat, lon = F.col("lat"), F.col("lon")
    return _points(spark, sf_dir).select("c_custkey", joins.in_box(lat, lon, -30, 40, 150, -120).alias("pacific"), joins.in_box(lat, lon, 0, 60, -20, 50).alias("box"))


@query(f"""with {POINTS} select c_custkey from pts where lat - lon < 60.05 and lat + lon < 60.05 and lat + lon > -60.05 and lat - lon > -60.05""")
def point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in a diamond around the origin."""
    ring = [(60.05, 0.0), (0.0, 60.05), (-60.05, 0.0), (0.0, -60.05)]
    return _points(spark, sf_dir).where(joins.in_ring(F.col("lat"), F.col("lon"), ring)).select("c_custkey")


@query(f"""with {GRID}, g as (select lat, lon, avg(value) as v from grid group by 1, 2), p as (select c_custkey, (c_custkey % 110) / 10.0 + 0.03 as lat, (c_custkey % 230) / 10.0 + 0.07 as lon from customer),
w as (select p.*, floor(lat) as i, floor(lon) as j, lat - floor(lat) as y, lon - floor(lon) as x from p)
select c_custkey, round((1 - y) * (1 - x) * a.v + (1 - y) * x * b.v + y * (1 - x) * c.v + y * x * d.v, 4) as value from w
left join g a on a.lat = i and a.lon = j left join g b on b.lat = i and b.lon = j + 1 left join g c on c.lat = i + 1 and c.lon = j left join g d on d.lat = i + 1 and d.lon = j + 1""")
def bilinear_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid(spark, sf_dir).groupBy("lat", "lon").agg(F.avg("value").alias("value"))
    p = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 110 / 10 + 0.03).alias("lat"), (F.col("c_custkey") % 230 / 10 + 0.07).alias("lon"))
    return joins.bilinear(p, g, 1.0, "value").select("c_custkey", r("value", 4).alias("value"))
