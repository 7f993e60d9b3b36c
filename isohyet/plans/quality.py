"""Quality flags and guards, ranks, pairs in windows, sampling grids, agreement of
members, and formulas over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import frames, joins, physics as ph
from ..operators.windows import Ordered, ranked_pct
from .base import DAILY, daily, query, r, table


@query("""with g as (select l_suppkey, l_returnflag || l_linestatus as sheet, count(*) filter (l_quantity <= 40) as valid from lineitem group by 1, 2)
select l_suppkey, sheet, valid from (select *, row_number() over (partition by l_suppkey order by valid desc, sheet) as place from g) where place = 1""")
def best_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each supplier's sheets the one with most valid values."""
    sheet = F.concat("l_returnflag", "l_linestatus").alias("sheet")
    g = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", sheet).agg(F.count_if(F.col("l_quantity") <= 40).alias("valid"))
    best = g.groupBy("l_suppkey").agg(F.min(F.struct((-F.col("valid")).alias("k"), "sheet")).alias("x"))
    return best.select("l_suppkey", "x.sheet", (-F.col("x.k")).alias("valid"))


@query("""select l_orderkey, l_linenumber, l_partkey, strftime(try_cast(printf('%04d-%02d-%02d %02d:%02d:00', 1990 + l_linenumber, cast(l_quantity as integer) % 14, l_partkey % 32, l_suppkey % 13 * 2 + 1, l_orderkey % 60) as timestamp), '%Y-%m-%d %H:%M') as observed from lineitem""")
def time_from_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times put together from parts; impossible ones are null."""
    month = F.col("l_quantity").cast("int") % 14
    parts = [1990 + F.col("l_linenumber"), month, F.col("l_partkey") % 32, F.col("l_suppkey") % 13 * 2 + 1, F.col("l_orderkey") % 60]
    time = F.try_make_timestamp(*[p.cast("int") for p in parts], F.lit(0))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.date_format(time, "yyyy-MM-dd HH:mm").alias("observed"))


@query("""select o_orderkey, row_number() over (partition by o_custkey, o_orderstatus order by o_orderdate, o_orderkey) > 1 as duplicated from orders""")
def duplicated_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an earlier row has the same key."""
    w = Window.partitionBy("o_custkey", "o_orderstatus").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", (F.row_number().over(w) > 1).alias("duplicated"))


@query("""with x as (select o_orderkey, o_custkey, rank() over (partition by o_custkey order by o_orderpriority) - 1 as below, count(*) over (partition by o_custkey, o_orderpriority) as same, count(*) over (partition by o_custkey) as n from orders)
select o_orderkey, round((below + below + same + 1) * 50.0 / n, 6) as percentile from x""")
def percentile_of_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each order's priority stands among its customer's, in per cent, ties
    in the middle of their places."""
    ranked = ranked_pct(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), ["o_custkey"], "o_orderpriority", "place")
    return ranked.select("o_orderkey", r(100 * F.col("place")).alias("percentile"))


@query("""with g as (select o_custkey, avg(o_totalprice) as price, count(*) as n from orders group by 1)
select 'mean' as stat, round(avg(price), 3) as price, round(avg(n), 6) as n from g union all select 'std', round(stddev_samp(price), 3), round(stddev_samp(n), 6) from g
union all select 'min', round(min(price), 3), round(min(n), 6) from g union all select 'max', round(max(price), 3), round(max(n), 6) from g""")
def group_mean_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means by group, and a row of each statistic of these means."""
    g = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.avg("o_totalprice").alias("price"), F.count("*").alias("n"))
    stats = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    row = g.agg(*[F.struct(F.lit(name).alias("stat"), r(f("price"), 3).alias("price"), r(f("n")).alias("n")).alias(name) for name, f in stats.items()])
    return row.select(F.inline(F.array(*stats)))


@query("""with f as (select l_orderkey, l_linenumber, l_partkey, case when l_extendedprice > 90000 then 4 when l_extendedprice > 80000 then 3 else 1 end as price, case when l_quantity >= 49 then 9 when l_quantity < 3 then 3 else 1 end as quantity, case when l_tax > 0.075 then 9 else 1 end as tax from lineitem)
select *, case when 4 in (price, quantity, tax) then 4 when 3 in (price, quantity, tax) then 3 when 9 in (price, quantity, tax) then 9 else 1 end as overall from f""")
def qc_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flag a column, and the flag of the row: failed before suspect before
    missing before good."""
    price, quantity = F.col("l_extendedprice"), F.col("l_quantity")
    flags = {
        "price": F.when(price > 90000, 4).when(price > 80000, 3).otherwise(1),
        "quantity": F.when(quantity >= 49, 9).when(quantity < 3, 3).otherwise(1),
        "tax": F.when(F.col("l_tax") > 0.075, 9).otherwise(1),
    }
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *[f.alias(n) for n, f in flags.items()])
    return rows.withColumn("overall", frames.overall_flag([F.col(n) for n in flags]))


@query("""with x as (select l_suppkey, case when l_quantity <= 49 then l_quantity end as q, case when l_extendedprice >= 2000 then l_extendedprice end as p from lineitem), y as (select *, case when q is not null and p is not null then p / q end as unit from x)
select l_suppkey, bool_or(unit is null) as any_missing, bool_and(q is not null) as all_counted, count(unit) as complete, round(avg(unit), 5) as unit from y group by 1""")
def complete_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value only where all its inputs are there, and whether any or all are."""
    q, p = F.when(F.col("l_quantity") <= 49, F.col("l_quantity")), F.when(F.col("l_extendedprice") >= 2000, F.col("l_extendedprice"))
    x = table(spark, sf_dir, "lineitem").select("l_suppkey", q.alias("q"), p.alias("p"))
    y = x.withColumn("unit", frames.if_complete(F.col("p") / F.col("q"), [F.col("p"), F.col("q")]))
    return y.groupBy("l_suppkey").agg(
        F.bool_or(F.isnull("unit")).alias("any_missing"), F.bool_and(F.isnotnull("q")).alias("all_counted"), F.count("unit").alias("complete"), r(F.avg("unit"), 5).alias("unit")
    )


@query("""with c as (select o_custkey % 6 as lat, (o_custkey // 6) % 8 as lon, o_orderpriority as member, avg(o_totalprice) filter (year(o_orderdate) >= 1998) - avg(o_totalprice) filter (year(o_orderdate) < 1998) as change from orders group by 1, 2, 3),
m as (select lat, lon, avg(change) as mean, count(change) as members, count(*) filter (change > 0) as up, count(*) filter (change < 0) as down from c group by 1, 2), a as (select *, case when mean > 0 then up when mean < 0 then down else 0 end as agree from m)
select lat, lon, round(mean, 3) as mean, members, agree, agree >= 0.8 * members as stippled from a""")
def sign_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where four of five members change in the direction of their mean."""
    late, price = F.year("o_orderdate") >= 1998, F.col("o_totalprice")
    cell = [(F.col("o_custkey") % 6).alias("lat"), (F.floor(F.col("o_custkey") / 6) % 8).alias("lon")]
    c = table(spark, sf_dir, "orders").groupBy(*cell, "o_orderpriority").agg((F.avg(F.when(late, price)) - F.avg(F.when(~late, price))).alias("change"))
    m = c.groupBy("lat", "lon").agg(F.avg("change").alias("mean"), F.count("change").alias("members"), F.count_if(F.col("change") > 0).alias("up"), F.count_if(F.col("change") < 0).alias("down"))
    m = m.withColumn("agree", F.when(F.col("mean") > 0, F.col("up")).when(F.col("mean") < 0, F.col("down")).otherwise(0))
    return m.select("lat", "lon", r("mean", 3).alias("mean"), "members", "agree", (F.col("agree") >= 0.8 * F.col("members")).alias("stippled"))


@query("""with s as (select o_custkey % 6 as cell, cast(year(o_orderdate) as integer) as year, avg(o_totalprice) as spring from orders where month(o_orderdate) between 3 and 5 group by 1, 2)
select cell, year, round(spring, 4) as spring, round(spring - lag(spring) over (partition by cell order by year), 4) as change from s""")
def spring_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of March to May, and their change from the spring before."""
    o = table(spark, sf_dir, "orders").where(F.month("o_orderdate").between(3, 5))
    s = o.groupBy((F.col("o_custkey") % 6).alias("cell"), F.year("o_orderdate").alias("year")).agg(F.avg("o_totalprice").alias("spring"))
    before = Ordered(["cell"], ["year"]).lag("spring")
    return s.select("cell", "year", r("spring", 4).alias("spring"), r(F.col("spring") - before, 4).alias("change"))


@query("""with x as (select p_partkey, p_size - 10.0::double as t, 0.0864 * (p_retailprice / 20 + p_retailprice / 15) as rn, (p_size / 10.0 + 1) * (4.87 / ln(67.8 * 10 - 5.42)) as u2, 101325 - 200.0::double * p_size as p from part),
y as (select *, 0.6108 * exp(17.27 * t / (t + 237.3)) as es, 1.004e-3 * p / (1000 * 2.45 * 0.622) as gamma from x), z as (select *, 4098 * es / pow(t + 237.3, 2) as slope, 0.4 * es as deficit from y),
v as (select *, 0.408 * slope * rn / (slope + gamma * (1 + 0.34 * u2)) as radiation, gamma * 900 * u2 * deficit / (t + 273) / (slope + gamma * (1 + 0.34 * u2)) as advection from z)
select p_partkey, round(rn, 6) as rn, round(u2, 6) as u2, round(radiation, 6) as radiation, round(advection, 6) as advection, round(radiation + advection, 6) as pet from v""")
def evapotranspiration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Net radiation from heat fluxes, wind at two metres, and what radiation and
    dry moving air evaporate, in mm a day."""
    s, price = F.col("p_size").cast("double"), F.col("p_retailprice")
    rows = table(spark, sf_dir, "part").withColumns({"rn": ph.net_radiation(price / 20, price / 15), "u2": ph.wind_at_2m(s / 10 + 1)})
    radiation, advection = ph.penman_monteith(F.col("rn"), s - 10, F.col("u2"), 101325 - 200 * s, F.lit(60.0))
    return rows.select("p_partkey", r("rn").alias("rn"), r("u2").alias("u2"), r(radiation).alias("radiation"), r(advection).alias("advection"), r(radiation + advection).alias("pet"))


PAIR_DAYS = 120


@query(f"""with p as (select o_custkey, cast(o_orderdate as date) as first, cast(lead(o_orderdate) over (partition by o_custkey order by o_orderdate, o_orderkey) as date) as last from orders),
w as (select o_orderkey, o_custkey, cast(o_orderdate as date) as start, cast(o_orderdate as date) + {PAIR_DAYS} as stop from orders where o_orderstatus = 'F')
select o_orderkey, count(*) as pairs, cast(max(last - first) as integer) as longest from w join p on w.o_custkey = p.o_custkey and first >= start and last <= stop group by 1""")
def pairs_in_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of neighbouring orders that lie whole in a window after a filled one."""
    o = table(spark, sf_dir, "orders").withColumn("date", F.to_date("o_orderdate"))
    last = F.lead("date").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    pairs = o.select("o_custkey", F.col("date").alias("first"), last.alias("last"))
    windows = o.where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", F.col("date").alias("start"), F.date_add("date", PAIR_DAYS).alias("stop"))
    found = joins.pairs_within(pairs, windows, ["o_custkey"], 64)
    return found.groupBy("o_orderkey").agg(F.count("*").alias("pairs"), F.max(F.date_diff("last", "first")).alias("longest"))


@query("""with b as (select p_brand, min(p_retailprice) as low, max(p_retailprice) as high from part group by 1), i as (select cast(unnest(range(5)) as integer) as i) select p_brand, i, round(low + i * (high - low) / 4, 6) as x from b cross join i""")
def even_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five evenly spaced values from the least to the greatest of each group."""
    b = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.min("p_retailprice").alias("low"), F.max("p_retailprice").alias("high"))
    return b.select("p_brand", F.posexplode(frames.spaced(F.col("low"), F.col("high"), 5)).alias("i", "x")).withColumn("x", r("x"))


@query("""with t as (select * from lineitem where l_shipdate < '1999-01-01'), g as (select l_suppkey, regr_r2(l_extendedprice, l_quantity) as quantity, regr_r2(l_extendedprice, l_tax) as tax from t group by 1)
select l_suppkey, feature, round(r2, 5) as r2, r2 <= 0.5 as kept from (unpivot g on quantity, tax into name feature value r2)""")
def overfit_rejection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fits of one feature on the early rows; one that explains more than half of
    them is rejected."""
    t = table(spark, sf_dir, "lineitem").where("l_shipdate < '1999-01-01'")
    fits = {"quantity": F.regr_r2("l_extendedprice", "l_quantity"), "tax": F.regr_r2("l_extendedprice", "l_tax")}
    long = t.groupBy("l_suppkey").agg(*[f.alias(n) for n, f in fits.items()]).unpivot(["l_suppkey"], list(fits), "feature", "r2").dropna()
    return long.select("l_suppkey", "feature", r("r2", 5).alias("r2"), (F.col("r2") <= 0.5).alias("kept"))


@query(f"""with {DAILY}, x as (select *, lag(n) over w as before, lead(n) over w as after from daily window w as (partition by event_type order by date))
select event_type, date, round(0.25 * before + 0.5 * n + 0.25 * after, 6) as smooth from x where before is not null and after is not null""")
def convolution_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A kernel over each series, only where the whole kernel is on it."""
    smooth = Ordered(["event_type"], ["date"]).weighted("n", [0.25, 0.5, 0.25])
    return daily(spark, sf_dir).select("event_type", "date", r(smooth).alias("smooth")).dropna()


@query("""select user_id, cast(ts as date) as date, round(max(value), 6) as value, cast(max(struct_pack(v := value, h := -hour(ts))).h * -1 as integer) as hour from events group by 1, 2""")
def daily_maximum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greatest value of each day, and the first hour that has it."""
    top = F.max(F.struct("value", (-F.hour("ts")).alias("h")))
    g = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("date")).agg(top.alias("x"))
    return g.select("user_id", "date", r("x.value").alias("value"), (-F.col("x.h")).alias("hour"))


@query("""select split_part(p_name, ' ', 2) as family, count(distinct split_part(p_name, ' ', 1)) as variants, count(*) as n, round(avg(p_retailprice), 5) as price from part group by 1""")
def name_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants of a family, both read from names."""
    word = lambda i: F.split_part("p_name", F.lit(" "), F.lit(i))
    return table(spark, sf_dir, "part").groupBy(word(2).alias("family")).agg(F.count_distinct(word(1)).alias("variants"), F.count("*").alias("n"), r(F.avg("p_retailprice"), 5).alias("price"))


@query("""select l_orderkey, l_linenumber, l_partkey, round(case when cast(l_quantity as integer) <> 50 then cast(l_quantity as integer) * 0.01 + 273.15 end, 6) as value from lineitem""")
def unpacked_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small integers with a scale, an offset and a fill value."""
    value = frames.affine_unpack(F.col("l_quantity").cast("short"), 0.01, 273.15, 50)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", r(value).alias("value"))


@query("""select case o_orderstatus when 'F' then 'filled' when 'O' then 'open' else 'other' end as label, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by 1""")
def code_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes by a map of labels; a code that is not in it is 'other'."""
    label = frames.labelled(F.col("o_orderstatus"), {"F": "filled", "O": "open"}, "other")
    return table(spark, sf_dir, "orders").groupBy(label.alias("label")).agg(F.count("*").alias("n"), r(F.sum("o_totalprice"), 2).alias("total"))
