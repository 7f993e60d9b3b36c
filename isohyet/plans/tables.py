"""Aggregation, reshaping, cleaning, scalar and set queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import frames, physics as ph
from .base import query, r, table

YEARS = list(range(1995, 2002))
MONTHS = list(range(1, 13))


@query("""with g as (select o_custkey % 5 as region, cast(year(o_orderdate) as integer) as year, count(distinct o_custkey) as customers, count(*) as orders from orders where o_totalprice > 100000 group by 1, 2),
k as (select cast(unnest(generate_series(0, 4)) as bigint) as region), y as (select cast(unnest(generate_series(1995, 2001)) as integer) as year)
select region, year, coalesce(customers, 0) as customers, coalesce(orders, 0) as orders, round(avg(coalesce(orders, 0)) over (partition by region), 4) as climatology from k cross join y left join g using (region, year)""")
def yearly_distinct_counts_zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_totalprice > 100000")
    g = o.groupBy((F.col("o_custkey") % 5).alias("region"), F.year("o_orderdate").alias("year")).agg(F.count_distinct("o_custkey").alias("customers"), F.count("*").alias("orders"))
    keys = spark.range(5).select(F.col("id").alias("region"), F.explode(F.array(*map(F.lit, YEARS))).alias("year"))
    out = keys.join(g, ["region", "year"], "left").fillna(0, ["customers", "orders"])
    return out.withColumn("climatology", r(F.avg("orders").over(Window.partitionBy("region")), 4))


@query("""select l_orderkey, l_linenumber, l_partkey, case when l_extendedprice > 90000 then 'high' when l_quantity < 1 or l_quantity > 50 then 'range' when l_discount < 0 or l_discount > 0.1 then 'discount' else 'ok' end as flag,
least(l_discount, l_tax) as low_rate, greatest(l_discount, l_tax) as high_rate from lineitem""")
def qc_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, q, d = F.col("l_extendedprice"), F.col("l_quantity"), F.col("l_discount")
    flag = F.when(price > 90000, "high").when((q < 1) | (q > 50), "range").when((d < 0) | (d > 0.1), "discount").otherwise("ok")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", flag.alias("flag"), F.least("l_discount", "l_tax").alias("low_rate"), F.greatest("l_discount", "l_tax").alias("high_rate"))


@query("""select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 4) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, round(avg(l_discount), 6) as avg_disc, round(var_samp(l_quantity) / avg(l_quantity), 6) as vmr,
 round(median(l_quantity), 4) as med, round(quantile_cont(l_extendedprice, 0.9), 4) as p90 from lineitem group by 1, 2""")
def multi_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), r(F.sum("l_quantity"), 4).alias("sum_qty"), r(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), r(F.avg("l_discount")).alias("avg_disc"),
        r(F.var_samp("l_quantity") / F.avg("l_quantity")).alias("vmr"), r(F.median("l_quantity"), 4).alias("med"), r(F.percentile("l_extendedprice", 0.9), 4).alias("p90"),
    )


@query("""select o_custkey % 10 as bucket, max(struct_pack(d := o_orderdate, k := o_orderkey, s := o_orderstatus)).s as last_status, min(struct_pack(p := o_totalprice, k := o_orderkey)).k as cheapest,
 cast(count_if(o_orderstatus = 'F') as bigint) as n_f, round(exp(sum(ln(1 + o_totalprice / 1e9))) - 1, 8) as compound, count(distinct o_orderpriority) as priorities from orders group by 1""")
def first_last_and_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 10).alias("bucket")).agg(
        F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey", "o_orderstatus")).alias("last_status"), F.min(F.struct("o_totalprice", "o_orderkey"))["o_orderkey"].alias("cheapest"),
        F.count_if(F.col("o_orderstatus") == "F").alias("n_f"), r(F.exp(F.sum(F.log1p(F.col("o_totalprice") / 1e9))) - 1, 8).alias("compound"), F.count_distinct("o_orderpriority").alias("priorities"),
    )


@query("""select cast(year(o_orderdate) as integer) as year, coalesce(count(*) filter (o_orderstatus = 'F'), 0) as f, coalesce(count(*) filter (o_orderstatus = 'O'), 0) as o, coalesce(count(*) filter (o_orderstatus = 'P'), 0) as p from orders group by 1""")
def pivot_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year")).pivot("o_orderstatus", ["F", "O", "P"]).count()
    return g.fillna(0).toDF("year", "f", "o", "p")


@query("""select cast(year(o_orderdate) as integer) as year, cast(month(o_orderdate) as integer) as month, round(sum(o_totalprice), 2) as total from orders group by 1, 2""")
def unpivot_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide year by month, and back to long rows."""
    rows = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"), "o_totalprice")
    wide = rows.groupBy("year").pivot("month", MONTHS).agg(F.sum("o_totalprice"))
    long = wide.unpivot(["year"], [str(m) for m in MONTHS], "month", "total").dropna()
    return long.select("year", F.col("month").cast("int").alias("month"), r("total", 2).alias("total"))


@query("""select cast(least(greatest(floor((l_extendedprice - 0) / 10000) + 1, 0), 11) as bigint) as bin, count(*) as n, round(avg(l_quantity), 6) as mean_q from lineitem group by 1""")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.width_bucket("l_extendedprice", F.lit(0.0), F.lit(100000.0), F.lit(10)).alias("bin")).agg(F.count("*").alias("n"), r(F.avg("l_quantity")).alias("mean_q"))


@query("""select cast(greatest(ceil(l_quantity / 10), 1) as integer) as i, cast(greatest(ceil(l_discount / 0.02), 1) as integer) as j, date_trunc('year', l_shipdate)::date as bin, round(avg(l_extendedprice), 4) as mean_price, count(*) as nobs from lineitem group by 1, 2, 3""")
def grid_bin_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Right-closed bins in two dimensions and time."""
    i, j = F.greatest(F.ceil(F.col("l_quantity") / 10), F.lit(1)).cast("int"), F.greatest(F.ceil(F.col("l_discount") / 0.02), F.lit(1)).cast("int")
    return table(spark, sf_dir, "lineitem").groupBy(i.alias("i"), j.alias("j"), F.trunc("l_shipdate", "year").alias("bin")).agg(r(F.avg("l_extendedprice"), 4).alias("mean_price"), F.count("*").alias("nobs"))


@query("""select p_brand, round(avg(p_retailprice) filter (p_size <= 10), 4) as small, round(avg(p_retailprice) filter (p_size > 10), 4) as large, round(avg(p_retailprice) filter (p_size <= 10) - avg(p_retailprice) filter (p_size > 10), 4) as diff, round(100 * avg(cast(p_retailprice <= 1200 as int)), 4) as pct_below from part group by 1""")
def conditional_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    small, large = F.avg(F.when(F.col("p_size") <= 10, F.col("p_retailprice"))), F.avg(F.when(F.col("p_size") > 10, F.col("p_retailprice")))
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(r(small, 4).alias("small"), r(large, 4).alias("large"), r(small - large, 4).alias("diff"), r(100 * F.avg((F.col("p_retailprice") <= 1200).cast("int")), 4).alias("pct_below"))


@query("""with x as (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as nth from events) select user_id, event_type, event_id as last_event, cast(json_extract(props, '$.k') as integer) as k from x where nth = 1""")
def dedupe_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames.keep_one(table(spark, sf_dir, "events"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")], last=True)
    return rows.select("user_id", "event_type", F.col("event_id").alias("last_event"), F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("""with a as (select distinct o_custkey as k from orders where year(o_orderdate) = 1996), b as (select distinct o_custkey as k from orders where year(o_orderdate) = 1997)
select k, 'both' as side from a where k in (select k from b) union all select k, 'first' from a where k not in (select k from b) union all select k, 'second' from b where k not in (select k from a)""")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    a, b = (o.where(F.year("o_orderdate") == y).select(F.col("o_custkey").alias("k")).distinct() for y in (1996, 1997))
    side = lambda df, name: df.withColumn("side", F.lit(name))
    return side(a.intersect(b), "both").unionByName(side(a.subtract(b), "first")).unionByName(side(b.subtract(a), "second"))


@query("""select s_suppkey, upper(trim(s_name)) as name, lpad(cast(s_suppkey as varchar), 6, '0') as code, regexp_replace(s_name, '[^0-9]', '', 'g') as digits, split_part(s_name, '#', 1) as head, md5(s_name) as digest,
 concat(s_nationkey, '_', lpad(cast(s_suppkey as varchar), 4, '0')) as key, case when s_acctbal < 0 then 'debt' when s_acctbal < 5000 then 'mid' else 'rich' end as class, try_cast(substr(s_name, 1, 3) as double) as num from supplier""")
def string_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(
        "s_suppkey", F.upper(F.trim("s_name")).alias("name"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("code"), F.regexp_replace("s_name", "[^0-9]", "").alias("digits"),
        F.split_part("s_name", F.lit("#"), F.lit(1)).alias("head"), F.md5("s_name").alias("digest"), F.concat_ws("_", F.col("s_nationkey").cast("string"), F.lpad(F.col("s_suppkey").cast("string"), 4, "0")).alias("key"),
        F.when(F.col("s_acctbal") < 0, "debt").when(F.col("s_acctbal") < 5000, "mid").otherwise("rich").alias("class"), F.expr("try_cast(substr(s_name, 1, 3) as double)").alias("num"),
    )


WX = "wx as (select p_partkey, p_size * 7.0 as dir, p_retailprice / 100.0 as spd, p_size - 10.0 as t, p_size / 2.0 - 10.0 as dew, 1000.0 - p_size * 5 as p from part), "


@query(f"""with {WX} uv as (select *, -spd * sin(radians(dir)) as u, -spd * cos(radians(dir)) as v, 6.112 * exp(17.67 * t / (t + 243.5)) as es, 6.112 * exp(17.67 * dew / (dew + 243.5)) as e from wx)
select p_partkey, round(u, 6) as u, round(v, 6) as v, round(least(100.0, greatest(0.0, 100 * e / es)), 6) as rh, round(0.622 * e / (p - 0.378 * e), 8) as q, round((t + 273.15) * pow(1000.0 / p, 0.2854), 6) as theta,
round(1004.0 * (t + 273.15) + 9.81 * 100 + 2.5e6 * (0.622 * e / (p - 0.378 * e)), 3) as mse from uv""")
def meteorology(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size").cast("double")
    wx = table(spark, sf_dir, "part").select("p_partkey", (s * 7).alias("dir"), (F.col("p_retailprice") / 100).alias("spd"), (s - 10).alias("t"), (s / 2 - 10).alias("dew"), (1000 - s * 5).alias("p"))
    u, v = ph.wind_uv(F.col("dir"), F.col("spd"))
    t, p, e = F.col("t"), F.col("p"), ph.vapour_pressure(F.col("dew"))
    q = ph.specific_humidity(e, p)
    return wx.select("p_partkey", r(u).alias("u"), r(v).alias("v"), r(ph.relative_humidity(t, F.col("dew"))).alias("rh"), r(q, 8).alias("q"), r(ph.potential_temperature(t + 273.15, p)).alias("theta"), r(ph.moist_static_energy(t + 273.15, F.lit(981.0), q), 3).alias("mse"))


@query("""select p_partkey, round(case when p_size * 13.0 % 360 >= 180 then p_size * 13.0 % 360 - 360 else p_size * 13.0 % 360 end, 6) as lon, (p_size * 8 % 4 = 0 and p_size * 8 % 100 <> 0) or p_size * 8 % 400 = 0 as leap,
round(case when p_size / 50.0 <= 0.25 then 1.2 when p_size / 50.0 >= 0.8 then 0.0 else 1.2 * (0.8 - p_size / 50.0) / (0.8 - 0.25) end, 6) as weight, round(pow(1 + p_size / 100.0, 1 / 12.0) - 1, 8) as monthly from part""")
def calendar_and_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", r(ph.wrap_longitude(s * 13.0)).alias("lon"), ph.is_leap(s * 8).alias("leap"), r(ph.piecewise_weight(s / 50, 0.25, 0.8, 1.2)).alias("weight"), r(ph.monthly_rate(s / 100), 8).alias("monthly"))


@query("""select o.o_orderpriority, c.c_mktsegment, n.n_name, count(*) as n, round(sum(o_totalprice), 2) as total from orders o join customer c on o_custkey = c_custkey join nation n on c_nationkey = n_nationkey where o_orderdate between '1996-01-01' and '1996-12-31' and c_mktsegment like '%U%' group by 1, 2, 3""")
def chained_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where(F.col("o_orderdate").between("1996-01-01", "1996-12-31"))
    c = table(spark, sf_dir, "customer").where(F.col("c_mktsegment").contains("U"))
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("o_orderpriority", "c_mktsegment", "n_name").agg(F.count("*").alias("n"), r(F.sum("o_totalprice"), 2).alias("total"))
