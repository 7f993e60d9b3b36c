"""Queries over files that are written from the given tables into the shared
folder, and read back through the library's readers and stores."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import frames
from ..session import reachable, shared_root
from ..sources import stores, text
from .base import GRID, grid, query, r, table


def place(spark: SparkSession, name: str) -> str:
    return f"{shared_root(reachable(spark))}/{name}-{uuid.uuid4().hex}"


@query("select cast(s_nationkey as varchar) as nation, count(*) as suppliers, round(sum(s_acctbal), 2) as balance from supplier group by 1")
def csv_with_unit_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV files whose first row names units; codes stay text."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("string").alias("nation"), "s_acctbal")
    units = s.groupBy().agg(F.lit("number").alias("s_suppkey"), F.lit("code").alias("nation"), F.lit("dollars").alias("s_acctbal"))
    path = place(spark, "csv")
    stores.save_csv(units.union(s.select(*[F.col(c).cast("string") for c in s.columns])), path)
    rows = text.csv(spark, path, "s_suppkey long, nation string, s_acctbal double", key="s_suppkey")
    return rows.groupBy("nation").agg(F.count("*").alias("suppliers"), r(F.sum("s_acctbal"), 2).alias("balance"))


@query("""with m as (select cast(year(o_orderdate) as integer) as year, cast(month(o_orderdate) as integer) as month, round(avg(o_totalprice) / 1000, 2) as value, count(*) as n from orders group by 1, 2), y as (select distinct year from m), c as (select unnest(range(1, 13)) as month)
select y.year, cast(c.month as integer) as month, make_date(y.year, cast(c.month as integer), 1) as date, value from y join c on true left join m on m.year = y.year and m.month = c.month""")
def year_month_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line a year, twelve numbers between spaces, under two lines of heading,
    with a sentinel where a month is missing; read as a monthly series."""
    m = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).agg(r(F.avg("o_totalprice") / 1000, 2).alias("value"))
    wide = m.groupBy("year").pivot("month", list(range(1, 13))).agg(F.max("value"))
    cells = [F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("-99.99")) for k in range(1, 13)]
    lines = wide.select((F.col("year") % 3).alias("part"), (F.col("year") + 2).alias("line"), F.concat_ws("   ", F.col("year").cast("string"), *cells).alias("value"))
    heads = lines.select("part").distinct().select("part", F.inline(F.array(F.struct(F.lit(0).alias("line"), F.lit("monthly means in thousands").alias("value")), F.struct(F.lit(1).alias("line"), F.lit("year  jan  feb  mar  apr  may  jun  jul  aug  sep  oct  nov  dec").alias("value")))))
    path, names = place(spark, "lines"), ["year", *[f"m{k}" for k in range(1, 13)]]
    lines.union(heads).repartition("part").sortWithinPartitions("part", "line").drop("line").write.partitionBy("part").text(path)
    rows = text.whitespace_table(spark, path, names, skip=2)
    return text.year_by_month(rows, "year", names[1:])


@query("""with m as (select o_orderpriority as priority, cast(year(o_orderdate) as integer) as year, avg(o_totalprice) as value from orders group by 1, 2), g as (select *, avg(value) over (partition by priority) as mean from m)
select priority, year as years from g where value > mean""")
def json_year_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years above the mean, as one JSON record with a list a priority."""
    m = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("priority"), F.year("o_orderdate").alias("year")).agg(F.avg("o_totalprice").alias("value"))
    g = m.join(m.groupBy("priority").agg(F.avg("value").alias("mean")), "priority").where("value > mean")
    path = place(spark, "json")
    g.groupBy("priority").agg(F.sort_array(F.collect_list("year")).alias("years")).write.json(path)  # a few years each
    return text.json_lists(spark, path, "priority", "years")


ITEM = T.StructType([T.StructField("l_orderkey", T.LongType()), T.StructField("l_quantity", T.DoubleType()), T.StructField("l_shipdate", T.DateType())])


@query("select l_returnflag as mode, count(*) as rows, count_if(l_linenumber = 7) as malformed, round(sum(case when l_linenumber <> 7 then l_quantity end), 2) as quantity from lineitem group by 1")
def files_with_malformed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by return flag, in as many parts as tasks wrote; rows that do not parse
    are counted by file, and the others are read all the same."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("mode"), "l_orderkey", F.when(F.col("l_linenumber") == 7, "many").otherwise(F.col("l_quantity").cast("string")).alias("l_quantity"), "l_shipdate")
    path = place(spark, "flags")
    rows.write.partitionBy("mode").csv(path, header=True)
    good, issues = text.csv_with_issues(spark, path, ITEM)
    mode = F.url_decode(F.regexp_extract("file", "mode=([^/]+)/", 1)).alias("mode")
    a = issues.groupBy(mode).agg(F.sum("rows").alias("rows"), F.sum("malformed").alias("malformed"))
    b = good.groupBy(mode).agg(r(F.sum("l_quantity"), 2).alias("quantity"))
    return a.join(b, "mode", "left")


@query("""with s as (select o_orderkey, o_orderdate, o_totalprice, 0 as fresh from orders where o_orderdate < date '1997-01-01' union all select o_orderkey, o_orderdate, o_totalprice * 2, 1 from orders where o_orderdate >= date '1996-07-01'),
k as (select *, row_number() over (partition by o_orderkey, o_orderdate order by fresh desc) as nth from s) select cast(year(o_orderdate) as integer) as year, count(*) as orders, round(sum(o_totalprice), 2) as total from k where nth = 1 group by 1""")
def stored_increment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store by year, and an increment that overlaps it: new values count, and
    only the years that they touch are written again."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice", F.year("o_orderdate").alias("year"))
    path = place(spark, "store")
    stores.save(o.where("o_orderdate < date '1997-01-01'"), path, ["year"])
    new = o.where("o_orderdate >= date '1996-07-01'").withColumn("o_totalprice", F.col("o_totalprice") * 2)
    stores.append_increment(spark, path, new, ["o_orderkey"], "o_orderdate", "year")
    return spark.read.parquet(path).groupBy("year").agg(F.count("*").alias("orders"), r(F.sum("o_totalprice"), 2).alias("total"))


@query("""with t as (select distinct p_brand as brand, fast from part, (select unnest([5, 10, 20]) as fast)), k as (select *, md5('{"brand":"' || brand || '","fast":' || fast || '}') as key from t) select brand, fast, key from k where not (brand < 'Brand#3' and fast <> 20)""")
def resumed_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of a batch of parameters, whose results are kept by a digest
    of them, after a run that ended early."""
    todo = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand")).distinct().withColumn("fast", F.explode(F.array(*map(F.lit, (5, 10, 20)))))
    todo = todo.withColumn("key", stores.parameter_key("brand", "fast"))
    path = place(spark, "results")
    stores.save_report({"done": todo.where("brand < 'Brand#3' and fast <> 20")}, path)
    return stores.not_done(todo, spark.read.parquet(f"{path}/done"), ["key"])


@query("select 'extended price' as column_name, 'dollars' as unit, round(avg(l_extendedprice), 2) as mean from lineitem union all select 'quantity', 'pieces', round(avg(l_quantity), 2) from lineitem")
def stored_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units outlast storing; columns whose names have them in parentheses lose
    these."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("extended price (USD)"), F.col("l_quantity").alias("quantity"), "l_returnflag")
    rows, path = frames.without_units(rows), place(spark, "units")
    stores.save(rows, path, units={"extended price": "dollars", "quantity": "pieces"})
    back = spark.read.parquet(path)
    known, numbers = stores.units(back), frames.numeric_columns(back)
    each = [F.struct(F.lit(c).alias("column_name"), F.lit(known.get(c)).alias("unit"), r(F.avg(f"`{c}`"), 2).alias("mean")) for c in numbers]
    return back.agg(F.array(*each).alias("_m")).select(F.inline("_m"))


@query("select c_mktsegment as segment, count(*) as n, round(sum(c_acctbal), 2) as balance from customer group by 1")
def columns_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns found by loose names: without regard to case and spaces, by
    keywords, by a marker beside a name, and the closest of several."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("Cust Key"), F.col("c_acctbal").alias("M2 balance yoy (USD)"), (F.col("c_acctbal") * 0).alias("M2 balance"), F.col("c_mktsegment").alias("Market Segment 1"))
    c = frames.without_units(c)
    key, segment = frames.first_existing(c, ["customer", "CUSTKEY"]), frames.resolve_name(c.columns, "market-segment")
    balance = frames.marked_column(c, "m2", ["m1"], ["yoy"])
    assert frames.fuzzy_column(c, ["m2", "balance"]) == "M2 balance"
    return c.groupBy(F.col(segment).alias("segment")).agg(F.count(key).alias("n"), r(F.sum(balance), 2).alias("balance"))


@query("""with x as (select cast(cast(o_orderdate as date) as varchar) as day, cast(o_totalprice as varchar) as price, o_orderstatus as status, case when o_orderkey % 3 = 0 then o_orderpriority else cast(o_orderkey as varchar) end as mixed from orders)
select 'day' as "column", round(avg(cast(try_cast(day as date) is not null as int)), 6) as dates, round(avg(cast(try_cast(day as double) is not null as int)), 6) as numbers from x union all select 'price', 0.0, round(avg(cast(try_cast(price as double) is not null as int)), 6) from x
union all select 'status', 0.0, round(avg(cast(try_cast(status as double) is not null as int)), 6) from x union all select 'mixed', 0.0, round(avg(cast(try_cast(mixed as double) is not null as int)), 6) from x""")
def column_parse_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which text columns are dates, and which are numbers."""
    o = table(spark, sf_dir, "orders")
    mixed = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).otherwise(F.col("o_orderkey").cast("string"))
    x = o.select(F.to_date("o_orderdate").cast("string").alias("day"), F.col("o_totalprice").cast("string").alias("price"), F.col("o_orderstatus").alias("status"), mixed.alias("mixed"))
    return frames.parse_rates(x, ["yyyy-MM-dd"]).select("column", r("dates").alias("dates"), r("numbers").alias("numbers"))


@query("""select l_linenumber, count(*) as rows, count(case when l_linenumber not in (3, 4, 5) then 1 end) as finite, round(avg(case when l_linenumber not in (3, 4, 5) then l_quantity end), 6) as mean from lineitem group by 1""")
def fill_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NaN, infinities and sentinels count as missing."""
    n = F.col("l_linenumber")
    odd = F.when(n == 3, F.lit(float("nan"))).when(n == 4, F.lit(float("-inf"))).when(n == 5, F.lit(1e20)).otherwise(F.col("l_quantity").cast("double"))
    x = frames.missing_to_null(table(spark, sf_dir, "lineitem").select("l_linenumber", odd.alias("value")))
    return x.groupBy("l_linenumber").agg(F.count("*").alias("rows"), F.count("value").alias("finite"), r(F.avg("value")).alias("mean"))


@query(f"""with {GRID}, g as (select lat, lon * 15.0 as lon, avg(value) as value from grid group by 1, 2) select lat, round(lon, 1) as lon, round(value, 3) as value from g union all select lat, round(lon + 360, 1), round(value, 3) from g where lon = (select min(lon) from g)""")
def wrapped_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first meridian once more, a turn on."""
    g = grid(spark, sf_dir).groupBy("lat", (F.col("lon") * 15.0).alias("lon")).agg(F.avg("value").alias("value"))
    return frames.cyclic_point(g).select("lat", r("lon", 1).alias("lon"), r("value", 3).alias("value"))
