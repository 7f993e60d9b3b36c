"""Registration of queries and the inputs that many of them share.

``bars`` (P) is a daily open/high/low/close/volume panel by brand, from line
items and their orders; ``daily`` (E) the events a day of each type; ``grid``
(G) monthly means of order totals on a 12 by 24 grid of customers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import reachable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tie_free(sql: str) -> str:
    """``round(x, n)`` as ``round((x) + 1e-(n+3), n)``. Means of prices often
    lie exactly half-way between two results, where the last bit of a sum would
    decide; ``r`` moves them in the same way."""
    out, at = "", 0
    while (start := sql.find("round(", at)) >= 0:
        depth, i = 1, start + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[i], 0)
            i += 1
        value, _, digits = sql[start + 6 : i - 1].rpartition(",")
        out += sql[at:start] + f"round(({tie_free(value)}) + 1e-{int(digits) + 3}, {int(digits)})"
        at = i
    return out + sql[at:]


def query(sql: str | None = None) -> Callable:
    """Registers a function under its name, with its SQL if there is one."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        if f.__name__ in QUERIES:
            raise ValueError(f"two queries are named {f.__name__}")
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = tie_free(sql)
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return reachable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def r(x: str | Column, digits: int = 6) -> Column:
    """Rounded, ties upwards, and never a negative zero."""
    x = F.col(x) if isinstance(x, str) else x
    return F.round(x.cast("double") + 10.0 ** -(digits + 3), digits) + F.lit(0.0)


BARS = """
bar_rows as (
  select p_brand as symbol, cast(o_orderdate as date) as date, l_extendedprice as price, l_quantity as q,
         struct_pack(a := l_shipdate, b := l_orderkey, c := l_linenumber, p := l_extendedprice) as k
  from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey),
bars as (
  select symbol, date, min(k).p as open, max(price) as high, min(price) as low, max(k).p as close, sum(q) as volume,
         row_number() over (partition by symbol order by date) as t
  from bar_rows group by symbol, date)
"""


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_shipdate", "l_extendedprice", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date"))
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("symbol"))
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    k = F.struct("l_shipdate", "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("p"))
    out = rows.groupBy("symbol", "date").agg(
        F.min(k)["p"].alias("open"), F.max("l_extendedprice").alias("high"), F.min("l_extendedprice").alias("low"), F.max(k)["p"].alias("close"), F.sum("l_quantity").alias("volume")
    )
    return out.withColumn("t", F.row_number().over(Window.partitionBy("symbol").orderBy("date")))


DAILY = """
daily as (
  select event_type, cast(ts as date) as date, count(*) as n, avg(value) as value
  from events group by 1, 2)
"""


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type", F.to_date("ts").alias("date")).agg(F.count("*").alias("n"), F.avg("value").alias("value"))


GRID = """
grid as (
  select cast(o_custkey % 12 as integer) as lat, cast((o_custkey // 12) % 24 as integer) as lon,
         cast(date_trunc('month', o_orderdate) as date) as month, avg(o_totalprice) as value, count(*) as n
  from orders group by 1, 2, 3)
"""


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    lat, lon = F.col("o_custkey") % 12, F.floor(F.col("o_custkey") / 12) % 24
    return o.groupBy(lat.cast("int").alias("lat"), lon.cast("int").alias("lon"), F.trunc("o_orderdate", "month").alias("month")).agg(F.avg("o_totalprice").alias("value"), F.count("*").alias("n"))


MONTHLY = """
monthly as (
  select cast(date_trunc('month', o_orderdate) as date) as month, avg(o_totalprice) as value, count(*) as n,
         row_number() over (order by date_trunc('month', o_orderdate)) as t
  from orders group by date_trunc('month', o_orderdate))
"""


def by_cell_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly means of a coarse grid: lat, lon, year, value."""
    o = table(spark, sf_dir, "orders")
    lat, lon = F.col("o_custkey") % 6, F.floor(F.col("o_custkey") / 6) % 8
    return o.groupBy(lat.cast("int").alias("lat"), lon.cast("int").alias("lon"), F.year("o_orderdate").alias("year")).agg(F.avg("o_totalprice").alias("value"))


CELL_YEAR = """
cells as (
  select cast(o_custkey % 6 as integer) as lat, cast((o_custkey // 6) % 8 as integer) as lon, cast(year(o_orderdate) as integer) as year,
         avg(o_totalprice) as value
  from orders group by 1, 2, 3)
"""
