"""Queries on polygons: every nation has a region of customers, some with a hole
and some over the date line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import regions
from .base import query, table
from .series import POINTS, _points

RADIUS = "(12 + n_nationkey % 5 * 5 + (corner % 2) * 6.0)"
CENTRE = "(n_nationkey * 37 % 100 - 50)", "(n_nationkey * 53 % 360 - 180)"
LAT = f"{CENTRE[0]} + case when ring = 0 then {RADIUS} else 5.5 end * sin(2 * pi() * (corner + 0.3) / case when ring = 0 then 9 else 4 end)"
LON = f"{CENTRE[1]} + case when ring = 0 then {RADIUS} else 5.5 end * cos(2 * pi() * (corner + 0.3) / case when ring = 0 then 9 else 4 end)"
VERTICES = f"""vertices as (select n_nationkey as nation, ring, corner, {LAT} as lat, {LON} as lon from nation, (select unnest([0, 1]) as ring), (select unnest(range(9)) as corner) where corner < case when ring = 0 then 9 else 4 end and (ring = 0 or n_nationkey % 2 = 0))"""
EDGES = """edges as (select nation, lon as x1, lat as y1, coalesce(lead(lon) over w, first(lon) over w) as x2, coalesce(lead(lat) over w, first(lat) over w) as y2 from vertices window w as (partition by nation, ring order by corner))"""


def nation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stars of nine corners; those of every other nation have a square hole."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.array(F.lit(0), F.lit(1))).alias("ring")).where("ring = 0 or n_nationkey % 2 = 0")
    n = n.withColumn("corner", F.explode(F.sequence(F.lit(0), F.when(F.col("ring") == 0, 8).otherwise(3))))
    vertices = n.select(F.col("n_nationkey").alias("nation"), "ring", "corner", F.expr(LAT).alias("lat"), F.expr(LON).alias("lon"))
    return regions.ring_edges(vertices, "nation", "ring", "corner")


@query(f"""with {POINTS}, {VERTICES}, {EDGES}, t as (select unnest([-360.0, 0.0, 360.0]) as turn),
c as (select c_custkey, nation, turn, count(*) filter ((y1 > lat) <> (y2 > lat) and lon + turn < x1 + (lat - y1) * (x2 - x1) / (y2 - y1)) as crossings from pts, t, edges where y1 <> y2 group by 1, 2, 3)
select distinct c_custkey, nation from c where crossings % 2 = 1""")
def customers_in_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which regions each customer lies in."""
    return regions.points_in_polygons(_points(spark, sf_dir), nation_edges(spark, sf_dir), "c_custkey", "nation")


@query(f"""with {POINTS}, {VERTICES}, {EDGES}, t as (select unnest([-360.0, 0.0, 360.0]) as turn),
c as (select c_custkey, nation, turn, count(*) filter ((y1 > lat) <> (y2 > lat) and lon + turn < x1 + (lat - y1) * (x2 - x1) / (y2 - y1)) as crossings from pts, t, edges where y1 <> y2 group by 1, 2, 3),
i as (select distinct c_custkey, nation from c where crossings % 2 = 1)
select n_nationkey as nation, count(i.c_custkey) as customers, round(sum(c_acctbal), 2) as balance, count(distinct c_mktsegment) as segments from nation left join i on nation = n_nationkey left join customer c on c.c_custkey = i.c_custkey group by 1""")
def region_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances within each region, with the regions that are empty."""
    inside = regions.points_in_polygons(_points(spark, sf_dir), nation_edges(spark, sf_dir), "c_custkey", "nation")
    rows = inside.join(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment"), "c_custkey")
    g = rows.groupBy("nation").agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal") + 1e-5, 2).alias("balance"), F.countDistinct("c_mktsegment").alias("segments"))
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"))
    return nations.join(g, "nation", "left").fillna(0, ["customers", "segments"])
