"""Rain seasons from cumulated anomalies, and how two experiments differ in them.
Orders are the rain of pentads of a mean year, on rows of latitude."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import query, r, table

PENTADS = 73

SEASON = f"""
x as (select cast(o_custkey % 6 as integer) as lat, cast(o_orderkey // 32 % 2 as integer) as run, cast(least((dayofyear(o_orderdate) - 1) // 5, {PENTADS - 1}) as integer) as k, sum(o_totalprice) / 1e5 as rain from orders group by 1, 2, 3),
c as (select lat, run, cast(unnest(range({PENTADS})) as integer) as k from (select distinct lat, run from x)),
y as (select c.*, coalesce(rain, 0) as rain from c left join x using (lat, run, k)),
z as (select *, sum(rain - mean) over (partition by lat, run order by k) as cum from (select *, avg(rain) over (partition by lat, run) as mean from y)),
e as (select lat, run, min(struct_pack(c := round(cum, 6), k := k)).k as low, min(struct_pack(c := -round(cum, 6), k := k)).k as high from z group by 1, 2),
s as (select lat, run, low, high, (high - low + {PENTADS}) % {PENTADS} as length, sum(rain) filter (case when high > low then k > low and k <= high else k > low or k <= high end) as total from y join e using (lat, run) group by 1, 2, 3, 4)
"""


def rain_seasons(rain: DataFrame, by: list[str], place: str, value: str, places: int) -> DataFrame:
    """The season of each group: it begins after the lowest and ends with the
    highest of the cumulated departures from the mean, over the turn of the year if
    that is where it lies; ``onset``, ``withdrawal``, ``length``, ``total`` and
    ``intensity``. Places without a row have no rain. Of equal extremes the first
    counts; rain that never varies has a season of no length, and no intensity."""
    whole = rain.select(*by).distinct().withColumn(place, F.explode(F.sequence(F.lit(0), F.lit(places - 1))))
    rows = whole.join(rain, [*by, place], "left").withColumn(value, F.coalesce(F.col(value), F.lit(0.0)))
    w = Window.partitionBy(*by)
    rows = rows.withColumn("_c", F.col(value) - F.avg(value).over(w)).withColumn("_c", F.round(F.sum("_c").over(w.orderBy(place)), 6))
    ends = {"_low": F.min(F.struct("_c", place))[place], "_high": F.min(F.struct(-F.col("_c"), place))[place]}
    g = rows.groupBy(*by).agg(*[x.alias(k) for k, x in ends.items()])
    at, low, high = F.col(place), F.col("_low"), F.col("_high")
    inside = F.when(high > low, (at > low) & (at <= high)).otherwise((at > low) | (at <= high))
    out = rows.join(g, by).groupBy(*by, "_low", "_high").agg(F.sum(F.when(inside, F.col(value))).alias("total"))
    length = (high - low + places) % places
    return out.select(*by, ((low + 1) % places).alias("onset"), high.alias("withdrawal"), length.alias("length"), "total", F.try_divide("total", length).alias("intensity"))


def pentads(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.least(F.floor((F.dayofyear("o_orderdate") - 1) / 5), F.lit(PENTADS - 1)).cast("int")
    cell = [(F.col("o_custkey") % 6).cast("int").alias("lat"), (F.floor(F.col("o_orderkey") / 32) % 2).cast("int").alias("run"), k.alias("k")]
    return table(spark, sf_dir, "orders").groupBy(*cell).agg((F.sum("o_totalprice") / 1e5).alias("rain"))


@query(f"with {SEASON} select lat, run, (low + 1) % {PENTADS} as onset, high as withdrawal, length, round(total, 4) as total, round(total / nullif(length, 0), 4) as intensity from s")
def rain_season(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Begin, end, length, rain and its strength of each latitude's season."""
    s = rain_seasons(pentads(spark, sf_dir), ["lat", "run"], "k", "rain", PENTADS)
    return s.select("lat", "run", "onset", "withdrawal", "length", r("total", 4).alias("total"), r("intensity", 4).alias("intensity"))


@query(f"""with {SEASON}, d as (select a.lat, b.length - a.length as longer, b.total - a.total as more, b.total / nullif(b.length, 0) - a.total / nullif(a.length, 0) as stronger, cos(radians(a.lat * 10.0)) as w from s a join s b on b.lat = a.lat and a.run = 0 and b.run = 1)
select lat, longer, round(more, 4) as more, round(stronger, 4) as stronger, round(sum(w * longer) over () / sum(w) over (), 5) as area_longer, round(sum(case when longer > 0 then w else 0 end) over () / sum(w) over (), 5) as area_share from d""")
def rain_season_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seasons of the second experiment against the first, by latitude and over
    the area: how much longer, and on which share of it."""
    s = rain_seasons(pentads(spark, sf_dir), ["lat", "run"], "k", "rain", PENTADS)
    of = lambda c, k: F.max(F.when(F.col("run") == k, F.col(c)))
    d = s.groupBy("lat").agg(*[(of(c, 1) - of(c, 0)).alias(n) for c, n in (("length", "longer"), ("total", "more"), ("intensity", "stronger"))], F.count("*").alias("_n")).where("_n = 2").drop("_n")
    w, every = F.cos(F.radians(F.col("lat") * 10.0)), Window.partitionBy()  # a row a latitude
    area = {"area_longer": F.col("longer"), "area_share": (F.col("longer") > 0).cast("int")}
    d = d.withColumns({k: F.sum(w * x).over(every) / F.sum(w).over(every) for k, x in area.items()})
    return d.select("lat", "longer", r("more", 4).alias("more"), r("stronger", 4).alias("stronger"), r("area_longer", 5).alias("area_longer"), r("area_share", 5).alias("area_share"))
