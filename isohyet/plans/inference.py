"""Queries on limits of estimates."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import inference as inf
from .base import CELL_YEAR, by_cell_year, query, r, table

PRIORITY_MONTHS = """
pm as (
  select o_orderpriority as priority, cast(year(o_orderdate) * 12 + month(o_orderdate) as integer) as month, avg(o_totalprice) as value
  from orders group by 1, 2)
"""


def priority_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("priority"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("month")).agg(F.avg("o_totalprice").alias("value"))


DRAWS, BLOCKS = 150, 30


def cdf_sql(x: str) -> str:
    t = f"(1 / (1 + 0.3275911 * abs({x}) / sqrt(2.0)))"
    tail = f"({t} * (0.254829592 + {t} * (-0.284496736 + {t} * (1.421413741 + {t} * (-1.453152027 + {t} * 1.061405429)))) * exp(-({x}) * ({x}) / 2) / 2)"
    return f"case when {x} >= 0 then 1 - {tail} else {tail} end"


def bca_sql(name: str, statistic: str) -> str:
    """Estimate and limits of one statistic over ``pm``, as select."""
    bias = "[" + ", ".join(repr(NormalDist().inv_cdf(k / (2 * DRAWS))) if 0 < k < 2 * DRAWS else "null" for k in range(2 * DRAWS + 1)) + "]"
    z = {k: f"(bias + {NormalDist().inv_cdf(q)!r})" for k, q in (("low", 0.025), ("high", 0.975))}
    place = ", ".join(f"{DRAWS - 1} * ({cdf_sql(f'(bias + {x} / (1 - acceleration * {x}))')}) as {k}_at" for k, x in z.items())
    at = lambda k: f"stars[cast(floor({k}_at) as int) + 1] + (stars[cast(least(floor({k}_at) + 1, {DRAWS - 1}) as int) + 1] - stars[cast(floor({k}_at) as int) + 1]) * ({k}_at - floor({k}_at))"
    return f"""(with v as (select *, row_number() over (partition by priority order by month) - 1 as nth, count(*) over (partition by priority) as n from pm),
e as (select priority, {statistic} as estimate, any_value(n) as n from v group by 1),
d as (select priority, b, cast('0x' || substr(md5(b || ':' || k), 1, 8) as bigint) % n as nth from e, (select unnest(range({DRAWS})) as b), (select unnest(range(1000)) as k) where k < n),
s as (select d.priority, b, {statistic} as star from d join v on v.priority = d.priority and v.nth = d.nth group by 1, 2),
t as (select s.priority, list(star order by star) as stars, sum(case when star < estimate then 2 when star = estimate then 1 else 0 end) as below from s join e using (priority) group by 1),
j as (select v.priority, part, {statistic} as without from v, (select unnest(range({BLOCKS})) as part) where part < least(n, {BLOCKS}) and part <> nth % least(n, {BLOCKS}) group by 1, 2),
g as (select priority, sum(pow(m - without, 3)) / (6 * pow(sum(pow(m - without, 2)), 1.5)) as acceleration from (select *, avg(without) over (partition by priority) as m from j) group by 1),
b as (select e.priority, estimate, stars, acceleration, ({bias})[cast(below as int) + 1] as bias from e join t using (priority) join g using (priority)), p as (select *, {place} from b)
select priority, '{name}' as statistic, round(estimate, 3) as estimate, round({at("low")}, 2) as low, round({at("high")}, 2) as high, round(bias, 5) as bias, round(acceleration, 5) as acceleration from p)"""


STATISTICS = {"mean": (lambda: F.avg("value"), "avg(value)"), "slope": (lambda: F.regr_slope("value", "month"), "regr_slope(value, month)"), "spread": (lambda: F.stddev_samp("value"), "stddev_samp(value)")}


@query(f"with {PRIORITY_MONTHS} " + " union all ".join(bca_sql(k, sql) for k, (_, sql) in STATISTICS.items()))
def bca_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of a mean, a trend and a spread of each priority's months."""
    rows, out = priority_months(spark, sf_dir), None
    for name, (statistic, _) in STATISTICS.items():
        x = inf.bca(rows, ["priority"], ["month"], statistic(), DRAWS, 0.95, BLOCKS)
        x = x.select("priority", F.lit(name).alias("statistic"), r("estimate", 3).alias("estimate"), r("low", 2).alias("low"), r("high", 2).alias("high"), r("bias", 5).alias("bias"), r("acceleration", 5).alias("acceleration"))
        out = x if out is None else out.union(x)
    return out


SMOOTH, TAPER = 5, 0.1
FREEDOM = inf.spectrum_freedom(SMOOTH, TAPER)
LOW, HIGH = (inf.chi_square_quantile(q, FREEDOM) / FREEDOM for q in (0.05, 0.95))


@query(f"""with {PRIORITY_MONTHS}, n as (select *, row_number() over (partition by priority order by month) - 1 as t, count(*) over (partition by priority) as n, value - avg(value) over (partition by priority) as x from pm),
m as (select *, cast(floor({TAPER} * n / 2 + 0.5) as integer) as m, lead(x) over (partition by priority order by t) as nx from n),
w as (select *, x * case when t < m then 0.5 * (1 - cos(pi() * (t + 0.5) / m)) when t >= n - m then 0.5 * (1 - cos(pi() * (n - 1 - t + 0.5) / m)) else 1 end as y from m),
c as (select priority, any_value(n) as n, avg(x * x) as variance, sum(x * nx) / sum(x * x) as lag from m group by 1),
f as (select priority, k, any_value(n) as n, pow(sum(y * cos(2 * pi() * k * t / n)), 2) + pow(sum(y * sin(2 * pi() * k * t / n)), 2) as p from w, (select unnest(range(1, 500)) as k) where k <= n // 2 group by 1, 2),
s as (select a.priority, a.k, sum(g * b.p) as p from f a, (select unnest(range(-{SMOOTH // 2}, {SMOOTH // 2 + 1})) as d, unnest([{", ".join(map(repr, inf.daniell(SMOOTH).tolist()))}]) as g) join f b on b.priority = a.priority and b.k = case when a.k + d < 1 then 1 - (a.k + d) when a.k + d > a.n // 2 then 2 * (a.n // 2) + 1 - (a.k + d) else a.k + d end group by 1, 2),
a as (select s.*, n, p * variance / (sum(p * case when k = 1 or k = n // 2 then 0.5 else 1 end) over (partition by s.priority) / n) as power, 1 / (1 + lag * lag - 2 * lag * cos(2 * pi() * k / n)) as curve from s join c on c.priority = s.priority),
r as (select *, curve * sum(power) over (partition by priority) / sum(curve) over (partition by priority) as red from a)
select priority, k, round(k / n, 6) as frequency, round(power / 1e6, 4) as power, round(red / 1e6, 4) as red, round(red * {LOW!r} / 1e6, 4) as low, round(red * {HIGH!r} / 1e6, 4) as high from r where n // 2 >= {SMOOTH}""")
def red_noise_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothed spectra of months against the limits of red noise."""
    out = inf.red_noise_spectrum(priority_months(spark, sf_dir), ["priority"], "month", "value", SMOOTH, TAPER)
    return out.select("priority", "k", r("frequency").alias("frequency"), *[r(F.col(c) / 1e6, 4).alias(c) for c in ("power", "red", "low", "high")])


CELL_MONTHS = """
cm as (
  select cast(o_custkey % 6 as integer) as lat, cast((o_custkey // 6) % 4 as integer) as lon, cast(year(o_orderdate) * 12 + month(o_orderdate) as integer) as month, avg(o_totalprice) as value
  from orders group by 1, 2, 3),
ix as (select cast(year(o_orderdate) * 12 + month(o_orderdate) as integer) as month, avg(o_totalprice) as idx from orders group by 1)
"""


@query(f"""with {CELL_MONTHS}, h as (select unnest(range(-6, 7)) as lag), g as (select lat, lon, lag, count(*) as n, corr(value, idx) as r from cm, h join ix on ix.month = cm.month + lag group by 1, 2, 3),
ca as (select *, value - avg(value) over (partition by lat, lon) as d from cm), ia as (select *, idx - avg(idx) over () as d from ix),
a as (select x.lat, x.lon, y.month - x.month as k, sum(x.d * y.d) as s from ca x join ca y on y.lat = x.lat and y.lon = x.lon and y.month - x.month between 0 and 6 group by 1, 2, 3),
b as (select y.month - x.month as k, sum(x.d * y.d) as s from ia x join ia y on y.month - x.month between 0 and 6 group by 1),
e as (select g.*, a.s / a0.s * (b.s / b0.s) as ab from g join a on a.lat = g.lat and a.lon = g.lon and a.k = abs(lag) join a a0 on a0.lat = g.lat and a0.lon = g.lon and a0.k = 0 join b on b.k = abs(lag) join b b0 on b0.k = 0),
f as (select *, case when lag = 0 then n else n * (1 - ab) / (1 + ab) end as ne, abs(atanh(r)) * sqrt(greatest(n - 3, 0)) as z from e)
select lat, lon, cast(lag as integer) as lag, n, round(r, 5) as r, round(ne, 4) as effective_n, round(r * sqrt(greatest(ne - 2, 0) / (1 - r * r)), 4) as t, round(2 * (1 - ({cdf_sql("z")})), 6) as p from f""")
def lead_lag_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlations of all cells with an index at 13 lags, and their tests."""
    o = table(spark, sf_dir, "orders").withColumn("month", F.year("o_orderdate") * 12 + F.month("o_orderdate"))
    cell = [(F.col("o_custkey") % 6).cast("int").alias("lat"), (F.floor(F.col("o_custkey") / 6) % 4).cast("int").alias("lon")]
    cells = o.groupBy(*cell, "month").agg(F.avg("o_totalprice").alias("value"))
    index = o.groupBy("month").agg(F.avg("o_totalprice").alias("idx"))
    out = inf.lead_lag(cells, index, ["lat", "lon"], "month", "value", "idx", 6)
    return out.select("lat", "lon", "lag", "n", r("r", 5).alias("r"), r("effective_n", 4).alias("effective_n"), r("t", 4).alias("t"), r("p").alias("p"))


@query(f"""with {CELL_YEAR}, b as (select lat, lon, year, value, avg(value) over (partition by lat, lon) as mean, cos(radians(lat * 10.0)) as w from cells), k as (select *, sum(w * mean) over (partition by year) / sum(w) over (partition by year) as mx, sum(w * value) over (partition by year) / sum(w) over (partition by year) as my from b),
g as (select year, sum(w * (mean - mx) * (mean - mx)) as xx, sum(w * (value - my) * (value - my)) as yy, sum(w * (mean - mx) * (value - my)) as xy, pow(sum(w), 2) / sum(w * w) as ne from k group by 1), h as (select *, xy / sqrt(xx * yy) as r from g)
select year, round(r, 5) as r, round(sqrt(yy / xx), 5) as amplitude_ratio, round(ne, 4) as effective_n, round(tanh(atanh(r) - {NormalDist().inv_cdf(0.975)!r} / sqrt(greatest(ne - 3, 1))), 5) as low, round(tanh(atanh(r) + {NormalDist().inv_cdf(0.975)!r} / sqrt(greatest(ne - 3, 1))), 5) as high from h""")
def field_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each year's field agrees with the mean one, weighted by area."""
    mean = F.avg("value").over(Window.partitionBy("lat", "lon"))
    rows = by_cell_year(spark, sf_dir).withColumns({"mean": mean, "w": F.cos(F.radians(F.col("lat") * 10.0))})
    out = inf.weighted_pearson(rows, ["year"], "mean", "value", "w")
    return out.select("year", r("r", 5).alias("r"), r("amplitude_ratio", 5).alias("amplitude_ratio"), r("effective_n", 4).alias("effective_n"), r("low", 5).alias("low"), r("high", 5).alias("high"))
