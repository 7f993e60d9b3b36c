"""Queries on regressions of monthly counts on the month before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import regressors as reg
from ..session import shared
from .base import query, r, table

SPLIT = 1997 * 12 + 1
X = ["price", "urgent"]
UNIT_MONTHS = """
um as (
  select cast(o_custkey % 6 as integer) as unit, cast(year(o_orderdate) * 12 + month(o_orderdate) as integer) as t, cast(count(*) as double) as y,
         avg(o_totalprice) / 1e5 as x1, avg(case when o_orderpriority = '1-URGENT' then 1.0 else 0.0 end) as x2
  from orders group by 1, 2),
counts as (select a.unit, a.t, a.y, b.x1 as price, b.x2 as urgent from um a join um b on a.unit = b.unit and a.t = b.t + 1)
"""


def unit_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders a month of each unit, beside the price and share of urgent orders of
    the month before."""
    o = table(spark, sf_dir, "orders")
    um = o.groupBy((F.col("o_custkey") % 6).cast("int").alias("unit"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("t")).agg(
        F.count("*").cast("double").alias("y"), (F.avg("o_totalprice") / 1e5).alias("x1"), F.avg((F.col("o_orderpriority") == "1-URGENT").cast("int")).alias("x2")
    )
    before = um.select("unit", (F.col("t") + 1).alias("t"), F.col("x1").alias("price"), F.col("x2").alias("urgent"))
    return um.select("unit", "t", "y").join(before, ["unit", "t"])


# With two scaled features the axes of the products are their sum and difference.
EVIDENCE = f"""with recursive {UNIT_MONTHS},
g as (select unit, cast(count(*) as double) as n, avg(price) as m1, avg(urgent) as m2, avg(y) as base, case when var_pop(price) > 0 then stddev_pop(price) else 1.0 end as s1, case when var_pop(urgent) > 0 then stddev_pop(urgent) else 1.0 end as s2,
 covar_pop(price, urgent) as c12, covar_pop(price, y) as c1, covar_pop(urgent, y) as c2, var_pop(price) as v1, var_pop(urgent) as v2, var_pop(y) as vy from counts where t < {SPLIT} group by 1 having count(*) > 1),
e as (select *, n * (1 + c12 / (s1 * s2)) as eu, n * (1 - c12 / (s1 * s2)) as ev, n * (c1 / s1 + c2 / s2) / sqrt(2.0) as bu, n * (c1 / s1 - c2 / s2) / sqrt(2.0) as bv, n * vy as yy from g where v1 > 0 and v2 > 0),
it as (
  select unit, 0 as i, 1 / (yy / n + 2.220446049250313e-16) as a, 1.0::double as l, 0.0::double as u, 0.0::double as v, true as going from e
  union all
  select unit, i + 1, (n - used + 2e-4) / (greatest(yy - 2 * (nu * bu + nv * bv) + eu * nu * nu + ev * nv * nv, 0.0) + 2e-6), (used + 2e-4) / (nu * nu + nv * nv + 2e-6), nu, nv,
         i = 0 or (abs(nu - u + nv - v) + abs(nu - u - (nv - v))) / sqrt(2.0) >= 1e-3
  from (select it.*, e.* exclude (unit), bu / (eu + l / a) as nu, bv / (ev + l / a) as nv, a * eu / (l + a * eu) + a * ev / (l + a * ev) as used from it join e on it.unit = e.unit where going and i < 300)),
fit as (select e.*, k.a, k.l, bu / (eu + k.l / k.a) as fu, bv / (ev + k.l / k.a) as fv from e join (select unit, max_by(a, i) as a, max_by(l, i) as l from it group by 1) k on e.unit = k.unit)"""


@query(f"""{EVIDENCE}, z as (select c.unit, t, y, (price - m1) / s1 as z1, (urgent - m2) / s2 as z2 from counts c join fit f on c.unit = f.unit where t >= {SPLIT})
select z.unit, t, y, round(base + (fu * (z1 + z2) + fv * (z1 - z2)) / sqrt(2.0), 5) as prediction, round(sqrt(1 / a + pow(z1 + z2, 2) / 2 / (l + a * eu) + pow(z1 - z2, 2) / 2 / (l + a * ev)), 5) as doubt from z join fit on z.unit = fit.unit""")
def bayesian_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months from 1997 on, predicted by each unit's ridge of the months before."""
    rows = unit_months(spark, sf_dir)
    models = reg.bayesian_ridge(rows.where(F.col("t") < SPLIT), ["unit"], X, "y")
    return reg.with_ridge(rows.where(F.col("t") >= SPLIT), models, ["unit"], X).select("unit", "t", "y", r("prediction", 5).alias("prediction"), r("doubt", 5).alias("doubt"))


@query(f"""{EVIDENCE} select unit, cast(n as bigint) as n, round(base, 5) as base, round((fu + fv) / sqrt(2.0), 5) as price, round((fu - fv) / sqrt(2.0), 5) as urgent, round(a, 5) as noise, round(l / a, 3) as penalty from fit""")
def bayesian_ridge_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The penalties that the evidence chose, and the weights of scaled features."""
    m = reg.bayesian_ridge(unit_months(spark, sf_dir).where(F.col("t") < SPLIT), ["unit"], X, "y")
    return m.select("unit", "n", r("base", 5).alias("base"), r(F.col("weights")[0], 5).alias("price"), r(F.col("weights")[1], 5).alias("urgent"), r("noise", 5).alias("noise"), r(F.col("strength") / F.col("noise"), 3).alias("penalty"))


BOOST = {"rounds": 4, "depth": 2, "bins": 8, "rate": 0.3, "ridge": 1.0, "lasso": 0.1, "least_gain": 0.01, "least_weight": 3.0, "max_step": 0.7, "rows": 0.8}


def boosting_sql(rounds: int, depth: int, bins: int, rate: float, ridge: float, lasso: float, least_gain: float, least_weight: float, max_step: float, rows: float) -> str:
    """Tables ``f<rounds>`` with the sum of leaves of each row, and ``s<round>_<level>``
    with the splits, one after the other."""
    w = lambda g, h: f"greatest(least(-sign({g}) * greatest(abs({g}) - {lasso}, 0.0) / ({h} + {ridge}), {max_step}), -{max_step})"
    won = lambda g, h: f"-(2 * ({g} * {w(g, h)} + {lasso} * abs({w(g, h)})) + ({h} + {ridge}) * {w(g, h)} * {w(g, h)})"
    at = ", ".join(str(i / bins) for i in range(1, bins))
    out = [
        UNIT_MONTHS.strip(),
        f"cut as materialized (select list_distinct(quantile_disc(price, [{at}])) as c0, list_distinct(quantile_disc(urgent, [{at}])) as c1, ln(avg(y)) as base from counts where t < {SPLIT})",
        f"f0 as materialized (select unit, t, y, t < {SPLIT} as seen, len(list_filter(c0, lambda c: c < price)) as b0, len(list_filter(c1, lambda c: c < urgent)) as b1, base as f, t * 6 + unit as key from counts, cut)",
    ]
    for m in range(rounds):
        draw = f"cast('0x' || substr(md5('{m}:' || cast(key as bigint)), 1, 6) as bigint) % 1000 < {round(rows * 1000)}"
        out.append(f"n{m}_0 as materialized (select *, seen and {draw} as part, exp(f) - y as g, exp(f + {max_step}) as h, 1 as node from f{m})")
        for k in range(depth):
            out += [
                f"h{m}_{k} as materialized (select node, feature, bin, sum(g) as g, sum(h) as h from (select node, 0 as feature, b0 as bin, g, h from n{m}_{k} where part union all select node, 1, b1, g, h from n{m}_{k} where part) where node >= {2**k} group by 1, 2, 3)",
                f"c{m}_{k} as materialized (select node, feature, bin, sum(g) over (partition by node, feature order by bin) as gl, sum(h) over (partition by node, feature order by bin) as hl, sum(g) over (partition by node, feature) as ga, sum(h) over (partition by node, feature) as ha from h{m}_{k})",
                f"s{m}_{k} as materialized (select node, feature, bin, gain from (select node, feature, bin, round({won('gl', 'hl')} + {won('(ga - gl)', '(ha - hl)')} - {won('ga', 'ha')}, 9) as gain, hl, ha from c{m}_{k}) where hl >= {least_weight} and ha - hl >= {least_weight} and gain > {least_gain} qualify row_number() over (partition by node order by gain desc, feature, bin) = 1)",
                f"n{m}_{k + 1} as materialized (select n.* replace (case when s.node is null then n.node else n.node * 2 + cast(case when s.feature = 0 then b0 else b1 end > s.bin as int) end as node) from n{m}_{k} n left join s{m}_{k} s on n.node = s.node)",
            ]
        out += [
            f"l{m} as materialized (select node, {rate} * {w('sum(g)', 'sum(h)')} as value from n{m}_{depth} where part group by 1)",
            f"f{m + 1} as materialized (select n.* exclude (part, g, h, node) replace (f + coalesce(value, 0.0) as f) from n{m}_{depth} n left join l{m} l on n.node = l.node)",
        ]
    return "with " + ",\n".join(out)


BOOST_SQL = boosting_sql(**BOOST)


def boosted(rows: DataFrame) -> reg.BoostedCounts:
    return reg.poisson_boosting(rows.where(F.col("t") < SPLIT).withColumn("key", F.col("t") * 6 + F.col("unit")), X, "y", "key", **BOOST)


@query(BOOST_SQL + f" select unit, t, y, round(exp(f), 5) as expected from f{BOOST['rounds']} where not seen")
def poisson_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts expected from 1997 on, by trees of the months before."""
    rows = shared(unit_months(spark, sf_dir))
    return rows.where(F.col("t") >= SPLIT).select("unit", "t", "y", r(boosted(rows).expected(), 5).alias("expected"))


@query(BOOST_SQL + " select feature, round(sum(gain), 4) as gain from (" + " union all ".join(f"select case when feature = 0 then 'price' else 'urgent' end as feature, gain from s{m}_{k}" for m in range(BOOST["rounds"]) for k in range(BOOST["depth"])) + ") group by 1")
def boosting_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss that each feature's splits took away."""
    gains = boosted(unit_months(spark, sf_dir)).gains()
    rows = [(k, v) for k, v in gains.items() if v > 0]
    return spark.createDataFrame(rows, "feature string, gain double").select("feature", r("gain", 4).alias("gain"))
