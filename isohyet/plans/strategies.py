"""Signals, folds, sweeps and feature-matrix queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import backtest as bt, learning, physics as ph, statistics as st
from ..operators.windows import Ordered
from .base import BARS, CELL_YEAR, MONTHLY, bars, by_cell_year, query, r, table
from .fields import monthly

M = Ordered([], ["month"])

def signal_sql(inclusive: bool = False) -> str:
    """Targets by month; the threshold's months include this one or end before it."""
    before = "23 preceding and current row" if inclusive else "24 preceding and 1 preceding"
    return f"""{MONTHLY}, g as (select month, t, value / 100000 - n / 100.0 as gap, value from monthly),
h as (select *, case when count(gap) over (order by month rows between 2 preceding and current row) >= 3 then avg(gap) over (order by month rows between 2 preceding and current row) end as ma3 from g),
k as (select *, lag(ma3) over (order by month) as before, case when count(ma3) over (order by month rows between {before}) >= 12 then quantile_cont(ma3, 0.2) over (order by month rows between {before}) end as thr,
 list(value) over (order by month rows between 23 preceding and current row) as held from h),
p as (select * exclude (held), case when len(held) >= 12 then len([v for v in held if v <= value]) / cast(len(held) as double) end as pct from k),
s as (select *, case when ma3 > before and ma3 > thr then 1 when not ma3 > before then -1 else 0 end as signal, case when pct <= 0.25 then 1.2 when pct >= 0.8 then 0.0 else 1.2 * (0.8 - pct) / (0.8 - 0.25) end as weight from p where thr is not null and before is not null and pct is not null),
targets as (select month, t, signal, weight, greatest(0.0, least(1.0, (0.5 + 0.3 * signal) * weight)) as target, row_number() over (order by month) as i from s)"""


SIGNAL = signal_sql()


def targets(spark: SparkSession, sf_dir: str, inclusive: bool = False) -> DataFrame:
    """Signal, valuation weight and target of each month. The valuation is the
    share of the last 24 months at or below this one's; the trend's threshold is a
    quantile of the months before this one (``inclusive``: up to it)."""
    m = monthly(spark, sf_dir).withColumn("gap", F.col("value") / 100000 - F.col("n") / 100)
    m = m.withColumn("ma3", M.mean("gap", 3))
    span = M.rows(-23)
    thr = M.rolling(lambda c: F.percentile(c, F.lit(0.2)), "ma3", 24, 12) if inclusive else M.quantile_before("ma3", 0.2, 24, 12)
    held = F.collect_list("value").over(span)  # 24 at most
    pct = F.when(F.size(held) >= 12, F.size(F.filter(held, lambda v: v <= F.col("value"))) / F.size(held))
    m = m.withColumns({"before": M.lag("ma3"), "thr": thr, "pct": pct}).where("thr is not null and before is not null and pct is not null")
    m = m.withColumns({"signal": bt.trend_signal(F.col("ma3"), F.col("before"), F.col("thr")), "weight": ph.piecewise_weight(F.col("pct"), 0.25, 0.8, 1.2)})
    return m.select("month", "t", "signal", "weight", bt.target_position(F.col("signal"), F.col("weight")).alias("target"))


@query(f"with {SIGNAL} select month, signal, round(weight, 6) as weight, round(target, 6) as target from targets")
def valuation_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return targets(spark, sf_dir).select("month", "signal", r("weight").alias("weight"), r("target").alias("target"))


@query(f"with {signal_sql(inclusive=True)} select month, signal, round(target, 6) as target from targets")
def valuation_signal_inclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a threshold of months up to the one that is judged."""
    return targets(spark, sf_dir, inclusive=True).select("month", "signal", r("target").alias("target"))


BAND = """fold as (select month, i, target, cast(target as double) as position from targets where i = 1
 union all select x.month, x.i, x.target, case when abs(x.target - f.position) >= 0.1 then x.target else f.position end from fold f join targets x on x.i = f.i + 1)"""


@query(f"with recursive {SIGNAL}, {BAND} select month, round(target, 6) as target, round(position, 6) as position from fold")
def band_hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = targets(spark, sf_dir).withColumns({"k": F.lit(1), "band": F.lit(0.1)})
    return bt.band_hysteresis(rows, ["k"], "month", "target", "band").select("month", r("target").alias("target"), r("position").alias("position"))


@query(f"""with {BARS}, x as (select symbol, date, close / lag(close) over (partition by symbol order by date) - 1 as ret from bars), y as (select *, exp(sum(ln(1 + ret)) over w) as e from x where ret is not null window w as (partition by symbol order by date rows unbounded preceding)),
z as (select *, e / greatest(1.0, max(e) over (partition by symbol order by date rows unbounded preceding)) - 1 as dd from y)
select symbol, count(*) as n, round(avg(ret) * 252 / (stddev_samp(ret) * sqrt(252)), 4) as sharpe, round(min(dd), 4) as max_drawdown, round(stddev_samp(ret) * sqrt(252), 4) as volatility from z group by 1""")
def backtest_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bars(spark, sf_dir).select("symbol", "date", Ordered(["symbol"], ["date"]).pct_change("close").alias("ret")).dropna()
    p = bt.performance(rows, ["symbol"], "date", "ret", 252)
    return p.select("symbol", "n", r("sharpe", 4).alias("sharpe"), r("max_drawdown", 4).alias("max_drawdown"), r("volatility", 4).alias("volatility"))


@query(f"""with {BARS}, p as (select unnest([5, 10, 20]) as fast, unnest([1, 1, 1]) as one), q as (select unnest([30, 60]) as slow), g as (select fast, slow from p, q),
m as (select symbol, date, t, close / lag(close) over (partition by symbol order by date) - 1 as ret, {", ".join(f"case when t >= {n} then avg(close) over (partition by symbol order by date rows between {n - 1} preceding and current row) end as m{n}" for n in (5, 10, 20, 30, 60))} from bars),
x as (select fast, slow, symbol, date, ret, case fast when 5 then m5 when 10 then m10 else m20 end as f, case slow when 30 then m30 else m60 end as s from m, g),
y as (select *, lag(cast(f > s as int)) over (partition by fast, slow, symbol order by date) as held from x)
select fast, slow, count(*) as n, round(avg(held * ret), 8) as mean_ret, round(avg(held), 6) as exposure from y where held is not null group by 1, 2""")
def param_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of averages at once: parameters are rows, not a loop."""
    s = Ordered(["symbol"], ["date"])
    rows = bars(spark, sf_dir).select("symbol", "date", s.pct_change("close").alias("ret"), *[s.mean("close", n).alias(f"m{n}") for n in (5, 10, 20, 30, 60)])
    grid = [F.struct(F.lit(a).alias("fast"), F.lit(b).alias("slow"), (F.col(f"m{a}") > F.col(f"m{b}")).cast("int").alias("on")) for a in (5, 10, 20) for b in (30, 60)]
    rows = rows.select("symbol", "date", "ret", F.inline(F.array(*grid)))
    rows = rows.withColumn("held", Ordered(["fast", "slow", "symbol"], ["date"]).lag("on")).where("held is not null")
    return rows.groupBy("fast", "slow").agg(F.count("*").alias("n"), r(F.avg(F.col("held") * F.col("ret")), 8).alias("mean_ret"), r(F.avg("held")).alias("exposure"))


@query(f"""with {BARS}, w as (select symbol, date + cast((12 - isodow(date)) % 7 as integer) as week_end, max(struct_pack(d := date, v := close)).v as close from bars group by 1, 2), x as (select *, close / lag(close) over (partition by symbol order by week_end) - 1 as ret from w),
v as (select *, case when count(ret) over f >= 12 then stddev_samp(ret) over f end as vol from x window f as (partition by symbol order by week_end rows between 12 preceding and 1 preceding))
select week_end, symbol, round((1 / vol) / sum(1 / vol) over (partition by week_end), 6) as weight from v where vol > 0""")
def inverse_vol_rebalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.market import weekly

    s = Ordered(["symbol"], ["week_end"])
    x = weekly(bars(spark, sf_dir)).withColumn("ret", s.pct_change("close"))
    x = x.withColumn("vol", s.guarded(F.stddev_samp("ret"), "ret", s.rows(-12, -1), 12)).where("vol > 0")
    return x.select("week_end", "symbol", r((1 / F.col("vol")) / F.sum(1 / F.col("vol")).over(Window.partitionBy("week_end"))).alias("weight"))


@query(f"""with {BARS}, m as (select symbol, date, t, case when t >= 10 then avg(close) over (partition by symbol order by date rows between 9 preceding and current row) end as f, case when t >= 40 then avg(close) over (partition by symbol order by date rows between 39 preceding and current row) end as s from bars),
x as (select *, case when f > s and lag(f - s) over (partition by symbol order by date) <= 0 then 1 when f < s and lag(f - s) over (partition by symbol order by date) >= 0 then 0 end as sig from m),
y as (select *, last_value(sig ignore nulls) over (partition by symbol order by date rows unbounded preceding) as pos from x)
select symbol, date, coalesce(lag(pos) over (partition by symbol order by date), 0) as position from y""")
def dual_line_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Ordered(["symbol"], ["date"])
    rows = bars(spark, sf_dir).withColumns({"f": s.mean("close", 10), "s": s.mean("close", 40)})
    sig = F.when(s.crossed("f", "s"), 1).when(s.crossed("f", "s", up=False), 0)
    rows = rows.withColumn("sig", sig).withColumn("pos", s.ffill("sig"))
    return rows.select("symbol", "date", F.coalesce(s.lag("pos"), F.lit(0)).alias("position"))


FEATURES = """feat as (select o_custkey % 20 as unit, cast(year(o_orderdate) as integer) as year, avg(o_totalprice) filter (month(o_orderdate) between 1 and 6) as x1, avg(o_totalprice) filter (month(o_orderdate) > 6) as x2, cast(count(*) as double) as y from orders group by 1, 2)"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, m = table(spark, sf_dir, "orders"), F.month("o_orderdate")
    avg = lambda c: F.avg(F.when(c, F.col("o_totalprice")))
    return o.groupBy((F.col("o_custkey") % 20).alias("unit"), F.year("o_orderdate").alias("year")).agg(avg(m.between(1, 6)).alias("x1"), avg(m > 6).alias("x2"), F.count("*").cast("double").alias("y"))


@query(f"""with {FEATURES} select a.unit, a.year, round(b.x2, 4) as before_x2, round(a.x2 - a.x1, 4) as tendency, a.y from feat a join feat b on a.unit = b.unit and b.year = a.year - 1 where a.x1 is not null and a.x2 is not null and b.x2 is not null""")
def feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir)
    before = f.select("unit", (F.col("year") + 1).alias("year"), F.col("x2").alias("before_x2"))
    return f.join(before, ["unit", "year"]).dropna().select("unit", "year", r("before_x2", 4).alias("before_x2"), r(F.col("x2") - F.col("x1"), 4).alias("tendency"), "y")


@query(f"""with {FEATURES}, f as (select * from feat where x1 is not null and x2 is not null), g as (select unit, covar_pop(x1, x1) as a, covar_pop(x1, x2) as b, covar_pop(x2, x2) as d, covar_pop(x1, y) as p, covar_pop(x2, y) as q, avg(y) as my, avg(x1) as m1, avg(x2) as m2 from f group by 1),
k as (select unit, (p * d - q * b) / (a * d - b * b) as b1, (q * a - p * b) / (a * d - b * b) as b2, my, m1, m2 from g where a * d - b * b <> 0)
select unit, round(b1 * 1e4, 4) as b1, round(b2 * 1e4, 4) as b2, round(my - b1 * m1 - b2 * m2, 3) as b0 from k""")
def multiple_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = st.ols(features(spark, sf_dir).dropna(), ["unit"], "y", "x1", "x2").where("b1 is not null")
    return k.select("unit", r(F.col("b1") * 1e4, 4).alias("b1"), r(F.col("b2") * 1e4, 4).alias("b2"), r("b0", 3).alias("b0"))


@query(f"""with {FEATURES}, f as (select unit, year, x1 as x, y from feat where x1 is not null), p as (select a.unit, a.year, a.y, a.x, regr_slope(b.y, b.x) as k, regr_intercept(b.y, b.x) as c, avg(b.y) as base from f a join f b on a.unit = b.unit and a.year <> b.year group by a.unit, a.year, a.y, a.x)
select unit, count(*) as n, round(sqrt(avg(pow(y - (k * x + c), 2))), 3) as rmse, round(sqrt(avg(pow(y - base, 2))), 3) as rmse_mean from p group by 1""")
def loo_cv_ols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.leave_one_out(features(spark, sf_dir).where("x1 is not null"), ["unit"], "year", "x1", "y").select("unit", "n", r("rmse", 3).alias("rmse"), r("rmse_mean", 3).alias("rmse_mean"))


@query(f"""with {FEATURES}, u as (select unit, 'x1' as feature, x1 as x, y from feat union all select unit, 'x2', x2, y from feat), c as (select unit, feature, corr(x, y) as r from u group by 1, 2)
select unit, feature, round(r, 5) as r from (select *, row_number() over (partition by unit order by abs(r) desc, feature) as k from c) where k = 1""")
def corr_feature_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = features(spark, sf_dir).unpivot(["unit", "y"], ["x1", "x2"], "feature", "x")
    c = long.groupBy("unit", "feature").agg(F.corr("x", "y").alias("r"))
    w = Window.partitionBy("unit").orderBy(F.abs("r").desc(), "feature")
    return c.withColumn("k", F.row_number().over(w)).where("k = 1").select("unit", "feature", r("r", 5).alias("r"))


@query(f"""with {FEATURES}, m as (select unit, avg(y) as mean, var_samp(y) as var from feat group by 1) select unit, round(mean, 6) as lambda, round(var / mean, 6) as vmr, round(case when var > mean then mean * mean / (var - mean) end, 6) as size, round(case when var > mean then mean / var end, 6) as prob from m""")
def poisson_nb_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = features(spark, sf_dir).groupBy("unit").agg(F.avg("y").alias("m"), F.var_samp("y").alias("v"))
    over = F.col("v") > F.col("m")
    return m.select("unit", r("m").alias("lambda"), r(F.col("v") / F.col("m")).alias("vmr"), r(F.when(over, F.col("m") * F.col("m") / (F.col("v") - F.col("m")))).alias("size"), r(F.when(over, F.col("m") / F.col("v"))).alias("prob"))


@query(f"""with {FEATURES}, v as (select unit, y, row_number() over (partition by unit order by year) - 1 as nth, count(*) over (partition by unit) as n from feat),
whole as (select unit, count(*) as n, avg(y) as mean from feat group by 1), d as (select unit, b, cast('0x' || substr(md5(b || ':' || k), 1, 8) as bigint) % n as nth from whole, (select unnest(range(500)) as b), (select unnest(range((select max(n) from whole))) as k) where k < n),
m as (select unit, b, avg(y) as m from d join v using (unit, nth) group by 1, 2), l as (select unit, list(m order by m) as stars from m group by 1)
select unit, n, round(mean, 6) as mean, round(stars[13], 6) as low, round(stars[488], 6) as high from whole join l using (unit)""")
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = learning.bootstrap_mean(features(spark, sf_dir).select("unit", "year", "y"), ["unit"], ["year"], "y", 500, 0.95)
    return b.select("unit", "n", r("mean").alias("mean"), r("low").alias("low"), r("high").alias("high"))


def power_steps(name: str, matrix: str, steps: int = 3000) -> str:
    """The leading vector of a matrix, a list of rows, by repeated products."""
    times = lambda m, v: f"list_transform({m}, lambda row: list_dot_product(row, {v}))"
    return f"""{name}_i as (select 0 as i, m, list_transform(m, lambda row: 1.0 + row[1] / m[1][1]) as v from {matrix} union all
 select i + 1, m, list_transform(w, lambda e: e / sqrt(list_dot_product(w, w))) from (select i, m, {times('m', 'v')} as w from {name}_i where i < {steps})),
{name} as (select m, v, list_dot_product(v, {times('m', 'v')}) as size from {name}_i where i = {steps})"""


@query(f"""with recursive {CELL_YEAR}, a as (select lat, lon, year as t, (value - avg(value) over (partition by lat, lon)) * sqrt(cos(radians(lat * 10.0))) as a from cells), years as (select distinct t from a),
c as (select x.t, y.t as u, sum(x.a * y.a) as c from a x join a y on x.lat = y.lat and x.lon = y.lon group by 1, 2), full_c as (select p.t, q.t as u, coalesce(c, 0.0) as c from years p cross join years q left join c on c.t = p.t and c.u = q.t),
rws as (select t, list(c order by u) as r from full_c group by 1), mat as (select list(r order by t) as m from rws), {power_steps("one", "mat")},
rest as (select list_transform(m, lambda row, i: list_transform(row, lambda e, j: e - size * v[i] * v[j])) as m from one), {power_steps("two", "rest")},
both_ as (select 1 as mode, v, size from one union all select 2, v, size from two), tr as (select sum(c) as total from full_c where t = u), n as (select t, row_number() over (order by t) as i from years)
select cast(mode as integer) as mode, t, round(v[i] * sqrt(size) * sign(list_extract(list_sort(list_transform(v, lambda e: {{'a': abs(e), 'e': e}}), 'DESC'), 1).e), 3) as score, round(size / total, 6) as share from both_, tr, n""")
def eof_pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = learning.leading_patterns(by_cell_year(spark, sf_dir), ["lat", "lon"], "year", "value", F.sqrt(F.cos(F.radians(F.col("lat") * 10.0))), 2)
    return e.select("mode", "t", r("score", 3).alias("score"), r("share").alias("share"))


@query(f"""with {FEATURES}, d as (select * from feat where x1 is not null and x2 is not null), m as (select avg(x1) as m1, avg(x2) as m2, stddev_samp(x1) as s1, stddev_samp(x2) as s2 from d where year < 1999),
z as (select unit, year, y, (x1 - m1) / s1 as z1, (x2 - m2) / s2 as z2 from d cross join m), c as (select avg(y) as y0, var_pop(z1) + 0.1 / stddev_pop(y) as c11, var_pop(z2) + 0.1 / stddev_pop(y) as c22, covar_pop(z1, z2) as c12, covar_pop(z1, y) as c1, covar_pop(z2, y) as c2 from z where year < 1999)
select unit, year, y, round(y0 + ((c22 * c1 - c12 * c2) * z1 + (c11 * c2 - c12 * c1) * z2) / (c11 * c22 - c12 * c12), 6) as prediction from z cross join c where year >= 1999""")
def ridge_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.linear_predictions(features(spark, sf_dir).dropna(), ["x1", "x2"], "y", "year", 1999, 0.1, 0.0)
