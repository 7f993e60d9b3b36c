"""Market-panel queries: roll-ups, rolling windows, indicators, screens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import market
from ..operators.windows import Ordered, ewm, ranked_last, ranked_pct
from ..session import shared
from .base import BARS, bars, query, r

P = Ordered(["symbol"], ["date"])
W = "partition by symbol order by date"


def frame(n: int) -> str:
    return f"({W} rows between {n - 1} preceding and current row)"


def guarded(agg: str, value: str, n: int, least: int | None = None) -> str:
    return f"case when count({value}) over {frame(n)} >= {n if least is None else least} then {agg} over {frame(n)} end"


WEEKLY = """
weekly as (
  select symbol, date + cast((12 - isodow(date)) % 7 as integer) as week_end, min(struct_pack(d := date, v := open)).v as open,
         max(high) as high, min(low) as low, max(struct_pack(d := date, v := close)).v as close, sum(volume) as volume
  from bars group by 1, 2)
"""


@query(f"with {BARS}, {WEEKLY} select symbol, week_end, open, high, low, close, round(volume, 4) as volume from weekly")
def weekly_ohlcv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.weekly(bars(spark, sf_dir)).withColumn("volume", r("volume", 4))


@query(f"""with {BARS}, m as (select symbol, last_day(date) as month_end, max(struct_pack(d := date, v := close)).v as close from bars group by 1, 2)
select symbol, month_end, close, round(close / lag(close) over (partition by symbol order by month_end) - 1, 6) as ret from m""")
def month_end_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = bars(spark, sf_dir).groupBy("symbol", F.last_day("date").alias("month_end")).agg(F.max_by("close", "date").alias("close"))
    return m.select("symbol", "month_end", "close", r(Ordered(["symbol"], ["month_end"]).pct_change("close")).alias("ret"))


@query(f"""with {BARS} select symbol, date, round({guarded("avg(close)", "close", 20)}, 8) as sma20, round({guarded("avg(close)", "close", 60, 10)}, 8) as sma60 from bars""")
def rolling_mean_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir).select("symbol", "date", r(P.mean("close", 20), 8).alias("sma20"), r(P.mean("close", 60, 10), 8).alias("sma60"))


@query(f"""with {BARS} select symbol, date, round({guarded("stddev_samp(close)", "close", 20)}, 4) as std1, round({guarded("stddev_pop(close)", "close", 20)}, 4) as std0 from bars""")
def rolling_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir).select("symbol", "date", r(P.std("close", 20), 4).alias("std1"), r(P.std("close", 20, ddof=0), 4).alias("std0"))


@query(f"""with {BARS} select symbol, date, {guarded("max(high)", "high", 20)} as hh, {guarded("min(low)", "low", 20)} as ll,
round({guarded("sum(cast(close > open as int))", "close", 20)} / 20.0, 6) as hit_ratio from bars""")
def rolling_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    up = (F.col("close") > F.col("open")).cast("int")
    return bars(spark, sf_dir).select("symbol", "date", P.max("high", 20).alias("hh"), P.min("low", 20).alias("ll"), r(P.sum(up, 20) / 20.0).alias("hit_ratio"))


@query(f"""with {BARS} select symbol, date, round(case when count(close) over w >= 24 then quantile_cont(close, 0.2) over w end, 6) as q20
from bars window w as ({W} rows between 60 preceding and 1 preceding)""")
def rolling_quantile_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir).select("symbol", "date", r(P.quantile_before("close", 0.2, 60, 24)).alias("q20"))


@query(f"""with {BARS} select symbol, date, round({guarded("regr_slope(close, t)", "close", 20)}, 4) as slope from bars""")
def rolling_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir).select("symbol", "date", r(P.slope("close", 20, "t"), 4).alias("slope"))


@query(f"""with {BARS}, x as (select symbol, date, close, list(close) over {frame(50)} as held from bars)
select symbol, date, round(case when len(held) >= 10 then (len(list_filter(held, lambda v: v < close)) + (len(list_filter(held, lambda v: v = close)) + 1) / 2.0) / len(held) end, 6) as rank_last from x""")
def rolling_rank_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = bars(spark, sf_dir).select("symbol", "date", "close")
    return ranked_last(days, ["symbol"], ["date"], [("at", "close", 50, 10)]).select("symbol", "date", r("at").alias("rank_last"))


@query(f"""with {BARS}, x as (select *, {guarded("min(close)", "close", 52)} as lo, {guarded("max(close)", "close", 52)} as hi from bars)
select symbol, date, round(case when hi > lo then (close - lo) / (hi - lo) end, 6) as position from x""")
def range_position_52(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir).select("symbol", "date", r(P.range_position("close", 52)).alias("position"))


@query(f"""with {BARS} select symbol, date, round(case when count(close) over c >= 3 then avg(close) over c end, 6) as centred,
round(sum(close) over k / 5, 6) as convolved,
high = max(high) over s as swing_high, low = min(low) over s as swing_low,
round((lag(close, 2) over o + 2 * lag(close) over o + 4 * close + 2 * lead(close) over o + lead(close, 2) over o) / 10, 6) as smoothed
from bars window o as ({W}), c as ({W} rows between 3 preceding and 2 following), k as ({W} rows between 2 preceding and 2 following), s as ({W} rows between 3 preceding and 3 following)""")
def centred_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir).select(
        "symbol", "date", r(P.centred_mean("close", 6, 3)).alias("centred"), r(P.convolved("close", 5)).alias("convolved"),
        P.is_swing("high", 3).alias("swing_high"), P.is_swing("low", 3, high=False).alias("swing_low"), r(P.weighted("close", [1, 2, 4, 2, 1])).alias("smoothed"),
    )


@query(f"""with {BARS} select symbol, date, round(close - lag(close) over o, 4) as diff1, round((close - lag(close, 5) over o) / 5, 4) as diff5,
round(close / lag(close) over o - 1, 6) as pct1, round(lead(close, 20) over o / close - 1, 6) as fwd20, round(lead(close, 60) over o / close - 1, 6) as fwd60,
round(case when count(close) over f >= 11 then avg(close) over f end, 6) as fwd_mean
from bars window o as ({W}), f as ({W} rows between 5 following and 15 following)""")
def shifts_and_forward_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    close = F.col("close")
    return bars(spark, sf_dir).select(
        "symbol", "date", r(P.change("close"), 4).alias("diff1"), r(P.change("close", 5) / 5, 4).alias("diff5"), r(P.pct_change("close")).alias("pct1"),
        r(P.lag("close", -20) / close - 1).alias("fwd20"), r(P.lag("close", -60) / close - 1).alias("fwd60"),
        r(P.guarded(F.avg("close"), "close", P.rows(5, 15), 11)).alias("fwd_mean"),
    )


@query(f"""with {BARS}, x as (select *, close / lag(close) over ({W}) - 1 as ret from bars), y as (select *, exp(sum(ln(1 + ret)) over u) as equity from x window u as ({W} rows unbounded preceding))
select symbol, date, round(sum(volume) over u, 4) as cum_volume, round(equity / first_value(equity ignore nulls) over ({W} rows between unbounded preceding and unbounded following), 4) as equity,
max(close) over u as peak, round(close / max(close) over u - 1, 6) as drawdown from y window u as ({W} rows unbounded preceding)""")
def cumulative_equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bars(spark, sf_dir).withColumn("ret", P.pct_change("close"))
    rows = rows.withColumn("equity", P.cumulative_return("ret"))
    first = F.first("equity", ignorenulls=True).over(P.rows(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.select("symbol", "date", r(P.cumulative(F.sum("volume")), 4).alias("cum_volume"), r(F.col("equity") / first, 4).alias("equity"), P.cumulative(F.max("close")).alias("peak"), r(P.drawdown("close")).alias("drawdown"))


@query(f"""with {BARS}, x as (select *, {guarded("avg(close)", "close", 20)} as m, {guarded("stddev_pop(close)", "close", 20)} as s from bars)
select symbol, date, round(100 * (4 * s) / m, 4) as bandwidth, round(case when s > 0 then (close - m + 2 * s) / (4 * s) end, 4) as percent_b from x""")
def bollinger_bandwidth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.bollinger(bars(spark, sf_dir), 20).select("symbol", "date", r("bandwidth", 4).alias("bandwidth"), r("percent_b", 4).alias("percent_b"))


TR = f"tr as (select *, greatest(high - low, abs(high - lag(close) over ({W})), abs(low - lag(close) over ({W}))) as tr from bars)"


@query(f"""with {BARS}, {TR} select symbol, date, round(tr, 4) as tr, round({guarded("avg(tr)", "tr", 14)}, 4) as atr from tr""")
def atr_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bars(spark, sf_dir).withColumn("tr", market.true_range())
    return rows.select("symbol", "date", r("tr", 4).alias("tr"), r(P.mean("tr", 14), 4).alias("atr"))


def fold_sql(rows: str, value: str, alpha: str, least: int, out: str, digits: int) -> str:
    """Recursive SQL of an exponentially weighted mean of ``value`` in ``rows``
    (symbol, date, t)."""
    return f"""f as (
  select symbol, date, t, cast({value} as double) as m, case when {value} is null then 0 else 1 end as n from {rows} where t = 1
  union all
  select x.symbol, x.date, x.t, case when x.{value} is null then f.m when f.m is null then x.{value} else f.m * (1 - {alpha}) + x.{value} * {alpha} end,
         f.n + case when x.{value} is null then 0 else 1 end
  from f join {rows} x on x.symbol = f.symbol and x.t = f.t + 1)
select symbol, date, round(case when n >= {least} then m end, {digits}) as {out} from f"""


@query(f"with recursive {BARS}, {TR}, {fold_sql('tr', 'tr', '(1.0::double / 14)', 14, 'atr_wilder', 4)}")
def ewm_wilder_atr(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bars(spark, sf_dir).withColumn("tr", market.true_range())
    return ewm(rows, ["symbol"], ["date"], "tr", 1.0 / 14, "e", 14).select("symbol", "date", r("e", 4).alias("atr_wilder"))


def ewm_fold(rows: str, out: str, means: list[tuple[str, str, str]]) -> str:
    """Recursive SQL of exponentially weighted means without nulls but leading
    ones: (name, value, alpha), of ``rows`` or of the means before it."""
    made = {name: value for name, value, _ in means}
    seed = {name: (value if value not in made else made[value]) for name, value, _ in means}
    while any(v in made for v in seed.values()):
        seed = {n: made.get(v, v) for n, v in seed.items()}
    first = ", ".join(f"cast({seed[name]} as double) as {name}" for name, *_ in means)
    step: dict[str, str] = {}
    for name, value, alpha in means:
        new = step.get(value, f"x.{value}")
        step[name] = f"(case when f.{name} is null then {new} else f.{name} * (1 - {alpha}) + {new} * {alpha} end)"
    return f"{out} as (select symbol, date, t, {first} from {rows} where t = 1 union all select x.symbol, x.date, x.t, {', '.join(f'{e} as {n}' for n, e in step.items())} from {out} f join {rows} x on x.symbol = f.symbol and x.t = f.t + 1)"


@query(f"""with recursive {BARS}, g as (select symbol, date, t, greatest(close - lag(close) over ({W}), 0) as d, greatest(lag(close) over ({W}) - close, 0) as e from bars),
g2 as (select symbol, date, t, case when t > 1 then d end as gain, case when t > 1 then e end as loss from g),
{ewm_fold("g2", "m", [("up", "gain", "(1.0::double / 14)"), ("down", "loss", "(1.0::double / 14)")])}
select symbol, date, round(case when t > 14 and up + down <> 0 then 100 * up / (up + down) end, 4) as rsi from m""")
def rsi_wilder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.rsi(bars(spark, sf_dir), 14).select("symbol", "date", r("rsi", 4).alias("rsi"))


@query(f"""with recursive {BARS}, {ewm_fold("bars", "m", [("f0", "close", "(2.0::double / 13)"), ("s0", "close", "(2.0::double / 27)"), ("e1", "close", "(2.0::double / 13)"), ("e2", "e1", "(2.0::double / 13)"), ("e3", "e2", "(2.0::double / 13)")])},
k as (select symbol, date, t, f0 - s0 as macd, 100 * (e3 / lag(e3) over ({W}) - 1) as trix from m), {ewm_fold("k", "n", [("signal", "macd", "(2.0::double / 10)")])}
select symbol, date, round(macd, 4) as macd, round(signal, 4) as signal, round(macd - signal, 4) as hist, round(trix, 4) as trix from k join n using (symbol, date)""")
def macd_trix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.macd_trix(bars(spark, sf_dir)).select("symbol", "date", *[r(c, 4).alias(c) for c in ("macd", "signal", "hist", "trix")])


@query(f"""with {BARS}, x as (select *, sign(close - lag(close) over ({W})) * volume as v, (high + low + close) / 3 as tp from bars),
y as (select *, tp * volume as mf, tp - lag(tp) over ({W}) as dtp, {guarded("avg(tp)", "tp", 14)} as ma from x),
z as (select *, {guarded("avg(abs(tp - ma))", "abs(tp - ma)", 14)} as md, coalesce(sum(v) over ({W} rows unbounded preceding), 0) as obv,
 {guarded("sum(case when dtp > 0 then mf else 0 end)", "dtp", 14)} as pos, {guarded("sum(case when dtp < 0 then mf else 0 end)", "dtp", 14)} as neg from y)
select symbol, date, round(obv, 4) as obv, round(case when pos + neg > 0 then 100 * pos / (pos + neg) end, 4) as mfi, round(case when md > 0 then (tp - ma) / (0.015 * md) end, 4) as cci from z""")
def obv_mfi_cci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.obv_mfi_cci(bars(spark, sf_dir), 14).select("symbol", "date", *[r(c, 4).alias(c) for c in ("obv", "mfi", "cci")])


@query(f"""with {BARS}, x as (select *, ln(close / lag(close) over ({W})) as lr from bars),
y as (select *, {guarded("avg(close)", "close", 5)} as a, {guarded("avg(close)", "close", 20)} as b, {guarded("avg(close)", "close", 60)} as c, {guarded("stddev_pop(lr)", "lr", 20)} as s from x)
select symbol, date, round(s * sqrt(252), 4) as vol, coalesce(a > b and b > c, false) as stacked from y""")
def realized_vol_sma_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bars(spark, sf_dir).withColumn("lr", F.log(F.col("close") / P.lag("close")))
    a, b, c = (P.mean("close", n) for n in (5, 20, 60))
    return rows.select("symbol", "date", r(P.std("lr", 20, ddof=0) * F.sqrt(F.lit(252.0)), 4).alias("vol"), F.coalesce((a > b) & (b > c), F.lit(False)).alias("stacked"))


@query(f"""with {BARS}, x as (select symbol, date, close / lag(close, 21) over ({W}) - 1 as ret from bars),
y as (select *, rank() over (partition by date order by ret asc nulls last) - 1 as less, count(*) over (partition by date, ret) as ties, count(*) over (partition by date) as n from x)
select symbol, date, round(ret, 6) as ret, round(100 * (less + 1 + (ties - 1) / 2.0) / n, 4) as rps from y""")
def rps_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bars(spark, sf_dir).select("symbol", "date", P.pct_change("close", 21).alias("ret"))
    return ranked_pct(rows, ["date"], "ret", "p").select("symbol", "date", r("ret").alias("ret"), r(100 * F.col("p"), 4).alias("rps"))


@query(f"""with {BARS}, x as (select symbol, date_trunc('month', date)::date as month, sum(volume) as volume from bars group by 1, 2)
select * from (select month, symbol, round(volume, 4) as volume, cast(row_number() over (partition by month order by volume desc, symbol) as integer) as place from x) where place <= 3""")
def topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bars(spark, sf_dir).groupBy(F.trunc("date", "month").alias("month"), "symbol").agg(F.sum("volume").alias("volume"))
    w = Window.partitionBy("month").orderBy(F.desc("volume"), "symbol")
    return rows.withColumn("place", F.row_number().over(w)).where("place <= 3").select("month", "symbol", r("volume", 4).alias("volume"), "place")


@query(f"""with {BARS}, x as (select *, {guarded("avg(close)", "close", 5)} - {guarded("avg(close)", "close", 20)} as d from bars),
y as (select *, coalesce(d > 0 and lag(d) over ({W}) <= 0, false) as up, coalesce(d < 0 and lag(d) over ({W}) >= 0, false) as down from x)
select symbol, date, up, down, max(cast(up as int)) over {frame(7)} = 1 as up_recent, coalesce(close > case when count(close) over b >= 20 then max(close) over b end, false) as breakout
from y window b as ({W} rows between 20 preceding and 1 preceding)""")
def cross_and_breakout_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bars(spark, sf_dir).withColumns({"a": P.mean("close", 5), "b": P.mean("close", 20)})
    rows = rows.withColumns({"up": P.crossed("a", "b"), "down": P.crossed("a", "b", up=False)})
    return rows.select("symbol", "date", "up", "down", P.any_within("up", 7).alias("up_recent"), P.breaks_out("close", 20).alias("breakout"))


@query(f"""with {BARS} select symbol, date, round((close - avg(close) over p) / stddev_samp(close) over p, 4) as z, round((volume - min(volume) over p) / nullif(max(volume) over p - min(volume) over p, 0), 6) as scaled
from bars window p as (partition by symbol)""")
def group_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("symbol")
    z = (F.col("close") - F.avg("close").over(w)) / F.stddev_samp("close").over(w)
    scaled = F.try_divide(F.col("volume") - F.min("volume").over(w), F.max("volume").over(w) - F.min("volume").over(w))
    return bars(spark, sf_dir).select("symbol", "date", r(z, 4).alias("z"), r(scaled).alias("scaled"))


def calm_sql(rows: str, date: str, n: int, lookback: int, q: float, out: str, q_band: float | None = None) -> str:
    """Recursive SQL of ``market.calm`` over ``rows`` (symbol, ``date``, t)."""
    w, least = f"partition by symbol order by {date}", max(5, lookback // 5)
    rank = lambda c: f"case when len(l_{c}) >= {least} then (len(list_filter(l_{c}, lambda v: v < l_{c}[len(l_{c})])) + (len(list_filter(l_{c}, lambda v: v = l_{c}[len(l_{c})])) + 1) / 2.0) / len(l_{c}) end"
    alpha = f"(1.0::double / {n})"
    return f"""{out}_tr as (select *, greatest(high - low, abs(high - lag(close) over ({w})), abs(low - lag(close) over ({w}))) as tr from {rows}),
{out}_m as (select symbol, t, cast(tr as double) as m from {out}_tr where t = 1 union all select x.symbol, x.t, f.m * (1 - {alpha}) + x.tr * {alpha} from {out}_m f join {out}_tr x on x.symbol = f.symbol and x.t = f.t + 1),
{out}_v as (select x.*, case when x.t >= {n} then m end as atr, case when x.t >= {n} then 4 * stddev_pop(close) over (partition by x.symbol order by x.t rows between {n - 1} preceding and current row) / avg(close) over (partition by x.symbol order by x.t rows between {n - 1} preceding and current row) end as bbw from {out}_tr x join {out}_m f on x.symbol = f.symbol and x.t = f.t),
{out}_l as (select symbol, {date}, list(atr) filter (atr is not null) over k as l_atr, list(bbw) filter (bbw is not null) over k as l_bbw from {out}_v window k as (partition by symbol order by t rows between {lookback - 1} preceding and current row)),
{out} as (select symbol, {date} from {out}_l where {rank("atr")} <= {q} or {rank("bbw")} <= {q if q_band is None else q_band})"""


@query(f"""with recursive {BARS}, {WEEKLY}, weeks as (select *, row_number() over (partition by symbol order by week_end) as t from weekly), {calm_sql("weeks", "week_end", 20, 52, 0.35, "cw")}, {calm_sql("bars", "date", 20, 252, 0.2, "cd")}
select symbol, date, close from bars join cd using (symbol, date) where exists (select 1 from cw where cw.symbol = bars.symbol and bars.date between cw.week_end + 1 and cw.week_end + 41)""")
def low_volatility_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calm days in the weeks after a calm week."""
    return market.low_volatility_days(bars(spark, sf_dir), 20, (52, 0.35), (252, 0.2), 40).select("symbol", "date", "close")


@query(f"""with recursive {BARS}, {WEEKLY}, weeks as (select *, row_number() over (partition by symbol order by week_end) as t from weekly), {calm_sql("weeks", "week_end", 20, 52, 0.3, "cw", 0.2)}, {calm_sql("bars", "date", 20, 126, 0.15, "cd", 0.1)}
select symbol, date, close from bars join cd using (symbol, date) where exists (select 1 from cw where cw.symbol = bars.symbol and bars.date between cw.week_end + 1 and cw.week_end + 21)""")
def low_volatility_either(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``low_volatility_screen``, with a share of its own for each measure."""
    return market.low_volatility_days(bars(spark, sf_dir), 20, (52, 0.3, 0.2), (126, 0.15, 0.1), 20).select("symbol", "date", "close")


ZIGZAG = """zz as (
  select symbol, t, 0 as trend, high as mx, t as mi, low as mn, t as ni, cast(null as bigint) as st, cast(null as double) as sp, cast(null as varchar) as kind from bars where t = 1
  union all
  select symbol, t, case when up then 1 when down then -1 else trend end,
         case when up or (trend >= 0 and hi > mx) then hi else mx end, case when up or (trend >= 0 and hi > mx) then t else mi end,
         case when down or (trend <= 0 and lo < mn) then lo else mn end, case when down or (trend <= 0 and lo < mn) then t else ni end,
         case when up then ni2 when down then mi2 end, case when up then mn2 when down then mx2 end, case when up then 'low' when down then 'high' end
  from (select *, (trend = 0 or (trend = -1 and not lo < mn)) and hi - mn2 >= 0.3 * mn2 and ni2 < t as up,
               not ((trend = 0 or (trend = -1 and not lo < mn)) and hi - mn2 >= 0.3 * mn2 and ni2 < t) and (trend = 0 or (trend = 1 and not hi > mx)) and mx2 - lo >= 0.3 * mx2 and mi2 < t as down
        from (select x.symbol, x.t, f.trend, f.mx, f.mi, f.mn, f.ni, x.high as hi, x.low as lo,
                     case when f.trend = 0 and x.high > f.mx then x.high else f.mx end as mx2, case when f.trend = 0 and x.high > f.mx then x.t else f.mi end as mi2,
                     case when f.trend = 0 and x.low < f.mn then x.low else f.mn end as mn2, case when f.trend = 0 and x.low < f.mn then x.t else f.ni end as ni2
              from zz f join bars x on x.symbol = f.symbol and x.t = f.t + 1))),
swings as (select zz.symbol, b.date, st as t, sp as price, kind from zz join bars b on b.symbol = zz.symbol and b.t = st where kind is not null)"""


@query(f"""with recursive {BARS}, {ZIGZAG} select * from swings""")
def zigzag_swings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.zigzag(bars(spark, sf_dir), 0.3)


@query(f"""with recursive {BARS}, {ZIGZAG}, h as (select s.*, (select min(struct_pack(t := l.t, d := l.date, p := l.price)) from swings l where l.symbol = s.symbol and l.kind = 'low' and l.t > s.t) as low, (select min(x.t) from swings x where x.symbol = s.symbol and x.kind = 'high' and x.t > s.t) as nxt from swings s where kind = 'high'),
legs as (select symbol, t, date as high_date, price as high, low.d as low_date, low.p as low, (price - low.p) / price as dr from h where low is not null and (nxt is null or nxt >= low.t) and low.t - t >= 1 and (price - low.p) / price between 0.03 and 0.99)
select symbol, high_date, high, low_date, low, round(dr, 6) as drop, coalesce(lag(dr) over w > dr and lag(dr, 2) over w > lag(dr) over w and low > lag(low, 2) over w and lag(low) over w > lag(low, 2) over w, false) as valid from legs window w as (partition by symbol order by t)""")
def vcp_contractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contractions between swings, and whether the last three shrink. Bounds are
    wide here, as the prices of line items jump."""
    return market.contractions(market.zigzag(bars(spark, sf_dir), 0.3), 0.03, 0.99, 1, 3).withColumn("drop", r("drop"))


@query(f"""with recursive {BARS}, {ZIGZAG}, h as (select s.*, (select min(struct_pack(t := l.t, d := l.date, p := l.price)) from swings l where l.symbol = s.symbol and l.kind = 'low' and l.t > s.t) as low, (select min(x.t) from swings x where x.symbol = s.symbol and x.kind = 'high' and x.t > s.t) as nxt from swings s where kind = 'high'),
legs as (select symbol, t, date as high_date, price as high, low.d as low_date, low.p as low, (price - low.p) / price as dr from h where low is not null and (nxt is null or nxt >= low.t) and low.t - t >= 1 and (price - low.p) / price between 0.03 and 0.99)
select symbol, high_date, high, low_date, low, round(dr, 6) as drop, coalesce(dr <= 0.9 and lag(dr) over w > dr + 0.02 and low - lag(low) over w > 100, false) as valid from legs window w as (partition by symbol order by t)""")
def vcp_tight_contractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contractions whose drop shrinks and whose low rises by more than a margin."""
    legs = market.contractions(market.zigzag(bars(spark, sf_dir), 0.3), 0.03, 0.99, 1, 2)
    return market.tight_contractions(legs, 2, 0.02, 100.0, 0.9).withColumn("drop", r("drop"))


BREAKOUTS = f"""x as (select *, case when count(high) over p >= 20 then max(high) over p end as pivot_high, case when count(volume) over v >= 20 then avg(volume) over v end as mv from bars window p as ({W} rows between 20 preceding and 1 preceding), v as ({W} rows between 19 preceding and current row))"""


@query(f"""with {BARS}, {BREAKOUTS}
select symbol, date, close, pivot_high, round(volume / mv, 6) as volume_ratio from x where close > pivot_high and volume > 1.2 * mv and (high - close) <= 0.5 * (high - low)""")
def breakout_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return breakouts(bars(spark, sf_dir)).select("symbol", "date", "close", "pivot_high", "volume_ratio")


def breakouts(rows: DataFrame) -> DataFrame:
    """Bars that close above their pivot on volume."""
    rows = rows.withColumns({"pivot_high": P.guarded(F.max("high"), "high", P.rows(-20, -1), 20), "mv": P.mean("volume", 20)})
    ok = (F.col("close") > F.col("pivot_high")) & (F.col("volume") > 1.2 * F.col("mv")) & (F.col("high") - F.col("close") <= 0.5 * (F.col("high") - F.col("low")))
    return rows.where(ok).withColumn("volume_ratio", r(F.col("volume") / F.col("mv")))


@query(f"""with {BARS}, {BREAKOUTS}, e as (select symbol, date, t, close as entry from x where close > pivot_high and volume > 1.2 * mv and (high - close) <= 0.5 * (high - low)),
y as (select e.symbol, e.date, e.entry, b.t - e.t as k, b.t > e.t and b.low <= e.entry * 0.9 as stop, b.t > e.t and b.high >= e.entry * 1.2 as take, b.close as px, b.t = max(b.t) over (partition by e.symbol, e.date) as final
 from e join bars b on b.symbol = e.symbol and b.t between e.t and e.t + 20),
z as (select *, row_number() over (partition by symbol, date order by k) as nth from y where stop or take or final)
select symbol, date, cast(k as integer) as bars_held, case when stop then 'stop' when take then 'take' else 'time' end as reason, round(case when stop then entry * 0.9 when take then entry * 1.2 else px end / entry - 1, 6) as ret from z where nth = 1""")
def barrier_exit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exits of every breakout signal. Bars are written once and read four times."""
    rows = shared(bars(spark, sf_dir))
    out = market.barrier_exits(rows, breakouts(rows), stop=0.1, take=0.2, hold=20)
    return out.select("symbol", "date", "bars_held", "reason", r("ret").alias("ret"))
