"""Queries on price patterns, on smooth bars: order priorities are the symbols,
means of twenty days of their orders the prices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import patterns
from ..operators.windows import Ordered, ranked_pct
from .base import BARS, bars, query, r, table

SMOOTH = """
sd as (select o_orderpriority as symbol, cast(o_orderdate as date) as date, avg(o_totalprice) as v, count(*) * 100.0 + o_orderdate_mod as volume from (select *, (date_diff('day', date '1992-01-01', cast(o_orderdate as date)) * 37) % 97 as o_orderdate_mod from orders) group by 1, 2, o_orderdate_mod),
sm as (select *, row_number() over (partition by symbol order by date) as t, avg(v) over (partition by symbol order by date rows between 19 preceding and current row) as close from sd),
smooth as (select symbol, date, t, volume, close, greatest(close, lag(close, 1, close) over (partition by symbol order by date)) * 1.002 as high, least(close, lag(close, 1, close) over (partition by symbol order by date)) * 0.998 as low from sm)
"""


def smooth_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Ordered(["symbol"], ["date"])
    date = F.to_date("o_orderdate")
    noise = F.datediff(F.first("date"), F.lit("1992-01-01").cast("date")) * 37 % 97
    d = table(spark, sf_dir, "orders").withColumn("date", date).groupBy(F.col("o_orderpriority").alias("symbol"), "date").agg(F.avg("o_totalprice").alias("v"), (F.count("*") * 100.0 + noise).alias("volume"))
    d = d.withColumns({"t": F.row_number().over(s.spec()), "close": F.avg("v").over(s.rows(-19))})
    before = F.lag("close", 1).over(s.spec())
    return d.select("symbol", "date", "t", "volume", "close", (F.greatest("close", before) * 1.002).alias("high"), (F.least("close", before) * 0.998).alias("low"))


def flags_sql(rise: str) -> str:
    """Flags of ``smooth``: highs and lows joined by ranges of places, the legs of
    each bar's own window numbered from its end; ``rise`` is the tolerance."""
    return f"""{SMOOTH}, tr as (select *, greatest(high - low, abs(high - lag(close) over w), abs(low - lag(close) over w)) as tr from smooth window w as (partition by symbol order by t)),
sw as (select *, avg(tr) over (partition by symbol order by t rows between 19 preceding and current row) as atr, count(*) over c as n, max(high) over c as mx, min(low) over c as mn from tr window c as (partition by symbol order by t rows between 2 preceding and 2 following)),
hs as (select symbol, t + 2 as t, high as price from sw where n = 5 and high = mx and t + 2 <= (select max(t) from smooth x where x.symbol = sw.symbol)), ls as (select symbol, t + 2 as t, low as price from sw where n = 5 and low = mn and t + 2 <= (select max(t) from smooth x where x.symbol = sw.symbol)),
hl as (select h.symbol, h.t as high_t, h.price as high, min(l.t) as low_t from hs h join ls l on l.symbol = h.symbol and l.t >= h.t + 5 group by 1, 2, 3),
le as (select hl.*, l.price as low, (hl.high - l.price) / hl.high as dr, sw.atr from hl join ls l on l.symbol = hl.symbol and l.t = low_t join sw on sw.symbol = hl.symbol and sw.t = low_t
 where not exists (select 1 from hs x where x.symbol = hl.symbol and x.t > high_t and x.t <= low_t) and hl.high > l.price and (hl.high - l.price) / hl.high between 0.02 and 0.4),
own as (select b.symbol, b.t, le.high_t, le.high, le.low, le.dr, le.atr, row_number() over (partition by b.symbol, b.t order by le.low_t desc) as nth from smooth b join le on le.symbol = b.symbol and le.low_t <= b.t and le.high_t >= b.t - 119),
fl as (select a.symbol, a.t, a.high as piv, a.high_t as pivot_t from own a join own b on b.symbol = a.symbol and b.t = a.t and b.nth = 2 where a.nth = 1 and b.dr > a.dr and a.low - b.low > {rise})"""


RISES = {"atr": (("atr", 0.5), "0.5 * a.atr"), "pct": (("pct", 0.01), "0.01 * b.low"), "abs": (("abs", 500.0), "500")}


def flags(spark: SparkSession, sf_dir: str, rise: str) -> DataFrame:
    return patterns.contraction_flags(smooth_bars(spark, sf_dir), 5, 120, 0.02, 0.4, 5, 2, 0.0, RISES[rise][0])


def flag_query(kind: str) -> None:
    def vcp(spark: SparkSession, sf_dir: str) -> DataFrame:
        return flags(spark, sf_dir, kind).where("vcp_ok").select("symbol", "t", r("pivot", 2).alias("pivot"), "pivot_t")

    vcp.__name__ = f"vcp_flags_{kind}"
    vcp.__doc__ = "Bars on which the contractions of the last 120 shrink, as known on the bar."
    query(f"with {flags_sql(RISES[kind][1])} select symbol, t, round(piv, 2) as \"pivot\", pivot_t from fl")(vcp)


for _kind in RISES:
    flag_query(_kind)


@query(f"""with {flags_sql(RISES["pct"][1])}, pv as (select distinct symbol, pivot_t, piv from fl), vm as (select *, case when count(*) over w >= 20 then avg(volume) over w end as mean from smooth window w as (partition by symbol order by t rows between 49 preceding and current row))
select p.symbol, p.pivot_t, round(p.piv, 2) as "pivot", min(b.t) as t from pv p join vm b on b.symbol = p.symbol and b.t between p.pivot_t + 1 and p.pivot_t + 20 and b.close > p.piv and b.volume > 1.1 * mean and (b.high - b.close) / nullif(b.high - b.low, 0) <= 0.6 group by 1, 2, 3""")
def pivot_breakouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first bar of twenty that breaks out over the pivot of a contraction."""
    rows = smooth_bars(spark, sf_dir)
    pivots = flags(spark, sf_dir, "pct").where("vcp_ok").select("symbol", "pivot_t", "pivot").distinct()
    out = patterns.first_breakouts(rows, pivots, 20, 1.1)
    return out.select("symbol", "pivot_t", r("pivot", 2).alias("pivot"), "t")


SPANS = (21, 63, 126, 252)


@query(f"with {BARS}, x as (select symbol, date, t, close, {', '.join(f'close / lag(close, {n}) over (partition by symbol order by date) - 1 as r{n}' for n in SPANS)} from bars), "
       + "y as (" + " union all ".join(f"select symbol, date, {n} as span, rank() over (partition by date order by r{n} asc nulls last) - 1 as less, count(*) over (partition by date, r{n}) as ties, count(*) over (partition by date) as n from x" for n in SPANS) + ") "
       + "select symbol, date, " + ", ".join(f"round(max(case when span = {n} then 100 * (less + 1 + (ties - 1) / 2.0) / n end), 4) as rps_{n}" for n in SPANS) + " from y group by 1, 2")
def rps_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percent ranks of returns over one, three, six and twelve months."""
    s = Ordered(["symbol"], ["date"])
    rows = bars(spark, sf_dir).select("symbol", "date", *[s.pct_change("close", n).alias(f"r{n}") for n in SPANS])
    for n in SPANS:
        rows = ranked_pct(rows, ["date"], f"r{n}", f"p{n}")
    return rows.select("symbol", "date", *[r(100 * F.col(f"p{n}"), 4).alias(f"rps_{n}") for n in SPANS])
