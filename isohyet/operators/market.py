"""Market operators on a bar panel: symbol, date, open, high, low, close,
volume and t (the bar's number in its symbol)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared
from .windows import Ordered, ewms

P = Ordered(["symbol"], ["date"])


def weekly(bars: DataFrame) -> DataFrame:
    """Bars of weeks that end on Friday; a week without a bar has no row."""
    week = F.next_day(F.date_sub("date", 1), "FRI").alias("week_end")
    return bars.groupBy("symbol", week).agg(
        F.min_by("open", "date").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "date").alias("close"), F.sum("volume").alias("volume")
    )


def true_range(s: Ordered = P) -> Column:
    before = s.lag("close")
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def bollinger(bars: DataFrame, n: int) -> DataFrame:
    m, s = P.mean("close", n), P.std("close", n, ddof=0)
    return bars.withColumns({"bandwidth": 100 * (4 * s) / m, "percent_b": F.try_divide(F.col("close") - m + 2 * s, 4 * s)})


def rsi(bars: DataFrame, n: int) -> DataFrame:
    """Wilder's index; nothing is filled backwards, so it never looks ahead."""
    d = P.change("close")
    rows = bars.select("symbol", "date", F.greatest(d, F.lit(0.0)).alias("gain"), F.greatest(-d, F.lit(0.0)).alias("loss"), d.isNull().alias("first"))
    rows = rows.withColumns({c: F.when(~F.col("first"), F.col(c)) for c in ("gain", "loss")})
    rows = ewms(rows, ["symbol"], ["date"], [("up", "gain", 1.0 / n, n), ("down", "loss", 1.0 / n, n)])
    return rows.withColumn("rsi", F.try_divide(100 * F.col("up"), F.col("up") + F.col("down")))


def macd_trix(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, n: int = 12) -> DataFrame:
    span = lambda name, value, k: (name, value, 2.0 / (k + 1), 1)
    rows = bars.select("symbol", "date", "close")
    rows = ewms(rows, ["symbol"], ["date"], [span("_f", "close", fast), span("_s", "close", slow), span("_1", "close", n), span("_2", "_1", n), span("_3", "_2", n)])
    rows = rows.withColumns({"macd": F.col("_f") - F.col("_s"), "trix": 100 * P.pct_change("_3")})
    return ewms(rows, ["symbol"], ["date"], [span("signal", "macd", signal)]).withColumn("hist", F.col("macd") - F.col("signal"))


def obv_mfi_cci(bars: DataFrame, n: int) -> DataFrame:
    """On-balance volume, money-flow index, and the commodity channel index
    whose deviation is the mean of distances to each bar's own average."""
    tp = (F.col("high") + F.col("low") + F.col("close")) / 3
    rows = bars.withColumns({"tp": tp, "_v": F.signum(P.change("close")) * F.col("volume")})
    rows = rows.withColumns({"ma": P.mean("tp", n), "_d": P.change("tp"), "_mf": F.col("tp") * F.col("volume")})
    flow = lambda cond: P.guarded(F.sum(F.when(cond, F.col("_mf")).otherwise(0.0)), "_d", P.rows(1 - n), n)
    pos, neg = flow(F.col("_d") > 0), flow(F.col("_d") < 0)
    md = P.mean(F.abs(F.col("tp") - F.col("ma")), n)
    return rows.withColumns({"obv": F.coalesce(P.cumulative(F.sum("_v")), F.lit(0.0)), "mfi": F.try_divide(100 * pos, pos + neg), "cci": F.try_divide(F.col("tp") - F.col("ma"), 0.015 * md)})


def barrier_exits(bars: DataFrame, entries: DataFrame, stop: float, take: float, hold: int) -> DataFrame:
    """First exit of each entry within ``hold`` bars: stop before take within a
    bar, else the close of the last bar there is: an entry on a symbol's last bar
    leaves after no bar, at its own price. The join is on the symbol and blocks
    of ``hold`` bars."""
    e = entries.select("symbol", F.col("date").alias("entry_date"), F.col("t").alias("et"), F.col("close").alias("entry"))
    last = bars.groupBy("symbol").agg(F.max("t").alias("lt"))
    ends = e.join(last, "symbol").withColumn("final", F.least(F.col("lt"), F.col("et") + hold))
    blocks = ends.withColumn("block", F.explode(F.array_distinct(F.array(F.floor(F.col("et") / hold), F.floor(F.col("final") / hold)))))
    later = bars.withColumn("block", F.floor(F.col("t") / hold))
    rows = blocks.join(later, ["symbol", "block"]).where((F.col("t") >= F.col("et")) & (F.col("t") <= F.col("final")))
    k = F.col("t") - F.col("et")
    stopped, taken = (k > 0) & (F.col("low") <= F.col("entry") * (1 - stop)), (k > 0) & (F.col("high") >= F.col("entry") * (1 + take))
    reason = F.when(stopped, "stop").when(taken, "take").otherwise("time")
    price = F.when(stopped, F.col("entry") * (1 - stop)).when(taken, F.col("entry") * (1 + take)).otherwise(F.col("close"))
    first = F.min(F.struct(k.cast("int").alias("k"), reason.alias("reason"), price.alias("px")))
    out = rows.where(stopped | taken | (F.col("t") == F.col("final"))).groupBy("symbol", "entry_date", "entry").agg(first.alias("x"))
    return out.select("symbol", F.col("entry_date").alias("date"), F.col("x.k").alias("bars_held"), F.col("x.reason").alias("reason"), (F.col("x.px") / F.col("entry") - 1).alias("ret"))


def calm(rows: DataFrame, by: list[str], order: list[str], n: int, lookback: int, q: float, q_band: float | None = None) -> DataFrame:
    """Rows on which the smoothed true range ranks in the lowest ``q``, or the
    bandwidth in the lowest ``q_band`` (else ``q``, too), of the ``lookback`` rows
    up to it."""
    s = Ordered(by, order)
    rows = rows.withColumns({"_tr": true_range(s), "_bbw": 4 * s.std("close", n, ddof=0) / s.mean("close", n)})
    least = max(5, lookback // 5)
    rows = ewms(rows, by, order, [("_atr", "_tr", 1.0 / n, n)], [("_range", "_atr", lookback, least), ("_band", "_bbw", lookback, least)])
    return rows.where((F.col("_range") <= q) | (F.col("_band") <= (q if q_band is None else q_band)))


def low_volatility_days(days: DataFrame, n: int, weeks: tuple[float, ...], daily: tuple[float, ...], after: int) -> DataFrame:
    """Calm days in the ``after`` + 1 days that follow a calm week; ``weeks`` and
    ``daily`` are the rows looked back on and the share of them, or a share for
    the range and one for the band. Days are written once and read twice."""
    days = shared(days)
    flagged = calm(weekly(days), ["symbol"], ["week_end"], n, *weeks)
    # Each flag covers a bounded number of days: listing them makes the range
    # join an equi-join.
    open_days = flagged.select("symbol", F.explode(F.sequence(F.date_add("week_end", 1), F.date_add("week_end", after + 1))).alias("date")).distinct()
    return calm(days, ["symbol"], ["date"], n, *daily).join(open_days, ["symbol", "date"], "left_semi")


def zigzag(bars: DataFrame, reversal: float) -> DataFrame:
    """Swing points that a move of ``reversal`` or more confirms. A bar that sets
    an extreme does not confirm it; before the first swing a low is looked for
    first. True sequential state: one function call a symbol, on its bars."""

    def swings(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        highs, lows, out, trend = pdf["high"].tolist(), pdf["low"].tolist(), [], 0
        top = bottom = 0  # bars of the extremes
        for i in range(1, len(pdf)):
            higher, lower = highs[i] > highs[top], lows[i] < lows[bottom]
            if trend == 0:
                top, bottom = (i if higher else top), (i if lower else bottom)
            rose = highs[i] - lows[bottom] >= reversal * lows[bottom] and bottom < i
            fell = highs[top] - lows[i] >= reversal * highs[top] and top < i
            if (trend == 0 or (trend < 0 and not lower)) and rose:
                out.append((bottom, lows[bottom], "low"))
                trend, top = 1, i
            elif (trend == 0 or (trend > 0 and not higher)) and fell:
                out.append((top, highs[top], "high"))
                trend, bottom = -1, i
            elif trend > 0 and higher:
                top = i
            elif trend < 0 and lower:
                bottom = i
        at = [k for k, _, _ in out]
        return pd.DataFrame({"symbol": pdf["symbol"].iloc[0], "date": pdf["date"].iloc[at].tolist(), "t": pdf["t"].iloc[at].tolist(), "price": [x for _, x, _ in out], "kind": [x for _, _, x in out]})

    return bars.select("symbol", "date", "t", "high", "low").groupBy("symbol").applyInPandas(swings, "symbol string, date date, t long, price double, kind string")


def contractions(swings: DataFrame, min_drop: float, max_drop: float, min_bars: int, need: int) -> DataFrame:
    """Legs from a high to the next low, without a high between, at least
    ``min_bars`` long and of a drop within bounds; ``valid`` if the last ``need``
    drops shrink and no later low of theirs is at or under the first."""
    w = Window.partitionBy("symbol").orderBy("t")
    later = w.rangeBetween(1, Window.unboundedFollowing)
    low = F.min(F.when(F.col("kind") == "low", F.struct("t", "date", "price"))).over(later)
    high = F.min(F.when(F.col("kind") == "high", F.col("t"))).over(later)
    legs = swings.withColumns({"low": low, "next": high}).where("kind = 'high' and low is not null and (next is null or next >= low.t)")
    legs = legs.withColumn("drop", (F.col("price") - F.col("low.price")) / F.col("price"))
    legs = legs.where((F.col("low.t") - F.col("t") >= min_bars) & F.col("drop").between(min_drop, max_drop))
    back = range(need - 1)
    shrink = [F.lag("drop", k + 1).over(w) > (F.lag("drop", k).over(w) if k else F.col("drop")) for k in back]
    above = [(F.lag("low.price", k).over(w) if k else F.col("low.price")) > F.lag("low.price", need - 1).over(w) for k in back]
    valid = F.lit(True)
    for test in [*shrink, *above]:
        valid = valid & test
    return legs.select("symbol", F.col("date").alias("high_date"), F.col("price").alias("high"), F.col("low.date").alias("low_date"), F.col("low.price").alias("low"), "drop", F.coalesce(valid, F.lit(False)).alias("valid"))


def tight_contractions(legs: DataFrame, need: int, less: float, rise: float, last: float) -> DataFrame:
    """``legs`` of :func:`contractions` with another ``valid``: of the last
    ``need`` each drop is under the one before by more than ``less``, each low
    over the one before by more than ``rise``, and the last drop is at most ``last``."""
    w = Window.partitionBy("symbol").orderBy("high_date")
    at = lambda c, k: F.lag(c, k).over(w) if k else F.col(c)
    valid = F.col("drop") <= last
    for k in range(need - 1):
        valid &= (at("drop", k + 1) > at("drop", k) + less) & (at("low", k) - at("low", k + 1) > rise)
    return legs.withColumn("valid", F.coalesce(valid, F.lit(False)))
