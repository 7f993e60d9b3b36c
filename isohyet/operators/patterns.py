"""Price patterns that a bar may use only once they are known: contractions
between centred swings, their pivots, and breakouts over those.

Bars have ``symbol``, ``t`` (1, 2, ... without gaps), ``high``, ``low``, ``close``,
``volume``. Everything is window frames that grow by a row at a time, so work is
linear in the bars, however far back a flag looks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .market import true_range
from .windows import Ordered

S = Ordered(["symbol"], ["t"])


def confirmed_swings(bars: DataFrame, window: int = 5) -> DataFrame:
    """``bars`` with swing_high and swing_low: the price of a bar that is the
    extreme of ``window`` bars around it, on the bar half a window later, which is
    the first to know; null elsewhere. Equal extremes are swings each."""
    half = window // 2
    for name, value, fn in (("swing_high", "high", F.max), ("swing_low", "low", F.min)):
        extreme = S.guarded(fn(value), value, S.rows(-half, half), window)
        bars = bars.withColumn(f"_{name}", F.when(F.col(value) == extreme, F.col(value)))
    return bars.withColumns({n: S.lag(f"_{n}", half) for n in ("swing_high", "swing_low")}).drop("_swing_high", "_swing_low")


def legs(swings: DataFrame, min_drop: float, max_drop: float, min_bars: int) -> DataFrame:
    """Drops from a swing high to the first swing low ``min_bars`` or more bars
    later, if no other high is confirmed up to it: symbol, t and price of the high
    (``high_t``, ``high``) and of the low (``low_t``, ``low``), ``drop``."""
    back = Window.partitionBy("symbol").orderBy(F.desc("t"))  # later bars come first
    nearest = lambda value, least: F.last(value, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -least))
    low = nearest(F.when(F.col("swing_low").isNotNull(), F.struct("t", F.col("swing_low").alias("price"))), min_bars)
    following = nearest(F.when(F.col("swing_high").isNotNull(), F.col("t")), 1)
    found = swings.withColumns({"_low": low, "_next": following}).where(F.col("swing_high").isNotNull() & F.col("_low").isNotNull() & (F.col("_next").isNull() | (F.col("_low.t") < F.col("_next"))))
    found = found.select("symbol", F.col("t").alias("high_t"), F.col("swing_high").alias("high"), F.col("_low.t").alias("low_t"), F.col("_low.price").alias("low"))
    found = found.where("high > low").withColumn("drop", (F.col("high") - F.col("low")) / F.col("high"))
    return found.where(F.col("drop").between(min_drop, max_drop))


def contraction_flags(bars: DataFrame, window: int = 5, lookback: int = 120, min_drop: float = 0.03, max_drop: float = 0.4, min_bars: int = 5, need: int = 3, less: float = 0.0, rise: tuple[str, float] = ("abs", 0.0), atr_bars: int = 20, last: float | None = None) -> DataFrame:
    """``bars`` with vcp_ok and pivot, the price of the last high, as known on each
    bar: of the legs within the last ``lookback`` bars the last ``need`` must
    shrink by more than ``less`` each, and their lows rise by more than a tolerance:
    ``rise`` in price ("abs"), as a share of the low before ("pct"), or in mean true
    ranges of ``atr_bars`` at the later low ("atr"; none yet: 0). With ``last`` the
    last drop must be as small.

    A search that begins anew on each window of bars finds just the legs of the
    whole series whose high lies in the window: after the first high in it both
    wait for the same low. So the legs are found once, and a bar looks at the last
    ones that are complete."""
    rows = confirmed_swings(bars, window).withColumn("_atr", S.mean(true_range(S), atr_bars, 1) if rise[0] == "atr" else F.lit(None).cast("double"))
    found = legs(rows, min_drop, max_drop, min_bars)
    if rise[0] == "atr":
        found = found.join(rows.select("symbol", F.col("t").alias("low_t"), "_atr"), ["symbol", "low_t"])
    w = Window.partitionBy("symbol").orderBy("low_t")
    at = lambda c, k: F.lag(c, k).over(w) if k else F.col(c)
    kind, size = rise
    by: dict[str, Column] = {"abs": F.lit(size)}
    good = F.lit(True) if last is None else F.col("drop") <= last
    for k in range(need - 1):
        if kind == "pct":
            by["pct"] = size * at("low", k + 1)
        elif kind == "atr":
            by["atr"] = F.coalesce(size * at("_atr", k), F.lit(0.0))
        good &= (at("drop", k + 1) > at("drop", k) + less) & (at("low", k) - at("low", k + 1) > by[kind])
    found = found.select("symbol", F.col("low_t").alias("t"), F.struct(F.coalesce(good, F.lit(False)).alias("good"), F.col("high").alias("pivot"), F.col("high_t").alias("pivot_t"), at("high_t", need - 1).alias("since")).alias("_leg"))
    rows = bars.join(found, ["symbol", "t"], "left").withColumn("_leg", S.ffill("_leg"))
    ok = F.coalesce(F.col("_leg.good") & (F.col("_leg.since") > F.col("t") - lookback), F.lit(False))
    return rows.withColumn("vcp_ok", ok).withColumns({"pivot": F.when(F.col("vcp_ok"), F.col("_leg.pivot")), "pivot_t": F.when(F.col("vcp_ok"), F.col("_leg.pivot_t"))}).drop("_leg")


def first_breakouts(bars: DataFrame, pivots: DataFrame, ahead: int = 20, volume_factor: float = 1.8, volume_bars: int = 50, least_bars: int = 20, wick: float | None = 0.6) -> DataFrame:
    """The first of the ``ahead`` bars after each pivot (symbol, pivot_t, pivot)
    that closes over it, on ``volume_factor`` times the mean volume of the last
    ``volume_bars`` (``least_bars`` at least), with at most ``wick`` of its range
    above the close: t, close. Pivots without one have no row. The join is on the
    symbol and blocks of ``ahead`` bars, two a pivot."""
    rows = bars.withColumn("_mean", S.mean("volume", volume_bars, least_bars))
    ok = F.col("volume") > volume_factor * F.col("_mean")
    if wick is not None:
        ok &= F.try_divide(F.col("high") - F.col("close"), F.col("high") - F.col("low")) <= wick
    rows = rows.where(ok).select("symbol", "t", "close", F.floor(F.col("t") / ahead).alias("_block"))
    block = F.floor((F.col("pivot_t") + 1) / ahead)
    wanted = pivots.withColumn("_block", F.explode(F.array(block, block + 1)))
    hits = wanted.join(rows, ["symbol", "_block"]).where((F.col("t") > F.col("pivot_t")) & (F.col("t") <= F.col("pivot_t") + ahead) & (F.col("close") > F.col("pivot")))
    first = hits.groupBy("symbol", "pivot_t", "pivot").agg(F.min(F.struct("t", "close")).alias("_first"))
    return first.select("symbol", "pivot_t", "pivot", "_first.t", "_first.close")
