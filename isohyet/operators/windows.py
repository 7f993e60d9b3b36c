"""Rolling, lagged, cumulative and run-based operators over ordered panels.

An :class:`Ordered` names the entity columns and a total order. Its methods
return Columns, so several of them in one ``select`` share one shuffle and one
sort. Rolling results are null until ``min_periods`` non-null values are in the
frame; Spark alone would return partial results there.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNBOUNDED = Window.unboundedPreceding


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


@dataclass(frozen=True)
class Ordered:
    by: Sequence[str]
    order: Sequence[str]

    def spec(self) -> WindowSpec:
        return Window.partitionBy(*self.by).orderBy(*self.order)

    def rows(self, start: int, end: int = 0) -> WindowSpec:
        return self.spec().rowsBetween(start, end)

    def guarded(self, agg: Column, value: str | Column, frame: WindowSpec, min_periods: int) -> Column:
        return F.when(F.count(_col(value)).over(frame) >= min_periods, agg.over(frame))

    # rolling, ending in the current row
    def rolling(self, fn, value: str | Column, n: int, min_periods: int | None = None) -> Column:
        return self.guarded(fn(_col(value)), value, self.rows(1 - n), n if min_periods is None else min_periods)

    def mean(self, value: str | Column, n: int, min_periods: int | None = None) -> Column:
        return self.rolling(F.avg, value, n, min_periods)

    def std(self, value: str | Column, n: int, min_periods: int | None = None, ddof: int = 1) -> Column:
        return self.rolling(F.stddev_samp if ddof else F.stddev_pop, value, n, min_periods)

    def sum(self, value: str | Column, n: int, min_periods: int | None = None) -> Column:
        return self.rolling(F.sum, value, n, min_periods)

    def max(self, value: str | Column, n: int, min_periods: int | None = None) -> Column:
        return self.rolling(F.max, value, n, min_periods)

    def min(self, value: str | Column, n: int, min_periods: int | None = None) -> Column:
        return self.rolling(F.min, value, n, min_periods)

    def slope(self, value: str | Column, n: int, position: str | Column) -> Column:
        """Least-squares slope per row; ``position`` is the row number."""
        return self.guarded(F.regr_slope(_col(value), _col(position)), value, self.rows(1 - n), n)

    def quantile_before(self, value: str | Column, q: float, n: int, min_periods: int) -> Column:
        """Linear quantile of the ``n`` rows before the current one."""
        return self.guarded(F.percentile(_col(value), F.lit(q)), value, self.rows(-n, -1), min_periods)

    def range_position(self, value: str | Column, n: int) -> Column:
        low, high = self.min(value, n), self.max(value, n)
        return F.try_divide(_col(value) - low, high - low)

    # centred
    def centred_mean(self, value: str | Column, n: int, min_periods: int) -> Column:
        """An even ``n`` reaches one row further back than forward."""
        return self.guarded(F.avg(_col(value)), value, self.rows(-(n // 2), (n - 1) // 2), min_periods)

    def convolved(self, value: str | Column, n: int) -> Column:
        """Moving average with zeros beyond the ends (odd ``n``)."""
        return F.sum(_col(value)).over(self.rows(-(n // 2), n // 2)) / n

    def is_swing(self, value: str | Column, half: int, high: bool = True) -> Column:
        fn = F.max if high else F.min
        return _col(value) == fn(_col(value)).over(self.rows(-half, half))

    def weighted(self, value: str | Column, weights: Sequence[float]) -> Column:
        """Centred weighted mean; null where a neighbour is missing."""
        k = len(weights) // 2
        near = [F.lag(_col(value), k - i).over(self.spec()) * w for i, w in enumerate(weights)]
        return sum(near[1:], near[0]) / sum(weights)

    # shifts and changes
    def lag(self, value: str | Column, k: int = 1) -> Column:
        return F.lag(_col(value), k).over(self.spec()) if k >= 0 else F.lead(_col(value), -k).over(self.spec())

    def change(self, value: str | Column, k: int = 1) -> Column:
        return _col(value) - self.lag(value, k)

    def pct_change(self, value: str | Column, k: int = 1) -> Column:
        return F.try_divide(_col(value), self.lag(value, k)) - 1

    def ffill(self, value: str | Column) -> Column:
        return F.last(_col(value), ignorenulls=True).over(self.rows(UNBOUNDED))

    def bfill(self, value: str | Column) -> Column:
        return F.first(_col(value), ignorenulls=True).over(self.rows(0, Window.unboundedFollowing))

    # cumulative
    def cumulative(self, agg: Column) -> Column:
        return agg.over(self.rows(UNBOUNDED))

    def cumulative_return(self, r: str | Column) -> Column:
        return F.exp(F.sum(F.log1p(_col(r))).over(self.rows(UNBOUNDED)))

    def drawdown(self, value: str | Column) -> Column:
        return _col(value) / F.max(_col(value)).over(self.rows(UNBOUNDED)) - 1

    # events
    def crossed(self, a: str | Column, b: str | Column, up: bool = True) -> Column:
        now, before = _col(a) - _col(b), self.lag(_col(a) - _col(b))
        return F.coalesce((now > 0) & (before <= 0) if up else (now < 0) & (before >= 0), F.lit(False))

    def any_within(self, flag: str | Column, n: int) -> Column:
        return F.max(_col(flag).cast("int")).over(self.rows(1 - n)) == 1

    def breaks_out(self, value: str | Column, n: int) -> Column:
        before = self.rows(-n, -1)
        return F.coalesce(_col(value) > self.guarded(F.max(_col(value)), value, before, n), F.lit(False))

    def run_id(self, flag: str | Column) -> Column:
        """Number of the run of equal flags that a row is in."""
        first = F.coalesce((~_col(flag).eqNullSafe(self.lag(flag))).cast("int"), F.lit(1))
        return F.sum(first).over(self.rows(UNBOUNDED))


def ranked_pct(df: DataFrame, group: Sequence[str], value: str, name: str) -> DataFrame:
    """Percent rank within a group, ties averaged, nulls at the bottom."""
    w = Window.partitionBy(*group)
    less = F.rank().over(w.orderBy(F.col(value).asc_nulls_last())) - 1
    ties = F.count("*").over(Window.partitionBy(*group, value))
    return df.withColumn(name, (less + 1 + (ties - 1) / 2) / F.count("*").over(w))


def rank_of_last(x: np.ndarray, n: int, least: int, block: int = 4096) -> np.ndarray:
    """Share of the ``n`` values up to each that are at or below it, ties
    averaged; where it is missing, the last known one of the frame is ranked. No
    rank where the frame has fewer than ``least`` known values."""
    x = np.asarray(x, float)
    if not len(x):
        return x
    last = pd.Series(x).ffill(limit=n - 1).to_numpy() if n > 1 else x
    frames = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(n - 1, np.nan), x]), n)
    out = np.full(len(x), np.nan)
    for at in range(0, len(x), block):
        frame, now = frames[at : at + block], last[at : at + block, None]
        held = (~np.isnan(frame)).sum(1)
        rank = ((frame < now).sum(1) + ((frame == now).sum(1) + 1) / 2) / np.maximum(held, 1)
        out[at : at + block] = np.where(held >= max(least, 1), rank, np.nan)
    return out


def ewms(df: DataFrame, by: Sequence[str], order: Sequence[str], means: Sequence[tuple[str, str, float, int]], ranks: Sequence[tuple[str, str, int, int]] = ()) -> DataFrame:
    """Exponentially weighted means with ``adjust=False``, seeded by the first
    non-null value: for each (name, value, alpha, min_periods) a column, which
    later ones may have as their value; then for each (name, value, n, least) of
    ``ranks`` the rank of the last of ``n`` rows. One pass of a function an entity
    for all of them; an entity's series must fit a task."""
    schema = T.StructType([*df.schema.fields, *[T.StructField(name, T.DoubleType()) for name, *_ in (*means, *ranks)]])

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(order), kind="stable")
        for name, value, alpha, least in means:
            pdf[name] = pdf[value].astype(float).ewm(alpha=alpha, adjust=False, ignore_na=True, min_periods=least).mean()
        for name, value, n, least in ranks:
            pdf[name] = rank_of_last(pdf[value].astype(float).to_numpy(), n, least)
        return pdf

    return df.groupBy(*by).applyInPandas(each, schema)


def ranked_last(df: DataFrame, by: Sequence[str], order: Sequence[str], ranks: Sequence[tuple[str, str, int, int]]) -> DataFrame:
    """For each (name, value, n, least) the rank of the last of ``n`` rows, see
    :func:`rank_of_last`."""
    return ewms(df, by, order, (), ranks)


def ewm(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, alpha: float, name: str, min_periods: int = 1) -> DataFrame:
    return ewms(df, by, order, [(name, value, alpha, min_periods)])


def islands(df: DataFrame, by: Sequence[str], order: str, flag: str | Column, min_length: int = 1) -> DataFrame:
    """Runs of rows where ``flag`` holds: first and last ``order``, length."""
    s = Ordered(by, [order])
    rows = df.withColumn("_flag", _col(flag)).withColumn("_run", s.run_id("_flag")).where("_flag")
    return rows.groupBy(*by, "_run").agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("length")).where(F.col("length") >= min_length).drop("_run")


def merged_intervals(df: DataFrame, by: Sequence[str], start: str, end: str) -> DataFrame:
    """Unions of overlapping or touching intervals."""
    w = Window.partitionBy(*by).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(UNBOUNDED, -1))
    rows = df.withColumn("_new", F.coalesce((F.col(start) > before).cast("int"), F.lit(1))).withColumn("_island", F.sum("_new").over(w.rowsBetween(UNBOUNDED, 0)))
    return rows.groupBy(*by, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("_island")


def interpolated(df: DataFrame, by: Sequence[str], order: str, value: str, name: str, limit: int | None = None) -> DataFrame:
    """Linear interpolation inside gaps, by ``order`` (numeric). With a limit
    only the first ``limit`` rows of a gap are filled."""
    s = Ordered(by, [order])
    at = F.when(F.col(value).isNotNull(), F.col(order))
    df = df.withColumns({"_x0": s.ffill(at), "_x1": s.bfill(at), "_y0": s.ffill(value), "_y1": s.bfill(value)})
    inside = F.col("_y0") + (F.col("_y1") - F.col("_y0")) * F.try_divide(F.col(order) - F.col("_x0"), F.col("_x1") - F.col("_x0"))
    if limit is not None:
        nth = F.row_number().over(Window.partitionBy(*by, "_x0").orderBy(order)) - 1  # the known row is the 0th
        inside = F.when(nth <= limit, inside)
    return df.withColumn(name, F.coalesce(F.col(value), inside)).drop("_x0", "_x1", "_y0", "_y1")
