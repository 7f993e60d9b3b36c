"""Signals, position folds and performance of parameter sweeps."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import physics
from .windows import Ordered


def trend_signal(gap: Column, before: Column, threshold: Column) -> Column:
    """1 if the gap rises and is above the threshold, -1 whenever it does not
    rise, else 0; 0 also while there is no threshold."""
    rises = gap > before
    return F.when(threshold.isNull(), 0).when(rises & (gap > threshold), 1).when(~F.coalesce(rises, F.lit(False)), -1).otherwise(0)


def target_position(signal: Column, weight: Column) -> Column:
    return physics.clip((0.5 + 0.3 * signal) * weight, 0.0, 1.0)


def band_hysteresis(df: DataFrame, by: Sequence[str], order: str, target: str, band: str, name: str = "position") -> DataFrame:
    """Positions that follow a target only when it moves by the band or more: a
    fold over each entity's targets in order, one pass of a function an entity."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        out, held = [], None
        for t, b in zip(pdf[target].tolist(), pdf[band].tolist(), strict=True):
            held = t if held is None or abs(t - held) >= b else held
            out.append(held)
        return pdf.assign(**{name: out})

    return df.groupBy(*by).applyInPandas(follow, schema)


def performance(df: DataFrame, by: Sequence[str], order: str, ret: str, periods: int) -> DataFrame:
    """Total and annual return, volatility, Sharpe ratio, deepest drawdown and
    Calmar ratio of each group's returns."""
    s = Ordered(by, [order])
    rows = df.withColumn("_e", s.cumulative_return(ret))
    rows = rows.withColumn("_d", F.col("_e") / F.greatest(F.lit(1.0), s.cumulative(F.max("_e"))) - 1)
    g = rows.groupBy(*by).agg(F.count(ret).alias("n"), F.exp(F.sum(F.log1p(F.col(ret)))).alias("_t"), F.stddev_samp(ret).alias("_s"), F.avg(ret).alias("_m"), F.min("_d").alias("max_drawdown"))
    annual = F.pow("_t", periods / F.col("n")) - 1
    g = g.withColumns({"total_return": F.col("_t") - 1, "annual_return": annual, "volatility": F.col("_s") * periods**0.5, "sharpe": F.try_divide(F.col("_m") * periods, F.col("_s") * periods**0.5)})
    return g.withColumn("calmar", F.try_divide(F.col("annual_return"), -F.col("max_drawdown"))).drop("_t", "_s", "_m")
