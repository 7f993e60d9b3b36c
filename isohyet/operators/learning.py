"""Validation, resampling, patterns and regressions on feature tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared
from .inference import draw

if TYPE_CHECKING:
    import pandas as pd


def leave_one_out(df: DataFrame, by: Sequence[str], key: str, x: str, y: str) -> DataFrame:
    """Error of a line fitted without each row in turn, and of the mean. The
    fit without a row follows from the group's sums less the row's own."""
    w = Window.partitionBy(*by)
    own = {"n": F.lit(1.0), "x": F.col(x), "y": F.col(y), "xx": F.col(x) * F.col(x), "xy": F.col(x) * F.col(y)}
    # Centred first: sums of squares of large values would lose the digits.
    df = df.withColumns({x: F.col(x) - F.avg(x).over(w), "_ym": F.avg(y).over(w)}).withColumn(y, F.col(y) - F.col("_ym"))
    rest = {k: F.sum(v).over(w) - v for k, v in own.items()}
    slope = F.try_divide(rest["n"] * rest["xy"] - rest["x"] * rest["y"], rest["n"] * rest["xx"] - rest["x"] * rest["x"])
    rows = df.withColumns({"_k": slope, "_mx": rest["x"] / rest["n"], "_my": rest["y"] / rest["n"]})
    guess = F.col("_my") + F.col("_k") * (F.col(x) - F.col("_mx"))
    rmse = lambda e: F.sqrt(F.avg(e * e))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), rmse(F.col(y) - guess).alias("rmse"), rmse(F.col(y) - F.col("_my")).alias("rmse_mean"))


def bootstrap_mean(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, draws: int, level: float) -> DataFrame:
    """Percentile interval of the mean. The row that place k of sample b takes is
    by a hash of both, so that a lost task repeats the same draws. Samples are
    rows that meet the numbered rows of their group: no group is gathered."""
    w = Window.partitionBy(*by)
    rows = shared(df.select(*by, (F.row_number().over(w.orderBy(*order)) - 1).cast("long").alias("_at"), F.count("*").over(w).alias("_n"), F.col(value).cast("double").alias("_v")))
    whole = rows.groupBy(*by).agg(F.max("_n").alias("n"), F.avg("_v").alias("mean"))
    places = whole.select(*by, "n", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("_b")).withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    places = places.select(*by, "_b", draw(F.col("_k"), F.col("_b"), F.col("n")).alias("_at"))
    stars = places.join(rows, [*by, "_at"]).groupBy(*by, "_b").agg(F.avg("_v").alias("_star"))
    stars = stars.groupBy(*by).agg(F.sort_array(F.collect_list("_star")).alias("_m"))  # one number a draw
    at = lambda q: F.get("_m", F.lit(min(draws - 1, int(q * draws))))
    return whole.join(stars, list(by)).select(*by, "n", "mean", at((1 - level) / 2).alias("low"), at(1 - (1 - level) / 2).alias("high"))


def leading_patterns(df: DataFrame, cell: Sequence[str], time: str, value: str, weight: Column, k: int) -> DataFrame:
    """Leading empirical orthogonal functions of weighted anomalies: a row for
    each time and component, with its score and share of variance. The sign is
    fixed by the score of largest size being positive. A cell adds nothing to
    times that it lacks.

    Each task multiplies blocks of its cells' series and hands on one product of
    times by times; their sum is solved at once, whatever the number of cells.
    """
    import numpy as np
    import pandas as pd

    w = Window.partitionBy(*cell)
    rows = df.select(*cell, F.col(time).cast("int").alias("t"), ((F.col(value) - F.avg(value).over(w)) * weight).cast("double").alias("a")).where("t is not null and a is not null")
    series = rows.groupBy(*cell).agg(F.collect_list(F.struct("t", "a")).alias("s")).select("s")

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        times, total = np.empty(0, int), np.zeros((0, 0))
        for pdf in batches:
            if pdf.empty:
                continue
            size = pdf["s"].map(len).to_numpy()
            flat = pd.DataFrame([tuple(r.values()) for s in pdf["s"] for r in s], columns=["t", "a"])
            wider = np.union1d(times, flat["t"].to_numpy(int))
            block, old = np.zeros((len(pdf), len(wider))), np.searchsorted(wider, times)
            np.add.at(block, (np.repeat(np.arange(len(pdf)), size), np.searchsorted(wider, flat["t"])), flat["a"].to_numpy(float))
            grown = block.T @ block
            grown[np.ix_(old, old)] += total
            times, total = wider, grown
        for i, t in enumerate(times):
            yield pd.DataFrame({"t": t, "u": times, "c": total[i]})

    cov = series.mapInPandas(products, "t int, u int, c double").groupBy("t", "u").agg(F.sum("c").alias("c"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot(index="t", columns="u", values="c").fillna(0.0).sort_index().sort_index(axis=1)
        values, vectors = np.linalg.eigh(m.to_numpy())
        out = []
        for i in range(min(k, len(values))):
            v = vectors[:, -1 - i] * np.sqrt(max(0.0, values[-1 - i]))
            v = v * (np.sign(v[np.argmax(np.abs(v))]) or 1.0)
            out.append(pd.DataFrame({"mode": i + 1, "t": m.index, "score": v, "share": values[-1 - i] / values.sum()}))
        return pd.concat(out)

    return cov.withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(solve, "mode int, t int, score double, share double")


def linear_predictions(df: DataFrame, features: Sequence[str], y: str, time: str, split: int, strength: float, mix: float) -> DataFrame:
    """Ridge (mix 0) to lasso (mix 1) regression, fitted before ``split`` and
    applied from it on; scaling is learned on the fitted rows alone."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.regression import LinearRegression

    steps = [VectorAssembler(inputCols=list(features), outputCol="_f"), StandardScaler(inputCol="_f", outputCol="_z", withMean=True), LinearRegression(featuresCol="_z", labelCol=y, regParam=strength, elasticNetParam=mix, standardization=False)]
    model = Pipeline(stages=steps).fit(df.where(F.col(time) < split))
    return model.transform(df.where(F.col(time) >= split)).select(*[c for c in df.columns if c not in features], F.round("prediction", 6).alias("prediction"))
