"""Totals of calendar periods that are told of while they are still open, and once
more when they close: a stateful processor with a timer a period."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COLUMNS = ["key", "period_end", "n", "total", "state"]


@contextlib.contextmanager
def state_in_files(spark: SparkSession) -> Iterator[None]:
    """Timers need the state store that keeps its state in files; the session's
    own choice is set again afterwards."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


class Periods(StatefulProcessor):
    """State: count and sum of each open period of a key, by its end in seconds.
    A period costs two numbers until it closes, however many rows it has."""

    def __init__(self, recent: int):
        self.recent = recent

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "period long", "n long, total double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new: dict[int, tuple[int, float]] = {}
        for part in rows:
            for end, values in part.groupby("period")["value"]:
                n, total = new.get(int(end), (0, 0.0))
                new[int(end)] = n + len(values), total + float(values.sum())
        told = []
        for end, (n, total) in sorted(new.items()):
            if self.open.containsKey((end,)):
                m, before = self.open.getValue((end,))
                n, total = n + m, total + before
            else:
                self.handle.registerTimer(1000 * end)
            self.open.updateValue((end,), (n, total))
            told.append((key[0], end, n, total, "open"))
        if told:
            yield pd.DataFrame(told, columns=COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        end = expiredTimerInfo.getExpiryTimeInMs() // 1000
        n, total = self.open.getValue((end,))
        self.open.removeKey((end,))
        late = timerValues.getCurrentWatermarkInMs() // 1000 - end
        yield pd.DataFrame([(key[0], end, n, total, "closed" if late <= self.recent else "stale")], columns=COLUMNS)

    def close(self) -> None:
        pass


def period_totals(stream: DataFrame, key: str, value: str, days: int, late: str, recent_days: float) -> DataFrame:
    """key, period_end (seconds), n, total and state of periods of ``days`` days:
    a row that is ``open``, with what there is so far, whenever rows of the period
    come in; one that is ``closed`` when the watermark, ``late`` behind the newest
    row, passes its end; ``stale`` instead if it had passed that by more than
    ``recent_days``, so that old news is not told as new. Rows behind the watermark
    are dropped; rows without a time, and null values, take no part."""
    length = days * 86400
    period = (F.floor(F.col("ts").cast("double") / length).cast("long") + 1) * length
    rows = stream.where(F.col("ts").isNotNull() & F.col(value).isNotNull()).select(F.col(key).cast("string").alias("key"), "ts", F.col(value).cast("double").alias("value"), period.alias("period"))
    marked = rows.withWatermark("ts", late)
    return marked.groupBy("key").transformWithStateInPandas(Periods(int(recent_days * 86400)), "key string, period_end long, n long, total double, state string", "append", "eventTime")
