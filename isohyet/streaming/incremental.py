"""Incremental variants on event streams, with bounded state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, files: str = "events.parquet", per_trigger: int | None = 1) -> DataFrame:
    """Parquet files as a stream, ``per_trigger`` to a batch (None: all that are
    there); ts is an instant in the session's zone."""
    schema = spark.read.parquet(f"{folder}/{files}").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", files if "." in files else "*")
    stream = (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(stream: DataFrame, width: str, late: str) -> DataFrame:
    """Counts and means of windows; a window closes ``late`` after its end."""
    g = stream.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return g.agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("window.start").alias("start"), "event_type", "n", "mean")


def sliding(stream: DataFrame, width: str, step: str, late: str) -> DataFrame:
    g = stream.withWatermark("ts", late).groupBy(F.window("ts", width, step), "event_type")
    return g.agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def user_sessions(stream: DataFrame, gap: str, late: str) -> DataFrame:
    g = stream.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap))
    return g.agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


def notify_once(stream: DataFrame, keys: list[str], late: str, groups: int = 1024) -> DataFrame:
    """One event of each key: the first by time, then id, of the batch that first
    has the key. Events that arrive in a later batch are not told of, even if they
    are older. A key is forgotten ``late`` after its last event, and told of again
    from then on. Keys are dealt to ``groups`` by their hash; the state of a group,
    kept in the checkpoint, is its keys and when each is forgotten. A worker holds
    these and a row a key, not the rows of the batch. ``groups`` must stay as it is
    for a checkpoint."""
    from pyspark.sql.streaming.state import GroupStateTimeout
    from pyspark.sql.types import IntegralType, StringType, StructField, StructType

    wait = int(pd.Timedelta(late).total_seconds() * 1000)
    told = [f.name for f in stream.schema]

    def first(group: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        known, mark = dict(zip(*state.get, strict=True)) if state.exists else {}, state.getCurrentWatermarkMs()
        rows = last = None
        for f in () if state.hasTimedOut else frames:
            at = f.groupby("_key")["_at"].max()
            last = at if last is None else pd.concat([last, at]).groupby(level=0).max()
            f = f if rows is None else pd.concat([rows, f], ignore_index=True)
            order = f[["_key", "_at", "_id"]].sort_values(["_at", "_id"]).drop_duplicates("_key").index
            rows = f.loc[order].reset_index(drop=True)
        new = {}
        if rows is not None:
            fresh = rows.loc[~rows["_key"].isin(known.keys()), told]
            if len(fresh):
                yield fresh
            until = (last // 1000).fillna(mark).clip(lower=mark).astype("int64") + wait
            new = dict(zip(until.index.tolist(), until.tolist(), strict=True))
        known = {k: t for k, t in known.items() if t >= mark} | new
        if known:
            state.update((list(known), list(known.values())))
            state.setTimeoutTimestamp(min(known.values()))
        elif state.exists:
            state.remove()

    # Whole numbers go as strings: pandas makes a column with a null one of floats.
    as_text = [F.col(f.name).cast("string").alias(f.name) if isinstance(f.dataType, IntegralType) else F.col(f.name) for f in stream.schema]
    out = StructType([StructField(f.name, StringType() if isinstance(f.dataType, IntegralType) else f.dataType) for f in stream.schema])
    key = F.to_json(F.array(*[F.col(k).cast("string") for k in keys])).alias("_key")
    group = F.pmod(F.xxhash64(*keys), F.lit(groups)).cast("int").alias("_group")
    rows = stream.withWatermark("ts", late).select(*as_text, key, F.unix_micros("ts").alias("_at"), F.col("event_id").alias("_id"), group)
    first_rows = rows.groupBy("_group").applyInPandasWithState(first, out, "keys array<string>, until array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)
    return first_rows.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in stream.schema])


def last_target(stream: DataFrame, band: float, write: int = 100_000) -> DataFrame:
    """Targets by key that follow a value only when it moves by ``band``. The
    state is one number a key and survives restarts in the checkpoint. Of a batch
    a worker holds three numbers a row of the key, and ``write`` rows of results."""

    def follow(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = state.get[0] if state.exists else None
        parts = [(f["ts"].to_numpy("datetime64[us]"), f["event_id"].to_numpy("int64"), f["value"].to_numpy("float64")) for f in frames]
        ts, ids, values = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        order = np.lexsort((ids, ts))
        for at in range(0, len(order), write):
            some, targets, moves = order[at : at + write], [], []
            for v in values[some].tolist():
                moved = held is None or abs(v - held) >= band
                held = v if moved else held
                targets.append(held)
                moves.append(moved)
            yield pd.DataFrame({"event_type": key[0], "event_id": ids[some], "target": targets, "moved": moves})
        state.update((held,))

    from pyspark.sql.streaming.state import GroupStateTimeout

    rows = stream.select("event_type", "event_id", "ts", "value")
    return rows.groupBy("event_type").applyInPandasWithState(follow, "event_type string, event_id long, target double, moved boolean", "target double", "append", GroupStateTimeout.NoTimeout)


def run_once(result: DataFrame, target: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Takes all that is there, writes Parquet, stops; started again with the
    same checkpoint it takes only what is new."""
    spark = result.sparkSession
    query = result.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(target)
