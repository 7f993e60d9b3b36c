"""Reading and writing of tables: partitioned Parquet, increments, state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.frames import increment
from ..session import shared


def save(df: DataFrame, path: str, by: Sequence[str] = (), mode: str = "overwrite", units: dict[str, str] | None = None) -> None:
    """Parquet, partitioned by columns; units are kept as column metadata."""
    for name, unit in (units or {}).items():
        df = df.withMetadata(name, {"units": unit})
    writer = df.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def units(df: DataFrame) -> dict[str, str]:
    """Units that columns were saved with."""
    return {f.name: f.metadata["units"] for f in df.schema.fields if "units" in f.metadata}


def save_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).csv(path, header=True, encoding="UTF-8")


def save_report(frames: dict[str, DataFrame], path: str) -> None:
    """Several tables, one folder each."""
    for name, df in frames.items():
        save(df, f"{path}/{name}")


def append_increment(spark: SparkSession, path: str, new: DataFrame, keys: Sequence[str], time: str, part: str) -> None:
    """Adds new rows to a table partitioned by ``part`` and rewrites only the
    partitions that they touch. Of equal keys and times the new row counts."""
    touched = new.select(part).distinct()
    stored = spark.read.parquet(path).join(touched, part, "left_semi")
    out = increment(stored, new, keys, time)
    # The option of this write alone; no setting of the session changes.
    shared(out).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)


def not_done(todo: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What a resumed batch still has to do."""
    return todo.join(done.select(*keys).distinct(), list(keys), "left_anti")


def parameter_key(*columns: str):
    """Digest of parameters, as the key of stored results."""
    return F.md5(F.to_json(F.struct(*columns)))
