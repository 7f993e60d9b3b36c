"""Session helpers."""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def reachable(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package where it is not installed and
    the driver found it by its working folder. On a cluster, install it or send
    it with --py-files; then this changes nothing."""
    root = str(Path(__file__).resolve().parent.parent)
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{known}:{root}".strip(":")
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``);
    a temporary one only where none is named and Spark is local, as in tests."""
    sc = spark.sparkContext
    place = sc._jsc.sc().getCheckpointDir()
    if place.isDefined():
        return place.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="isohyet-"))
    return sc._jsc.sc().getCheckpointDir().get()


def shared(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder, its lineage cut."""
    shared_root(df.sparkSession)
    return df.checkpoint()
