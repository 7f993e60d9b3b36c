"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import reachable

#: Separators of the words `[^\x20\x09-\x0D]+`.
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return reachable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often and
    in whatever lambda ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def split_words(text: Column) -> Column:
    """Words `[^\x20\x09-\x0D]+` of a text, in order; none for a null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def lower_ascii(text: Column) -> Column:
    """A-Z to lower case, nothing else. The built-in ``lower`` does the same
    to a text without other letters, and is far cheaper than ``translate``."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def id_remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def small_or_shuffled(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows, else
    as it is, so that the join shuffles. ``df`` must be narrow."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).
    Only where none is set and Spark is local, as in tests, a temporary one is
    made and set; a cluster must name one."""
    sc = spark.sparkContext
    place = sc._jsc.sc().getCheckpointDir()
    if place.isDefined():
        return place.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="isohyet-"))
    return sc._jsc.sc().getCheckpointDir().get()


def give_back() -> None:
    """Returns to the system what this Python worker still holds of the tasks
    that it ran before: garbage, Arrow's pool, and the heap's free pages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder, its lineage cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
