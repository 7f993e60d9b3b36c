"""Sharding by global byte-size prefix sums (law ``bytes``).

Rows are put in order of id by a range partitioning, each partition's bytes and
rows are totalled, the running sum of those totals (one row a partition) gives
every partition its global offset, and with the running sum inside it every row
knows the bytes before it in the whole table. The sequence is cut at equal
targets: a row goes to the shard in which its middle byte falls. Shards are
contiguous in id order and their sizes differ by at most about one text.

Only DataFrame functions run, and only (id, size, checksum) is shuffled, never
a text. The order is total: ties of an id are ordered by checksum, size and
place in the input, so a hot id or repeated rows are split over partitions like
any others. Copies of a text are ordinary rows: the law is equal sizes.

Defined cases: a null text has size 1 and checksum 0; null ids come first;
repeated rows get a slot each; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, table

SHARDS = 8


def with_prefix_sums(rows: DataFrame, order: list[str], size: str) -> DataFrame:
    """``rows`` plus ``before`` (sum of ``size`` over all earlier rows of the
    table), ``row`` (their number) and ``total`` (the whole sum). ``order``
    must be unique."""
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # Written once, so that both uses below see one and the same partitioning.
    placed = checkpointed(rows.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()))
    parts = placed.groupBy("part").agg(F.sum(size).alias("part_size"), F.count("*").alias("part_rows"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        "part",
        F.coalesce(F.sum("part_size").over(earlier), F.lit(0)).alias("size_offset"),
        F.coalesce(F.sum("part_rows").over(earlier), F.lit(0)).alias("row_offset"),
        F.sum("part_size").over(Window.partitionBy()).alias("total"),
    )
    inside = Window.partitionBy("part").orderBy(*order)
    local = placed.withColumn("upto", F.sum(size).over(inside.rowsBetween(Window.unboundedPreceding, 0))).withColumn("nth", F.row_number().over(inside))
    # offsets has one row a partition: the bound of this broadcast.
    out = local.join(F.broadcast(offsets), "part")
    return out.withColumn("before", F.col("size_offset") + F.col("upto") - F.col(size)).withColumn("row", F.col("row_offset") + F.col("nth") - 1).drop("part", "size_offset", "row_offset", "upto", "nth")


def assign_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row of ``docs``."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.monotonically_increasing_id().alias("place"))
    rows = with_prefix_sums(rows, ["doc_id", "text_crc32", "size", "place"], "size")
    cut = F.expr(f"((2 * before + size) * {shards}) div (2 * total)")
    rows = rows.withColumn("shard", F.least(F.lit(shards - 1), cut).cast("int"))
    first = rows.groupBy("shard").agg(F.min("row").alias("first_row"))  # one row a shard
    return rows.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("first_row")).alias("slot"))


def op6_prefix_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = assign_shards(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
