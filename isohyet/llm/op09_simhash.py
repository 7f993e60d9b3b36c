"""Near-duplicates by SimHash fingerprints and multi-index hashing.

Fingerprints are made one partition at a time (numpy on Arrow batches). Texts
with one fingerprint collapse to a class first, so a group of copies of any
size is one row from then on. A class's 64 bits are two segments of 32. Classes
within two bits agree in the low segment, agree in the high one, or differ by
one bit in each; so the classes' segments are the tables, and each class looks
up its own two segments and the ball of radius one around its high segment
(only bits from 0 to 1: the other class of a pair looks up the rest). Every
match is verified on all 64 bits.

A bucket of the tables that many classes share is not joined member by member:
there each class enumerates the other segment's ball as far as the distance
allows and looks up whole fingerprints, at most 529 of them, so that work stays
linear in the bucket.

Links become components by alternating large-star and small-star steps on the
links alone, each written to the shared folder; nothing is gathered on the
driver but two numbers a step.

Defined cases: a null or blank text has fingerprint zero and is linked like any
other; fewer than three words are one shingle; repeated rows give a row each;
component_id is null only if all ids of a component are; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, table

SHINGLE, SEED = 3, 42
#: Classes in a bucket from which on whole fingerprints are looked up.
BIG_BUCKET = 64
LOW = 0xFFFFFFFF


def simhash(text: bytes, width: int = SHINGLE) -> int:
    """Bit by bit the majority of the XXH64 of all shingles of words."""
    words = text.lower().split()  # bytes: A-Z and ASCII white space alone
    if not words:
        return 0
    joined, width = b" ".join(words), min(width, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)], "<u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bounded, however long the text
        counts += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, place: str | None = None) -> DataFrame:
    """doc_id, place (the column of that name, else
    ``monotonically_increasing_id``) and fp, the fingerprint as a signed long, of
    every row."""
    at = F.monotonically_increasing_id() if place is None else F.col(place)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("place"), pa.array([simhash(t.as_py() or b"") for t in texts], pa.int64())], names=["doc_id", "place", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text", at.alias("place")).mapInArrow(each, "doc_id long, place long, fp long")


def _bit(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), n)


def _high(fp: Column) -> Column:
    return F.shiftrightunsigned(fp, 32)


def _pairs_of_bits(offset: int) -> list[int]:
    """Masks that flip none, one or two of the 32 bits from ``offset`` on."""
    one = [1 << (offset + i) for i in range(32)]
    masks = [0, *one, *(a | b for i, a in enumerate(one) for b in one[i + 1 :])]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(classes: DataFrame, distance: int = 2, big: int = BIG_BUCKET) -> DataFrame:
    """Pairs (a, b), a < b, of distinct ``fp`` at ``distance`` (two) bits or
    fewer. ``classes`` has one row a fingerprint."""
    assert distance == 2, "the segments are laid out for two bits"
    fp = F.col("fp")
    high, low = _high(fp), fp.bitwiseAND(LOW)
    segments = F.array(F.struct(F.lit(0).alias("seg"), low.alias("key")), F.struct(F.lit(1).alias("seg"), high.alias("key")))
    stored = classes.select(fp, F.inline(segments))
    flips = F.transform(F.filter(F.sequence(F.lit(0), F.lit(31)), lambda i: high.bitwiseAND(_bit(i)) == 0), lambda i: F.struct(F.lit(1).alias("seg"), high.bitwiseOR(_bit(i)).alias("key")))
    probes = classes.select(fp, high.alias("own"), F.inline(F.concat(segments, flips)))
    buckets = stored.groupBy("seg", "key").count()
    crowded = buckets.where(F.col("count") > big).select("seg", "key")
    a, b = F.col("a"), F.col("b")
    near = F.bit_count(a.bitwiseXOR(b)) <= distance
    same = (F.col("seg") == 0) | (F.col("key") == F.col("own"))
    # Own segments: the smaller of a pair looks up; ball: who has the 0 bit does.
    usual = stored.join(buckets.where((F.col("count") <= big)), ["seg", "key"]).select("seg", "key", F.col("fp").alias("b"))
    found = probes.withColumnRenamed("fp", "a").join(usual, ["seg", "key"]).where(near & (~same | (a < b)) & (a != b))
    found = found.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    # Crowded buckets: the other segment's ball, whole fingerprints looked up.
    at = probes.join(crowded, ["seg", "key"])
    masks = F.when(F.col("seg") == 0, F.array(*map(F.lit, _pairs_of_bits(32)))).otherwise(F.array(*map(F.lit, _pairs_of_bits(0))))
    other = F.array(*[F.lit(1 << i) for i in range(32)])
    target = F.when(same, F.transform(masks, lambda m: fp.bitwiseXOR(m))).otherwise(
        F.transform(other, lambda m: F.call_function("shiftleft", F.col("key"), F.lit(32)).bitwiseOR(low).bitwiseXOR(m))
    )
    whole = at.select(fp.alias("a"), F.explode(target).alias("b")).join(classes.select(fp.alias("b")), "b").where(a != b)
    return found.union(whole.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of an edge reaches."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("m"))
        near = both.join(least, F.col("a") == F.col("node"))
        out = near.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        if not large:
            out = near.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("node").alias("a"), F.col("m").alias("b")))
        return out.where(F.col("a") != F.col("b")).distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = checkpointed(edges)
    before = state(edges)
    while before[0]:
        edges = checkpointed(star(star(edges, large=True), large=False))
        now = state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, place: str | None = None) -> DataFrame:
    """doc_id, place, fp, component (a fingerprint in it) and component_id of
    every row of ``docs``."""
    rows = checkpointed(fingerprints(docs, place))
    classes = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(classes.select("fp")))
    rooted = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.where(F.col("root") != F.col("fp")).groupBy("root").agg(F.min("first_id").alias("other_id"))
    # A class is its own root or one link from it; only roots of several classes
    # have an entry in `least`.
    ids = rooted.join(least, "root", "left").join(classes.select(F.col("fp").alias("root"), F.col("first_id").alias("root_id")), "root")
    ids = checkpointed(ids.select("fp", F.col("root").alias("component"), F.least("first_id", "other_id", "root_id").alias("component_id")))
    return rows.join(ids, "fp").select("doc_id", "place", "fp", "component", "component_id")


def representatives(docs: DataFrame, place: str | None = None) -> DataFrame:
    """place of one row of each component: the smallest id, then place."""
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "place"))["place"]
    return near_duplicates(docs, place).groupBy("component").agg(first.alias("place")).select("place")


def op9_simhash_mih(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
