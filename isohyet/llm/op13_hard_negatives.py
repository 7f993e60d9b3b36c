"""Hard negatives by one-dimensional distance keys (iDistance).

Largest inner products become nearest neighbours: with M the largest norm, a
row x is augmented by sqrt(M^2 - |x|^2), a query q by 0, and the squared distance
is |q|^2 + M^2 - 2 q.x, an integer. Every row belongs to its nearest pivot and is
stored, sorted by (pivot, distance to it), in blocks of ``BLOCK`` rows that know
their interval of distances. By the triangle inequality a row at distance key
from a pivot that is d away from the query is at least |key - d| and at most
key + d away; so a search in growing radii scans the blocks whose key interval
meets the annulus, raises its score bound to that of the k-th best row, and
ends when the radius of that bound has been covered. The first two radii are
those that reach a 64th and an eighth of a sample's keys, if the bound asks for
so much; the third is the bound's own: three joins of blocks with chunks of
queries, whatever the data.

Two searches follow each other: the nearest rows of the query's label, and for
each of their scores the best rows of other labels within the window below it.

Only anchors are queries, and anchors with one label and vector are one query.
Of rows with one label and vector only the smallest ids can appear in a result:
the others are left out of the index by a limit that each task applies before
the shuffle. Pivots are the centres of a bounded sample (``SAMPLE`` rows in the
order of a hash, one driver-side k-means); which they are changes the work, never
the result.

Defined cases: rows with a null id, label or vector, or a null or infinite
component or NaN, take no part; shorter vectors count as if filled with zeros;
rows that repeat id, label and vector are one row; an anchor never finds a row of
its own id; an empty table gives no rows; scores that do not fit a long raise an
error; other columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, shared_dir, table

POSITIVES, NEGATIVES, LOW, HIGH = 5, 5, 80, 100
SCALE = 256
PIVOTS, SAMPLE, ROUNDS = 64, 2048, 8
#: Shares of the sample's keys that the first radii reach.
SHARES = (1 / 64, 1 / 8)
#: Rows of a block and queries of a chunk.
BLOCK, CHUNK = 1024, 256
#: Beyond every score.
FAR = 1 << 62


def quantised(rows: DataFrame, scale: float) -> DataFrame:
    """vec_id, label, vector (32-bit integers floor(scale * x)) and norm2 of the
    rows of ``rows`` (vec_id, label, embedding) that take part."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, norms = [], []
            for x in batch.column("embedding"):
                v = np.floor(scale * x.values.to_numpy(zero_copy_only=False).astype(np.float64)) if x.is_valid and not x.values.null_count else np.array([np.nan])
                if not np.isfinite(v).all():
                    vectors.append(None)
                    norms.append(0)
                    continue
                if len(v) and (np.abs(v).max() >= 1 << 31 or (v * v).sum() >= FAR):
                    raise ValueError("components are too large: scores would not fit a long")
                v = v.astype(np.int64)
                vectors.append(v.astype("<i4").tobytes())
                norms.append(int((v * v).sum()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(vectors, pa.binary()), pa.array(norms, pa.int64())], names=["vec_id", "label", "vector", "norm2"])

    rows = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding").dropna()
    return rows.mapInArrow(each, "vec_id long, label long, vector binary, norm2 long").dropna(subset=["vector"]).distinct()


def matrix(vectors: list[bytes], dims: int, kind: type = np.float64) -> np.ndarray:
    if all(len(v) == 4 * dims for v in vectors):
        return np.frombuffer(b"".join(vectors), "<i4").reshape(len(vectors), dims).astype(kind)
    out = np.zeros((len(vectors), dims), kind)
    for i, v in enumerate(vectors):
        out[i, : len(v) // 4] = np.frombuffer(v, "<i4")
    return out


class Space:
    """Dimensions, largest squared norm and pivots; fits a broadcast."""

    def __init__(self, dims: int, most: int, sample: list[bytes], pivots: int = PIVOTS):
        self.dims, self.most = dims, most
        x = self.augmented(matrix(sample, dims))
        x = x[np.lexsort(x.T)] if len(x) else x
        centres = x[np.linspace(0, len(x) - 1, min(pivots, len(x))).astype(int)] if len(x) else np.zeros((1, dims + 1))
        for _ in range(ROUNDS):
            own = self._squares(x, centres).argmin(axis=1) if len(x) else np.zeros(0, int)
            centres = np.array([x[own == k].mean(axis=0) if (own == k).any() else c for k, c in enumerate(centres)])
        self.centres = np.unique(centres, axis=0)
        near = np.sqrt(self._squares(x, self.centres))
        self.own = near.argmin(axis=1) if len(x) else np.zeros(0, int)
        self.keys = near[np.arange(len(x)), self.own]

    @staticmethod
    def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return np.maximum(0, (x * x).sum(axis=1)[:, None] + (centres * centres).sum(axis=1) - 2 * (x @ centres.T))

    def augmented(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, self.most - (x * x).sum(axis=1)))
        return np.concatenate([x, extra[:, None]], axis=1)

    def distances(self, vectors: list[bytes], query: bool = False) -> np.ndarray:
        return np.sqrt(self._squares(self.augmented(matrix(vectors, self.dims), query), self.centres))

    def reaches(self, d: np.ndarray) -> np.ndarray:
        """For queries at the distances ``d`` from the pivots: the radii within
        which SHARES of the sample may lie."""
        if not len(self.keys) or not len(d):
            return np.zeros((len(d), len(SHARES)))
        return np.quantile(np.abs(d[:, self.own] - self.keys), SHARES, axis=1).T

    def scores(self, rows: list[bytes], queries: list[bytes]) -> np.ndarray:
        """Exact integer inner products, in floats where those are exact."""
        kind = np.float32 if self.most < 1 << 24 else np.float64 if self.most < 1 << 53 else np.int64
        return (matrix(rows, self.dims, kind) @ matrix(queries, self.dims, kind).T).astype(np.int64)


def keyed(rows: DataFrame, space: Space, query: bool) -> DataFrame:
    """``rows`` in the order of (pivot, key), with both; queries also with the
    distances to all pivots and the radii to begin with."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = space.distances(batch.column("vector").to_pylist(), query)
            own = d.argmin(axis=1) if len(d) else np.zeros(0, int)
            columns = [*batch.columns, pa.array(own.astype(np.int32)), pa.array(d[np.arange(len(d)), own])]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(x.tolist(), pa.list_(pa.float64())) for x in (d, space.reaches(d))] if query else [])], names=[*batch.schema.names, "pivot", "key", *(["dists", "radii"] if query else [])])

    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", pivot int, key double" + ", dists array<double>, radii array<double>" * query
    first = rows.columns[0]
    return rows.mapInArrow(each, schema).repartitionByRange("pivot", "key", first).sortWithinPartitions("pivot", "key", first)


def numbered(first: int = 0) -> Iterator[int]:
    """Numbers that no other task of the stage gives."""
    at = (TaskContext.get().partitionId() << 33) + first
    while True:
        yield at
        at += 1


def index(rows: DataFrame, space: Space, size: int = BLOCK) -> DataFrame:
    """Blocks of the rows (vec_id, label, vector), written to the shared folder:
    block, pivot, lo and hi (keys), ids, labels, vectors."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = numbered(), []

        def block(part: list[dict]) -> pa.RecordBatch:
            keys = [r["key"] for r in part]
            row = {"block": next(number), "pivot": part[0]["pivot"], "lo": keys[0], "hi": keys[-1], "ids": [r["vec_id"] for r in part], "labels": [r["label"] for r in part], "vectors": [r["vector"] for r in part]}
            longs = pa.list_(pa.int64())
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([("block", pa.int64()), ("pivot", pa.int32()), ("lo", pa.float64()), ("hi", pa.float64()), ("ids", longs), ("labels", longs), ("vectors", pa.list_(pa.binary()))]))

        for batch in batches:
            for r in batch.to_pylist():
                if held and (len(held) == size or held[-1]["pivot"] != r["pivot"]):
                    yield block(held)
                    held = []
                held.append(r)
        if held:
            yield block(held)

    path = f"{shared_dir(rows.sparkSession)}/distance-keys-{uuid.uuid4().hex}"
    blocks = keyed(rows, space, False).mapInArrow(each, "block long, pivot int, lo double, hi double, ids array<long>, labels array<long>, vectors array<binary>")
    blocks.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def chunked(rows: DataFrame, space: Space, size: int = CHUNK) -> DataFrame:
    """The queries (label, vector, norm2) with a number, and a chunk of at most
    ``size`` neighbours."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = numbered()
        for batch in batches:
            ids = np.array([next(number) for _ in range(batch.num_rows)], np.int64)
            own = (ids >> 33 << 33) + (ids & ((1 << 33) - 1)) // size
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(own), *[batch.column(c) for c in ("label", "vector", "norm2", "dists", "radii")]], names=["query", "chunk", "label", "vector", "norm2", "dists", "radii"])

    return checkpointed(keyed(rows, space, True).mapInArrow(each, "query long, chunk long, label long, vector binary, norm2 long, dists array<double>, radii array<double>"))


def best_of(space: Space, same: bool, k: int):
    """The function that scans (block, chunk) pairs: the k best rows of each
    window (query, window, score, vec_id) of a chunk's searches in a block."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i] for c in batch.schema.names}
                m = {f.name: r["members"].values.field(f.name) for f in r["members"].type.value_type}
                d = m["dists"].flatten().to_numpy().reshape(len(r["members"]), -1)[:, r["pivot"].as_py()]
                lo, hi = r["lo"].as_py(), r["hi"].as_py()
                bound = np.maximum(0.0, np.maximum(lo - d, d - hi))
                use = np.flatnonzero((bound > m["seen"].to_numpy()) & (bound <= m["now"].to_numpy()) & (d + hi >= m["inner"].to_numpy()))
                vectors, wanted = m["vector"].to_pylist(), m["label"].to_pylist()
                lows, highs = m["lows"].to_pylist(), m["highs"].to_pylist()
                ids, labels = r["ids"].values.to_numpy(), r["labels"].values.to_numpy()
                scores = space.scores(r["vectors"].values.to_pylist(), [vectors[j] for j in use])
                out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(4)]
                for at, j in enumerate(use):
                    own = scores[:, at]
                    some = np.flatnonzero(((labels == wanted[j]) == same) & (own >= min(lows[j])) & (own <= max(highs[j])))
                    for w, (low, high) in enumerate(zip(lows[j], highs[j], strict=True)):
                        got = some[(own[some] >= low) & (own[some] <= high)]
                        got = got[np.lexsort((ids[got], -own[got]))[:k]]
                        for column, x in zip(out, (np.full(len(got), m["query"][int(j)].as_py()), np.full(len(got), w), own[got], ids[got]), strict=True):
                            column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)).cast(t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["query", "window", "score", "vec_id"])

    return each


def search(queries: DataFrame, blocks: DataFrame, space: Space, windows: DataFrame, same: bool, k: int) -> DataFrame:
    """The k best rows (query, window, score, vec_id) with the query's label
    (``same``) or another one in each window, lows to highs, of ``windows``
    (query, lows, highs)."""

    def away(score: Column) -> Column:
        """The distance at which rows have this score; a little more or less is
        left to rounding by the callers."""
        return F.sqrt(F.greatest(F.lit(0.0), F.col("norm2").cast("double") + float(space.most) - 2.0 * score.cast("double")))

    slack = 1e-6 * (1 + math.sqrt(space.most))
    whole = queries.join(windows, "query").withColumn("seen", F.lit(-1.0)).withColumn("inner", away(F.array_max("highs")) - slack)
    found, state = None, whole.select("query", "lows", "seen")
    held = whole.drop("lows", "seen")
    for step in range(len(SHARES) + 1):
        whole_radius = away(F.array_min("lows")) + slack
        radius = whole_radius if step == len(SHARES) else F.least(whole_radius, F.col("radii")[step])
        ready = checkpointed(held.join(state, "query").withColumn("now", F.greatest("seen", radius)))
        chunks = ready.where(F.col("now") > F.col("seen")).groupBy("chunk").agg(F.collect_list(F.struct("query", "label", "vector", "dists", "lows", "highs", "seen", "now", "inner")).alias("members"))
        part = lambda j: F.transform("members", lambda m: F.struct(F.get(m["dists"], j).alias("d"), m["seen"].alias("seen"), m["now"].alias("now"), m["inner"].alias("inner")))
        pivots = chunks.select("chunk", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(len(space.centres) - 1)), part)).alias("pivot", "at"))

        def meets(x: Column) -> Column:
            bound = F.greatest(F.lit(0.0), F.col("lo") - x["d"], x["d"] - F.col("hi"))
            return (bound > x["seen"]) & (bound <= x["now"]) & (x["d"] + F.col("hi") >= x["inner"])

        pairs = pivots.join(blocks.select("block", "pivot", "lo", "hi"), "pivot").where(F.exists("at", meets)).select("chunk", "block")
        work = pairs.join(chunks, "chunk").join(blocks, "block").select("pivot", "lo", "hi", "ids", "labels", "vectors", "members")
        new = work.mapInArrow(best_of(space, same, k), "query long, window int, score long, vec_id long")
        new = new if found is None else found.union(new)
        order = Window.partitionBy("query", "window").orderBy(F.desc("score"), "vec_id")
        found = checkpointed(new.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank"))
        bounds = found.groupBy("query", "window").agg(F.count("*").alias("n"), F.min("score").alias("low")).where(F.col("n") == k)
        bounds = bounds.groupBy("query").agg(F.map_from_entries(F.collect_list(F.struct("window", "low"))).alias("kth"))
        raised = F.transform("lows", lambda low, w: F.greatest(low, F.coalesce(F.get(F.array(F.col("kth")), F.lit(0))[w], low)))
        state = ready.join(bounds, "query", "left").select("query", F.when(F.col("kth").isNull(), F.col("lows")).otherwise(raised).alias("lows"), F.col("now").alias("seen"))
    return found


def hard_negatives(vectors: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: float = SCALE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score
    for the rows of ``vectors`` (vec_id, label, embedding) that ``anchors`` (a
    condition on vec_id) names. Components count as floor(scale * x); a negative
    scores ``low`` to ``high`` hundredths of its positive."""
    rows = checkpointed(quantised(vectors, scale))
    size = rows.agg(F.max(F.octet_length("vector")).alias("bytes"), F.max("norm2").alias("norm2")).first()
    sample = [bytes(r["vector"]) for r in rows.orderBy(F.xxhash64("vec_id", "label"), "vec_id", "label", "vector").limit(SAMPLE).select("vector").collect()]
    space = Space((size["bytes"] or 0) // 4, size["norm2"] or 0, sample)
    # Each task keeps the smallest ids of a label and vector before the shuffle.
    copies = Window.partitionBy("label", "vector").orderBy("vec_id")
    kept = rows.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= max(positives + 1, negatives))
    blocks = index(kept.select("vec_id", "label", "vector"), space)
    wanted = rows.where(anchors)
    queries = chunked(wanted.select("label", "vector", "norm2").distinct(), space)
    everything = queries.select("query", F.array(F.lit(-FAR)).alias("lows"), F.array(F.lit(FAR)).alias("highs"))
    near = search(queries, blocks, space, everything, True, positives + 1).select("query", F.col("score").alias("positive_score"), F.col("vec_id").alias("positive_id"))
    p, hundred = F.col("positive_score"), F.lit(100).cast("long")
    least, most = low * p + F.pmod(-low * p, hundred), high * p - F.pmod(high * p, hundred)  # to whole hundreds
    bands = near.select("query", "positive_score", F.expr("0L").alias("zero"), least.alias("least"), most.alias("most")).distinct().where(F.col("least") <= F.col("most"))
    bands = bands.select("query", "positive_score", F.expr("least div 100").alias("low"), F.expr("most div 100").alias("high"))
    bands = checkpointed(bands.withColumn("window", F.row_number().over(Window.partitionBy("query").orderBy("positive_score")) - 1))
    listed = bands.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("window", "low", "high"))).alias("w")).select("query", F.col("w.low").alias("lows"), F.col("w.high").alias("highs"))
    far = search(queries, blocks, space, listed, False, negatives)
    ranked = far.withColumn("rank", F.row_number().over(Window.partitionBy("query", "window").orderBy(F.desc("score"), "vec_id")))
    ranked = ranked.join(bands.select("query", "window", "positive_score"), ["query", "window"]).select("query", "positive_score", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    # An anchor's own id goes; then the first of its query's rows are its positives.
    mine = wanted.select(F.col("vec_id").alias("anchor_id"), "label", "vector").join(queries.select("query", "label", "vector"), ["label", "vector"]).select("anchor_id", "query")
    mine = mine.join(near, "query").where(F.col("positive_id") != F.col("anchor_id"))
    first = Window.partitionBy("anchor_id", "query").orderBy(F.desc("positive_score"), "positive_id")
    mine = mine.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= positives)
    return mine.join(ranked, ["query", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def relabelled(rows: DataFrame) -> DataFrame:
    """Every seventh id has a label that is one off."""
    label = F.col("label").cast("long")
    return rows.select("vec_id", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), "embedding")


def op13_distance_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(relabelled(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 100 == 0)


ORACLE = """
WITH usable AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
        CAST(list_sum([z[1] * z[2] FOR z IN list_zip(a.v, b.v)]) AS BIGINT) AS score
    FROM usable a JOIN usable b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank,
    s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
    AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id)
QUALIFY row_number() OVER w <= 5
"""
