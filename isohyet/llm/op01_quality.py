"""Quality rules: surface rules, then a hashed n-gram log-likelihood ratio.

Words and pairs of words are hashed into ``buckets`` cells. Two multinomials
over the cells are counted: the *target* over documents that ``labels`` trusts
(quality 1) and the *raw* one over the whole corpus. A document's score is the
mean over its n-grams of log(target / raw), so length does not matter, and
every document is held against the same fixed threshold.

Only DataFrame functions run: a counting pass and a scoring pass over the
texts, neither of which shuffles a text. What goes to the driver is one number
a cell. Over ``MAX_BROADCAST_IDS`` trusted ids the target is counted in a pass
of its own, whose join shuffles texts, dealt by id and text so that an id with
many rows is split; rows without an id take no part in it.

Defined cases: a null, empty or blank text has no words, score 0 and
``base_failed``; a null doc_id is never trusted; repeated rows give a row each;
other columns of the input are ignored; with no trusted document at all the
ratio is 0 everywhere and only the base rules decide.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, let, split_words, table

BUCKETS = 1 << 15
#: Mean log-ratio a document must reach.
THRESHOLD = -0.1
#: Ids of trusted documents that may be broadcast; more are joined by a shuffle,
#: in which an id's rows are dealt over so many parts.
MAX_BROADCAST_IDS, SALTS = 2_000_000, 16


def repeated_words(hashes: Column, width: int = 8) -> Column:
    """Words that stand in a window of ``width`` words found at least twice in
    the text. Only a text in which some window repeats is sorted."""
    n = F.size(hashes)
    windows = F.when(n >= width, F.transform(F.sequence(F.lit(1), n - (width - 1)), lambda i: F.xxhash64(F.slice(hashes, i, width))))

    def covered(ws: Column) -> Column:
        ordered = F.sort_array(F.transform(ws, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            twin = lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(s, twin), lambda x: x["i"]))

        step = lambda acc, i: F.struct((acc["n"] + i + width - F.greatest(acc["end"], i)).cast("long").alias("n"), (i + width).cast("long").alias("end"))
        zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
        return F.aggregate(let(ordered, starts), zero, step)["n"]

    count = let(windows, lambda ws: F.when(F.size(F.array_distinct(ws)) < F.size(ws), covered(ws)).otherwise(F.lit(0).cast("long")))
    return F.coalesce(count, F.lit(0).cast("long"))


def grams(hashes: Column, buckets: int) -> Column:
    """Cells of each word and of each pair with the next word (or the end)."""
    return F.concat(
        F.transform(hashes, lambda h: F.pmod(h, F.lit(buckets)).cast("int")),
        F.transform(hashes, lambda h, i: F.pmod(F.xxhash64(h, F.coalesce(F.get(hashes, i + 1), F.lit(0).cast("long"))), F.lit(buckets)).cast("int")),
    )


def hashed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("words", split_words(F.col("text"))).withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))


def ngram_counts(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(cell, target, raw): n-grams of the trusted and of all documents."""
    ids = checkpointed(trusted.select(F.col("doc_id").alias("trusted_id")).dropna().distinct())
    if ids.count() <= MAX_BROADCAST_IDS:
        rows = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("trusted_id"), "left")
        cells = _cells(rows.select(F.col("trusted_id").isNotNull().cast("long").alias("good"), "text"), buckets)
        return cells.groupBy("cell").agg(F.sum("good").alias("target"), F.count("*").alias("raw"))
    raw = _cells(docs.select(F.lit(0).alias("good"), "text"), buckets).groupBy("cell").agg(F.count("*").alias("raw"))
    salt = F.pmod(F.xxhash64("text"), F.lit(SALTS)).cast("int").alias("salt")
    ids = ids.select("trusted_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("trusted_salt"))
    some = docs.select("doc_id", "text", salt).dropna(subset=["doc_id"])
    some = some.join(ids, (F.col("doc_id") == F.col("trusted_id")) & (F.col("salt") == F.col("trusted_salt")), "left_semi")
    target = _cells(some.select(F.lit(1).alias("good"), "text"), buckets).groupBy("cell").agg(F.count("*").alias("target"))
    return raw.join(target, "cell", "left").select("cell", F.coalesce("target", F.lit(0)).alias("target"), "raw")


def _cells(rows: DataFrame, buckets: int) -> DataFrame:
    """(good, cell) of every n-gram of ``rows`` (good, text)."""
    cells = rows.select("good", split_words(F.col("text")).alias("words"))
    cells = cells.select("good", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"), F.size("words").alias("n_words"))
    # Both uses of `hashes` keep Spark from computing it anew for each pair.
    return cells.where(F.size("hashes") == F.col("n_words")).select("good", F.explode(grams(F.col("hashes"), buckets)).alias("cell"))


def log_ratios(counts: DataFrame, buckets: int = BUCKETS) -> list[float]:
    """log(target / raw) of every cell, add-one smoothed. ``counts`` has at most
    ``buckets`` rows, which is what the driver gets."""
    ratios, rows = [0.0] * buckets, counts.collect()
    target, raw = sum(r["target"] for r in rows), sum(r["raw"] for r in rows)
    for r in rows if target else []:
        ratios[r["cell"]] = round(math.log((r["target"] + 1) / (target + buckets) / ((r["raw"] + 1) / (raw + buckets))), 6)
    return ratios


def score_quality(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """Base rules, the n-gram ratio and the verdict for every document.

    ``docs`` needs doc_id and text, ``trusted`` doc_id. Returns doc_id, the
    surface counts, base_failed, llr (mean log-ratio) and kept.
    """
    ratios = log_ratios(ngram_counts(docs, trusted, buckets), buckets)
    # One string literal, folded by the optimizer into an array constant.
    weights = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<double>")
    joined = F.array_join("words", "")
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = hashed(docs).select(
        "doc_id",
        "hashes",
        F.size("hashes").cast("long").alias("n_words"),
        F.length(joined).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    total = let(weights, lambda w: F.aggregate(grams(F.col("hashes"), buckets), F.lit(0.0), lambda acc, g: acc + F.get(w, g)))
    rows = rows.select(*[c for c in rows.columns if c != "hashes"], repeated_words(F.col("hashes")).alias("n_repeat_words"), total.alias("total"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = rows.withColumn("llr", F.when(F.col("n_words") > 0, F.col("total") / (2 * F.col("n_words"))).otherwise(0.0)).withColumn("base_failed", failed)
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold)).drop("total")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    rows = score_quality(table(spark, sf_dir, "documents"), trusted)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")
