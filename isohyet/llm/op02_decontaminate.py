r"""Benchmark decontamination as a prefix-filtered set join.

Benchmark items become windows of 13 consecutive words (a shorter item is one
window). A window's set is its shingles of two words, ordered by how rare they
are in the corpus. A document that contains the window contains all of the set,
so for containment the necessary prefix is one token: its rarest shingle. Only
positions in documents that hold such a prefix shingle are joined, on the
shingle; a positional bound (the window must start at or after the first word)
and a length bound (it must end at or before the last) prune, and the words of
what is left are compared one by one with the window.

Two passes over the texts: one counts the benchmark's shingles in all documents
(partial sums a batch, then a shuffle of counts), one posts prefix positions,
each with the words around it. Neither shuffles a text. The benchmark's shingles
are broadcast as a filter while there are at most ``MAX_FILTER`` of them; beyond
that all positions are posted and the join, which Spark then shuffles, does the
filtering.

Defined cases: a null or wordless text has no words and no hits; a null or
wordless item has no window; items that repeat count by item_id; repeated rows
of documents give a row each; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, small_or_shuffled, table

WINDOW = 13
#: Words, on UTF-8 bytes with A-Z lower-cased: every byte of a non-ASCII
#: character belongs to a word.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
MAX_FILTER = 1_000_000
MAX_BROADCAST_WINDOWS = 200_000


def words_of(text: str | bytes | None) -> list[bytes]:
    text = text or b""
    return WORD.findall((text.encode() if isinstance(text, str) else text).lower())


def shingles(words: list[bytes]) -> list[bytes]:
    """Pairs of neighbours by position; a lone word stands for itself."""
    return [a + b" " + b for a, b in zip(words, words[1:])] if len(words) > 1 else list(words)


def windows(benchmark: DataFrame, width: int = WINDOW, place: str | None = None) -> DataFrame:
    """win, item_id, words, at, shingle: the shingles of every window."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = words_of(text)
                for i in range(max(1, len(words) - width + 1) if words else 0):
                    part = words[i : i + width]
                    rows += [(item, b" ".join(part).decode("utf-8", "replace"), len(part), at, s.decode("utf-8", "replace")) for at, s in enumerate(shingles(part))]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()), strict=True)], names=["item_id", "words", "len", "at", "shingle"])

    return benchmark.select(F.col("item_id").cast("string"), "text").mapInArrow(each, "item_id string, words string, len int, at int, shingle string")


def shingle_filter(rows: DataFrame) -> frozenset | None:
    """All shingles in ``rows``, or None if they are too many to broadcast."""
    found = [r["shingle"].encode() for r in rows.select("shingle").distinct().limit(MAX_FILTER + 1).collect()]
    return None if len(found) > MAX_FILTER else frozenset(found)


def positions(words: list[bytes], keep: frozenset | None) -> list[tuple[int, bytes]]:
    """Positions of wanted shingles: of pairs, and of words for the windows
    that are one word."""
    pairs = zip(words, words[1:])
    if keep is None:
        return [*((i, a + b" " + b) for i, (a, b) in enumerate(pairs)), *enumerate(words)]
    found = [(i, s) for i, (a, b) in enumerate(pairs) if (s := a + b" " + b) in keep]
    lone = {k for k in keep if b" " not in k} if len(keep) < 1000 else keep
    return found + [(i, w) for i, w in enumerate(words) if w in lone] if lone else found


def count_shingles(docs: DataFrame, keep: frozenset | None) -> DataFrame:
    """(shingle, n): occurrences in all documents, summed batch by batch."""
    sent = docs.sparkSession.sparkContext.broadcast(keep)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n: Counter = Counter()
            for text in batch.column("text").cast(pa.large_binary()):
                n.update(s for _, s in positions(words_of(text.as_py()), sent.value))
            yield pa.RecordBatch.from_arrays([pa.array([k.decode() for k in n], pa.string()), pa.array(list(n.values()), pa.int64())], names=["shingle", "n"])

    return docs.select("text").mapInArrow(each, "shingle string, n long").groupBy("shingle").agg(F.sum("n").alias("n"))


def rarest(wins: DataFrame, counts: DataFrame) -> DataFrame:
    """Each window with its prefix: the rarest shingle and where it stands."""
    rows = wins.join(counts, "shingle", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    first = Window.partitionBy("item_id", "words").orderBy("n", "shingle", "at")
    return rows.withColumn("rank", F.row_number().over(first)).where("rank = 1").select("shingle", "at", "len", "words", "item_id")


def post(docs: DataFrame, keep: frozenset | None, width: int, place: str | None = None) -> DataFrame:
    """doc_id, place (the column of that name, else ``monotonically_increasing_id``
    of the row), n_words, and an array of prefix positions, each with the words
    before and after it."""
    at = F.monotonically_increasing_id() if place is None else F.col(place)
    sent = docs.sparkSession.sparkContext.broadcast(keep)
    entry = pa.struct([("pos", pa.int32()), ("shingle", pa.string()), ("before", pa.int32()), ("around", pa.string())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, posts = [], []
            for text in batch.column("text").cast(pa.large_binary()):
                words = words_of(text.as_py())
                sizes.append(len(words))
                posts.append([{"pos": i, "shingle": s.decode(), "before": min(i, width - 1), "around": b" ".join(words[max(0, i - width + 1) : i + width]).decode()} for i, s in positions(words, sent.value)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("place"), pa.array(sizes, pa.int64()), pa.array(posts, pa.list_(entry))], names=["doc_id", "place", "n_words", "posts"])

    return docs.select(F.col("doc_id").cast("long"), "text", at.alias("place")).mapInArrow(each, "doc_id long, place long, n_words long, posts array<struct<pos:int,shingle:string,before:int,around:string>>")


def find_contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, place: str | None = None) -> DataFrame:
    """doc_id, place, n_words, n_hit (words inside any occurrence of a window),
    items (sorted ids of items with one), one row per row of ``docs``."""
    wins = windows(benchmark, width)
    keep = shingle_filter(wins)
    # Written once: it is used twice, and each use would count all texts anew.
    prefix = checkpointed(rarest(wins, count_shingles(docs, keep)).withColumnsRenamed({"shingle": "key", "words": "window"}))
    keep = shingle_filter(prefix.select(F.col("key").alias("shingle")))
    rows = post(docs, keep, width, place).select("doc_id", "place", "n_words", F.explode_outer("posts").alias("post"))
    # A row without a post must not meet the others in one partition.
    key = F.coalesce(F.col("post.shingle"), F.concat(F.lit("\n"), F.col("place").cast("string")))
    start = F.col("post.pos") - F.col("at")
    inside = (start >= 0) & (start + F.col("len") <= F.col("n_words"))
    words = F.slice(F.split("post.around", " "), F.col("post.before") - F.col("at") + 1, F.col("len"))
    same = F.when(inside, F.array_join(words, " ") == F.col("window"))
    hit = F.when(same, F.struct(start.alias("start"), (start + F.col("len")).alias("end")))
    met = rows.withColumn("key", key).join(small_or_shuffled(prefix, MAX_BROADCAST_WINDOWS), "key", "left")
    met = met.select("doc_id", "place", "n_words", hit.alias("hit"), F.when(same, F.col("item_id")).alias("item"))
    # collect_set leaves nulls out; a document's own length bounds its hits.
    out = met.groupBy("doc_id", "place").agg(F.max("n_words").alias("n_words"), F.sort_array(F.collect_set("hit")).alias("hits"), F.sort_array(F.collect_set("item")).alias("items"))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, x: F.struct(F.greatest(acc["end"], x["end"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(acc["end"], x["start"]))).cast("long").alias("n"))
    return out.select("doc_id", "place", "n_words", F.aggregate("hits", zero, step)["n"].alias("n_hit"), "items")


def op2_prefix_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit, n_words = F.col("n_hit"), F.col("n_words")
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= n_words)).alias("contaminated"))


WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: Every shingle of a window's length is met with the windows; a row is a place.
ORACLE = f"""
with d as (select doc_id, row_number() over () as place, {WORDS} as w from documents),
i as (select cast(item_id as varchar) as item_id, {WORDS} as w, least(len(w), {WINDOW}) as size from benchmark),
win as (select distinct item_id, size, array_to_string(w[p : p + size - 1], ' ') as s from (select *, unnest(range(1, len(w) - size + 2)) as p from i where size > 0)),
spots as (select place, size, w, unnest(range(1, len(w) - size + 2)) as p from d, (select distinct size from win)),
met as (select place, p, win.size, item_id from (select place, size, p, array_to_string(w[p : p + size - 1], ' ') as s from spots) sh join win on win.size = sh.size and win.s = sh.s),
hit as (select place, count(*) as n_hit from (select distinct place, unnest(range(p, p + size)) as q from met) group by 1),
found as (select place, count(*) as n_items, string_agg(item_id, ',' order by item_id) as items from (select distinct place, item_id from met) group by 1)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join hit using (place) left join found using (place)
"""
