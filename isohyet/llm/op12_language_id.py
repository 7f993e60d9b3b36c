"""Language identification by bit-sliced Bloom filters of n-grams.

Every learned language has a Bloom filter of the letter n-grams that are usual in
it, and the filters of all languages lie side by side: row r of the table holds
bit r of every filter, as a mask with one bit a language. The masks of an
n-gram's ``HASHES`` rows, combined by AND, name at once all languages that may
contain it. A text's count for a language is the number of its n-grams whose
combined mask has the language's bit, corrected for the false positives that
the filter's share of set bits leads to; the largest corrected count decides,
and its share of all corrected counts is the score.

N-grams have three or four code points of the lower-cased text; what is no letter
ends a word, and an n-gram may begin or end there. Learning counts the n-grams
of all texts with a language, in numpy on Arrow batches, reduced per task before
they are shuffled. An n-gram is usual in a language if its frequency there is
``RATIO`` times its largest frequency in any language or more; so stray foreign
words and wrong labels don't make it a member. The driver gets one mask a row of
the table (at most 2 ** ``MAX_BITS`` rows for 63 languages) and broadcasts it;
scoring is one pass without a shuffle.

Defined cases: a null text, or one without a letter, is ``und`` with score 0, and
so is every text where nothing was learned; a text none of whose n-grams is known
gets the language with the most n-grams learned, with score 0; ties go to the
smallest language; a null doc_id is never held out and is learned from like any
other; repeated rows count and are returned each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, id_remainder, table

FOLDS, HELD_OUT = 4, 2
SIZES = (3, 4)
RATIO = 0.25
#: Rows an n-gram has in the table, rows for each n-gram of the largest language,
#: and the binary logarithms of the least and most rows.
HASHES, ROOM, MIN_BITS, MAX_BITS = 3, 8, 14, 21
#: Languages of one mask, and those that may be learned.
SLICE, MAX_LANGUAGES = 63, 4096
#: Code points handled at once, and n-grams that a counting task holds.
STRETCH, MAX_HELD = 1 << 20, 1 << 22
UNKNOWN = "und"


@cache
def letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def stretches(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """(index of the first, lower-cased texts) of neighbours that have about
    ``STRETCH`` code points together; a longer text comes in parts, cut behind
    white space where there is some, each with its index."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        if held and size + len(text) > STRETCH:
            yield first, held
            held, size = [], 0
        if not held:
            first = i
        if len(text) <= STRETCH:
            held.append(text.lower())
            size += len(text)
            continue
        at = 0
        while at < len(text):
            end = at + STRETCH
            if end < len(text):
                end = max(text.rfind(" ", at, end), text.rfind("\n", at, end)) + 1 or end
            yield i, [text[at:end].lower()]
            at = end
    if held:
        yield first, held


def grams(texts: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """For each of SIZES the hashes of the n-grams that begin at every place of
    the joined texts, and whether there is one; the places where texts begin and
    the last ends; the numbers of letters."""
    starts = np.cumsum([0, *[len(t) + 1 for t in texts]])
    codes = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), "<u4")
    alpha = letters()[codes]
    codes = np.where(alpha, codes, 0).astype(np.uint64)
    out = []
    for n in SIZES:
        size = max(0, len(codes) - n + 1)
        h, there = np.full(size, n, np.uint64), np.ones(size, bool)  # from n on: a leading 0 must count
        for k in range(n):
            h = (h ^ codes[k : k + size]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            if 0 < k < n - 1:
                there &= alpha[k : k + size]
        out.append((h, there))
    return out, starts, _sums(alpha, starts)


def _sums(flags: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    at = total[np.minimum(starts, len(flags))]
    return at[1:] - at[:-1]


def count_grams(docs: DataFrame, held: int = MAX_HELD) -> DataFrame:
    """lang, gram (its hash) and n over all rows of ``docs`` (text, lang)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, list[np.ndarray]] = {}

        def sent() -> Iterator[pa.RecordBatch]:
            for lang, parts in kept.items():
                gram, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])
            kept.clear()

        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            for lang in sorted(set(langs)):
                for _, some in stretches([t for t, own in zip(texts, langs, strict=True) if own == lang]):
                    kept.setdefault(lang, []).extend(h[there] for h, there in grams(some)[0])
                    if sum(len(x) for parts in kept.values() for x in parts) > held:
                        yield from sent()
        yield from sent()

    rows = docs.select("text", F.col("lang").cast("string")).dropna().mapInArrow(each, "lang string, gram long, n long")
    return rows.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Filters:
    """The table: ``masks[r, s]`` has the bits of row r of languages 63 s to
    63 s + 62; ``false`` is each language's share of false positives."""

    def __init__(self, langs: list[str], masks: np.ndarray, most: int = 0):
        self.langs, self.masks, self.most = langs, masks, most
        filled = [((masks[:, k // SLICE] >> np.uint64(k % SLICE)) & np.uint64(1)).mean() for k in range(len(langs))]
        self.false = np.array(filled) ** HASHES

    def of(self, hashes: np.ndarray, s: int) -> np.ndarray:
        """The languages of slice ``s`` that may contain each n-gram."""
        last = np.uint64(len(self.masks) - 1)
        out = self.masks[(hashes & last).astype(np.int64), s]
        for k in range(1, HASHES):
            out &= self.masks[((hashes >> np.uint64(MAX_BITS * k)) & last).astype(np.int64), s]
        return out

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text the n-grams that each language contains, the n-grams
        and the letters."""
        found, starts, n_letters = grams(texts)
        total, hits = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(self.langs)), np.int64)
        for h, there in found:
            total += _sums(there, starts)
            for s in range(self.masks.shape[1]):
                masks = np.where(there, self.of(h, s), np.uint64(0))
                for k in range(s * SLICE, min(len(self.langs), (s + 1) * SLICE)):
                    hits[:, k] += _sums((masks >> np.uint64(k % SLICE)) & np.uint64(1), starts)
        return hits, total, n_letters

    def decide(self, hits: np.ndarray, total: np.ndarray, n_letters: np.ndarray) -> tuple[list[str], np.ndarray]:
        sure = np.maximum(0.0, (hits - self.false * total[:, None]) / np.maximum(1e-9, 1 - self.false))
        whole, best = sure.sum(axis=1), sure.argmax(axis=1)
        best[whole == 0] = self.most
        score = np.where((whole > 0) & (n_letters > 0), sure[np.arange(len(best)), best] / np.where(whole > 0, whole, 1), 0.0)
        return [self.langs[k] if n else UNKNOWN for k, n in zip(best.tolist(), n_letters.tolist(), strict=True)], score


def train(docs: DataFrame, ratio: float = RATIO) -> Filters | None:
    """The filters of all languages of ``docs`` (text, lang); None without any."""
    counts = checkpointed(count_grams(docs))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"), F.count("*").alias("different")).orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(totals) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not totals:
        return None
    spark = docs.sparkSession
    known = spark.createDataFrame([(r["lang"], i, r["total"]) for i, r in enumerate(totals)], "lang string, k int, total long")
    # A row a language: MAX_LANGUAGES bounds this broadcast and the lists below.
    rates = counts.join(F.broadcast(known), "lang").select("gram", "k", (F.col("n") / F.col("total")).alias("rate"))
    usual = rates.groupBy("gram").agg(F.max("rate").alias("top"), F.collect_list(F.struct("k", "rate")).alias("own")).select("gram", "top", F.inline("own")).where(F.col("rate") >= ratio * F.col("top"))
    bits = min(MAX_BITS, max(MIN_BITS, (ROOM * max(r["different"] for r in totals)).bit_length()))
    places = F.array(*[F.shiftrightunsigned("gram", MAX_BITS * i).bitwiseAND((1 << bits) - 1) for i in range(HASHES)])
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("k") % SLICE)
    rows = usual.select(F.floor(F.col("k") / SLICE).cast("int").alias("slice"), bit.alias("mask"), F.explode(places).alias("row")).groupBy("slice", "row").agg(F.bit_or("mask").alias("mask")).toArrow()
    masks = np.zeros((1 << bits, -(-len(totals) // SLICE)), np.uint64)
    masks[rows["row"].to_numpy(), rows["slice"].to_numpy()] = rows["mask"].to_numpy().astype(np.uint64)
    most = max(range(len(totals)), key=lambda i: (totals[i]["total"], -i))
    return Filters([r["lang"] for r in totals], masks, most)


def identify(docs: DataFrame, model: Filters | None) -> DataFrame:
    """doc_id, lang_pred and score of every row of ``docs`` (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            if model is None:
                pred, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            else:
                sums = np.zeros((len(texts), len(model.langs)), np.int64), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
                for first, some in stretches(texts):
                    for whole, part in zip(sums, model.counts(some), strict=True):
                        whole[first : first + len(some)] += part
                pred, score = model.decide(*sums)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(each, "doc_id long, lang_pred string, score double")


def op12_bloom_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = id_remainder(F.col("doc_id"), FOLDS) == HELD_OUT
    rows = identify(docs, train(docs.where(~held_out)))
    return rows.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
