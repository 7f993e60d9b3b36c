"""Spelling variants by Levenshtein automata on compact trie shards.

Words are counted one partition at a time; what a task has counted is sent on
whenever it holds ``MAX_HELD`` different words, so that its memory is bounded
and a frequent word moves as a few numbers. The words that occur often enough
are cut, in order, into shards of at most ``SHARD_WORDS`` words, each a trie in
level order: the edge labels of all nodes are one string, a node's children are
one stretch of it, and what follows the last branching of a word is kept as a
tail. The shards are written to the shared folder and broadcast in groups of at
most ``MAX_BROADCAST`` bytes. Each word's distance-one automaton runs through
every shard depth-first: along the word's own path no edit is used yet, and at
each node of it the branches with the one edit are followed until they fail or
accept. Near the root a trie has many branches, so edits in the first half of a
word are looked for in tries of the words read backwards; a neighbour counts in
the direction that the length of the common beginning names. A task emits one
row a word: the number of neighbours and the best form.
Several groups are reduced by word. Roots are found by pointer doubling: a form
has at least twice its word's count, so chains are short.

Defined cases: a null or empty text has no run; a null doc_id counts as the empty
text before the colon; repeated rows count each; a run of one code point that
loses it is no word; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, table

#: Runs `[a-zÀ-ÿ]+` in UTF-8; the second byte of such a letter is 0x80 to 0xBF.
RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])[a-z]*(?:\xc3[\x80-\xbf][a-z]*)*")
#: A run loses a code point if this divides its checksum.
DAMAGE = 97
MIN_LENGTH, MIN_COUNT, RATIO = 5, 3, 2
#: Different words that a counting task holds, words of a shard, bytes of the
#: shards that are broadcast at once.
MAX_HELD, SHARD_WORDS, MAX_BROADCAST = 200_000, 1 << 16, 64 << 20


def runs(doc_id: int | None, text: bytes, least: int = MIN_LENGTH, damage: int = DAMAGE) -> tuple[list[bytes], list[tuple[bytes, bytes]]]:
    """All runs of a text, and (run, result) of those that lose a code point."""
    found = RUN.findall(text.lower())  # bytes: A-Z alone
    seed, crc = zlib.crc32(b"" if doc_id is None else b"%d" % doc_id), zlib.crc32
    seed = crc(b":", seed)
    hit = []
    for run in [w for w in found if len(w) >= least and not crc(w, seed) % damage]:
        word, h = run.decode(), crc(run, seed)
        at = h % len(word)
        hit.append((run, (word[:at] + word[at + 1 :]).encode()))
    return found, hit


def count_words(docs: DataFrame, least: int = MIN_LENGTH, min_count: int = MIN_COUNT, damage: int = DAMAGE, held: int = MAX_HELD) -> DataFrame:
    """word and n of all words of at least ``least`` code points that occur
    ``min_count`` times or more."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def sent() -> pa.RecordBatch:
            got = [(w, n) for w, n in counts.items() if n > 0 and len(w) >= least and len(w) - w.count(b"\xc3") >= least]
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in got], pa.binary()).cast(pa.string()), pa.array([n for _, n in got], pa.int64())], names=["word", "n"])

        for batch in batches:
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.large_binary()), strict=True):
                found, hit = runs(i, text.as_py() or b"", least, damage)
                counts.update(found)
                counts.subtract(a for a, _ in hit)
                counts.update(b for _, b in hit)
                if len(counts) > held:
                    yield sent()
        yield sent()

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(each, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


class Trie:
    """Words in ascending order, with their counts, as a trie in level order.

    Node v has the children first[v] to first[v + 1], whose edges are labelled by
    the same stretch of ``labels``. A node with one word below it is a leaf and
    keeps the rest of that word in ``tails``. ``n`` is the count of the word that
    ends at a node or its tail, 0 if none does."""

    __slots__ = ("first", "labels", "n", "tail_at", "tails")
    SCHEMA = "back boolean, labels string, tails string, first binary, tail_at binary, n binary"

    def __init__(self, labels: str, tails: str, first: array, tail_at: array, n: array):
        self.labels, self.tails, self.first, self.tail_at, self.n = labels, tails, first, tail_at, n

    @classmethod
    def of(cls, words: list[str], counts: list[int]) -> Trie:
        labels, tails, first, tail_at, n = [" "], [], array("I"), array("I"), array("q")
        nodes, length = [(0, len(words), 0)], 0  # words below a node, and its depth
        for lo, hi, depth in nodes:  # grows: nodes are appended level by level
            first.append(len(nodes))
            tail_at.append(length)
            if hi - lo == 1:
                tails.append(words[lo][depth:])
                length += len(words[lo]) - depth
                n.append(counts[lo])
                continue
            ends = lo < hi and len(words[lo]) == depth
            n.append(counts[lo] if ends else 0)
            lo += ends
            while lo < hi:
                label = words[lo][depth]
                end = bisect_left(words, chr(ord(label) + 1), lo, hi, key=lambda w: w[depth])  # noqa: B023
                labels.append(label)
                nodes.append((lo, end, depth + 1))
                lo = end
        first.append(len(nodes))
        tail_at.append(length)
        return cls("".join(labels), "".join(tails), first, tail_at, n)

    def row(self) -> tuple:
        return self.labels, self.tails, self.first.tobytes(), self.tail_at.tobytes(), self.n.tobytes()

    @classmethod
    def read(cls, row: tuple) -> Trie:
        labels, tails, *rest = row
        return cls(labels, tails, *[array(kind, bytes(x)) for kind, x in zip("IIq", rest, strict=True)])

    def exact(self, v: int, word: str, i: int) -> int:
        """The count of the word that ``word[i:]`` leads to from node v, or 0."""
        first, labels = self.first, self.labels
        while True:
            lo, hi = first[v], first[v + 1]
            if lo == hi:
                a, b = self.tail_at[v], self.tail_at[v + 1]
                return self.n[v] if len(word) - i == b - a and self.tails.startswith(word[i:], a) else 0
            if i == len(word):
                return self.n[v]
            v = labels.find(word[i], lo, hi)
            if v < 0:
                return 0
            i += 1

    def near(self, word: str, start: int = 0) -> dict[str, int]:
        """The words at exactly one insertion, deletion or replacement that
        agree with ``word`` in ``start`` code points or more."""
        first, labels, exact, size = self.first, self.labels, self.exact, len(word)
        found: dict[str, int] = {}
        v = i = 0
        while True:
            lo, hi = first[v], first[v + 1]
            if lo == hi:  # a leaf, no edit used so far
                tail = self.tails[self.tail_at[v] : self.tail_at[v + 1]]
                if self.n[v] and one_edit(word[i:], tail) and (i >= start or word.startswith(tail[: start - i], i)):
                    found[word[:i] + tail] = self.n[v]
                return found
            own = labels.find(word[i], lo, hi) if i < size else -1
            if i >= start and i < size and (n := exact(v, word, i + 1)):
                found[word[:i] + word[i + 1 :]] = n
            for c in range(lo, hi) if i >= start else ():
                if n := exact(c, word, i):
                    found[word[:i] + labels[c] + word[i:]] = n
                if i < size and c != own and (n := exact(c, word, i + 1)):
                    found[word[:i] + labels[c] + word[i + 1 :]] = n
            if own < 0:
                return found
            v, i = own, i + 1


def one_edit(a: str, b: str) -> bool:
    """Whether a and b differ by exactly one edit."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    k, most = 0, min(len(a), len(b))
    while k < most and a[k] == b[k]:
        k += 1
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def neighbours(word: str, ahead: list[Trie], back: list[Trie]) -> dict[str, int]:
    """The near words in tries of words and in tries of words read backwards."""
    half, found = len(word) // 2, {}
    for t in ahead:
        found |= t.near(word, half)
    drow, start = word[::-1], word[:half]
    for t in back:
        found |= {x[::-1]: n for x, n in t.near(drow, len(word) - half).items() if not x.endswith(start[::-1])}
    return found


def trie_shards(words: DataFrame, size: int = SHARD_WORDS) -> DataFrame:
    """Tries of at most ``size`` words each, neighbours in order together, and
    the same of the words read backwards (``back``)."""

    def shards(back: bool) -> DataFrame:
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def shard(rows: list[tuple]) -> pa.RecordBatch:
                row = (back, *Trie.of([w for w, _ in rows], [n for _, n in rows]).row())
                kinds = [pa.bool_(), pa.string(), pa.string(), pa.binary(), pa.binary(), pa.binary()]
                return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=["back", "labels", "tails", "first", "tail_at", "n"])

            rows: list[tuple] = []
            for batch in batches:
                rows += zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True)
                while len(rows) >= size:
                    yield shard(rows[:size])
                    del rows[:size]
            if rows:
                yield shard(rows)

        read = F.reverse("word") if back else F.col("word")
        return words.select(read.alias("word"), "n").repartitionByRange("word").sortWithinPartitions("word").mapInArrow(each, Trie.SCHEMA)

    return shards(False).union(shards(True))


def best_neighbours(words: DataFrame, shards: list[tuple]) -> DataFrame:
    """word, n, n_near and best (the negative count and text of the largest
    neighbour) of each word, within the broadcast ``shards``."""
    sent = words.sparkSession.sparkContext.broadcast(shards)
    best = pa.struct([("less", pa.int64()), ("form", pa.string())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ahead, back = ([Trie.read(r[1:]) for r in sent.value if r[0] == b] for b in (False, True))
        for batch in batches:
            count, form = [], []
            for word in batch.column("word").to_pylist():
                found = neighbours(word, ahead, back)
                top = min(((-n, w) for w, n in found.items()), default=None)
                count.append(len(found))
                form.append(top and {"less": top[0], "form": top[1]})
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(count, pa.int64()), pa.array(form, best)], names=["word", "n", "n_near", "best"])

    return words.mapInArrow(each, "word string, n long, n_near long, best struct<less: long, form: string>")


def groups(shards: DataFrame, most: int = MAX_BROADCAST) -> Iterator[list[tuple]]:
    """The shards, one group of at most ``most`` bytes (or one shard) at a time."""
    rows, held = [], 0
    for r in shards.toLocalIterator():
        size = sum(len(x) for x in r[1:])
        if rows and held + size > most:
            yield rows
            rows, held = [], 0
        rows.append(tuple(r))
        held += size
    if rows:
        yield rows


def spelling_variants(words: DataFrame, ratio: int = RATIO, size: int = SHARD_WORDS, most: int = MAX_BROADCAST) -> DataFrame:
    """word, n, n_near, form, form_n and root of every row of ``words`` (word, n).

    A word's form is its near word of largest n (ties: the smallest), if that is
    at least ``ratio`` (over 1) times its own n; its root is where its forms lead."""
    assert ratio > 1, "forms must have larger counts, or they could lead in circles"
    spark = words.sparkSession
    # Narrow rows in few megabytes, but much work each: dealt out evenly.
    words = checkpointed(words.select("word", "n").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "word"))
    parts = [checkpointed(best_neighbours(words, g)) for g in groups(checkpointed(trie_shards(words, size)), most)]
    if not parts:
        return words.select("word", "n", *[F.lit(None).cast(k).alias(c) for c, k in (("n_near", "long"), ("form", "string"), ("form_n", "long"), ("root", "string"))])
    rows = parts[0]
    if len(parts) > 1:
        for p in parts[1:]:
            rows = rows.union(p)
        rows = rows.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    good = -F.col("best.less") >= ratio * F.col("n")
    rows = checkpointed(rows.select("word", "n", "n_near", F.when(good, F.col("best.form")).alias("form"), F.when(good, -F.col("best.less")).alias("form_n")))
    links = rows.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = checkpointed(links.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if not links.where("moved").limit(1).count():
            break
        links = links.drop("moved")
    return rows.join(links.drop("moved"), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spelling_variants(count_words(table(spark, sf_dir, "documents")))
    return rows.select("word", "form", "root", "n", "n_near", "form_n")
