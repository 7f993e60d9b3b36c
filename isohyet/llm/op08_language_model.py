"""N-gram language model in an Elias-Fano trie of memory-mapped levels.

Level 1 holds the vocabulary: ascending word hashes (Elias-Fano) with their
counts; a word's id is its rank. Below it are ``order - 1`` levels of n-grams.
For every n-gram of a level there is a pointer (Elias-Fano, monotone) to the range
of its successors in the next, which are word ids relative to it: in the second
level, where ranges are long, Elias-Fano coded with the context's rank, below it,
where most are of one, packed. A successor is searched between the two pointers
of its context only. Beside each n-gram stands the quantised log of its
discounted probability, and of the weight that its own contexts give to the next
lower order.

Smoothing is interpolated absolute discounting,
``P(w | h) = max(c(hw) - D, 0) / c(h) + D * n(h) / c(h) * P(w | h')``
with n(h) the number of different successors of h (the width of its pointer
range), h' the history without its first word, and at the end the add-one unigram
in which all unknown words are one.

N-grams are dealt to small tries by a hash of their first word; those of a first
word with very many tokens by the second, too, so that building is even work. A
store is a file of many tries, so that however many tries there are, there are
at most ``MAX_STORES`` files. Training is two counting passes over all training
documents: numpy pre-counts a few million tokens at a time, Spark shuffles the
counts (packed by trie), and each partition codes its tries in the folder shared
by the cluster. Scoring is one pass over all documents without a shuffle: tasks
map the files into memory and search them for whole blocks of tokens at a time;
the n-gram found for a token is the context of the next, one level down. Nothing
of the model passes through the driver but one line per file.

Defined cases: a null or empty text is its end token alone; a null doc_id is
training data; repeated rows are counted and scored each; other columns are
ignored; without training documents every probability is that of an unknown
word. More than three thousand million different words raise an error.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import elias_fano as ef
from .common import checkpointed, id_remainder, shared_dir, table

FOLDS, HELD_OUT = 7, 2
ORDER, DISCOUNT = 3, 0.8
#: The end of a text; no word is a space.
END = b" "
#: Bytes of text taken at a time, tokens counted at a time, and the size aimed
#: at for a file of level 1 and for a trie.
BLOCK_BYTES, BLOCK_TOKENS = 6 << 20, 2 << 20
LEVEL1_WORDS, TRIE_TOKENS, LEAST_FILES = 1 << 19, 1 << 19, 64
MAX_STORES = 4096
#: Pairs of ids must fit into 63 bits.
MAX_WORDS = 3_000_000_000
#: Logs of probabilities are kept as multiples of this, rounded down so that
#: the probabilities of a context never add up to more than one.
QUANTUM = 2.0**-12
POWERS = 10.0 ** (np.arange(1 << 16) * -QUANTUM)


@dataclass(frozen=True)
class Model:
    """Where the levels are, and the totals that scoring needs."""

    uri: str
    order: int
    bits: int  # level 1 files are split by so many upper bits of the hash
    offsets: tuple[int, ...]  # id of the first word of each level 1 file
    tokens: int
    words: int
    documents: int
    tries: int = 0
    piece: int = 1
    discount: float = DISCOUNT

    def pieces(self, counts: np.ndarray) -> np.ndarray:
        """Over how many parts a first word with so many tokens is spread."""
        return 1 + counts // self.piece

    @property
    def stores(self) -> int:
        return min(self.tries, MAX_STORES)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.Array, np.ndarray]]:
    """Rows some megabytes at a time, their words (A-Z in lower case) and the
    number of words of each row."""
    for batch in batches:
        texts = pc.fill_null(batch.column("text").cast(pa.large_string()), "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy())
        first = 0
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + BLOCK_BYTES, "right")))
            lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.slice(first, last - first)))
            flat = lists.flatten()
            real = pc.greater(pc.binary_length(flat), 0)
            upto = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
            offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            yield batch.slice(first, last - first), flat.filter(real), np.diff(upto[offsets])
            first = last


def hash_tokens(words: pa.Array, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each different token (the end is the last), and the index of the
    hash of every token, an end after each text's words."""
    coded = words.dictionary_encode()
    digest = xxhash.xxh64_intdigest
    known = coded.dictionary.cast(pa.large_binary()).to_pylist()
    hashes = np.fromiter(map(digest, [*known, END]), np.uint64, len(known) + 1)
    index = np.full(len(words) + len(sizes), len(known), np.int32)
    inside = np.ones(len(index), bool)
    inside[np.cumsum(sizes + 1) - 1] = False
    index[inside] = coded.indices.to_numpy(zero_copy_only=False)
    return hashes, index


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix of the bits of integers."""
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Trie:
    """The levels of one trie, as views of its store."""

    def __init__(self, arrays: dict[str, np.ndarray], order: int):
        self.arrays = arrays
        self.contexts, self.second = ef.sequence(arrays, "context"), ef.sequence(arrays, "word2")
        self.pointers = {k: ef.sequence(arrays, f"pointer{k}") for k in range(2, order + 1)}
        self.words = {k: ef.Packed(ef.part(arrays, f"word{k}")) for k in range(3, order + 1)}


class Levels:
    """The files of a model, mapped into memory when first needed."""

    open: dict[str, Levels] = {}

    def __init__(self, model: Model):
        self.model, self.first, self.tries, self.stores = model, {}, {}, {}
        self.spread: dict | None = None

    @classmethod
    def of(cls, model: Model) -> Levels:
        key = f"{model.uri} {model.tries}"
        if key not in cls.open:
            cls.open.clear()  # one model at a time
            cls.open[key] = cls(model)
        return cls.open[key]

    def level1(self, k: int) -> tuple[ef.Sequence, np.ndarray]:
        if k not in self.first:
            arrays = ef.mapped(f"{self.model.uri}/words-{k}")
            self.first[k] = ef.sequence(arrays, "hash"), arrays["count"]
        return self.first[k]

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Tokens of each id; for the start of a text, the documents."""
        out, words = np.full(len(ids), self.model.documents, np.int64), np.flatnonzero(ids < self.model.words)
        part = np.searchsorted(np.array(self.model.offsets), ids[words], "right") - 1
        for k, rows in grouped(part):
            out[words[rows]] = self.level1(k)[1][ids[words[rows]] - self.model.offsets[k]]
        return out

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Id (-1 if unknown) and count of each hash."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        bits = self.model.bits
        part = (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)
        for k, rows in grouped(part):
            if self.model.offsets[k] == self.model.offsets[k + 1]:
                continue
            seq, count = self.level1(k)
            at = seq.find(hashes[rows] & np.uint64((1 << (64 - bits)) - 1))
            rows, at = rows[at >= 0], at[at >= 0]
            ids[rows], counts[rows] = at + self.model.offsets[k], count[at]
        return ids, counts

    def wide(self) -> dict[str, np.ndarray]:
        """Which stores there are, and the width of spread contexts."""
        if self.spread is None:
            self.spread = ef.mapped(f"{self.model.uri}/spread")
        return self.spread

    def trie(self, k: int) -> Trie | None:
        if k not in self.tries:
            store = k % self.model.stores
            if store not in self.stores:
                there = self.wide()["stores"]
                at = np.searchsorted(there, store)
                self.stores[store] = {}
                if at < len(there) and there[at] == store:
                    for name, x in ef.mapped(f"{self.model.uri}/store-{store}").items():
                        own, _, rest = name.partition("/")
                        self.stores[store].setdefault(int(own), {})[rest] = x
            arrays = self.stores[store].get(k)
            self.tries[k] = Trie(arrays, self.model.order) if arrays else None
        return self.tries[k]

    def second(self, context: np.ndarray, count: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of each different pair, in order of the context: discounted
        probability (0 if not seen), how many different successors the context
        has, and trie and place of the pair (-1 if not seen)."""
        m = self.model
        p, width, place = np.zeros(len(context)), np.zeros(len(context), np.int64), np.full(len(context), -1, np.int64)
        file = trie_of(m, context, count, word)
        for k, rows in grouped(file):
            if (trie := self.trie(k)) is None:
                continue
            # A context is searched once, however many pairs begin with it.
            own = context[rows]
            new = np.append(True, own[1:] != own[:-1])
            at, rank = trie.contexts.find(own[new]), np.cumsum(new) - 1
            first, last = trie.pointers[2].between(np.maximum(at, 0))
            width[rows] = np.where(at >= 0, last - first, 0)[rank]
            keep = np.flatnonzero((at[rank] >= 0) & (word[rows] >= 0))
            rows, rank = rows[keep], rank[keep]
            found = trie.second.find(at[rank] * np.int64(m.words + 1) + word[rows], first[rank], last[rank])
            rows, found = rows[found >= 0], found[found >= 0]
            p[rows], place[rows] = ef.probability(trie.arrays, "log2", found, POWERS), found
        many = np.flatnonzero(m.pieces(count) > 1)
        if len(many):  # contexts spread over tries: the sum over their parts
            keys, widths = self.wide()["context"], self.wide()["width"]
            at = np.minimum(np.searchsorted(keys, context[many]), max(0, len(keys) - 1))
            hit = keys[at] == context[many] if len(keys) else np.zeros(len(many), bool)
            width[many] = np.where(hit, widths[at] if len(keys) else 0, width[many])
        return p, width, file, place

    def deeper(self, level: int, file: np.ndarray, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of each word after an n-gram of the level above, given by trie and
        place: discounted probability, weight of the lower order, place."""
        p, weight, place = np.zeros(len(context)), np.ones(len(context)), np.full(len(context), -1, np.int64)
        for k, rows in grouped(file):
            trie = self.trie(k)
            rows = rows[np.argsort(context[rows])]
            own = context[rows]
            new = np.append(True, own[1:] != own[:-1])
            rank = np.cumsum(new) - 1
            first, last = (x[rank] for x in trie.pointers[level].between(own[new]))
            some = np.flatnonzero(last > first)  # none follow the end of a text
            rows, first, last = rows[some], first[some], last[some]
            weight[rows] = ef.probability(trie.arrays, f"rest{level - 1}", context[rows], POWERS)
            keep = np.flatnonzero(word[rows] >= 0)
            found = trie.words[level].find(word[rows[keep]], first[keep], last[keep])
            rows, found = rows[keep[found >= 0]], found[found >= 0]
            p[rows], place[rows] = ef.probability(trie.arrays, f"log{level}", found, POWERS), found
        return p, weight, place


def grouped(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each different key and the rows that have it."""
    order = np.argsort(keys.astype(np.uint16) if len(keys) and keys.max() < 1 << 16 else keys, kind="stable")
    cuts = np.flatnonzero(np.diff(keys[order])) + 1
    for rows in np.split(order, cuts) if len(keys) else []:
        yield int(keys[rows[0]]), rows


def trie_of(m: Model, context: np.ndarray, count: np.ndarray, word: np.ndarray) -> np.ndarray:
    part = np.maximum(word, 0) % m.pieces(count)
    return (mixed(context * np.int64(1_000_003) + part) % np.uint64(m.tries)).astype(np.int64)


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """Rows of each file, from batches sorted by file."""
    held: list[pa.RecordBatch] = []

    def joined() -> tuple[int, dict[str, np.ndarray]]:
        t, k = pa.Table.from_batches(held), held[0].column("file")[0].as_py()
        held.clear()  # else the rows are in memory twice while they are coded
        return k, {c: t.column(c).to_numpy() for c in t.column_names if c != "file"}

    for batch in batches:
        for _, rows in grouped(batch.column("file").to_numpy()):
            part = batch.slice(int(rows[0]), len(rows))
            if held and held[0].column("file")[0].as_py() != part.column("file")[0].as_py():
                yield joined()
            held.append(part)
    if held:
        yield joined()


def count_words(docs: DataFrame) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, words, sizes in blocks(batches):
            hashes, index = hash_tokens(words, sizes)
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(np.bincount(index, minlength=len(hashes)).astype(np.int64))], names=["hash", "n"])

    return docs.select("text").mapInArrow(each, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


def build_words(counts: DataFrame, uri: str, bits: int, partitions: int) -> DataFrame:
    """Writes level 1; (file, words) of each of its files."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, t in runs(batches):
            hashes = t["hash"].view(np.uint64) & np.uint64((1 << (64 - bits)) - 1)
            order = np.argsort(hashes)
            ef.write(f"{uri}/words-{k}", ef.named("hash", ef.encode(hashes[order], 1 << (64 - bits))) | {"count": t["n"][order]})
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([len(order)], pa.int64())], names=["file", "words"])

    file = F.shiftrightunsigned("hash", 64 - bits) if bits else F.lit(0).cast("long")
    rows = counts.select(file.alias("file"), "hash", "n").repartition(partitions, "file").sortWithinPartitions("file")
    return rows.mapInArrow(each, "file long, words long")


def places(levels: Levels, words: pa.Array, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of every token: id and count; and where texts start."""
    hashes, index = hash_tokens(words, sizes)
    ids, counts = levels.ids(hashes)
    return ids[index], counts[index], np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])


def ordered(columns: list[np.ndarray]) -> np.ndarray:
    """The order of rows by their columns, of which the first tells most apart."""
    order = np.argsort(columns[0])
    tie = np.diff(columns[0][order]) == 0
    many = np.flatnonzero(np.append(tie, False) | np.append(False, tie))
    part = order[many]
    order[many] = part[np.lexsort([c[part] for c in reversed(columns)])]
    return order


def summed(columns: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Different rows, in order, with the sum of ``n``."""
    if not len(n):
        return columns, n
    order = ordered(columns)
    columns = [c[order] for c in columns]
    first = np.flatnonzero(np.append(True, np.logical_or.reduce([np.diff(c) != 0 for c in columns])))
    return [c[first] for c in columns], np.add.reduceat(n[order], first)


def shrunk(columns: list[np.ndarray]) -> bytes:
    """Columns of 64-bit integers in few bytes: like bytes side by side, then
    compressed, as ids differ in their lower bytes only."""
    data = b"".join(np.ascontiguousarray(c.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns)
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(data).to_pybytes()


def grown(data: bytes, n: int) -> list[np.ndarray]:
    size = int.from_bytes(data[:8], "little")
    whole = np.frombuffer(pa.Codec("zstd").decompress(data[8:], size).to_pybytes(), np.uint8).reshape(n, 8, -1)
    return [np.ascontiguousarray(c.T).view("<i8").reshape(-1) for c in whole]


def count_grams(docs: DataFrame, model: Model) -> DataFrame:
    """(store, trie, rows): pre-counted n-grams of the model's order, packed; the
    first two words are one number, id * (words + 1) + id. Those cut short by
    the end of their text have the id after the last word's behind it."""
    none = model.words

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, held, size = Levels.of(model), [], 0

        def counted() -> pa.RecordBatch:
            columns, n = summed([np.concatenate(c) for c in zip(*held, strict=True)], np.ones(size, np.int64))
            context, word = columns[0] // (none + 1), columns[0] % (none + 1)
            distinct, at = np.unique(context, return_inverse=True)
            file = trie_of(model, context, levels.counts(distinct)[at], word)
            keys, data = [], []
            for k, rows in grouped(file):
                keys.append(k)
                data.append(shrunk([*(c[rows] for c in columns), n[rows]]))
            keys = np.array(keys, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(keys % model.stores), pa.array(keys), pa.array(data, pa.binary())], names=["store", "trie", "rows"])

        for _, words, sizes in blocks(batches):
            ids, _, starts = places(levels, words, sizes)
            # Every token after the one before it; a text's first after its start.
            before = np.roll(ids, 1)
            before[starts] = none
            ends, at = np.repeat(np.cumsum(sizes + 1), sizes + 1), np.arange(len(ids))
            columns = [before * np.int64(none + 1) + ids]
            for k in range(1, model.order - 1):
                columns.append(np.where(at + k < ends, ids[np.minimum(at + k, len(ids) - 1)], none))
            held.append(columns)
            size += len(ids)
            if size >= BLOCK_TOKENS:
                yield counted()
                held, size = [], 0
        if size:
            yield counted()

    return docs.select("text").mapInArrow(each, "store long, trie long, rows binary")


def trie_arrays(model: Model, columns: list[np.ndarray], n: np.ndarray, counts) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """All levels of a trie; its contexts, their counts and widths."""
    span, log = np.int64(model.words + 1), lambda p: np.log10(np.maximum(p, 1e-18))
    first = np.flatnonzero(np.append(True, np.diff(columns[0]) != 0))
    node, total = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(n)))), np.add.reduceat(n, first)
    context, word = columns[0][first] // span, columns[0][first] % span
    distinct, start = np.unique(context, return_index=True)
    ends, of = np.append(start, len(first)), counts(distinct)
    rank = np.repeat(np.arange(len(distinct)), np.diff(ends))
    arrays = ef.named("context", ef.encode(distinct, model.words + 1)) | ef.named("pointer2", ef.encode(ends, len(first) + 1))
    arrays |= ef.named("word2", ef.encode(rank * span + word, len(distinct) * int(span))) | ef.named("log2", ef.quantised(log((total - model.discount) / of[rank]), QUANTUM))
    for level in range(3, model.order + 1):
        inside = np.flatnonzero(columns[level - 2] != model.words)
        columns, node, n = [c[inside] for c in columns], node[inside], n[inside]
        first = np.flatnonzero(np.append(True, (np.diff(node) != 0) | (np.diff(columns[level - 2]) != 0))) if len(n) else inside
        above, words = node[first], columns[level - 2][first]
        own = np.add.reduceat(n, first) if len(n) else n
        pointer = np.append(0, np.cumsum(np.bincount(above, minlength=len(total))))
        arrays |= ef.named(f"rest{level - 1}", ef.quantised(log(np.maximum(np.diff(pointer), 1) * model.discount / total), QUANTUM))
        arrays |= ef.named(f"pointer{level}", ef.encode(pointer, len(first) + 1)) | ef.named(f"word{level}", ef.pack(words, model.words + 1))
        arrays |= ef.named(f"log{level}", ef.quantised(log((own - model.discount) / total[above]), QUANTUM))
        node, total = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(n)))), own
    return arrays, distinct, of, np.diff(ends)


def build_tries(grams: DataFrame, model: Model, partitions: int) -> DataFrame:
    """Writes the stores; (store, context, width), a line for each store (context
    -1) and for each context in it that is spread over several tries."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, open_store, out, lines = Levels.of(model), None, None, []

        def tries() -> Iterator[tuple[int, int, list[bytes]]]:
            key, held = None, []
            for batch in batches:
                for store, trie, data in zip(batch.column("store").to_pylist(), batch.column("trie").to_pylist(), batch.column("rows"), strict=True):
                    if key != (store, trie) and held:
                        yield *key, held
                        held = []
                    key = (store, trie)
                    held.append(data.as_py())
            if held:
                yield *key, held

        for store, trie, data in tries():
            if store != open_store:
                if out:
                    out.close()
                open_store, out = store, ef.Writer(f"{model.uri}/store-{store}")
                lines.append((store, -1, 0))
            parts = [grown(x, model.order) for x in data]
            data.clear()
            *columns, n = (np.concatenate(c) for c in zip(*parts, strict=True))
            parts.clear()
            columns, n = summed(columns, n)
            arrays, context, of, width = trie_arrays(model, columns, n, levels.counts)
            out.add({f"{trie}/{k}": v for k, v in arrays.items()})
            wide = np.flatnonzero(model.pieces(of) > 1)
            lines += zip([store] * len(wide), context[wide].tolist(), width[wide].tolist(), strict=True)
        if out:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in lines], pa.int64()) for i in range(3)], names=["store", "context", "width"])

    return grams.repartition(max(1, min(model.stores, max(partitions, model.tries // 16))), "store").sortWithinPartitions("store", "trie").mapInArrow(each, "store long, context long, width long")


def write_spread(lines: DataFrame, uri: str) -> None:
    """The stores there are and the contexts in several tries, in one file (a
    few lines a trie)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches), pa.schema([("store", pa.int64()), ("context", pa.int64()), ("width", pa.int64())]))
        store, context, width = (t.column(c).to_numpy() for c in t.column_names)
        keys, at = np.unique(context[context >= 0], return_inverse=True)
        ef.write(f"{uri}/spread", {"stores": np.unique(store), "context": keys, "width": np.bincount(at, width[context >= 0], len(keys)).astype(np.int64)})
        yield pa.RecordBatch.from_arrays([pa.array([len(keys)], pa.int64())], names=["n"])

    # Only the lines are moved: coalesce would build all stores in one task.
    lines.repartition(1).mapInArrow(each, "n long").collect()


def train(docs: DataFrame, order: int = ORDER, discount: float = DISCOUNT) -> Model:
    """Counts ``docs`` and writes the model's levels (``order``, two at least) to
    the shared folder."""
    import pyarrow.fs as pafs

    spark = docs.sparkSession
    uri = f"{shared_dir(spark)}/lm-{uuid.uuid4().hex}"
    uri = uri if "://" in uri or uri.startswith("file:") else f"file://{uri}"
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = uri.replace("file:", "file://", 1)
    if order < 2:
        raise ValueError("the order is two at least")
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(path)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = checkpointed(count_words(docs))
    total = counts.agg(F.count("*").alias("words"), F.sum("n").alias("tokens")).first()
    ends = counts.where(F.col("hash") == xxhash.xxh64_intdigest(END) - (1 << 64 if xxhash.xxh64_intdigest(END) >> 63 else 0)).first()
    if total["words"] > MAX_WORDS:
        raise OverflowError(f"more than {MAX_WORDS} different words")
    bits = max(LEAST_FILES.bit_length() - 1, (total["words"] // LEVEL1_WORDS).bit_length())
    made = {r["file"]: r["words"] for r in build_words(counts, uri, bits, partitions).collect()}
    offsets = np.concatenate([[0], np.cumsum([made.get(k, 0) for k in range(1 << bits)])])
    tokens = total["tokens"] or 0
    tries = max(LEAST_FILES, tokens // TRIE_TOKENS)
    model = Model(uri, order, bits, tuple(offsets.tolist()), tokens, total["words"], ends["n"] if ends else 0, tries, max(1000, tokens // (4 * tries)), discount)
    write_spread(build_tries(count_grams(docs, model), model, partitions), uri)
    return model


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of every row."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = Levels.of(model)
        for rows, words, sizes in blocks(batches):
            ids, counts, starts = places(levels, words, sizes)
            unigram = (counts + 1) / (model.tokens + model.words + 1)
            before, of = np.roll(ids, 1), np.roll(counts, 1)
            before[starts], of[starts] = model.words, model.documents
            known = np.flatnonzero((before >= 0) & (of > 0))
            # Each different pair is searched once; pairs are in order, so that
            # neighbours in a trie are searched after one another.
            span = np.int64(model.words + 2)
            key, at, pair = np.unique(before[known] * span + ids[known] + 1, return_index=True, return_inverse=True)
            seen, width, tries, found = levels.second(key // span, of[known[at]], key % span - 1)
            weight = np.where(width > 0, model.discount * width / of[known[at]], 1.0)
            p = unigram.copy()
            p[known] = seen[pair] + weight[pair] * unigram[known]
            file, place = np.zeros(len(ids), np.int64), np.full(len(ids), -1, np.int64)
            file[known], place[known] = tries[pair], found[pair]
            for level in range(3, model.order + 1):
                # What was found for the token before is the context now.
                file, context = np.roll(file, 1), np.roll(place, 1)
                context[starts] = -1
                known, place = np.flatnonzero(context >= 0), np.full(len(ids), -1, np.int64)
                seen, weight, place[known] = levels.deeper(level, file[known], context[known], ids[known])
                p[known] = seen + weight * p[known]
            sums = [np.add.reduceat(x, starts) for x in ((counts > 0).astype(np.int64), np.log10(unigram), np.log10(p))]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(sizes + 1, pa.int64()), *map(pa.array, sums)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(each, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def op8_elias_fano_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = id_remainder(F.col("doc_id"), FOLDS) == HELD_OUT
    model = train(docs.where(~held_out))
    return score_texts(docs, model).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
