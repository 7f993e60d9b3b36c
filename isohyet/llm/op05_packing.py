"""Cost-balanced packing of tokenised documents into fixed-length sequences.

A document is its token ids and an end id. Within a block of documents, whole
stretches of ``capacity`` ids become sequences of their own; what remains of
each document is assigned, longest first, to the sequence of lowest cost that
still has room, where a piece costs ``linear * n + quadratic * n * n``
(attention is within pieces). Sequences of a block have together exactly as
many places as it has ids: as many full ones as fit, and powers of two for the
rest, so nothing is padded. A piece that fits nowhere whole is cut.

One pass over the input, no shuffle: a block is a run of rows of one input
partition, bounded by ``BLOCK_DOCS`` and ``BLOCK_TOKENS``, so that a task holds
one block at a time and a lost executor's partitions are simply read again.
``sequence_id`` holds the partition in its upper bits.

Ids are those of ``tokenizers``. A space that touches no other white space
always starts a new token of a byte-level vocabulary, so texts are cut there and
the ids of the stretches kept in a bounded table. Other texts, and those that
hold the name of an added token, are encoded whole.

Defined cases: a null or empty text is its end id alone; repeated rows are
packed each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, table

CAPACITY, END_ID = 2048, 1
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
BLOCK_DOCS, BLOCK_TOKENS = 4096, 1 << 22
CACHED, CACHED_CHARS = 200_000, 48
#: White space, as Arrow's regular expressions have it.
BLANK = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
#: Texts that are cut and encoded at a time.
GROUP_DOCS, GROUP_BYTES = 1024, 2 << 20
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
#: Fixed value: how byte-level vocabularies cut a text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: For each vocabulary file its tokenizer and two tables of known stretches: the
#: used ones, and those used before.
_encoders: dict[str, tuple] = {}


def byte_of_char() -> dict[str, int]:
    """The character by which a byte-level vocabulary shows each byte: itself
    if it is visible, else the next free one from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


def stretch_encoder(path: str, tok):
    """Ids of one stretch. A vocabulary whose merges are in the order of their
    ids is the same by ranks, which takes a third of the time; any other is left
    to ``tokenizers``."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    shown, vocab = byte_of_char(), model["vocab"]
    merged = [vocab.get("".join(m if isinstance(m, list) else m.split(" ")), -1) for m in model["merges"]]
    if any(b <= a for a, b in zip(merged, merged[1:])) or any(c not in vocab or vocab[c] >= merged[0] for c in shown):
        return lambda text: tok.encode(text, add_special_tokens=False).ids
    import tiktoken

    special = {t.content for t in tok.get_added_tokens_decoder().values()}
    ranks = {bytes(shown[c] for c in t): i for t, i in vocab.items() if t not in special}
    return tiktoken.Encoding("stretches", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def encoder(path: str | None):
    """A function from texts to their ids, as little-endian 32-bit bytes."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    if path not in _encoders:  # kept for as long as the worker lives
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        _encoders[path] = tok, stretch_encoder(path, tok), [{}, {}]
    tok, one, tables = _encoders[path]
    added = "".join(f"|{re.escape(t.content)}" for t in tok.get_added_tokens_decoder().values())
    mixed, plain = rf" {BLANK}|{BLANK} |\x00{added}", re.compile(r" ?\S+").fullmatch
    feed = tok.encode("\n").ids[0]

    def fresh(parts: set[str]) -> dict[str, bytes]:
        """Ids of stretches. Those without a line feed go through as lines of
        one text, which is cut at the ids of the line feeds."""
        words = list(filter(plain, parts))
        out = {p: np.array(one(p), "<u4").tobytes() for p in parts.difference(words)}
        for i in range(0, len(words), 2000):
            ids = np.array(one("\n".join(words[i : i + 2000])), "<u4")
            cuts, data = (4 * np.flatnonzero(ids == feed)).tolist(), ids.tobytes()
            pieces = [data[a:b] for a, b in zip([0, *(c + 4 for c in cuts)], [*cuts, len(data)], strict=True)]
            out.update(zip(words[i : i + 2000], pieces, strict=True))
        return out

    def encode(texts: list[str]) -> list[bytes]:
        whole = pc.match_substring_regex(pa.array(texts, pa.large_string()), mixed).to_pylist()
        parts = [[] if w else t.replace(" ", "\x00 ").split("\x00") for t, w in zip(texts, whole, strict=True)]
        used, old = tables
        new = set().union(*parts).difference(used)
        used.update({p: old[p] for p in new.intersection(old)})
        used.update(fresh(new.difference(old)))
        entire = iter(tok.encode_batch_fast([t for t, w in zip(texts, whole, strict=True) if w], add_special_tokens=False))
        out = [np.array(next(entire).ids, "<u4").tobytes() if w else b"".join(map(used.__getitem__, p)) for p, w in zip(parts, whole, strict=True)]
        if len(used) > CACHED:  # what was not used since the last time goes
            tables[:] = {}, {k: v for k, v in used.items() if len(k) <= CACHED_CHARS}
        return out

    return encode


def pack(lengths: np.ndarray, capacity: int = CAPACITY, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of all pieces of documents
    of the given lengths. Sequences count from 0 and are filled to the end."""
    pieces, rest, n = [], [], 0
    for doc, length in enumerate(lengths.tolist()):
        for start in range(0, length - capacity + 1, capacity):
            pieces.append((doc, start, capacity, n, 0))
            n += 1
        if length % capacity:
            rest.append((length % capacity, doc, length - length % capacity))
    rest.sort(key=lambda x: (-x[0], x[1]))
    places = sum(x[0] for x in rest)
    tail = places % capacity
    room = np.array([capacity] * (places // capacity) + [1 << b for b in reversed(range(tail.bit_length())) if tail >> b & 1], np.int64)
    size, cost = room.copy(), np.zeros(len(room))
    for length, doc, start in rest:
        while length:
            fits = np.flatnonzero(room >= length)
            at = int(fits[np.argmin(cost[fits])]) if len(fits) else int(np.argmax(room))
            part = min(length, int(room[at]))
            pieces.append((doc, start, part, n + at, int(size[at] - room[at])))
            room[at] -= part
            cost[at] += linear * part + quadratic * part * part
            start, length = start + part, length - part
    return pieces


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """All pieces of all documents, with their ids as little-endian bytes."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, number = encoder(path), TaskContext.get().partitionId() << 40
        ids: list = []
        tokens: list[bytes] = []
        held = 0

        def block() -> pa.RecordBatch:
            nonlocal number, held
            pieces = pack(np.array([len(t) // 4 for t in tokens], np.int64), capacity)
            doc, start, length, seq, offset = (np.array(x, np.int64) for x in zip(*pieces, strict=True))
            cut = [tokens[d][4 * s : 4 * (s + n)] for d, s, n in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)]
            total = np.array([len(t) // 4 for t in tokens], np.int64)[doc]
            out = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(cut, pa.binary()), pa.array(total), pa.array(seq + number), pa.array(offset)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
            number += int(seq.max()) + 1
            ids.clear(), tokens.clear()
            held = 0
            return out

        give_back()
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            texts = pc.fill_null(batch.column("text").cast(pa.large_string()), "")
            ends, at = np.cumsum(pc.binary_length(texts).to_numpy()), 0
            while at < batch.num_rows:
                # Many texts at once have few different stretches for their size.
                upto = max(at + 1, min(at + GROUP_DOCS, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + GROUP_BYTES, "right"))))
                new = [t + end for t in encode(texts.slice(at, upto - at).to_pylist())]
                ids += batch.column("doc_id").slice(at, upto - at).to_pylist()
                tokens += new
                held += sum(map(len, new)) // 4
                at = upto
                if len(tokens) >= BLOCK_DOCS or held >= BLOCK_TOKENS:
                    yield block()
        if tokens:
            yield block()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(packed, SCHEMA)


def with_digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_cost_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_digest(pack_documents(table(spark, sf_dir, "documents")))
