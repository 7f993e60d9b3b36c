"""Toxicity by multiple-instance learning with a noisy-or.

A document is a bag of sentences. A sentence's probability is a logistic
function of the words in it and of their beginnings (so that inflected forms
count together), and the document's is the noisy-or of its sentences:
1 - prod(1 - p). Only documents have labels; maximising their likelihood teaches
the weights, and the sentences that explain a toxic document can then be located.

Learning is on a bounded sample (``SAMPLE`` documents of each label at most, in
the order of a hash of the id, one whole text an id), in one task; it returns a
table of at most ``FEATURES`` weights. Scoring is one pass of a partition-wise function
over all texts with those weights, without a shuffle.

Defined cases: a null or empty text has no sentence and score 0; documents
without label are scored like all others; a null doc_id counts as held out;
without labels of both kinds every score is 0; repeated rows give a row each;
other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, id_remainder, table

FOLDS, HELD_OUT = 5, 0
#: Labelled documents of each label, and features, that the model is fitted on.
SAMPLE, FEATURES, MIN_DOCS = 4000, 2000, 4
STEPS, RATE, L2 = 400, 0.1, 1e-4
#: Evidence (nats of the G test) that a feature must have.
MIN_GAIN = 8.0
BIAS = ""  # no feature is empty
#: Features: whole words, and beginnings of so many letters with a hyphen.
STEMS = (4, 5, 6)
SENTENCE, WORD = re.compile(r"[^.!?\n]+"), re.compile(r"[^\W\d_]+")


def sentences(text: str) -> Iterator[tuple[int, int, list[str]]]:
    for m in SENTENCE.finditer(text):
        words = WORD.findall(m[0].lower())
        if words:
            yield m.start(), m.end(), words


def features(words: list[str]) -> set[str]:
    return set(words).union(*({f"{w[:k]}-" for w in words if len(w) > k} for k in STEMS))


def choose_features(texts: list[str], labels: np.ndarray) -> list[str]:
    """Features whose presence differs most between the labels (G test)."""
    seen = [Counter(), Counter()]
    for text, y in zip(texts, labels, strict=True):
        seen[int(y)].update(set().union(*(features(words) for _, _, words in sentences(text))))
    n = [int((labels == 0).sum()), int((labels == 1).sum())]

    def g(word: str) -> float:
        both, score = (seen[0][word] + seen[1][word]) / (n[0] + n[1]), 0.0
        for k in (0, 1):
            for had, share in ((seen[k][word], both), (n[k] - seen[k][word], 1 - both)):
                score += had * math.log(had / (n[k] * share)) if had else 0.0
        return score

    gains = {w: g(w) for w in seen[0] | seen[1] if seen[0][w] + seen[1][w] >= MIN_DOCS}
    return sorted((w for w, x in gains.items() if x >= MIN_GAIN), key=lambda w: (-gains[w], w))[:FEATURES]


def fit(texts: list[str], labels: np.ndarray) -> dict[str, float]:
    """Weights of features, and of the bias, by Adam on the bags' likelihood."""
    vocabulary = choose_features(texts, labels)
    index = {w: i for i, w in enumerate(vocabulary)}
    doc_of, sent_of, word_of, plain = [], [], [], np.zeros(len(texts))
    for d, text in enumerate(texts):
        for _, _, words in sentences(text):
            known = sorted(index[w] for w in features(words) if w in index)
            if known:
                sent_of += [len(doc_of)] * len(known)
                word_of += known
                doc_of.append(d)
            else:
                plain[d] += 1
    doc_of, sent_of, word_of = (np.array(x, np.int64) for x in (doc_of, sent_of, word_of))
    w, b = np.zeros(len(vocabulary)), -6.0
    m1, m2 = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    weight = 1.0 / len(texts)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for step in range(1, STEPS + 1):
        z = b + np.bincount(sent_of, w[word_of], len(doc_of))
        strength = np.bincount(doc_of, np.logaddexp(0, z), len(texts)) + plain * np.logaddexp(0, b)
        # d loss / d strength: 1 for clean bags, -(1 - p) / p for toxic ones.
        pull = np.where(labels == 1, -1 / np.expm1(np.clip(strength, 1e-6, 50)), 1.0) * weight
        each = pull[doc_of] * sigmoid(z)
        slope = np.append(np.bincount(word_of, each[sent_of], len(w)) + L2 * w, each.sum() + (pull * plain).sum() * sigmoid(b))
        m1, m2 = 0.9 * m1 + 0.1 * slope, 0.999 * m2 + 0.001 * slope**2
        move = RATE * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return {BIAS: float(b), **{v: float(x) for v, x in zip(vocabulary, w.round(6), strict=True) if x}}


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict[str, float]:
    """The model, learned from labelled documents that are not held out."""
    usable = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).dropna().where(id_remainder(F.col("doc_id"), FOLDS) != HELD_OUT)
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id")
    chosen = usable.where("toxic = 1").orderBy(order, "doc_id").limit(sample).union(usable.where("toxic = 0").orderBy(order, "doc_id").limit(sample))
    # At most 2 * sample rows of two numbers: the bound of this broadcast.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", F.struct(F.xxhash64("text").alias("hash"), "text").alias("own"))
    # Rows that repeat an id are reduced before they are moved to one task.
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("own")["text"].alias("text"))

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = pd.concat([pd.DataFrame({"doc_id": [], "text": [], "toxic": []}), *batches]).sort_values(["doc_id", "text"], kind="stable")
        y = got["toxic"].to_numpy(dtype=np.int64)
        model = fit([t or "" for t in got["text"]], y) if 0 < y.sum() < len(y) else {}
        yield pd.DataFrame({"word": list(model), "weight": list(model.values())}, columns=["word", "weight"]).astype({"word": str, "weight": float})

    return {r["word"]: r["weight"] for r in rows.repartition(1).mapInPandas(learn, "word string, weight double").collect()}


def by_kind(model: dict[str, float]) -> list[tuple[int | None, dict[str, float]]]:
    """The weights of words (None) and of beginnings of each length."""
    stems = [(k, {f[:-1]: w for f, w in model.items() if f.endswith("-") and len(f) == k + 1}) for k in STEMS]
    return [(None, {f: w for f, w in model.items() if f != BIAS and not f.endswith("-")}), *stems]


def score(text: str, bias: float, kinds: list) -> tuple[float, list[dict]]:
    """Noisy-or over the sentences, and the offending ones."""
    strength, plain, found = 0.0, 0, []
    for start, end, tokens in sentences(text):
        z = bias
        for k, weights in kinds:
            known = weights.keys() & set(tokens if k is None else [t[:k] for t in tokens if len(t) > k])
            z += sum(map(weights.__getitem__, known))
        if z == bias:
            plain += 1
            continue
        s = max(z, 0.0) + math.log1p(math.exp(-abs(z)))
        strength += s
        if z >= 0:  # as likely offending as not
            found.append({"start": start, "end": end, "score": -math.expm1(-s)})
    strength += plain * math.log1p(math.exp(bias))
    return -math.expm1(-strength), found


def score_toxicity(docs: DataFrame, model: dict[str, float]) -> DataFrame:
    """All columns of ``docs`` plus toxicity (0 to 1) and offending (sentences
    as code point offsets with their probability), underscores added to these
    names if ``docs`` has them already."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    entry = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])
    names = free_name(docs, "toxicity"), free_name(docs, "offending")
    span = T.StructType().add("start", "integer").add("end", "integer").add("score", "double")
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.ArrayType(span))])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        kinds = by_kind(model)
        for batch in batches:
            got = [score(t.as_py() or "", model[BIAS], kinds) if model else (0.0, []) for t in batch.column("text")]
            columns = [*batch.columns, pa.array([x for x, _ in got], pa.float64()), pa.array([x for _, x in got], pa.list_(entry))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *names])

    return docs.mapInArrow(each, schema)


def op7_noisy_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = score_toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
    held_out = id_remainder(F.col("doc_id"), FOLDS) == HELD_OUT
    return rows.select("doc_id", held_out.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"), F.to_json("offending").alias("offending"))
