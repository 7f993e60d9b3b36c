"""Spelling variants, language identification and hard negatives against brute
force, and on hard inputs."""

from __future__ import annotations

import collections
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from isohyet.llm import op11_spelling as q11
from isohyet.llm import op12_language_id as q12
from isohyet.llm import op13_hard_negatives as q13

SF = "/root/testdata/sf0.001"
CLASHES = "word n n_near best form root lang_pred score gram row mask pivot key block chunk query window place"
RUN = re.compile("[A-Za-zÀ-ÿ]+")


def with_clashes(df):
    return df.withColumns({c: F.lit(c) for c in CLASHES.split()} | {"a.b": F.lit(1)})


def edit_one(a, b):
    """By definition: all strings at one edit over the letters of the other."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_words(rows, least=5, min_count=3, damage=97):
    n = collections.Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            word = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % damage == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= least:
                n[word] += 1
    return {w: k for w, k in n.items() if k >= min_count}


def brute_variants(n, ratio=2):
    near = {w: [x for x in n if edit_one(w, x)] for w in n}
    form = {w: (min(near[w], key=lambda x: (-n[x], x)) if near[w] else None) for w in n}
    form = {w: f if f and n[f] >= ratio * n[w] else None for w, f in form.items()}
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (n[w], len(near[w]), form[w], n.get(form[w]), root)
    return out


def variants(df):
    return {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in df.collect()}


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(5)
    words = ["straße", "façade", "Über", "stone", "stones", "ston", "atone", "alone", "ALONE", "loner", "ÉCOLE", "école", "ecole", "x", "don't", "naïve", "naive", "a1b2", "中文", "😀", "×÷×÷×"]
    texts = [None, "", " \n", "stone", "z" * 50_000, "alone " * 30_000, *[" ".join(rng.choice(words) + rng.choice(["", "", "s", "e"]) for _ in range(rng.randint(1, 80))) for _ in range(60)]]
    return [(i, t) for i, t in zip([*range(len(texts) - 3), 7, 7, None], texts, strict=True)]


def test_tries_and_automata():
    rng = random.Random(1)
    for letters, size in (("abcé", 700), ("ab", 50), ("ab", 3)):
        words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(500)})
        ahead, back = [], []
        for out, rows in ((ahead, [(w, i + 1) for i, w in enumerate(words)]), (back, sorted((w[::-1], i + 1) for i, w in enumerate(words)))):
            out += [q11.Trie.read(q11.Trie.of(*map(list, zip(*rows[i : i + size], strict=True))).row()) for i in range(0, len(rows), size)]
        for w in [*words, "", "zz"]:
            want = {x: i + 1 for i, x in enumerate(words) if x != w and edit_one(w, x)}
            assert q11.neighbours(w, ahead, back) == want
            # Each neighbour is found in one shard of one direction only.
            assert sum(len(q11.neighbours(w, [t], [])) for t in ahead) + sum(len(q11.neighbours(w, [], [t])) for t in back) == len(want)


@pytest.mark.parametrize("damage", [97, 2])
def test_spelling_against_brute_force(spark, prose, damage):
    docs = with_clashes(spark.createDataFrame(prose, "doc_id long, text string")).repartition(3)
    counted = q11.count_words(docs, damage=damage, held=10)
    want = brute_words(prose, damage=damage)
    assert {r["word"]: r["n"] for r in counted.collect()} == want
    assert variants(q11.spelling_variants(counted)) == brute_variants(want)


def test_spelling_in_many_shards_and_groups(spark):
    rng = random.Random(9)
    n = {"".join(rng.choice("abé") for _ in range(rng.randint(5, 8))): rng.choice([3, 3, 5, 9, 40, 200, 1000]) for _ in range(400)}
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    want = brute_variants(n)
    assert max(len(collections.OrderedDict.fromkeys([w, f, r])) for w, (_, _, f, _, r) in want.items()) == 3  # chains
    assert variants(q11.spelling_variants(words, size=60, most=6000)) == want


def test_spelling_of_nothing(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    rows = q11.spelling_variants(q11.count_words(docs))
    assert rows.collect() == [] and set(rows.columns) == {"word", "n", "n_near", "form", "form_n", "root"}
    assert q11.spelling_variants(q11.count_words(docs.limit(0))).count() == 0


def test_spelling_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    n = brute_words(docs)
    got = variants(q11.op11_spelling_variants(spark, SF))
    assert {w: x[0] for w, x in got.items()} == n
    some = dict(random.Random(2).sample(sorted(n.items()), 150))
    for w in some:
        near = [x for x in n if abs(len(x) - len(w)) < 2 and x != w and edit_one(w, x)]
        best = min(near, key=lambda x: (-n[x], x)) if near else None
        assert got[w][1] == len(near) and got[w][2] == (best if best and n[best] >= 2 * n[w] else None)
        assert got[w][4] == (w if got[w][2] is None else got[got[w][2]][4])


# Language identification


def brute_grams(text):
    out = []
    chars = [c if c.isalpha() else "\0" for c in "\n" + text.lower() + "\n"]
    for n in q12.SIZES:
        for i in range(len(chars) - n + 1):
            if all(c != "\0" for c in chars[i + 1 : i + n - 1]):
                out.append((n, "".join(chars[i : i + n])))
    return out


def test_ngrams_against_brute_force():
    texts = ["", "a", "ab", "The Quick\x00brown", "x1y22zz", "ÀÉ 中文字 😀 ǅ", "  ", "don't stop", "İstanbul"]
    lowered = [t.lower() for t in texts]
    found, starts, letters = q12.grams(lowered)
    names = {}
    for k, t in enumerate(lowered):
        want = collections.Counter(brute_grams(t))
        got = collections.Counter()
        for n, (h, there) in zip(q12.SIZES, found, strict=True):
            own = h[starts[k] : starts[k + 1]][there[starts[k] : starts[k + 1]]]
            got.update((n, int(x)) for x in own)
        assert sorted(want.values()) == sorted(got.values())
        alone = q12.grams([t])[0]  # the same wherever the text stands
        assert got == collections.Counter((n, int(x)) for n, (h, there) in zip(q12.SIZES, alone, strict=True) for x in h[: len(t) + 1][there[: len(t) + 1]])
        for g in want:
            h, there = q12.grams([g[1].replace("\0", " ")])[0][q12.SIZES.index(g[0])]
            names.setdefault(g, set()).update(int(x) for x in h[there] if (g[0], int(x)) in got)
        assert letters[k] == sum(map(str.isalpha, t))


def test_long_texts_are_cut_at_spaces(monkeypatch):
    texts = ["one two three", "", "four five six seven eight", "nine", "x" * 70]
    whole = [sum(int(there.sum()) for _, there in q12.grams([t])[0]) for t in texts]
    monkeypatch.setattr(q12, "STRETCH", 10)
    sums = [0] * len(texts)
    for first, some in q12.stretches(texts):
        found, starts, _ = q12.grams(some)
        for _, there in found:
            for k in range(len(some)):
                sums[first + k] += int(there[starts[k] : starts[k + 1]].sum())
    assert sums[:4] == whole[:4] and "".join(t for _, some in q12.stretches(texts) for t in some) == "".join(texts)


def test_filters_have_no_false_negatives_and_count_right(spark):
    """70 languages (two slices), each with words of its own and shared ones."""
    rng = random.Random(4)
    own = {f"l{k:02d}": ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(15)] for k in range(70)}
    rows = [(i, " ".join(rng.choice(own[lang]) for _ in range(200)), lang) for i, lang in enumerate(own)]
    model = q12.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == sorted(own) and model.masks.shape[1] == 2 and 0 < model.false.max() < 0.01
    count = {lang: collections.Counter(brute_grams(t)) for _, t, lang in rows}
    total = {lang: sum(c.values()) for lang, c in count.items()}
    probe = " ".join(own["l03"][:3] + own["l66"][:2])
    hits, n, _ = model.counts([probe])
    grams = brute_grams(probe)
    assert n[0] == len(grams)
    for k, lang in enumerate(model.langs):
        exact = sum(count[lang][g] / total[lang] >= q12.RATIO * max(c[g] / total[x] for x, c in count.items()) and count[lang][g] > 0 for g in grams)
        assert exact <= hits[0, k] <= exact + 2
    assert model.decide(*model.counts([probe]))[0] == ["l03"]


def test_language_edges(spark):
    rows = [(None, "der die das und nicht", "de"), (1, "the and of not with", "en"), (2, None, "en"), (3, "the wind", None), (4, "", "fr"), (4, "", "fr")]
    docs = with_clashes(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    model = q12.train(docs)
    assert model.langs == ["de", "en"]
    ask = with_clashes(spark.createDataFrame([(1, None), (2, ""), (3, "12 - 34 !"), (4, "NICHT"), (5, "the"), (5, "the"), (None, "Ωω"), (8, "nicht " * 300_000)], "doc_id long, text string"))
    got = sorted(((r["doc_id"] or 0, r["lang_pred"], round(r["score"], 3)) for r in q12.identify(ask, model).collect()))
    assert got == [(0, "de", 0.0), (1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0), (4, "de", 1.0), (5, "en", 1.0), (5, "en", 1.0), (8, "de", 1.0)]
    assert q12.train(docs.limit(0)) is None
    assert {r["lang_pred"] for r in q12.identify(ask, None).collect()} == {"und"} and q12.identify(ask.limit(0), model).count() == 0


def test_language_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in q12.op12_bloom_language_id(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    held = [r for r in docs if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert sorted(r["doc_id"] for r in held) == sorted(i for i, r in got.items() if r["held_out"])
    asked = [r for r in held if r["lang"] and any(map(str.isalpha, r["text"] or ""))]
    assert np.mean([got[r["doc_id"]]["lang_pred"] == r["lang"] for r in asked]) >= 0.99
    assert all(0 <= r["score"] <= 1 for r in got.values())


# Hard negatives


def brute_negatives(rows, step=3, positives=5, negatives=5, scale=4):
    use = []
    for i, label, x in rows:
        if i is not None and label is not None and x is not None and all(v is not None and np.isfinite(v) for v in x):
            row = (i, label, tuple(int(np.floor(scale * v)) for v in x))
            if row not in use:
                use.append(row)
    score = lambda a, b: sum(p * q for p, q in zip(a, b, strict=False))
    out = []
    for i, label, x in use:
        if i % step:
            continue
        near = sorted((-score(x, y), j) for j, other, y in use if other == label and j != i)[:positives]
        for s, j in near:
            p = -s
            fit = sorted((-score(x, y), k) for k, other, y in use if other != label and 80 * p <= 100 * score(x, y) <= 100 * p)[:negatives]
            out += [(i, j, rank + 1, k, p, -t) for rank, (t, k) in enumerate(fit)]
    return sorted(out)


def mined(df):
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r[c] for c in names) for r in df.collect())


def vectors(kind):
    rng = np.random.default_rng(3)
    if kind == "ties":  # small integers: many equal scores and vectors
        return [(i, int(rng.integers(0, 3)), rng.integers(-2, 3, 3).astype(float).tolist()) for i in range(150)]
    if kind == "clusters":
        centre = rng.normal(size=(6, 8)) * 5
        return [(i, int(rng.integers(0, 4)), (centre[i % 6] + rng.normal(size=8)).tolist()) for i in range(240)]
    if kind == "copies":
        return [(i, i % 2 if i < 120 else 1, [1.0, 2.0, 3.0] if i % 3 else rng.normal(size=3).tolist()) for i in range(160)]
    bad = [(1, None, [1.0]), (None, 1, [1.0, 2.0]), (2, 1, None), (3, 1, [float("nan"), 1.0]), (6, 1, [float("inf")]), (9, 1, [None, 1.0])]
    some = [(0, 1, [1.0, 2.0]), (0, 1, [1.0, 2.0]), (12, 1, [1.0, 2.0, 3.0]), (15, 2, [1.0, 1.9]), (18, 2, [0.9, 2.0]), (21, 1, []), (24, 2, [-5.0, -5.0]), (15, 1, [2.0, 1.0])]
    return bad + some


@pytest.mark.parametrize("kind", ["ties", "clusters", "copies", "edges"])
@pytest.mark.parametrize("size", [7, 1024])
def test_hard_negatives_against_brute_force(spark, monkeypatch, kind, size):
    monkeypatch.setattr(q13.index, "__defaults__", (size,))
    monkeypatch.setattr(q13.chunked, "__defaults__", (size,))
    rows = vectors(kind)
    df = with_clashes(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).repartition(3)
    got, want = mined(q13.hard_negatives(df, F.col("vec_id") % 3 == 0, scale=4)), brute_negatives(rows)
    assert got == want
    if kind == "clusters":
        assert len(want) > 100


def test_hard_negatives_of_nothing(spark):
    df = spark.createDataFrame([(1, 1, [1.0])], "vec_id long, label int, embedding array<float>")
    assert mined(q13.hard_negatives(df, F.col("vec_id") % 100 == 0)) == []
    assert mined(q13.hard_negatives(df.limit(0), F.col("vec_id") % 100 == 0)) == []


def test_blocks_beyond_the_bound_are_not_read(spark):
    """Far clusters: a search reads a part of the blocks, all rows found."""
    rng = np.random.default_rng(8)
    rows = [(i, i % 5, (np.eye(8)[i % 8] * 100 + rng.normal(size=8)).tolist()) for i in range(4000)]
    base = q13.quantised(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), 4)
    sample = [bytes(r["vector"]) for r in base.select("vector").limit(200).collect()]
    space = q13.Space(8, base.agg(F.max("norm2")).first()[0], sample, 8)
    blocks = q13.index(base.select("vec_id", "label", "vector"), space, 50)
    queries = q13.chunked(base.where("vec_id % 100 = 0").select("label", "vector", "norm2").distinct(), space, 1)
    read = spark.sparkContext.accumulator(0)
    plain = q13.best_of

    def counting(*args):
        scan = plain(*args)

        def each(batches):
            for b in batches:
                read.add(b.num_rows)
                yield from scan([b])

        return each

    q13.best_of = counting
    try:
        wide = queries.select("query", F.array(F.lit(-q13.FAR)).alias("lows"), F.array(F.lit(q13.FAR)).alias("highs"))
        assert q13.search(queries, blocks, space, wide, True, 6).count() == 40 * 6
    finally:
        q13.best_of = plain
    assert 0 < read.value < 0.35 * 40 * blocks.count()
