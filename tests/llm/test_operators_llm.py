"""The training-data operators against brute force, and on hard inputs."""

from __future__ import annotations

import collections
import hashlib
import html
import math
import random
import re
import textwrap
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isohyet.llm import common, elias_fano as ef
from isohyet.llm import op01_quality as q1
from isohyet.llm import op02_decontaminate as q2
from isohyet.llm import op03_html as q3
from isohyet.llm import op04_pii as q4
from isohyet.llm import op05_packing as q5
from isohyet.llm import op06_sharding as q6
from isohyet.llm import op07_toxicity as q7
from isohyet.llm import op08_language_model as q8
from isohyet.llm import op09_simhash as q9
from isohyet.llm import op10_licenses as q10
from isohyet.llm import registry

SF = "/root/testdata/sf0.001"
CLASHES = "place size shard total words hashes score toxicity offending pii spans fp component part before row unit digest key hit items length start"
SPACE = re.compile(r"[\x20\x09-\x0d]+")


def words(text):
    return [w for w in SPACE.split(text or "") if w]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    vocabulary = ["the", "of", "Über", "é", "x", "moron", "42", "a.b@c.de", "+1 (555) 555-0100", "4111 1111 1111 1111", "10.0.0.256", "10.0.0.255", "\t", "\n", "中文", "😀", "The"]
    made = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    repeated = "one two three four five six seven eight nine ten\n"
    return [None, "", " \n\t ", "word", "The Quick\x00brown", repeated * 4, "é" * 5000, "ab " * 40000, "1" * 30000, "a@" * 5000, "a@b" + ".c" * 20000, made[0], made[0], *made]


@pytest.fixture(scope="module")
def docs(spark, texts):
    """Nulls, blanks, very long runs, repeated rows, a null id, other columns."""
    ids = [*range(len(texts) - 2), 5, None]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
    df = spark.createDataFrame([(i, t, None, "s", len(t or "")) for i, t in zip(ids, texts)], schema)
    return df.withColumns({c: F.lit(c) for c in CLASHES.split()}).repartition(3).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def multiset(items):
    return collections.Counter(items)


# 1 quality -------------------------------------------------------------------
def base_rules(text):
    ws = words(text)
    counts = collections.Counter(tuple(ws[i : i + 8]) for i in range(len(ws) - 7))
    inside = {j for i in range(len(ws) - 7) if counts[tuple(ws[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    failed = len(ws) < 20 or 100 * len(inside) > 30 * len(ws)
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside), failed


def test_quality(spark, docs, rows, none, monkeypatch):
    trusted = spark.createDataFrame([(i,) for i in range(0, 40, 2)] + [(None,)], "doc_id long")
    got = q1.score_quality(docs, trusted).collect()
    key = lambda r: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
    assert multiset((r.doc_id, *key(r)) for r in got) == multiset((i, *base_rules(t)) for i, t in rows)
    assert not any(r.kept for r in got if r.base_failed) and all(r.kept == (r.llr >= q1.THRESHOLD) for r in got if not r.base_failed)
    monkeypatch.setattr(q1, "MAX_BROADCAST_IDS", 0)  # the way without a broadcast
    assert multiset(map(tuple, q1.score_quality(docs, trusted).collect())) == multiset(map(tuple, got))
    monkeypatch.undo()
    assert q1.score_quality(none, trusted).count() == 0
    assert all(r.llr == 0 for r in q1.score_quality(docs.limit(9), trusted.limit(0)).collect())


def test_quality_ratio(spark):
    df = spark.createDataFrame([(i, "good text here " * 9 if i % 2 else "bad %%% stuff " * 9) for i in range(20)], "doc_id long, text string")
    got = {r.doc_id: r.llr for r in q1.score_quality(df, df.where("doc_id % 2 = 1").select("doc_id"), buckets=512).collect()}
    grams = lambda t: [g for a, b in zip(words(t), [*words(t)[1:], None]) for g in (a, (a, b))]
    good, bad = grams("good text here " * 9), grams("bad %%% stuff " * 9)
    target, raw = collections.Counter(good * 10), collections.Counter((good + bad) * 10)
    ratio = lambda g: math.log((target[g] + 1) / (sum(target.values()) + 512) / ((raw[g] + 1) / (sum(raw.values()) + 512)))
    for i, t in ((1, good), (0, bad)):
        assert got[i] == pytest.approx(sum(map(ratio, t)) / len(t), abs=1e-4)


# 2 decontamination -----------------------------------------------------------
def contamination(text, items):
    ws = q2.words_of(text)
    hit, found = set(), set()
    for item, it in items:
        iw = q2.words_of(it)
        for k in range(max(1, len(iw) - 12) if iw else 0):
            win = iw[k : k + 13]
            for i in range(len(ws) - len(win) + 1):
                if ws[i : i + len(win)] == win:
                    hit |= set(range(i, i + len(win)))
                    found.add(str(item))
    return len(ws), len(hit), tuple(sorted(found))


@pytest.mark.parametrize("limit", [10**6, 3])
def test_contamination(spark, none, monkeypatch, limit):
    monkeypatch.setattr(q2, "MAX_FILTER", limit)
    rng = random.Random(1)
    say = lambda n: [rng.choice("alpha beta gamma delta The of é".split()) for _ in range(n)]
    items = [(1, " ".join(say(20))), (2, " ".join(say(13))), (3, "short item"), (4, "Gamma"), (5, None), (6, "!!"), (10, " ".join(say(30)))]
    items.append((7, items[0][1].upper().replace("É", "é")))
    texts = [None, "", "gamma", "a short, item. b", *(" ".join([*say(9), *(t or "").split()[a : a + 16], *say(9)]) for _, t in items for a in (0, 2)), " ".join(say(300))]
    d = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)], "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit(1))
    got = multiset((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in q2.find_contamination(d, b).collect())
    assert got == multiset((i // 2, *contamination(t, items)) for i, t in enumerate(texts))
    assert q2.find_contamination(none, b).count() == 0
    assert all(r.n_hit == 0 for r in q2.find_contamination(d, b.limit(0)).collect())


# 3 html ----------------------------------------------------------------------
PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="home"><!-- c --><nav><ul><li><a href="/a">Menu</a></li></ul></nav>
<div class="ad">Buy this now, really.</div><div id="cookie-notice">We use cookies, accept them.</div><aside>Side words</aside>
<article><h1>A &amp; B</h1><p>One  two<br>three.<p><b>Four, five</b> six &#8212; seven.</p><script>var x = "</p>";</script><ul><li>item one, and more of it.</li></ul></article>
<section class="comments"><p>A reader writes, at length, about it.</p></section><form><label>Name</label><input></form><footer>&copy; x</footer></body></html>"""


def test_html(spark):
    want = "A & B\n\nOne two three.\n\nFour, five six — seven.\n\nitem one, and more of it."
    assert q3.main_text(PAGE) == want
    assert q3.main_text(None) == q3.main_text("") == q3.main_text("<nav>x</nav>") == ""
    assert q3.main_text("plain < text") == "plain < text" and q3.main_text("<p>cut <b") == "cut"
    assert q3.main_text("<p>" + "<div>" * 3000 + "deep, deep text.") == "deep, deep text."
    df = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (None, None, None)], "page_id long, url string, html string").withColumn("text", F.lit("x"))
    got = q3.extract(df).collect()
    assert [r.text for r in got].count(want) == 2 and len(got) == 3
    assert q3.extract(df.limit(0)).count() == 0


def test_html_articles(spark):
    """Pages of the test tables whose article is marked as such."""
    inline = re.compile(r"</?(?:b|i|em|strong|a|span|br)\b[^>]*>")
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        body = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S)[1]
        parts = [" ".join(html.unescape(inline.sub(" ", x)).split()) for x in re.split(r"</?(?:p|h\d|div|ul|li)\b[^>]*>", body)]
        assert q3.main_text(r.html) == "\n\n".join(filter(None, parts))


def test_html_ratios_decide(spark):
    """Without any mark, and without roles at all; the share right is of the
    method alone. Another threshold selects other paths."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    want = [q3.main_text(x) for x in pages]
    alone = [q3.main_text(x, roles=None) for x in pages]
    assert np.mean([a == b for a, b in zip(alone, want)]) >= 0.9
    assert [q3.main_text(x, 0.2, None) for x in pages] != alone != [q3.main_text(x, 1.0, None) for x in pages]
    marks = q3.MARKS
    try:
        q3.MARKS = frozenset()
        assert np.mean([q3.main_text(x) == y for x, y in zip(pages, want)]) >= 0.9
    finally:
        q3.MARKS = marks


def test_html_unmarked_boilerplate():
    body = "<p>A long paragraph, with much to say; it goes on, and on.</p>" * 4
    teaser = "<div><p>Short teaser.</p></div>"
    text = "\n\n".join(["A long paragraph, with much to say; it goes on, and on."] * 4)
    assert q3.main_text(f"<body><div id=a>{body}</div>{teaser}{teaser}</body>") == text
    assert q3.main_text(f"<body>{teaser}<article>{body}</article>{teaser}</body>") == text
    # No article is lost for its class, and states are no marks.
    assert q3.main_text(f'<body class="single has-sidebar"><article class="post share-enabled">{body}</article></body>') == text
    # Cards in articles do not outweigh the text beside them.
    card = "<article class=card><a>More.</a></article>"
    assert q3.main_text(f"<body><div class=text>{body}</div>{card}</body>") == text
    assert q3.main_text(f"<article>{body}<div class=comments><p>A long comment, by a reader; it goes on.</p></div></article>") == text
    assert q3.main_text("<article><p>x, y.</p><figure><img><figcaption>Seen.</figcaption></figure></article>") == "x, y.\n\nSeen."
    assert q3.main_text('<div data-x="hidden words"><p>x</p></div>') == "x" and q3.main_text("<p hidden>x</p>") == ""


@pytest.mark.parametrize("page", ["<div>some text. " * 20000, "<b>x</b>" * 100_000, "<a '" * 50_000, '<p class="' * 50_001])
def test_html_linear(page):
    began = time.process_time()
    q3.main_text(page)
    assert time.process_time() - began < 5


@pytest.mark.parametrize("page", ["<i>" * 30_000 + "</b>" * 30_000, "<div>" * 30_000 + "</p>x" * 30_000, "<div>" + "<i><p>" * 15_000, ("<div>" + "<i>" * 50) * 600])
def test_html_stray_tags_linear(page):
    began = time.process_time()
    q3.main_text(page)
    assert time.process_time() - began < 2


# 4 personal data -------------------------------------------------------------
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(len(p.lstrip("0")) < 4 and int(p[-9:]) < 256 for p in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            out += [(kind, m.start(), m.end())] if ok else []
    return out


def spans_found(df):
    got = q4.find_pii(df).select("doc_id", "text", F.col(common.free_name(df, "pii")).alias("p")).collect()
    return [(r.doc_id, r.text, [(k, s.start, s.end) for k in q4.BASE for s in r.p[k]], [(k, s.start, s.end) for k in q4.ADDED for s in r.p[k]]) for r in got]


def test_pii_base(spark, docs, none):
    rng = random.Random(5)
    bits = ["a", "B9", "@", ".", "..", "@@", " ", "-", "+", "1", "25", "255", "256", "000", "(", ")", "_", "%", "é", "\n", "4111111111111111", "x.y", "12345678901"]
    made = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 40))) for _ in range(600)]
    extra = spark.createDataFrame([(i, t) for i, t in enumerate(made)], "doc_id long, text string")
    for df in (docs.where("length(text) < 20000 or text is null"), extra):
        for i, text, base, _ in spans_found(df):
            assert base == base_spans(text), text[:200]
    assert len(spans_found(docs)) == docs.count() and spans_found(none) == []


def test_pii_added_and_masked(spark):
    text = "Konto DE89370400440532013000 und DE89370400440532013001, SSN 078-05-1120 id 078-05-1121x; token = \"" + "ab12" * 10 + "\" mail x.y@z.org at 1.2.3.4"
    df = spark.createDataFrame([(1, text), (2, "ééé a@b.cd"), (3, None)], "doc_id long, text string")
    (_, _, base, added), *_ = spans_found(df)
    assert [(k, text[a:b]) for k, a, b in added] == [("iban", "DE89370400440532013000"), ("ssn", "078-05-1120"), ("ssn", "078-05-1121"), ("secret", "ab12" * 10)]
    out = [r[0] for r in q4.find_pii(df).select(F.when(F.col("text").isNotNull(), q4.masked(F.col("text"), F.col("pii")))).collect()]
    want = text
    for k, a, b in sorted([*base, *added], key=lambda x: -x[1]):
        want = want[:a] + f"<{k.upper()}>" + want[b:]
    assert out == [want, "ééé <EMAIL>", None]


# 5 packing -------------------------------------------------------------------
def test_packing(docs, rows, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = q5.pack_documents(docs).collect()
    pieces = collections.defaultdict(list)
    for r in got:
        pieces[r.sequence_id].append((r.offset, r.length, len(r.ids) // 4))
    for p in pieces.values():
        p.sort()
        assert [o for o, _, _ in p] == [sum(n for _, n, _ in p[:i]) for i in range(len(p))] and all(n == m > 0 for _, n, m in p)
        total = sum(n for _, n, _ in p)
        assert total == 2048 or total < 2048 and total & (total - 1) == 0
    want = multiset(np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for _, t in rows)
    whole, parts = collections.Counter(), sorted(got, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.start))
    for i in {r.doc_id for r in parts}:
        own = [r for r in parts if r.doc_id == i]
        if sum(1 for r in own if r.start == 0) == 1:  # ids that rows repeat are counted below
            whole[b"".join(r.ids for r in own)] += 1
            assert own[0].doc_tokens * 4 == sum(len(r.ids) for r in own)
    assert not whole - want and sum(len(r.ids) for r in got) == sum(len(k) * n for k, n in want.items())
    assert q5.pack_documents(none).count() == 0


def test_encoding_is_exact():
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode, rng = q5.encoder(None), random.Random(2)
    bits = [" ", "  ", "\n", " \n", "\n\n", "\t", "'s", "n't", "a", "Bc", "é", "中", "12", ".", "!!", "<|endoftext|>", "\x00", "\x1c", "\x85", "_", "-", "😀", "\r\n", " "]
    for _ in range(1500):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert encode([t])[0] == np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), repr(t)


def test_pack_balances():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 6000, 500)
    pieces = q5.pack(lengths)
    cost = collections.Counter()
    for _, _, n, seq, _ in pieces:
        cost[seq] += q5.LINEAR * n + q5.QUADRATIC * n * n
    size = collections.Counter()
    for _, _, n, seq, _ in pieces:
        size[seq] += n
    mixed = [cost[s] for s in size if size[s] == 2048 and sum(1 for p in pieces if p[3] == s) > 1]
    assert sum(size.values()) == lengths.sum() and np.std(mixed) / np.mean(mixed) < 0.25
    assert q5.pack(np.array([], np.int64)) == []


# 6 sharding ------------------------------------------------------------------
def test_shards(spark, docs, rows, none):
    got = q6.assign_shards(docs).collect()
    assert multiset((r.doc_id, r["size"], r.text_crc32) for r in got) == multiset((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [(r.doc_id is not None, r.doc_id or 0) for r in order] == sorted((r.doc_id is not None, r.doc_id or 0) for r in got)
    same = spark.range(4000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("hot text").alias("text"))
    sizes = [r["sum(size)"] for r in q6.assign_shards(same).groupBy("shard").sum("size").collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 2 * 9
    assert q6.assign_shards(none).count() == 0


# 7 toxicity ------------------------------------------------------------------
def test_toxicity(spark, docs, none):
    rng = random.Random(4)
    plain = [f"w{i}" for i in range(50)]
    plain = ["alpha", "beta", "gamma", "delta", "words", "other", "thing", "place", "under", "water"]
    bad = ["vilefoo", "vilebar", "vilebaz", "vilequx"]

    def say(toxic):
        s = [[rng.choice(plain) for _ in range(8)] for _ in range(rng.randint(1, 6))]
        if toxic:
            rng.choice(s).insert(3, rng.choice(bad))
        return ". ".join(" ".join(x) for x in s) + "."

    y = [int(rng.random() < 0.3) for _ in range(800)]
    d = spark.createDataFrame([(i, say(t)) for i, t in enumerate(y)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(y)] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    model = q7.train(d, labels.where("toxic is not null"))
    got = {r.doc_id: r for r in q7.score_toxicity(d, model).collect()}
    held = [i for i in range(800) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i].toxicity >= 0.5) == y[i] for i in held]) > 0.97
    for r in got.values():
        spans = [r.text[s.start : s.end] for s in r.offending]
        assert all("vile" in s for s in spans) and (r.toxicity >= 0.5) == bool(spans)
    # Labels of held-out rows change nothing.
    other = labels.where("toxic is not null").withColumn("toxic", F.when(common.id_remainder(F.col("doc_id"), 5) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert q7.train(d, other) == model
    # Rows that repeat an id, or label it twice, are one example.
    twice = labels.where("toxic is not null").union(labels.where("toxic = 1").withColumn("toxic", F.lit(0)))
    assert q7.train(d.union(d), twice) == model
    messy = q7.score_toxicity(docs, model)
    assert messy.count() == docs.count() and messy.columns[-2:] == ["toxicity_", "offending_"]
    assert all(r.toxicity_ == 0 for r in messy.where("text is null or trim(text) = ''").collect())
    assert q7.score_toxicity(none, model).count() == 0
    assert q7.train(d, labels.limit(0)) == {} and q7.score_toxicity(d, {}).first().toxicity == 0


def test_toxicity_by_brute_force(spark):
    """Scores and likelihood by products over all sentences; the fitted weights
    are where the likelihood of the documents no longer rises."""
    rng = random.Random(9)
    texts, y = [], []
    for i in range(300):
        y.append(int(i % 3 == 0))
        s = [" ".join(rng.choice(["oak", "elm", "ash", "fir"]) for _ in range(4)) for _ in range(rng.randint(1, 4))]
        texts.append(". ".join([*s, rng.choice(["vilewort", "oak"])] if y[-1] else s) + (" elm" if i % 7 else " vilewort"))
    model = q7.fit(texts, np.array(y))

    def p_of(text, weights):
        clean = 1.0
        for part in re.split(r"[.!?\n]", text):
            ws = re.findall(r"[^\W\d_]+", part.lower())
            if ws:
                has = {*ws, *(f"{w[:k]}-" for w in ws for k in q7.STEMS if len(w) > k)}
                clean *= 1 - 1 / (1 + math.exp(-weights[q7.BIAS] - sum(weights.get(f, 0) for f in has)))
        return 1 - clean

    def loss(weights):
        p = [min(max(p_of(t, weights), 1e-9), 1 - 1e-9) for t in texts]
        return -sum(math.log(q if k else 1 - q) for q, k in zip(p, y)) / len(y) + q7.L2 / 2 * sum(w * w for f, w in weights.items() if f != q7.BIAS)

    assert len(model) > 1
    for t in texts[:60]:
        assert q7.score(t, model[q7.BIAS], q7.by_kind(model))[0] == pytest.approx(p_of(t, model), abs=1e-9)
    best = loss(model)
    for f in list(model)[:6]:
        for step in (-0.3, 0.3):
            assert loss(model | {f: model[f] + step}) > best - 1e-4


# 8 language model ------------------------------------------------------------
@pytest.mark.parametrize("n, universe", [(0, 9), (1, 1), (7, 1 << 62), (1000, 1 << 20), (3000, 3500), (5000, 1 << 40), (40, 1 << 50)])
def test_elias_fano(n, universe):
    rng = np.random.default_rng(n)
    v = np.sort(rng.choice(universe, n, replace=False) if universe < 1 << 22 else rng.integers(0, universe, n)).astype(np.uint64)
    if n == 40:
        v[10:30] = v[10]  # repeats, as pointers have
    s = ef.Sequence(ef.encode(v, universe))
    assert (s.access(np.arange(n)) == v).all() if n else True
    first = {int(x): i for i, x in reversed(list(enumerate(v)))}
    q = np.unique(np.concatenate([v, rng.integers(0, universe, 300).astype(np.uint64)]))
    assert s.find(q).tolist() == [first.get(int(x), -1) for x in q]


def test_elias_fano_file(tmp_path):
    v = np.arange(0, 5000, 3).astype(np.uint64)
    ef.write(f"file://{tmp_path}/x", ef.named("s", ef.encode(v, 5000)) | {"a": np.arange(5, dtype=np.uint16)})
    got = ef.mapped(f"file://{tmp_path}/x")
    assert got["a"].tolist() == [0, 1, 2, 3, 4] and ef.sequence(got, "s").find(np.array([3, 4, 4998])).tolist() == [1, -1, 1666]
    assert [p.name for p in tmp_path.iterdir()] == ["x"]


def lm_brute(rows, order):
    tokens = [[*(t or "").encode().lower().split(), b" "] for _, t in rows]
    train = [w for (i, _), w in zip(rows, tokens) if zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2]
    c = collections.Counter(w for t in train for w in t)
    grams = collections.Counter(tuple([None, *t][i : i + k]) for t in train for i in range(len(t) + 1) for k in range(2, order + 1) if i + k <= len(t) + 1)
    width, of = collections.Counter(g[:-1] for g in grams), collections.Counter()
    for g, x in grams.items():
        of[g[:-1]] += x
    n, v = sum(c.values()), len(c)
    out = []
    for t in tokens:
        base, full = [(c[w] + 1) / (n + v + 1) for w in t], [None, *t]
        score = 0.0
        for i, b in enumerate(base):
            for k in range(2, order + 1):
                h = tuple(full[i + 2 - k : i + 1]) if i + 2 >= k else ()
                if h and of[h]:
                    b = max(grams[*h, t[i]] - 0.8, 0) / of[h] + 0.8 * width[h] / of[h] * b
            score += math.log10(b)
        out.append((len(t), sum(c[w] > 0 for w in t), sum(map(math.log10, base)), score))
    return out, n


@pytest.mark.parametrize("order", [2, 3, 4])
def test_language_model(spark, docs, rows, none, order):
    held = common.id_remainder(F.col("doc_id"), 7) == 2
    model = q8.train(docs.where(~held), order)
    got = sorted((tuple(r) for r in q8.score_texts(docs, model).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1], r[3]))
    brute, n = lm_brute(rows, order)
    want = sorted(((i, *b) for (i, _), b in zip(rows, brute)), key=lambda r: (r[0] is None, r[0] or 0, r[1], r[3]))
    assert model.tokens == n
    for a, b in zip(got, want, strict=True):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3], rel=1e-9) and b[4] - a[1] * order * q8.QUANTUM <= a[4] <= b[4] + 1e-9 * a[1]
    assert q8.score_texts(none, model).count() == 0
    empty = q8.train(none, order)
    assert all(r.n_known == 0 and r.score == 0 for r in q8.score_texts(docs.where("text = ''"), empty).collect())


def test_spread_contexts(spark, monkeypatch):
    """One context holds a third of all tokens, over several tries; tries share
    few stores; probabilities after a context add up to one at most."""
    monkeypatch.setattr(q8, "MAX_STORES", 5)
    rng = random.Random(8)
    texts = [" ".join(x for _ in range(200) for x in ("hot", f"w{rng.randint(0, 400)}", f"v{rng.randint(0, 9)}")) for _ in range(60)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = q8.train(d.where(common.id_remainder(F.col("doc_id"), 7) != 2))
    assert model.pieces(np.array([60 * 200]))[0] > 1 and model.tries > model.stores
    brute, _ = lm_brute(list(enumerate(texts)), 3)
    got = {r.doc_id: r.score for r in q8.score_texts(d, model).collect()}
    assert all(b[3] - 3 * b[0] * q8.QUANTUM <= got[i] <= b[3] + 1e-6 for i, b in enumerate(brute))
    with pytest.raises(ValueError):
        q8.train(d, 1)
    monkeypatch.setattr(q8, "MAX_WORDS", 10)
    with pytest.raises(OverflowError):
        q8.train(d)


# 9 near-duplicates -----------------------------------------------------------
def simhash_brute(text):
    ws = [w for w in re.split(rb"[\x20\x09-\x0d]+", (text or "").encode().lower()) if w]
    sh = [b" ".join(ws[k : k + 3]) for k in range(max(1, len(ws) - 2))] if ws else []
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def component_brute(rows):
    fps = [simhash_brute(t) for _, t in rows]
    distinct = sorted(set(fps))
    parent = {f: f for f in distinct}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                parent[find(b)] = find(a)
    least = collections.defaultdict(list)
    for (i, _), f in zip(rows, fps):
        least[find(f)].append(i)
    return [(i, f, min((x for x in least[find(f)] if x is not None), default=None)) for (i, _), f in zip(rows, fps)]


def test_near_duplicates(docs, rows, none):
    small = docs.where("length(text) < 20000 or text is null")
    kept = [(i, t) for i, t in rows if t is None or len(t) < 20000]
    got = multiset((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in q9.near_duplicates(small).collect())
    assert got == multiset(component_brute(kept))
    # Two rows share an id here, so ids alone do not tell the components apart.
    assert q9.representatives(small).count() == q9.near_duplicates(small).select("component").distinct().count()
    assert q9.near_duplicates(none).count() == 0


@pytest.mark.parametrize("big", [2, 40, 10**6])
def test_links(spark, big):
    rng = np.random.default_rng(1)
    base, fps = int(rng.integers(1 << 62)), set()
    while len(fps) < 150:
        x = base
        for b in rng.choice(64, int(rng.integers(1, 5)), replace=False):
            x ^= 1 << int(b)
        fps.add(x - (1 << 64) if x >> 63 else x)
    fps |= {int(x) for x in rng.integers(0, 1 << 62, 100)}
    order = sorted(fps)
    want = {(a, b) for i, a in enumerate(order) for b in order[i + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    assert {(r.a, r.b) for r in q9.links(spark.createDataFrame([(x,) for x in fps], "fp long"), big=big).collect()} == want


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001), (1001, 1002), (1000, 1002)]
    got = {r.node: r.root for r in q9.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {1001: 1000, 1002: 1000}


def test_iban_ends_by_country(spark):
    cases = {
        "IBAN DE89 3704 0044 0532 0130 00 Please pay": ["DE89 3704 0044 0532 0130 00"],
        "account GB82WEST12345698765432 2024": ["GB82WEST12345698765432"],
        "iban DE12 DE89370400440532013000 A1": ["DE89370400440532013000"],
        "bank NO93 8601 1117 947, BE68 5390 0754 7034 X": ["NO93 8601 1117 947", "BE68 5390 0754 7034"],
        "IBAN DE88 3704 0044 0532 0130 00 Please pay": [],
    }
    d = spark.createDataFrame(list(enumerate(cases)), "doc_id int, text string")
    assert [[s.value for s in r.pii["iban"]] for r in q4.find_pii(d).orderBy("doc_id").collect()] == list(cases.values())


# 10 licences -----------------------------------------------------------------
def test_licenses(spark, docs, none):
    d = spark.createDataFrame(
        [(1, "Released under the MIT Licence"), (2, "x\nCopyright (c) 2020 Me\nLICENSED under the Apache License; version 2.0\nMore."), (3, "© 2001 A\nReleased under the  MIT license!"), (4, None), (4, "Released under the MIT License, mostly.")],
        "doc_id long, text string",
    )
    got = [(r.doc_id, r.license, r.n_notices, r.notices) for r in q10.scan_licenses(d, q10.known_digests(spark)).orderBy("doc_id", "n_notices", "digest").collect()]
    assert sorted(got, key=str) == sorted([(1, "MIT", 1, "MIT"), (2, None, 1, "Apache-2.0"), (3, "MIT", 1, "MIT"), (4, None, 0, ""), (4, None, 0, "")], key=str)
    assert q10.scan_licenses(docs, q10.known_digests(spark)).count() == docs.count()
    assert q10.scan_licenses(none, q10.known_digests(spark)).count() == 0
    empty = hashlib.sha256(b"").hexdigest()
    assert all(r.digest == empty for r in q10.scan_licenses(docs.where("text is null or trim(text) = ''"), q10.known_digests(spark)).collect())


def test_whole_license_texts(spark):
    """Licences and notices, whole, in other case, punctuation, spelling and
    wrapping, behind comment signs, and with another copyright line."""
    text = {f.name: f.read_text() for f in q10.TEXTS.glob("*.txt")}
    mit = text["MIT.txt"].replace("<year> <copyright holders>", "2020 An Author")
    body = " ".join(mit.split("\n\n", 2)[2].split())
    bare = re.sub(r"(?m)^[0-9]\. ", "* ", text["BSD-3-Clause.txt"])
    cases = [
        (mit.upper().replace("SUBLICENSE", "SUB-LICENCE"), "MIT", "MIT"),
        ("\n".join(f"// {x}" for x in textwrap.wrap(body, 40)), "MIT", "MIT"),
        ("int a;\n" + "\n".join(f" * {x}" for x in text["Apache-2.0.notice.txt"].split("\n")) + "\nint b;", None, "Apache-2.0"),
        (bare, "BSD-3-Clause", "BSD-3-Clause"),
        (text["GPL-3.0.txt"].replace(";", ","), "GPL-3.0", "GPL-3.0"),
        (mit + "\n\n" + text["ISC.txt"], None, "ISC,MIT"),
        (mit[:-30], None, ""),
        ("Some software. " + body, None, ""),
    ]
    cases += [(t, n.removesuffix(".txt").removesuffix(".notice"), None) for n, t in text.items()]
    d = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "doc_id long, text string")
    for r in q10.scan_licenses(d, q10.known_digests(spark)).collect():
        _, whole, inside = cases[r.doc_id]
        assert r.license == whole and (inside is None or r.notices == inside), (r.doc_id, r)
    long = spark.createDataFrame([(1, "Released under the MIT License.\n" * 20000 + "x\n" * 20000)], "doc_id long, text string")
    assert q10.scan_licenses(long, q10.known_digests(spark)).first().n_notices == 20000
    with pytest.raises(ValueError):
        q10.known_digests(spark, [("x", "no word of the list")])


# queries ---------------------------------------------------------------------
#: Their rows are words and pairs: held against brute force and SQL over whole tables.
NOT_BY_DOCUMENT = {"op11_spelling_variants", "op13_distance_keys"}


@pytest.mark.parametrize("name", sorted(registry.QUERIES.keys() - NOT_BY_DOCUMENT))
def test_queries_cover_their_table(spark, name):
    df = registry.QUERIES[name](spark, SF)
    ids = {"op3_tag_path_ratios": ("pages", "page_id")}.get(name, ("documents", "doc_id"))
    want = {r[0] for r in spark.read.parquet(f"{SF}/{ids[0]}.parquet").select(ids[1]).collect()}
    assert {r[0] for r in df.select(ids[1]).collect()} == want


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, name):
    from compare import connect, rows as cells

    assert cells(registry.QUERIES[name](spark, SF).toPandas()) == cells(connect(SF).sql(registry.ORACLES[name]).df())
