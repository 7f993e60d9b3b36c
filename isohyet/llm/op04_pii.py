r"""Personal data: patterns propose, checksums confirm, context adjusts.

Each kind has a regular expression. What it matches must pass the kind's
validator (digit counts, octets, Luhn, mod 97), and a score is the kind's prior
plus a credit for a passed checksum plus one for context words shortly before
the span. The base kinds (email, ip, card, phone) are always reported; the
added ones (iban, ssn, secret) only from ``MIN_SCORE`` on.

Only DataFrame functions run, in one pass without a shuffle. Offsets come from
``split`` by the same pattern: its pieces are the gaps between matches. All
patterns are possessive and start at the head of a run of characters, so that
matching stays linear in the text and free of recursion.

Defined cases: a null or empty text has no spans (empty strings, counts 0);
repeated rows give a row each; other columns are ignored; spans are counted in
code points, end exclusive, and spans of different kinds may overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, let, table

BASE = ["email", "ip", "card", "phone"]
ADDED = ["iban", "ssn", "secret"]
MIN_SCORE = 0.5
#: Code points before a span that are searched for context words.
CONTEXT = 40
#: Pattern, prior score and context words of each kind.
LOCAL = "A-Za-z0-9._%+-"
#: Characters of an IBAN by country, from the registry of ISO 13616.
IBAN = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_LENGTHS = "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\x20?+[A-Z0-9]){{{n - 4}}}" for n, c in IBAN.items())
#: The whole number: by its country's length; of other countries the whole run.
IBAN_TEXT = rf"(?:{_LENGTHS}|(?!{'|'.join(IBAN.values()).replace(' ', '|')})[A-Z]{{2}}[0-9]{{2}}(?:\x20?+[A-Z0-9]){{11,30}}+)"
KINDS = {
    "email": (rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.8, "mail|contact|write"),
    "ip": (r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++", 0.5, "ip|addr|host|server|login"),
    "card": (r"[0-9](?:[\x20-]?+[0-9])++", 0.3, "card|visa|master|credit|payment"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", 0.5, "tel|phone|call|mobil|fax"),
    # The head alone, so that a number is found behind what only looks like one.
    "iban": (r"[A-Z](?<![A-Za-z0-9][A-Z])[A-Z][0-9]{2}", 0.1, "iban|bank|account|konto"),
    "ssn": (r"[0-9](?<![0-9-][0-9])[0-9]{2}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.2, "ssn|social|security"),
    "secret": (r"[=:]\x20?[\"']?[A-Za-z0-9+/_-]{32,}+", 0.2, "token|secret|key|passw|auth"),
}
CHECKSUM, NEAR = 0.5, 0.4
SPAN = "struct<start:int,end:int,value:string>"


def proposals(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, end, value>>."""
    none = F.array().cast(f"array<{SPAN}>")
    zero = F.struct(F.lit(0).alias("at"), none.alias("spans"))

    def placed(found: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + x["gap"]
            end = start + F.length(x["value"])
            return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value")))).alias("spans"))

        gaps = lambda g: F.aggregate(F.transform(found, lambda v, i: F.struct(v.alias("value"), F.length(F.get(g, i)).alias("gap"))), zero, step)["spans"]
        return F.when(F.size(found) > 0, let(F.split(text, pattern, -1), gaps)).otherwise(none)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """13 to 19 digits whose Luhn sum is a multiple of ten."""

    def total(d: Column) -> Column:
        digit = lambda i: F.substr(d, F.length(d) - i, F.lit(1))
        each = lambda acc, i: acc + F.when(i % 2 == 0, digit(i)).otherwise(F.translate(digit(i), "0123456789", "0246813579")).cast("int")
        return F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), each)

    return let(digits(value), lambda d: F.when(F.length(d).between(13, 19), total(d) % 10 == 0).otherwise(False))


def mod97(value: Column) -> Column:
    """The check of ISO 13616: first four characters to the end, letters as
    10 to 35, the number leaves 1 when divided by 97."""

    def rest(v: Column) -> Column:
        turned = F.concat(F.substr(v, F.lit(5)), F.substr(v, F.lit(1), F.lit(4)))
        code = lambda i: F.ascii(F.substr(turned, i, F.lit(1)))
        each = lambda acc, i: F.when(code(i) < 58, (acc * 10 + code(i) - 48) % 97).otherwise((acc * 100 + code(i) - 55) % 97)
        return F.aggregate(F.sequence(F.lit(1), F.length(v)), F.lit(0), each) == 1

    return let(F.replace(value, F.lit(" "), F.lit("")), rest)


OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Kinds with a checksum earn its credit by passing it.
CHECKED = {"card": luhn, "iban": mod97}
VALID = CHECKED | {"ip": lambda v: v.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"), "phone": lambda v: F.length(digits(v)).between(9, 15)}


def spans_of(text: Column, kind: str, min_score: float = MIN_SCORE) -> Column:
    """Confirmed spans of a kind: array<struct<start, end, value, score>>."""
    pattern, prior, words = KINDS[kind]
    found = proposals(text, pattern)
    if kind in ("email", "phone"):  # without this sign there is no match
        sign = "@" if kind == "email" else "+"
        found = F.when(F.contains(text, F.lit(sign)), found).otherwise(F.array().cast(f"array<{SPAN}>"))
    if kind == "secret":  # the sign and quote before it are not part of it
        head = lambda v: F.length(F.regexp_extract(v, "^[=:]\\x20?[\"']?", 0))
        found = F.transform(found, lambda x: F.struct((x["start"] + head(x["value"])).alias("start"), x["end"].alias("end"), F.substr(x["value"], head(x["value"]) + 1).alias("value")))
    if kind == "iban":  # 34 characters at most, each after a space
        whole = lambda x: F.regexp_extract(F.substr(text, x["start"] + 1, F.lit(70)), f"^{IBAN_TEXT}", 0)
        found = F.transform(F.transform(found, lambda x: F.struct(x["start"].alias("start"), whole(x).alias("value"))), lambda x: F.struct(x["start"].alias("start"), (x["start"] + F.length(x["value"])).alias("end"), x["value"].alias("value")))
        found = F.filter(found, lambda x: x["value"] != "")
    if kind in VALID:
        found = F.filter(found, lambda x: VALID[kind](x["value"]))

    def scored(x: Column) -> Column:
        begin = F.greatest(x["start"] - CONTEXT, F.lit(0))
        near = F.lower(F.substr(text, begin + 1, x["start"] - begin)).rlike(words)
        score = F.lit(prior + (CHECKSUM if kind in CHECKED else 0.0)) + F.when(near, NEAR).otherwise(0.0)
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), F.least(score, F.lit(1.0)).alias("score"))

    found = F.transform(found, scored)
    return found if kind in BASE else F.filter(found, lambda x: x["score"] >= min_score)


def find_pii(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """``docs`` plus ``pii`` (underscores added if ``docs`` has it already): a
    struct with an array of spans for each kind."""
    text = F.coalesce("text", F.lit(""))
    return docs.withColumn(free_name(docs, "pii"), F.struct(*[spans_of(text, k, min_score).alias(k) for k in [*BASE, *ADDED]]))


def listed(kinds: list[str], pii: Column) -> Column:
    """kind:start:end of all spans, by kind, then start, comma-joined."""

    def each(kind: str) -> Column:
        return F.transform(pii[kind], lambda x: F.concat_ws(":", F.lit(kind), x["start"].cast("string"), x["end"].cast("string")))

    return F.array_join(F.concat(*map(each, kinds)), ",")


def masked(text: Column, pii: Column) -> Column:
    """``text`` with every span of ``pii`` (overlapping ones as one, named by
    the first) replaced by its kind in angle brackets."""

    def each(kind: str) -> Column:
        return F.transform(pii[kind], lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(kind.upper()).alias("kind")))

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        new = F.concat(acc["out"], F.substr(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit("<"), x["kind"], F.lit(">"))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(x["start"] >= acc["at"], new).otherwise(acc["out"]).alias("out"))

    whole = lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1))
    return let(F.sort_array(F.concat(*map(each, [*BASE, *ADDED]))), lambda s: F.when(F.size(s) > 0, F.aggregate(s, zero, step, whole)).otherwise(text))


def op4_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    pii = F.col("pii")
    counts = [F.size(pii[k]).cast("long").alias(f"n_{k}") for k in [*BASE, *ADDED]]
    best = F.array_max(F.concat(*[F.transform(pii[k], lambda x: x["score"]) for k in [*BASE, *ADDED]]))
    return rows.select("doc_id", *counts, F.sha2(listed(BASE, pii), 256).alias("base_sha256"), listed([*BASE, *ADDED], pii).alias("spans"), best.alias("top_score"))
