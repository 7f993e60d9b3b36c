"""Licence scan by canonical digest lookup.

A text is brought to a canonical form: lower case, equivalent spellings unified,
copyright lines, list markers and punctuation dropped, white space reduced. Its
digest is looked up among the digests of known licence texts: whole licences,
the notices that they ask for, and one-line declarations. Two kinds of unit are
looked up, always entire: the whole document, and every run of whole lines that
may be a known text, so that one is found where it stands in a document, however
its lines are wrapped and whatever comment signs are before them.

A run may be a known text only if it begins like one (``HEAD`` characters) and
has its length; both are looked up in small tables and leave the digest of few
runs to be computed, but of all that can match. A text without any of
``ANCHORS`` holds no known text.

Only DataFrame functions run. Known texts are a fixed table of at most
``MAX_KNOWN`` rows, so that side is always broadcast; no document text is
shuffled.

Defined cases: a null, empty or punctuation-only text has the digest of '' and
no licence; runs that repeat count each time; of texts with one digest the
smallest name counts; repeated rows give a row each; other columns are ignored.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table

#: Licence texts, a file each: ``<SPDX identifier>.txt`` the whole licence,
#: ``<SPDX identifier>.notice.txt`` what it asks to be put in source files.
TEXTS = Path(__file__).parent / "licenses"
#: Notices by which public licences are declared, and the SPDX
#: identifier of each.
KNOWN = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
#: Spellings that count as one, after lower-casing, from the
#: published list of equivalent words of the SPDX matching guidelines.
SPELLINGS = [
    ("licence", "license"), ("sub-license", "sublicense"), ("sub license", "sublicense"), ("https:", "http:"), ("\u00a9", "(c)"),
    ("organisation", "organization"), ("organise", "organize"), ("authoris", "authoriz"), ("recognis", "recogniz"), ("emphasis", "emphasiz"),
    ("initialis", "initializ"), ("maximis", "maximiz"), ("optimis", "optimiz"), ("realis", "realiz"), ("utilis", "utiliz"), ("capitalis", "capitaliz"),
    ("categoris", "categoriz"), ("acknowledgement", "acknowledgment"), ("judgement", "judgment"), ("analogue", "analog"), ("analyse", "analyze"),
    ("artefact", "artifact"), ("calibre", "caliber"), ("cancelled", "canceled"), ("catalogue", "catalog"), ("centre", "center"), ("favour", "favor"),
    ("fulfilment", "fulfillment"), ("labelling", "labeling"), ("labour", "labor"), ("modelling", "modeling"), ("modelled", "modeled"),
    ("non-commercial", "noncommercial"), ("offence", "offense"), ("per cent", "percent"), ("practise", "practice"), ("programme", "program"),
    ("signalling", "signaling"), ("whilst", "while"), ("wilful", "willful"),
]
#: A line that states a copyright, and a list marker. (?d): only a line feed
#: ends a line.
COPYRIGHT = r"(?md)^[^\p{L}\n(]*(?:copyright[\x20\t]*(?:\(c\)|[0-9<\[{:]|by\x20)|\(c\)|all rights reserved)[^\n]*$"
MARKER = r"(?md)^[^\p{L}\p{N}\n]*[0-9]{1,2}[.)]\s"
#: Every known text has one of these, in any spelling; the characters by which a
#: run is told to begin like one; and how many texts may be known.
ANCHORS, HEAD, MAX_KNOWN = ("licen", "software"), 16, 5000


def known_texts(folder: Path | str = TEXTS) -> list[tuple[str, str]]:
    """(SPDX identifier, text): the one-line declarations, and the files of
    ``folder``, with and without their first line where that is a title."""
    out = list(KNOWN)
    for file in sorted(Path(folder).glob("*.txt")):
        name, text = file.name.removesuffix(".txt").removesuffix(".notice"), file.read_text(encoding="utf-8")
        title, _, rest = text.strip().partition("\n\n")
        out += [(name, text)] + ([(name, rest)] if "\n" not in title and title.lower().endswith("license") else [])
    return out


def canonical(text: Column) -> Column:
    """The canonical form, lines apart by line feeds, none of them empty."""
    out = F.lower(F.coalesce(text, F.lit("")))
    for other, one in SPELLINGS:
        out = F.replace(out, F.lit(other), F.lit(one))
    out = F.regexp_replace(F.regexp_replace(out, COPYRIGHT, ""), MARKER, "")
    out = F.regexp_replace(F.regexp_replace(out, r"[^\p{L}\p{M}\p{N}\n]+", " "), r"(?: ?\n ?)+", "\n")
    return F.regexp_replace(out, r"\A[ \n]+|[ \n]+\z", "")


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """(known_digest, license, head, length), one row a digest."""
    known = known_texts() if known is None else known
    if len(known) > MAX_KNOWN or not all(any(a in t.lower() for a in ANCHORS) for _, t in known):
        raise ValueError(f"at most {MAX_KNOWN} texts can be known, each with one of {ANCHORS}")
    rows = spark.createDataFrame(known, "license string, text string").select("license", F.translate(canonical(F.col("text")), "\n", " ").alias("form"))
    return rows.groupBy("form").agg(F.min("license").alias("license")).select(F.sha2("form", 256).alias("known_digest"), "license", F.substr("form", F.lit(1), F.lit(HEAD)).alias("head"), F.length("form").alias("length"))


def runs(lines: Column, lengths: Column) -> Column:
    """Digests of all runs of ``lines`` that begin with a head in the map
    ``lengths`` and have one of its lengths."""

    def from_line(line: Column, i: Column) -> Column:
        joined = F.when(F.length(line) >= HEAD, line).otherwise(F.array_join(F.slice(lines, i + 1, HEAD), " "))

        def ends(wanted: Column) -> Column:
            zero = F.struct(F.lit(-1).alias("size"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("at"))

            def step(acc: Column, x: Column) -> Column:
                size, n = acc["size"] + 1 + F.length(x), acc["n"] + 1
                return F.struct(size.alias("size"), n.alias("n"), F.when(F.array_contains(wanted, size), F.concat(acc["at"], F.array(n))).otherwise(acc["at"]).alias("at"))

            # A line has a character at least, and a space before the next.
            some = F.slice(lines, i + 1, F.floor(F.array_max(wanted) / 2).cast("int") + 1)
            return F.transform(F.aggregate(some, zero, step)["at"], lambda n: F.sha2(F.array_join(F.slice(lines, i + 1, n), " "), 256))

        none = F.array().cast("array<string>")
        return let(F.element_at(lengths, F.substr(joined, F.lit(1), F.lit(HEAD))), lambda w: F.when(w.isNull(), none).otherwise(ends(w)))

    return F.flatten(F.transform(lines, from_line))


def scan_licenses(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, the digest of the whole text, the licence that the whole text is
    (null if none), how many runs of its lines are known texts, and which
    licences those name (sorted, comma-joined, '' if none)."""
    found: dict[str, list[int]] = {}
    for r in known.select("head", "length").distinct().collect():  # MAX_KNOWN rows at most
        found.setdefault(r["head"], []).append(r["length"])
    lengths = F.create_map(*[c for h, n in sorted(found.items()) for c in (F.lit(h), F.array(*map(F.lit, sorted(n))))])
    rows = docs.select("doc_id", canonical(F.col("text")).alias("form"), F.monotonically_increasing_id().alias("place"))
    anchored = F.lit(False)
    for a in ANCHORS:
        anchored |= F.contains("form", F.lit(a))
    inside = F.when(anchored, let(F.split("form", "\n", -1), lambda c: runs(c, lengths))).otherwise(F.array().cast("array<string>")) if found else F.array().cast("array<string>")
    whole = F.sha2(F.translate("form", "\n", " "), 256)
    rows = rows.select("doc_id", "place", F.posexplode(F.concat(F.array(whole), inside)).alias("unit", "digest"))
    rows = rows.join(F.broadcast(known.select("known_digest", "license")), F.col("digest") == F.col("known_digest"), "left")
    own, run = F.col("unit") == 0, F.col("unit") > 0
    out = rows.groupBy("doc_id", "place").agg(
        F.max(F.when(own, F.col("digest"))).alias("digest"),
        F.max(F.when(own, F.col("license"))).alias("license"),
        F.count(F.when(run, F.col("license"))).alias("n_notices"),
        F.array_join(F.sort_array(F.collect_set(F.when(run, F.col("license")))), ",").alias("notices"),
    )
    return out.drop("place")


def op10_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"), known_digests(spark))


def oracle() -> str:
    r"""Every known text is held against the text from every line on."""

    def canon(x: str) -> str:
        x = f"lower(coalesce({x}, ''))"
        for other, one in SPELLINGS:
            x = f"replace({x}, '{other}', '{one}')"
        for pattern in (COPYRIGHT, MARKER):
            x = f"regexp_replace({x}, '{pattern.replace('(?md)', '(?m)')}', '', 'g')"
        x = rf"regexp_replace({x}, '[^\p{{L}}\p{{M}}\p{{N}}\n]+', ' ', 'g')"
        return rf"trim(regexp_replace({x}, '(?: ?\n ?)+', chr(10), 'g'), ' ' || chr(10))"

    values = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in known_texts())
    return f"""
    with known as (select translate({canon("t")}, chr(10), ' ') as k, min(l) as license from (values {values}) v(l, t) group by 1),
    forms as (select doc_id, row_number() over () as place, {canon("text")} as form from documents),
    lines as (select place, string_split(form, chr(10)) as c, unnest(range(1, len(string_split(form, chr(10))) + 1)) as i from forms),
    rests as (select place, c[i] as line, array_to_string(c[i:], chr(10)) as rest from lines where c[i] <> ''),
    hits as (select place, license from rests join known on starts_with(k, substr(line, 1, 8))
             where translate(substr(rest, 1, length(k)), chr(10), ' ') = k and substr(rest, length(k) + 1, 1) in ('', chr(10))),
    found as (select place, count(*) as n, string_agg(distinct license, ',' order by license) as names from hits group by 1)
    select doc_id, sha256(translate(form, chr(10), ' ')) as digest, license, coalesce(n, 0) as n_notices, coalesce(names, '') as notices
    from forms left join known on translate(form, chr(10), ' ') = k left join found using (place)
    """
