"""Main text of HTML pages by tag-path ratios.

A page's blocks of text are grouped by their root-to-leaf path of elements, each
with its class and id. Every path gets two ratios, characters per node and
punctuation marks per node. They are smoothed over the tree of paths (a path
counts for another ``DECAY`` to the power of the distance between them, in which
edges to sections are long and edges to paragraphs, headings and list items are
short) and fused: ``sqrt(length) * (1 + sqrt(punctuation))``, as a share of the
page's best.

What an element declares of itself is fused as an added term (``ROLES``): a path
in an ``article`` or ``main`` gains, one with an advert's, menu's, comment's or
sidebar's class, id or role loses. The ratios decide whether a declared article
is believed: only if the ratio-weighted text in it is at least ``BELIEVED`` of
that outside. If it is, paths beside it lose. Paths at ``threshold`` or more are
content, and all their nodes are returned in page order. Elements whose tag says
that they are never text (scripts, styles, forms, ``nav``, ``footer``, ``aside``
and a ``header`` outside articles) are no part of any ratio.

One pass of a partition-wise function, no shuffle: a page is a row, and memory
is bounded by one batch of pages. Work is linear in the page, however deep it is
nested: smoothing is one walk up the tree of paths and one down.

Defined cases: null, empty or text-free html gives an empty text and n_chars 0;
unclosed and stray tags are tolerated; a truncated page yields what it has;
repeated rows give a row each; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Score from which on a path is content, and how much a path counts for one at
#: distance one.
THRESHOLD, DECAY = 0.65, 0.1
#: Share of the outer text that a declared article must hold to be believed.
BELIEVED = 0.25
#: Added to the ratio (0 to 1) of a path by what its elements declare.
ROLES = {"article": 0.7, "plain": 0.0, "beside": -0.7, "marked": -1.4}
#: Length of edges: to children of the body, other sections, and parts of text.
TOP_EDGE, SECTION_EDGE, PART_EDGE = 3.0, 1.0, 0.05
# What HTML says of its elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Content up to the closing tag is not markup.
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
DROPPED = RAW | frozenset("head nav footer aside form button select option datalist dialog menu svg canvas object audio video".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
PARTS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption details summary".split())
WHOLE = frozenset("html body article main".split())
#: Words of class, id or role that mark an element as not content.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent disqus footer form header masthead menu menubar modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion related reply replies respond share sharing sidebar social sponsor sponsored subscribe subscription toolbar contentinfo complementary".split()
)
#: Words beside which a mark says what the page has, not what the element is.
STATES = frozenset("has with without no is not enabled disabled open opened closed on off active visible content".split())
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+)))?")
PUNCTUATION = re.compile(r"[.,;:!?。，]")
SPACES = re.compile(r"\s+")
#: An open tag of the first is closed by a new one of the second.
CLOSES = {"p": frozenset("p div ul ol dl table section article aside header footer nav form blockquote pre main h1 h2 h3 h4 h5 h6 hr figure".split()), "li": frozenset(["li"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"]), "option": frozenset(["option"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"])}
ENDS = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}


@dataclass
class Tree:
    """Paths of a page as a tree; a path's parent has a smaller number."""

    parent: list[int] = field(default_factory=lambda: [-1])
    edge: list[float] = field(default_factory=lambda: [0.0])
    role: list[str] = field(default_factory=lambda: ["plain"])
    known: dict[tuple[int, str], int] = field(default_factory=dict)

    def child(self, parent: int, key: str, edge: float, role: str) -> int:
        """The path one element longer, by the element's tag, class and id."""
        at = self.known.setdefault((parent, key), len(self.parent))
        if at == len(self.parent):
            self.parent.append(parent)
            self.edge.append(edge)
            self.role.append(role)
        return at


def attributes_of(text: str) -> dict[str, str]:
    if not text or text.isspace():
        return {}
    return {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(text)}


def is_hidden(attributes: dict[str, str]) -> bool:
    return "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or "display:none" in SPACES.sub("", attributes.get("style", "").lower())


def is_marked(attributes: dict[str, str]) -> bool:
    """Whether a word of class, id or role is a mark and tells no state."""
    for name in ("class", "id", "role"):
        for token in attributes.get(name, "").lower().split():
            parts = set(re.split(r"[^a-z]+", token))
            if parts & MARKS and not parts & STATES:
                return True
    return False


def blocks(page: str) -> tuple[Tree, list[tuple[int, str]]]:
    """The paths, and (path, text) of every block of text outside dropped
    elements."""
    tree, out = Tree(), []
    # Tag, path, whether it is dropped, and the place of the nearest open block.
    stack: list[tuple[str, int, bool, int]] = []
    opened: Counter[str] = Counter()  # open elements by tag: most stray end tags stop here
    text: list[str] = []
    at, size, path, blank = 0, len(page), 0, True

    def flush() -> None:
        nonlocal blank
        joined = SPACES.sub(" ", entities.unescape("".join(text))).strip()
        if joined:
            out.append((path, joined))
        text.clear()
        blank = True

    def take(piece: str) -> None:
        nonlocal path, blank
        if piece and not (stack and stack[-1][2]):
            if blank and not piece.isspace():
                path, blank = stack[-1][1] if stack else 0, False
            text.append(piece)

    def close(k: int) -> None:
        opened.subtract(x[0] for x in stack[k:])
        del stack[k:]

    while at < size:
        m = TAG.search(page, at)
        if not m:
            take(page[at:])
            break
        take(page[at : m.start()])
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        if tag not in INLINE and tag != "br":
            flush()
        if tag == "br":
            take(" ")
        if m[1]:
            if opened[tag] > 0:
                close(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag))
        elif tag in RAW:
            end = ENDS[tag].search(page, at)
            at = end.end() if end else size
        elif tag not in VOID:
            # As in HTML: a new block ends an open one of its kind, with all
            # unclosed inline elements inside it.
            k = stack[-1][3] if stack else -1
            if k >= 0 and tag in CLOSES.get(stack[k][0], ()):
                close(k)
            above, dropped = (stack[-1][1], stack[-1][2]) if stack else (0, False)
            own = attributes_of(m[3])
            role = tree.role[above]
            if role != "marked":
                role = "article" if tag in ("article", "main") else "marked" if tag not in WHOLE and own and is_marked(own) else role
            dropped = dropped or tag in DROPPED or (tag == "header" and role != "article") or (bool(own) and is_hidden(own))
            here = above
            if tag not in INLINE:
                edge = PART_EDGE if tag in PARTS else TOP_EDGE if not stack or stack[-1][0] in ("html", "body") else SECTION_EDGE
                here = tree.child(above, " ".join([tag, own.get("class", ""), own.get("id", "")]), edge, role)
            elif role != tree.role[above]:
                here = tree.child(above, tag + role, 0.0, role)
            opened[tag] += 1
            stack.append((tag, here, dropped, len(stack) if tag not in INLINE else stack[-1][3] if stack else 0))
    flush()
    return tree, out


def ratios(tree: Tree, parts: list[tuple[int, str]], decay: float = DECAY) -> dict[int, float]:
    """Smoothed and fused tag-path ratio of every path with text."""
    n = len(tree.parent)
    sums = [[0.0] * n for _ in range(3)]  # characters, punctuation marks, nodes
    for path, text in parts:
        for k, x in enumerate((len(text), len(PUNCTUATION.findall(text)), 1)):
            sums[k][path] += x
    near = [decay**e for e in tree.edge]
    for total in sums:
        for i in range(n - 1, 0, -1):  # from below
            total[tree.parent[i]] += near[i] * total[i]
        for i in range(1, n):  # from above, without what came from here
            total[i] += near[i] * max(0.0, total[tree.parent[i]] - near[i] * total[i])
    return {p: math.sqrt(sums[0][p] / sums[2][p]) * (1 + math.sqrt(sums[1][p] / sums[2][p])) for p in {p for p, _ in parts}}


def scores(tree: Tree, parts: list[tuple[int, str]], roles: dict[str, float] | None = ROLES) -> dict[int, float]:
    """Ratio of every path as a share of the best, plus what its role adds
    (nothing without ``roles``)."""
    ratio = ratios(tree, parts)
    role = {p: tree.role[p] if roles else "plain" for p in ratio}
    if all(r == "marked" for r in role.values()):
        return dict.fromkeys(ratio, -1.0)
    best = max(x for p, x in ratio.items() if role[p] != "marked")
    mass = {"article": 0.0, "plain": 0.0, "marked": 0.0}
    for p, text in parts:
        mass[role[p]] += ratio[p] * len(text)
    if mass["article"] >= BELIEVED * mass["plain"] and mass["article"]:
        role = {p: "beside" if r == "plain" else r for p, r in role.items()}
    else:
        role = {p: "plain" if r == "article" else r for p, r in role.items()}
    return {p: min(1.0, x / best) + (roles or ROLES)[role[p]] for p, x in ratio.items()}


def main_text(page: str | None, threshold: float = THRESHOLD, roles: dict[str, float] | None = ROLES) -> str:
    tree, parts = blocks(page or "")
    if not parts:
        return ""
    score = scores(tree, parts, roles)
    return "\n\n".join(text for path, text in parts if score[path] >= threshold)


def extract(pages: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, url and text of every row of ``pages``."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), threshold) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").mapInArrow(each, "page_id long, url string, text string")


def op3_tag_path_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
