"""Main text of web pages: site templates are removed by subtrees that recur on a host.

Every page is read into a tree of elements. Each subtree of the text that is left gets a hash of its
tags, classes and words, and Spark counts on how many different pages of a host it stands: pages
with the same main text count once, so copies of an article do not make it a template. Subtrees on
at least `min_pages` pages of a host, however large the host is, are deleted on that host. Counts are
joined to each page's own subtrees, so no list per host is gathered, and only pages that lose
something are read a second time.

Some furniture differs from page to page and is known by its markup: navigation, page headers and
footers, sidebars, forms, scripts and styles by their elements, and adverts, notices, reader
comments and the like by role, class or id. A name that only contains such a word, and a form, are
no furniture where they hold an article or most of the page's prose. A class or id that is such a
word spares `main`, and an article that has most of the page's text while no other article stands
outside of furniture; comments are never spared for an article. Where a page says what its article
is (`article`, `main` or that role), only that counts, and its prose is never taken for a template.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import blake2b, sha256

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructType

from levylens.llm.urlfilter import host_of
from levylens.sources.sinks import staged

MIN_PAGES = 10

# fixed values: names of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript iframe noembed noframes xmp textarea title template".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby"
    " s samp small span strike strong sub sup time tt u var wbr".split()
)
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre dl dt dd figcaption hr br hgroup".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl dt dd fieldset figcaption"
    " figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section"
    " summary table ul".split()
)
SAME = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"),
    "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th"),
}
WALL = frozenset("table ul ol dl select td th tr".split())
FURNITURE = frozenset(
    "nav aside form button select input dialog menu svg canvas object audio video math"
    " datalist output progress meter".split()
)
PAGE_ONLY = frozenset(("header", "footer"))  # furniture but within an article
ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar"
    " toolbar status".split()
)
#: One of these words in a class or id tells that an element is furniture (see _spare).
MARKS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside footer masthead topbar"
    " cookie cookies consent gdpr notice banner alert popup modal overlay ad ads advert"
    " adverts advertisement advertising adsense sponsor sponsored promo promotion newsletter"
    " subscribe subscription signup login share sharing social related recommended comment"
    " comments disqus replies pagination pager toolbar widget skip search".split()
)
COMMENTS = frozenset("comment comments disqus replies".split())
_TAG = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<[!?/][^>]*+(?:>|\Z)"
    r"|<[a-zA-Z][^>]*+(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(
    r"(?:^|[\s/\"'])(class|id|role|hidden|aria-hidden|style)\s*+(?:=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?",
    re.I,
)
_WORD = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")
_SPACE = re.compile(r"\s+")


@dataclass(slots=True)
class Node:
    tag: str
    mark: str  # class, id and role
    parent: int
    furniture: bool
    article: bool
    children: list = field(default_factory=list)  # numbers of nodes, and strings


def _described(tag: str, attributes: str) -> tuple[str, str, bool]:
    """(class, id and role as one string, role, whether hidden)."""
    mark, role, hidden = [], "", False
    if attributes and not attributes.isspace():
        for name, *values in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), "".join(values)
            if name in ("class", "id"):
                mark.append(value)
            elif name == "role":
                role = value.strip().lower()
            elif name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true":
                hidden = True
            elif name == "style" and re.search(r"display\s*:\s*none", value, re.I):
                hidden = True
    return " ".join(mark), role, hidden


def parse(page: str) -> list[Node]:
    """The elements of a page in document order, the root first. Any string can be read: missing
    end tags are supplied, stray ones ignored, an unfinished tag at the end is dropped."""
    nodes = [Node("#root", "", -1, False, False)]
    opened, count, at = [0], {}, 0
    unsure: dict[int, bool] = {}  # forms and elements with a word of MARKS; whether it is a whole name

    def close(to: int) -> None:
        while len(opened) > to:
            count[nodes[opened.pop()].tag] -= 1

    def text(a: int, b: int) -> None:
        if a < b:
            nodes[opened[-1]].children.append(entities.unescape(page[a:b]))

    for m in iter(lambda: _TAG.search(page, at), None):
        text(at, m.start())
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if count.get(tag):
                i = len(opened) - 1
                while nodes[opened[i]].tag != tag:
                    i -= 1
                close(i)
            elif tag == "br":
                nodes[opened[-1]].children.append("\n")
            continue
        if tag in CLOSES_P and count.get("p"):
            _close_nearest(nodes, opened, ("p",), close)
        if tag in SAME and any(count.get(t) for t in SAME[tag]):
            _close_nearest(nodes, opened, SAME[tag], close)
        mark, role, hidden = _described(tag, m[3])
        words = {w.lower() for w in _WORD.findall(mark)} if mark else ()
        article = tag in ("article", "main") or role in ("article", "main")
        sure = tag in FURNITURE and tag != "form" or hidden or role in ROLES
        names = mark.lower().split()
        whole = not MARKS.isdisjoint(names) and tag not in ("body", "html")
        part = bool(words) and not MARKS.isdisjoint(words) and tag not in ("body", "html")
        part |= "header" in words and not (count.get("article") or count.get("main"))
        part |= tag == "form"
        whole &= not (tag == "main" or role == "main")
        bad = sure or whole or part and not article
        nodes.append(Node(tag, mark, opened[-1], bad, article))
        if bad and not sure and (not whole or COMMENTS.isdisjoint(names)):
            unsure[len(nodes) - 1] = whole
        nodes[opened[-1]].children.append(len(nodes) - 1)
        if tag in RAW:
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            at = end.start() if end else len(page)
            nodes[-1].furniture = True
        if tag not in VOID and not (m[3].endswith("/") and tag in ("svg", "path")):
            opened.append(len(nodes) - 1)
            count[tag] = count.get(tag, 0) + 1
    text(at, len(page))
    if unsure:
        _spare(nodes, unsure)
    return nodes


def _spare(nodes: list[Node], unsure: dict[int, bool]) -> None:
    """Elements of `unsure` are no furniture where they hold the article.

    With a word of MARKS within a longer name that is an article or most of the page's prose; with
    a whole one `main`, or an article with most of the page's text if there is none elsewhere. What
    stands in other furniture does not count.
    """
    n = len(nodes)
    sure, within, marked = [False] * n, [False] * n, [False] * n
    for i, node in enumerate(nodes):
        above = node.parent
        sure[i] = node.furniture and i not in unsure or above >= 0 and sure[above]
        within[i] = node.tag in PROSE or above >= 0 and within[above]
        marked[i] = unsure.get(i, False) or above >= 0 and marked[above]
    prose, text = [0] * n, [0] * n  # of paragraphs, headings and the like; of everything
    plain, article, main = [False] * n, [False] * n, [False] * n
    for i in range(n - 1, 0, -1):
        node, above = nodes[i], nodes[i].parent
        if sure[i]:
            continue
        own = sum(len(c.strip()) for c in node.children if isinstance(c, str))
        text[i] += own
        prose[i] += own if within[i] else 0
        plain[i] |= node.article and not node.furniture
        article[i] |= node.article
        main[i] |= node.tag == "main"
        for counts in (prose, text):
            counts[above] += counts[i]
        for holds in (plain, article, main):
            holds[above] |= holds[i]
    elsewhere = any(
        x.article and not (sure[i] or marked[i]) for i, x in enumerate(nodes)
    )
    for i, whole in unsure.items():
        if sure[i]:
            continue
        if whole:
            nodes[i].furniture = not (main[i] or article[i] and not elsewhere and 2 * text[i] > text[0])
        else:
            nodes[i].furniture = not (plain[i] or 2 * prose[i] > prose[0])


def _close_nearest(nodes: list[Node], opened: list[int], tags: tuple[str, ...], close) -> None:
    """Close the innermost open element of `tags` that no list or table stands around."""
    for i in range(len(opened) - 1, 0, -1):
        tag = nodes[opened[i]].tag
        if tag in tags:
            close(i)
            return
        if tag in WALL or tag in ("article", "section", "div", "button"):
            return


def _articles(nodes: list[Node]) -> list[int]:
    """The outermost elements that hold the article; the root if the page names none."""
    inside = [False] * len(nodes)
    found = []
    for i, n in enumerate(nodes):
        outer = n.parent >= 0 and inside[n.parent]
        inside[i] = outer or n.furniture or n.article
        if n.article and not n.furniture and not outer:
            found.append(i)
    return found or [0]


def hashes(nodes: list[Node]) -> list[int]:
    """A signed 64-bit hash of each subtree: tags, classes and words, not links or other values."""
    out = [0] * len(nodes)
    for i in range(len(nodes) - 1, -1, -1):
        h = blake2b(f"{nodes[i].tag}\0{nodes[i].mark}".encode(errors="replace"), digest_size=8)
        for c in nodes[i].children:
            if isinstance(c, int):
                h.update(out[c].to_bytes(8, "little", signed=True))
            elif c and not c.isspace():
                h.update(" ".join(c.split()).encode(errors="replace"))
        out[i] = int.from_bytes(h.digest(), "little", signed=True)
    return out


def _can_be_template(nodes: list[Node], roots: list[int]) -> list[bool]:
    """Elements other than inline ones, outside the article or, within it, other than prose; not
    those that contain an article."""
    named = roots != [0]
    holds, inside = [False] * len(nodes), [False] * len(nodes)
    for r in roots if named else ():
        while r >= 0 and not holds[r]:
            holds[r] = True
            r = nodes[r].parent
    chosen = set(roots) if named else ()
    out = []
    for i, n in enumerate(nodes):
        inside[i] = i in chosen or n.parent >= 0 and inside[n.parent]
        prose = inside[i] and (n.tag in PROSE or n.tag in ("li", "tr", "td", "th", "tbody"))
        out.append(i > 0 and not holds[i] and n.tag not in INLINE and not prose
                   and n.tag not in ("html", "body", "head"))
    return out


def blocks(
    nodes: list[Node], templates: frozenset[int] = frozenset(), seen: set[int] | None = None
) -> list[str]:
    """The blocks of main text in page order, without furniture and subtrees among `templates`.
    The hashes of all subtrees that could be templates and have a part in it are added to `seen`."""
    wanted = bool(templates) or seen is not None
    own = hashes(nodes) if wanted else []
    roots = _articles(nodes)
    able = _can_be_template(nodes, roots) if wanted else []
    out: list[str] = []
    parts: list[str] = []

    def finish() -> None:
        block = _SPACE.sub(" ", "".join(parts)).strip()
        if block:
            out.append(block)
        parts.clear()

    for root in roots:
        named = root != 0
        stack = [iter(nodes[root].children)]
        ends = [True]
        while stack:
            child = next(stack[-1], None)
            if child is None:
                stack.pop()
                if ends.pop():
                    finish()
            elif isinstance(child, str):
                parts.append(child)
            else:
                n = nodes[child]
                block = n.tag not in INLINE
                if block:
                    finish()
                if n.furniture or n.tag in PAGE_ONLY and not named:
                    continue
                if wanted and able[child]:
                    if own[child] in templates:
                        continue
                    if seen is not None:
                        seen.add(own[child])
                stack.append(iter(n.children))
                ends.append(block)
        finish()
    return out


def extract(page: str | None, templates: frozenset[int] = frozenset()) -> str:
    return " ".join(blocks(parse(page), templates)) if page else ""


def _first_reading(pages: DataFrame) -> DataFrame:
    """`pages` (..., html, host) with, in place of html, a digest of it, the text by markup alone
    and the subtrees it is made of that could be templates."""
    kept = len(pages.columns) - 2
    schema = StructType([*pages.schema.fields[:kept], pages.schema["host"]])
    schema = schema.add("page", BinaryType()).add("text", StringType())
    schema = schema.add("subtrees", ArrayType(LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, texts, trees = [], [], []
            for page in batch.column(kept).to_pylist():
                seen: set[int] = set()
                texts.append(" ".join(blocks(parse(page), frozenset(), seen)) if page else "")
                digests.append(sha256((page or "").encode(errors="replace")).digest())
                trees.append(sorted(seen))
            columns = [*batch.columns[:kept], batch.column(kept + 1), pa.array(digests, pa.binary())]
            columns += [pa.array(texts, pa.string()), pa.array(trees, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return pages.mapInArrow(run, schema)


def deletions(read: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, page, subtrees): what goes from the pages of `read` (host, page, text, subtrees)
    because it stands on so many different pages of the host, with different texts. Stored."""
    main = F.xxhash64("text").alias("main")
    rows = read.select("host", "page", main, F.explode("subtrees").alias("subtree"))
    often = rows.select("host", "main", "subtree").distinct().groupBy("host", "subtree")
    often = often.agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    often = staged(often.select(F.col("host").alias("site"), F.col("subtree").alias("tree")), "subtrees")
    same = F.col("host").eqNullSafe(F.col("site")) & (F.col("subtree") == F.col("tree"))
    found = rows.select("host", "page", "subtree").join(often, same)
    return staged(found.groupBy("host", "page").agg(F.collect_set("subtree").alias("trees")), "deletions")


def main_text(
    pages: DataFrame, url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES
) -> DataFrame:
    """`pages` without `html_col` and with the column text (replacing one of that name): the main
    text, its blocks joined by one space, character references decoded. Runs jobs.

    Null and empty pages, and pages of nothing but furniture, have an empty text. Pages without
    host form one site. Repeated rows stay. A page is held in memory as a whole, with a record per
    element.
    """
    others = [c for c in pages.columns if c.lower() != "text" and c != html_col]
    names = [f"_{i}" for i in range(len(others))]
    flat = pages.select(
        *[F.col(f"`{c}`") for c in others],
        F.col(f"`{html_col}`").cast("string"),
        host_of(F.col(f"`{url_col}`").cast("string")),
    ).toDF(*names, "html", "host")
    read = staged(_first_reading(flat), "readings")
    changed = deletions(read, min_pages).select(
        F.col("host").alias("site"), F.col("page").alias("digest"), "trees"
    )
    same = F.col("host").eqNullSafe(F.col("site")) & (F.col("page") == F.col("digest"))
    untouched = read.join(changed, same, "left_anti").select(*names, "text")
    schema = untouched.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column(len(names)).to_pylist(), batch.column(len(names) + 1), strict=True)
            texts = [extract(page, frozenset(trees.as_py())) for page, trees in both]
            columns = [*batch.columns[: len(names)], pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    keyed = flat.withColumn("page", F.unhex(F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256)))
    again = keyed.join(changed, same).select(*names, "html", "trees").mapInArrow(run, schema)
    return untouched.unionByName(again).toDF(*others, "text")
