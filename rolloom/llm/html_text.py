"""Main text of web pages by markup and nearest-URL page differencing.

A page becomes its visible text lines, one per block element. Menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles and reader comments are left out where
tags, roles, classes or ids name them. Where a page declares its article (``article``,
``main`` or that role), the lines inside it are the text.

The rest of a page's template is found by differencing, on every page: pages are ordered by
URL path within their host, a page's lines are aligned with those of the page before and
the page after by longest common subsequence, and shared lines are deleted. Lines inside a
declared article meet only such lines, and are deleted only if both neighbours and at least
half of the host's pages have them and the three pages have different titles, because pages
of one host may well quote the same passage.

A copy of the page is no neighbour, and the next page by path that is no copy takes its
place. Pages with equal lines are one page here. A page that shares nearly all lines with
the one before, in both directions, is its copy if they have the same title, or if that
also holds without the lines that at least half of the host's pages have, its template.

Null and empty pages have an empty text. Repeated rows give equal results. Pages with a
null URL share one nameless host. Neighbours are found over range partitions of the order,
so that a host with most of the pages is spread like any other.
"""

from __future__ import annotations

import html as html_lib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from rolloom.llm.arrow_text import map_text, slices
from rolloom.session import checkpointed

#: A neighbour with this share of equal lines, of both pages, may be a copy. Pages that a line of the host's template is on, at least.
COPY, OFTEN = 0.8, 3
#: Element, class, id and role names.
RAW = frozenset("script style noscript template textarea title iframe svg math object canvas select head".split())
#: Those of them whose content a page shows where the end tag is missing.
OPEN_RAW = frozenset("head object svg math canvas select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("nav footer aside form button dialog menu label fieldset datalist audio video map".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox sponsor sponsored promo promotion banner sidebar menu nav navbar navigation topbar "
    "breadcrumb breadcrumbs header masthead footer foot comment comments respond reply replies disqus cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup login share sharing social related recommended recommendations widget widgets pagination pager toolbar copyright".split()
)
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_ALIKE = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
_KEEPS = frozenset("ul ol dl table".split())


def _named(value: str, in_article: bool) -> bool:
    """Whether a class or id names a part that is no main text; the header of an article holds its headline."""
    for one in value.lower().split():
        parts = re.split(r"[-_]+", one)
        if in_article and "header" in (parts[0], parts[-1]):
            continue
        if parts[0] not in ("has", "no", "with", "without") and (parts[0] in NAMES or parts[-1] in NAMES):
            return True
    return False


def _boilerplate(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in SKIPPED or (tag == "header" and not in_article):
        return True
    if not attributes or tag in ("html", "body", "article", "main") and "comment" not in attributes:
        return False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "")
        if name in ("class", "id") and tag not in ("h1", "h2", "h3", "h4", "h5", "h6") and _named(value, in_article):
            return True
        if name == "role" and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def lines(html: str) -> tuple[list[str], list[bool]]:
    """Visible lines of a page, and whether each is inside a declared article."""
    out, inside = [], []
    parts: list[str] = []
    stack: list[str] = []
    skip_at = article_at = -1
    at, raw_end = 0, None

    def flush() -> None:
        if parts:
            joined = "".join(parts)
            if "&" in joined:
                joined = html_lib.unescape(joined)
            text = " ".join(joined.split())
            if text:
                out.append(text)
                inside.append(article_at >= 0)
            parts.clear()

    def pop_to(depth: int) -> None:
        nonlocal skip_at, article_at
        del stack[depth:]
        if skip_at >= depth:
            skip_at = -1
        if article_at >= depth:
            article_at = -1

    while True:
        m = _TAG.search(html, at)
        text = html[at : m.start() if m else len(html)]
        if text and skip_at < 0:
            parts.append(text)
        if not m:
            break
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, closing, attributes = tag.lower(), bool(m[1] or m[4]), (m[3] if m[2] else m[6]) or ""
        if tag not in INLINE:
            if skip_at < 0:
                flush()
        elif tag == "br" and skip_at < 0:
            parts.append(" ")
        if closing:
            if tag in stack:
                depth = len(stack) - 1 - stack[::-1].index(tag)
                if tag not in INLINE or not any(t not in INLINE for t in stack[depth + 1 :]):
                    if tag not in INLINE and skip_at >= depth:
                        flush()  # a skipped inline part ends with its block
                    pop_to(depth)
            continue
        if tag in RAW:
            raw_end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at) if not attributes.endswith("/") else None
            if raw_end:
                at = raw_end.end()
            elif tag not in OPEN_RAW and not attributes.endswith("/"):
                at = len(html)
            continue
        if tag in VOID or attributes.endswith("/") and tag not in ("p", "div", "a", "li"):
            continue
        if tag in _CLOSES_P and "p" in stack:
            depth = len(stack) - 1 - stack[::-1].index("p")
            if all(t in INLINE for t in stack[depth + 1 :]):
                if skip_at > depth:
                    flush()
                pop_to(depth)
        if tag in _ALIKE:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth] in _ALIKE[tag]:
                    pop_to(depth)
                    break
                if stack[depth] in _KEEPS:
                    break
        if skip_at < 0:
            if _boilerplate(tag, attributes, article_at >= 0):
                if tag not in INLINE:
                    flush()
                skip_at = len(stack)
            elif article_at < 0 and (tag in ("article", "main") or "main" in attributes and re.search(r"""role\s*=\s*["']?main\b""", attributes)):
                article_at = len(stack)
        stack.append(tag)
    flush()
    return out, inside


def _lengths(a: list, b: list) -> np.ndarray:
    """Length of a longest common subsequence of ``a`` and each beginning of ``b``, a bit per line of ``b``."""
    masks: dict = {}
    for j, x in enumerate(b):
        masks[x] = masks.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        met = row & masks.get(x, 0)
        if met:
            row = ((row + met) | (row - met)) & full
    packed = np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8)
    grown = 1 - np.unpackbits(packed, bitorder="little")[: len(b)].astype(np.int64)
    return np.concatenate([[0], np.cumsum(grown)])


def _halved(a: list, b: list) -> list[int]:
    """Places in ``a`` of a longest common subsequence, in memory that grows with the lines alone: halves of ``a`` are solved apart."""
    out: list[int] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        i, k, j, m = work.pop()
        if i >= k or j >= m:
            continue
        if k - i == 1:
            if a[i] in b[j:m]:
                out.append(i)
            continue
        middle = (i + k) // 2
        left, right = _lengths(a[i:middle], b[j:m]), _lengths(a[middle:k][::-1], b[j:m][::-1])[::-1]
        cut = j + int(np.argmax(left + right))
        if left[cut - j] + right[cut - j]:
            work += [(middle, k, cut, m), (i, middle, j, cut)]
    return out


def shared_lines(a: list, b: list) -> list[int]:
    """Places in ``a`` of a longest common subsequence of ``a`` and ``b``.

    Pages whose lines are mostly different have few equal pairs, which are followed one by one;
    where lines repeat so often that the pairs outnumber the lines, bits stand for them.
    """
    head = 0
    while head < len(a) and head < len(b) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < len(a) - head and tail < len(b) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a_rest, b_rest = a[head : len(a) - tail], b[head : len(b) - tail]
    counts = Counter(b_rest)
    if sum(counts[x] for x in a_rest) > 8 * (len(a_rest) + len(b_rest)):
        middle = _halved(a_rest, b_rest)
    else:
        middle = _paired(a_rest, b_rest)
    return [*range(head), *(head + i for i in middle), *range(len(a) - tail, len(a))]


def _paired(a: list, b: list) -> list[int]:
    """Places in ``a`` of a longest common subsequence, from the pairs of equal lines."""
    where: dict = {}
    for j, x in enumerate(b):
        where.setdefault(x, []).append(j)
    ends: list[int] = []
    nodes: list[tuple] = []
    last: list[int] = []
    for i, x in enumerate(a):
        for j in reversed(where.get(x, ())):
            k = bisect_left(ends, j)
            nodes.append((i, last[k - 1] if k else -1))
            if k == len(ends):
                ends.append(j)
                last.append(len(nodes) - 1)
            else:
                ends[k] = j
                last[k] = len(nodes) - 1
    out, n = [], last[-1] if last else -1
    while n >= 0:
        out.append(nodes[n][0])
        n = nodes[n][1]
    return out[::-1]


_TITLE = re.compile(r"<title[^>]*>(.*?)</title", re.I | re.S)
#: Turns the hash of a line inside an article into another.
_INSIDE = 0x1F83D9ABFB41BD6B


def _hashed():
    def each(column: pa.Array):
        rows, insides, titles = [], [], []
        for page in column.to_pylist():
            found, inside = lines(page or "")
            rows.append([(xxhash.xxh3_64_intdigest(x) - (1 << 63)) ^ (_INSIDE if i else 0) for x, i in zip(found, inside, strict=True)])
            insides.append(inside)
            title = _TITLE.search(page or "")
            titles.append(" ".join(html_lib.unescape(title[1]).split()) or None if title else None)
        return [rows, insides, titles]

    return each


def _is_copy(mine: list, theirs: list, same: list[int], one_title: bool, often: set) -> bool:
    """Whether two pages that share the lines at ``same`` are copies, by title or beyond the template of the host."""
    if len(same) < COPY * max(len(mine), len(theirs)):
        return False
    own, other = sum(x not in often for x in mine), sum(x not in often for x in theirs)
    return one_title or sum(mine[i] not in often for i in same) >= COPY * max(own, other, 1)


def neighbours(pages: DataFrame) -> DataFrame:
    """``row`` with ``before`` and ``after``: the nearest pages by path on the same host.

    ``pages`` has ``row``, ``host``, ``path`` and ``part``, the number of the range
    partition of (host, path, row) that the page is in. One row per partition, its first
    and last page, closes the gaps between partitions.
    """
    place = F.struct("host", "path", "row")
    own = W.partitionBy("part").orderBy("host", "path", "row")
    edges = pages.groupBy("part").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    # one row per partition of the table: small enough for one task and a broadcast
    ordered = W.orderBy("part")
    edges = edges.select(F.col("part").alias("_part"), F.lag("last").over(ordered).alias("_last"), F.lead("first").over(ordered).alias("_first"))
    near = pages.select("row", "host", "part", F.lag(place).over(own).alias("b"), F.lead(place).over(own).alias("a")).join(F.broadcast(edges), F.col("part") == F.col("_part"))
    b, a = F.coalesce("b", "_last"), F.coalesce("a", "_first")
    return near.select("row", F.when(b["host"] == F.col("host"), b["row"]).alias("before"), F.when(a["host"] == F.col("host"), a["row"]).alias("after"))


def _leaders(table: DataFrame, copies: DataFrame) -> DataFrame:
    """``row``, ``part``, ``host``, ``path`` and ``leader``: the page itself, or the first of the run of copies it is in."""
    own = W.partitionBy("part").orderBy("host", "path", "row")
    marked = table.select("row", "host", "path", "part").join(copies.select("row", F.lit(True).alias("copy")), "row", "left")
    marked = marked.withColumn("lead", F.when(F.col("copy").isNull(), F.col("row")))
    placed = checkpointed(marked.withColumn("own", F.last("lead", ignorenulls=True).over(own)), "leaders")
    ends = placed.groupBy("part").agg(F.max_by("own", F.struct("host", "path", "row")).alias("last"))
    # one row per partition of the table, as in neighbours()
    ends = ends.select(F.col("part").alias("_part"), F.last("last", ignorenulls=True).over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)).alias("_last"))
    joined = placed.join(F.broadcast(ends), F.col("part") == F.col("_part"))
    return joined.select("row", "host", "path", "part", F.coalesce("own", "_last").alias("leader"))


def template_lines(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Lines that pages share with their neighbours and lose: ``id``, ``h`` (hash of the row), ``gone`` (places)."""
    address = F.coalesce(F.col(url), F.lit(""))
    rows = pages.select(
        F.col(key).alias("id"), F.xxhash64(address, F.coalesce(html, F.lit(""))).alias("h"), F.col(html).alias("t"),
        F.lower(F.regexp_extract(address, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1)).alias("host"),
        F.regexp_extract(address, r"^(?:(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]*)?([^?#]*)", 1).alias("path"),
    )
    parsed = map_text(rows, "t", ["id", "h", "host", "path"], {"lines": "array<bigint>", "inside": "array<boolean>", "title": "string"}, _hashed)
    parsed = parsed.where(F.size("lines") > 0).withColumn("row", F.monotonically_increasing_id()).withColumn("same", F.xxhash64("host", "lines"))
    parsed = checkpointed(parsed, "lines")
    # equal line lists of a host are one page, at the first path
    single = parsed.groupBy("host", "same").agg(F.min_by(F.struct("path", "row", "lines", "inside", "title"), F.struct("path", "row")).alias("p")).select("host", "same", "p.*")
    table = checkpointed(checkpointed(single, "single").repartitionByRange("host", "path", "row").withColumn("part", F.spark_partition_id()), "ranged")
    # at most two lines for each line of a page: half of the pages have each of them
    on = table.select("host", F.explode(F.array_distinct("lines")).alias("x")).groupBy("host", "x").agg(F.count("*").alias("c")).where(F.col("c") >= OFTEN)
    often = on.join(table.groupBy("host").agg(F.count("*").alias("n")), "host").where(2 * F.col("c") >= F.col("n")).groupBy("host").agg(F.collect_list("x").alias("often"))
    often = checkpointed(often, "often")
    theirs = table.select(F.col("row").alias("other"), F.col("lines").alias("theirs"), F.col("title").alias("their_title"))

    def met(sides: DataFrame) -> DataFrame:
        mine = table.select("row", "host", "lines", "inside", "title").join(sides, "row").join(theirs, "other").join(often, "host", "left")
        return mine.select("row", "lines", "inside", "title", "theirs", "their_title", "often")

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            copies, outer, inner = [], [], []
            for _, mine, inside, title, other, other_title, common in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                same, common = shared_lines(mine, other), set(common or ())
                copies.append(_is_copy(mine, other, same, bool(title) and title == other_title, common))
                kept = [] if copies[-1] else same
                outer.append([i for i in kept if not inside[i]])
                inner.append([i for i in kept if inside[i] and mine[i] in common] if title and other_title and title != other_title else [])
            places = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch[0], pa.array(copies, pa.bool_()), pa.array(outer, places), pa.array(inner, places), batch[5]], ["row", "copy", "outer", "inner", "their_title"]
            )

    shape = "row bigint, copy boolean, outer array<int>, inner array<int>, their_title string"
    first = neighbours(table.select("row", "host", "path", "part")).select("row", F.col("before").alias("other")).where("other is not null")
    led = checkpointed(_leaders(table, met(first).mapInArrow(run, shape).where("copy")), "led")
    near = neighbours(led.where("leader = row").select("row", "host", "path", "part")).withColumnRenamed("row", "leader")
    sides = led.select("row", "leader").join(near, "leader").select("row", F.explode(F.array("before", "after")).alias("other")).where("other is not null")
    found = met(sides).mapInArrow(run, shape).groupBy("row").agg(F.flatten(F.collect_list("outer")).alias("outer"), F.collect_list(F.struct("inner", "their_title")).alias("s"))
    both = F.when((F.size("s") == 2) & (F.col("s")[0]["their_title"] != F.col("s")[1]["their_title"]), F.array_intersect(F.col("s")[0]["inner"], F.col("s")[1]["inner"]))
    gone = found.select("row", F.array_union("outer", F.coalesce(both, F.array().cast("array<int>"))).alias("gone")).where(F.size("gone") > 0)
    gone = gone.join(table.select("row", "host", "same"), "row").select("host", "same", "gone")
    # equal rows have equal lists
    return parsed.select("id", "h", "host", "same").join(gone, ["host", "same"]).groupBy("id", "h").agg(F.first("gone").alias("gone"))


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per row the key, the URL, ``text`` (blocks joined by two line ends), ``n_chars``, and ``n_shared``, the lines lost to neighbours."""
    gone = checkpointed(template_lines(pages, key, url, html), "template").select(F.col("id").alias("_id"), F.col("h").alias("_h"), "gone")
    rows = pages.select(F.col(key).alias("id"), F.col(url).alias("url"), F.col(html).alias("t"))
    rows = rows.withColumn("h", F.xxhash64(F.coalesce("url", F.lit("")), F.coalesce("t", F.lit(""))))
    joined = rows.join(gone, F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left").select("id", "url", "gone", "t")

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in slices(batch, "t"):
                texts, lost = [], [len(x or ()) for x in part.column(2).to_pylist()]
                for page, drop in zip(part.column(3).to_pylist(), part.column(2).to_pylist(), strict=True):
                    found, inside = lines(page or "")
                    declared, without = any(inside), set(drop or ())
                    kept = [x for n, (x, i) in enumerate(zip(found, inside, strict=True)) if n not in without and (i or not declared)]
                    texts.append("\n\n".join(kept))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64()), pa.array(lost, pa.int64())], ["id", "url", "text", "n_chars", "n_shared"])

    kind, link = (pages.schema[c].dataType.simpleString() for c in (key, url))
    return joined.mapInArrow(run, f"id {kind}, url {link}, text string, n_chars bigint, n_shared bigint").toDF(key, url, "text", "n_chars", "n_shared")
