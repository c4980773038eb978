"""Main text of web pages: differences to pages with near URLs, with markup as a guard.

A page becomes lines, one per block element. The pages of a host are sorted by URL path, and each
is aligned, by longest common subsequences of all their lines, with the nearest pages that are no
near copies of it or of each other. What half of them share is the site's, not the page's, and goes.

Markup guards on both sides. Lines in menus, headers, footers, sidebars, forms, adverts and
comments are left out whether shared or not: such lines also differ from page to page. Lines inside
``article`` or ``main`` go only if all the other pages have them inside theirs: quoted passages are
common between pages of a host. A class or id that names a site part rules out what lies outside
``article`` and ``main``; inside, it only takes the guard away, and the other pages decide. Strong
evidence in one place takes nothing from lines elsewhere.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import defaultdict
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askframe.llm.aliases import host_of, path_of
from askframe.llm.common import arrow_columns, col, kept
from askframe.llm.shards import ranked

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)"""
    r"""((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_NAME = re.compile(r"[a-z0-9]+")
#: A self-closing tag; the slash at the end of a value without quotes is the value's.
_CLOSED = re.compile(r"""(?<!=)(?:^|[\s"']|(?:^|\s)[^\s=]+)/\Z""")

#: Elements whose content is no markup: skipped up to their end tag.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "noembed"}
#: Elements that never hold main text.
SITE = {"nav", "footer", "aside", "form", "header", "menu", "dialog", "button", "select", "head",
        "object", "fieldset"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that end a line.
BLOCKS = HEADINGS | SITE | {
    "html", "body", "article", "main", "section", "div", "p", "ul", "ol", "li", "dl", "dt", "dd",
    "table", "thead", "tbody", "tfoot", "tr", "caption", "blockquote", "pre", "figure",
    "figcaption", "address", "hr", "details", "summary", "center"}
#: Elements that nest and are tracked.
NESTED = BLOCKS - {"p", "hr"} - HEADINGS
#: Words in class, id or role that name a part of the site (see ``_names``).
SITE_WORDS = {
    "nav", "navbar", "navigation", "menu", "sidebar", "footer", "header", "masthead", "ad", "ads",
    "advert", "adverts", "advertisement", "banner", "promo", "sponsor", "sponsored", "cookie",
    "cookies", "consent", "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay",
    "newsletter", "subscribe", "subscription", "share", "sharing", "social", "related",
    "recommended", "breadcrumb", "breadcrumbs", "pagination", "pager", "widget", "toolbar",
    "login", "signup", "search", "contentinfo", "complementary", "dialog"}
#: Words that may stand beside these in the name of a site part.
LAYOUT_WORDS = {
    "site", "page", "global", "main", "top", "bottom", "left", "right", "primary", "secondary", "bar",
    "box", "block", "container", "wrapper", "wrap", "inner", "outer", "panel", "section", "area", "list",
    "item", "items", "link", "links", "button", "buttons", "icon", "icons", "form", "row", "col", "column",
    "unit", "slot", "zone", "sticky", "fixed", "small", "large", "mobile", "desktop", "js", "is", "the"}
COMMENT_WORDS = {"comment", "comments", "commentlist", "reply", "replies", "respond", "disqus",
                 "discussion"}
#: Words that name the main text, where no element does.
MAIN_WORDS = {"article", "articlebody", "post", "entry", "story", "content", "main"}

RULED_OUT, UNDECIDED, NAMED, MARKED = -1, 0, 1, 2

#: Pages are compared with those up to so many places away in URL order, then with samples.
NEAR = 8
#: Sample pages of a host, for pages whose neighbours are all their copies.
SAMPLES = 16
#: A page is compared with so many others at most that are no near copies of it or each other.
OTHERS = 6
#: Pages with more than this share of lines in common are near copies.
COPY_SHARE = 0.8
#: A line goes if half of the others share it, and so many where there are as many. A line of
#: ``article`` goes only if all of them share it, and they are at least so many.
LEAST, LEAST_MARKED = 2, 4
#: Places in URL order that one task takes together.
_CHUNK = 256


def _names(attributes: str) -> tuple[set[str], bool]:
    """The words of class, id and role, and whether one of the names there is that of a site part:
    made of site words and words of layout alone. ``share-of-market`` is none, ``share-bar`` is."""
    if "=" not in attributes:
        return set(), False
    words, site = set(), False
    for m in _ATTRIBUTE.finditer(attributes):
        for name in m[2].lower().split():
            own = set(_NAME.findall(name))
            words |= own
            site = site or (bool(own & SITE_WORDS) and own <= SITE_WORDS | LAYOUT_WORDS)
    return words, site


def lines_of(page: str | None) -> tuple[list[str], list[int]]:
    """The lines of a page with the strongest evidence on it, and the evidence for each.

    This is what markup alone says: lines in ``article`` or ``main``, else those in parts named as
    content, else all that are not ruled out. ``main_text`` does not stop at it.
    """
    lines = [(t, e) for t, e in parsed(page) if e != RULED_OUT]
    best = max((e for _, e in lines), default=UNDECIDED)
    chosen = [(t, e) for t, e in lines if e == best]
    return [t for t, _ in chosen], [e for _, e in chosen]


def parsed(page: str | None) -> list[tuple[str, int]]:
    """All lines of a page in order, and the evidence for each.

    Character references are decoded, white space inside a line is one space; empty lines are left
    out. Null is an empty page.
    """
    lines: list[tuple[str, int]] = []
    parts: list[str] = []
    # Open elements: name, evidence inside, and whether text inside is dropped (why).
    stack: list[tuple[str, int, str]] = []
    heading = main_seen = False

    def end_line() -> None:
        text = " ".join(entities.unescape("".join(parts)).split())
        parts.clear()
        if text:
            evidence, dropped = stack[-1][1:] if stack else (UNDECIDED, "")
            out = dropped and not (dropped == "header" and heading)
            lines.append((text, RULED_OUT if out else evidence))

    page = page or ""
    at = 0
    while True:
        token = _TOKEN.search(page, at)
        parts.append(page[at:token.start() if token else len(page)])
        if token is None:
            break
        at = token.end()
        if token[2] is None:
            continue
        name, closing = token[2].lower(), bool(token[1])
        if not closing and name == "svg" and _CLOSED.search(token[3]):
            continue
        if not closing and name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name not in BLOCKS:
            if name in ("br", "td", "th"):
                parts.append(" ")
            continue
        end_line()
        heading = name in HEADINGS and not closing
        if name not in NESTED:
            continue
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
            continue
        evidence, dropped = (stack[-1][1], stack[-1][2]) if stack else (UNDECIDED, "")
        words, site = _names(token[3])
        if name in ("article", "main"):
            if not words & COMMENT_WORDS and (dropped == "site" and not main_seen or not dropped):
                evidence, dropped, main_seen = MARKED, "", True
            elif words & COMMENT_WORDS:
                dropped = dropped or "comments"
        elif name in ("html", "body"):
            pass
        elif not dropped:
            if name == "header" and evidence == MARKED:
                dropped = "header"  # its headings belong to the article
            elif name in SITE:
                dropped = "element"
            elif words & COMMENT_WORDS:
                dropped = "comments"
            elif site and evidence == MARKED:
                evidence = UNDECIDED  # inside the article a name alone takes nothing away
            elif site:
                dropped = "site"
            elif words & MAIN_WORDS:
                evidence = max(evidence, NAMED)
        stack.append((name, evidence, dropped))
    end_line()
    return lines


def _row(a: list, b: list) -> np.ndarray:
    """Lengths of the longest common subsequences of ``a`` with every prefix of ``b``, by bits."""
    places: dict = defaultdict(int)
    for j, x in enumerate(b):
        places[x] |= 1 << j
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & places.get(x, 0)
        v = ((v + u) | (v - u)) & full
    bits = np.unpackbits(
        np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[:len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def common(a: list, b: list) -> list[int]:
    """Places in ``a`` of a longest common subsequence with ``b``, in memory linear in both."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    out = list(range(head))
    work = [(head, len(a) - tail, head, len(b) - tail)]
    while work:
        a0, a1, b0, b1 = work.pop()
        if a0 >= a1 or b0 >= b1:
            continue
        if a1 - a0 == 1:
            if a[a0] in b[b0:b1]:
                out.append(a0)
            continue
        middle = (a0 + a1) // 2
        left = _row(a[a0:middle], b[b0:b1])
        right = _row(a[middle:a1][::-1], b[b0:b1][::-1])
        cut = b0 + int(np.argmax(left + right[::-1]))
        work += [(a0, middle, b0, cut), (middle, a1, cut, b1)]
    out += range(len(a) - tail, len(a))
    return sorted(out)


def shared(a: list, b: list) -> list[int]:
    """``common`` of lists that have little in common: only what is in both is aligned."""
    in_a, in_b = set(a), set(b)
    places = [i for i, x in enumerate(a) if x in in_b]
    return [places[i] for i in common([a[i] for i in places], [x for x in b if x in in_a])]


def marks(lines: list[tuple[str, int]]) -> tuple[list[int], list[int]]:
    """A number for each line, and its evidence. A line of ``article`` is equal to such lines only."""
    return [
        int.from_bytes(hashlib.blake2b(
            f"{e == MARKED:d}{t}".encode("utf-8", "surrogatepass"), digest_size=8).digest(),
            "little", signed=True)
        for t, e in lines], [e for _, e in lines]


def decide(own: tuple[list[int], list[int]], others: Iterable[tuple[list[int], list[int]]]) -> list[int]:
    """Places of lines that are the site's: shared with pages that are no copies.

    ``others`` are the pages to compare with, nearest first. Near copies of the page or of an
    earlier one are passed over; without any other page nothing goes.
    """
    def open_lines(page: tuple) -> int:
        return sum(e != RULED_OUT for e in page[1])

    def near(page: tuple, other: tuple, places: list[int]) -> bool:
        both = sum(page[1][i] != RULED_OUT for i in places)
        return 2 * both > COPY_SHARE * (open_lines(page) + open_lines(other))

    used: list[tuple] = []
    votes = [0] * len(own[0])
    for other in others:
        places = shared(own[0], other[0])
        if not open_lines(other) or near(own, other, places):
            continue
        if any(near(u, other, shared(u[0], other[0])) for u in used):
            continue
        used.append(other)
        for i in places:
            votes[i] += 1
        if len(used) == OTHERS:
            break
    half = (len(used) + 1) // 2
    least = {UNDECIDED: max(1, half, min(LEAST, len(used))), NAMED: max(half, LEAST),
             MARKED: max(LEAST_MARKED, len(used))}
    return [i for i, (n, e) in enumerate(zip(votes, own[1])) if e != RULED_OUT and n >= least[e]]


def _decisions(chunk: pa.Table) -> pa.Table:
    """``decide`` for the home pages of a chunk, against the pages near them and the samples."""
    rows = {}
    for row in sorted(chunk.to_pylist(), key=lambda r: (r["home"], r["sampled"])):
        known = rows.setdefault(row["rank"], row)
        known["home"] |= row["home"]
        known["sampled"] |= row["sampled"]
    samples: dict = defaultdict(list)
    for row in rows.values():
        if row["sampled"]:
            samples[row["host"]].append(row["rank"])
    out: list[tuple] = []
    for rank, row in rows.items():
        if not row["home"]:
            continue
        near = [r for r in range(rank - NEAR, rank + NEAR + 1)
                if r in rows and rows[r]["host"] == row["host"]]
        ranks = sorted({*near, *samples[row["host"]]} - {rank}, key=lambda r: (abs(r - rank), r))
        gone = decide((row["lines"], row["levels"]),
                      ((rows[r]["lines"], rows[r]["levels"]) for r in ranks))
        if gone:
            out.append((row["host"], row["sig"], gone))
    columns = list(zip(*out)) or [(), (), ()]
    return pa.table({
        "host": pa.array(columns[0], pa.string()), "sig": pa.array(columns[1], pa.int64()),
        "gone": pa.array(columns[2], pa.list_(pa.int32()))})


def _shared(pages: DataFrame) -> DataFrame:
    """``key`` and ``gone``, the places of lines to delete, for pages that lose any."""
    def make(batch: pa.RecordBatch) -> list:
        found = [marks(parsed(p.as_py())) for p in batch.column(batch.schema.names.index("html"))]
        return [[lines for lines, _ in found], [levels for _, levels in found]]

    read = arrow_columns(
        pages, ["key", "host", "path", "html"], "lines array<bigint>, levels array<int>", make)
    light = kept(
        read.select("key", "host", "path", "lines", "levels",
                    F.xxhash64("lines", "levels").alias("sig")), "page-lines")
    # Pages with the same lines count once, at the smallest path.
    first = light.groupBy("host", "sig").agg(F.min(F.struct("path", "lines", "levels")).alias("page"))
    places = kept(
        ranked(first.where("size(page.lines) > 0").select("host", "sig", "page.*"),
               ["host", "path", "sig"], "rank").select("rank", "host", "sig", "lines", "levels"),
        "page-places")
    chunk = F.expr(f"rank div {_CHUNK}")
    page = ["rank", "host", "sig", "lines", "levels"]
    near = places.withColumn("chunk", F.explode(F.array_distinct(F.array(
        chunk, F.expr(f"greatest(rank - {NEAR}, 0) div {_CHUNK}"),
        F.expr(f"(rank + {NEAR}) div {_CHUNK}")))))
    near = near.select("chunk", *page, (F.col("chunk") == chunk).alias("home"),
                       F.lit(False).alias("sampled"))
    drawn = places.groupBy("host", F.pmod(F.xxhash64("sig"), F.lit(SAMPLES)).alias("bucket")).agg(
        F.min(F.struct(F.xxhash64("sig", F.lit(1)).alias("draw"),
                       *[c for c in page if c != "host"])).alias("page"))
    far = places.select("host", chunk.alias("chunk")).distinct().join(drawn, "host").select(
        "chunk", "page.rank", "host", "page.sig", "page.lines", "page.levels",
        F.lit(False).alias("home"), F.lit(True).alias("sampled"))
    gone = near.unionByName(far).groupBy("chunk").applyInArrow(
        _decisions, "host string, sig bigint, gone array<int>")
    gone = kept(gone, "page-shared")
    return light.select("key", "host", "sig").distinct().join(gone, ["host", "sig"]).select("key", "gone")


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``text`` (lines joined by ``\\n``) and ``n_chars`` (code points).

    One row per row of ``pages``; null pages have an empty text. Pages equal in key, url and html
    count as one when pages are compared. A null url, or one without ``://``, has an empty host and
    path like any other host. A page without others than near copies on its host loses no line.
    """
    own = pages.select(col(key).alias("page_id"), col(url).alias("url"), col(html).alias("html"))
    keyed = own.withColumn("key", F.xxhash64("page_id", "url", "html"))
    gone = _shared(keyed.select(
        "key", host_of(F.coalesce("url", F.lit(""))).alias("host"),
        path_of(F.coalesce("url", F.lit(""))).alias("path"), "html"))

    def make(batch: pa.RecordBatch) -> list:
        names = batch.schema.names
        out = []
        for page, cut in zip(batch.column(names.index("html")), batch.column(names.index("gone"))):
            lines, drop = parsed(page.as_py()), set(cut.as_py() or ())
            out.append("\n".join(
                t for i, (t, e) in enumerate(lines) if e != RULED_OUT and i not in drop))
        return [out]

    joined = keyed.join(gone, "key", "left")
    made = arrow_columns(joined, ["page_id", "url", "html", "gone"], "text string", make)
    return made.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
