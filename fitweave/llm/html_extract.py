"""Main text of web pages by consensus paths of their host.

Three steps.  (1) Every page scores its containers: each block of text that is not boilerplate gives its
characters outside links to the nearest container and half of them to the one around it.  (2) In Spark,
pages vote per host for the generalised tag-class path of their best containers; a vote is the
container's share of the page's score, so every page has the same say.  Votes inside an ``article`` or
``main`` element count for that element.  Outside of these a container's vote goes to the highest one around
it that adds prose (text of its own, a heading, or a block of four words or more outside links), so that
sections, leads and titles beside the best container are not lost, and on as long as nothing else is added.
What is beside the chosen container stays out: links and labels of up to three words.  (3) Every page is read again and the text of the elements on
its host's winning path is taken; a page without such an element, or with empty ones only, uses its own best path.

Boilerplate is what contracts call menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles and reader comments: by element, or by a class token or id made of such words.  An element that holds the
page's main element, all its articles or nearly all its text is none (``spared``).  Blocks are trimmed, white space
inside them becomes one space, and they are joined by line feeds in page order.

The winning paths, one short row per host, are broadcast only while there are at most ``BROADCAST_HOSTS``
of them; beyond that pages meet them in a salted join.  Parsing uses one pass over the tags with an
explicit stack, so deep nesting and unclosed elements cost no more than other markup.

Defined cases
* null or empty html gives an empty text; null urls share one (empty) host
* text outside any container belongs to the root, whose path is empty
* ties between paths: the one that sorts first; repeated rows give one result row each
* very long texts: time and memory grow with the page, one pass to find spared elements and one to read
* a raw element (``svg``, ``iframe``, ...) without an end is its tag alone; ``script`` and ``style`` reach to the end
* an empty table gives an empty result; extra columns are ignored
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from itertools import takewhile

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitweave.llm.common import materialize, spread_join

BROADCAST_HOSTS = 100_000
UP = "^"  # before a path, once per container between the best one and the one that is taken
LABEL_WORDS, LABEL_CHARS = 3, 24  # the longest text that is no prose; characters for scripts without blanks
VOTES = 3  # best containers of a page that get a vote

TAG = re.compile(r"<(?:!--|(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>[^>]*+)>|[!?][^>]*+>)")
# elements whose content is no markup, or none that is shown
RAW = {
    tag: re.compile(rf"<(?P<close>/?){tag}(?![\w:-])[^>]*?(?P<empty>/?)>", re.IGNORECASE)
    for tag in ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "select", "object")
}
SELF_CLOSING = frozenset(("svg",))
TO_THE_END = frozenset(("script", "style"))
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
QUOTE = re.compile("[\"']")
DIGITS = re.compile(r"[0-9]+")
PARTS = re.compile(r"[^a-z]+")

VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
CONTAINERS = frozenset(("div", "section", "article", "main", "td", "center", "blockquote", "details", "dd"))
DROPPED = frozenset(("head", "nav", "header", "footer", "aside", "form", "button", "menu", "dialog"))
BLOCKS = CONTAINERS | DROPPED | frozenset((
    "address", "body", "html", "dl", "dt", "fieldset", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "hr",
    "li", "ol", "p", "pre", "summary", "table", "tbody", "tfoot", "th", "thead", "tr", "ul", "caption", "legend",
))
BOILERPLATE = frozenset((
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "banner",
    "sidebar", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "footer", "header", "masthead",
    "cookie", "cookies", "consent", "gdpr", "notice", "popup", "modal", "newsletter", "subscribe", "share", "sharing",
    "social", "related", "recommended", "comment", "comments", "disqus", "respond", "pagination", "toolbar",
))
ROLES = frozenset(("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "form"))
# what may stand beside those words in one class token: "related-posts" speaks of related, "social-history" of history
COMPANIONS = frozenset((
    "posts", "articles", "stories", "box", "bar", "list", "links", "link", "item", "items", "block", "widget", "widgets",
    "inner", "slot", "unit", "thread", "section", "area", "top", "bottom", "left", "right", "main", "site", "global", "",
))
NEVER_WRAPS = frozenset(("head", "nav", "footer", "aside", "button", "menu", "dialog"))  # elements that are boilerplate whatever they hold
READERS = frozenset(("comment", "comments", "disqus", "respond"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
# elements whose class speaks about the page, not about themselves
WHOLE = frozenset(("html", "body", "main", "article"))


def tokens(html: str) -> Iterator[tuple[str, str, bool, str]]:
    """(text before, tag, whether it closes, attributes), and last the remaining text; in linear time.

    A ``>`` inside a quoted value belongs to the value if the quote is closed at all.
    """
    last = html.rfind(">") + 1  # no tag ends after it
    unclosed: set[str] = set()
    raw: dict[str, dict[int, int]] = {}
    done = at = 0
    while m := TAG.search(html, at, last):
        before = html[done : m.start()]
        at = m.end()
        tag, attrs = (m["tag"] or "").lower(), m["attrs"] or ""
        if m.group() == "<!--":
            end = html.find("-->", at)
            at = len(html) if end < 0 else end + 3
        elif tag and not m["close"]:
            quote = open_quote(attrs)
            while quote and quote not in unclosed:
                end = html.find(quote, at)
                stop = html.find(">", end + 1) if end >= 0 else -1
                if stop < 0:
                    unclosed.add(quote)
                    break
                attrs, at = attrs + ">" + html[at:stop], stop + 1
                quote = open_quote(html[end + 1 : stop])
            if tag in RAW:
                if tag in TO_THE_END:
                    at = next((end.end() for end in RAW[tag].finditer(html, at, last) if end["close"]), len(html))
                else:
                    if tag not in raw:
                        raw[tag] = raw_ends(html, tag, last)
                    at = max(at, raw[tag].get(m.start(), at))
                tag = ""
        yield before, tag, bool(m["close"]), attrs
        done = at
        if at >= last:
            break
    yield html[done:], "", False, ""


def raw_ends(html: str, tag: str, last: int) -> dict[int, int]:
    """Start of each opening tag of a raw element: where the element ends.  Unclosed and self-closed ones are left out."""
    ends: dict[int, int] = {}
    opened: list[int] = []
    for m in RAW[tag].finditer(html, 0, last):
        if not m["close"]:
            if not (m["empty"] and tag in SELF_CLOSING):
                opened.append(m.start())
        elif opened:
            ends[opened.pop()] = m.end()
    return ends


def open_quote(attrs: str) -> str:
    """The quote that is still open at the end of a tag's attributes."""
    quote = ""
    for mark in QUOTE.findall(attrs):
        quote = mark if not quote else "" if mark == quote else quote
    return quote


def kind(tag: str, attrs: str) -> tuple[str, bool, bool]:
    """(class value, whether the element looks like boilerplate, whether like reader comments), all by its tag alone."""
    classes, tokens_of, role = "", [], False
    for name, *values in ATTRIBUTE.findall(attrs) if attrs else ():
        value = next((v for v in values if v), "").lower()
        if name.lower() == "role":
            role = value in ROLES
        else:
            tokens_of += value.split()
            classes = value if name.lower() == "class" else classes
    words = [parts for parts in map(set, map(PARTS.split, tokens_of)) if parts <= BOILERPLATE | COMPANIONS]
    readers = any(parts & READERS for parts in words)
    if tag in WHOLE:
        return classes, tag == "article" and readers, readers
    return classes, tag in DROPPED or role or any(parts & BOILERPLATE for parts in words), readers


def spared(html: str) -> frozenset[int]:
    """Numbers of the opening tags that look like boilerplate and yet hold the page's text.

    Such an element holds the page's main element or all its articles, or, on a page without these, more
    than three quarters of the text outside links.  So does a header in an article that has a heading or a
    paragraph.  Reader comments are never among them, however long.
    """
    # open elements: tag, number (-1: not in question), and the counts when they were opened
    stack: list[tuple[str, int, tuple[int, int, int, int]]] = [("", -1, (0, 0, 0, 0))]
    opened: dict[str, int] = {}
    held: dict[int, tuple[int, int, int]] = {}
    keep: set[int] = set()
    mains = articles = prose = headings = link = 0

    def pop() -> None:
        tag, number, before = stack.pop()
        opened[tag] -= 1
        if number >= 0:
            held[number] = (mains - before[0], articles - before[1], prose - before[2])
            if tag == "header" and opened.get("article") and headings > before[3]:
                keep.add(number)

    number = -1
    for text, tag, closes, attrs in tokens(html):
        if not link:
            prose += len(text.strip())
        if not tag:
            continue
        if closes:
            link = 0 if tag == "a" else link
            if opened.get(tag):
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        number += 1
        if tag in BLOCKS:
            while stack[-1][0] == "p" or stack[-1][0] == "li" == tag:
                pop()
        if tag in VOID:
            continue
        link = 1 if tag == "a" else link
        _, dropped, readers = kind(tag, attrs)
        before = (mains, articles, prose, headings)
        mains += tag == "main"
        articles += tag == "article" and not dropped
        headings += tag == "p" or tag in HEADINGS
        if dropped or tag in CONTAINERS or opened.get(tag):
            stack.append((tag, -1 if readers or not dropped or tag in NEVER_WRAPS else number, before))
            opened[tag] = opened.get(tag, 0) + 1
    while len(stack) > 1:
        pop()
    for n, (m, a, p) in held.items():
        if m == mains if mains else a == articles if articles else 4 * p > 3 * prose:
            keep.add(n)
    return frozenset(keep)


class Page:
    """One pass over a page.  ``wanted`` is a path to extract, or None to score all containers."""

    def __init__(self, html: str, wanted: str | None = None):
        self.scores: dict[int, float] = {}
        self.blocks: list[str] = []
        self._nodes: list[tuple[int, str]] = [(-1, "")]  # parent and name of each path of this page
        self._known: dict[tuple[int, str], int] = {}
        # by node: has any text of its own, has text outside links of its own, has prose of its own
        self._own: dict[int, tuple[bool, bool, bool]] = {}
        self._heading = False
        self._up = len(wanted or "") - len((wanted or "").lstrip(UP))
        wanted = wanted and wanted.lstrip(UP)
        self._goal = wanted.split("/") if wanted else []
        self._scoring = wanted is None
        self._parts: list[str] = []
        self._link_chars = self._in_link = self._skip = 0
        self._take = int(wanted == "")
        # open elements: tag, path, dropped, taken, number of goal parts matched so far (-1: left the goal)
        self._stack: list[tuple[str, int, bool, bool, int]] = [("", 0, False, False, 0)]
        # open containers on the way up from the best one: place in the stack, blocks before it, text outside links
        self._ways: list[list] = []
        self._open: dict[str, int] = {}
        self._spared = spared(html)
        self._number = -1  # of the opening tag
        for text, tag, closes, attrs in tokens(html):
            if text:
                self._text(text)
            if tag and closes:
                self._end(tag)
            elif tag:
                self._start(tag, attrs)
        self._flush()

    def _text(self, text: str) -> None:
        if not self._skip and (self._scoring or self._take):
            self._parts.append(text)
            if self._in_link:
                self._link_chars += len(text)

    def _flush(self) -> None:
        if self._parts:
            text = " ".join(unescape("".join(self._parts)).split())
            self._parts = []
            if text and self._scoring:
                path = self._stack[-1][1]
                value = max(0.0, len(text) - 1.5 * self._link_chars)
                prose = value > 0 and (self._heading or len(text.split()) > LABEL_WORDS or len(text) > LABEL_CHARS)
                _, plain, more = self._own.get(path, (True, False, False))
                self._own[path] = (True, plain or value > 0, more or prose)
                self.scores[path] = self.scores.get(path, 0.0) + value
                if path:
                    outer = self._nodes[path][0]
                    self.scores[outer] = self.scores.get(outer, 0.0) + value / 2
            elif text:
                self.blocks.append(text)
                if self._ways and len(text) > 1.5 * self._link_chars:
                    self._ways[-1][2] = True
        self._link_chars = 0

    def _start(self, tag: str, attrs: str) -> None:
        self._number += 1
        if tag == "br":
            self._text("\n")
        if tag in BLOCKS:
            self._flush()
            while self._stack[-1][0] == "p" or self._stack[-1][0] == "li" == tag:  # closed by what follows
                self._pop()
            self._heading = tag in HEADINGS
        if tag in VOID:
            return
        if tag == "a":
            self._in_link = 1
        classes, dropped, _ = kind(tag, attrs)
        dropped = dropped and self._number not in self._spared
        container = tag in CONTAINERS and not dropped
        if not (dropped or container or self._open.get(tag)):
            return
        _, path, _, _, matched = self._stack[-1]
        taken = False
        if container:
            name = ".".join([tag, *sorted(set(DIGITS.sub("#", classes).replace("/", "|").split()))])
            inside = 0 <= matched < len(self._goal) and self._goal[matched] == name
            matched = matched + 1 if inside else -1
            taken = inside and matched == len(self._goal)
            child = self._known.setdefault((path, name), len(self._nodes))
            if child == len(self._nodes):
                self._nodes.append((path, name))
            path = child
        if container and self._take and len(self._ways) < self._up:
            self._ways.append([len(self._stack), len(self.blocks), False])
        self._stack.append((tag, path, dropped, taken, matched))
        self._open[tag] = self._open.get(tag, 0) + 1
        self._skip += dropped
        self._take += taken

    def _pop(self) -> None:
        tag, _, dropped, taken, _ = self._stack.pop()
        self._open[tag] -= 1
        self._skip -= dropped
        self._take -= taken
        if self._ways and self._ways[-1][0] == len(self._stack):
            _, before, plain = self._ways.pop()
            if not plain:  # links only, beside the best container
                del self.blocks[before:]
            elif self._ways:
                self._ways[-1][2] = True

    def _end(self, tag: str) -> None:
        if tag in BLOCKS:
            self._flush()
            self._heading = False
        if tag == "a":
            self._in_link = 0
        if self._open.get(tag):
            while self._stack[-1][0] != tag:
                self._pop()
            self._pop()

    def path(self, node: int) -> str:
        """The path, cut at its first article, or else its first main element."""
        names = []
        while node:
            node, name = self._nodes[node]
            names.append(name)
        names.reverse()
        for whole in ("article", "main"):
            for at, name in enumerate(names):
                if name.split(".", 1)[0] == whole:
                    return "/".join(names[: at + 1])
        return "/".join(names)

    def _gains(self) -> list[str]:
        """What each node's parent has beside it: "prose", "other" text, or nothing ("")."""
        size = len(self._nodes)
        own = [self._own.get(n, (False, False, False)) for n in range(size)]
        some, prose = [int(o[0]) for o in own], [int(o[2]) for o in own]  # 1 if the subtree has any
        with_some, with_prose = [0] * size, [0] * size  # children whose subtree has any
        for node in range(size - 1, 0, -1):  # parents have lower numbers
            parent = self._nodes[node][0]
            with_some[parent] += some[node]
            with_prose[parent] += prose[node]
            some[parent] |= some[node]
            prose[parent] |= prose[node]
        gains = [""]
        for node in range(1, size):
            parent = self._nodes[node][0]
            more = own[parent][1] or with_prose[parent] > prose[node]
            gains.append("prose" if more else "other" if own[parent][0] or with_some[parent] > some[node] else "")
        return gains

    def _around(self, node: int, gains: list[str]) -> tuple[str, int]:
        """The path that a container votes for, and how many containers above its own it is."""
        path = self.path(node)
        if any(name.split(".", 1)[0] in WHOLE for name in path.split("/")):
            return path, 0
        chain = [node]
        while chain[-1]:
            chain.append(self._nodes[chain[-1]][0])
        up = max((n + 1 for n, below in enumerate(chain[:-1]) if gains[below] == "prose"), default=0)
        up += sum(1 for _ in takewhile(lambda below: not gains[below], chain[up:-1]))
        return self.path(chain[up]), up

    def votes(self, most: int = VOTES) -> dict[str, int]:
        """Thousandths of the page's score by path, of its best containers; the best first."""
        best = sorted(self.scores.items(), key=lambda x: (-x[1], x[0]))[:most]
        total = sum(self.scores.values())
        gains = self._gains()
        shares: dict[str, float] = {}
        ways: dict[str, int] = {}
        for node, score in best:
            path, up = self._around(node, gains)
            shares[path] = shares.get(path, 0.0) + score
            ways.setdefault(path, up)
        found = sorted(shares.items(), key=lambda x: (-x[1], x[0]))
        return {UP * ways[p] + p: round(1000 * v / total) for p, v in found if v > 0}


def main_text(html: str | None, wanted: str | None) -> str:
    """Text of the elements on the wanted path, or on the page's own best path if they are missing or empty."""
    html = html or ""
    if wanted is not None:
        page = Page(html, wanted)
        if page.blocks:
            return "\n".join(page.blocks)
    own = next(iter(Page(html).votes()), "")
    return "\n".join(Page(html, own).blocks)


def host(url: str = "url") -> Column:
    found = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1)
    return F.lower(found)


def page_votes(pages: DataFrame) -> DataFrame:
    """(host, path, share) of every page."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (name, path, share)
                for name, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True)
                for path, share in (Page(html or "").votes() or {None: 0}).items()
            ]
            if rows:
                columns = zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64()), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in columns], ["host", "path", "share"])

    return pages.select(host().alias("host"), "html").mapInArrow(score, "host string, path string, share long")


def host_paths(pages: DataFrame) -> DataFrame:
    """The winning path of each host (null if no page of the host has any text)."""
    bare = F.ltrim("path", F.lit(UP))
    votes = page_votes(pages).select("host", bare.alias("path"), (F.length("path") - F.length(bare)).alias("up"), "share")
    counted = votes.groupBy("host", "path").agg(F.sum("share").alias("share"), F.min("up").alias("up"))
    whole = F.concat(F.repeat(F.lit(UP), F.col("up")), "path")
    chosen = F.min_by(whole, F.struct((-F.col("share")).alias("share"), "path")).alias("path")
    return counted.groupBy("host").agg(chosen)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and the main text of every page."""
    # a page's votes collapse by host and path before they shuffle, however many pages a host has
    winners = materialize(host_paths(pages), "host-paths")
    keyed = pages.select(F.col("page_id").cast("long"), "url", "html", host().alias("host"))
    if winners.count() <= BROADCAST_HOSTS:
        joined = keyed.join(F.broadcast(winners), "host", "left")
    else:
        sizes = pages.groupBy(host().alias("host")).agg(F.count(F.lit(1)).alias("n"))
        sized = winners.join(sizes, "host")
        joined = spread_join(keyed.withColumn("doc_id", F.col("page_id")), sized, "host", "n", "left")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py(), p.as_py()) for h, p in zip(batch.column("html"), batch.column("path"), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"]
            )

    return joined.select("page_id", "url", "html", "path").mapInArrow(read, "page_id long, url string, text string")
