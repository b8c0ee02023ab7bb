"""HTML pages to titled Markdown and plain text.

The tree work of one page is inherently per document, so it runs in ``mapInPandas``: Arrow
batches in, six columns out, no shuffle.  The rest of the import works on those columns.
All steps walk the tree with explicit stacks and touch each node a fixed number of times,
so unclosed tags and deep nesting cost no more than other markup.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fitweave import vocab

PAGE_SCHEMA = "page_id bigint, url string, html string"
CLEAN_SCHEMA = (
    "page_id bigint, url string, raw_hash string, title string, markdown string, plain_text string, "
    "related_removed boolean, block_score int"
)
VOID = {
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr",
}
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
SECTIONS = ("section", "aside", "div", "ul", "ol")
PARAGRAPHS = {
    "address", "article", "aside", "body", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "html", "main", "p", "section", "summary",
}
NOISE = re.compile("|".join(vocab.NOISE_NAMES), re.I)
RELATED = re.compile(rf"\b(?:{'|'.join(vocab.RELATED_HEADINGS)})\b", re.I)
DETAIL = re.compile(rf"\b(?:{'|'.join(vocab.DETAIL_HEADINGS)})\b", re.I)
SPACES = re.compile(r"\s+")


class Node:
    """An element; ``gone`` elements are skipped with all below them."""

    __slots__ = ("tag", "attrs", "children", "parent", "gone")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.children, self.parent, self.gone = tag, attrs, [], parent, False

    def walk(self) -> Iterator[Node | str]:
        """Everything below, in document order."""
        stack = [iter(self.children)]
        while stack:
            child = next(stack[-1], None)
            if child is None:
                stack.pop()
            elif isinstance(child, str):
                yield child
            elif not child.gone:
                yield child
                stack.append(iter(child.children))

    def nodes(self) -> Iterator[Node]:
        return (n for n in self.walk() if isinstance(n, Node))

    def text(self) -> str:
        return " ".join(s for s in (n.strip() for n in self.walk() if isinstance(n, str)) if s)

    def first(self, tag: str) -> Node | None:
        return next((n for n in self.nodes() if n.tag == tag), None)


class _Builder(HTMLParser):
    """Nested nodes as written: a missing end tag leaves the element open."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.top = Node("", {}, None)
        self.open: dict[str, int] = {}

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.top)
        self.top.children.append(node)
        if tag not in VOID:
            self.top = node
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_endtag(self, tag):
        if not self.open.get(tag):
            return
        closed = None
        while closed != tag:
            closed = self.top.tag
            self.open[closed] -= 1
            self.top = self.top.parent

    def handle_data(self, data):
        self.top.children.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def page_title(root: Node) -> str | None:
    """First h1 with text, else social titles, else the title element."""
    heading = root.first("h1")
    if heading and (text := heading.text()):
        return text
    named = {}
    for node in root.nodes():
        if node.tag == "meta" and node.attrs.get("content"):
            for attribute in ("property", "name"):
                named.setdefault((attribute, node.attrs.get(attribute)), node.attrs["content"].strip())
    for wanted in (("property", "og:title"), ("name", "twitter:title")):
        if wanted in named:
            return named[wanted]
    title = root.first("title")
    return title.text() or None if title else None


def drop_noise(root: Node) -> None:
    """Embedded documents are opened, page furniture goes."""
    for node in root.nodes():
        source = node.attrs.get("srcdoc", "") if node.tag == "iframe" else ""
        if source.strip():
            inner = parse(source)
            node.tag, node.attrs, node.children = "div", {}, (inner.first("body") or inner).children
            for child in node.children:
                if isinstance(child, Node):
                    child.parent = node
        named = f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}"
        node.gone = (
            node.tag in vocab.DROPPED_TAGS or node.attrs.get("aria-hidden") == "true" or bool(NOISE.search(named))
        )


class Outline:
    """All elements of a tree in document order, with their ranges in its whole text.

    Phrases are searched once in the whole text; whether an element holds one is then a lookup, also
    when elements of a broken page all lie inside each other.
    """

    def __init__(self, root: Node):
        self.entries: list[tuple[Node, int, int]] = []
        self.place: dict[int, int] = {}
        texts: list[str] = []
        starts = [0]
        stack: list[tuple[int, Iterator]] = [(-1, iter(root.children))]
        open_at: list[int] = []
        while stack:
            at, children = stack[-1]
            child = next(children, None)
            if child is None:
                stack.pop()
                if at >= 0:
                    node, first, _ = self.entries[at]
                    self.entries[at] = (node, open_at.pop(), starts[-1] - 1 if len(texts) > first else -1)
            elif isinstance(child, str):
                if stripped := child.strip():
                    texts.append(stripped)
                    starts.append(starts[-1] + len(stripped) + 1)
            elif not child.gone:
                self.place[id(child)] = len(self.entries)
                stack.append((len(self.entries), iter(child.children)))
                self.entries.append((child, len(texts), 0))
                open_at.append(starts[-1])
        self.text = " ".join(texts)
        self.related = [m.span() for m in RELATED.finditer(self.text)]
        self.details = [m.span() for m in DETAIL.finditer(self.text)]

    @staticmethod
    def count(found: list[tuple[int, int]], start: int, end: int) -> int:
        """Phrases that lie within a range of the text."""
        return max(0, bisect_right(found, end, key=lambda m: m[1]) - bisect_left(found, start, key=lambda m: m[0]))

    def below(self, node: Node) -> list[tuple[Node, int, int]]:
        """Entries inside an element: they follow it until the first that is not inside."""
        at = self.place.get(id(node), -1) + 1
        return self.entries[at : at + sum(1 for _ in node.nodes())]


def main_block(root: Node, outline: Outline) -> tuple[Node, int | None]:
    """The block that most likely holds the advertisement, and its score."""
    sums = [(0, 0, 0)]  # of the headings up to h3: h1 elements, those naming details, related phrases
    before: list[int] = []
    for node, start, end in outline.entries:
        before.append(len(sums) - 1)
        if node.tag in HEADINGS[:3]:
            main, detail, related = sums[-1]
            sums.append((
                main + (node.tag == "h1"),
                detail + bool(outline.count(outline.details, start, end)),
                related + outline.count(outline.related, start, end),
            ))
    before.append(len(sums) - 1)
    # the number of entries inside each: an entry's parent always comes before it
    inside = [0] * len(outline.entries)
    for at in range(len(inside) - 1, -1, -1):
        above = outline.place.get(id(outline.entries[at][0].parent))
        if above is not None:
            inside[above] += inside[at] + 1
    best: tuple[Node, int] | None = None
    body = None
    for at, (node, start, end) in enumerate(outline.entries):
        body = body or (node if node.tag == "body" else None)
        if node.tag in ("main", "article") or node.attrs.get("role") == "main":
            main, detail, related = (
                y - x for x, y in zip(sums[before[at + 1]], sums[before[at + 1 + inside[at]]], strict=True)
            )
            score = max(0, end - start) // 40 + 300 * (main > 0) + 500 * (detail > 0) - 700 * related
            if best is None or score > best[1]:
                best = (node, score)
    return best or (body or root, None)


def drop_related(block: Node, outline: Outline) -> bool:
    """Recommendation sections go by their heading."""
    related = [
        n for n, start, end in outline.below(block) if n.tag in HEADINGS and outline.count(outline.related, start, end)
    ]
    above: set[int] = set()
    holder = block
    while holder is not None and related:
        above.add(id(holder))
        holder = holder.parent
    nearest: dict[int, Node | None] = {}
    for heading in related:
        path, holder = [], heading.parent
        while holder is not None and holder.tag not in SECTIONS and id(holder) not in nearest:
            path.append(holder)
            holder = holder.parent
        if holder is not None and holder.tag not in SECTIONS:
            holder = nearest[id(holder)]
        nearest.update((id(n), holder) for n in path)
        if holder is None or holder is block:
            heading.gone = True
        elif id(holder) in above:
            block.children = []
        else:
            holder.gone = True
    return bool(related)


def lift_items(block: Node) -> None:
    """List items nested directly in items become siblings, in the order they are shown."""
    for node in [block, *block.nodes()]:
        if node.tag == "li" and node is not block:
            continue  # handled from the first element above it that is no item
        result: list[Node | str] = []
        pending = [iter(node.children)]
        while pending:
            child = next(pending[-1], None)
            if child is None:
                pending.pop()
                continue
            result.append(child)
            if isinstance(child, Node) and child.tag == "li":
                child.parent = node
                nested = [c for c in child.children if isinstance(c, Node) and c.tag == "li"]
                if nested:
                    child.children = [c for c in child.children if not (isinstance(c, Node) and c.tag == "li")]
                    pending.append(iter(nested))
        node.children = result


def _cell(text: str) -> str:
    return SPACES.sub(" ", text).strip()


def _indented(text: str, first: str, rest: str) -> str:
    lines = text.split("\n")
    return "\n".join([first + lines[0], *(rest + line if line else line for line in lines[1:])])


def _table(rows: list[tuple[list[str], bool]]) -> str:
    """Rows of cells; the first row is the header if it is marked as one, else the header is empty."""
    rows = [r for r in rows if r[0]]
    if not rows:
        return ""
    width = max(len(cells) for cells, _ in rows)
    if not rows[0][1]:
        rows = [([], True), *rows]
    lines = [f"| {' | '.join(cells + [''] * (width - len(cells)))} |" for cells, _ in rows]
    lines.insert(1, f"| {' | '.join(['---'] * width)} |")
    return "\n\n" + "\n".join(lines) + "\n\n"


def _joined(parts: list) -> str:
    """The texts of a list of texts and such lists."""
    out, stack = [], [iter(parts)]
    while stack:
        part = next(stack[-1], None)
        if part is None:
            stack.pop()
        elif isinstance(part, str):
            out.append(part)
        else:
            stack.append(iter(part))
    return "".join(out)


# elements whose form depends on their text as a whole
SHAPED = {
    *HEADINGS, "br", "hr", "img", "title", "head", "td", "th", "tr", "thead", "tbody", "tfoot", "table", "li", "ul",
    "ol", "blockquote", "pre", "code", "kbd", "samp", "b", "strong", "em", "i", "del", "s", "a",
}


class _Writer:
    """What an open element has collected, and how it is written when it closes.

    Elements that only pass their content on hand over their list, so no text is copied per level.
    """

    __slots__ = ("node", "children", "parts", "rows", "items", "verbatim", "listed")

    def __init__(self, node: Node, above: _Writer | None):
        self.node, self.children, self.parts = node, iter(node.children), []
        self.rows: list[tuple[list[str], bool]] = []
        self.items = 0
        self.verbatim = node.tag == "pre" or above is not None and above.verbatim
        self.listed = node.tag in ("ul", "ol") or above is not None and above.listed

    def close(self, above: _Writer | None) -> str | list:
        tag = self.node.tag
        if tag not in SHAPED:
            return ["\n\n", self.parts, "\n\n"] if tag in PARAGRAPHS and not self.verbatim else self.parts
        inner = _joined(self.parts)
        flat = inner.strip()
        if tag in HEADINGS:
            return f"\n\n{'#' * int(tag[1])} {_cell(flat)}\n\n" if flat else ""
        if tag == "br":
            return "  \n"
        if tag == "hr":
            return "\n\n---\n\n"
        if tag == "img":
            return f"![{self.node.attrs.get('alt', '')}]({self.node.attrs.get('src', '')})"
        if tag in ("title", "head"):
            return ""
        if tag in ("td", "th"):
            if above is not None:
                above.parts.append(" ")
                above.rows.append(([_cell(flat).replace("|", "\\|")], tag == "th"))
            return inner + " "
        if tag == "tr":
            cells = [c for row, _ in self.rows for c in row]
            if above is not None and cells:
                above.rows.append((cells, all(h for _, h in self.rows)))
                return ""
            return inner
        if tag in ("thead", "tbody", "tfoot") and above is not None:
            above.rows += self.rows
            return ""
        if tag == "table":
            return (f"\n\n{flat}\n\n" if flat else "") + _table(self.rows)
        if tag == "li":
            if above is not None:
                above.items += 1
            numbered = above is not None and above.node.tag == "ol"
            start = above.node.attrs.get("start", "") if numbered else ""
            mark = f"{(int(start) if start.isdecimal() else 1) + above.items - 1}. " if numbered else "- "
            body = re.sub(r"\n{2,}", "\n", flat)
            return _indented(body, mark, " " * len(mark)) + "\n" if flat else ""
        if tag in ("ul", "ol"):
            inside = above is not None and above.listed
            return (f"\n{flat}\n" if inside else f"\n\n{flat}\n\n") if flat else ""
        if tag == "blockquote":
            text = re.sub(r"\n{3,}", "\n\n", flat)
            return "\n\n" + "\n".join(f"> {line}".rstrip() for line in text.split("\n")) + "\n\n" if flat else ""
        if tag == "pre":
            return f"\n\n```\n{inner.strip(chr(10))}\n```\n\n" if flat else ""
        if tag in ("code", "kbd", "samp"):
            fence = "`" * (1 + max((len(m) for m in re.findall("`+", flat)), default=0))
            return inner if self.verbatim else f"{fence}{flat}{fence}" if flat else ""
        if tag in ("b", "strong", "em", "i", "del", "s"):
            mark = {"b": "**", "strong": "**", "em": "*", "i": "*"}.get(tag, "~~")
            return inner if self.verbatim else f"{mark}{flat}{mark}" if flat else ""
        if tag == "a" and self.node.attrs.get("href") and flat:
            return f"[{flat}]({self.node.attrs['href']})"
        return inner


def markdown(block: Node) -> str:
    """ATX headings, ``-`` bullets, numbered items, pipe tables, quotes and fenced code."""
    stack = [_Writer(block, None)]
    while True:
        top = stack[-1]
        child = next(top.children, None)
        if child is None:
            stack.pop()
            text = top.close(stack[-1] if stack else None)
            if not stack:
                break
            if text:
                stack[-1].parts.append(text)
        elif isinstance(child, str):
            top.parts.append(child if top.verbatim else SPACES.sub(" ", child))
        elif not child.gone:
            stack.append(_Writer(child, top))
    out, fenced = [], False
    for line in _joined([text]).split("\n"):
        if line == "```":
            fenced = not fenced
        if fenced or line.endswith("  ") and line.strip():
            out.append(line)  # code, and the two blanks of a line break
        else:
            plain = line.rstrip()
            out.append(plain if re.match(r" *(?:[-*>|]|[0-9]+\.) |  +\S", plain) else plain.lstrip())
    return re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip()


def clean_page(html: str) -> tuple[str | None, str, str, bool, int | None]:
    root = parse(html)
    title = page_title(root)
    drop_noise(root)
    outline = Outline(root)
    block, score = main_block(root, outline)
    removed = drop_related(block, outline)
    lift_items(block)
    return title, markdown(block), block.text(), removed, score


def _clean_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        cleaned = [clean_page(html or "") for html in batch["html"]]
        yield pd.DataFrame(
            {
                "page_id": batch["page_id"],
                "url": batch["url"],
                "raw_hash": batch["raw_hash"],
                "title": [c[0] for c in cleaned],
                "markdown": [c[1] for c in cleaned],
                "plain_text": [c[2] for c in cleaned],
                "related_removed": [c[3] for c in cleaned],
                "block_score": pd.array([c[4] for c in cleaned], dtype="Int32"),
            }
        )


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAGE_SCHEMA).parquet(path)


def page_problem(limit: int | None = None) -> Column:
    """Why a page cannot be read as HTML; null for pages that can.

    ``limit`` is a size in bytes for callers that have to bound one page; by default there is none.
    """
    lower = F.lower("html")
    problem = F.when(F.col("html").isNull(), "no content").when(
        ~(lower.contains("<html") | lower.contains("<!doctype html")), "not html"
    )
    return problem if limit is None else problem.when(F.octet_length("html") > limit, "too large")


def recognizable_html(pages: DataFrame, limit: int | None = None) -> DataFrame:
    """Pages that look like HTML."""
    return pages.where(page_problem(limit).isNull())


def quarantined_pages(pages: DataFrame, limit: int | None = None) -> DataFrame:
    """The other pages, whole, with the reason."""
    return pages.withColumn("reason", page_problem(limit)).where(F.col("reason").isNotNull())


def clean_pages(pages: DataFrame) -> DataFrame:
    """Title, Markdown and text of every page (P1), and the hash of its bytes."""
    keyed = pages.select("page_id", "url", "html", F.sha2("html", 256).alias("raw_hash"))
    return keyed.mapInPandas(_clean_batches, CLEAN_SCHEMA)
