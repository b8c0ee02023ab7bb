"""Secret scan through a trigram inverted index.

Each rule's regular expression is turned into a Boolean query over trigrams that every match must
contain: an OR of ANDs, in lower case.  Documents are indexed block by block inside the scan, as search
engines build segments: the trigrams of all queries get posting lists of the block's documents, the
lists are intersected and united as the queries say, and only those candidates are verified with the
regular expression.  A rule without mandatory trigrams (such as a run of hex digits) is verified on
every document.  Nothing is shuffled, texts never leave their task, and a block is bounded in bytes.

Defined cases
* null text counts as empty and has no spans; empty texts likewise
* very long texts are a block of their own, indexed in overlapping windows
* repeated rows and null ``doc_id`` give one result row each; ties in a start are ordered by rule
* an empty table gives an empty result; extra columns are ignored
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from re import _constants as ops
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 1 << 20
STRINGS = 64  # alternatives that one literal run may grow to


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str
    flags: int = re.ASCII
    group: int = 0
    least: int = 1  # characters of that group
    linear: str = ""  # finds the same spans, as its group "span", without starting anew inside a run

    def spans(self, compiled: re.Pattern, text: str) -> list[tuple[int, int]]:
        if "span" in compiled.groupindex:
            return [m.span("span") for m in compiled.finditer(text)]
        return [m.span() for m in compiled.finditer(text) if m.end(self.group) - m.start(self.group) >= self.least]


BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE, 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]{24,}"),  # maximal runs, as a run of any length filtered by length would give
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_bot", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    # the first "eyJ" of a run leaves the longest rest, so if it does not match, no later one of the run does
    Rule(
        "web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
        linear=r"(?<![A-Za-z0-9_-])(?>[A-Za-z0-9_-]*?(?=eyJ))(?P<span>eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)",
    ),
)
RULES = BASE_RULES + MORE_RULES

Query = frozenset  # an OR of ANDs: frozenset of frozensets of trigrams; a member that is empty means "all"
ALL: Query = frozenset([frozenset()])


def simplest(query: Query) -> Query:
    """Without members that a weaker member implies."""
    return frozenset(a for a in query if not any(b < a for b in query))


def both(a: Query, b: Query) -> Query:
    if len(a) * len(b) > STRINGS * STRINGS:
        return min(a, b, key=len)
    return simplest(frozenset(x | y for x in a for y in b))


def of_strings(strings: frozenset[str]) -> Query:
    return simplest(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings))


def mandatory(pattern: str, flags: int = 0) -> Query:
    """The Boolean trigram query of a regular expression."""
    strings, query = _sequence(parser.parse(pattern, flags))
    return query if strings is None else both(query, of_strings(strings))


def _sequence(nodes) -> tuple[frozenset[str] | None, Query]:
    """Of a sequence of nodes: all strings it can be (None: too many), and what else it must contain."""
    run: frozenset[str] = frozenset([""])
    exact, query = True, ALL
    for node in nodes:
        strings, inner = _node(node)
        query = both(query, inner)
        if strings is not None and len(run) * len(strings) <= STRINGS:
            run = frozenset(a + b for a in run for b in strings)
            continue
        exact = False
        query = both(query, of_strings(run))
        run = frozenset([""]) if strings is None else strings
    if exact:
        return run, query
    return None, both(query, of_strings(run))


def _node(node) -> tuple[frozenset[str] | None, Query]:
    kind, value = node
    if kind is ops.LITERAL:
        return frozenset([chr(value).lower()]), ALL
    if kind is ops.SUBPATTERN:
        return _sequence(value[-1])
    if kind is ops.AT:
        return frozenset([""]), ALL
    if kind is ops.IN:
        chars = set()
        for part, what in value:
            if part is ops.LITERAL:
                chars.add(chr(what).lower())
            elif part is ops.RANGE and what[1] - what[0] < STRINGS:
                chars |= {chr(c).lower() for c in range(what[0], what[1] + 1)}
            else:
                return None, ALL
        return (frozenset(chars), ALL) if len(chars) <= 16 else (None, ALL)
    if kind is ops.BRANCH:
        parts = [_sequence(p) for p in value[1]]
        if all(s is not None for s, _ in parts) and sum(len(s) for s, _ in parts) <= STRINGS:
            return frozenset().union(*(s for s, _ in parts)), ALL
        whole = [q if s is None else both(q, of_strings(s)) for s, q in parts]
        return None, simplest(frozenset().union(*whole))
    if kind in (ops.MAX_REPEAT, ops.MIN_REPEAT, ops.POSSESSIVE_REPEAT):
        least, most, what = value
        strings, inner = _sequence(what)
        if strings is not None and (least, most) in ((0, 1), (1, 1)):
            return strings | frozenset([""]) if least == 0 else strings, ALL
        if least == 0:
            return None, ALL
        return None, inner if strings is None else both(inner, of_strings(strings))
    return None, ALL


class Segment:
    """Posting lists of one block of documents, for the trigrams that queries ask for."""

    def __init__(self, texts: list[bytes], slots: np.ndarray, size: int):
        lengths = np.array([len(t) + 1 for t in texts], np.int64)
        ends = np.cumsum(lengths)
        joined = b"\0".join([*texts, b""]).lower()
        found = []
        for at in range(0, len(joined), BLOCK_BYTES):
            window = np.frombuffer(joined[at : at + BLOCK_BYTES + 2], np.uint8).astype(np.uint32)
            codes = (window[:-2] << 16) | (window[1:-1] << 8) | window[2:]
            slot = slots[codes]
            hits = np.flatnonzero(slot)
            found.append((np.searchsorted(ends, hits + at, "right") * size) + slot[hits])
        pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        order = np.argsort(pairs % size, kind="stable")
        marks = np.searchsorted(pairs[order] % size, np.arange(size + 1))
        docs = pairs[order] // size
        self.postings = [docs[marks[i] : marks[i + 1]] for i in range(size)]
        self.count = len(texts)

    def candidates(self, query: list[list[int]]) -> np.ndarray:
        out = np.zeros(self.count, bool)
        for conjunction in query:
            lists = sorted((self.postings[s] for s in conjunction), key=len)
            hit = lists[0] if lists else np.arange(self.count)
            for other in lists[1:]:
                hit = np.intersect1d(hit, other, assume_unique=True)
            out[hit] = True
        return np.flatnonzero(out)


def _scanner(rules: tuple[Rule, ...]) -> Callable[[list[str]], list[list[dict]]]:
    queries = [mandatory(r.pattern, r.flags) for r in rules]
    trigrams = sorted({t.encode() for q in queries for part in q for t in part})
    trigrams = [t for t in trigrams if len(t) == 3]  # in bytes; others would only narrow further
    numbers = {t: n for n, t in enumerate(trigrams, 1)}
    slots = np.zeros(1 << 24, np.uint16)
    for t, n in numbers.items():
        slots[int.from_bytes(t, "big")] = n
    asked = [[[numbers[t.encode()] for t in part if t.encode() in numbers] for part in q] for q in queries]
    compiled = [re.compile(r.linear or r.pattern, r.flags) for r in rules]

    def scan(texts: list[str]) -> list[list[dict]]:
        segment = Segment([t.encode() for t in texts], slots, len(trigrams) + 1)
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for n, (rule, query, pattern) in enumerate(zip(rules, asked, compiled, strict=True)):
            for doc in segment.candidates(query):
                found[doc] += [(start, n, end) for start, end in rule.spans(pattern, texts[doc])]
        return [[{"kind": rules[n].name, "start": s, "end": e} for s, n, e in sorted(f)] for f in found]

    return scan


def blocks(texts: list[str], limit: int = BLOCK_BYTES) -> Iterator[list[str]]:
    """Consecutive texts of about ``limit`` characters together, at least one."""
    block: list[str] = []
    size = 0
    for text in texts:
        if block and size + len(text) > limit:
            yield block
            block, size = [], 0
        block.append(text)
        size += len(text)
    if block:
        yield block


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and ``spans``: array of (kind, start, end) in code points, by start and then rule."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = _scanner(rules)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            spans = [s for block in blocks(texts) for s in run(block)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        scan, "doc_id long, spans array<struct<kind:string,start:int,end:int>>"
    )
