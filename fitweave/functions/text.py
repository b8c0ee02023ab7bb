"""String expressions shared by every operator.

Java regular expressions are ASCII-only by default, so the word helpers spell out
letter classes and always switch on Unicode case folding.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
LINE_BREAKS = r"\r\n|[\r\x0B\f\x1C\x1D\x1E\u0085\u2028\u2029]"
SPACES = r"[\s\x1C-\x1F\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+"
BEFORE_WORD = r"(?<![\p{L}\p{N}_])"
AFTER_WORD = r"(?![\p{L}\p{N}_])"


def phrases(options: Iterable[str], *, start: bool = True, end: bool = True) -> str:
    """Case-insensitive pattern for any of the phrases at word boundaries."""
    body = "|".join(options)
    return f"(?iu){BEFORE_WORD if start else ''}(?:{body}){AFTER_WORD if end else ''}"


def sql_text(word: str) -> str:
    """SQL literal of a text."""
    return "'" + word.replace("\\", "\\\\").replace("'", "\\'") + "'"


def word_list(words: Iterable[str]) -> Column:
    """Constant array; one parsed expression instead of one call per word."""
    return F.expr(f"array({', '.join(sql_text(w) for w in words)})")


def number_map(values: dict[str, int]) -> Column:
    return F.expr(f"map({', '.join(f'{sql_text(k)}, {v}' for k, v in values.items())})")


def empty_words() -> Column:
    return F.array().cast("array<string>")


def strip(value: Column, chars: str = WHITESPACE) -> Column:
    return F.btrim(value, F.lit(chars))


def blank_to_null(value: Column) -> Column:
    return F.when(value != "", value)


def capture(value: Column, pattern: str, group: int = 1) -> Column:
    """First match of a group that is never empty, NULL when there is none."""
    return F.nullif(F.regexp_extract(value, pattern, group), F.lit(""))


def squeeze(value: Column) -> Column:
    """All whitespace runs to one space, ends trimmed."""
    return strip(F.regexp_replace(value, SPACES, " "))


def casefold(value: Column) -> Column:
    return F.replace(F.lower(value), F.lit("ß"), F.lit("ss"))


def unify_lines(value: Column) -> Column:
    """Every kind of line break to a line feed."""
    return F.regexp_replace(value, LINE_BREAKS, "\n")


def lines_of(value: Column) -> Column:
    return F.split(unify_lines(value), "\n")


def contains_any(value: Column, markers: Iterable[str]) -> Column:
    markers = list(markers)
    if len(markers) == 1:
        return value.contains(markers[0])
    return value.rlike("|".join(re.escape(m) for m in markers))


def marker_label(value: Column, table, default: Column | None = None) -> Column:
    """Label of the first table row with a marker inside the value."""
    rule = None
    for label, markers in table:
        hit = contains_any(value, markers)
        rule = F.when(hit, label) if rule is None else rule.when(hit, label)
    return rule.otherwise(F.lit(None) if default is None else default)


def first_of(values: Column) -> Column:
    """First element of an array, NULL when it is empty."""
    return F.get(values, F.lit(0))


def let(value: Column, use) -> Column:
    """Bind an expression to a name, so that lambdas below do not evaluate it per element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def distinct_by(values: Column, key) -> Column:
    """Keep the first element per key, in order; elements without a key go.

    Two sorts of the row's own array, so the cost does not grow with the square of its length.
    """
    entries = F.transform(values, lambda v, i: F.struct(key(v).alias("key"), i.alias("at"), v.alias("value")))
    by_key = F.sort_array(F.filter(entries, lambda e: e["key"].isNotNull()))
    firsts = let(
        by_key,
        lambda s: F.filter(s, lambda e, i: (i == 0) | (F.get(s, i - 1)["key"] != e["key"])),
    )
    in_order = F.sort_array(F.transform(firsts, lambda e: F.struct(e["at"], e["value"])))
    return F.transform(in_order, lambda e: e["value"])


@functools.cache
def _accent_table() -> tuple[str, str]:
    source, target = [], []
    for code in range(0xC0, 0x2000):
        parts = unicodedata.normalize("NFKD", chr(code))
        base = [c for c in parts if not unicodedata.combining(c)]
        if len(base) == 1 and base[0] != chr(code) and not unicodedata.combining(chr(code)):
            source.append(chr(code))
            target.append(base[0])
    return "".join(source), "".join(target)


def without_accents(value: Column) -> Column:
    """Base letters of precomposed characters; loose combining marks are dropped."""
    source, target = _accent_table()
    return F.regexp_replace(F.translate(value, source, target), r"\p{M}+", "")


def comparable_text(value: Column) -> Column:
    """Case-, accent- and punctuation-insensitive form used for identity and diffs."""
    folded = without_accents(casefold(F.coalesce(value, F.lit(""))))
    return F.trim(F.regexp_replace(folded, r"[^\p{L}\p{N}]+", " "))


def target_text(value: Column) -> Column:
    """Normalized form for preference comparison."""
    folded = F.lower(F.coalesce(value, F.lit("")))
    for letter, spelled in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        folded = F.replace(folded, F.lit(letter), F.lit(spelled))
    return F.trim(F.regexp_replace(folded, "[^a-z0-9+#]+", " "))


def content_hash(value: Column) -> Column:
    return F.sha2(value, 256)


def stable_id(*parts: Column) -> Column:
    """Deterministic key from natural-key columns."""
    return F.sha2(F.concat_ws("\x00", *[p.cast("string") for p in parts]), 256)
