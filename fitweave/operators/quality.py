"""Gates and cleanup for page and document text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fitweave import vocab
from fitweave.functions import text as T


def quality_columns(text: Column, title: Column, minimum_length: int = vocab.MINIMUM_TEXT_LENGTH) -> dict:
    """``sufficient``, ``text_length`` and ``warnings`` of a page text (P5)."""
    flat = T.squeeze(F.coalesce(text, F.lit("")))
    lowered = F.lower(flat)
    short = F.length(flat) < minimum_length
    untitled = F.coalesce(title, F.lit("")) == ""
    blocked = T.contains_any(lowered, vocab.BLOCK_PAGE_MARKERS)
    markers = sum((lowered.contains(m).cast("int") for m in vocab.JOB_MARKERS), F.lit(0))
    plain_title = T.squeeze(F.lower(F.coalesce(title, F.lit(""))))
    block_page = blocked & (plain_title.isin(*vocab.BLOCK_PAGE_TITLES) | (markers < 2))
    return {
        "sufficient": ~(short | untitled | block_page),
        "text_length": F.length(flat),
        "warnings": F.array_compact(
            F.array(
                F.when(short, "content_below_minimum_length"),
                F.when(untitled, "title_not_detected"),
                F.when(blocked, "possible_login_or_bot_protection"),
            )
        ),
    }


def with_missing_description(warnings: Column, related_removed: Column, sufficient: Column) -> Column:
    """Adds the warning for a page whose only content was a related-jobs block."""
    extra = F.when(related_removed & ~sufficient, F.array(F.lit("job_description_not_found")))
    return F.array_union(warnings, F.coalesce(extra, T.empty_words()))


def merged_warnings(old: Column, new: Column, *, reimport: bool = False) -> Column:
    """Ordered union without repeats; a reimport first drops earlier fallback warnings (P25)."""
    kept = F.filter(old, lambda w: ~w.startswith("semantic_metadata_")) if reimport else old
    return F.array_union(kept, new)


def has_broken_glyphs(text: Column) -> Column:
    """Doubled letters from a broken font mapping: five linked token pairs in a row.

    Links of a line are written as a string of 0 and 1, so a run is a substring test.
    """

    def linked(tokens: Column) -> Column:
        def link(token: Column, i: Column) -> Column:
            before = F.get(tokens, i - 1)
            hit = (
                (i > 0) & (F.length(before) <= 2) & (F.length(token) == 2)
                & (F.lower(F.right(before, F.lit(1))) == F.lower(F.left(token, F.lit(1))))
            )
            return F.when(hit, "1").otherwise("0")

        return F.array_join(F.transform(tokens, link), "").contains("11111")

    return F.exists(
        T.lines_of(text),
        lambda line: T.let(F.regexp_extract_all(line, F.lit(r"\p{L}+"), F.lit(0)), linked),
    )


def text_is_sufficient(text: Column, minimum_length: int = vocab.MINIMUM_TEXT_LENGTH) -> Column:
    """Whether extracted text is usable without OCR."""
    flat = T.squeeze(text)
    size = F.length(flat)
    broken = size - F.length(F.replace(flat, F.lit("\ufffd"), F.lit("")))
    visible = F.length(F.replace(flat, F.lit(" "), F.lit("")))
    meaningful = F.length(F.regexp_replace(flat, r"[^\p{L}\p{N}]+", ""))

    def fragmented(lengths: Column) -> Column:
        n = F.size(lengths)
        short = F.size(F.filter(lengths, lambda x: x <= 45))
        total = F.aggregate(lengths, F.lit(0), lambda a, x: a + x)
        return F.coalesce((n >= 20) & (short / n >= 0.65) & (total / n < 55), F.lit(False))

    lengths = F.filter(
        F.transform(T.lines_of(text), lambda line: F.length(T.strip(line))), lambda n: n > 0
    )
    return F.coalesce(
        (size >= minimum_length)
        & ~((broken >= 3) & (broken / size >= 0.001))
        & (visible > 0)
        & (meaningful / visible >= 0.5)
        & ~has_broken_glyphs(text)
        & ~T.let(lengths, fragmented),
        F.lit(False),
    )


def normalized_extracted_text(text: Column) -> Column:
    """Layout artifacts removed, lines and headings kept."""
    value = F.regexp_replace(text, r"\r\n?", "\n")
    value = F.regexp_replace(value, r"-[ \t]*\n[ \t]*(?=\p{L})", "-")
    value = F.regexp_replace(value, r"(?m)^[ \t]*(?:&nbsp;|\u00A0)[ \t]*$", "")
    value = F.regexp_replace(value, r"(?m)^[ \t]*[•●▪][ \t]+", "- ")
    value = F.regexp_replace(value, r"\n{3,}", "\n\n")
    return T.strip(value)


def needs_fallback(title: Column, company: Column, location: Column, language: Column) -> Column:
    """Metadata that rules could not fill well enough (P10)."""
    missing = [F.coalesce(c, F.lit("")) == "" for c in (title, company, location, language)]
    words = F.size(F.split(T.squeeze(location), " "))
    long = F.coalesce((F.length(location) > 120) | (words > 12), F.lit(False))
    return missing[0] | missing[1] | missing[2] | missing[3] | long


def is_matchable(content: Column) -> Column:
    """Enough text for matching."""
    return F.length(T.strip(content)) >= 80
