"""Term sets for matching."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fitweave import vocab
from fitweave.functions import text as T

# A-Z a-z À-Ö Ø-ö ø-ÿ 0-9 + # . one by one: Java tests such a class by one lookup, and a class of ranges range by range
_RANGES = ["AZ", "az", "ÀÖ", "Øö", "øÿ", "09", "++", "##", ".."]
TOKEN = f"[{''.join(chr(c) for first, last in _RANGES for c in range(ord(first), ord(last) + 1))}]{{2,}}"
YEARS = vocab.MATCH_YEARS_PATTERN
SOFT_SKILL = T.phrases(vocab.SOFT_SKILL_STEMS, end=False)
ELIGIBILITY = T.phrases(vocab.ELIGIBILITY_STEMS, end=False)
WORK_CONTEXT = T.phrases(["production", "professional"])
ALTERNATIVE = T.phrases(["or", "oder"])
SKILL_SCOPE = T.phrases(["mit", "in", "with", "for"])


def tokens(value: Column) -> Column:
    return F.regexp_extract_all(F.lower(value), F.lit(TOKEN), F.lit(0))


def term_set(value: Column, keywords: Column | None = None) -> Column:
    """Distinct terms of a text and its keywords plus concept tags."""
    words = tokens(F.coalesce(value, F.lit("")))
    if keywords is not None:
        joined = F.replace(F.array_join(keywords, " "), F.lit("_"), F.lit(" "))
        words = F.when(F.size(F.coalesce(keywords, T.empty_words())) > 0, F.concat(words, tokens(joined))).otherwise(words)
    terms = F.array_except(words, T.word_list(vocab.MATCH_STOPWORDS))
    tags = [
        F.when(
            F.arrays_overlap(terms, T.word_list(aliases)), F.array(F.lit(f"concept:{name}"))
        ).otherwise(T.empty_words())
        for name, aliases in vocab.TERM_CONCEPTS.items()
    ]
    # few texts name any concept, so one search rules out all of them
    aliases = [alias for names in vocab.TERM_CONCEPTS.values() for alias in names]
    return F.when(F.arrays_overlap(terms, T.word_list(aliases)), F.concat(terms, *tags)).otherwise(terms)


def alternative_anchors(value: Column) -> Column:
    """Terms next to "or" / "oder"."""

    def is_pivot(word: Column) -> Column:
        return F.coalesce(word.isin("or", "oder"), F.lit(False))

    beside = T.let(
        tokens(value),
        lambda words: F.filter(
            words,
            lambda _, i: is_pivot(F.get(words, i + 1)) | is_pivot(F.get(words, i - 1)),
        ),
    )
    return F.array_except(beside, T.word_list(vocab.MATCH_STOPWORDS))


def _decimal(value: Column) -> Column:
    return F.replace(value, F.lit(","), F.lit(".")).try_cast("double")


def minimum_years(
    requirement: Column, normalized_value: Column | None = None, *, read_tag: bool = False
) -> Column:
    """Required years of experience named in the text.

    A bare ``min_years:N`` tag carries no "years of experience" wording and is
    ignored unless ``read_tag`` is set.
    """
    from_text = _decimal(T.capture(requirement, YEARS))
    if normalized_value is None:
        return from_text
    tagged = _decimal(T.capture(normalized_value, YEARS))
    if read_tag:
        tagged = F.coalesce(
            tagged, _decimal(T.capture(normalized_value, vocab.YEARS_TAG_PATTERN))
        )
    return F.coalesce(tagged, from_text)


def skill_years(source_content: Column, evidence_text: Column) -> Column:
    """Documented years of one evidence row: JSON field first, then ``Jahre: N``."""
    documented = F.get_json_object(source_content, "$.years_experience")
    written = T.capture(evidence_text, vocab.WRITTEN_YEARS_PATTERN)
    return F.when(documented.isNotNull(), documented.try_cast("double")).otherwise(
        _decimal(written)
    )


def evidence_weight(source_content: Column, context: Column) -> Column:
    """How much one evidence row counts when citations are chosen."""
    by_context = F.lit(vocab.OTHER_CONTEXT_WEIGHT)
    for name, weight in vocab.CONTEXT_WEIGHT.items():
        by_context = F.when(context == name, F.lit(weight)).otherwise(by_context)
    manual = F.get_json_object(source_content, "$.source_type") == "manual_training"
    return F.when(manual, F.lit(0.5)).otherwise(by_context)


def is_soft_skill(category: Column, requirement: Column) -> Column:
    named = F.lower(T.strip(category)) == "soft_skill"
    return named | F.concat_ws(" ", category, requirement).rlike(SOFT_SKILL)


def needs_work_context(requirement: Column) -> Column:
    return requirement.rlike(WORK_CONTEXT)


def is_eligibility(requirement: Column) -> Column:
    return requirement.rlike(ELIGIBILITY)
