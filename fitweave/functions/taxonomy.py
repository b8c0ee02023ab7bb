"""Marker tables turned into expressions (F7-F10, F15, F19) and preference overlap."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fitweave import vocab
from fitweave.functions import text as T


def canonical_work_model(value: Column) -> Column:
    folded = T.target_text(value)
    return T.marker_label(folded, vocab.WORK_MODEL_MARKERS, T.blank_to_null(folded))


def canonical_employment_type(value: Column) -> Column:
    folded = T.target_text(value)
    known = T.marker_label(folded, vocab.EMPLOYMENT_MARKERS)
    free = F.when(~folded.isin(*vocab.EMPLOYMENT_UNKNOWN), T.blank_to_null(folded))
    return F.coalesce(known, free)


def skill_category(value: Column) -> Column:
    folded = T.casefold(F.coalesce(value, F.lit("")))
    return T.marker_label(folded, vocab.SKILL_CATEGORY_MARKERS, F.lit("other"))


def skill_level(value: Column) -> Column:
    folded = T.casefold(F.coalesce(value, F.lit("")))
    return F.when(
        folded != "", T.marker_label(folded, vocab.SKILL_LEVEL_MARKERS, F.lit("basic"))
    )


def role_level(role: Column) -> Column:
    return T.marker_label(T.casefold(role), vocab.ROLE_LEVEL_MARKERS)


def role_preferences(roles: Column) -> Column:
    """Role names to (role, level, priority) in list order."""
    return F.transform(
        roles,
        lambda r, i: F.struct(
            r.alias("role"), role_level(r).alias("level"), (i + 1).cast("int").alias("priority")
        ),
    )


def label(value: Column, labels: dict[str, str]) -> Column:
    result = value
    for key, shown in labels.items():
        result = F.when(value == key, F.lit(shown)).otherwise(result)
    return result


def concept_names(folded: Column) -> Column:
    """Concept groups whose markers occur inside an already folded text.

    Markers are substrings, so short ones also hit inside longer words.
    """
    return F.array_compact(
        F.array(
            *[
                F.when(T.contains_any(folded, markers), F.lit(name))
                for name, markers in vocab.TARGET_CONCEPTS.items()
            ]
        )
    )


def folded_overlap(desired: Column, actual: Column) -> Column:
    """Share of desired terms or concepts found in the actual text, both already folded."""
    want = F.array_distinct(F.split(desired, " "))
    have = F.array_distinct(F.split(actual, " "))
    lexical = F.size(F.array_intersect(want, have)) / F.size(want)
    want_concepts = concept_names(desired)
    shared = F.size(F.array_intersect(want_concepts, concept_names(actual)))
    by_concept = F.when(F.size(want_concepts) > 0, shared / F.size(want_concepts))
    empty = (F.coalesce(desired, F.lit("")) == "") | (F.coalesce(actual, F.lit("")) == "")
    return F.when(empty, F.lit(0.0)).otherwise(
        F.greatest(lexical, F.coalesce(by_concept, F.lit(0.0)))
    )


def target_overlap(desired: Column, actual: Column) -> Column:
    return folded_overlap(T.target_text(desired), T.target_text(actual))
