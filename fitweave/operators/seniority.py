"""Seniority signals and job role from ad text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fitweave import vocab
from fitweave.functions import text as T
from fitweave.operators import structure

YEARS = vocab.SENIORITY_YEARS_PATTERN
RULES = [(level, T.phrases(options)) for level, options in vocab.SENIORITY_RULES]
OWNERSHIP = T.phrases(vocab.OWNERSHIP_WORDS)
LEVEL_WORD = T.phrases(vocab.ROLE_LEVELS)
ROLE_NOUN = T.phrases(vocab.ROLE_NOUNS)
ROLE_CONTEXT = T.phrases(vocab.ROLE_CONTEXTS)
# longer lines are prose, not the name of a role; so are lines further down
ROLE_LENGTH = 140
ROLE_LINES = 80


def filled_lines(content: Column) -> Column:
    return F.filter(F.transform(T.lines_of(content), lambda line: T.strip(line)), lambda line: line != "")


def seniority(content: Column) -> Column:
    """(level, confidence, years_required, signals) or NULL."""
    years = F.array_max(
        F.transform(
            F.regexp_extract_all(content, F.lit(YEARS), F.lit(1)),
            lambda y: F.replace(y, F.lit(","), F.lit(".")).try_cast("double"),
        )
    )

    def decide(known: Column) -> Column:
        lines, top = known["lines"], known["years"]

        def entry(level, confidence, signals) -> Column:
            return F.struct(
                F.lit(level).alias("level"), confidence.cast("double").alias("confidence"),
                top.alias("years_required"), signals.alias("signals"),
            )

        def lines_with(pattern: str) -> Column:
            return F.filter(lines, lambda line: line.rlike(pattern))

        def any_line(pattern: str) -> Column:
            return F.exists(lines, lambda line: line.rlike(pattern))

        signals = F.when(any_line(OWNERSHIP), lines_with(OWNERSHIP)).otherwise(lines_with(YEARS))
        result = F.when(
            top.isNotNull() | any_line(OWNERSHIP),
            entry("professional", F.when(top.isNotNull(), 0.92).otherwise(0.7), signals),
        )
        for level, pattern in reversed(RULES):
            result = F.when(
                any_line(pattern), entry(level, F.lit(0.95), lines_with(pattern))
            ).otherwise(result)
        return result

    return T.let(
        F.struct(filled_lines(content).alias("lines"), years.alias("years")), decide
    )


def ensure_seniority_requirement(requirements: Column, level: Column) -> Column:
    """Adds the years requirement when no experience requirement exists."""
    years = structure.general_number(level["years_required"])
    generated = F.struct(
        F.concat(F.lit("Mindestens "), years, F.lit(" Jahre Berufserfahrung")).alias("requirement"),
        F.lit("experience").alias("category"), F.lit("must").alias("priority"),
        T.word_list(["Berufserfahrung", "years_experience"]).alias("keywords"),
        F.concat(F.lit("min_years:"), years).alias("normalized_value"),
        level["confidence"].alias("confidence"),
        F.array_join(level["signals"], "; ").alias("evidence"),
    )
    missing = years.isNotNull() & ~F.exists(requirements, lambda r: r["category"] == "experience")
    return F.when(missing, F.concat(requirements, F.array(generated))).otherwise(requirements)


def job_role(title: Column, content: Column) -> Column:
    """Role without its level words.

    A line that names the role in context wins over the title, if it is among the first ``ROLE_LINES``.
    """
    name = T.strip(F.coalesce(title, F.lit("")))
    lines = F.slice(F.filter(T.lines_of(content), lambda line: T.strip(line) != ""), 1, ROLE_LINES)
    candidates = F.concat(
        F.array(name),
        F.transform(lines, lambda line: T.strip(line, " #-*\t")),
    )
    roles = F.filter(candidates, lambda c: c.rlike(ROLE_NOUN) & (F.length(c) <= ROLE_LENGTH))

    def pick(found: Column) -> Column:
        contextual = T.first_of(F.filter(found, lambda c: c.rlike(ROLE_CONTEXT)))
        in_context = T.strip(
            F.regexp_replace(F.regexp_replace(T.strip(contextual), vocab.ROLE_PREFIX_PATTERN, ""), r"(?s)[.!?].*$", "")
        )
        value = F.coalesce(in_context, T.strip(T.first_of(found)), name)
        bare = F.regexp_replace(F.regexp_replace(value, T.SPACES, " "), LEVEL_WORD, "")
        return T.blank_to_null(T.strip(F.regexp_replace(bare, r"\s{2,}", " "), " -,:;"))

    return T.let(roles, pick)
