"""Requirements, activities and benefits from ad text (X16-X21), without a shuffle.

A job's text stays one row.  The text is split at heading lines, so a list item belongs to
the heading that starts its segment and no fill-forward window is needed.  Results are
arrays that are exploded only when child tables are written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitweave import vocab
from fitweave.functions import text as T

ITEM_MARK = r"(?:[-*+]|\d+[.)])"
HEADING = r"^[ \t]{0,3}#{1,6}[ \t]+(\S.*?)[ \t]*$"
BOLD = r"^[ \t]*\*\*([^*\n]{2,60})\*\*[ \t]*[^\n]{0,80}$"
SEGMENT_START = r"(?m)^(?=[ \t]{0,3}#{1,6}[ \t]+\S|[ \t]*\*\*[^*\n]{2,60}\*\*[ \t]*[^\n]{0,80}$)"
ITEM = rf"(?m)^[ \t]*{ITEM_MARK}[ \t]+(\S.*?)[ \t]*$"
# a list item line, or the rest of one just joined, followed by a line indented by 1-3 blanks
CONTINUATION = (
    rf"(?m)(^[ \t]*{ITEM_MARK}[ \t]+\S[^\n]*?|\G(?!\A)[^\n]*?)[ \t]*\n {{1,3}}(?=\S)"
    rf"(?!{ITEM_MARK}[ \t]+\S)"
)
BENEFIT = T.phrases(vocab.BENEFIT_HEADINGS)
ACTIVITY = T.phrases(vocab.ACTIVITY_HEADINGS)
ACTIVITY_OPENER = T.phrases(vocab.ACTIVITY_OPENERS)
REQUIREMENT = T.phrases(vocab.REQUIREMENT_HEADINGS)
OPTIONAL = T.phrases(vocab.OPTIONAL_WORDS)
MUST = T.phrases(vocab.MUST_WORDS)
YEARS = vocab.REQUIRED_YEARS_PATTERN.replace("NUMBER", vocab.NUMBER_PATTERN).replace(
    "WORDS", "|".join(vocab.NUMBER_WORDS)
)
YEARS_ANYWHERE = f"(?iu){YEARS}"
YEARS_FIRST = f"(?ius)^(.*?){YEARS}"
KEYWORD = "[A-Za-zÄÖÜäöüß0-9+#.-]{3,}"


def clean_item(value: Column) -> Column:
    return T.strip(F.regexp_replace(value, T.SPACES, " "), " \t:;,.")


def join_continuations(content: Column) -> Column:
    """Indented follow-up lines become part of their list item."""
    return F.regexp_replace(T.unify_lines(content), CONTINUATION, "$1 ")


def keywords(value: Column) -> Column:
    """Distinct words in order of appearance, stop words removed."""
    words = F.regexp_extract_all(value, F.lit(KEYWORD), F.lit(0))
    kept = F.filter(words, lambda w: ~T.casefold(w).isin(*vocab.KEYWORD_STOPWORDS))
    return T.distinct_by(kept, T.casefold)


def priority(value: Column, heading: Column) -> Column:
    combined = F.concat_ws(" ", heading, value)
    return (
        F.when(combined.rlike(OPTIONAL), "nice_to_have").when(combined.rlike(MUST), "must")
        .otherwise("should")
    )


def general_number(value: Column) -> Column:
    """Shortest text of a number: 3 instead of 3.0."""
    whole = value == F.floor(value)
    return F.when(whole, value.cast("long").cast("string")).otherwise(value.cast("string"))


def required_years(value: Column) -> Column:
    """Years named in a requirement: a number, the lower end of a range, or a number word."""

    def number(named: Column) -> Column:
        digits = F.replace(T.capture(named, f"^({vocab.NUMBER_PATTERN})"), F.lit(","), F.lit("."))
        words = F.try_element_at(T.number_map(vocab.NUMBER_WORDS), named).cast("double")
        return F.coalesce(digits.try_cast("double"), words)

    return T.let(F.lower(T.capture(value, YEARS_ANYWHERE)), number)


def section_kind(heading: Column) -> Column:
    """Benefits win over activities, activities over requirements."""
    return (
        F.when(heading.rlike(BENEFIT), "benefit")
        .when(heading.rlike(ACTIVITY) | heading.rlike(ACTIVITY_OPENER), "activity")
        .when(heading.rlike(REQUIREMENT), "requirement")
    )


def segments(content: Column) -> Column:
    """Array of (heading, kind, items) in text order."""

    def segment(part: Column) -> Column:
        first = F.substring_index(part, "\n", 1)
        heading = clean_item(F.coalesce(T.capture(first, HEADING), T.capture(first, BOLD)))
        return T.let(
            F.struct(heading.alias("heading"), part.alias("part")),
            lambda s: F.struct(
                s["heading"].alias("heading"),
                section_kind(s["heading"]).alias("kind"),
                F.regexp_extract_all(s["part"], F.lit(ITEM), F.lit(1)).alias("items"),
            ),
        )

    return F.transform(F.split(join_continuations(content), SEGMENT_START), segment)


def section_items(parts: Column, kind: str) -> Column:
    """(text, heading) of the items of one section kind, first spelling wins."""
    rows = F.flatten(
        F.transform(
            F.filter(parts, lambda s: s["kind"] == kind),
            lambda s: F.transform(
                s["items"],
                lambda i: F.struct(clean_item(i).alias("text"), s["heading"].alias("heading")),
            ),
        )
    )
    long_enough = F.filter(rows, lambda r: F.length(r["text"]) >= 8)
    return T.distinct_by(long_enough, lambda r: T.casefold(r["text"]))


def _requirement(text, category, rank, words, tag, confidence, evidence) -> Column:
    return F.struct(
        text.alias("requirement"), F.lit(category).alias("category"), rank.alias("priority"),
        words.alias("keywords"), tag.alias("normalized_value"),
        F.lit(confidence).alias("confidence"), evidence.alias("evidence"),
    )


def _expand(item: Column) -> Column:
    """One or two requirements of a list item: years of experience and the rest."""
    text = item["text"]
    none = F.lit(None).cast("string")

    def build(known: Column) -> Column:
        years, rank, rest = known["years"], known["rank"], known["rest"]
        whole = _requirement(text, "other", rank, keywords(text), none, 0.8, text)
        timed = _requirement(
            F.concat(F.lit("Mindestens "), years, F.lit(" Jahre Berufserfahrung")), "experience", rank,
            T.word_list(["Berufserfahrung", "years_experience"]),
            F.concat(F.lit("min_years:"), years), 0.95, text,
        )
        left = _requirement(rest, "other", rank, keywords(rest), none, 0.8, text)
        return (
            F.when(years.isNull(), F.array(whole))
            .when(F.length(rest) >= 3, F.array(timed, left))
            .otherwise(F.array(timed))
        )

    def split(years: Column) -> Column:
        rest = clean_item(
            F.regexp_replace(F.regexp_replace(text, YEARS_FIRST, "$1"), vocab.YEARS_CONNECTOR_PATTERN, "")
        )
        return F.struct(
            general_number(years).alias("years"), priority(text, item["heading"]).alias("rank"),
            F.when(years.isNotNull(), rest).alias("rest"),
        )

    return T.let(T.let(required_years(text), split), build)


def structure_columns(parts: Column) -> dict[str, Column]:
    """``requirements``, ``activities`` and ``benefits`` arrays from segments."""
    activities = F.transform(
        section_items(parts, "activity"),
        lambda r: F.struct(
            r["text"].alias("activity"), F.lit("responsibility").alias("category"),
            keywords(r["text"]).alias("keywords"), F.lit(0.85).alias("confidence"),
            r["text"].alias("evidence"),
        ),
    )
    requirements = F.flatten(F.transform(section_items(parts, "requirement"), _expand))
    benefits = F.transform(
        section_items(parts, "benefit"),
        lambda r: F.struct(
            r["text"].alias("benefit"), r["text"].alias("evidence"), F.lit(0.85).alias("confidence")
        ),
    )
    return {"requirements": requirements, "activities": activities, "benefits": benefits}


def with_structure(jobs: DataFrame, content: str = "content") -> DataFrame:
    parts = jobs.withColumn("_segments", segments(F.col(content)))
    return parts.withColumns(structure_columns(F.col("_segments"))).drop("_segments")


def _rows(jobs: DataFrame, column: str) -> DataFrame:
    """One row per element of an array that was just extracted.

    The outer form, without its rows for empty arrays: for the plain one Spark infers a filter on the array's size, puts
    it before any exchange, and so extracts every array a second time, there in as many tasks as the table has splits.
    """
    rows = jobs.select("job_id", F.posexplode_outer(column).alias("position", "r"))
    return rows.where(F.col("position").isNotNull()).select("job_id", "position", "r.*")


def requirement_rows(jobs: DataFrame) -> DataFrame:
    return _rows(jobs, "requirements")


def activity_rows(jobs: DataFrame) -> DataFrame:
    return _rows(jobs, "activities")


def benefit_rows(jobs: DataFrame) -> DataFrame:
    return _rows(jobs, "benefits")


def item_rows(jobs: DataFrame, kind: str, content: str = "content") -> DataFrame:
    """Distinct items of one section kind with their heading, one row each."""
    parts = jobs.withColumn("_segments", segments(F.col(content)))
    return _rows(parts.select("job_id", section_items(F.col("_segments"), kind).alias("items")), "items")
