"""Title, company, location, work model and terms of an ad.

Every rule is a column over the job's own row: whole-text patterns, or look-ahead and
look-behind inside arrays of its cleaned lines.  The cascades are ``coalesce``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitweave import vocab
from fitweave.functions import text as T

LEGAL = "|".join(vocab.LEGAL_FORMS)
LEGAL_LONG = "|".join(vocab.LEGAL_FORMS_LONG)
LEGAL_WORD = rf"(?iu)\b(?:{LEGAL})\b"
PLACE_MODE = r"(?iu)\((hybrid|remote|on-?site)\)"
FIELDS = ["title", "company", "published_text", "location", "employment_type", "contract_term",
          "work_model", "source_portal", "language"]
# where an ad names title, company and place: its first filled lines; what follows is body text
HEADER_LINES = 15
# a line that is nothing but an employment type says so near the top
EMPLOYMENT_LINES = 40


def detect_language(content: Column) -> Column:
    """de or en from marker words; NULL when unclear."""
    folded = T.casefold(content)
    umlaut = F.lower(content).rlike("[äöüß]")

    def decide(words: Column) -> Column:
        def count(language: str) -> Column:
            return F.size(F.filter(words, lambda w: w.isin(*vocab.LANGUAGE_WORDS[language])))

        return T.let(
            F.struct(
                (count("de") + F.when(umlaut, 2).otherwise(0)).alias("de"), count("en").alias("en")
            ),
            lambda s: F.when((s["de"] >= s["en"]) & (s["de"] >= 3) & (s["de"] >= s["en"] * 1.5), "de")
            .when((s["en"] > s["de"]) & (s["en"] >= 3) & (s["en"] >= s["de"] * 1.5), "en"),
        )

    return T.let(F.regexp_extract_all(folded, F.lit(r"\p{L}+"), F.lit(0)), decide)


def clean_line(line: Column) -> Column:
    """Line without quote mark, bullet, leading colon, leading images and link syntax."""
    value = T.strip(F.regexp_replace(line, r"^\s*>\s?", ""))
    value = F.regexp_replace(value, r"^\s*[-*]\s+", "")
    value = F.regexp_replace(value, r"^:\s*", "")
    value = T.strip(F.regexp_replace(value, r"^(?:!\[[^\]]*\]\([^)]+\)\s*)+", ""))
    return T.strip(F.regexp_replace(value, r"^\[([^\]]+)\]\([^)]+\)$", "$1"))


def normalized_heading(cleaned: Column) -> Column:
    """Comparable form of an already cleaned line."""
    value = T.strip(F.regexp_replace(cleaned, "^#+", ""))
    value = T.strip(T.strip(value, "*_"))
    return T.casefold(F.regexp_replace(value, r"^[^\p{L}\p{N}_]+", ""))


def clean_title(title: Column) -> Column:
    """Title without markup, OCR slip and portal badge."""
    value = T.strip(F.regexp_replace(clean_line(title), "^#+", ""))
    value = F.regexp_replace(
        value, r"(?iu)^Al(?=\s+(?:Engineer|Scientist|Developer|Researcher)\b)", "AI"
    )
    value = F.regexp_replace(
        value, r"(?iu)^(?:\[?NEU\]?\s*[-|·:]?\s+)|(?:\s*[-|·:]?\s*\[?NEU\]?)$", ""
    )
    return T.blank_to_null(value)


def main_heading(content: Column) -> Column:
    """First level-one heading."""
    return clean_title(T.capture(content, r"(?m)^\s*#\s+(.+?)\s*$"))


def _usable(value: Column) -> Column:
    return (value != "") & ~value.startswith("#") & (value != "&nbsp;")


def _heading_positions(norm: Column, headings: list[str]) -> Column:
    marked = F.transform(norm, lambda h, i: F.when(h.isin(*headings), i))
    return F.filter(marked, lambda i: i.isNotNull())


def _first_value(values: Column) -> Column:
    return T.first_of(F.filter(values, lambda v: v.isNotNull()))


def section_value(clean: Column, norm: Column, headings: list[str]) -> Column:
    """First usable of the five lines after a heading line."""
    return _first_value(
        F.transform(
            _heading_positions(norm, headings),
            lambda i: T.first_of(F.filter(F.slice(clean, i + 2, F.lit(5)), _usable)),
        )
    )


def value_before_heading(clean: Column, norm: Column, headings: list[str]) -> Column:
    """Nearest usable of the three lines before a heading line."""
    return _first_value(
        F.transform(
            _heading_positions(norm, headings),
            lambda i: T.first_of(
                F.filter(
                    F.reverse(F.slice(clean, F.greatest(i - 3, F.lit(0)) + 1, F.least(i, F.lit(3)))),
                    _usable,
                )
            ),
        )
    )


def inline_value(content: Column, headings: list[str]) -> Column:
    """``heading: value`` on one line, longest heading first."""
    names = "|".join(re.escape(h) for h in sorted(headings, key=len, reverse=True))
    found = T.capture(
        content, vocab.INLINE_VALUE_PATTERN.replace("NAMES", names)
    )
    return clean_line(found)


def map_link_location(content: Column) -> Column:
    """Label of a maps link."""
    return clean_line(
        T.capture(content, vocab.MAP_LINK_PATTERN)
    )


def _header(clean: Column) -> Column:
    """The filled lines of the header; a name in the body is not the ad's own."""
    return F.slice(F.filter(clean, lambda v: (v != "") & (v != "&nbsp;")), 1, HEADER_LINES)


def _first_index(values: Column, test) -> Column:
    marked = F.transform(values, lambda v, i: F.when(test(v), i))
    return T.first_of(F.filter(marked, lambda i: i.isNotNull()))


def plain_header(clean: Column) -> Column:
    """(title, company) of a text header: the first line with a legal form ends the title."""

    def build(h: Column) -> Column:
        parts = F.filter(
            F.slice(h["lines"], F.lit(1), h["at"]),
            lambda p: ~p.startswith("[") & ~normalized_heading(p).isin(*vocab.PORTAL_CHROME)
            & (F.length(p) <= 100),
        )
        title = F.array_join(F.transform(parts, lambda p: T.strip(F.regexp_replace(p, "^#+", ""))), " ")
        return F.when(
            h["at"].isNotNull(),
            F.struct(
                T.blank_to_null(T.strip(title)).alias("title"), F.get(h["lines"], h["at"]).alias("company")
            ),
        )

    return T.let(
        T.let(
            _header(clean),
            lambda lines: F.struct(
                lines.alias("lines"), _first_index(lines, lambda v: v.rlike(LEGAL_WORD)).alias("at")
            ),
        ),
        build,
    )


def compact_header(clean: Column) -> Column:
    """(title, company, location, work_model) of ``company · place (Hybrid)``."""
    separator = vocab.HEADER_SEPARATOR_PATTERN

    def build(h: Column) -> Column:
        line = F.get(h["lines"], h["at"])
        parts = F.transform(F.split(line, separator), lambda p: T.strip(p))
        mode = F.initcap(F.lower(T.capture(line, PLACE_MODE)))
        place = F.regexp_replace(F.get(parts, F.lit(1)), vocab.PLACE_MODE_END_PATTERN, "")
        title = T.strip(F.regexp_replace(F.get(h["lines"], h["at"] - 1), "^#+", ""))
        return F.when(
            h["at"].isNotNull(),
            F.struct(
                F.when(h["at"] > 0, T.blank_to_null(title)).alias("title"),
                T.blank_to_null(F.get(parts, F.lit(0))).alias("company"),
                T.blank_to_null(T.strip(place)).alias("location"),
                F.replace(mode, F.lit("On-site"), F.lit("On-Site")).alias("work_model"),
            ),
        )

    return T.let(
        T.let(
            _header(clean),
            lambda lines: F.struct(
                lines.alias("lines"),
                _first_index(
                    lines, lambda v: v.rlike(PLACE_MODE) & v.rlike(vocab.HEADER_MARK_PATTERN)
                ).alias("at"),
            ),
        ),
        build,
    )


def split_terms(value: Column) -> Column:
    """(employment_type, contract_term) parts of a comma list."""
    contract = T.phrases(["unbefristet", "befristet", "permanent", "fixed[- ]term", "temporary"])
    parts = F.transform(F.split(value, vocab.TERM_SEPARATOR_PATTERN), lambda p: T.strip(p))
    return T.let(
        parts,
        lambda ps: F.struct(
            T.blank_to_null(F.array_join(F.filter(ps, lambda p: (p != "") & ~p.rlike(contract)), ", "))
            .alias("employment_type"),
            T.blank_to_null(F.array_join(F.filter(ps, lambda p: p.rlike(contract)), ", "))
            .alias("contract_term"),
        ),
    )


def instaffo_details(content: Column) -> Column:
    """Portal-specific fields (X11); the caller checks the filename."""
    return F.struct(
        clean_line(T.capture(content, vocab.PORTAL_TITLE_PATTERN)).alias("title"),
        clean_line(
            T.capture(
                content,
                vocab.PORTAL_COMPANY_PATTERN,
            )
        ).alias("company"),
        T.strip(T.capture(content, vocab.PORTAL_LOCATION_PATTERN)).alias("location"),
        T.capture(
            content,
            vocab.PORTAL_EMPLOYMENT_PATTERN,
        ).alias("employment_type"),
    )


def source_portal(filename: Column, url: Column) -> Column:
    """Portal named in the filename or URL."""
    source = F.lower(F.concat_ws(" ", F.coalesce(filename, F.lit("")), F.coalesce(url, F.lit(""))))
    return T.marker_label(source, [(label, [marker]) for marker, label in vocab.PORTALS])


def work_model(content: Column) -> Column:
    """Explicit wording only; the compact header is a separate fallback."""
    lowered = F.lower(content)
    return (
        F.when(
            lowered.rlike(
                T.phrases([r"100\s*%\s*remote", "fully remote", "vollständig remote",
                           "remote in (?:de|germany|deutschland)"])
            ),
            "Remote",
        )
        .when(lowered.rlike(T.phrases(["hybrid", "hybrides arbeiten"])), "Hybrid")
        .when(
            lowered.rlike(T.phrases(["homeoffice", "remote work", "work remotely", "remotely"])),
            "Remote möglich",
        )
    )


def company_below_title(lines: Column, clean: Column) -> Column:
    """First plausible name in the four lines below the first main heading."""
    city = [c.capitalize() for c in vocab.CITY_ONLY if c.isascii()]

    def plausible(v: Column) -> Column:
        only_city = v.rlike(r"^[A-Z][A-Za-z .'-]{2,40}$") & F.lower(v).isin(*[c.lower() for c in city])
        return (
            ~normalized_heading(clean_line(v)).isin(*vocab.CALLS_TO_ACTION) & ~v.contains(",")
            & ~only_city & (F.length(v) <= 200) & ~v.rlike(r"^(https?://|www\.)")
        )

    def build(after: Column) -> Column:
        stop = _first_index(after, lambda v: v.startswith("#") | (v == "&nbsp;"))
        before = F.slice(after, F.lit(1), F.coalesce(stop, F.size(after)))
        return T.first_of(F.filter(before, plausible))

    at = _first_index(lines, lambda line: line.rlike(vocab.BELOW_TITLE_PATTERN))
    following = T.let(at, lambda i: F.filter(F.slice(clean, i + 2, F.lit(4)), lambda v: v != ""))
    return F.when(at.isNotNull(), T.let(following, build))


def company_rules(content: Column, lines: Column, clean: Column, norm: Column, url: Column,
                  compact: Column, plain: Column, instaffo: Column) -> list[Column]:
    """Company rules in order of trust."""
    from_join = F.when(
        url.rlike(vocab.COMPANY_SITE_PATTERN),
        clean_line(
            T.capture(
                content,
                vocab.COMPANY_SITE_LINK_PATTERN,
            )
        ),
    )
    labelled = T.strip(
        T.capture(content, vocab.EMPLOYER_LINE_PATTERN)
    )
    linked = T.strip(
        T.capture(content, vocab.COMPANY_PAGE_PATTERN)
    )
    brand = T.strip(
        F.regexp_replace(
            T.capture(content, vocab.LOGO_LINK_PATTERN),
            vocab.LOGO_END_PATTERN, "",
        )
    )
    prose = clean_line(
        T.capture(content, vocab.PROSE_COMPANY_PATTERN.replace("FORMS", LEGAL_LONG))
    )
    standalone = F.regexp_extract_all(
        content, F.lit(vocab.COMPANY_LINE_PATTERN.replace("FORMS", LEGAL_LONG)), F.lit(1)
    )
    return [
        instaffo["company"], from_join, labelled, linked,
        F.when(F.length(brand) <= 120, brand),
        company_below_title(lines, clean),
        section_value(clean, norm, vocab.INFORMATION_HEADINGS),
        compact["company"], prose, plain["company"],
        clean_line(F.try_element_at(standalone, F.lit(-1))),
    ]


def with_lines(jobs: DataFrame, content: str = "content") -> DataFrame:
    """Adds the line arrays and header structs the rules share."""
    return (
        jobs.withColumn("_content", T.unify_lines(F.coalesce(content, F.lit(""))))
        .withColumn("_lines", F.split("_content", "\n"))
        .withColumn("_clean", F.transform("_lines", clean_line))
        .withColumn("_norm", F.transform("_clean", normalized_heading))
        .withColumn("_compact", compact_header(F.col("_clean")))
        .withColumn("_plain", plain_header(F.col("_clean")))
        .withColumn(
            "_instaffo",
            F.when(F.lower("source_filename").contains("instaffo"), instaffo_details(F.col("_content"))),
        )
    )


def with_metadata(jobs: DataFrame, content: str = "content") -> DataFrame:
    """Adds all metadata fields to jobs with content, source_filename and source_url."""
    text, clean, norm = F.col("_content"), F.col("_clean"), F.col("_norm")
    compact, plain, instaffo = F.col("_compact"), F.col("_plain"), F.col("_instaffo")

    def first_filled(*rules: Column) -> Column:
        return F.coalesce(*[T.blank_to_null(r) for r in rules])

    location = first_filled(
        instaffo["location"], inline_value(text, vocab.LOCATION_HEADINGS),
        section_value(clean, norm, vocab.LOCATION_HEADINGS),
        value_before_heading(clean, norm, vocab.LOCATION_FOOTINGS),
        compact["location"], map_link_location(text),
    )
    address = first_filled(
        inline_value(text, vocab.ADDRESS_HEADINGS), section_value(clean, norm, vocab.ADDRESS_HEADINGS)
    )
    commute = vocab.COMMUTE_PATTERN
    bare = T.strip(
        T.capture(F.substring_index(text, "\n", EMPLOYMENT_LINES), vocab.BARE_EMPLOYMENT_PATTERN)
    )
    employment = first_filled(
        instaffo["employment_type"], inline_value(text, vocab.EMPLOYMENT_HEADINGS),
        section_value(clean, norm, vocab.EMPLOYMENT_HEADINGS), bare,
    )
    contract = first_filled(
        inline_value(text, vocab.CONTRACT_HEADINGS), section_value(clean, norm, vocab.CONTRACT_HEADINGS)
    )
    published = T.strip(
        T.capture(text, vocab.PUBLISHED_PATTERN)
    )
    return (
        with_lines(jobs, content)
        .withColumn("_location", location)
        .withColumn("_terms", split_terms(employment))
        .withColumns(
            {
                "title": clean_title(
                    first_filled(instaffo["title"], compact["title"], plain["title"], main_heading(text))
                ),
                "company": first_filled(
                    *company_rules(text, F.col("_lines"), clean, norm, F.col("source_url"), compact,
                                   plain, instaffo)
                ),
                "published_text": published,
                "location": F.when(F.col("_location").rlike(commute), address)
                .otherwise(F.col("_location")),
                "employment_type": F.col("_terms")["employment_type"],
                "contract_term": F.coalesce(contract, F.col("_terms")["contract_term"]),
                "work_model": F.coalesce(work_model(text), compact["work_model"]),
                "source_portal": source_portal(F.col("source_filename"), F.col("source_url")),
                "language": detect_language(text),
            }
        )
        .drop("_content", "_lines", "_clean", "_norm", "_compact", "_plain", "_instaffo", "_location",
              "_terms")
    )
