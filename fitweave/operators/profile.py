"""Profile resources as matching evidence and their maintenance
(U1, U2, J4, J11, J13, F16, F17, P27, C5, A13, A17)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitweave import vocab
from fitweave.functions import dates
from fitweave.functions import text as T

EVIDENCE_COLUMNS = ["profile_id", "source_name", "source_type", "source_content", "label",
                    "evidence_text", "experience_context", "keywords"]


def clean_preferences(values: Column) -> Column:
    """Trimmed, non-empty, first spelling per case-insensitive value (F16)."""
    trimmed = F.filter(F.transform(values, lambda v: T.strip(v)), lambda v: v != "")
    return T.distinct_by(trimmed, lambda v: T.casefold(v))


def has_unique(values: Column, key) -> Column:
    """Whether a key occurs once per row list."""
    keys = F.transform(values, key)
    return F.size(F.array_distinct(keys)) == F.size(values)


def is_linkedin(url: Column) -> Column:
    """Empty, or a URL on one of the allowed hosts."""
    host = F.lower(F.regexp_extract(url, r"^https?://(?:[^/@]*@)?([^/:?#]+)", 1))
    return url.isNull() | host.isin(*vocab.LINKEDIN_HOSTS)


def nationality_evidence(profiles: DataFrame) -> DataFrame:
    """One evidence row per profile with a nationality; German ones imply more."""
    name = T.strip(F.col("nationality"))
    german = T.casefold(name).isin(*vocab.GERMAN_NATIONALITIES)
    statement = F.concat(F.lit("Im Profil hinterlegte Staatsangehörigkeit: "), name, F.lit("."))
    words = F.concat(F.array(name), T.word_list(vocab.NATIONALITY_KEYWORDS))
    pid = F.col("profile_id").cast("string")
    return profiles.where(F.coalesce(name, F.lit("")) != "").select(
        "profile_id",
        F.concat(F.lit("profile:"), pid, F.lit(":nationality")).alias("source_name"),
        F.lit("manual").alias("source_type"),
        F.to_json(
            F.struct(german.alias("nato_member_nationality"), name.alias("nationality"), pid.alias("profile_id"))
        ).alias("source_content"),
        F.lit(vocab.NATIONALITY_LABEL).alias("label"),
        F.when(german, F.concat_ws(" ", statement, *[F.lit(s) for s in vocab.GERMAN_STATEMENTS]))
        .otherwise(statement).alias("evidence_text"),
        F.lit("other").alias("experience_context"),
        F.when(german, F.concat(words, T.word_list(vocab.GERMAN_KEYWORDS))).otherwise(words).alias("keywords"),
    )


def _titles(localizations: Column) -> Column:
    return F.transform(localizations, lambda entry: entry["title"])


def _localized_text(localizations: Column) -> Column:
    parts = F.flatten(
        F.transform(
            localizations,
            lambda entry: F.concat(F.array(entry["title"], F.coalesce(entry["summary"], F.lit(""))), entry["bullets"]),
        )
    )
    return F.array_join(F.filter(parts, lambda p: p != ""), "\n")


def _resource(rows: DataFrame, kind: str, context: str, source_type, label: Column, core: Column, words: Column) -> DataFrame:
    """Evidence rows of one resource table with id, profile_id and localizations."""
    texts = F.array(core, _localized_text(F.col("localizations")))
    return rows.select(
        "profile_id",
        F.concat(F.lit("profile:"), F.col("profile_id").cast("string"), F.lit(f":{kind}:"), F.col("id").cast("string"))
        .alias("source_name"),
        source_type.alias("source_type"),
        F.to_json(F.struct(*[c for c in rows.columns if c != "localizations"])).alias("source_content"),
        label.alias("label"),
        F.array_join(F.filter(texts, lambda p: p != ""), "\n").alias("evidence_text"),
        F.lit(context).alias("experience_context"),
        F.filter(words, lambda w: F.coalesce(w != "", F.lit(False))).alias("keywords"),
    )


def profile_evidence(profiles, experiences, projects, education, certificates, skill_links) -> DataFrame:
    """All evidence of all profiles (U1).  ``skill_links`` come from ``linked_skill_evidence``."""
    first_title = F.get(_titles(F.col("localizations")), F.lit(0))
    titles = _titles(F.col("localizations"))
    dot = F.lit(" · ")
    end = F.coalesce(F.col("end_date").cast("string"), F.lit("heute"))
    parts = [
        nationality_evidence(profiles),
        _resource(
            experiences, "experience", "professional", F.lit("manual"),
            F.concat(F.coalesce(first_title, F.lit("Berufserfahrung")), dot, "company"),
            F.concat(F.lit("Berufserfahrung bei "), "company", F.lit(", "), F.col("start_date").cast("string"), F.lit(" bis "), end),
            F.concat(F.array("company"), titles),
        ),
        _resource(
            projects, "project", "project",
            F.when(F.coalesce("repository_url", F.lit("")) != "", "github").otherwise("portfolio"),
            F.coalesce(first_title, "canonical_name"),
            F.concat(F.lit("Portfolio-Projekt "), "canonical_name", F.lit("; Rolle: "),
                     F.coalesce(T.blank_to_null(F.col("role")), F.lit("nicht angegeben")), F.lit("; Technologien: "),
                     F.array_join("technologies", ", ")),
            F.concat(F.array("canonical_name", "role"), F.col("technologies"), titles),
        ),
        _resource(
            education, "education", "education", F.lit("manual"),
            F.concat(F.coalesce(first_title, F.lit("Ausbildung")), dot, "institution"),
            F.concat(F.lit("Ausbildung bei "), "institution"), F.concat(F.array("institution"), titles),
        ),
        _resource(
            certificates, "certificate", "training", F.lit("certificate"),
            F.concat("official_name", dot, "issuer"),
            F.concat(F.lit("Zertifikat "), "official_name", F.lit(", ausgestellt von "), "issuer"),
            F.concat(F.array("official_name", "issuer"), titles),
        ),
        skill_links,
    ]
    result = parts[0].select(*EVIDENCE_COLUMNS)
    for part in parts[1:]:
        result = result.unionByName(part.select(*EVIDENCE_COLUMNS))
    return result


def link_sources(experiences, projects, certificates, education) -> DataFrame:
    """The four linkable tables in one shape: kind, source_id, owner, source_label, dates."""
    none = F.lit(None).cast("date")

    def part(rows, kind, label, start=none, end=none):
        return rows.select(
            F.lit(kind).alias("kind"), F.col("id").cast("string").alias("source_id"),
            F.col("profile_id").alias("owner"), F.col(label).alias("source_label"),
            start.alias("source_start"), end.alias("source_end"),
        )

    return (
        part(experiences, "experience", "company", F.col("start_date"), F.col("end_date"))
        .unionByName(part(projects, "project", "canonical_name"))
        .unionByName(part(certificates, "certificate", "official_name"))
        .unionByName(part(education, "education", "institution"))
    )


def linked_skill_evidence(links: DataFrame, skills: DataFrame, sources: DataFrame, as_of: Column) -> DataFrame:
    """Evidence of skill links; links whose source is gone are dropped.

    ``links``: link_id, skill_id, kind, source_id, evidence_text, experience_context.
    """
    joined = links.join(skills.select("skill_id", "profile_id", "canonical_name", "aliases"), "skill_id").join(
        sources, ["kind", "source_id"], "left"
    ).where(F.col("source_label").isNotNull() | (F.col("kind") == "manual_training"))
    years = F.when(
        F.col("kind") == "experience",
        F.round(F.greatest(F.lit(0.0), dates.years_between(F.col("source_start"), F.col("source_end"), as_of)), 2),
    )
    label = F.coalesce("source_label", F.lit("Manuelles Training"))
    return joined.select(
        "profile_id",
        F.concat(F.lit("profile:"), F.col("profile_id").cast("string"), F.lit(":skill-evidence:"), F.col("link_id").cast("string"))
        .alias("source_name"),
        F.lit("manual").alias("source_type"),
        F.to_json(F.struct(F.col("canonical_name").alias("skill"), F.col("kind").alias("source_type"), years.alias("years_experience")))
        .alias("source_content"),
        F.concat("canonical_name", F.lit(" · "), label).alias("label"),
        F.concat_ws("\n", F.concat(F.lit("Skill: "), "canonical_name"), F.concat(F.lit("Quelle: "), label),
                    T.blank_to_null(F.col("evidence_text"))).alias("evidence_text"),
        "experience_context",
        F.concat(F.array("canonical_name"), F.coalesce("aliases", T.empty_words())).alias("keywords"),
    )


def validate_links(links: DataFrame, skills: DataFrame, sources: DataFrame) -> DataFrame:
    """Links with a reject reason where skill or source do not fit the profile."""
    owners = skills.select("skill_id", F.col("profile_id").alias("_skill_owner"))
    joined = links.join(owners, "skill_id", "left").join(
        sources.select("kind", "source_id", "owner"), ["kind", "source_id"], "left"
    )
    manual = F.col("kind") == "manual_training"
    reason = (
        F.when(~F.col("_skill_owner").eqNullSafe(F.col("profile_id")), "skill_not_found")
        .when(manual & F.col("source_id").isNotNull(), "manual_training_with_source")
        .when(~manual & ~F.col("owner").eqNullSafe(F.col("profile_id")), "source_not_found")
    )
    return joined.withColumn("reject_reason", reason).drop("_skill_owner", "owner")


def nest_localizations(parents: DataFrame, localizations: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Parents with their localizations sorted by language.

    Languages are unique per parent, so a nested list has at most as many entries as there
    are languages.
    """
    nested = localizations.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("language", *fields))).alias("localizations")
    )
    return parents.join(nested, key, "left")


def upsert_resources(current: DataFrame, changes: DataFrame, key: str, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """(new state, revision rows) after one change per entity.

    ``changes`` carry ``action`` (upsert or delete); NULL fields keep the stored value.  A
    created entity starts at revision 1, every other change adds one.
    """
    renamed = changes.select(key, "action", *[F.col(f).alias(f"_{f}") for f in fields])
    joined = current.withColumn("_stored", F.lit(True)).join(renamed, key, "full_outer")
    stored = F.coalesce("_stored", F.lit(False))
    changed = F.col("action").isNotNull()
    revision = F.when(~stored, 1).otherwise(F.col("revision") + F.when(changed, 1).otherwise(0))
    merged = joined.select(
        key, *[F.coalesce(f"_{f}", f).alias(f) for f in fields], revision.alias("revision"), "action",
        F.when(F.col("action") == "delete", "deleted").when(~stored, "created").when(changed, "updated").alias("event"),
        (stored | (F.col("action") == "upsert")).alias("_valid"),
    ).where("_valid").drop("_valid")
    state = merged.where(~F.coalesce(F.col("action") == "delete", F.lit(False))).select(key, *fields, "revision")
    revisions = merged.where("event is not null").select(
        key, "revision", F.col("event").alias("action"), F.to_json(F.struct(key, *fields, "revision")).alias("snapshot")
    )
    return state, revisions


def merge_localizations(current: DataFrame, changes: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Localizations merged by language; other languages stay."""
    renamed = changes.select(key, "language", *[F.col(f).alias(f"_{f}") for f in fields])
    return current.join(renamed, [key, "language"], "full_outer").select(
        key, "language", *[F.coalesce(f"_{f}", f).alias(f) for f in fields]
    )


def longest_station(experiences: DataFrame, as_of: Column) -> DataFrame:
    """Longest employment of a profile in years, never below zero."""
    years = dates.years_between(F.col("start_date"), F.col("end_date"), as_of)
    return experiences.groupBy("profile_id").agg(F.greatest(F.lit(0.0), F.max(years)).alias("years"))
