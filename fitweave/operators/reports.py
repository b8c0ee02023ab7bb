"""Matching context, job detail, lists and stored reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitweave.operators import scoring
from fitweave.operators.ranking import number_rows


def matching_context(pairs: DataFrame, jobs: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs, the texts of their jobs, and the evidence of their profiles.

    Every text and evidence row is there once, however many pairs share it; contact data and references
    stay out.
    """
    keys = pairs.select("job_id", "profile_id").distinct()
    texts = jobs.select(
        "job_id", F.col("title").alias("job_title"), F.col("language").alias("job_language"),
        F.col("content").alias("job_content"),
    )
    allowed = evidence.select(
        "profile_id", "evidence_id", "source_name", "source_type", "label", "evidence_text",
        "experience_context", "keywords",
    )
    return (
        keys,
        texts.join(keys.select("job_id").distinct(), "job_id", "left_semi"),
        allowed.join(keys.select("profile_id").distinct(), "profile_id", "left_semi"),
    )


def document_pairs(pairs: DataFrame, matches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs that documents can be written for, rejected pairs): those with and without a stored match."""
    keys = ["job_id", "profile_id"]
    matched = matches.select(*keys).distinct()
    return pairs.join(matched, keys, "left_semi"), pairs.join(matched, keys, "left_anti")


def review_evidence(evidence: Column, limit: int | None = None, length: int | None = None) -> Column:
    """Evidence items for a review payload (P20), whole by default.

    A caller that shows the payload may ask for the first ``limit`` items and ``length`` characters of each.
    """
    def shown(entry: Column) -> Column:
        text = F.coalesce(entry["evidence_text"], F.lit(""))
        return entry.withField("evidence_text", text if length is None else F.substring(text, 1, length))

    return F.transform(evidence if limit is None else F.slice(evidence, 1, limit), shown)


def with_companies(jobs: DataFrame, companies: DataFrame) -> DataFrame:
    """Jobs with their company, if any."""
    return jobs.join(companies, "company_id", "left")


def applications_report(applications: DataFrame, jobs: DataFrame, companies: DataFrame, profiles: DataFrame) -> DataFrame:
    """Applications with job, company and profile."""
    return (
        with_companies(applications.join(jobs, "job_id"), companies).join(profiles, "profile_id")
    )


def stored_matches(requirements: DataFrame, matches: DataFrame) -> DataFrame:
    """Requirements with their matches."""
    return requirements.join(matches, ["job_id", "requirement_id"])


def with_has_matching(jobs: DataFrame, matches: DataFrame) -> DataFrame:
    """Flag for jobs that have any match."""
    matched = matches.select("job_id").distinct().withColumn("_hit", F.lit(True))
    return jobs.join(matched, "job_id", "left").withColumn(
        "has_matching", F.coalesce("_hit", F.lit(False))
    ).drop("_hit")


def open_jobs(jobs: DataFrame, applications: DataFrame) -> DataFrame:
    """Jobs without an application."""
    return jobs.join(applications.select("job_id"), "job_id", "left_anti")


def active(jobs: DataFrame, archived: bool = False) -> DataFrame:
    """Active or archived jobs."""
    flag = F.col("archived_at").isNotNull()
    return jobs.where(flag if archived else ~flag)


def find_applications(pairs: DataFrame, applications: DataFrame) -> DataFrame:
    """Application per (job, profile), if any."""
    return pairs.join(applications, ["job_id", "profile_id"], "left")


def repeated_pairs(applications: DataFrame) -> DataFrame:
    """(job, profile) keys that break uniqueness."""
    return applications.groupBy("job_id", "profile_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def cascade_delete(deleted: DataFrame, children: dict[str, DataFrame], key: str = "job_id") -> dict[str, DataFrame]:
    """Every child table without the rows of deleted parents."""
    ids = deleted.select(key).distinct()
    return {name: rows.join(ids, key, "left_anti") for name, rows in children.items()}


CHUNK = 1000


def detail_chunks(children: DataFrame, order: list[str], size: int = CHUNK) -> DataFrame:
    """Children of every job in numbered chunks of at most ``size``, however many a job has.

    Columns: job_id, chunk (from 0), first (number of the chunk's first child, from 1) and ``items`` by ``order``.
    """
    numbered = number_rows(children, ["job_id"], [F.col(c) for c in order], "_number")
    items = F.sort_array(F.collect_list(F.struct("_number", *order)))
    chunks = numbered.groupBy("job_id", F.floor((F.col("_number") - 1) / size).alias("chunk")).agg(
        F.min("_number").alias("first"), items.alias("items")
    )
    return chunks.withColumn("items", F.transform("items", lambda i: F.struct(*[i[c].alias(c) for c in order])))


def job_detail(jobs: DataFrame, companies: DataFrame, requirements: DataFrame, activities: DataFrame) -> DataFrame:
    """One row per job with all its children in order (M3).

    For jobs whose children fit into one row; ``detail_chunks`` has them in rows of bounded size.
    """
    reqs = requirements.groupBy("job_id").agg(
        F.array_sort(F.collect_list(F.struct("category", "priority", "requirement"))).alias("requirements")
    )
    acts = activities.groupBy("job_id").agg(
        F.array_sort(F.collect_list(F.struct("position", "activity"))).alias("activities")
    )
    title = F.coalesce("title", F.lit("Unbenannte Stelle"))
    return (
        with_companies(jobs, companies).join(reqs, "job_id", "left").join(acts, "job_id", "left")
        .withColumn("title", title)
    )


def job_list(jobs: DataFrame, companies: DataFrame, matches: DataFrame, include_archived: bool = False) -> DataFrame:
    """Job list newest first with the matching flag (M4)."""
    rows = jobs if include_archived else active(jobs)
    flagged = with_has_matching(with_companies(rows, companies), matches)
    return flagged.withColumn("title", F.coalesce("title", F.lit("Unbenannte Stelle"))).orderBy(
        F.desc("imported_at"), F.desc("job_id")
    )


def stored_report(matches: DataFrame, target: DataFrame) -> DataFrame:
    """Fits, level summary and recommendation per pair with stored matches (M2)."""
    return report_of_fits(scoring.fit_and_levels(matches), target, scoring.PAIR)


def report_of_fits(fits: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """The same from fits that are aggregated already; ``keys`` of them are in the target fits too."""
    qualified = fits.select(
        *keys, F.col("score").alias("qualification_score"), F.col("level").alias("qualification_level"),
        "achieved_points", "possible_points", "requirement_count", "must_gaps", "summary",
    )
    targets = target.select(
        *scoring.PAIR, F.col("score").alias("target_score"), F.col("level").alias("target_level"), "review_exclusions"
    )
    return scoring.recommendation(qualified.join(targets, keys))
