"""Dashboard queries: search, status filters, duplicate names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitweave.functions import text as T
from fitweave.operators import reports
from fitweave.operators.skew import balanced_join

SEARCHED = ["title", "company", "location", "work_model", "employment_type", "source_portal"]


def search_text(columns: list[str] | None = None) -> Column:
    filled = [T.blank_to_null(F.col(c)) for c in (columns or SEARCHED)]
    return T.without_accents(F.lower(F.concat_ws(" ", *filled)))


def keyword_search(jobs: DataFrame, terms: str, columns: list[str] | None = None) -> DataFrame:
    """Jobs whose searchable text contains every term."""
    folded = [t for t in _fold(terms).split() if t]
    text = search_text(columns)
    for term in folded:
        jobs = jobs.where(text.contains(term))
    return jobs


def _fold(terms: str) -> str:
    import unicodedata

    flat = unicodedata.normalize("NFD", terms.lower())
    return "".join(c for c in flat if not unicodedata.combining(c))


def name_counts(jobs: DataFrame) -> DataFrame:
    """How often a title and company occur together; partial aggregation, then a salted join."""
    key = [F.lower(F.coalesce("title", F.lit(""))).alias("_title"), F.lower(F.coalesce("company", F.lit(""))).alias("_company")]
    keyed = jobs.select("*", *key)
    counts = keyed.groupBy("_title", "_company").agg(F.count(F.lit(1)).alias("same_name"))
    joined = balanced_join(keyed, counts, ["_title", "_company"], ["job_id"])
    return joined.drop("_title", "_company")


def status_filter(jobs: DataFrame, applications: DataFrame, status: str = "", matching: str = "") -> DataFrame:
    """Rows the dashboard shows for a status and matching choice.

    ``jobs`` carry archived_at and has_matching.  An application status lists applications;
    "open" and "archived" list jobs.
    """
    rows = reports.active(jobs, archived=status == "archived")
    if matching:
        rows = rows.where(F.col("has_matching") == (matching == "matched"))
    if status == "archived":
        return rows.withColumn("status", F.lit(None).cast("string"))
    if status == "open":
        return reports.open_jobs(rows, applications).withColumn("status", F.lit(None).cast("string"))
    wanted = applications.where(F.col("status") == status) if status else applications
    return rows.join(wanted.select("job_id", "status"), "job_id")


def dashboard(jobs: DataFrame, applications: DataFrame, matches: DataFrame, terms: str = "", status: str = "",
              matching: str = "") -> DataFrame:
    """Search, filters and name counts in one plan.

    Name counts cover all jobs, as duplicates are judged before filtering.
    """
    counted = name_counts(reports.with_has_matching(jobs, matches))
    return status_filter(keyword_search(counted, terms), applications, status, matching)
