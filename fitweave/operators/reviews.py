"""Review history: latest run, confidence scale, decisions and retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitweave.operators.ranking import keep_one

KEY = ["subject_type", "subject_id", "review_type"]


def keep_latest_review(reviews: DataFrame) -> DataFrame:
    """Newest run per subject and review type; attempt and id break ties."""
    order = [F.col("created_at"), F.col("attempt"), F.col("review_id")]
    return keep_one(reviews, KEY, order, last=True)


def review_issues(reviews: DataFrame) -> DataFrame:
    """Issues of each run with their position."""
    return reviews.select(
        "review_id", F.posexplode("issues").alias("position", "issue")
    ).select("review_id", "position", "issue.*")


def normalized_confidence(value: Column) -> Column:
    """Percentages to fractions; fractions stay as they are."""
    return F.when((value > 1) & (value <= 100), value / 100).otherwise(value)


def normalize_review_confidences(reviews: DataFrame) -> DataFrame:
    """Fractions everywhere plus a flag that all of them lie between 0 and 1."""
    fields = F.transform_values("field_confidence", lambda _, v: normalized_confidence(v))
    scaled = reviews.withColumn(
        "overall_confidence", normalized_confidence(F.col("overall_confidence"))
    ).withColumn("field_confidence", fields)
    overall = F.col("overall_confidence")
    return scaled.withColumn(
        "valid",
        F.coalesce(overall.between(0, 1), F.lit(True))
        & F.coalesce(
            F.forall(F.map_values("field_confidence"), lambda v: v.between(0, 1)), F.lit(True)
        ),
    )


def retry_outcome(reviews: DataFrame, first: int = 1, retries_allowed: bool = True) -> DataFrame:
    """Decision that counts after at most one retry (V3)."""
    second = F.max(F.when(F.col("attempt") == first + 1, F.col("decision")))
    per_key = reviews.groupBy(*KEY).agg(
        F.max(F.when(F.col("attempt") == first, F.col("decision"))).alias("first_decision"),
        (second if retries_allowed else F.lit(None).cast("string")).alias("second_decision"),
    )
    one, two = F.col("first_decision"), F.col("second_decision")
    return per_key.withColumn(
        "outcome",
        F.when(one != "retry", one)
        .when((one == "retry") & (two.isNull() | (two == "retry")), "manual_review")
        .otherwise(two),
    ).withColumn("attempts_used", F.when(one.isNull(), 0).when(one != "retry", 1).otherwise(2))


def _all_filled(items: Column, field: str) -> Column:
    return F.coalesce(
        items.isNotNull()
        & F.forall(items, lambda i: F.coalesce(F.length(F.trim(i[field])) > 0, F.lit(False))),
        F.lit(False),
    )


def apply_review(extractions: DataFrame) -> DataFrame:
    """Result after a review decision, with an outcome column.

    ``outcome`` is original, original_manual, corrected, invalid_correction or unsupported;
    the last two carry no result and belong in a quarantine table.
    """
    corrected = (
        F.col("corrected_metadata").isNotNull()
        & _all_filled(F.col("corrected_activities"), "activity")
        & _all_filled(F.col("corrected_requirements"), "requirement")
    )
    decision = F.col("decision")
    outcome = (
        F.when(decision == "accept", "original")
        .when(decision == "manual_review", "original_manual")
        .when(decision == "correct", F.when(corrected, "corrected").otherwise("invalid_correction"))
        .otherwise("unsupported")
    )
    marked = extractions.withColumn("outcome", outcome)
    for name in ("metadata", "activities", "requirements"):
        marked = marked.withColumn(
            f"final_{name}",
            F.when(F.col("outcome") == "corrected", F.col(f"corrected_{name}")).when(
                F.col("outcome").startswith("original"), F.col(name)
            ),
        )
    return marked.withColumn("requires_manual_review", F.col("outcome") == "original_manual")


def select_review_result(results: DataFrame, reviews: DataFrame, key: str) -> DataFrame:
    """Corrected result when a review gives one, else the generated result (V2)."""
    joined = results.join(reviews.select(key, "review_status", "corrected_result"), key, "left")
    usable = F.when(
        (F.col("corrected_result") != "") & (F.col("review_status") != "failed"),
        F.col("corrected_result"),
    )
    return joined.withColumn("final_result", F.coalesce(usable, F.col("generated_result")))
