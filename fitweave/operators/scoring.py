"""Qualification fit, level summary and recommendation.

Points are summed as integer hundredths, so the score does not depend on the order in
which partial sums meet, and exact halves round to even.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitweave import vocab

PAIR = ["job_id", "profile_id"]


def priority_weight(priority: Column) -> Column:
    weight = F.lit(2)
    for name, value in vocab.PRIORITY_WEIGHT.items():
        weight = F.when(priority == name, F.lit(value)).otherwise(weight)
    return weight


def fulfilment_percent(level: Column) -> Column:
    percent = F.lit(0)
    for name, value in vocab.LEVEL_FULFILMENT.items():
        percent = F.when(level == name, F.lit(round(value * 100))).otherwise(percent)
    return percent


def weighted_requirements(matches: DataFrame) -> DataFrame:
    """Per-requirement breakdown; a narrow projection, one row per match."""
    priority = F.coalesce("priority", F.lit("should"))
    level = F.coalesce("match_level", F.lit("unknown"))
    return (
        matches.withColumn("priority", priority)
        .withColumn("match_level", level)
        .withColumn("priority_weight", priority_weight(F.col("priority")))
        .withColumn("fulfillment_percent", fulfilment_percent(F.col("match_level")))
        .withColumn(
            "weighted_points",
            F.col("priority_weight") * F.col("fulfillment_percent") / F.lit(100.0),
        )
        .withColumn("possible_points", F.col("priority_weight"))
    )


def fit_level(score: Column) -> Column:
    return (
        F.when(score.isNull(), "unknown").when(score >= 80, "strong").when(score >= 60, "good")
        .when(score >= 40, "partial").otherwise("weak")
    )


def must_gap(priority: Column, level: Column) -> Column:
    return (priority == "must") & level.isin("gap", "unknown")


def _point_sums() -> list[Column]:
    weight = priority_weight(F.coalesce("priority", F.lit("should")))
    percent = fulfilment_percent(F.coalesce("match_level", F.lit("unknown")))
    return [
        F.sum((weight * percent).cast("long")).alias("_hundredths"),
        F.sum(weight.cast("long")).alias("possible_points"),
        F.count(F.lit(1)).alias("requirement_count"),
        F.count_if(must_gap(F.col("priority"), F.coalesce("match_level", F.lit("unknown"))))
        .alias("must_gaps"),
    ]


def _level_sums() -> list[Column]:
    return [F.count_if(F.col("match_level") == level).alias(f"_{level}") for level in vocab.LEVEL_FULFILMENT]


def _level_map() -> Column:
    """The non-zero level counts as a map; only the five closed levels can be keys."""
    entries = F.array(
        *[F.struct(F.lit(level).alias("k"), F.col(f"_{level}").alias("v")) for level in vocab.LEVEL_FULFILMENT]
    )
    return F.map_from_entries(F.filter(entries, lambda e: e["v"] > 0))


def qualification_fit(matches: DataFrame, keys: list[str] = PAIR) -> DataFrame:
    """Weighted fit per pair; one partial and one final hash aggregation."""
    return with_score(matches.groupBy(*keys).agg(*_point_sums()))


def fit_and_levels(matches: DataFrame, keys: list[str] = PAIR) -> DataFrame:
    """Weighted fit and level summary per pair from one aggregation."""
    sums = matches.groupBy(*keys).agg(*_point_sums(), *_level_sums())
    levels = [f"_{level}" for level in vocab.LEVEL_FULFILMENT]
    return with_score(sums).withColumn("summary", _level_map()).drop(*levels)


def with_score(sums: DataFrame) -> DataFrame:
    score = F.when(
        F.col("possible_points") > 0,
        F.bround(F.col("_hundredths") / F.col("possible_points"), 0).cast("int"),
    )
    return (
        sums.withColumn("score", score)
        .withColumn("level", fit_level(F.col("score")))
        .withColumn("achieved_points", F.col("_hundredths") / F.lit(100.0))
        .drop("_hundredths")
    )


def level_counts(matches: DataFrame, keys: list[str] = PAIR) -> DataFrame:
    """Matches per pair and level."""
    return matches.groupBy(*keys, "match_level").agg(F.count(F.lit(1)).alias("n"))


def level_summary(matches: DataFrame, keys: list[str] = PAIR) -> DataFrame:
    """Level counts of a pair as a map."""
    return matches.groupBy(*keys).agg(*_level_sums()).select(*keys, _level_map().alias("summary"))


def recommendation(pairs: DataFrame) -> DataFrame:
    """Verdict per pair from qualification_score, target_score, target_level, must_gaps
    and review_exclusions; first rule that holds decides."""
    q, t = F.col("qualification_score"), F.col("target_score")
    gaps, reviews = F.col("must_gaps"), F.col("review_exclusions")
    rule = (
        F.when(F.col("target_level") == "conflict", "conflict")
        .when(q.isNull(), "no_qualification")
        .when(t.isNull(), "no_target")
        .when((q >= 60) & (t >= 60) & (gaps == 0), "both_fit")
        .when((q >= 40) & (t >= 60), "gaps_left")
        .when((q >= 60) & (t < 45), "goals_differ")
        .when(q < 40, "low_qualification")
        .otherwise("mixed")
    )
    verdicts = {
        "conflict": ("deprioritize", "Nicht priorisieren"),
        "no_qualification": ("review", "Zunächst Qualifikationen prüfen"),
        "no_target": ("review", "Ziel-Fit manuell prüfen"),
        "both_fit": ("apply", "Bewerbung empfohlen"),
        "gaps_left": ("consider", "Bewerbung erwägen"),
        "goals_differ": ("review", "Fachlich passend, Ziel-Fit schwach"),
        "low_qualification": ("deprioritize", "Eher nicht priorisieren"),
        "mixed": ("review", "Manuell abwägen"),
    }

    def pick(index: int) -> Column:
        chosen = F.lit(None).cast("string")
        for name, values in verdicts.items():
            chosen = F.when(F.col("_rule") == name, F.lit(values[index])).otherwise(chosen)
        return chosen

    def percent(label: str, score: Column) -> Column:
        return F.concat(
            F.lit(f"{label}: "),
            F.coalesce(F.concat(score.cast("int").cast("string"), F.lit(" %")), F.lit("unklar")),
        )

    reasons = F.array_compact(
        F.array(
            percent("Qualifikations-Fit", q),
            percent("Ziel-Fit", t),
            F.when(gaps > 0, F.concat(gaps.cast("string"), F.lit(" unbelegte oder unklare Muss-Anforderung(en)"))),
            F.when(reviews > 0, F.concat(reviews.cast("string"), F.lit(" Ausschlusskriterium/-kriterien manuell prüfen"))),
        )
    )
    return (
        pairs.withColumn("_rule", rule)
        .withColumn("verdict", pick(0))
        .withColumn("headline", pick(1))
        .withColumn("reasons", reasons)
        .withColumn(
            "requires_manual_review",
            F.col("verdict").isin("consider", "review") | (gaps > 0) | (reviews > 0),
        )
        .drop("_rule")
    )
