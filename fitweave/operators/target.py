"""Fit of a job to a profile's goals (A4-A9) for a table of (job, profile) pairs.

Texts are folded into words and concepts once per job and once per profile.  After the two
joins everything is computed inside the pair's row over the short preference lists, so
scoring adds no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitweave import vocab
from fitweave.functions import taxonomy as X
from fitweave.functions import text as T
from fitweave.operators.skew import balanced_join

LISTS = {
    "industry": "target_industries",
    "location": "target_locations",
    "work_model": "preferred_work_models",
    "employment_type": "preferred_employment_types",
}


def folded(value: Column) -> Column:
    """(words, concepts) of a text."""
    return T.let(
        T.target_text(value),
        lambda text: F.struct(
            F.filter(F.array_distinct(F.split(text, " ")), lambda w: w != "").alias("words"),
            X.concept_names(text).alias("concepts"),
        ),
    )


def overlap(desired: Column, actual: Column) -> Column:
    """Larger of the shared word and concept shares of two folded texts."""

    def share(field: str) -> Column:
        return F.coalesce(
            F.try_divide(F.size(F.array_intersect(desired[field], actual[field])), F.size(desired[field])),
            F.lit(0.0),
        )

    filled = (F.size(desired["words"]) > 0) & (F.size(actual["words"]) > 0)
    return F.when(filled, F.greatest(share("words"), share("concepts"))).otherwise(F.lit(0.0))


def _filled(values: Column) -> Column:
    return F.filter(
        F.coalesce(values, T.empty_words()), lambda v: F.coalesce(T.strip(v) != "", F.lit(False))
    )


def _first_filled(*values: Column) -> Column:
    return F.coalesce(*[T.blank_to_null(v) for v in values])


def prepare_jobs(jobs: DataFrame) -> DataFrame:
    """Folded fields of jobs: title, role, location, work_model, employment_type, industry,
    activity_text, content, seniority_level."""
    employment = X.canonical_employment_type(F.col("employment_type"))
    actual = {
        "role": _first_filled(F.col("role"), F.col("title")),
        "activities": F.col("activity_text"),
        "industry": F.col("industry"),
        "location": F.col("location"),
        "work_model": X.canonical_work_model(F.col("work_model")),
        "employment_type": employment,
    }
    source = F.concat_ws(
        " ", *[T.blank_to_null(F.col(c)) for c in ("title", "location", "work_model", "employment_type", "content")]
    )
    return jobs.select(
        "job_id",
        *[T.blank_to_null(v).alias(f"actual_{k}") for k, v in actual.items()],
        *[folded(v).alias(f"job_{k}") for k, v in actual.items()],
        folded(source).alias("job_source"),
        T.target_text(source).contains("immatrikul").alias("mentions_enrolment"),
        F.coalesce(F.lower("seniority_level"), F.lit("unknown")).alias("job_level"),
    )


def prepare_profiles(profiles: DataFrame) -> DataFrame:
    """Folded preference lists; plain role names stand in for missing structured roles."""
    plain = F.transform(
        F.coalesce("target_roles", T.empty_words()),
        lambda r, i: F.struct(r.alias("role"), F.lit(None).cast("string").alias("level"), (i + 1).cast("int").alias("priority")),
    )
    structured = F.filter("target_role_preferences", lambda p: F.coalesce(p["role"] != "", F.lit(False)))
    roles = F.when(F.size(F.coalesce("target_role_preferences", F.array())) > 0, structured).otherwise(plain)

    def fold_all(values: Column) -> Column:
        return F.transform(values, lambda v: folded(v))

    goal = T.strip(F.coalesce("career_goal", F.lit("")))
    return profiles.select(
        "profile_id",
        F.transform(
            roles,
            lambda r: F.struct(
                r["role"].alias("role"), F.lower(r["level"]).alias("level"),
                F.greatest(F.lit(1), F.least(F.lit(5), F.coalesce(r["priority"], F.lit(1)))).alias("priority"),
                folded(r["role"]).alias("text"),
            ),
        ).alias("roles"),
        fold_all(F.when(goal != "", F.array(goal)).otherwise(T.empty_words())).alias("want_activities"),
        *[fold_all(_filled(F.col(column))).alias(f"want_{key}") for key, column in LISTS.items()],
        F.transform(
            F.coalesce("deal_breakers", T.empty_words()),
            lambda v: F.struct(v.alias("criterion"), T.target_text(v).alias("plain"), folded(v).alias("text")),
        ).alias("breakers"),
    )


def _entry(key: str, status: Column, percent: Column, weight: Column) -> Column:
    return F.struct(
        F.lit(key).alias("key"), status.alias("status"), percent.cast("int").alias("percent"),
        weight.cast("int").alias("weight"),
    )


def preference(key: str, wanted: Column, actual_text: Column, actual: Column, weight: Column) -> Column:
    """One criterion from the best overlap over the wanted values (A5)."""
    def judge(best: Column) -> Column:
        status = (
            F.when(F.size(wanted) == 0, "not_configured").when(actual_text.isNull(), "unknown")
            .when(best >= 1, "match").when(best >= 0.5, "partial").otherwise("mismatch")
        )
        percent = F.when(
            (F.size(wanted) > 0) & actual_text.isNotNull(),
            F.when(best >= 1, 100).when(best >= 0.5, 60).otherwise(0),
        )
        return _entry(key, status, percent, weight)

    return T.let(F.array_max(F.transform(wanted, lambda d: overlap(d, actual))), judge)


def role_overlaps(roles: Column, actual: Column) -> Column:
    return F.transform(
        roles,
        lambda r: F.struct(
            overlap(r["text"], actual).alias("overlap"), r["level"].alias("level"),
            r["priority"].alias("priority"), r["role"].alias("role"),
        ),
    )


def _best(rows: Column) -> Column:
    """First row with the largest overlap."""
    return T.let(
        F.array_max(rows["overlap"]),
        lambda top: T.first_of(F.filter(rows, lambda r: r["overlap"] == top)),
    )


def role_weight(overlaps: Column) -> Column:
    """Weight of the role criterion from the priority of the best role."""
    return T.let(
        _best(overlaps),
        lambda b: F.coalesce(
            F.when(b["overlap"] > 0, F.lit(2) * (F.lit(6) - b["priority"])),
            F.lit(vocab.TARGET_WEIGHT["role"]),
        ),
    )


def level_rank(level: Column) -> Column:
    rank = F.lit(None).cast("int")
    for name, value in vocab.TARGET_LEVEL_RANK.items():
        rank = F.when(level == name, F.lit(value)).otherwise(rank)
    return rank


def seniority_criterion(overlaps: Column, job_level: Column) -> Column:
    """Distance between the job's level and the level wanted for the best role.

    Without a wanted level, or without a ranked job level, the criterion stays unknown.
    """
    levelled = F.filter(overlaps, lambda r: r["level"].isNotNull() & (r["level"] != "") & (r["overlap"] > 0))

    def points(best: Column) -> Column:
        delta = level_rank(job_level) - F.coalesce(level_rank(best["level"]), F.lit(2))
        return F.when(
            best.isNotNull(),
            T.let(
                delta,
                lambda d: F.when(d == 0, 100).when(d > 0, 80).when(d == -1, 60).when(d.isNotNull(), 0),
            ),
        )

    def judge(percent: Column) -> Column:
        status = (
            F.when(percent.isNull(), "unknown").when(percent == 100, "match").when(percent > 0, "partial")
            .otherwise("mismatch")
        )
        return _entry("seniority", status, percent, F.lit(vocab.TARGET_WEIGHT["seniority"]))

    return T.let(T.let(_best(levelled), points), judge)


def exclusions(breakers: Column, employment: Column, enrolment: Column, source: Column) -> Column:
    """Status of every deal-breaker: conflict, review or clear."""

    def judge(b: Column) -> Column:
        freelance = T.contains_any(b["plain"], ["freiberuf", "freelance"]) & F.coalesce(
            employment == "freelance", F.lit(False)
        )
        student = b["plain"].contains("student") & (
            F.coalesce(employment == "working_student", F.lit(False)) | enrolment
        )
        status = (
            F.when(freelance | student, "conflict").when(overlap(b["text"], source) >= 0.5, "review")
            .otherwise("clear")
        )
        return F.struct(b["criterion"].alias("criterion"), status.alias("status"))

    return F.transform(breakers, judge)


def target_fit(pairs: DataFrame, jobs: DataFrame, profiles: DataFrame) -> DataFrame:
    """Criteria, exclusions, score and level of every pair (A4)."""
    ids = pairs.select("job_id", "profile_id")
    wide = balanced_join(ids, prepare_profiles(profiles), ["profile_id"], ["job_id"])
    wide = balanced_join(wide, prepare_jobs(jobs), ["job_id"], ["profile_id"], counted=ids)
    weights = vocab.TARGET_WEIGHT
    wide = wide.withColumn("role_overlaps", role_overlaps(F.col("roles"), F.col("job_role")))
    role_texts = F.transform(F.filter("roles", lambda r: T.strip(r["role"]) != ""), lambda r: r["text"])
    criteria = F.array(
        preference("role", role_texts, F.col("actual_role"), F.col("job_role"), role_weight(F.col("role_overlaps"))),
        preference("activities", F.col("want_activities"), F.col("actual_activities"), F.col("job_activities"), F.lit(weights["activities"])),
        seniority_criterion(F.col("role_overlaps"), F.col("job_level")),
        *[
            preference(key, F.col(f"want_{key}"), F.col(f"actual_{key}"), F.col(f"job_{key}"), F.lit(weights[key]))
            for key in LISTS
        ],
    )
    scored = wide.withColumn("criteria", criteria).withColumn(
        "exclusions",
        exclusions(F.col("breakers"), F.col("actual_employment_type"), F.col("mentions_enrolment"), F.col("job_source")),
    )
    usable = F.filter("criteria", lambda c: c["percent"].isNotNull())

    def total(value) -> Column:
        return F.aggregate(usable, F.lit(0), lambda acc, c: acc + value(c))

    result = scored.withColumn("_points", total(lambda c: c["percent"] * c["weight"])).withColumn(
        "_weight", total(lambda c: c["weight"])
    )
    score = F.when(F.col("_weight") > 0, F.bround(F.col("_points") / F.col("_weight"), 0).cast("int"))
    result = result.withColumn("score", score).withColumn(
        "hard_conflict", F.exists("exclusions", lambda e: e["status"] == "conflict")
    )
    s = F.col("score")
    level = (
        F.when(F.col("hard_conflict"), "conflict").when(s.isNull(), "unknown").when(s >= 75, "strong")
        .when(s >= 45, "partial").otherwise("weak")
    )
    return result.select(
        "job_id", "profile_id", "score", level.alias("level"), "criteria", "exclusions",
        F.size(F.filter("exclusions", lambda e: e["status"] == "review")).alias("review_exclusions"),
        "hard_conflict",
    )
