"""Import of extracted ads into the job table.

Duplicates are found by two equi-joins (content hash, URL), never by an OR condition.
Stored rows are reduced to one candidate per key first, so a group of many copies
meets the import as a single row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitweave import vocab
from fitweave.functions import text as T
from fitweave.operators.graphs import components
from fitweave.operators.ranking import keep_one
from fitweave.operators.skew import balanced_join
from fitweave.session import materialize

FILL_FIELDS = ["company", "source_portal", "location", "work_model", "employment_type",
               "contract_term", "language"]


IMPORT_KEYS = ("content_hash", "source_url")


def with_normalized_hash(rows: DataFrame, content: str = "content") -> DataFrame:
    """Adds ``normalized_hash``, of the text without case, accents, punctuation and spacing.

    Null for a text without letters and figures: such texts say nothing about each other.
    """
    # nullif names its argument once, so that a text is folded once
    return rows.withColumn("normalized_hash", T.content_hash(F.nullif(T.comparable_text(F.col(content)), F.lit(""))))


def normalized_keys(rows: DataFrame, *columns: str) -> DataFrame:
    """``columns`` and ``normalized_hash``, written: groups, counts and joins read them, and folding a text costs far more than that."""
    return materialize(with_normalized_hash(rows).select(*columns, "normalized_hash"), "normalized-keys")


def find_duplicates(incoming: DataFrame, stored: DataFrame, keys: tuple[str, ...] = IMPORT_KEYS) -> DataFrame:
    """First stored job that agrees in any of the keys, per import.

    ``incoming``: import_id and the keys.  ``stored``: job_id, imported_at and the same keys.  With
    ``normalized_hash`` as a key, an ad posted again in another typography meets its first posting.
    """
    first = F.struct("imported_at", "job_id")

    def by(key: str) -> DataFrame:
        candidates = stored.where(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(key).agg(
            F.min(first).alias("found")
        )
        # one candidate per key: Spark splits a hot key's imports by itself (adaptive skew join)
        return incoming.select("import_id", key).join(candidates, key).select("import_id", "found")

    both = by(keys[0])
    for key in keys[1:]:
        both = both.unionByName(by(key))
    return both.groupBy("import_id").agg(F.min("found").alias("found")).select(
        "import_id", F.col("found.job_id").alias("existing_id")
    )


def reposted_jobs(jobs: DataFrame) -> DataFrame:
    """Every job with the first posting of its normalized text and how often that was posted.

    ``jobs``: job_id, imported_at, content.  Only digests are shuffled; counts are combined first and a
    text that is posted very often is sliced in the join.  A text without letters and figures stands alone.
    """
    keyed = normalized_keys(jobs, "job_id", "imported_at")
    first = F.min_by("job_id", F.struct("imported_at", "job_id")).alias("first_id")
    groups = keyed.where(F.col("normalized_hash").isNotNull()).groupBy("normalized_hash").agg(
        first, F.count(F.lit(1)).alias("postings"))
    joined = balanced_join(keyed, groups, ["normalized_hash"], ["job_id"], how="left")
    return joined.select(
        "job_id", F.coalesce("first_id", "job_id").alias("first_id"), F.coalesce("postings", F.lit(1)).cast("long").alias("postings")
    )


# rounds before what is left is folded component by component
LEADER_ROUNDS = 3


def batch_leaders(incoming: DataFrame, rounds: int = LEADER_ROUNDS) -> DataFrame:
    """Imports of one batch that are new when the batch is processed in import order.

    An import is a duplicate only of an earlier import that was itself inserted.  Of imports that agree
    in both keys only the first can be new, so the others go first.  Every round settles the imports that
    come first under both of their keys and drops what they cover, which empties groups that share a
    key, however large.  Chains (hash, URL, hash, ...) would take a round per link: what is left after
    ``rounds`` rounds is labelled by connected components and folded in order inside each.
    """
    keys = incoming.select("import_id", "content_hash", F.nullif("source_url", F.lit("")).alias("source_url"))
    open_rows = materialize(keys.groupBy("content_hash", "source_url").agg(F.min("import_id").alias("import_id")), "leader-open")
    leaders = []
    for _ in range(rounds):
        hash_first = open_rows.groupBy("content_hash").agg(F.min("import_id").alias("_by_hash"))
        url_first = open_rows.where("source_url is not null").groupBy("source_url").agg(F.min("import_id").alias("_by_url"))
        first = balanced_join(
            balanced_join(open_rows, hash_first, ["content_hash"], ["import_id"]),
            url_first, ["source_url"], ["import_id"], how="left", counted=open_rows.select("source_url"),
        ).where((F.col("import_id") == F.col("_by_hash")) & (F.col("import_id") == F.coalesce("_by_url", "import_id")))
        settled = materialize(first.select("import_id", "content_hash", "source_url"), "leader-settled")
        leaders.append(settled)
        left = open_rows.join(settled.select("content_hash"), "content_hash", "left_anti").join(
            settled.where("source_url is not null").select("source_url").distinct(), "source_url", "left_anti"
        )
        open_rows = materialize(left.select("import_id", "content_hash", "source_url"), "leader-open")
        if open_rows.isEmpty():
            break
    else:
        leaders.append(fold_leaders(open_rows))
    return _union(leaders)


def _union(frames: list[DataFrame]) -> DataFrame:
    whole = frames[0]
    for other in frames[1:]:
        whole = whole.unionByName(other)
    return whole


def fold_leaders(rows: DataFrame) -> DataFrame:
    """Leaders among ``rows`` (import_id, content_hash, source_url) by one ordered pass over each component.

    Components link the keys that rows share.  A task streams through its components in import order and
    holds the keys of one component's leaders at a time.
    """
    # labels of two keys may collide; then two components are folded together, with the same outcome
    ends = rows.withColumn("a", F.xxhash64(F.lit("hash"), "content_hash")).withColumn(
        "b", F.when(F.col("source_url").isNotNull(), F.xxhash64(F.lit("url"), "source_url"))
    )
    labels = components(ends.where("b is not null").select("a", "b"))
    labelled = ends.join(labels.withColumnRenamed("node", "a"), "a", "left").select(
        F.coalesce("root", "a").alias("component"), *rows.columns
    )
    ordered = labelled.repartition("component").sortWithinPartitions("component", "import_id")
    kept = rows.columns

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, hashes, urls = None, set(), set()
        for batch in batches:
            keep = []
            names = ("component", "content_hash", "source_url")
            for component, content_hash, url in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
                if component != current:
                    current, hashes, urls = component, set(), set()
                new = content_hash not in hashes and (url is None or url not in urls)
                if new:
                    hashes.add(content_hash)
                    urls.add(url)
                keep.append(new)
            yield batch.select(kept).filter(pa.array(keep, pa.bool_()))

    return ordered.mapInArrow(fold, rows.schema)


def resolve_companies(names: DataFrame, companies: DataFrame) -> DataFrame:
    """Company table extended by names it does not know, compared case-insensitively."""
    key = F.lower(T.strip(F.col("company")))
    wanted = names.select(T.strip(F.col("company")).alias("name"), key.alias("name_key")).where(
        F.col("name_key") != ""
    )
    fresh = wanted.groupBy("name_key").agg(F.min("name").alias("name"))
    known = companies.withColumn("name_key", F.lower("name"))
    added = fresh.join(known.select("name_key"), "name_key", "left_anti")
    return known.select("company_id", "name", "name_key").unionByName(
        added.select(T.stable_id(F.col("name_key")).alias("company_id"), "name", "name_key")
    )


def child_counts(jobs: DataFrame, children: DataFrame, name: str) -> DataFrame:
    """Children per job, zero where there are none."""
    counts = children.groupBy("job_id").agg(F.count(F.lit(1)).alias(name))
    return jobs.join(counts, "job_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))


def accept_candidates(jobs: DataFrame, candidates: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Fills empty metadata fields from externally supplied candidates.

    Long candidates are checked against the job text, then pivoted by one aggregation.
    """
    folded = T.casefold(T.squeeze(F.col("content")))
    evidence = T.casefold(T.squeeze(F.col("evidence")))
    confidence = F.coalesce("confidence", F.lit(0.0))
    value = T.strip(F.col("value"))
    value = F.when(F.col("field") == "language", T.casefold(value)).otherwise(value)
    from_benefit = (F.col("field") == "work_model") & T.contains_any(
        T.casefold(F.col("evidence")), vocab.BENEFIT_EVIDENCE
    )
    accepted = (
        candidates.where(F.col("field").isin(*vocab.CANDIDATE_FIELDS))
        .join(jobs.select("job_id", "content"), "job_id")
        .where(
            (value != "")
            & ((F.col("field") != "language") | value.isin("de", "en"))
            & (confidence >= threshold)
            & (F.coalesce("evidence", F.lit("")) != "")
            & ((F.col("content") == "") | folded.contains(evidence))
            & ~from_benefit
        )
        .groupBy("job_id")
        .agg(
            *[
                F.min(F.when(F.col("field") == name, value)).alias(f"_{name}")
                for name in vocab.CANDIDATE_FIELDS
            ]
        )
    )
    merged = jobs.join(accepted, "job_id", "left")
    for name in vocab.CANDIDATE_FIELDS:
        merged = merged.withColumn(name, F.coalesce(T.blank_to_null(F.col(name)), F.col(f"_{name}")))
    return merged.drop(*[f"_{name}" for name in vocab.CANDIDATE_FIELDS])


def override(extracted: Column, given: Column) -> Column:
    """Given value where it is not empty."""
    return F.coalesce(T.blank_to_null(given), extracted)


def display_value(stored: Column, extracted: Column) -> Column:
    """Stored value, else the freshly extracted one."""
    return F.coalesce(T.blank_to_null(stored), extracted)


def edit_metadata(jobs: DataFrame, patches: DataFrame, fields: list[str]) -> DataFrame:
    """Sets only the fields a patch names in ``set_fields``; blank text clears."""
    renamed = patches.select(
        "job_id", "set_fields", *[F.col(f).alias(f"_{f}") for f in fields]
    )
    edited = jobs.join(renamed, "job_id", "left")
    for field in fields:
        named = F.coalesce(F.array_contains("set_fields", field), F.lit(False))
        edited = edited.withColumn(
            field,
            F.when(named, T.blank_to_null(T.strip(F.col(f"_{field}")))).otherwise(F.col(field)),
        )
    return edited.select(*jobs.columns)


def normalize_requirement_items(items: Column) -> Column:
    """Trimmed, capped and validated requirement structs of one job, at most 200."""
    priorities = list(vocab.PRIORITY_WEIGHT)

    def normalize(item: Column) -> Column:
        first = lambda c: T.blank_to_null(c)
        text = T.strip(F.coalesce(first(item["requirement"]), item["activity"], F.lit("")))
        category = F.coalesce(first(T.strip(item["category"])), F.lit("other"))
        rank = T.strip(F.coalesce(first(item["priority"]), F.lit("should")))
        words = F.filter(
            F.transform(F.coalesce(item["keywords"], T.empty_words()), lambda k: T.strip(k)),
            lambda k: F.coalesce(k != "", F.lit(False)),
        )
        return F.struct(
            text.alias("requirement"),
            category.alias("category"),
            F.when(rank.isin(*priorities), rank).otherwise("should").alias("priority"),
            F.array_distinct(words).alias("keywords"),
        )

    return F.filter(F.transform(items, normalize), lambda r: F.length(r["requirement"]) >= 3)


def preferred_requirements(stored: Column, extracted: Column) -> Column:
    """Stored list when it has any valid row, else the extracted list."""
    return T.let(
        normalize_requirement_items(F.coalesce(stored, F.filter(extracted, lambda _: F.lit(False)))),
        lambda s: F.when(F.size(s) > 0, s).otherwise(normalize_requirement_items(extracted)),
    )


def ingest_jobs(incoming: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Upsert of a batch of extracted ads: (outcome per import, new state of touched jobs) (G1).

    ``incoming``: import_id (processing order), content_hash, source_url, source_type,
    retrieval_method, replace_existing, title, content, FILL_FIELDS, requirements, activities.
    ``stored``: job_id, imported_at, the same content columns.  A replacing import takes over all fields; every
    later import of the same job only fills what is empty, in import order.
    """
    # the extraction behind ``incoming`` runs once; key lookups then read key columns only
    incoming = materialize(incoming, "import-batch")
    matched = incoming.join(find_duplicates(incoming, stored), "import_id", "left")
    unmatched = matched.where("existing_id is null").select("import_id", "content_hash", "source_url")
    leaders = materialize(batch_leaders(unmatched), "import-leaders")
    new_id = T.stable_id(F.lit("job"), F.col("content_hash"), F.coalesce("source_url", F.lit("")))
    as_stored = leaders.select(
        new_id.alias("job_id"), F.col("import_id").alias("imported_at"), "content_hash", "source_url"
    )
    in_batch = find_duplicates(unmatched, as_stored).withColumnRenamed("existing_id", "batch_id")
    lead = leaders.select("import_id", F.lit(True).alias("is_new"))
    targeted = (
        matched.join(in_batch, "import_id", "left").join(lead, "import_id", "left")
        .withColumn("is_new", F.coalesce("is_new", F.lit(False)))
        .withColumn("job_id", F.coalesce(F.col("existing_id").cast("string"), "batch_id"))
        .drop("existing_id", "batch_id")
    )
    ocr = (F.col("source_type") == "pdf") & (F.col("retrieval_method") == vocab.OCR_METHOD)
    known = stored.select(
        F.col("job_id").cast("string").alias("job_id"), F.col("retrieval_method").alias("_stored_method")
    )
    first_ocr = targeted.groupBy("job_id").agg(
        F.min(F.when(ocr, F.col("import_id"))).alias("_first_ocr"),
        F.bool_or(F.col("is_new") & ocr).alias("_new_by_ocr"),
    ).join(known, "job_id", "left")
    ranked = targeted.join(first_ocr, "job_id").withColumn(
        "replaces",
        F.when(F.col("is_new"), False).otherwise(
            F.coalesce("replace_existing", F.lit(False))
            | (ocr & (F.col("import_id") == F.col("_first_ocr")) & ~F.col("_new_by_ocr")
               & ~F.coalesce(F.col("_stored_method") == vocab.OCR_METHOD, F.lit(False)))
        ),
    ).drop("_first_ocr", "_new_by_ocr", "_stored_method")
    ranked = materialize(ranked, "import-targets")

    whole = ["title", "content", "content_hash", "source_url", "source_type", "retrieval_method"]
    fields = whole + FILL_FIELDS
    base_order = F.when(F.col("replaces") | F.col("is_new"), F.col("import_id"))
    bases = ranked.groupBy("job_id").agg(F.max(base_order).alias("_base"))
    rows = ranked.join(bases, "job_id")
    later = F.col("import_id") > F.coalesce("_base", F.lit(-1))

    def filled(name: str) -> Column:
        value = F.col(name)
        present = F.size(value) > 0 if name in ("requirements", "activities") else value != ""
        return F.min_by(name, F.when(later & F.coalesce(present, F.lit(False)), F.col("import_id")))

    lists = ["requirements", "activities"]
    is_base = F.col("import_id") == F.col("_base")
    changes = rows.groupBy("job_id").agg(
        F.bool_or(F.coalesce(is_base, F.lit(False))).alias("_has_base"),
        *[F.max_by(n, F.when(is_base, F.col("import_id"))).alias(f"_base_{n}") for n in fields + lists],
        *[filled(n).alias(f"_fill_{n}") for n in FILL_FIELDS + lists],
    )
    before = stored.select(
        F.col("job_id").cast("string").alias("job_id"),
        *[F.col(n).alias(f"_old_{n}") for n in fields + lists],
    )
    joined = changes.join(before, "job_id", "left")

    def final(name: str) -> Column:
        start = F.when(F.col("_has_base"), F.col(f"_base_{name}")).otherwise(F.col(f"_old_{name}"))
        if name in lists:
            start = F.when(F.size(start) > 0, start)
            return F.coalesce(start, F.col(f"_fill_{name}"))
        if name in FILL_FIELDS:
            return F.coalesce(T.blank_to_null(start), F.col(f"_fill_{name}"))
        return start

    jobs = joined.select("job_id", *[final(n).alias(n) for n in fields + lists])
    outcome = (
        F.when(F.col("is_new"), "inserted").when(F.col("replaces"), "replaced").otherwise("duplicate")
    )
    return ranked.select("import_id", "job_id", outcome.alias("outcome")), jobs


def merge_jobs(stored: DataFrame, changed: DataFrame) -> DataFrame:
    """Job table after an ingest: untouched rows plus the new state of touched ones."""
    columns = [c for c in changed.columns if c in stored.columns]
    kept = stored.withColumn("job_id", F.col("job_id").cast("string")).join(
        changed.select("job_id"), "job_id", "left_anti"
    )
    return kept.select(*columns).unionByName(changed.select(*columns))


def backfill(stored: DataFrame, extracted: DataFrame, fields: list[str], *, repair: bool = False) -> DataFrame:
    """Fill mode keeps stored values, repair mode prefers extracted ones."""
    fresh = extracted.select("job_id", *[F.col(f).alias(f"_{f}") for f in fields])
    joined = stored.join(fresh, "job_id", "left")
    for field in fields:
        old, new = F.col(field), F.col(f"_{field}")
        joined = joined.withColumn(field, F.coalesce(new, old) if repair else F.coalesce(old, new))
    return joined.select(*stored.columns)


def assign_single_profile(matches: DataFrame, profiles: DataFrame) -> DataFrame:
    """Matches without a profile get the only profile, if there is exactly one.

    The one-row aggregate is a scalar subquery, not a join.
    """
    only = profiles.agg(
        F.when(F.count(F.lit(1)) == 1, F.min("profile_id")).alias("only")
    )
    return matches.withColumn("profile_id", F.coalesce("profile_id", only.scalar()))


def latest_import(jobs: DataFrame) -> DataFrame:
    """Newest job (K1)."""
    return jobs.orderBy(F.desc("imported_at"), F.desc("job_id")).limit(1)


def one_per_hash(jobs: DataFrame) -> DataFrame:
    """First job per content hash."""
    return keep_one(jobs, ["content_hash"], [F.col("imported_at"), F.col("job_id")])
