"""Exact deduplication by progressive refinement.

Texts are equal when they are identical after each run of white space (U+0020, U+0009 to U+000D)
became one space.  Groups are refined three times: by length, by a hash of the first characters, and,
only for rows that still share both, by SHA-256 of the whole text.  A text alone in its length has no prefix hash
made, one alone with its prefix is never hashed as a whole, and the rows of both are taken from the group tables.

Defined cases
* null text counts as the empty text; all empty texts are one group
* null ``doc_id``: the row counts in its group; the smallest non-null id stays (null if there is none)
* ties do not occur: the smallest ``doc_id`` stays
* repeated rows (same id and text) each get a result row; ``exact_dedup`` leaves one of them; an id that
  also stands for a different text stays with both
* very long texts: every level holds one text at a time and moves lengths and hashes only
* an empty table gives an empty result; extra columns are ignored by ``exact_groups`` and kept by
  ``exact_dedup``
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitweave.llm.common import BROADCAST_ROWS, blank_null, materialize, sized, spread_join, without_ids

PREFIX_CHARS = 256


def normalised(column: str = "text") -> Column:
    return F.regexp_replace(blank_null(column), r"[\x20\x09-\x0D]+", " ")


def _measured(docs: DataFrame) -> DataFrame:
    """doc_id, the normalised text and its length, the key of the first level."""
    return docs.select("doc_id", normalised().alias("norm")).withColumn("length", F.char_length("norm"))


def _keyed(measured: DataFrame, prefix: int) -> DataFrame:
    """``_measured`` with the key of the second level."""
    return measured.withColumn("key", F.xxhash64("length", F.substring("norm", 1, prefix)))


def exact_groups(docs: DataFrame, prefix: int = PREFIX_CHARS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size."""
    return refined(docs, prefix).select("doc_id", "keep_id", "group_size")


def digested_groups(docs: DataFrame, prefix: int = PREFIX_CHARS) -> DataFrame:
    """``exact_groups`` with ``text_sha256``, the SHA-256 of the normalised text, of every row.

    For reports that show a digest; hashing what no copy made necessary is one more scan.
    """
    digests = _keyed(_measured(docs), prefix).select(
        F.col("doc_id").alias("_id"), F.col("length").alias("_length"), F.col("key").alias("_key"), F.sha2("norm", 256).alias("text_sha256")
    ).distinct()
    rows = refined(docs, prefix)
    # an id can stand for several texts; the levels that they share are known, and so are those that part them
    same = rows["doc_id"].eqNullSafe(digests["_id"]) & (rows["length"] == digests["_length"])
    same &= F.coalesce(rows["key"] == digests["_key"], F.lit(True)) & F.coalesce(rows["full_hash"] == digests["text_sha256"], F.lit(True))
    return rows.join(digests, same).select("doc_id", "keep_id", "group_size", "text_sha256")


def refined(docs: DataFrame, prefix: int) -> DataFrame:
    """The groups with the keys of the levels that each row went through.

    Counts are combined before they shuffle, so a group of any size is a few rows by then.  Rows meet
    their group again in ``spread_join``, which slices groups that hold a large share of all rows.
    """
    measured = _measured(docs)
    none = F.lit(None)
    by_length = materialize(
        measured.groupBy("length").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc_id")), "exact-lengths"
    )
    columns = ["doc_id", "keep_id", "group_size", "length", "key", "full_hash"]
    first = by_length.where("n = 1").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.col("n").alias("group_size"), "length",
        none.cast("long").alias("key"), none.cast("string").alias("full_hash"),
    )
    # prefix hashes are made of rows whose length others share; lengths are few, whatever the number of rows
    lengths = sized(by_length.where("n > 1").select("length"))
    narrow = _keyed(measured.join(lengths, "length", "left_semi"), prefix).select("doc_id", "length", "key")
    narrow = materialize(narrow, "exact-keys")
    by_key = narrow.groupBy("length", "key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc_id"))
    by_key = materialize(by_key, "exact-prefixes")
    second = by_key.where("n = 1").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.col("n").alias("group_size"), "length", "key", none.cast("string").alias("full_hash")
    )
    shared = by_key.where("n > 1").select("key", "n")
    full = _surviving(docs, narrow, shared, prefix).select("doc_id", "length", "key", F.sha2("norm", 256).alias("full_hash"))
    full = materialize(full, "exact-full")
    groups = full.groupBy("full_hash").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("keep_id"))
    groups = groups.withColumn("group_size", F.col("n"))
    third = spread_join(full, groups, "full_hash", "n")
    return first.unionByName(second).unionByName(third.select(*columns))


def _surviving(docs: DataFrame, narrow: DataFrame, shared: DataFrame, prefix: int) -> DataFrame:
    """Rows with their whole texts whose key others share.

    While the shared keys are few enough to be sent to all tasks, rows are picked where they are read.
    Beyond that, survivors are found on narrow rows, hot keys in slices, and fetch their texts by id.
    """
    read = _keyed(_measured(docs), prefix)
    keys = materialize(shared.select(F.col("key").alias("_key")), "exact-shared")
    if keys.count() <= BROADCAST_ROWS:
        return read.join(F.broadcast(keys), read["key"] == keys["_key"], "left_semi")
    ids = spread_join(narrow.select("doc_id", "key"), shared, "key", "n").distinct()
    ids = ids.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"))
    return read.join(ids, read["doc_id"].eqNullSafe(ids["_id"]) & (read["key"] == ids["_key"]), "left_semi")


def exact_dedup(docs: DataFrame, prefix: int = PREFIX_CHARS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; whole repeats of a row stay once."""
    rows = exact_groups(docs, prefix).withColumn("stays", F.col("doc_id").eqNullSafe(F.col("keep_id")))
    rows = materialize(rows, "exact-rows")
    stay = without_ids(docs, rows)
    repeated = rows.where("stays").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    repeated = materialize(repeated.select(F.col("doc_id").alias("_id")), "exact-repeated")
    if repeated.isEmpty():
        return stay
    again = stay["doc_id"].eqNullSafe(repeated["_id"])
    once = stay.join(repeated, again, "left_semi").withColumn("_once", F.sha2(normalised(), 256))
    return stay.join(repeated, again, "left_anti").unionByName(once.dropDuplicates(["doc_id", "_once"]).drop("_once"))
