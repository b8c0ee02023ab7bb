"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fitweave.session import ensure_checkpoint_dir, materialize

__all__ = ["blank_null", "documents", "ensure_checkpoint_dir", "materialize", "sized", "spread_join", "without_ids"]

HOT_SHARE = 1 / 512
BROADCAST_ROWS = 1_000_000  # of two longs at most, some 30 MB


def documents(spark: SparkSession, folder: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def blank_null(column: str = "text") -> Column:
    """A text column with null read as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def spread_join(rows: DataFrame, groups: DataFrame, key: str, count: str, how: str = "inner") -> DataFrame:
    """Equi-join of narrow rows with one row per group that stays even for hot groups.

    ``groups`` has ``key`` once and in ``count`` the number of ``rows`` that carry it.  Groups of at
    least 1/512 of all rows, hence at most 512 groups whatever the input, are sent to all tasks; their
    rows are salted by ``doc_id`` and the group is repeated once per salt.  All other rows keep salt 0.
    The result is exactly the plain join on ``key``; null keys match no group.
    """
    total = groups.agg((F.sum(count) * HOT_SHARE).alias("_limit"))
    hot = (
        groups.where(F.col(count) >= total.scalar())
        .select(F.col(key).alias("_hot_key"), F.ceil(F.col(count) / total.scalar()).cast("int").alias("_slices"))
    )
    salted = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left").withColumn(
        "_salt", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("_slices")), F.lit(0)).cast("int")
    )
    repeated = groups.drop(count).join(
        F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left"
    ).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_slices") - 1, F.lit(0)))))
    return salted.drop("_hot_key", "_slices").join(
        repeated.drop("_hot_key", "_slices"), [key, "_salt"], how
    ).drop("_salt")


def sized(small: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A narrow written table, sent to all tasks if it has at most ``most`` rows, else as it is.

    Only the way of the join depends on it: beyond the bound both sides are shuffled.
    """
    return F.broadcast(small) if small.count() <= most else small


def without_ids(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Rows of ``docs`` but for the ids none of whose ``verdicts`` (doc_id, stays) is to stay.

    An anti-join by id, null ids matching null ids, so no column of ``docs`` can clash.  Texts are
    shuffled only if very many ids go.
    """
    gone = verdicts.groupBy("doc_id").agg(F.bool_or("stays").alias("stays")).where(~F.col("stays"))
    gone = sized(materialize(gone.select(F.col("doc_id").alias("_gone_id")), "gone"))
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_gone_id"]), "left_anti")
