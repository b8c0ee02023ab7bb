"""Parquet tables of the engine: child rows, registry rows and match scopes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fitweave.operators import structure


COMMITS = "commits"


def write_jobs(jobs: DataFrame, folder: str, batch_id: int) -> None:
    """One batch of job rows and their ordered children.

    ``jobs`` carries the structure arrays.  They are written once and the child tables are exploded from the
    written part, so the extraction runs a single time and a lost executor never repeats it.  Every table
    gets a part of its own for the batch; other batches are neither read nor written.  The marker
    comes last: a batch without one is not there for readers, and writing it again replaces its parts.
    """
    spark = jobs.sparkSession
    _write_part(jobs, f"{folder}/jobs", batch_id)
    stored = spark.read.parquet(f"{folder}/jobs/batch={batch_id}")
    _write_part(structure.requirement_rows(stored), f"{folder}/job_requirements", batch_id)
    _write_part(structure.activity_rows(stored), f"{folder}/job_activities", batch_id)
    _write_part(structure.benefit_rows(stored), f"{folder}/job_benefits", batch_id)
    _write_part(spark.range(1).select(F.current_timestamp().alias("committed_at")), f"{folder}/{COMMITS}", batch_id)


def _write_part(rows: DataFrame, path: str, batch_id: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def read_batches(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the sink, of committed batches only, with the ``batch`` of each row.

    The markers are one row per batch; they prune the parts of the table before it is read.
    """
    committed = spark.read.parquet(f"{folder}/{COMMITS}").select("batch")
    return spark.read.parquet(f"{folder}/{name}").join(F.broadcast(committed), "batch", "left_semi")


def write_matches(matches: DataFrame, folder: str, buckets: int = 64) -> None:
    """Replaces the match rows of every touched bucket of (job, profile).

    The caller passes complete buckets, see ``touched_buckets``.  Buckets are few whatever the size of the table, so one
    of more than the advisory partition size is written by several tasks, a file each.
    """
    rows = matches.withColumn("bucket", match_bucket(buckets))
    rows.hint("rebalance", F.col("bucket")).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("bucket").parquet(folder)


def match_bucket(buckets: int = 64):
    return F.pmod(F.xxhash64("job_id", "profile_id"), F.lit(buckets)).cast("int")


def touched_buckets(stored: DataFrame, scope: DataFrame, buckets: int = 64) -> DataFrame:
    """Stored rows of all buckets that a scope of pairs touches."""
    wanted = scope.select(match_bucket(buckets).alias("bucket")).distinct()
    return stored.join(wanted, "bucket", "left_semi")


def read_table(spark: SparkSession, folder: str, name: str, schema: str | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{folder}/{name}")
