"""Tables that streams keep as a log of rows by micro-batch.

A batch writes the new rows of the keys it touched under its own id, so a replay overwrites itself, and
readers take the newest row of each key.  ``compact`` writes the newest rows of all keys up to a batch
once more; from then on readers start there and Spark skips the older folders.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fitweave.operators.ranking import keep_one


def append(rows: DataFrame, folder: str, batch_id: int) -> None:
    _write(rows, f"{folder}/log", batch_id)


def _write(rows: DataFrame, path: str, batch_id: int) -> None:
    (
        rows.withColumn("batch", F.lit(batch_id).cast("long"))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)
    )


def _read(spark: SparkSession, schema: str, path: str) -> DataFrame:
    try:
        return spark.read.schema(f"{schema}, batch long").parquet(path)
    except AnalysisException:  # not written yet
        return spark.createDataFrame([], f"{schema}, batch long")


def log_rows(spark: SparkSession, schema: str, folder: str, before: int | None = None) -> DataFrame:
    """All rows that may be the newest of their key, of batches before ``before`` if given."""
    base, log = (_read(spark, schema, f"{folder}/{part}") for part in ("compacted", "log"))
    if before is not None:
        base, log = base.where(F.col("batch") < before), log.where(F.col("batch") < before)
    start = base.agg(F.max("batch")).first()[0]  # of folder names; one number
    if start is None:
        return log
    return base.where(F.col("batch") == start).unionByName(log.where(F.col("batch") > start))


def newest(rows: DataFrame, key: list[str]) -> DataFrame:
    return keep_one(rows, key, [F.col("batch")], last=True)


def compact(spark: SparkSession, schema: str, folder: str, key: list[str], batch_id: int) -> None:
    """Newest rows of all keys up to and with ``batch_id``, as the new start of the log."""
    _write(newest(log_rows(spark, schema, folder, batch_id + 1), key).drop("batch"), f"{folder}/compacted", batch_id)
