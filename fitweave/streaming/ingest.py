"""Arriving pages go through extraction and the job upsert.

The job table is a log: each micro-batch writes the new state of the jobs it touched under its batch id.
A batch looks its imports up in the narrow key columns of the log and reads whole rows only of the jobs
that they meet.  A replayed batch sees only earlier batches and overwrites its own rows, so the result
does not depend on retries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fitweave.operators.ingest import find_duplicates, ingest_jobs
from fitweave.plans.extraction import import_pages
from fitweave.session import materialize
from fitweave.streaming import log

JOB_SCHEMA = (
    "job_id string, title string, content string, content_hash string, source_url string, source_type string, "
    "retrieval_method string, company string, source_portal string, location string, work_model string, "
    "employment_type string, contract_term string, language string, "
    "requirements array<struct<requirement:string,category:string,priority:string,keywords:array<string>,"
    "normalized_value:string,confidence:double,evidence:string>>, "
    "activities array<struct<activity:string,category:string,keywords:array<string>,confidence:double,evidence:string>>"
)
INDEX = ["job_id", "content_hash", "source_url", "batch"]


def current_jobs(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """Newest row per job, optionally as of an earlier batch."""
    return log.newest(log.log_rows(spark, JOB_SCHEMA, f"{folder}/jobs", before), ["job_id"])


def met_jobs(extracted: DataFrame, rows: DataFrame) -> DataFrame:
    """Newest whole rows of the jobs that an import meets; all other jobs are seen by their keys only."""
    index = log.newest(rows.select(*INDEX), ["job_id"]).withColumn("imported_at", F.col("batch"))
    met = find_duplicates(extracted.select("import_id", "content_hash", "source_url"), index)
    wanted = index.join(met.select(F.col("existing_id").alias("job_id")).distinct(), "job_id", "left_semi")
    return rows.join(wanted.select("job_id", "batch"), ["job_id", "batch"], "left_semi")


def ingest_batch(pages: DataFrame, batch_id: int, folder: str) -> None:
    """One micro-batch of pages into the job log."""
    rows = log.log_rows(pages.sparkSession, JOB_SCHEMA, f"{folder}/jobs", batch_id)
    # the lookup and the upsert both read the extracted pages
    extracted = materialize(import_pages(pages).drop("job_id"), "extracted-pages")
    stored = met_jobs(extracted, rows).withColumn("imported_at", F.col("batch"))
    _, jobs = ingest_jobs(extracted, stored)
    log.append(jobs.drop("batch"), f"{folder}/jobs", batch_id)


def compact_jobs(spark: SparkSession, folder: str, batch_id: int) -> None:
    log.compact(spark, JOB_SCHEMA, f"{folder}/jobs", ["job_id"], batch_id)


def stream_ingest_jobs(pages: DataFrame, folder: str) -> StreamingQuery:
    def handle(rows: DataFrame, batch_id: int) -> None:
        ingest_batch(rows, batch_id, folder)

    return (
        pages.writeStream.foreachBatch(handle).option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True).start()
    )
