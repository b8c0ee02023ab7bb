"""Streaming jobs run over the tables as file streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from fitweave.plans import bindings as B
from fitweave.plans.history import APPS, EVENTS, STATE_OUT, _shown_state, state_sql
from fitweave.plans.registry import Tables, query
from fitweave.session import scratch_path
from fitweave.streaming import applications, ingest


class _Stream:
    """Lets a table binding read a stream."""

    def __init__(self, events):
        self.events = events


def file_stream(t: Tables, name: str):
    return (
        t.spark.readStream.schema(getattr(t, name).schema).option("pathGlobFilter", f"{name}.parquet").parquet(t.folder)
    )


@query("t2_stream_application_state", f"{EVENTS}, {APPS}, {state_sql('app_events')} {STATE_OUT}")
def t2(t: Tables):
    folder = scratch_path(t.spark, "application-stream")
    events = B.application_events(_Stream(file_stream(t, "events")))
    applications.stream_application_state(events, folder).awaitTermination()
    return _shown_state(applications.read_state(t.spark, folder, B.application_events(t)))


@query("t1_stream_ingest_jobs")
def t1(t: Tables):
    folder = scratch_path(t.spark, "ingest-stream")
    ingest.stream_ingest_jobs(file_stream(t, "pages"), folder).awaitTermination()
    return ingest.current_jobs(t.spark, folder).select(
        "job_id", "title", "source_url", "language", F.length("content").alias("content_length")
    )
