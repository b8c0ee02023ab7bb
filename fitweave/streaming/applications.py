"""Arriving application events keep the state table current.

State depends on at most nine events of an application (``history.pivotal_events``), whatever the length
of its history.  These live in the state store, keyed by application: a micro-batch loads and writes the
pivots of the applications it touches, and of no others.  Which places an event competes for is decided by
Spark expressions and travels as a bit mask; the Python side only keeps the first or last event of a place.
Events are thinned out per task before they are shuffled, so an application that holds a third of a batch
arrives as a few rows per task.  There is no watermark: a late event gives the same state as if it had
arrived in order, and a replayed event changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType, TimestampType

from fitweave.operators import history
from fitweave.streaming import log

KEY = ["application_id"]
PLACES = "places"
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# applications that a task holds before it passes their pivots on
HELD = 20_000


def _state_schema(events: DataFrame) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    times = ("status_changed_at", "applied_at")
    return f"application_id {kinds['application_id']}, " + ", ".join(
        f"{name} {kinds['occurred_at'] if name in times else 'string'}" for name in history.STATE_COLUMNS
    )


class Pivots:
    """The first or last event of every place; events are tuples in the order of ``history.EVENT_COLUMNS``."""

    def __init__(self, firsts: int):
        self.firsts = firsts
        self.best: dict[int, tuple] = {}  # place -> (rank, event)

    def add(self, event: tuple, places: int) -> None:
        rank = tuple((value is not None, value) for value in event)  # nulls first, as Spark orders structs
        place = 0
        while places:
            if places & 1:
                old = self.best.get(place)
                if old is None or (rank < old[0] if place < self.firsts else rank > old[0]):
                    self.best[place] = (rank, event)
            places >>= 1
            place += 1

    def rows(self) -> list[tuple]:
        """Every kept event once, with the places it holds."""
        held: dict[tuple, int] = {}
        for place, (_, event) in self.best.items():
            held[event] = held.get(event, 0) | 1 << place
        return [(*event, places) for event, places in held.items()]


def _thinned(firsts: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[object, Pivots] = {}
        schema = None

        def flush() -> pa.RecordBatch:
            rows = [(key, *row) for key, pivots in held.items() for row in pivots.rows()]
            held.clear()
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            schema = batch.schema
            for key, *event, places in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                held.setdefault(key, Pivots(firsts)).add(tuple(event), places)
            if len(held) >= HELD:
                yield flush()
        if held:
            yield flush()

    return run


class PivotStore(StatefulProcessor):
    """Keeps the pivots of an application and hands out the new ones of each that a batch touches."""

    def __init__(self, firsts: int, kept: StructType):
        self.firsts = firsts
        self.kept = kept

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getListState("pivots", self.kept)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        pivots = Pivots(self.firsts)
        for stored in self.state.get():
            pivots.add(tuple(stored)[:-1], stored[-1])
        for row in rows:
            pivots.add(tuple(row)[1:-1], row[-1])
        kept = pivots.rows()
        self.state.put(kept)
        named = Row(*KEY, *self.kept.names)
        for row in kept:
            yield named(*key, *row)

    def close(self) -> None:
        pass


def _timestamps(events: DataFrame) -> list[str]:
    return [f.name for f in events.schema if isinstance(f.dataType, TimestampType) and f.name in history.EVENT_COLUMNS]


def pivot_stream(events: DataFrame) -> DataFrame:
    """application_id and its pivots for every application that a micro-batch touches, from the state store.

    Timestamps are kept as microseconds, so that no worker's time zone touches them.
    """
    firsts, lasts = history.pivot_conditions()
    places: Column = F.lit(0)
    for place, condition in enumerate([*firsts, *lasts]):
        places = places + F.when(condition, 1 << place).otherwise(0)
    times = _timestamps(events)
    rows = events.select(*KEY, *history.EVENT_COLUMNS, places.cast("long").alias(PLACES)).withColumns(
        {name: F.unix_micros(name) for name in times}
    )
    thin = rows.mapInArrow(_thinned(len(firsts)), rows.schema)
    kept = StructType([f for f in rows.schema if f.name not in KEY])
    pivots = thin.groupBy(*KEY).transformWithState(PivotStore(len(firsts), kept), rows.schema, "Update", "None")
    return pivots.drop(PLACES).withColumns({name: F.timestamp_micros(name) for name in times})


def write_state(pivots: DataFrame, batch_id: int, folder: str) -> None:
    """States of the applications that a batch touched, from all their pivots, under the batch's id.

    The pivots are written first: reading them twice must not run the state store twice.
    """
    pivots.write.mode("overwrite").parquet(f"{folder}/pivots/batch={batch_id}")
    written = pivots.sparkSession.read.schema(pivots.schema).parquet(f"{folder}/pivots/batch={batch_id}")
    applications = written.groupBy(*KEY).agg(F.min("occurred_at").alias("created_at"))
    log.append(history.rebuild_application_state(written, applications), f"{folder}/state", batch_id)


def stream_application_state(events: DataFrame, folder: str) -> StreamingQuery:
    """Starts the stream over all available input."""
    spark = events.sparkSession
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKSDB)  # keyed state needs it; the stream takes its settings when it starts
    try:
        return (
            pivot_stream(events).writeStream.foreachBatch(lambda rows, batch_id: write_state(rows, batch_id, folder))
            .outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        )
    finally:
        spark.conf.set(STORE, before)


def compact_state(spark: SparkSession, folder: str, events: DataFrame, batch_id: int) -> None:
    """Compacts the states up to a batch that has ended; ``events`` gives the column types."""
    log.compact(spark, _state_schema(events), f"{folder}/state", KEY, batch_id)


def read_state(spark: SparkSession, folder: str, events: DataFrame) -> DataFrame:
    """Newest state of every application; ``events`` gives the column types."""
    return log.newest(log.log_rows(spark, _state_schema(events), f"{folder}/state"), KEY).drop("batch")
