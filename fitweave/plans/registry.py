"""Registry of queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from fitweave.session import spread


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}
# rows of these tables cost far more CPU than I/O
TEXT_TABLES = {"documents", "pages", "conversations"}


class Tables:
    """Tables of one dataset folder, read on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        frame = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if name in TEXT_TABLES:
            frame = spread(frame)
        self.__dict__[name] = frame
        return frame


def query(name: str, sql: str | None = None):
    """Register ``fn(tables)`` under a name, with SQL that must give the same rows."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = Query(name, lambda spark, folder: fn(Tables(spark, folder)), sql)
        return fn

    return register
