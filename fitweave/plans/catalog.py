"""All registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fitweave.plans import corpus, cv, history, ingest, matching, pages, profile, relations, scoring, streams, target  # noqa: F401  (registration)
from fitweave.plans.registry import QUERIES, Tables

__all__ = ["QUERIES", "flagship"]


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return matching.m1_fit(Tables(spark, folder))
