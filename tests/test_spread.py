"""Costly work per row is dealt over tasks, and extracted once."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fitweave import session
from fitweave.operators import structure as X
from fitweave.plans import bindings as B
from fitweave.plans import pages
from fitweave.plans.registry import Tables


@pytest.fixture
def unset(spark, monkeypatch):
    """As on a cluster: no number of tasks is set, and tasks are small so that the small tables need several."""
    kept = spark.conf.get(session.SPREAD)
    spark.conf.unset(session.SPREAD)
    monkeypatch.setattr(session, "TASK_ROWS", 20)
    yield
    spark.conf.set(session.SPREAD, kept)


def test_ads_of_one_file_are_rendered_in_many_tasks(spark, sf, unset):
    parts = spark.read.parquet(f"{sf}/part.parquet")
    ads = B.ads(Tables(spark, sf))
    assert ads.rdd.getNumPartitions() == -(-parts.count() // 20) > 1
    assert ads.count() == parts.count()


def test_markdown_forms_of_one_file_are_read_in_many_tasks(spark, sf, unset):
    assert pages.p01_forms(Tables(spark, sf)).rdd.getNumPartitions() > 1


def test_extracted_arrays_are_not_extracted_again_for_a_filter(spark, sf):
    jobs = X.with_structure(B.ads(Tables(spark, sf)).select("job_id", "content"))
    for rows in (X.requirement_rows(jobs), X.activity_rows(jobs), X.benefit_rows(jobs)):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("split(") == 1


def test_rows_of_empty_and_missing_arrays(spark):
    schema = "job_id int, benefits array<struct<benefit: string>>"
    jobs = spark.createDataFrame([(1, [("a",), ("b",)]), (2, []), (3, None), (4, [("c",)])], schema)
    rows = X.benefit_rows(jobs).orderBy("job_id", "position")
    assert [tuple(r) for r in rows.collect()] == [(1, 0, "a"), (1, 1, "b"), (4, 0, "c")]
    assert rows.where(F.col("position").isNull()).isEmpty()


def test_a_bucket_of_matches_is_written_by_several_tasks(spark, tmp_path):
    from fitweave.sources.tables import write_matches

    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    kept = spark.conf.get(size)
    spark.conf.set(size, "64k")
    try:
        matches = spark.range(0, 60_000, 1, 8).select(
            F.col("id").alias("job_id"), F.lit("p").alias("profile_id"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
        write_matches(matches, str(tmp_path / "matches"), buckets=2)
    finally:
        spark.conf.set(size, kept)
    assert all(len(list((tmp_path / "matches" / f"bucket={n}").glob("*.parquet"))) > 1 for n in range(2))
    assert spark.read.parquet(str(tmp_path / "matches")).select("job_id").distinct().count() == 60_000
