"""Headline queries on one dataset; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fitweave.plans import catalog  # noqa: E402
from fitweave.session import SPREAD, build_session  # noqa: E402

HEADLINES = [
    "a01_qualification_fit",
    "a02_match_level_summary",
    "h1_rebuild_application_state",
    "w1_keep_latest_review",
    "w8_revision_numbers",
    "j06_duplicate_lookup",
    "m1_evaluate_matching",
    "m1_document_fit",
    "m2_stored_matching_report",
    "a04_target_fit",
    "p01_clean_pages",
    "p05_assess_quality",
    "p07_extracted_text_sufficient",
    "x01_detect_language",
    "x_extract_metadata",
    "x18_requirements",
    "x22_seniority",
    "g1_ingest_jobs",
    "u1_profile_evidence_union",
    "c1_cv_to_suggestions",
    "c3_match_and_conflict",
    "d1_dashboard",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = sys.argv[1:] or HEADLINES
    scratch = tempfile.TemporaryDirectory(prefix="fitweave-", ignore_cleanup_errors=True)
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.checkpoint.dir": scratch.name, "spark.sql.shuffle.partitions": cpus, SPREAD: cpus, "spark.driver.memory": "20g", "spark.ui.enabled": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in chosen:
        started = time.time()
        catalog.QUERIES[name].build(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - started, 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()
    scratch.cleanup()


if __name__ == "__main__":
    main()
