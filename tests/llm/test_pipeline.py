from __future__ import annotations

import re

from rows import edges, prose

import corpus_pipeline
from fitweave.llm import crf, packing
from fitweave.llm.common import documents, materialize
from test_exact_dedup import expected as equal_texts
from test_simhash import near_rule


def test_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "decontamination", "packing"]


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_each_stage_against_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    docs = documents(spark, folder)
    stages = dict(corpus_pipeline.STAGES)
    columns = docs.columns

    def step(name):
        nonlocal docs
        before, docs = docs, materialize(stages[name](spark, docs, folder), "test-stage")
        return before

    before = step("quality")
    scores = crf.score_documents(before, crf.train(before, documents(spark, folder, "labels")))
    assert docs.columns == columns and ids(docs) == {r["doc_id"] for r in scores.collect() if r["score"] >= 0.3}
    before = step("exact_dedup")
    kept = {i for i, keep, _ in equal_texts([(r["doc_id"], r["text"]) for r in before.collect()]) if i == keep}
    assert docs.columns == columns and ids(docs) == kept and docs.count() == len(kept)
    before = step("near_dedup")
    roots = near_rule({r["doc_id"]: r["text"] for r in before.collect()})
    assert docs.columns == columns and ids(docs) == {i for i, root in roots.items() if i == root}
    before = step("decontamination")
    normal = lambda t: re.sub(r"[\W_]+", " ", t.lower()).strip()
    items = [normal(r["text"]) for r in documents(spark, folder, "benchmark").collect()]
    leaked = {r["doc_id"] for r in before.collect() if any(x in normal(r["text"]) for x in items)}
    assert docs.columns == columns and ids(docs) == ids(before) - leaked
    before = step("packing")
    assert ids(docs) == ids(before)
    assert docs.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= packing.CAPACITY
    whole = corpus_pipeline.run(spark, folder)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, whole.select(key).collect())) == sorted(map(tuple, docs.select(key).collect()))


def test_odd_rows(spark):
    """Nulls in every column, empty and very long texts, ties and repeated rows, through all stages."""
    out = edges(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, out = out, materialize(stage(spark, out, "/root/testdata/sf0.001"), "test-stage")
        assert out.columns == before.columns and ids(out) <= ids(before), name
    kept = [r["doc_id"] for r in out.collect()]
    assert len(kept) == len(set(kept)) and not {5, 9} & set(kept)
    packed = corpus_pipeline.STAGES[-1][1](spark, out, "/root/testdata/sf0.001")
    assert ids(packed) == set(kept)


def test_extra_columns_and_empty_table(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.createDataFrame([(n, prose(n, 40), "en", None, 1, 0.5, "k") for n in range(20)], "doc_id long, text string, lang string, source string, n_chars long, score double, length string")
    for table in (docs, docs.limit(0)):
        out = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, out, folder)
            assert out.columns == docs.columns
            out = materialize(out, "test-stage")
        assert corpus_pipeline.STAGES[-1][1](spark, out, folder).count() >= out.count()
