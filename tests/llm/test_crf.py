from __future__ import annotations

import itertools

import numpy as np
import pytest
from rows import edges, nothing, prose

from fitweave.llm import crf
from fitweave.llm.common import documents
from fitweave.llm.queries import op7_quality


def test_forward_backward_is_the_sum_over_all_labellings():
    rng = np.random.default_rng(5)
    lengths = np.array([6, 4, 4, 1])
    evidence = np.where(np.arange(6) < lengths[:, None], rng.normal(size=(4, 6)), 0)
    links = rng.normal(size=(2, 2))
    good, pairs = crf.forward_backward(evidence, lengths, links)
    for d, n in enumerate(lengths):
        total, one, two = 0.0, np.zeros(n), np.zeros((max(0, n - 1), 2, 2))
        for labels in itertools.product((0, 1), repeat=int(n)):
            weight = np.exp(sum(evidence[d, t] * y for t, y in enumerate(labels)) + sum(links[a, b] for a, b in itertools.pairwise(labels)))
            total += weight
            one += weight * np.array(labels)
            for t, (a, b) in enumerate(itertools.pairwise(labels)):
                two[t, a, b] += weight
        assert np.allclose(good[d, :n], one / total)
        assert np.allclose(pairs[d, : n - 1], two / total)


def test_chains_in_groups_give_the_same():
    rng = np.random.default_rng(7)
    lengths = rng.integers(1, 30, 50)
    field = crf.Field(rng.normal(size=crf.WEIGHTS) * 0.1, 0.2, rng.normal(size=(2, 2)))
    columns = rng.integers(0, crf.WEIGHTS, (lengths.sum(), 5))
    whole = crf.marginals(field, columns, lengths)
    at = 0
    for n in lengths:
        assert np.allclose(whole[at : at + n], crf.marginals(field, columns[at : at + n], np.array([n])))
        at += n


def test_neighbours_do_not_cross_documents():
    levels = np.arange(4)[:, None] * np.ones((1, crf.VALUES), int)
    columns = crf.neighbour_columns(levels.astype(np.uint8), np.array([True, False, True, False]))
    nobody = 3 * crf.VALUES * crf.LEVELS
    assert (columns[[0, 2], crf.VALUES : 2 * crf.VALUES] == nobody).all()
    assert (columns[[1, 3], 2 * crf.VALUES :] == nobody).all()
    assert (columns[1, crf.VALUES : 2 * crf.VALUES] == columns[0, : crf.VALUES] + crf.VALUES * crf.LEVELS).all()


def junk(seed):
    return "\n".join([prose(seed, 12), *(" | ".join(prose(seed * 50 + n, 6).split()) for n in range(5)), prose(seed + 1, 9)])


def labelled(spark, n=240):
    docs = [(i, junk(i) if i % 3 == 0 else "\n".join(prose(i * 9 + k, 15) for k in range(6)), "en", None, None, None, "x", None) for i in range(n)]
    docs = spark.createDataFrame(docs, edges(spark).schema)
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(n)] + [(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_held_out_accuracy_and_edges(spark):
    docs, labels = labelled(spark)
    field = crf.train(docs, labels)
    scores = {r["doc_id"]: r["score"] for r in crf.score_documents(docs, field).collect()}
    assert all((s >= 0.3) == (i % 3 != 0) for i, s in scores.items())
    rows = crf.score_documents(edges(spark), field).collect()
    assert len(rows) == edges(spark).count() and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (1, 2)}) == 1
    assert crf.score_documents(nothing(spark), field).collect() == []
    kept = crf.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i in range(240) if i % 3}


@pytest.mark.parametrize(("labels", "score"), [([], 0.5), ([(1, 1, 0), (2, 1, 0), (3, 1, 0)], 1.0)])
def test_labels_of_one_kind(spark, labels, score):
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = edges(spark)
    assert {r["score"] for r in crf.score_documents(docs, crf.train(docs, table)).collect()} == {score}


def test_scores_do_not_depend_on_batches(spark):
    docs, labels = labelled(spark)
    field = crf.train(docs, labels)
    texts = [r["text"] for r in docs.collect()] + ["", None, "x\n" * 3000]
    together = crf.document_scores(field, texts)
    assert np.allclose(together, [crf.document_scores(field, [t])[0] for t in texts])


def test_long_documents_are_trained_on_lines_with_their_neighbours():
    for n in (1, 63, 64, 65, 66, 200, 5001):
        picked, runs = crf.sample_runs(n, 64)
        assert len(picked) == sum(runs) == len(set(picked.tolist())) == min(n, 64)
        assert picked[0] == 0 and picked[-1] == n - 1
        at = 0
        for length in runs:
            assert (np.diff(picked[at : at + length]) == 1).all()
            at += length


def seen_by_fit(monkeypatch, docs, labels):
    seen = {}
    monkeypatch.setattr(crf, "fit", lambda columns, *_: seen.setdefault("columns", columns))
    crf.train(docs, labels)
    return seen["columns"]


def test_features_of_long_documents_come_from_all_lines(spark, monkeypatch):
    text = "\n".join(("x " if n % 2 else "1 ") * (n % 5 + 1) for n in range(203))
    chosen = next(i for i in range(100) if not spark.range(i, i + 1).select(crf.held_out("id")).first()[0])
    docs = spark.createDataFrame([(chosen, text)], "doc_id long, text string")
    labels = spark.createDataFrame([(chosen, 1, 0)], "doc_id long, quality int, toxic int")
    levels, _ = crf.line_levels(text)
    whole = crf.neighbour_columns(levels, np.arange(203) == 0)
    assert (seen_by_fit(monkeypatch, docs, labels) == whole[crf.sample_runs(203, crf.SAMPLE_LINES)[0]]).all()


def test_a_repeated_id_reaches_the_driver_once(spark):
    docs, labels = labelled(spark, 40)
    one = crf.train(docs, labels)
    asked = []
    reduce = crf.one_per_id
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(crf, "one_per_id", lambda rows: asked.append(reduce(rows)) or asked[-1])
        again = crf.train(docs.unionByName(docs).unionByName(docs), labels)
    rows = asked[0].collect()
    assert len(rows) == len({r["id"] for r in rows}) > 20
    assert np.allclose(one.weights, again.weights) and np.isclose(one.slope, again.slope)


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    rows = op7_quality(spark, folder).collect()
    quality = {r["doc_id"]: r["quality"] for r in documents(spark, folder, "labels").collect()}
    held = [(r["predicted"], quality[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in quality]
    assert len(held) > 50
    assert sum(a == b for a, b in held) / len(held) > 0.95
