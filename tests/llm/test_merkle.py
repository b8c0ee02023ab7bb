from __future__ import annotations

import hashlib
import os
import sys

import pytest
from rows import edges, nothing

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

from check import bag, connect  # noqa: E402

from fitweave.llm import merkle, queries  # noqa: E402
from fitweave.llm.common import materialize  # noqa: E402

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def H(value):
    return hashlib.sha256(value.encode()).hexdigest()


def leaf(row):
    parts = []
    for c in merkle.LEAF_COLUMNS:
        v = None if row[c] is None else str(row[c])
        parts.append("-" if v is None else f"{len(v.encode())}:{v}")
    return H("".join(parts))


def tree(digests):
    """Root and, per leaf, its siblings level by level."""
    proofs = [[] for _ in digests]
    below = [[n] for n in range(len(digests))]
    while len(digests) > 1:
        above, joined = [], []
        for at in range(0, len(digests), 16):
            run = digests[at : at + 16]
            for n, leaves in enumerate(below[at : at + 16]):
                for x in leaves:
                    proofs[x].append("".join(run[:n] + run[n + 1 :]))
            above.append(H("".join(run)))
            joined.append([x for leaves in below[at : at + 16] for x in leaves])
        digests, below = above, joined
    return digests[0], proofs


def expected(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append((r["doc_id"], leaf(r)))
    keys = sorted(groups, key=lambda s: b"" if s is None else b"=" + s.encode())
    trees = {}
    for key in keys:
        groups[key].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[key] = tree([d for _, d in groups[key]])
    root, tops = tree([trees[k][0] for k in keys])
    out = []
    for key, top in zip(keys, tops, strict=True):
        for (doc_id, digest), proof in zip(groups[key], trees[key][1], strict=True):
            out.append((doc_id, digest, trees[key][0], root, H("".join(proof + top))))
    return sorted(out, key=repr)


def found(docs):
    rows = merkle.manifest(docs, held=merkle.leaf_digest()).withColumn("proof", merkle.proof_digest(merkle.F.col("steps")))
    rows = rows.withColumn("folded", merkle.fold(merkle.F.col("held"), merkle.F.col("steps"))).collect()
    assert all(r["folded"] == r["root"] for r in rows)
    return sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof"]) for r in rows), key=repr)


@pytest.mark.parametrize("sizes", [[1], [16], [17], [1, 1], [300, 1, 16, 33], [1] * 40, [257, 2]])
def test_shapes(spark, sizes):
    rows = [(s * 1000 + n, None if s == 1 else f"src{s}", "en", n, f"text {n}") for s, k in enumerate(sizes) for n in range(k)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert found(docs) == expected(docs.collect())


def test_a_tall_tree(spark):
    docs = spark.range(70_000).selectExpr("id AS doc_id", "if(id % 7 = 0, concat('s', id % 5), 'hot') AS source", "'x' AS lang", "id AS n_chars", "cast(id AS string) AS text")
    docs = materialize(docs, "tall")
    assert found(docs) == expected(docs.collect())


def test_edges(spark):
    docs = edges(spark)
    assert found(docs) == expected(docs.collect())
    assert merkle.manifest(nothing(spark), held=merkle.leaf_digest()).collect() == []
    odd = docs.withColumnsRenamed({"score": "rank", "shard": "key"}).selectExpr("*", "1 AS digest", "2 AS members", "3 AS steps", "4 AS _row")
    assert found(odd) == expected(docs.collect())


def test_ancestors_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BROADCAST_NODES", 0)
    docs = spark.createDataFrame([(n, f"s{n % 3}", "en", 1, "t") for n in range(1500)], SCHEMA)
    assert found(docs) == expected(docs.collect())


def test_tampered_rows_do_not_verify(spark, tmp_path):
    docs = spark.createDataFrame([(n, "a", None, n, ("Text" if n % 2 else "text") if n % 3 else None) for n in range(400)], SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op13_merkle(spark, str(tmp_path))
    verified = {r["doc_id"]: r["verified"] for r in rows.collect()}
    import zlib

    for n, good in verified.items():
        assert good == (not (zlib.crc32(str(n).encode()) % 5 == 0 and n % 2 == 1 and n % 3 != 0))


def test_edges_against_sql(spark, sf, tmp_path):
    docs = edges(spark).select(*merkle.LEAF_COLUMNS)
    docs.coalesce(1).write.parquet(f"{tmp_path}/out")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = connect(sf)
    con.execute(f"create or replace view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    frame = queries.op13_merkle(spark, str(tmp_path))
    cursor = con.execute(queries.ORACLE_SQL["op13_merkle"])
    names = [d[0] for d in cursor.description]
    assert bag(frame.columns, [tuple(r) for r in frame.collect()]) == bag(names, cursor.fetchall())
