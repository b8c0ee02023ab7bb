"""Small tables with the cases that every operator must take."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, shard string, `_k1` string"
WORDS = "river stone under bright lamp gentle forest morning paper silver window garden follow little thunder apple".split()


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    out = [rng.choice(WORDS) + (str(rng.randrange(40)) if rng.random() < 0.5 else "") for _ in range(words)]
    return " ".join(out).capitalize() + "."


def edge_rows() -> list[tuple]:
    """Nulls in every column, empty and very long texts, ties, repeated rows, other white space."""
    long_text = "\n".join(prose(n, 60) for n in range(400))
    texts = [
        (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one"), (5, "one"), (6, "one  two\tthree"), (7, "one two three"),
        (8, long_text), (9, long_text), (10, prose(1, 80)), (None, prose(1, 80)), (None, None), (11, "é" * 50), (12, "\U0001f600 ok"),
    ]
    return [(i, t, None if n % 3 else "en", None if n % 2 else "src0", None if t is None else len(t), None, "x", None) for n, (i, t) in enumerate(texts)]


def frame(spark, texts):
    """Documents from (id, text) pairs."""
    return spark.createDataFrame(list(texts), "doc_id long, text string")


def edges(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def collect(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)
