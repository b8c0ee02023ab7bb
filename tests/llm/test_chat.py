from __future__ import annotations

import random

from fitweave.llm import chat
from fitweave.llm.common import documents

SCHEMA = "conv_id long, turn long, role string, text string, place long, conv long, n long, h1 string"


def turns(spark, rows):
    return spark.createDataFrame([(*r, 0, 0, 0, "x") for r in rows], SCHEMA)


def expected(rows):
    talks = {}
    for conv, turn, role, text in rows:
        talks.setdefault(conv, []).append((turn is not None, turn or 0, role or "user", text or ""))
    talks = {c: [(r, x) for _, _, r, x in sorted(t)] for c, t in talks.items()}
    order = lambda c: (c is not None, c or 0)
    out = {}
    for conv, talk in talks.items():
        if any(len(t) > len(talk) and t[: len(talk)] == talk for t in talks.values()):
            continue
        if any(t == talk and order(c) < order(conv) for c, t in talks.items()):
            continue
        out[conv] = "".join(f"<|{r}|>\n{x}\n" for r, x in talk)
    return out


def found(df):
    return {r["conv_id"]: r["text"] for r in chat.format_chats(df).collect()}


def test_snapshots_of_random_talks(spark):
    rng, rows, conv = random.Random(2), [], 0
    for _ in range(40):
        talk = [(rng.choice(("user", "assistant")), rng.choice("abc")) for _ in range(rng.randrange(1, 7))]
        for end in rng.sample(range(1, len(talk) + 1), rng.randrange(1, len(talk) + 1)):
            rows += [(conv, n * rng.choice((1, 3)) if n else 0, *t) for n, t in enumerate(talk[:end])]
            conv += 1
    rng.shuffle(rows)
    assert found(turns(spark, rows)) == expected(rows)


def test_buckets_do_not_show(spark):
    rows = [(c, n, "user", f"{n}") for c, most in ((1, 90), (2, 40), (3, 41)) for n in range(most)] + [(3, 41, "user", "other")]
    df = turns(spark, rows)
    whole = {(r["conv"], r["place"]): (r["h1"], r["h2"]) for r in chat.rolled(df).collect()}
    assert whole == {(r["conv"], r["place"]): (r["h1"], r["h2"]) for r in chat.rolled(df, bucket=7).collect()}
    assert whole[1, 40] == whole[2, 40] and whole[1, 41] == whole[3, 41] != whole[3, 42]
    assert set(found(df)) == {1, 3}


def test_edges(spark):
    rows = [
        (1, 0, None, None), (2, 0, "user", ""), (3, 0, "user", ""), (3, 1, "assistant", "x"), (None, 0, "user", "y"), (None, None, "user", "z"),
        (4, 5, "user", "same"), (5, 9, "user", "same"), (6, 0, "user", "a"), (6, 0, "user", "a"), (7, 0, "user", "a"),
    ]
    assert found(turns(spark, rows)) == expected(rows)
    assert found(turns(spark, [])) == {}


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in documents(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert found(documents(spark, sf, "conversations")) == expected(rows)
