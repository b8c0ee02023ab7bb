"""Skew-safe operators, history folds, imports and CV rules against plain Python."""

from __future__ import annotations

import json
import random
import tempfile

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fitweave.functions import dates
from fitweave.functions import text as T
from fitweave.operators import cv, dashboard, graphs, history, ingest, quality, ranking, reports, reviews, search, skew
from fitweave.operators.skew import balanced_join
from fitweave.plans import bindings as B
from fitweave.plans import extraction
from fitweave.plans.registry import Tables
from fitweave.sources import tables
from fitweave.streaming import applications as stream
from fitweave.session import materialize
from fitweave.streaming import ingest as ingest_stream


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("hot", ["left", "right", "both"])
def test_balanced_join_equals_plain_join(spark, how, hot):
    """Nine tenths of the rows of one side, or of both, under one key."""
    def side(name: str, rows: int, skewed: bool):
        key = F.when(F.col("id") % 10 != 0, 7).otherwise(F.col("id") % 90) if skewed else F.col("id") % 70 + 3
        return spark.range(rows).select(key.alias("k"), F.col("id").alias(name))

    left, right = side("l", 700, hot != "right"), side("r", 400, hot != "left")
    plain = sorted(left.join(right, "k", how).select("k", "l", "r").collect(), key=str)
    for more in ({}, {"spread_right_by": ["r"]}, {"spread_right_by": ["r"], "counted": left.select("k")}):
        ours = balanced_join(left, right, ["k"], ["l"], how=how, share=0.05, **more)
        assert ours.columns == ["k", "l", "r"]
        assert sorted(ours.collect(), key=str) == plain


def test_hot_keys_are_few_and_cut_below_the_share(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id")).alias("k"))
    assert [tuple(r) for r in skew._slices(rows, ["k"], 0.01, "n").collect()] == [(1, 51)]


def test_numbering_and_keep_one_equal_windows(spark):
    rows = spark.range(2000).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 20).alias("k"), (F.col("id") * 7919 % 2003).alias("o"))
    ours = ranking.number_rows(rows, ["k"], [F.col("o")], "n")
    window = Window.partitionBy("k").orderBy("o")
    plain = rows.withColumn("n", F.row_number().over(window).cast("long"))
    assert sorted(ours.select("k", "o", "n").collect()) == sorted(plain.select("k", "o", "n").collect())
    first = ranking.keep_one(rows, ["k"], [F.col("o")])
    assert sorted(first.collect()) == sorted(plain.where("n = 1").select("k", "o").collect())


def test_numbering_of_one_hot_key_stays_spread(spark, monkeypatch):
    """Nine tenths of the rows in one group, in one short stretch of its order."""
    rows = spark.range(20_000).select(
        F.when(F.col("id") % 10 > 0, "hot").when(F.col("id") % 20 == 0, F.lit(None)).otherwise("cold").alias("k"), (F.col("id") * 7919 % 20_011).alias("o"))
    written = []
    ours = ranking.number_rows(rows.repartition(8), ["k"], [F.col("o")], "n")
    plain = rows.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("o")).cast("long"))
    assert sorted(map(tuple, ours.collect()), key=repr) == sorted(map(tuple, plain.select("k", "o", "n").collect()), key=repr)
    monkeypatch.setattr(ranking, "materialize", lambda frame, name: written.append(materialize(frame, name)) or written[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # these rows would fit into one task
    try:
        ranking.number_rows(rows.repartition(8), ["k"], [F.col("o")], "n")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    sizes = [r["count"] for r in written[0].groupBy("_task").count().collect()]
    assert len(sizes) >= 4 and max(sizes) < 20_000 / 2


def test_chunks_of_very_many_children(spark):
    children = spark.range(30_000).select(F.when(F.col("id") < 29_000, "big").otherwise("small").alias("job_id"), (F.col("id") * 7919 % 30_011).alias("place"))
    chunks = reports.detail_chunks(children, ["place"], size=500).collect()
    assert max(len(r["items"]) for r in chunks) == 500 and len(chunks) == 58 + 2
    big = [i["place"] for r in sorted(chunks, key=lambda r: r["chunk"]) if r["job_id"] == "big" for i in r["items"]]
    assert big == sorted(big) and len(big) == 29_000
    assert all(r["first"] == 500 * r["chunk"] + 1 for r in chunks)


def test_batches_of_the_job_sink(spark, tmp_path):
    """Two batches, one that failed before its marker, and a replay."""
    from fitweave.operators import structure

    def jobs(*names):
        rows = [(n, "## Aufgaben\n- Taue spleißen\n- Segel nähen\n## Profil\n- Erfahrung mit Hanf\n") for n in names]
        return structure.with_structure(spark.createDataFrame(rows, "job_id string, content string"))

    def seen(name):
        return sorted(r["job_id"] for r in tables.read_batches(spark, folder, name).select("job_id").distinct().collect())

    folder = str(tmp_path)
    tables.write_jobs(jobs("a", "b"), folder, 0)
    per_job = tables.read_batches(spark, folder, "job_activities").count() // 2
    tables.write_jobs(jobs("c"), folder, 1)
    tables._write_part(jobs("lost"), f"{folder}/jobs", 2)  # no children, no marker
    for name in ("jobs", "job_activities"):
        assert seen(name) == ["a", "b", "c"]
    for _ in range(2):
        tables.write_jobs(jobs("d"), folder, 2)
    assert seen("jobs") == seen("job_activities") == ["a", "b", "c", "d"]
    assert tables.read_batches(spark, folder, "job_activities").count() == 4 * per_job > 0


EVENT = ("event_id int, application_id int, event_type string, status string, occurred_at timestamp_ntz, created_at timestamp_ntz, "
         "channel string, portal_name string, note string")


def _random_events(seed: int, n: int):
    import datetime

    rng = random.Random(seed)
    start = datetime.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        at = start + datetime.timedelta(hours=rng.randrange(200))
        rows.append((i, rng.randrange(12), rng.choice(["created", "status_change", "note", "communication"]),
                     rng.choice([None, "", "draft", "applied", "followed_up", "rejected"]), at, at,
                     rng.choice([None, "email", "job_portal", "phone"]), rng.choice([None, "P1", "P2"]), rng.choice([None, "", "n1", "n2"])))
    rng.shuffle(rows)
    return rows


def _fold(events):
    """The rules one event list at a time."""
    events = sorted(events, key=lambda e: (e[4], e[5], e[0]))
    state = [e for e in events if e[2] in ("created", "status_change") and e[3]]
    notes = next((e[8] for e in reversed(events) if e[8]), None)
    if not state:
        return ("draft", None, None, None, None, None, notes)
    applied = [e for e in state if e[3] == "applied"]
    first = applied or [e for e in state if e[3] == "followed_up"]
    answers = [e for e in reversed(events) if e[3] != "applied"]
    return (
        state[-1][3], first[0][4] if first else None, next((e[6] for e in applied if e[6]), None),
        next((e[7] for e in applied if e[6] == "job_portal" and e[7]), None),
        next((e[6] for e in answers if e[6]), None),
        next((e[7] for e in answers if e[6] == "job_portal"), None), notes,
    )


def test_state_fold_equals_python_for_any_input_order(spark):
    for seed in (1, 2):
        rows = _random_events(seed, 150)
        events = spark.createDataFrame(rows, EVENT)
        state = history.rebuild_application_state(events, B.applications_of(events))
        columns = ["status", "applied_at", "application_channel", "application_portal_name", "response_channel",
                   "response_portal_name", "notes"]
        found = {r["application_id"]: tuple(r[c] for c in columns) for r in state.collect()}
        expected = {a: _fold([e for e in rows if e[1] == a]) for a in {e[1] for e in rows}}
        assert found == expected


def test_batch_leaders_equal_sequential_import(spark):
    rng = random.Random(5)
    rows = [(i, f"h{rng.randrange(25)}", rng.choice([None, "", *[f"u{j}" for j in range(15)]])) for i in range(120)]
    hashes, addresses, expected = set(), set(), []
    for i, h, u in rows:
        if h in hashes or (u and u in addresses):
            continue
        expected.append(i)
        hashes.add(h)
        if u:
            addresses.add(u)
    frame = spark.createDataFrame(rows, "import_id int, content_hash string, source_url string")
    assert sorted(r["import_id"] for r in ingest.batch_leaders(frame).collect()) == expected


def _sequential(rows):
    hashes, addresses, kept = set(), set(), []
    for i, h, u in sorted(rows):
        if h not in hashes and not (u and u in addresses):
            kept.append(i)
            hashes.add(h)
            addresses.add(u)
    return kept


def test_leaders_of_long_chains(spark, monkeypatch):
    """Import n shares its hash with one neighbour and its URL with the other, in order and shuffled."""
    written = []
    monkeypatch.setattr(graphs, "materialize", lambda frame, name: written.append(name) or materialize(frame, name))
    chain = [(n, f"h{n // 2}", f"u{(n + 1) // 2}") for n in range(10_000)]
    places = list(range(10_000))
    random.Random(1).shuffle(places)
    shuffled = [(20_000 + places[n], f"x{n // 2}", f"y{(n + 1) // 2}") for n in range(10_000)]
    frame = spark.createDataFrame(chain + shuffled, "import_id int, content_hash string, source_url string")
    found = sorted(r["import_id"] for r in ingest.batch_leaders(frame).collect())
    assert found == _sequential(chain + shuffled)
    assert written.count("graph-pointers") + ingest.LEADER_ROUNDS <= 20


def test_leaders_by_components_alone(spark):
    rng = random.Random(7)
    rows = [(i, f"h{rng.randrange(60)}" if i % 3 else "hot", rng.choice([None, "", *[f"u{j}" for j in range(90)]])) for i in range(400)]
    frame = spark.createDataFrame(rows, "import_id int, content_hash string, source_url string")
    for rounds in (0, 1):
        assert sorted(r["import_id"] for r in ingest.batch_leaders(frame, rounds=rounds).collect()) == _sequential(rows)
    assert ingest.batch_leaders(frame.limit(0)).collect() == []


def test_stream_state_equals_batch_state(spark, sf):
    t = Tables(spark, sf)
    events = B.application_events(t)
    with tempfile.TemporaryDirectory() as folder:
        # four files in random event order, so late events arrive in later batches
        events.withColumn("r", F.xxhash64("event_id")).repartition(4, "r").drop("r").write.parquet(f"{folder}/in")
        source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        stream.stream_application_state(source, f"{folder}/out").awaitTermination()

        def streamed(at: str):
            return sorted(stream.read_state(spark, at, events).select("application_id", *history.STATE_COLUMNS).collect())

        batch = history.rebuild_application_state(events, B.applications_of(events))
        expected = sorted(batch.select("application_id", *history.STATE_COLUMNS).collect())
        assert streamed(f"{folder}/out") == expected
        kept = spark.read.parquet(f"{folder}/out/pivots").groupBy("batch", "application_id").count()
        assert kept.agg(F.max("count")).first()[0] <= 9


def test_application_state_survives_restarts_late_and_replayed_events(spark, sf):
    """Three runs over one checkpoint, newest events first, the first part delivered again, one compaction."""
    events = B.application_events(Tables(spark, sf)).withColumn("event_id", F.col("event_id").cast("long"))
    half = events.agg(F.expr("percentile_approx(occurred_at, 0.5)")).first()[0]
    parts = [events.where(F.col("occurred_at") > half), events.where(F.col("occurred_at") <= half),
             events.where(F.col("occurred_at") > half)]
    with tempfile.TemporaryDirectory() as folder:
        touched = []
        for number, part in enumerate(parts):
            part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
            source = spark.readStream.schema(events.schema).parquet(f"{folder}/in")
            stream.stream_application_state(source, f"{folder}/out").awaitTermination()
            touched.append(part.select("application_id").distinct().count())
            if number == 1:
                stream.compact_state(spark, f"{folder}/out", events, number)
        columns = ["application_id", *history.STATE_COLUMNS]
        ours = stream.read_state(spark, f"{folder}/out", events).select(*columns)
        expected = history.rebuild_application_state(events, B.applications_of(events)).select(*columns)
        assert sorted(ours.collect()) == sorted(expected.collect())
        # a batch hands out the applications it touched, and no others
        written = spark.read.parquet(f"{folder}/out/pivots").groupBy("batch").agg(F.countDistinct("application_id").alias("n"))
        assert [r["n"] for r in written.orderBy("batch").collect()] == touched


def test_pivots_of_one_long_history_pass_as_few_rows():
    """A task hands on at most nine events of an application, nulls and repeated events included."""
    import pyarrow as pa

    rows = [(7, at % 501 or None, at, at % 77, "note", None, None, None, "x" * (at % 2), 1 | 256 * (at % 2)) for at in range(5000)] * 2
    names = ["application_id", *history.EVENT_COLUMNS, stream.PLACES]
    batch = pa.RecordBatch.from_pylist([dict(zip(names, row, strict=True)) for row in rows])
    out = [row for part in stream._thinned(5)([batch, batch]) for row in part.to_pylist()]
    first = min(rows, key=lambda r: tuple((v is not None, v) for v in r[1:-1]))
    last = max((r for r in rows if r[-1] & 256), key=lambda r: tuple((v is not None, v) for v in r[1:-1]))
    assert len(out) == 2 and {tuple(r.values())[:-1] for r in out} == {first[:-1], last[:-1]}
    assert sorted(r[stream.PLACES] for r in out) == [1, 256]


def test_stream_of_pages_meets_jobs_of_earlier_batches(spark):
    def page(title: str) -> str:
        text = " ".join(f"{title} Anforderungen und Aufgaben Nummer {n}." for n in range(40))
        return f"<html><body><article><h1>{title}</h1><p>{text}</p></article></body></html>"

    batches = [
        [(1, "https://a.invalid/1", page("Weber")), (2, "https://a.invalid/2", page("Färber"))],
        [(3, "https://b.invalid/9", page("Weber")), (4, "https://a.invalid/2", page("Färber neu")), (5, "https://a.invalid/5", page("Müller"))],
        [(6, "https://a.invalid/5", page("Müller")), (7, "https://c.invalid/1", page("Bäcker"))],
    ]
    with tempfile.TemporaryDirectory() as folder:
        for number, rows in enumerate(batches):
            for _ in range(1 + (number == 1)):  # one batch is replayed
                ingest_stream.ingest_batch(spark.createDataFrame(rows, "page_id bigint, url string, html string"), number, folder)
            if number == 1:
                ingest_stream.compact_jobs(spark, folder, number)
        jobs = ingest_stream.current_jobs(spark, folder)
        assert sorted(r["title"] for r in jobs.collect()) == ["Bäcker", "Färber", "Müller", "Weber"]


def test_search_table_equals_single_searches(spark):
    """Substrings across words, accents, single signs, missing entries, empty searches and a hot entry."""
    rng = random.Random(5)
    words = ["Straße", "Köln", "data", "Data-Engineer", "ab", "c", "Zürich", "engine", "\u00e9t\u00e9"]
    jobs = [(n, " ".join(["remote", *rng.choices(words, k=n % 6)]), None if n % 4 else rng.choice(words)) for n in range(300)]
    jobs.append((900, None, None))
    searches = ["remote", "straße", "zurich DATA", "c", "a-e", "e e", "engine  köl", "xyz", "", None, "  ", "ete", "data zzz q", "gineer"]
    frame = spark.createDataFrame(jobs, "job_id int, title string, company string")
    table = spark.createDataFrame(list(enumerate(searches)), "search_id int, terms string")
    ours = sorted((r[0], r[1]) for r in search.search_many(frame, table, ["title", "company"]).collect())
    alone = [(n, r["job_id"]) for n, terms in enumerate(searches)
             for r in dashboard.keyword_search(frame, terms or "", ["title", "company"]).select("job_id").collect()]
    assert ours == sorted(alone)
    assert search.search_many(frame, table.limit(0), ["title"]).collect() == []
    assert search.search_many(frame.limit(0), table, ["title"]).collect() == []


def test_reposted_ads_meet_in_any_typography(spark):
    rows = [(5, 2, "Köln: Data-Engineer (m/w/d)"), (6, 1, "KOLN  data engineer M W D!"), (7, 3, "köln dataengineer m w d"),
            (8, 1, "..."), (9, 1, "-"), (10, 1, None), (11, 9, "Straße"), (12, 8, "STRASSE")]
    jobs = spark.createDataFrame(rows, "job_id int, imported_at int, content string")
    assert {tuple(r) for r in ingest.reposted_jobs(jobs).collect()} == {
        (5, 6, 2), (6, 6, 2), (7, 7, 1), (8, 8, 1), (9, 9, 1), (10, 10, 1), (11, 12, 2), (12, 12, 2)}


def test_reimport_extracts_changed_texts_and_rules_only(spark, sf):
    ads = B.ads(Tables(spark, sf)).select("job_id", "content", "source_filename", "source_url").limit(30)
    twice = materialize(ads.unionByName(ads.withColumn("job_id", F.col("job_id") + 100_000)), "ads-twice")
    fields = ["job_id", "title", "location", "requirements", "activities", "seniority", "role"]
    whole = sorted(extraction.extract_jobs(twice).select(*fields).collect(), key=lambda r: r["job_id"])

    def run(texts, batch: int, version: str):
        rows = extraction.extract_incremental(texts, folder, batch, version)
        parts = spark.read.parquet(f"{folder}/version={version}")
        written = parts.where(F.col("batch") == batch).count()
        return sorted(rows.select(*fields, "fresh").collect(), key=lambda r: r["job_id"]), written

    with tempfile.TemporaryDirectory() as folder:
        first, written = run(twice, 0, "a")
        assert [r[:-1] for r in first] == [tuple(r) for r in whole] and all(r["fresh"] for r in first)
        assert written == ads.select("content", "source_filename", "source_url").distinct().count()
        again, written = run(twice, 1, "a")
        assert [r[:-1] for r in again] == [tuple(r) for r in whole] and not any(r["fresh"] for r in again) and written == 0
        changed = twice.withColumn("content", F.when(F.col("job_id") == 100_000 + whole[0]["job_id"], "# Weber\n\nNeu").otherwise(F.col("content")))
        for _ in range(2):  # the batch is repeated
            third, written = run(changed, 2, "a")
            assert written == 1
        assert [r["title"] for r in third if r["fresh"]] == ["Weber"]
        assert all(r["fresh"] for r in run(twice, 3, "b")[0])


def test_match_scope_is_replaced_per_bucket(spark):
    old = spark.createDataFrame([(1, "p", "gap"), (2, "p", "gap")], "job_id int, profile_id string, match_level string")
    with tempfile.TemporaryDirectory() as folder:
        tables.write_matches(old, f"{folder}/m", buckets=4)
        stored = spark.read.parquet(f"{folder}/m")
        scope = old.where("job_id = 1").select("job_id", "profile_id")
        same_bucket = tables.touched_buckets(stored, scope, 4).drop("bucket")
        from fitweave.operators.matching import replace_scope

        fresh = spark.createDataFrame([(1, "p", "strong_match")], old.schema)
        rows = replace_scope(same_bucket, fresh, scope).collect()
        tables.write_matches(spark.createDataFrame(rows, old.schema), f"{folder}/m", buckets=4)
        found = {r["job_id"]: r["match_level"] for r in spark.read.parquet(f"{folder}/m").collect()}
        assert found == {1: "strong_match", 2: "gap"}


def test_cv_dates(spark):
    cases = {("07 1999", False): "1999-07-01", ("02/2012", True): "2012-02-29", ("11-2003", False): "2003-11-01",
             ("Dez 2008", False): "2008-12-01", ("Nov 2017", True): "2017-11-30", ("Mai 2005", True): "2005-05-31",
             ("2011-09-13", True): "2011-09-13", ("1998-2", True): "1998-02-28", ("heute", True): None, ("", True): None}
    rows = [(k[0], k[1]) for k in cases]
    frame = spark.createDataFrame(rows, "v string, e boolean")
    column = F.when(F.col("e"), dates.cv_date(F.col("v"), end_of_month=True)).otherwise(dates.cv_date(F.col("v")))
    assert {(r[0], r[1]): r[2] for r in frame.select("v", "e", column).collect()} == cases


def test_structured_cv_becomes_suggestions(spark):
    document = {
        "profile": {"name": "Ilka Moor", "email": "ilka@boats.invalid", "linkedin": "https://boats.invalid/ilka", "summary": "unused"},
        "skills": {"categories": [{"category": "Programming", "skills": ["Fortran"]}],
                   "languages": [{"language": "Friesisch", "level": "Muttersprache"}]},
        "work_experience": [{"company": "Plankwerk", "job_title": "Bootsbauerin", "start_date": "2010-03-01", "end_date": "",
                             "activities": ["Hulls planed"]}],
        "references": [{"name": "Onno", "job_title": "Master", "company": "Dock", "linkedin": "https://o.invalid"}],
    }
    rows = spark.createDataFrame([(1, json.dumps(document))], "cv_id int, cv_json string")
    found = [(r["resource_type"], json.loads(r["proposed_data"])) for r in cv.cv_to_suggestions(cv.scan_cvs(rows)).orderBy("position").collect()]
    assert [k for k, _ in found] == ["profile", "skills", "skills", "experiences", "references"]
    assert found[0][1] == {"full_name": "Ilka Moor", "email": "ilka@boats.invalid", "linkedin_url": "https://boats.invalid/ilka"}
    assert found[1][1]["category"] == "programming_languages" and found[2][1]["proficiency_level"] == "expert"
    assert found[3][1]["localizations"][0]["title"] == "Bootsbauerin" and "end_date" not in found[3][1]
    assert found[4][1]["usage_consent"] is False and found[4][1]["localizations"][0]["summary"] == "https://o.invalid"


def test_conflicts_of_suggestions(spark):
    cases = [
        ("skills", {"canonical_name": "Dry-Stone walls", "category": "frameworks_libraries"},
         {"canonical_name": "dry stone Walls", "category": "frameworks_libraries"}, "duplicate", []),
        ("experiences", {"company": "Plankwerk", "start_date": "2004-05-01", "end_date": "2009-09-30",
                         "localizations": [{"language": "de", "title": "Bootsbauerin"}]},
         {"company": "PLANKWERK", "start_date": "2004-02-01", "end_date": "2009-09-30",
          "localizations": [{"language": "de", "title": "Bootsbauerin", "status": "draft"}]}, "conflict", ["start_date"]),
        ("references", {"full_name": "Onno Deich", "organization": "Dock", "email": "ONNO@dock.invalid"},
         {"full_name": "Onno Deich", "organization": "Quay", "email": "onno@dock.invalid"}, "conflict", ["organization"]),
        ("projects", {"canonical_name": "Barge"}, {"canonical_name": "Raft"}, "none", []),
    ]
    entities = [(i, k, f"e{i}", json.dumps(e), i) for i, (k, e, _, _, _) in enumerate(cases)]
    suggestions = [(i, i, k, json.dumps(s), None, "pending") for i, (k, _, s, _, _) in enumerate(cases)]
    rows = cv.with_conflicts(cv.match_entities(
        spark.createDataFrame(suggestions, "suggestion_id int, profile_id int, resource_type string, proposed_data string, matched_entity_id string, status string"),
        spark.createDataFrame(entities, "profile_id int, resource_type string, entity_id string, data string, created_at int")))
    found = {r["suggestion_id"]: (r["conflict_status"], [d["field"] for d in r["differences"]]) for r in rows.collect()}
    assert found == {i: (c[3], c[4]) for i, c in enumerate(cases)}


def test_candidates_need_evidence(spark):
    jobs = spark.createDataFrame(
        [("a", "Zweiter Segelmacher – Tuch und\nLeinen. Arbeit in der Halle", None, None, None, None, None, None, None)],
        "job_id string, content string, title string, company string, location string, work_model string, employment_type string, "
        "contract_term string, language string")
    rows = [("a", "title", "Zweiter Segelmacher", 0.95, "Zweiter Segelmacher – Tuch und Leinen"),
            ("a", "work_model", "Dach", 1.0, "Arbeit auf dem Dach"), ("a", "language", "sv", 1.0, "Arbeit in der Halle"),
            ("a", "company", "Nowhere AG", 0.98, ""), ("a", "location", "Sandhafen", 0.7, "Halle")]
    found = ingest.accept_candidates(jobs, spark.createDataFrame(rows, "job_id string, field string, value string, confidence double, evidence string")).first()
    assert found["title"] == "Zweiter Segelmacher"
    assert [found[f] for f in ("work_model", "language", "company", "location")] == [None] * 4


def test_review_rules(spark):
    rows = [("s", "a", "t", 1, "accept"), ("s", "b", "t", 1, "retry"), ("s", "c", "t", 1, "retry"), ("s", "c", "t", 2, "retry"),
            ("s", "d", "t", 1, "retry"), ("s", "d", "t", 2, "correct")]
    frame = spark.createDataFrame(rows, "subject_type string, subject_id string, review_type string, attempt int, decision string")
    found = {r["subject_id"]: r["outcome"] for r in reviews.retry_outcome(frame).collect()}
    assert found == {"a": "accept", "b": "manual_review", "c": "manual_review", "d": "correct"}
    values = spark.createDataFrame([(42.0,), (0.42,), (1.0,), (700.0,)], "v double")
    assert [r[0] for r in values.select(reviews.normalized_confidence(F.col("v"))).collect()] == [0.42, 0.42, 1.0, 700.0]


def test_comparable_text_drops_case_accents_and_punctuation(spark):
    frame = spark.createDataFrame([("Groß-Segel  Öl ÂME",), ("mañaná́_y",)], "v string")
    assert [r[0] for r in frame.select(T.comparable_text(F.col("v"))).collect()] == ["gross segel ol ame", "manana y"]
    assert quality.normalized_extracted_text is not None


def _compared(spark, pairs):
    """Conflict status of proposed against existing values, by case."""
    import json

    rows = [(str(n), "skills", json.dumps({"canonical_name": "x", "v": a}), json.dumps({"canonical_name": "x", "v": b} if b is not ... else {"canonical_name": "x"}), "e")
            for n, (a, b, _) in enumerate(pairs)]
    frame = spark.createDataFrame(rows, "suggestion_id string, resource_type string, proposed_data string, existing_data string, existing_id string")
    found = {r["suggestion_id"]: r["conflict_status"] for r in cv.with_conflicts(frame).collect()}
    return [found[str(n)] for n in range(len(pairs))]


def test_nested_values_compare_by_parts(spark):
    cases = [
        ([{"a": "1", "b": "2"}], [{"b": "2", "a": "1"}], "duplicate"),
        ([{"a": "1", "id": {"z": 1, "y": [2]}}], [{"a": "1"}], "duplicate"),
        (["a b"], ["a", "b"], "conflict"),
        (["a", "b"], ["b", "a"], "conflict"),
        ({"p": {"q": {"r": ["Ärger!", None]}}}, {"p": {"q": {"r": ["arger", None], "status": "draft"}, "x": None}}, "duplicate"),
        ({"p": []}, {"p": {}}, "conflict"),
        ({"p": {}}, {"p": {"id": 3, "revision": None}}, "duplicate"),
        ({"0": "a"}, ["a"], "conflict"),
        ([None], [], "conflict"),
        ([], ..., "conflict"),
        ("", ..., "conflict"),
        (1, 1.0, "duplicate"),
        (True, 1, "duplicate"),
        (1, "1", "conflict"),
        ({"a.b": 1}, {"a": {"b": 1}}, "conflict"),
        ({'k"]': ["x"]}, {'k"]': ["x"]}, "duplicate"),
        ({'k"]': ["x"]}, {'k"]': ["y"]}, "conflict"),
    ]
    assert _compared(spark, cases) == [c[2] for c in cases]


def test_values_below_the_last_level(spark):
    deep = lambda leaf: [[[[[[[[[[leaf]]]]]]]]]]
    cases = [(deep({"a": 1, "b": 2}), deep({"b": 2, "a": 1}), "duplicate"), (deep({"a": 1}), deep({"a": 2}), "conflict")]
    assert _compared(spark, cases) == [c[2] for c in cases]


def test_searches_for_the_same_terms_meet_the_index_once(spark, monkeypatch):
    from fitweave.operators import search

    written = {}
    plain = search.materialize

    def counted(frame, name):
        written[name] = plain(frame, name)
        return written[name]

    monkeypatch.setattr(search, "materialize", counted)
    jobs = spark.createDataFrame([(i, f"Data {'Ring' if i % 2 else 'Sail'} {i}") for i in range(20)], "job_id int, title string")
    terms = ["ring data", "Data  RING", " ", "", None, "sail 4", "nothing"]
    searches = spark.createDataFrame([(100 + i, t) for i, t in enumerate(terms)], "search_id int, terms string")
    found = {(r.search_id, r.job_id) for r in search.search_many(jobs, searches, ["title"]).collect()}
    odd, whole = set(range(1, 20, 2)), set(range(20))
    hits = {100: odd, 101: odd, 102: whole, 103: whole, 104: whole, 105: {4, 14}}
    assert found == {(s, j) for s, ids in hits.items() for j in ids}
    # 10 of both rings, 20 of the three empty searches; an index entry may let some more through for the others
    assert written["search-candidates"].where("search_id in (100, 101)").count() == 10
    assert written["search-candidates"].where("search_id in (102, 103, 104)").count() == 20


def test_reposted_ads_are_folded_once(spark):
    """Counts, groups and rows read written digests; each of them read and folded the texts again."""
    seen = spark.sparkContext.accumulator(0)

    def read(frames):
        for frame in frames:
            seen.add(len(frame))
            yield frame

    schema = "job_id long, imported_at long, content string"
    jobs = spark.createDataFrame([(n, n, f"Text {n % 3}!") for n in range(30)] + [(30, 30, "!"), (31, 31, None)], schema)
    found = {tuple(r) for r in ingest.reposted_jobs(jobs.mapInPandas(read, schema)).collect()}
    assert found == {(n, n % 3, 10) for n in range(30)} | {(30, 30, 1), (31, 31, 1)}
    assert seen.value == 32
