"""Match levels, target fit and recommendation against expected values."""

from __future__ import annotations

from pyspark.sql import functions as F

from fitweave.operators import matching, profile, reports, scoring, target

REQUIREMENT = (
    "job_id string, profile_id string, requirement_id string, requirement string, category string, "
    "priority string, keywords array<string>, normalized_value string"
)
EVIDENCE = (
    "profile_id string, evidence_id string, source_name string, source_type string, source_content string, "
    "label string, evidence_text string, experience_context string, keywords array<string>"
)
# name: (requirement, category, requirement keywords, [(context, evidence keywords)])
CASES = {
    "professional": ("Loom setup", "", [], [("professional", ["loom", "setup"])]),
    "project": ("Production experience with looms", "", [], [("project", ["looms"])]),
    "missing": ("Glassblowing", "", [], []),
    "soft": ("Independent and a team-oriented person", "Soft skills", [], []),
    "alternative_keyword": ("Fluent in Fortran or Cobol", "Programming Languages", ["fortran", "cobol"], [("other", ["fortran"])]),
    "incidental": ("Timber drying storage transport harbour lighting", "", [], [("professional", ["lighting"])]),
    "several": ("Good with hammer, chisel, plane and oak", "", [], [("other", ["hammer"]), ("other", ["chisel"]), ("other", ["plane", "oak"])]),
    "alternative": ("Experience in weaving, spinning, or wool dyeing", "", [], [("professional", ["weaving", "spinning", "fabric"])]),
    "years_english": ("9+ years of professional experience", "experience", [], []),
    "no_terms": ("!?", "", [], []),
}
EXPECTED = {
    "professional": ("strong_match", 1, None),
    "project": ("transferable", 1, None),
    "missing": ("gap", 0, 0.9),
    "soft": ("unknown", 0, 0.3),
    "alternative_keyword": ("partial_match", 1, None),
    "incidental": ("gap", 0, 0.85),
    "several": ("partial_match", 3, None),
    "alternative": ("strong_match", 1, None),
    "years_english": ("unknown", 0, 0.3),
    "no_terms": ("unknown", 0, 0.2),
}


def _evaluate(spark, cases, extra_evidence=()):
    requirements, evidence = [], list(extra_evidence)
    for name, (text, category, keywords, rows) in cases.items():
        requirements.append((name, name, "r", text, category, "must", keywords, None))
        for i, (context, words) in enumerate(rows):
            evidence.append((name, f"e{i}", "CV", "cv", "Profile content", "Workshop", "Ran the old workshop", context, words))
    result = matching.evaluate_matching(
        spark.createDataFrame(requirements, REQUIREMENT), spark.createDataFrame(evidence, EVIDENCE),
        F.lit("2024-01-01").cast("date"),
    )
    return {r["job_id"]: r for r in result.collect()}


def test_match_levels(spark):
    found = _evaluate(spark, CASES)
    for name, (level, cited, sure) in EXPECTED.items():
        row = found[name]
        assert (row["match_level"], len(row["cited"])) == (level, cited), (name, row)
        if sure is not None:
            assert row["confidence"] == sure
    assert "not production experience" in found["project"]["recommended_action"]
    assert "Erfahrungsjahre" in found["years_english"]["recommended_action"]
    assert found["missing"]["gap"] == "Glassblowing" and found["professional"]["gap"] is None


def test_years_use_dated_stations_and_professional_skills(spark):
    station = '{"start_date":"2001-06-01","end_date":"2007-06-01"}'
    rows = [
        ("station", "e", "x", "manual", station, "Job", "Berufserfahrung", "professional", ["x"]),
        ("skill", "e", "x", "manual", '{"years_experience":2}', "Fortran", "Skill: Fortran", "professional", ["Fortran"]),
        ("private", "e", "x", "manual", '{"years_experience":2}', "Fortran", "Skill: Fortran", "other", ["Fortran"]),
    ]
    text = "Mindestens 5 Jahre Berufserfahrung"
    scoped = "Mindestens 4 Jahre Erfahrung mit Fortran"
    found = _evaluate(
        spark, {"station": (text, "experience", [], []), "skill": (scoped, "experience", [], []),
                "private": (text, "experience", [], [])}, rows)
    assert (found["station"]["match_level"], found["station"]["confidence"]) == ("strong_match", 0.95)
    assert found["station"]["explanation"] == "Die längste dokumentierte Berufsstation umfasst 6 Jahre."
    assert found["skill"]["match_level"] == "gap" and found["skill"]["profile_source"] == "professional"
    assert found["private"]["match_level"] == "unknown"


def test_nationality_supports_eligibility(spark):
    people = spark.createDataFrame([("p", "deutsch"), ("f", "Französisch"), ("n", " ")], "profile_id string, nationality string")
    evidence = profile.nationality_evidence(people).withColumn("evidence_id", F.col("source_name"))
    texts = ["NATO-Staatsangehörigkeit", "Uneingeschränkte Arbeitserlaubnis in Deutschland", "Aufenthaltserlaubnis in Deutschland"]
    rows = [(f"j{i}", "p", "r", t, "other", "must", [], None) for i, t in enumerate(texts)]
    rows.append(("j9", "f", "r", texts[0], "other", "must", [], None))
    found = {
        r["job_id"]: r["match_level"]
        for r in matching.evaluate_matching(spark.createDataFrame(rows, REQUIREMENT), evidence).collect()
    }
    assert [found[f"j{i}"] for i in range(3)] == ["strong_match"] * 3
    assert found["j9"] != "strong_match"
    contents = [r[0] for r in evidence.select("source_content").collect()]
    assert len(contents) == 2 and not any("email" in c or "phone" in c for c in contents)


def test_qualification_fit_weights(spark):
    rows = [("j", "p", "must", "strong_match"), ("j", "p", "must", "gap"), ("j", "p", "should", "partial_match"),
            ("j", "p", "nice_to_have", "transferable"), ("k", "p", None, None)]
    fit = scoring.qualification_fit(spark.createDataFrame(rows, "job_id string, profile_id string, priority string, match_level string"))
    found = {r["job_id"]: r for r in fit.collect()}
    assert (found["j"]["score"], found["j"]["level"], found["j"]["achieved_points"], found["j"]["possible_points"]) == (52, "partial", 4.7, 9)
    assert (found["k"]["score"], found["k"]["level"], found["k"]["possible_points"]) == (0, "weak", 2)


def test_recommendation_rules(spark):
    rows = [("apply", 82, 76, "strong", 0, 0), ("conflict", 95, 90, "conflict", 0, 0), ("open", None, 90, "strong", 0, 0),
            ("gaps", 82, 76, "strong", 1, 0), ("goals", 82, 30, "weak", 0, 0), ("low", 30, 50, "partial", 0, 1)]
    schema = ("job_id string, qualification_score int, target_score int, target_level string, must_gaps int, review_exclusions int")
    found = {r["job_id"]: r for r in scoring.recommendation(spark.createDataFrame(rows, schema)).collect()}
    verdicts = {k: (v["verdict"], v["requires_manual_review"]) for k, v in found.items()}
    assert verdicts == {
        "apply": ("apply", False), "conflict": ("deprioritize", False), "open": ("review", True), "gaps": ("consider", True),
        "goals": ("review", True), "low": ("deprioritize", True),
    }
    assert found["apply"]["headline"] == "Bewerbung empfohlen"
    assert found["open"]["reasons"][0] == "Qualifikations-Fit: unklar"


JOB = ("job_id string, title string, role string, location string, work_model string, employment_type string, industry string, "
       "activity_text string, content string, seniority_level string")
PROFILE = ("profile_id string, career_goal string, target_roles array<string>, "
           "target_role_preferences array<struct<role:string,level:string,priority:int>>, target_industries array<string>, "
           "target_locations array<string>, preferred_work_models array<string>, preferred_employment_types array<string>, "
           "deal_breakers array<string>")


def test_target_fit(spark):
    jobs = [
        ("loom", "Hand Weaver", None, "Sandhafen", "Hybrid", "Unbefristete Vollzeitstelle", None, "Stoffe weben", "Stoffe weben am Fenster.", None),
        ("freelance", "Hand Weaver", None, "Sandhafen", "Remote", "Freelance", None, None, "Freelance weaving", None),
        ("junior", "Wool Dyer & Hand Weaver", None, "Sandhafen", None, "Angestellte/r", None, "Wolle färben und Stoffe weben", "Wolle färben", "junior"),
    ]
    people = [
        ("loom", "Stoffe weben", ["Wool Dyer", "Hand Weaver"], None, [], ["Sandhafen"], ["remote", "hybrid"], ["permanent"], ["Freiberuflich"]),
        ("freelance", "Weaving", ["Hand Weaver"], None, [], ["Sandhafen"], ["remote"], ["permanent"], ["Freiberuflich"]),
        ("junior", "Wolle färben, Stoffe weben", ["Wool Dyer", "Hand Weaver"], None, [], ["Sandhafen"], [], ["permanent"], []),
    ]
    pairs = spark.createDataFrame([(n, n) for n in ("loom", "freelance", "junior")], "job_id string, profile_id string")
    fit = target.target_fit(pairs, spark.createDataFrame(jobs, JOB), spark.createDataFrame(people, PROFILE))
    found = {r["job_id"]: r for r in fit.collect()}
    assert (found["loom"]["level"], found["loom"]["score"]) == ("strong", 100)
    assert found["loom"]["exclusions"][0]["status"] == "clear"
    assert found["freelance"]["level"] == "conflict" and found["freelance"]["exclusions"][0]["status"] == "conflict"
    assert found["junior"]["level"] == "strong"
    status = {c["key"]: c["status"] for c in found["junior"]["criteria"]}
    assert status["seniority"] == "unknown" and status["employment_type"] == "unknown"


def test_report_of_several_profiles(spark):
    rows = [("j", p, "must", level) for p, level in (("a", "strong_match"), ("a", "gap"), ("b", "partial_match"), ("b", "partial_match"))]
    matches = spark.createDataFrame(rows, "job_id string, profile_id string, priority string, match_level string")
    target_fit = spark.createDataFrame([("j", "a", 70, "partial", 0), ("j", "b", 90, "strong", 0)],
                                       "job_id string, profile_id string, score int, level string, review_exclusions int")
    found = {r["profile_id"]: r for r in reports.stored_report(matches, target_fit).collect()}
    assert [(found[p]["qualification_score"], found[p]["summary"]) for p in "ab"] == [(50, {"strong_match": 1, "gap": 1}), (65, {"partial_match": 2})]


def test_years_evidence_has_every_supplier(spark, sf):
    from fitweave.plans.profile import _years_matches
    from fitweave.plans.registry import Tables

    tables = Tables(spark, sf)
    assert _years_matches(tables)[1].count() == tables.supplier.count()


def test_best_evidence_equals_the_ranked_pair_table(spark):
    """Bounds and heads against the whole list of pairs, with frequent words, keywords, ties and three profiles."""
    import random

    rng = random.Random(5)
    words = [f"word{n}" for n in range(40)]

    def pick(k):
        return sorted({words[min(int(rng.expovariate(0.12)), 39)] for _ in range(k)})

    contexts = ["professional", "project", "training", "education", "other"]
    requirements = [(f"j{n}", f"p{n % 3}", "r", " ".join(pick(rng.randrange(1, 12))), "", "must", pick(rng.randrange(0, 2)), None) for n in range(250)]
    evidence = [
        (f"p{n % 3}", f"e{n:03}", "CV", "cv", '{"source_type":"manual_training"}' if n % 7 == 0 else "{}", "Staatsangehörigkeit" if n % 11 == 0 else "x",
         " ".join(pick(rng.randrange(1, 9))), rng.choice(contexts), [])
        for n in range(120)
    ]
    bodies = matching.requirement_bodies(spark.createDataFrame(requirements, REQUIREMENT))
    terms, rows = matching.body_terms(bodies), matching.evidence_terms(spark.createDataFrame(evidence, EVIDENCE))
    pairs = matching.overlap_pairs(terms, rows).join(rows.select("profile_id", "evidence_id", "evidence_code").distinct(), ["profile_id", "evidence_id"]).collect()
    by_body = {}
    for r in pairs:
        by_body.setdefault((r["profile_id"], r["body_hi"], r["body_lo"]), []).append(r)
    want = {}
    for body, found in by_body.items():
        found.sort(key=lambda r: (not r["relevant"], -(r["evidence_code"] // 100), -r["overlap"], r["evidence_id"]))
        want[body] = [(r["evidence_id"], r["overlap"], r["relevant"]) for r in found[:3]]
    outlook = matching.requirement_outlook(bodies, matching.term_summaries(rows))
    best = matching.best_evidence(outlook, rows)
    got = {}
    for r in sorted(best.collect(), key=lambda r: r["rank"]):
        got.setdefault((r["profile_id"], r["body_hi"], r["body_lo"]), []).append((r["evidence_id"], r["overlap"], r["relevant"]))
    assert got == want and len(want) > 200
    facts = {(r["profile_id"], r["body_hi"], r["body_lo"]): r for r in matching.body_facts(outlook, best).collect()}
    for body, found in by_body.items():
        kind = lambda c: any(x["relevant"] and c(x) for x in found)
        row = facts[body]
        assert row["any_relevant"] == any(x["relevant"] for x in found)
        assert row["relevant_professional"] == kind(lambda x: x["evidence_code"] // 10 % 10 == 1)
        assert row["relevant_nationality"] == kind(lambda x: x["evidence_code"] % 10 == 1)
        assert row["several_rows"] == (len(found) > 1)
    assert sum(len(v) for v in by_body.values()) > 4 * sum(len(v) for v in want.values())


def test_pairs_and_ranks_of_dealt_bodies_do_not_shuffle(spark, monkeypatch):
    """Hits are many times the bodies: with evidence that is broadcast, only bodies move."""
    monkeypatch.setattr(matching, "BODY_ROWS", 10)
    requirements = [(1, "p", f"r{i}", f"Python SQL Fortran harbour {i}") for i in range(50)]
    columns = "job_id int, profile_id string, requirement_id string, requirement string"
    rows = spark.createDataFrame(requirements, columns).withColumns({
        "category": F.lit("other"), "keywords": F.array().cast("array<string>"), "normalized_value": F.lit(None).cast("string"),
    })
    evidence = spark.createDataFrame([("p", i, "{}", "Skill", f"Python SQL {i}", "professional", None) for i in range(20)], (
        "profile_id string, evidence_id int, source_content string, label string, evidence_text string, "
        "experience_context string, keywords array<string>"))
    postings = matching.materialize(matching.evidence_terms(evidence), "test-postings")
    bodies = matching.materialize(matching.requirement_bodies(rows), "test-bodies")
    pairs = matching.overlap_pairs(matching.body_terms(matching.dealt_bodies(bodies)), postings)
    outlook = matching.materialize(matching.requirement_outlook(bodies, matching.term_summaries(postings)), "test-outlook")
    for result in (pairs, matching.best_evidence(outlook, postings)):
        plan = result._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == plan.count("REPARTITION_BY_NUM")
    assert pairs.count() == 50 * 20 and pairs.where("overlap >= 2").count() == 50 * 20


def _random_case(spark, profiles):
    import random

    rng = random.Random(9)
    words = [f"word{n}" for n in range(25)]
    contexts = ["professional", "project", "training", "education", "other", None]

    def pick(k):
        return [rng.choice(words) for _ in range(k)]

    requirements = [
        (f"j{n}", rng.choice([*profiles, "nobody"]), f"r{n}", rng.choice(["", "Mindestens 3 Jahre Erfahrung mit "]) * (n % 5 == 0)
         + rng.choice([" ", " oder "]).join(pick(rng.randrange(0, 9))), rng.choice(["Soft_Skill", "other", None]), "must",
         rng.choice([None, [], pick(1)]), None)
        for n in range(300)
    ]
    evidence = [
        (p, f"e{n % 37:03}{p}{n}", "CV", "cv", rng.choice(['{"source_type":"manual_training"}', '{"years_experience":4}', '{"start_date":"2001-06-01"}', "{}"]),
         "Staatsangehörigkeit" if n % 11 == 0 else "x", rng.choice([None, " ".join(pick(rng.randrange(0, 9)))]), rng.choice(contexts),
         rng.choice([None, pick(1)]))
        for p, many in profiles.items() for n in range(many)
    ]
    return spark.createDataFrame(requirements, REQUIREMENT), spark.createDataFrame(evidence, EVIDENCE)


def test_few_and_many_evidence_rows_give_the_same_matches(spark, monkeypatch):
    """Profiles on both sides of ``FEW``, and without evidence; both ways of either join."""
    case = _random_case(spark, {"a": 3, "b": 12, "c": 40, "d": 1})
    results = []
    for few, rows in ((0, 0), (1000, 10**6), (1000, 0), (12, 10**6), (12, 0)):
        monkeypatch.setattr(matching, "FEW", few)
        monkeypatch.setattr(matching, "FEW_ROWS", rows)
        found = matching.evaluate_matching(*case, F.lit("2024-01-01").cast("date"))
        assert found.count() == 300
        results.append(sorted(map(repr, found.collect())))
        assert results[-1] == results[0]
    assert len({r["rule"] for r in found.collect()}) > 8


def test_evidence_of_few_rows_is_not_shuffled_by_term(spark, monkeypatch):
    """Terms of all evidence were shuffled five times, whether a requirement has them or not."""
    written = {}

    def noted(frame, name):
        written[name] = frame._jdf.queryExecution().executedPlan().toString()
        return materialize(frame, name)

    materialize = matching.materialize
    monkeypatch.setattr(matching, "materialize", noted)
    found = matching.evaluate_matching(*_random_case(spark, {"a": 3, "b": 12}), F.lit("2024-01-01").cast("date"))
    written["result"] = found._jdf.queryExecution().executedPlan().toString()
    assert not any("hashpartitioning(profile_id" in plan and ", term#" in plan.split("Exchange hashpartitioning", 1)[1][:200] for plan in written.values())
    assert "match-summaries" not in written and "match-postings" not in written


def test_requirements_are_computed_once(spark):
    """They may come straight from the extraction of texts."""
    requirements, evidence = _random_case(spark, {"a": 3, "b": 12})
    seen = spark.sparkContext.accumulator(0)

    def extract(frames):
        for frame in frames:
            seen.add(len(frame))
            yield frame

    matching.evaluate_matching(requirements.mapInPandas(extract, REQUIREMENT), evidence).write.format("noop").mode("overwrite").save()
    assert seen.value == 300


def test_packed_evidence_gives_the_matches_of_the_joins(spark, monkeypatch):
    """Profiles of much evidence in their own row or by joins on terms, beside profiles of few rows."""
    case = _random_case(spark, {"a": 3, "b": 12, "c": 40, "d": 1})
    results = []
    for few, rows in ((0, 0), (0, 10**6), (10, 0), (10, 10**6)):
        monkeypatch.setattr(matching, "FEW", few)
        monkeypatch.setattr(matching, "PACKED", rows)
        found = matching.evaluate_matching(*case, F.lit("2024-01-01").cast("date"))
        results.append(sorted(map(repr, found.collect())))
        assert len(results[-1]) == 300 and results[-1] == results[0]


def test_packed_evidence_leaves_no_terms_or_pairs_as_rows(spark, monkeypatch):
    """Requirements of a profile of much evidence were written four times, with their terms and the heads of these."""
    written = []
    materialize = matching.materialize
    monkeypatch.setattr(matching, "FEW", 10)
    monkeypatch.setattr(matching, "materialize", lambda frame, name: (written.append(name), materialize(frame, name))[1])
    found = matching.evaluate_matching(*_random_case(spark, {"b": 12, "c": 40}), F.lit("2024-01-01").cast("date"))
    assert found.count() == 300 and "match-outlook" not in written and "match-summaries" not in written


def test_packed_facts_equal_all_pairs(monkeypatch):
    """Batches of any cut, dense and sparse counts, unknown and null profiles, repeated and null evidence ids, ties."""
    import random

    import pyarrow as pa

    from fitweave.operators import packed

    rng = random.Random(3)
    words = [f"w{n}" for n in range(60)]

    def pick(k):
        return sorted({words[min(int(rng.expovariate(0.08)), 59)] for _ in range(k)})

    evidence = sorted(
        ((p, f"e{n // 2:03}" if p == "b" else f"e{n:03}", rng.choice([5, 8, 9, 10]) * 100 + rng.randrange(1, 6) * 10 + (rng.random() < 0.2), pick(rng.randrange(0, 12)))
         for p in "ab" for n in range(90)), key=lambda e: (e[0], -(e[2] // 100), e[1], e[2]),
    )
    evidence = list({e[:3]: e for e in evidence}.values())
    evidence.append(("c", None, 1010, ["w0", "w1"]))
    rows = [(p, e, c, t) for p, e, c, terms in evidence for t in terms]
    names = ["profile_id", "evidence_id", "evidence_code", "term"]
    packed_rows = packed.pack(pa.table([pa.array(column) for column in zip(*rows)], names=names))
    bodies = []
    for _ in range(400):
        terms = pick(rng.randrange(0, 30)) + ["unknown"] * rng.randrange(2)
        bodies.append((rng.choice(["a", "b", "a", "b", "c", "nobody", None]), terms, *([t for t in terms if rng.random() < share] for share in (0.1, 0.2))))
    kinds = [pa.string(), *[pa.list_(pa.string())] * 3]
    columns = [pa.array(column, kind) for column, kind in zip(zip(*bodies), kinds)]

    def expected(profile, terms, keywords, anchors):
        mine = [e for e in evidence if profile is not None and e[0] == profile]
        pairs = []
        for _, e, code, has in mine:
            shared = set(terms) & set(has)
            if shared:
                relevant = len(shared) * 5 >= len(terms) or len(shared) >= 2 or bool(shared & set(keywords))
                pairs.append((not relevant, -(code // 100), -len(shared), e, code, shared))
        pairs.sort(key=lambda r: r[:4] + r[4:5])
        ids = {r[3] for r in pairs if r[3] is not None}
        kind = lambda digit, value, some: any(r[4] // digit % 10 == value for r in some)
        good = [r for r in pairs if not r[0]]
        return {
            "covered_terms": len(set().union(*[r[5] for r in pairs])), "several_rows": len(ids) > 1,
            "keyword_hit": any(r[5] & set(keywords) for r in pairs),
            "professional_alternative": any(r[5] & set(anchors) and r[4] // 10 % 10 == 1 for r in pairs),
            "any_professional": kind(10, 1, pairs), "any_nationality": kind(1, 1, pairs), "any_relevant": bool(good),
            "relevant_professional": kind(10, 1, good), "relevant_nationality": kind(1, 1, good),
            "top": [{"rank": i + 1, "evidence_id": r[3], "context": r[4] // 10 % 10, "relevant": not r[0]} for i, r in enumerate(pairs[:3])],
        }

    want = [expected(*body) for body in bodies]
    for hits in (1, 50, 2000, 10**6):
        monkeypatch.setattr(packed, "HITS", hits)
        assert packed.facts_of(packed_rows, 3, *columns).to_pylist() == want
    half = [c.slice(37, 200) for c in columns]
    assert packed.facts_of(packed_rows, 3, *half).to_pylist() == want[37:237]


def test_packed_evidence_without_any_term(spark, monkeypatch):
    monkeypatch.setattr(matching, "FEW", 1)
    evidence = [("p", f"e{n}", "CV", "cv", "{}", "x", text, "professional", None) for n, text in enumerate(["", None, "?", "und"])]
    requirements = [("j", p, f"r{n}", text, "", "must", None, None) for p in ("p", None) for n, text in enumerate(["Python", "", None])]
    found = matching.evaluate_matching(spark.createDataFrame(requirements, REQUIREMENT), spark.createDataFrame(evidence, EVIDENCE))
    want = {("r0", "unmatched"), ("r1", "no_terms"), ("r2", "no_terms")}
    assert {(r["requirement_id"], r["rule"]) for r in found.collect()} == want


def test_tokens_are_made_of_the_documented_characters():
    import re

    from fitweave.functions import terms

    ranges = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ0-9+#.]{2,}")
    for code in range(0x2200):
        assert bool(re.fullmatch(terms.TOKEN, 2 * chr(code))) == bool(ranges.fullmatch(2 * chr(code)))
