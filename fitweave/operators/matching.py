"""Requirement-to-evidence matching for all jobs and profiles at once.

Shape of the job

* Equal requirements of a profile are evaluated once ("bodies"); copies of the same
  sentence in many ads meet the evidence as a single row and get the result by join.
* Terms are tokenized, exploded and looked up on (profile, term) in summaries of the evidence: how many
  rows have the term, whether professional ones do, and its head, the best three.  Coverage and most flags
  follow from them, and so do the citations of a requirement that meets the evidence in one term.
* Others are a top-k join with bounds (``best_evidence``).  A row that shares one term only is beaten by the
  head of that term, so beyond the heads only rows that share two terms count, and those are found
  without the requirement's most frequent term, which is looked up afterwards.  Where every row is
  relevant, the heads also give a weight below which no row can be cited.
* Pairs of requirement and evidence exist only between these joins; what is written has one row per
  requirement, or per evidence row and term.
* Where all evidence of such profiles fits into a task (``PACKED`` rows of evidence and term), each requirement is decided in its
  own row, from its text to its facts (``packed_facts``): only the distinct requirements shuffle, and no term or pair is a row.
* That is for profiles of much evidence.  The evidence of a profile of at most ``FEW`` rows is one short array, and
  each of its requirements meets the whole array in its own row (``few_facts``): two shuffles by profile, whatever the terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fitweave import vocab
from fitweave.functions import dates
from fitweave.functions import terms as M
from fitweave.functions import text as T
from fitweave.operators import packed
from fitweave.operators.skew import BROADCAST_ROWS, balanced_join, sized_join
from fitweave.session import materialize

# a requirement body is named by 128 hash bits in two longs: fixed width in every shuffle
BODY = ["profile_id", "body_hi", "body_lo"]
CITED = 3
BODY_ROWS = 1_000  # each may pair with all evidence of its profile
FEW = 100  # evidence rows of a profile that a requirement meets one by one
FEW_ROWS = 20_000  # evidence rows with their terms, in arrays of a profile each, some 10 MB
PACKED = 2_000_000  # rows of evidence and term that go to all tasks, some 15 MB as numbers


def requirement_bodies(requirements: DataFrame) -> DataFrame:
    """Distinct requirements per profile with their term sets and wording flags."""
    marked = requirements if set(BODY) <= set(requirements.columns) else with_body_id(requirements)
    bodies = marked.dropDuplicates(BODY).select(
        *BODY, "requirement", "category", "keywords", "normalized_value"
    )
    text = F.col("requirement")
    return (
        bodies.withColumn("terms", M.term_set(text, F.col("keywords")))
        .withColumn("keyword_terms", F.when(F.size("keywords") > 0, M.term_set(F.lit(""), F.col("keywords"))).otherwise(T.empty_words()))
        # a pivot between them is a term of the text as well
        .withColumn("anchors", F.when(F.arrays_overlap("terms", T.word_list(["or", "oder"])) & text.rlike(M.ALTERNATIVE), M.alternative_anchors(text))
                    .otherwise(T.empty_words()))
        .withColumn("term_count", F.size("terms"))
        .withColumn("minimum_years", M.minimum_years(text, F.col("normalized_value")))
        .withColumns(wording_flags())
    )


def wording_flags() -> dict[str, Column]:
    """Flags that only the wording of a requirement decides."""
    text = F.col("requirement")
    return {
        "is_soft": M.is_soft_skill(F.coalesce("category", F.lit("")), text),
        "needs_context": M.needs_work_context(text),
        "is_eligibility": M.is_eligibility(text),
        "is_generic": ~text.rlike(M.SKILL_SCOPE),
    }


def dealt_bodies(bodies: DataFrame) -> DataFrame:
    """Written bodies, or what is known of them, dealt over tasks of about ``BODY_ROWS`` by their key.

    What is broadcast to them leaves them where they are, so that their terms, pairs, flags and ranks, which are many
    times as many rows, are aggregated and ranked in the same tasks and never shuffle.
    """
    return bodies.repartition(max(1, -(-bodies.count() // BODY_ROWS)), *BODY)


def with_body_id(requirements: DataFrame) -> DataFrame:
    parts = [
        F.col("requirement"), F.coalesce("category", F.lit("")), F.coalesce("normalized_value", F.lit("")),
        F.when(F.size(F.coalesce("keywords", T.empty_words())) > 0, F.to_json("keywords")).otherwise("[]"),
    ]
    return requirements.withColumn("body_hi", F.xxhash64(*parts)).withColumn(
        "body_lo", F.xxhash64(F.lit("low"), *parts)
    )


CONTEXTS = ["professional", "project", "training", "education", "other"]


def evidence_terms(evidence: DataFrame) -> DataFrame:
    """One row per profile, evidence and term with what ranking needs.

    ``evidence_code`` packs weight in tenths, context number and the nationality flag as
    decimal digits, so that a pair carries one small number instead of three columns.
    """
    return evidence.select("profile_id", "evidence_id", evidence_code().alias("evidence_code"), F.explode(evidence_term_set()).alias("term"))


def evidence_code() -> Column:
    return (
        F.round(M.evidence_weight(F.col("source_content"), F.col("experience_context")) * 10).cast("int") * 100
        + F.coalesce(F.array_position(T.word_list(CONTEXTS), F.col("experience_context")), F.lit(0)).cast("int") * 10
        + F.coalesce(F.col("label") == vocab.NATIONALITY_LABEL, F.lit(False)).cast("int")
    )


def evidence_term_set() -> Column:
    return M.term_set(F.col("evidence_text"), F.col("keywords"))


def term_summaries(evidence: DataFrame) -> DataFrame:
    """One row per profile and term of ``evidence_terms``: counts, flags and the head, its best rows.

    Both parts reduce before they shuffle (partial aggregation, rank limit).
    """
    key = ["profile_id", "term"]
    facts = evidence.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("evidence_id").alias("min_id"), F.max("evidence_id").alias("max_id"),
        F.bool_or(_context() == 1).alias("professional"), F.bool_or(_nationality()).alias("nationality"),
    )
    best = Window.partitionBy(*key).orderBy(_weight().desc(), "evidence_id")
    heads = evidence.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= CITED)
    return facts.join(heads.groupBy(*key).agg(F.collect_list(F.struct("evidence_id", "evidence_code")).alias("head")), key)


def _weight(code: Column | None = None) -> Column:
    return F.floor((F.col("evidence_code") if code is None else code) / 100).cast("int")


def _context(code: Column | None = None) -> Column:
    return F.floor((F.col("evidence_code") if code is None else code) / 10).cast("int") % 10


def _nationality(code: Column | None = None) -> Column:
    return (F.col("evidence_code") if code is None else code) % 10 == 1


FLAGS = ["is_soft", "needs_context", "is_eligibility", "is_generic"]
BODY_FACTS = ["term_count", "minimum_years", "flags"]
TERM_COLUMNS = ["term_count", "minimum_years", "terms", "keyword_terms", "anchors"]


def _flag(name: str) -> Column:
    return F.col("flags").bitwiseAND(1 << FLAGS.index(name)) > 0


def with_facts(bodies: DataFrame) -> DataFrame:
    """Requirements with their flags as bits of one number."""
    return bodies.withColumn("flags", sum((F.col(name).cast("int") * (1 << i) for i, name in enumerate(FLAGS)), F.lit(0)))


def body_terms(bodies: DataFrame) -> DataFrame:
    """One row per requirement and term, for the requirements that are decided by terms."""
    return bodies.where(F.col("minimum_years").isNull()).select(
        *BODY, "term_count", "keyword_terms", "anchors", F.explode("terms").alias("term")
    ).select(
        *BODY, "term_count", "term",
        F.array_contains("keyword_terms", F.col("term")).alias("is_keyword"),
        F.array_contains("anchors", F.col("term")).alias("is_anchor"),
    )


def overlap_pairs(terms: DataFrame, evidence: DataFrame) -> DataFrame:
    """Pairs of the same profile that share at least one term, with the overlap.

    The whole list, for callers that ask for it; matching itself goes by ``best_evidence``.  With terms of
    ``dealt_bodies`` and evidence that is broadcast, neither hits nor pairs shuffle.
    """
    hits = sized_join(terms, evidence, ["profile_id", "term"], ["body_hi"], spread_right_by=["evidence_id"])
    pairs = hits.groupBy(*BODY, "evidence_id").agg(
        F.count(F.lit(1)).alias("overlap"),
        F.bool_or("is_keyword").alias("keyword_overlap"),
        F.first("term_count").alias("term_count"),
    )
    return pairs.withColumn("relevant", _relevant())


def _relevant() -> Column:
    return (F.col("overlap") * 5 >= F.col("term_count")) | (F.col("overlap") >= 2) | F.col("keyword_overlap")


def coverage(terms: DataFrame, evidence: DataFrame) -> DataFrame:
    """Distinct requirement terms covered by any evidence row (A3).

    The evidence side is one row per (profile, term), so a frequent term makes no pairs.
    """
    known = materialize(evidence.select("profile_id", "term").distinct().withColumn("_known", F.lit(1)), "known-terms")
    hits = sized_join(terms, known, ["profile_id", "term"], ["body_hi"], how="left")
    return hits.groupBy(*BODY).agg(
        F.count("_known").alias("covered_terms"), F.first("term_count").alias("term_count")
    )


# up to so many terms, one shared term makes a row relevant
SHORT = 5


def requirement_outlook(bodies: DataFrame, summaries: DataFrame) -> DataFrame:
    """One row per requirement with all that the summaries of its terms tell.

    ``found`` has its covered terms, ``common`` the most frequent of them, and ``least`` the weight that a
    cited row has at least: three rows of the heads that are relevant for sure reach it.  A row of
    a head is relevant for sure if one term is enough, or if it is in the heads of two terms.
    """
    bodies = dealt_bodies(bodies)
    hits = sized_join(body_terms(bodies), summaries, ["profile_id", "term"], ["body_hi"])

    def any_of(condition: Column) -> Column:
        return F.coalesce(F.bool_or(condition), F.lit(False))

    kinds = ["professional", "nationality"]
    head = F.transform("head", lambda h: F.struct(h["evidence_id"], h["evidence_code"], F.col("is_keyword").alias("sure")))
    rows = hits.groupBy(*BODY).agg(
        F.count(F.lit(1)).alias("covered_terms"),
        F.coalesce(F.min("min_id") != F.max("max_id"), F.lit(False)).alias("several_rows"),
        any_of(F.col("is_keyword")).alias("keyword_hit"),
        any_of(F.col("is_anchor") & F.col("professional")).alias("professional_alternative"),
        *[any_of(F.col(k)).alias(f"any_{k}") for k in kinds],
        *[any_of(F.col("is_keyword") & F.col(k)).alias(f"sure_{k}") for k in kinds],
        F.collect_list(F.struct("n_rows", "term", "is_keyword", head.alias("head"))).alias("found"),
    )
    facts = with_facts(bodies).select(*BODY, *BODY_FACTS)
    rows = facts.join(rows, BODY, "left").withColumns({
        "covered_terms": F.coalesce("covered_terms", F.lit(0)),
        **{c: F.coalesce(c, F.lit(False)) for c in rows.columns if c.startswith(("any_", "sure_", "several", "keyword_h", "professional"))},
        "common": F.array_max("found"),
        "heads": F.sort_array(F.flatten(F.transform("found", lambda t: t["head"]))),
    })
    short = F.col("term_count") <= SHORT

    def sure(e: Column, i: Column) -> Column:
        """The last of the entries of one evidence row, if one of them is sure or there are two."""
        before, after = (F.get(F.col("heads"), i + step)["evidence_id"] for step in (-1, 1))
        again = F.coalesce(before == e["evidence_id"], F.lit(False))
        return (short | e["sure"] | again) & F.coalesce(after != e["evidence_id"], F.lit(True))

    rows = rows.withColumn("heads", F.filter("heads", sure))
    code = lambda e: e["evidence_code"]
    rows = rows.withColumns({
        "sure_professional": F.col("sure_professional") | F.coalesce(F.exists("heads", lambda e: _context(code(e)) == 1), F.lit(False)),
        "sure_nationality": F.col("sure_nationality") | F.coalesce(F.exists("heads", lambda e: _nationality(code(e))), F.lit(False)),
        "weights": F.sort_array(F.transform("heads", lambda e: _weight(code(e))), asc=False),
    })
    # rows below that weight are not looked at, so what they could tell has to be known
    known = short | ((F.col("sure_professional") | ~F.col("any_professional")) & (F.col("sure_nationality") | ~F.col("any_nationality")))
    return rows.withColumn("least", F.when(known, F.coalesce(F.get("weights", F.lit(CITED - 1)), F.lit(0))).otherwise(0)).drop("heads", "weights")


def best_evidence(outlook: DataFrame, evidence: DataFrame) -> DataFrame:
    """The rows to cite: relevant first, then weight, overlap and evidence id, three per requirement.

    ``pair_professional`` and ``pair_nationality`` tell whether any row that shares two terms with the requirement
    is of that kind; they hold for requirements of more than ``SHORT`` terms.
    """
    columns = [*BODY, "evidence_id", "evidence_code", "overlap", "relevant", "pair_professional", "pair_nationality"]
    none = F.lit(False)
    outlook = dealt_bodies(outlook)
    alone = outlook.where("covered_terms = 1").select(
        *BODY, "term_count", F.lit(1).alias("overlap"), F.col("common")["is_keyword"].alias("keyword_overlap"),
        F.inline(F.col("common")["head"]),
    ).drop("sure").withColumn("relevant", _relevant()).withColumns({"pair_professional": none, "pair_nationality": none})

    common = F.col("common")
    several = outlook.where("covered_terms > 1").select(
        *BODY, "term_count", "least", common["term"].alias("common_term"), common["is_keyword"].alias("common_keyword"),
        common["head"].alias("head"), F.filter("found", lambda t: t["term"] != common["term"]).alias("others"),
    )
    facts = ["term_count", "common_term", "common_keyword"]
    asked = several.select(*BODY, *facts, "least", F.explode("others").alias("t")).select(
        *BODY, *facts, "least", F.col("t.term").alias("term"), F.col("t.is_keyword").alias("is_keyword")
    )
    met = sized_join(asked, evidence, ["profile_id", "term"], ["body_hi"], spread_right_by=["evidence_id"]).where(
        _weight() >= F.col("least")
    ).select(*BODY, *facts, "evidence_id", "evidence_code", F.lit(1).alias("hit"), "is_keyword")
    heads = several.select(*BODY, *facts, F.inline("head")).select(
        *BODY, *facts, "evidence_id", "evidence_code", F.lit(0).alias("hit"), none.alias("is_keyword")
    )
    # facts in the key leave fixed-width buffers, so the aggregation hashes instead of sorting
    candidates = met.unionByName(heads).groupBy(*BODY, "evidence_id", *facts, "evidence_code").agg(
        F.sum("hit").alias("hits"), F.bool_or("is_keyword").alias("keyword"),
    )
    has_common = evidence.select(
        "profile_id", "evidence_id", F.col("term").alias("common_term"), F.lit(1).alias("in_common")
    )
    pairs = sized_join(candidates, has_common, ["profile_id", "evidence_id", "common_term"], ["body_hi"], how="left").select(
        *BODY, "evidence_id", "evidence_code", "term_count",
        (F.col("hits") + F.coalesce("in_common", F.lit(0))).alias("overlap"),
        (F.col("keyword") | (F.col("common_keyword") & F.col("in_common").isNotNull())).alias("keyword_overlap"),
    ).withColumn("relevant", _relevant())
    # the same partitions and order serve the flags and the rank, in one shuffle
    whole = Window.partitionBy(*BODY)
    twice = F.col("overlap") >= 2
    pairs = pairs.withColumns({
        "pair_professional": F.bool_or(twice & (_context() == 1)).over(whole),
        "pair_nationality": F.bool_or(twice & _nationality()).over(whole),
    })
    order = Window.partitionBy(*BODY).orderBy(F.desc("relevant"), _weight().desc(), F.desc("overlap"), "evidence_id")
    # heads of single terms are three rows at most, so their rank is computed with the others'
    return alone.select(*columns).unionByName(pairs.select(*columns)).withColumn(
        "rank", F.row_number().over(order)
    ).where(F.col("rank") <= CITED)


def body_facts(outlook: DataFrame, best: DataFrame) -> DataFrame:
    """Flags and citations per requirement."""
    entry = F.struct(
        "rank", F.col("evidence_id").cast("string").alias("evidence_id"), _context().alias("context"), "relevant"
    )
    tops = best.groupBy(*BODY).agg(
        F.array_sort(F.collect_list(entry)).alias("top"), F.bool_or("relevant").alias("top_relevant"),
        F.bool_or("pair_professional").alias("pair_professional"), F.bool_or("pair_nationality").alias("pair_nationality"),
    )
    rows = outlook.drop("found", "common", "least").join(tops, BODY, "left")
    short = F.col("term_count") <= SHORT

    def relevant(kind: str) -> Column:
        paired = F.col(f"sure_{kind}") | F.coalesce(f"pair_{kind}", F.lit(False))
        return F.when(short, F.col(f"any_{kind}")).otherwise(paired)

    return rows.withColumns({
        "top": F.coalesce("top", F.array().cast(tops.schema["top"].dataType)),
        "any_relevant": F.coalesce("top_relevant", F.lit(False)),
        "relevant_professional": relevant("professional"),
        "relevant_nationality": relevant("nationality"),
        **{name: _flag(name) for name in FLAGS},
    })


def documented_years(as_of: Column) -> list[Column]:
    """Years of the station and of the skill that an evidence row documents, if it is a professional one."""
    source = F.col("source_content")

    def day(field: str) -> Column:
        return F.get_json_object(source, f"$.{field}").substr(1, 10).try_cast("date")

    has_end = F.coalesce(F.get_json_object(source, "$.end_date"), F.lit("")) != ""
    end = F.when(has_end, day("end_date")).otherwise(as_of)
    stay = F.datediff(end, day("start_date")) / dates.DAYS_PER_YEAR
    station = F.when(stay.isNotNull(), F.greatest(F.lit(0.0), stay))  # rows without dates are no stations
    professional = F.col("experience_context") == "professional"
    return [
        F.when(professional, station).alias("station_years"),
        F.when(professional, M.skill_years(source, F.col("evidence_text"))).alias("skill_years"),
    ]


def _longest() -> list[Column]:
    return [F.max(c).alias(c) for c in ("station_years", "skill_years")]


def profile_years(evidence: DataFrame, as_of: Column) -> DataFrame:
    """Longest dated station and highest skill years of professional evidence."""
    rows = evidence.where(F.col("experience_context") == "professional")
    return rows.select("profile_id", *documented_years(as_of)).groupBy("profile_id").agg(*_longest())


def skill_year_citations(evidence: DataFrame) -> DataFrame:
    """Professional evidence rows that document the highest skill years, in long form."""
    rows = evidence.where(F.col("experience_context") == "professional").withColumn(
        "years", M.skill_years(F.col("source_content"), F.col("evidence_text"))
    ).where(F.col("years").isNotNull())
    best = rows.groupBy("profile_id").agg(F.max("years").alias("years"))
    return rows.join(best, ["profile_id", "years"], "left_semi").select(
        "profile_id", "evidence_id", "years"
    )


def match_rules(flags: dict[str, Column] | None = None) -> Column:
    """Name of the rule that decides a body; the first that holds.

    ``flags`` are those of ``wording_flags`` if they are no columns yet.  They come last in a condition, so that a wording is
    searched only where it decides.
    """
    flags = flags or {name: F.col(name) for name in FLAGS}
    years, terms = F.col("minimum_years"), F.col("term_count")
    share = F.col("covered_terms") / terms
    found = F.col("covered_terms") > 0
    incidental = ~F.col("any_relevant") & ~F.col("professional_alternative") & (share < 0.35)
    professional = F.when(F.col("any_relevant"), F.col("relevant_professional")).otherwise(
        F.col("any_professional")
    )
    nationality = F.when(F.col("any_relevant"), F.col("relevant_nationality")).otherwise(
        F.col("any_nationality")
    )
    by_station = F.col("station_years").isNotNull() & flags["is_generic"]
    soft = flags["is_soft"]
    return (
        F.when(years.isNotNull() & by_station & (F.col("station_years") >= years), "years_station_met")
        .when(years.isNotNull() & by_station, "years_station_short")
        .when(years.isNotNull() & F.col("skill_years").isNull(), "years_unknown")
        .when(years.isNotNull() & (F.col("skill_years") >= years), "years_met")
        .when(years.isNotNull(), "years_short")
        .when(terms == 0, "no_terms")
        .when(~found & soft, "soft_unmatched")
        .when(~found, "unmatched")
        .when(incidental & soft, "soft_incidental")
        .when(incidental, "incidental")
        .when(nationality & (share >= 0.6) & flags["is_eligibility"], "eligibility")
        .when(F.col("professional_alternative") | (professional & (share >= 0.6)), "professional")
        .when(
            ~professional & flags["needs_context"],
            F.when((share >= 0.2) & F.col("several_rows"), "context_components")
            .otherwise("context_transferable"),
        )
        .when(professional | (share >= 0.35) | F.col("keyword_hit"), "partial")
        .otherwise("transferable")
    )


RULE_LEVELS = {
    "strong_match": ["years_station_met", "years_met", "eligibility", "professional"],
    "partial_match": ["context_components", "partial"],
    "transferable": ["context_transferable", "transferable"],
    "gap": ["years_station_short", "years_short", "unmatched", "incidental"],
    "unknown": ["years_unknown", "no_terms", "soft_unmatched", "soft_incidental"],
}
FIXED_CONFIDENCE = {
    "years_station_met": 0.95, "years_station_short": 0.95, "years_met": 0.95,
    "years_short": 0.95, "years_unknown": 0.3, "no_terms": 0.2, "soft_unmatched": 0.3,
    "unmatched": 0.9, "soft_incidental": 0.3, "incidental": 0.85,
}


def _by_rule(values: dict, rule: Column, default: Column) -> Column:
    result = default
    for name, value in values.items():
        result = F.when(rule == name, F.lit(value)).otherwise(result)
    return result


def match_level(rule: Column) -> Column:
    result = F.lit(None).cast("string")
    for level, rules in RULE_LEVELS.items():
        result = F.when(rule.isin(*rules), F.lit(level)).otherwise(result)
    return result


def confidence(rule: Column) -> Column:
    """Two decimals from integer arithmetic; exact halves round up."""
    professional = F.when(F.col("any_relevant"), F.col("relevant_professional")).otherwise(
        F.col("any_professional")
    )
    n = F.col("term_count").cast("long")
    base = F.when(professional, 60).otherwise(50)
    numerator = (n * base + F.col("covered_terms") * 45) * 2 + n
    hundredths = F.least(F.lit(95), F.floor(numerator / (n * 2)))
    return _by_rule(FIXED_CONFIDENCE, rule, F.when(n > 0, hundredths / F.lit(100.0)))


def _number(value: Column) -> Column:
    return F.regexp_replace(F.format_string("%.2f", value), r"\.?0+$", "")


def match_texts(rule: Column) -> tuple[Column, Column]:
    """(explanation, recommended action) of a rule."""
    station, skill, need = (
        _number(F.col(c)) for c in ("station_years", "skill_years", "minimum_years")
    )
    explanation = (
        F.when(
            rule.startswith("years_station"),
            F.concat(F.lit("Die längste dokumentierte Berufsstation umfasst "), station, F.lit(" Jahre.")),
        )
        .when(
            rule == "years_met",
            F.concat(F.lit("Das Profil weist "), skill,
                     F.lit(" Jahre Skill-Erfahrung nach und erfüllt damit die Mindestanforderung von "),
                     need, F.lit(" Jahren.")),
        )
        .when(
            rule == "years_short",
            F.concat(F.lit("Das Profil weist höchstens "), skill,
                     F.lit(" Jahre Skill-Erfahrung nach; gefordert sind mindestens "), need,
                     F.lit(" Jahre.")),
        )
        .otherwise(_by_rule({k: v[0] for k, v in vocab.MATCH_TEXTS.items()}, rule, F.lit("")))
    )
    action = (
        F.when(rule == "years_met", "Die nachgewiesenen Erfahrungsjahre sachlich angeben.")
        .when(rule == "years_short",
              "Die fehlenden Erfahrungsjahre nicht behaupten; Anforderung manuell prüfen.")
        .otherwise(_by_rule({k: v[1] for k, v in vocab.MATCH_TEXTS.items()}, rule, F.lit("")))
    )
    return explanation, action


FACTS = [*BODY, "term_count", "minimum_years", *FLAGS, "covered_terms", "several_rows", "keyword_hit", "professional_alternative",
         "any_professional", "any_nationality", "any_relevant", "relevant_professional", "relevant_nationality", "top",
         "station_years", "skill_years"]
DECIDED = [*[c for c in FACTS if c not in FLAGS], "rule"]


def _of(rows: DataFrame, profiles: DataFrame, how: str) -> DataFrame:
    """Rows of the profiles, or of all others; written where they had to be shuffled for it."""
    if profiles.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(profiles), "profile_id", how)
    return materialize(rows.join(profiles, "profile_id", how), "match-part")


def packed_facts(bodies: DataFrame, postings: DataFrame, years: DataFrame) -> DataFrame:
    """Facts, citations and rule per requirement, by postings of bounded size that every task holds."""
    rows = postings.orderBy("profile_id", _weight().desc(), "evidence_id", "evidence_code")
    evidence = packed.pack(rows.select("profile_id", F.col("evidence_id").cast("string"), "evidence_code", "term").toArrow())
    decided_by_terms = F.when(F.col("minimum_years").isNull(), F.col("terms")).otherwise(T.empty_words())
    met = bodies.withColumn("asked", decided_by_terms).withColumn(
        "facts", packed.facts_column(evidence, CITED, "profile_id", "asked", "keyword_terms", "anchors")
    )
    found = [c for c in FACTS if c in packed.FLAGS or c in ("covered_terms", "top")]
    met = met.select(*BODY, "requirement", "category", "term_count", "minimum_years", *[F.col("facts")[c].alias(c) for c in found])
    return met.join(F.broadcast(years), "profile_id", "left").withColumn("rule", match_rules(wording_flags())).select(*DECIDED)


def many_facts(bodies: DataFrame, postings: DataFrame, years: DataFrame) -> DataFrame:
    """Facts and citations per requirement, by summaries and joins on terms."""
    outlook = materialize(requirement_outlook(bodies, materialize(term_summaries(postings), "match-summaries")), "match-outlook")
    facts = body_facts(outlook, best_evidence(outlook, postings))
    return balanced_join(facts, years, ["profile_id"], ["body_hi"], how="left", counted=bodies.select("profile_id")).select(*FACTS)


def few_facts(bodies: DataFrame, evidence: DataFrame) -> DataFrame:
    """The same for profiles of at most ``FEW`` evidence rows: a requirement meets all of them in its own row."""
    known = evidence.repartition("profile_id").select(
        "profile_id", F.struct("evidence_id", "evidence_code", evidence_term_set().alias("terms")).alias("e"), "station_years", "skill_years"
    ).groupBy("profile_id").agg(F.collect_list("e").alias("rows"), *_longest())
    known = materialize(known, "match-known")
    if evidence.count() <= FEW_ROWS:
        met = dealt_bodies(bodies).join(F.broadcast(known), "profile_id", "left")
    else:
        met = balanced_join(bodies, known, ["profile_id"], ["body_hi"], how="left")

    def pair(e: Column) -> Column:
        """Terms that a row shares with the requirement, and what follows from them."""
        return T.let(
            F.array_intersect("terms", e["terms"]),
            lambda shared: T.let(
                F.struct(
                    F.size(shared).alias("overlap"),
                    F.arrays_overlap(shared, F.col("keyword_terms")).alias("keyword"),
                    F.arrays_overlap(shared, F.col("anchors")).alias("anchor"),
                ),
                lambda p: F.struct(
                    # in the order of citations
                    (~((p["overlap"] * 5 >= F.col("term_count")) | (p["overlap"] >= 2) | p["keyword"])).alias("aside"),
                    (-_weight(e["evidence_code"])).alias("lightness"), (-p["overlap"]).alias("short_of"), e["evidence_id"].alias("evidence_id"),
                    _context(e["evidence_code"]).alias("context"), _nationality(e["evidence_code"]).alias("nationality"),
                    p["keyword"].alias("keyword"), p["anchor"].alias("anchor"), shared.alias("shared"),
                ),
            ),
        )

    decided_by_terms = F.when(F.col("minimum_years").isNull(), F.col("rows"))
    rows = F.coalesce(decided_by_terms, F.array().cast(known.schema["rows"].dataType))
    pairs = F.filter(F.transform(rows, pair), lambda p: p["short_of"] < 0)
    met = met.select(*BODY, "term_count", "minimum_years", *FLAGS, "station_years", "skill_years", F.sort_array(pairs).alias("pairs"))

    def any_pair(condition) -> Column:
        return F.exists("pairs", condition)

    def professional(p: Column) -> Column:
        return p["context"] == 1

    top = F.transform(
        F.slice("pairs", 1, CITED),
        lambda p, i: F.struct(
            (i + 1).alias("rank"), p["evidence_id"].cast("string").alias("evidence_id"), p["context"].alias("context"), (~p["aside"]).alias("relevant")
        ),
    )
    ids = F.transform("pairs", lambda p: p["evidence_id"])
    return met.withColumns({
        "covered_terms": F.size(F.array_distinct(F.flatten(F.transform("pairs", lambda p: p["shared"])))).cast("long"),
        "several_rows": F.coalesce(F.array_min(ids) != F.array_max(ids), F.lit(False)),
        "keyword_hit": any_pair(lambda p: p["keyword"]),
        "professional_alternative": any_pair(lambda p: p["anchor"] & professional(p)),
        "any_professional": any_pair(professional),
        "any_nationality": any_pair(lambda p: p["nationality"]),
        "any_relevant": any_pair(lambda p: ~p["aside"]),
        "relevant_professional": any_pair(lambda p: ~p["aside"] & professional(p)),
        "relevant_nationality": any_pair(lambda p: ~p["aside"] & p["nationality"]),
        "top": top,
    }).select(*FACTS)


def _written(bodies: DataFrame) -> DataFrame:
    """Requirements that are read several times; each text is tokenized once."""
    return materialize(bodies.select(*BODY, *TERM_COLUMNS, *FLAGS), "match-bodies")


def _decided(facts: DataFrame) -> DataFrame:
    return facts.withColumn("rule", match_rules()).select(*DECIDED)


def _of_many(bodies: DataFrame, evidence: DataFrame) -> DataFrame:
    """Decided requirements of profiles of much evidence."""
    postings = evidence.select("profile_id", "evidence_id", "evidence_code", F.explode(evidence_term_set()).alias("term"))
    postings = materialize(postings, "match-postings")
    years = evidence.groupBy("profile_id").agg(*_longest())
    if postings.count() <= PACKED:
        return packed_facts(bodies, postings, years)
    return _decided(many_facts(_written(bodies), postings, years))


def evaluate_bodies(requirements: DataFrame, evidence: DataFrame, as_of: Column) -> DataFrame:
    """Decision per distinct requirement of a profile, from written requirements."""
    # whole texts, since terms are cut where evidence is dealt evenly
    evidence = materialize(evidence.select(
        "profile_id", "evidence_id", evidence_code().alias("evidence_code"), *documented_years(as_of), "evidence_text", "keywords",
    ), "match-evidence")
    counts = evidence.groupBy("profile_id").agg(F.count(F.lit(1)).alias("n_rows"))
    many = materialize(counts.where(F.col("n_rows") > FEW).select("profile_id"), "match-many")
    if many.isEmpty():
        decided = _decided(few_facts(_written(requirement_bodies(requirements)), evidence))
    else:
        # parted before texts are tokenized
        part = {how: [_of(rows, many, how) for rows in (requirements, evidence)] for how in ("left_anti", "left_semi")}
        decided = _of_many(requirement_bodies(part["left_semi"][0]), part["left_semi"][1])
        if not part["left_anti"][0].isEmpty():
            few = _written(requirement_bodies(part["left_anti"][0]))
            decided = decided.unionByName(_decided(few_facts(few, part["left_anti"][1])))
    rule = F.col("rule")
    explanation, action = match_texts(rule)
    cites = rule.isin("eligibility", "professional", "context_components", "context_transferable",
                      "partial", "transferable")
    # irrelevant rows are cited only when nothing relevant was found
    kept = F.filter("top", lambda e: cites & (e["relevant"] | ~F.col("any_relevant")))
    cited = F.transform(
        kept,
        lambda e: F.struct(
            e["evidence_id"].alias("evidence_id"),
            F.get(T.word_list(CONTEXTS), e["context"] - 1).alias("context"),
        ),
    )
    contexts = F.array_join(F.array_sort(F.array_distinct(F.col("cited")["context"])), ", ")
    return (
        decided.withColumn("match_level", match_level(rule))
        .withColumn("confidence", confidence(rule))
        .withColumn("explanation", explanation)
        .withColumn("recommended_action", action)
        .withColumn("cited", cited)
        .withColumn(
            "profile_source",
            F.when(rule.isin("years_met", "years_short"), "professional")
            .when(F.size("cited") > 0, contexts).otherwise("none"),
        )
        .select(*BODY, "rule", "match_level", "confidence", "covered_terms", "term_count",
                "cited", "profile_source", "explanation", "recommended_action")
    )


def evaluate_matching(
    requirements: DataFrame, evidence: DataFrame, as_of: Column | None = None
) -> DataFrame:
    """One match per requirement row (M1)."""
    as_of = F.current_date() if as_of is None else as_of
    keep = ["job_id", "profile_id", "requirement_id", "requirement", "category", "priority"]
    # written, because they meet their bodies again and may come straight from the extraction of texts
    requirements = materialize(with_body_id(requirements.select(*keep, "keywords", "normalized_value")), "match-requirements")
    decided = evaluate_bodies(requirements, evidence, as_of)
    gap = F.when(F.col("match_level") == "gap", F.col("requirement"))
    # a sentence that very many ads copy is one body
    copies = balanced_join(requirements.select(*keep, *BODY[1:]), decided, BODY, ["job_id", "requirement_id"])
    return copies.drop("body_hi", "body_lo").withColumn("gap", gap)


def match_citations(matches: DataFrame, evidence: DataFrame) -> DataFrame:
    """Cited evidence of every match, one row each (M1).

    Rules on terms cite their best rows; rules on skill years cite every row of the profile that documents
    the highest years, as many as there are.
    """
    keys = ["job_id", "profile_id", "requirement_id"]
    by_terms = matches.select(*keys, F.inline("cited"))
    by_years = matches.where(F.col("rule").isin("years_met", "years_short")).select(*keys)
    best = skill_year_citations(evidence).select(
        "profile_id", F.col("evidence_id").cast("string").alias("evidence_id"), F.lit("professional").alias("context")
    )
    joined = balanced_join(by_years, best, ["profile_id"], ["job_id", "requirement_id"], spread_right_by=["evidence_id"])
    return by_terms.unionByName(joined)


# --- sinks ------------------------------------------------------------------------

def new_sources(evidence: DataFrame, stored: DataFrame) -> DataFrame:
    """Source texts not yet stored, once per content hash."""
    hashed = evidence.select(
        T.content_hash(F.col("source_content")).alias("content_hash"),
        F.col("source_name").alias("name"), "source_type", F.col("source_content").alias("content"),
        "evidence_id",
    )
    fresh = hashed.join(stored.select("content_hash"), "content_hash", "left_anti")
    first = F.min_by(F.struct("name", "source_type", "content"), "evidence_id").alias("s")
    return fresh.groupBy("content_hash").agg(first).select("content_hash", "s.*")


def new_evidence(evidence: DataFrame, stored: DataFrame) -> DataFrame:
    """Evidence not yet stored, once per source, label and text."""
    key = ["content_hash", "label", "evidence_text"]
    hashed = evidence.withColumn("content_hash", T.content_hash(F.col("source_content")))
    fresh = hashed.join(stored.select(*key), key, "left_anti")
    first = F.min_by(F.struct("experience_context", "keywords"), "evidence_id").alias("s")
    return fresh.groupBy(*key).agg(first).select(
        *key, "s.*", T.stable_id(*[F.col(k) for k in key]).alias("evidence_key")
    )


def replace_scope(stored: DataFrame, fresh: DataFrame, scope: DataFrame) -> DataFrame:
    """Stored matches with every (job, profile) of the scope replaced by the fresh set."""
    keys = ["job_id", "profile_id"]
    return stored.join(scope.select(*keys).distinct(), keys, "left_anti").unionByName(fresh)
