"""Queries on requirement-to-evidence matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from fitweave.functions import terms as M
from fitweave.functions import text as T
from fitweave.operators import matching as X
from fitweave.operators import scoring as S
from fitweave.plans import bindings as B
from fitweave.plans.registry import Tables, query
from fitweave.session import materialize, scratch_path
from fitweave.sources.tables import touched_buckets, write_matches
from fitweave import vocab

AS_OF = "2024-06-30"

TERMS_CTE = f"""{B.REQUIREMENTS}, {B.EVIDENCE},
bodies as (select distinct requirement from requirements),
body_terms as (select requirement, terms, len(terms) as n from (
  select requirement, {B.terms_sql('requirement')} as terms from bodies)),
req_terms as (select requirement, n, unnest(terms) as term from body_terms),
ev_terms as (select evidence_id, experience_context as context, unnest(ts) as term from (
  select evidence_id, experience_context, {B.terms_sql('evidence_text')} as ts from evidence)),
pairs as (select requirement, evidence_id, any_value(context) as context, any_value(n) as n, count(*) as overlap
  from req_terms join ev_terms using (term) group by requirement, evidence_id),
weighed as (select *, case context when 'professional' then 1.0 when 'project' then 0.9 when 'training' then 0.8
    else 0.5 end as weight, overlap * 5 >= n or overlap >= 2 as relevant from pairs),
covered as (select requirement, count(*) as c from req_terms
  where term in (select term from ev_terms) group by requirement),
ranked as (select *, row_number() over (partition by requirement
    order by relevant desc, weight desc, overlap desc, evidence_id) as rk,
  bool_or(relevant) over (partition by requirement) as any_relevant from weighed),
flags as (select requirement, bool_or(relevant) as any_relevant, count(*) as scored,
  bool_or(context = 'professional') filter (where relevant) as rel_prof,
  bool_or(context = 'professional') as any_prof from weighed group by requirement),
top as (select requirement,
    string_agg(cast(evidence_id as varchar), ',' order by rk) as cited,
    list_sort(list_distinct(list(context))) as contexts
  from ranked where rk <= 3 and (relevant or not any_relevant) group by requirement)"""

NOT_WORD = "[^\\p{L}\\p{N}_]"
_SOFT = f"(?i)(?:^|{NOT_WORD})(?:{'|'.join(vocab.SOFT_SKILL_STEMS)})"
_CONTEXT = f"(?i)(?:^|{NOT_WORD})(?:production|professional)(?:{NOT_WORD}|$)"

# The prose has no years wording, keywords, nationality or or/oder words with hits other
# than the rules below; alternatives are handled by neighbour lookup.
MATCH_CTE = f"""{TERMS_CTE},
toks as (select requirement, regexp_extract_all(lower(requirement), '[A-Za-zÀ-ÖØ-öø-ÿ0-9+#.]{{2,}}') as tk from bodies),
anchors as (select distinct requirement, a as term from (
    select requirement, unnest(list_filter(tk, lambda x, i: (i > 1 and tk[i-1] in ('or','oder'))
      or (i < len(tk) and tk[i+1] in ('or','oder')))) as a from toks
    where regexp_matches(requirement, '(?i)(?:^|{NOT_WORD})(?:or|oder)(?:{NOT_WORD}|$)'))
  where a not in ({B.sql_words(vocab.MATCH_STOPWORDS)})),
alternative as (select distinct r.requirement from req_terms r
  join anchors a on a.requirement = r.requirement and a.term = r.term
  join ev_terms e on e.term = r.term and e.context = 'professional'),
facts as (select b.requirement, b.n, coalesce(c.c, 0) as c, f.any_relevant, f.scored, t.cited, t.contexts,
    case when f.any_relevant then f.rel_prof else f.any_prof end as prof,
    a.requirement is not null as alt,
    regexp_matches(b.requirement, '{_SOFT}') as soft, regexp_matches(b.requirement, '{_CONTEXT}') as ctx,
    cast(coalesce(c.c, 0) as double) / nullif(b.n, 0) as share
  from body_terms b left join covered c using (requirement) left join flags f using (requirement)
  left join top t using (requirement) left join alternative a on a.requirement = b.requirement),
decided as (select *, case
    when n = 0 then 'no_terms'
    when c = 0 and soft then 'soft_unmatched'
    when c = 0 then 'unmatched'
    when not any_relevant and not alt and share < 0.35 then case when soft then 'soft_incidental' else 'incidental' end
    when alt or (prof and share >= 0.6) then 'professional'
    when ctx and not prof then case when share >= 0.2 and scored >= 2 then 'context_components'
      else 'context_transferable' end
    when prof or share >= 0.35 then 'partial' else 'transferable' end as rule from facts),
levels as (select requirement, rule, c, n,
    case when rule = 'professional' then 'strong_match' when rule in ('context_components','partial') then 'partial_match'
      when rule in ('context_transferable','transferable') then 'transferable'
      when rule in ('unmatched','incidental') then 'gap' else 'unknown' end as match_level,
    case rule when 'no_terms' then 0.2::double when 'soft_unmatched' then 0.3::double when 'soft_incidental' then 0.3::double
      when 'unmatched' then 0.9::double when 'incidental' then 0.85::double
      else least(95, (((case when prof then 60 else 50 end) * n + 45 * c) * 2 + n) // (2 * n)) / 100.0::double end
      as confidence,
    case when rule in ('professional','context_components','context_transferable','partial','transferable')
      then cited else '' end as cited,
    case when rule in ('professional','context_components','context_transferable','partial','transferable')
      then array_to_string(contexts, ', ') else 'none' end as profile_source
  from decided),
matches as (select r.job_id, r.requirement_id, r.priority, l.* from requirements r join levels l using (requirement))"""


def matches(t: Tables):
    return X.evaluate_matching(
        B.document_requirements(t), B.benchmark_evidence(t), F.lit(AS_OF).cast("date")
    )


@query("m1_evaluate_matching", f"""with {MATCH_CTE}
select requirement_id, rule, match_level, confidence, cited, profile_source from matches""")
def m1(t: Tables):
    return matches(t).select(
        "requirement_id", "rule", "match_level", "confidence",
        F.array_join(F.col("cited")["evidence_id"], ",").alias("cited"), "profile_source",
    )


@query("m1_document_fit", f"""with {MATCH_CTE},
points as (select job_id, sum((case priority when 'must' then 3 when 'should' then 2 else 1 end) *
    (case match_level when 'strong_match' then 100 when 'partial_match' then 65 when 'transferable' then 40 else 0 end)) as h,
  sum(case priority when 'must' then 3 when 'should' then 2 else 1 end) as p, count(*) as requirement_count,
  count(*) filter (where priority = 'must' and match_level in ('gap','unknown')) as must_gaps
  from matches group by job_id)
select job_id, cast(round_even(cast(h as double) / p, 0) as int) as score, requirement_count, must_gaps from points""")
def m1_fit(t: Tables):
    return S.qualification_fit(matches(t)).select("job_id", "score", "requirement_count", "must_gaps")


@query("a15_profile_source", f"""with {MATCH_CTE}
select profile_source, count(*) as n from matches group by profile_source""")
def a15(t: Tables):
    return matches(t).groupBy("profile_source").agg(F.count(F.lit(1)).alias("n"))


def _inputs(t: Tables):
    """Bodies with the digest of their text, and terms of evidence; each text is tokenized once."""
    bodies = X.requirement_bodies(B.document_requirements(t)).withColumn("requirement_hash", F.sha2("requirement", 256))
    bodies = materialize(bodies.drop("requirement", "category", "keywords", "normalized_value"), "bodies")
    return bodies, materialize(X.evidence_terms(B.benchmark_evidence(t)), "match-evidence")


def _with_hash(rows, bodies):
    # the bodies of a task are few, so they are hashed and the many rows beside them not sorted
    return rows.join(bodies.select(*X.BODY, "requirement_hash").hint("shuffle_hash"), X.BODY)


@query("j5_term_overlap_join", f"""with {TERMS_CTE}
select sha256(requirement) as requirement_hash, evidence_id, overlap, relevant from weighed""")
def j5(t: Tables):
    bodies, evidence = _inputs(t)
    bodies = X.dealt_bodies(bodies)
    return _with_hash(X.overlap_pairs(X.body_terms(bodies), evidence), bodies).select(
        "requirement_hash", "evidence_id", "overlap", "relevant"
    )


@query("a03_union_overlap", f"""with {TERMS_CTE}
select sha256(requirement) as requirement_hash, c as covered_terms, n as term_count
from covered join body_terms using (requirement)""")
def a03(t: Tables):
    bodies, evidence = _inputs(t)
    bodies = X.dealt_bodies(bodies)
    covered = X.coverage(X.body_terms(bodies), evidence).where(F.col("covered_terms") > 0)
    return _with_hash(covered, bodies).select("requirement_hash", "covered_terms", "term_count")


@query("w2_rank_evidence", f"""with {TERMS_CTE}
select sha256(requirement) as requirement_hash, evidence_id, rk as rank from ranked where rk <= 3""")
def w2(t: Tables):
    bodies, evidence = _inputs(t)
    summaries = materialize(X.term_summaries(evidence), "match-summaries")
    outlook = materialize(X.requirement_outlook(bodies, summaries), "match-outlook")
    return _with_hash(X.best_evidence(outlook, evidence), bodies).select("requirement_hash", "evidence_id", "rank")


@query("f01_terms", f"""
select doc_id, array_to_string(list_sort({B.terms_sql('text')}), ' ') as terms from documents""")
def f01(t: Tables):
    return t.documents.select(
        "doc_id", F.array_join(F.array_sort(M.term_set(F.col("text"))), " ").alias("terms")
    )


@query("f02_alternative_anchor_terms", f"""
select doc_id, array_to_string(list_sort(list_distinct(list_filter(list_filter(tk, lambda x, i:
    (i > 1 and tk[i-1] in ('or','oder')) or (i < len(tk) and tk[i+1] in ('or','oder'))),
  lambda w: w not in ({B.sql_words(vocab.MATCH_STOPWORDS)})))), ' ') as anchors
from (select doc_id, regexp_extract_all(lower(replace(text, ' and ', ' or ')), '[A-Za-zÀ-ÖØ-öø-ÿ0-9+#.]{{2,}}') as tk
  from documents)""")
def f02(t: Tables):
    worded = F.replace("text", F.lit(" and "), F.lit(" or "))
    return t.documents.select(
        "doc_id", F.array_join(F.array_sort(M.alternative_anchors(worded)), " ").alias("anchors")
    )


@query("u3_term_set_operations", f"""
select doc_id, len(list_intersect(a, b)) as shared, len(list_distinct(list_concat(a, b))) as together,
  len(list_filter(a, lambda x: not list_contains(b, x))) as only_first
from (select doc_id, {B.terms_sql("substr(text, 1, length(text) // 2)")} as a,
  {B.terms_sql("substr(text, length(text) // 2 + 1)")} as b from documents)""")
def u3(t: Tables):
    half = F.floor(F.length("text") / 2).cast("int")
    sets = t.documents.select(
        "doc_id",
        M.term_set(F.expr("substring(text, 1, cast(length(text) div 2 as int))")).alias("a"),
        M.term_set(F.expr("substring(text, cast(length(text) div 2 as int) + 1)")).alias("b"),
    )
    return sets.select(
        "doc_id", F.size(F.array_intersect("a", "b")).alias("shared"),
        F.size(F.array_union("a", "b")).alias("together"),
        F.size(F.array_except("a", "b")).alias("only_first"),
    )


@query("f14_content_hash", "select doc_id, sha256(text) as content_hash from documents")
def f14(t: Tables):
    return t.documents.select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))


@query("f18_requirement_predicates", f"""with {B.REQUIREMENTS}
select requirement_id, regexp_matches(r, '{_SOFT}') as is_soft, regexp_matches(r, '{_CONTEXT}') as needs_context,
  regexp_matches(r, '(?i)(?:^|{NOT_WORD})(?:{'|'.join(vocab.ELIGIBILITY_STEMS)})') as is_eligibility
from (select requirement_id, replace(replace(replace(requirement, 'the ', 'professional '), ' de ', ' Kommunikation '),
  ' der ', ' NATO-') as r from requirements)""")
def f18(t: Tables):
    text = F.col("requirement")
    for old, new in (("the ", "professional "), (" de ", " Kommunikation "), (" der ", " NATO-")):
        text = F.replace(text, F.lit(old), F.lit(new))
    rows = B.document_requirements(t).select("requirement_id", text.alias("r"))
    return rows.select(
        "requirement_id", M.is_soft_skill(F.lit(""), F.col("r")).alias("is_soft"),
        M.needs_work_context(F.col("r")).alias("needs_context"), M.is_eligibility(F.col("r")).alias("is_eligibility"),
    )


# --- sinks ------------------------------------------------------------------------

def _registry_inputs(t: Tables):
    contexts = ["professional", "project", "training", "education", "other"]
    incoming = t.documents.select(
        F.col("doc_id").alias("evidence_id"),
        F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("source_name"),
        F.lit("manual").alias("source_type"), F.col("text").alias("source_content"),
        F.col("lang").alias("label"), F.col("text").alias("evidence_text"),
        F.get(T.word_list(contexts), (F.col("doc_id") % 5).cast("int")).alias("experience_context"),
        T.empty_words().alias("keywords"),
    )
    stored = t.documents.join(t.labels.where("toxic = 1"), "doc_id", "left_semi").select(
        F.sha2("text", 256).alias("content_hash"), F.col("lang").alias("label"),
        F.col("text").alias("evidence_text"),
    )
    return incoming, stored


@query("s07_evidence_registry_sources", """
with stored as (select distinct sha256(text) as h from documents where doc_id in (select doc_id from labels where toxic = 1))
select sha256(text) as content_hash, concat('doc:', cast(min(doc_id) as varchar)) as name
from documents where sha256(text) not in (select h from stored) group by 1""")
def s07_sources(t: Tables):
    incoming, stored = _registry_inputs(t)
    return X.new_sources(incoming, stored).select("content_hash", "name")


@query("s07_evidence_registry_rows", """
with stored as (select distinct sha256(text) as h, lang from documents
  where doc_id in (select doc_id from labels where toxic = 1)),
fresh as (select *, row_number() over (partition by sha256(text), lang order by doc_id) as rn from documents d
  where not exists (select 1 from stored s where s.h = sha256(d.text) and s.lang = d.lang))
select sha256(text) as content_hash, lang as label,
  case doc_id % 5 when 0 then 'professional' when 1 then 'project' when 2 then 'training' when 3 then 'education'
    else 'other' end as experience_context
from fresh where rn = 1""")
def s07_rows(t: Tables):
    incoming, stored = _registry_inputs(t)
    return X.new_evidence(incoming, stored).select("content_hash", "label", "experience_context")


REPLACED = f"""with {B.SCORED},
scope as (select distinct o_orderkey as job_id from orders where o_orderstatus = 'P')
select job_id, requirement_id, priority, match_level from scored where job_id not in (select job_id from scope)
union all
select l_orderkey, l_linenumber, 'must', 'strong_match' from lineitem
where l_orderkey in (select job_id from scope) and l_quantity > 25"""


def _replacement(t: Tables):
    """Stored matches, fresh ones, and the pairs whose matches they replace."""
    scope = t.orders.where("o_orderstatus = 'P'").select(
        F.col("o_orderkey").alias("job_id"), F.lit("p0").alias("profile_id")
    )
    stored = B.scored_matches(t).select("job_id", "profile_id", "requirement_id", "priority", "match_level")
    fresh = (
        t.lineitem.where("l_quantity > 25")
        .select(F.col("l_orderkey").alias("job_id"), F.lit("p0").alias("profile_id"),
                F.col("l_linenumber").alias("requirement_id"), F.lit("must").alias("priority"),
                F.lit("strong_match").alias("match_level"))
        .join(scope, ["job_id", "profile_id"], "left_semi")
    )
    return stored, fresh, scope


@query("s08_replace_matches", REPLACED)
def s08(t: Tables):
    return X.replace_scope(*_replacement(t)).drop("profile_id")


@query("s08_written_matches", REPLACED)
def s08_written(t: Tables):
    """The same through the sink: stored matches are written, then the touched buckets are replaced."""
    stored, fresh, scope = _replacement(t)
    folder = scratch_path(t.spark, "matches")
    write_matches(stored, folder, buckets=8)
    table = t.spark.read.parquet(folder)
    replaced = X.replace_scope(touched_buckets(table, scope, buckets=8).drop("bucket"), fresh, scope)
    # read to the end before the folder it comes from is overwritten
    write_matches(materialize(replaced, "replaced-matches"), folder, buckets=8)
    return t.spark.read.parquet(folder).drop("profile_id", "bucket")
