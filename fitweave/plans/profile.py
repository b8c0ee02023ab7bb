"""Queries on profile resources, evidence and preferences."""

from __future__ import annotations

from pyspark.sql import functions as F

from fitweave import vocab
from fitweave.functions import dates
from fitweave.functions import terms as M
from fitweave.functions import text as T
from fitweave.operators import cv as C
from fitweave.operators import matching as X
from fitweave.operators import profile as P
from fitweave.operators import ranking
from fitweave.operators import structure as ST
from fitweave.plans import bindings as B
from fitweave.plans.corpus import AD_ITEMS, REQUIREMENT_ROWS, has
from fitweave.plans.registry import Tables, query

AS_OF = "2005-01-01"


def _as_of():
    return F.lit(AS_OF).cast("date")


def _loc(title, summary, bullets, when):
    entry = F.struct(
        F.lit("de").alias("language"), title.alias("title"), summary.cast("string").alias("summary"),
        bullets.alias("bullets"),
    )
    return F.filter(F.array(F.when(when, entry)), lambda e: e.isNotNull())


def resources(t: Tables):
    nation = F.col("c_nationkey") % 5
    profiles = t.customer.select(
        F.col("c_custkey").alias("profile_id"),
        F.when(nation == 0, "deutsch").when(nation == 1, " Germany ").when(nation == 2, "Französisch")
        .when(nation == 3, " ").alias("nationality"),
    )
    start = F.col("o_orderdate").cast("date")
    experiences = t.orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("profile_id"),
        F.concat(F.lit("Firma "), "o_orderpriority").alias("company"), start.alias("start_date"),
        F.when(F.col("o_orderstatus") != "O", F.date_add(start, 400)).alias("end_date"),
        _loc(F.concat(F.lit("Entwickler "), "o_orderstatus"), F.lit("Zusammenfassung"), F.array(F.lit("Punkt")),
             F.col("o_orderstatus") == "F").alias("localizations"),
    )
    even = F.col("p_size") % 2 == 0
    projects = t.part.select(
        F.col("p_partkey").alias("id"), F.col("p_partkey").alias("profile_id"), F.col("p_name").alias("canonical_name"),
        F.when(even, F.col("p_type")).alias("role"), F.array("p_brand", F.lit("SQL")).alias("technologies"),
        F.when(F.col("p_size") % 3 == 0, "https://git.example/x").alias("repository_url"),
        _loc(F.concat("p_name", F.lit(" Projekt")), F.lit(None), F.array("p_type"), even).alias("localizations"),
    )
    education = t.supplier.select(
        F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("profile_id"), F.col("s_name").alias("institution"),
        _loc(F.lit("M.Sc."), F.lit("Statistik"), T.empty_words(), F.col("s_nationkey") > 10).alias("localizations"),
    )
    certificates = t.nation.select(
        F.col("n_nationkey").alias("id"), F.col("n_nationkey").cast("long").alias("profile_id"),
        F.col("n_name").alias("official_name"), F.lit("Issuer").alias("issuer"),
        _loc(F.lit("x"), F.lit(None), T.empty_words(), F.lit(False)).alias("localizations"),
    )
    return profiles, experiences, projects, education, certificates


def skill_tables(t: Tables):
    size, part = F.col("p_size"), F.col("p_partkey")
    skills = t.part.select(
        part.alias("skill_id"), part.alias("profile_id"), F.col("p_name").alias("canonical_name"),
        F.array("p_type").alias("aliases"),
    )
    kind = size % 5
    links = t.part.select(
        part.alias("link_id"), part.alias("skill_id"), (part + F.when(size % 7 == 0, 1).otherwise(0)).alias("profile_id"),
        F.when(kind == 0, "experience").when(kind == 1, "project").when(kind == 2, "certificate")
        .when(kind == 3, "education").otherwise("manual_training").alias("kind"),
        F.when(kind == 0, part * 3).when(kind == 1, part).when(kind.isin(2, 3), size.cast("long"))
        .when(size % 3 == 0, size.cast("long")).cast("string").alias("source_id"),
        F.when(size % 2 == 0, F.col("p_brand")).otherwise("").alias("evidence_text"),
        F.when(kind == 0, "professional").otherwise("training").alias("experience_context"),
    )
    return skills, links


LINKS = """links as (select p_partkey as link_id, p_partkey as skill_id, p_partkey + case when p_size % 7 = 0 then 1 else 0 end as profile_id,
    case p_size % 5 when 0 then 'experience' when 1 then 'project' when 2 then 'certificate' when 3 then 'education'
      else 'manual_training' end as kind,
    cast(case when p_size % 5 = 0 then p_partkey * 3 when p_size % 5 = 1 then p_partkey when p_size % 5 in (2, 3) then p_size
      when p_size % 3 = 0 then p_size end as varchar) as source_id,
    case when p_size % 2 = 0 then p_brand else '' end as evidence_text,
    case when p_size % 5 = 0 then 'professional' else 'training' end as experience_context, p_name, p_type from part),
sources as (
  select 'experience' as kind, cast(o_orderkey as varchar) as source_id, o_custkey as owner, concat('Firma ', o_orderpriority) as lab,
    cast(o_orderdate as date) as st, case when o_orderstatus <> 'O' then cast(o_orderdate as date) + 400 end as en from orders
  union all select 'project', cast(p_partkey as varchar), p_partkey, p_name, null, null from part
  union all select 'certificate', cast(n_nationkey as varchar), n_nationkey, n_name, null, null from nation
  union all select 'education', cast(s_suppkey as varchar), s_suppkey, s_name, null, null from supplier)"""
LINKED = f"""linked as (select l.skill_id as profile_id, concat('profile:', cast(l.skill_id as varchar), ':skill-evidence:', cast(link_id as varchar)) as source_name,
    'manual' as source_type, concat(p_name, ' · ', coalesce(lab, 'Manuelles Training')) as label,
    concat_ws(chr(10), concat('Skill: ', p_name), concat('Quelle: ', coalesce(lab, 'Manuelles Training')), nullif(evidence_text, '')) as evidence_text,
    experience_context, concat(p_name, '|', p_type) as keywords,
    case when l.kind = 'experience' then round(greatest(0, date_diff('day', st, coalesce(en, date '{AS_OF}')) / 365.25::double), 2) end as years
  from links l left join sources s on s.kind = l.kind and s.source_id = l.source_id
  where lab is not null or l.kind = 'manual_training')"""


def _linked(t: Tables):
    _, experiences, projects, education, certificates = resources(t)
    skills, links = skill_tables(t)
    sources = P.link_sources(experiences, projects, certificates, education)
    return P.linked_skill_evidence(links.drop("profile_id"), skills, sources, _as_of())


@query("j04_linked_skill_evidence", f"with {LINKS}, {LINKED} select * from linked")
def j04(t: Tables):
    years = F.get_json_object("source_content", "$.years_experience").cast("double")
    return _linked(t).select(
        "profile_id", "source_name", "source_type", "label", "evidence_text", "experience_context",
        F.array_join("keywords", "|").alias("keywords"), years.alias("years"),
    )


@query("j13_validate_links", f"""with {LINKS}
select link_id, case when l.profile_id <> l.skill_id then 'skill_not_found'
  when l.kind = 'manual_training' and l.source_id is not null then 'manual_training_with_source'
  when l.kind <> 'manual_training' and s.owner is distinct from l.profile_id then 'source_not_found' end as reject_reason
from links l left join sources s on s.kind = l.kind and s.source_id = l.source_id""")
def j13(t: Tables):
    _, experiences, projects, education, certificates = resources(t)
    skills, links = skill_tables(t)
    sources = P.link_sources(experiences, projects, certificates, education)
    return P.validate_links(links, skills, sources).select("link_id", "reject_reason")


_DE = " ".join(vocab.GERMAN_STATEMENTS)
NATIONALITY = f"""nat as (select c_custkey as profile_id, trim(n) as n, lower(trim(n)) in ({B.sql_words(vocab.GERMAN_NATIONALITIES)}) as de from (
    select c_custkey, case c_nationkey % 5 when 0 then 'deutsch' when 1 then ' Germany ' when 2 then 'Französisch' when 3 then ' ' end as n
    from customer) where trim(n) <> ''),
nationality as (select profile_id, concat('profile:', cast(profile_id as varchar), ':nationality') as source_name, 'manual' as source_type,
    'Staatsangehörigkeit' as label, concat('Im Profil hinterlegte Staatsangehörigkeit: ', n, '.', case when de then ' {_DE}' else '' end) as evidence_text,
    'other' as experience_context,
    concat_ws('|', n, '{"|".join(vocab.NATIONALITY_KEYWORDS)}', case when de then '{"|".join(vocab.GERMAN_KEYWORDS)}' end) as keywords from nat)"""
_SHOWN = ["profile_id", "source_name", "source_type", "label", "evidence_text", "experience_context"]


@query("f17_nationality_evidence", f"with {NATIONALITY} select * from nationality")
def f17(t: Tables):
    return P.nationality_evidence(resources(t)[0]).select(*_SHOWN, F.array_join("keywords", "|").alias("keywords"))


EVIDENCE_UNION = f"""{NATIONALITY}, {LINKS}, {LINKED},
exp as (select o_custkey as profile_id, concat('profile:', cast(o_custkey as varchar), ':experience:', cast(o_orderkey as varchar)) as source_name,
    'manual' as source_type, concat(case when o_orderstatus = 'F' then 'Entwickler F' else 'Berufserfahrung' end, ' · Firma ', o_orderpriority) as label,
    concat_ws(chr(10), concat('Berufserfahrung bei Firma ', o_orderpriority, ', ', cast(cast(o_orderdate as date) as varchar), ' bis ',
      case when o_orderstatus <> 'O' then cast(cast(o_orderdate as date) + 400 as varchar) else 'heute' end),
      case when o_orderstatus = 'F' then concat('Entwickler F', chr(10), 'Zusammenfassung', chr(10), 'Punkt') end) as evidence_text,
    'professional' as experience_context, concat_ws('|', concat('Firma ', o_orderpriority), case when o_orderstatus = 'F' then 'Entwickler F' end) as keywords
  from orders),
proj as (select p_partkey as profile_id, concat('profile:', cast(p_partkey as varchar), ':project:', cast(p_partkey as varchar)) as source_name,
    case when p_size % 3 = 0 then 'github' else 'portfolio' end as source_type,
    case when p_size % 2 = 0 then concat(p_name, ' Projekt') else p_name end as label,
    concat_ws(chr(10), concat('Portfolio-Projekt ', p_name, '; Rolle: ', case when p_size % 2 = 0 then p_type else 'nicht angegeben' end,
      '; Technologien: ', p_brand, ', SQL'), case when p_size % 2 = 0 then concat(p_name, ' Projekt', chr(10), p_type) end) as evidence_text,
    'project' as experience_context,
    concat_ws('|', p_name, case when p_size % 2 = 0 then p_type end, p_brand, 'SQL', case when p_size % 2 = 0 then concat(p_name, ' Projekt') end) as keywords
  from part),
edu as (select s_suppkey as profile_id, concat('profile:', cast(s_suppkey as varchar), ':education:', cast(s_suppkey as varchar)) as source_name, 'manual' as source_type,
    concat(case when s_nationkey > 10 then 'M.Sc.' else 'Ausbildung' end, ' · ', s_name) as label,
    concat_ws(chr(10), concat('Ausbildung bei ', s_name), case when s_nationkey > 10 then concat('M.Sc.', chr(10), 'Statistik') end) as evidence_text,
    'education' as experience_context, concat_ws('|', s_name, case when s_nationkey > 10 then 'M.Sc.' end) as keywords from supplier),
cert as (select n_nationkey as profile_id, concat('profile:', cast(n_nationkey as varchar), ':certificate:', cast(n_nationkey as varchar)) as source_name,
    'certificate' as source_type, concat(n_name, ' · Issuer') as label, concat('Zertifikat ', n_name, ', ausgestellt von Issuer') as evidence_text,
    'training' as experience_context, concat(n_name, '|Issuer') as keywords from nation),
profile_evidence as (select * from nationality union all select * from exp union all select * from proj union all select * from edu
  union all select * from cert union all select profile_id, source_name, source_type, label, evidence_text, experience_context, keywords from linked)"""


def evidence(t: Tables):
    return P.profile_evidence(*resources(t), _linked(t))


@query("u1_profile_evidence_union", f"with {EVIDENCE_UNION} select * from profile_evidence")
def u1(t: Tables):
    return evidence(t).select(*_SHOWN, F.array_join("keywords", "|").alias("keywords"))


@query("u2_request_and_profile_evidence", f"""with {EVIDENCE_UNION}
select profile_id, source_name from profile_evidence
union all select doc_id, concat('doc:', cast(doc_id as varchar)) from documents""")
def u2(t: Tables):
    request = t.documents.select(
        F.col("doc_id").alias("profile_id"), F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("source_name")
    )
    return evidence(t).select("profile_id", "source_name").unionByName(request)


_STEM = "(?i)(?:^|[^\\p{L}\\p{N}_])(?:%s)"
_SOFT, _ELIGIBLE = (_STEM % "|".join(stems) for stems in (vocab.SOFT_SKILL_STEMS, vocab.ELIGIBILITY_STEMS))
_CITING = "('eligibility', 'professional', 'context_components', 'context_transferable', 'partial', 'transferable')"
# every rule of the matching on extracted requirements and the union of profile evidence
_MATCH = f"""{EVIDENCE_UNION},
ev as (select profile_id, source_name as eid, label, experience_context as context,
    case when linked_training then 0.5 else case experience_context when 'professional' then 1.0 when 'project' then 0.9
      when 'training' then 0.8 else {vocab.OTHER_CONTEXT_WEIGHT} end end as weight,
    {B.terms_sql("concat(evidence_text, ' ', replace(replace(coalesce(keywords, ''), '|', ' '), '_', ' '))")} as terms
  from (select e.*, e.source_name in (select source_name from linked join links
      on linked.source_name = concat('profile:', cast(skill_id as varchar), ':skill-evidence:', cast(link_id as varchar))
      where kind = 'manual_training') as linked_training from profile_evidence e)),
et as (select profile_id, eid, label, context, weight, unnest(terms) as term from ev),
stay as (select o_custkey as profile_id, greatest(0, max(date_diff('day', cast(o_orderdate as date),
    case when o_orderstatus <> 'O' then cast(o_orderdate as date) + 400 else date '{AS_OF}' end) / 365.25::double)) as stay
  from orders group by o_custkey),
learnt as (select profile_id, max(years) as skill from linked where experience_context = 'professional' group by profile_id),
rq as (select job_id, position, requirement, priority,
    {B.terms_sql("concat(requirement, ' ', replace(keywords, '_', ' '))")} as terms, {B.terms_sql("replace(keywords, '_', ' ')")} as kterms,
    case when {has('requirement', ['or', 'oder'])} then regexp_extract_all(lower(requirement), '[A-Za-zÀ-ÖØ-öø-ÿ0-9+#.]{{2,}}') else [] end as tk,
    try_cast(replace(regexp_extract(requirement, '{vocab.MATCH_YEARS_PATTERN.replace("(?iu)", "(?i)")}', 1), ',', '.') as double) as need,
    lower(trim(category)) = 'soft_skill' or regexp_matches(concat_ws(' ', category, requirement), '{_SOFT}') as soft, regexp_matches(requirement, '{_ELIGIBLE}') as eligible,
    {has('requirement', ['production', 'professional'])} as ctx, not {has('requirement', ['mit', 'in', 'with', 'for'])} as generic
  from reqs),
rt as (select job_id, position, unnest(terms) as term, kterms, list_filter(tk, lambda x, i: (i > 1 and tk[i-1] in ('or', 'oder'))
      or (i < len(tk) and tk[i+1] in ('or', 'oder'))) as anchors, len(terms) as n from rq where need is null),
pr as (select rt.job_id, position, eid, any_value(label) as label, any_value(context) as context, any_value(weight) as weight, any_value(n) as n,
    count(*) as overlap, bool_or(list_contains(kterms, rt.term)) as kw, bool_or(list_contains(anchors, rt.term)) as anchored
  from rt join et on et.profile_id = rt.job_id and et.term = rt.term group by rt.job_id, position, eid),
pw as (select *, overlap * 5 >= n or overlap >= 2 or kw as relevant from pr),
cov as (select job_id, position, count(*) as c from rt
  where exists (select 1 from et where et.profile_id = rt.job_id and et.term = rt.term) group by job_id, position),
fl as (select job_id, position, count(*) as scored, bool_or(kw) as kw, bool_or(anchored and context = 'professional') as alt,
    bool_or(relevant) as rel, bool_or(context = 'professional') as prof, coalesce(bool_or(context = 'professional') filter (where relevant), false) as rprof,
    bool_or(label = '{vocab.NATIONALITY_LABEL}') as nat, coalesce(bool_or(label = '{vocab.NATIONALITY_LABEL}') filter (where relevant), false) as rnat
  from pw group by job_id, position),
rk as (select *, row_number() over (partition by job_id, position order by relevant desc, weight desc, overlap desc, eid) as rk,
    bool_or(relevant) over (partition by job_id, position) as rel from pw),
tops as (select job_id, position, list_sort(list_distinct(list(context))) as contexts from rk where rk <= 3 and (relevant or not rel) group by all),
fa as (select rq.*, len(terms) as n, coalesce(c, 0) as c, coalesce(scored, 0) as scored, coalesce(fl.kw, false) as kw, coalesce(alt, false) as alt,
    coalesce(rel, false) as rel, case when rel then rprof else coalesce(prof, false) end as prof2,
    case when rel then rnat else coalesce(nat, false) end as nat2, contexts, stay, skill, coalesce(c, 0)::double / nullif(len(terms), 0) as share
  from rq left join cov using (job_id, position) left join fl using (job_id, position) left join tops using (job_id, position)
  left join stay on stay.profile_id = rq.job_id left join learnt on learnt.profile_id = rq.job_id),
ruled as (select *, case
    when need is not null and generic and stay is not null then case when stay >= need then 'years_station_met' else 'years_station_short' end
    when need is not null then case when skill is null then 'years_unknown' when skill >= need then 'years_met' else 'years_short' end
    when n = 0 then 'no_terms' when c = 0 then case when soft then 'soft_unmatched' else 'unmatched' end
    when not rel and not alt and share < 0.35 then case when soft then 'soft_incidental' else 'incidental' end
    when eligible and nat2 and share >= 0.6 then 'eligibility'
    when alt or (prof2 and share >= 0.6) then 'professional'
    when ctx and not prof2 then case when share >= 0.2 and scored >= 2 then 'context_components' else 'context_transferable' end
    when prof2 or share >= 0.35 or kw then 'partial' else 'transferable' end as rule from fa)"""


_LEVELS = f"""select job_id, position as requirement_id, requirement, priority, rule,
  case when rule in ('years_station_met', 'years_met', 'eligibility', 'professional') then 'strong_match'
    when rule in ('context_components', 'partial') then 'partial_match' when rule in ('context_transferable', 'transferable') then 'transferable'
    when rule in ('years_station_short', 'years_short', 'unmatched', 'incidental') then 'gap' else 'unknown' end as match_level,
  case when rule in ('years_station_met', 'years_station_short', 'years_met', 'years_short') then 0.95::double
    when rule in ('years_unknown', 'soft_unmatched', 'soft_incidental') then 0.3::double when rule = 'no_terms' then 0.2::double
    when rule = 'unmatched' then 0.9::double when rule = 'incidental' then 0.85::double
    else least(95, (((case when prof2 then 60 else 50 end) * n + 45 * c) * 2 + n) // (2 * n)) / 100.0::double end as confidence,
  case when rule in ('years_met', 'years_short') then 'professional'
    when rule in {_CITING} then array_to_string(contexts, ', ') else 'none' end as profile_source from ruled"""
_MATCH_OUT = ["job_id", "requirement_id", "requirement", "priority", "rule", "match_level", "confidence", "profile_source"]
_FORMS = """case c_custkey % 9 when 0 then '?!' when 1 then 'Self-motivated in glass' when 2 then 'Independent at Firma harbour timber lighting drying storage'
  when 3 then 'Staatsangehörigkeit deutsch' when 4 then 'Production SQL Portfolio' when 5 then 'Professional Zertifikat SQL Portfolio Technologien'
  when 6 then 'Firma harbour timber lighting drying storage sails' when 7 then 'Quiet hands' else 'Fortran or Berufserfahrung' end"""


@query("m1_rule_forms", f"""with reqs as (select c_custkey as job_id, 0 as position, {_FORMS} as requirement,
  case when c_custkey % 9 = 7 then 'Soft_Skill' else 'other' end as category, 'should' as priority, '' as keywords, null as normalized_value from customer),
{_MATCH} {_LEVELS}""")
def m1_forms(t: Tables):
    """Requirements worded for the rules that extracted ads do not reach."""
    requirements = t.customer.select(
        F.col("c_custkey").alias("job_id"), F.col("c_custkey").alias("profile_id"), F.lit(0).alias("requirement_id"),
        F.expr(_FORMS).alias("requirement"), F.when(F.col("c_custkey") % 9 == 7, "Soft_Skill").otherwise("other").alias("category"),
        F.lit("should").alias("priority"), T.empty_words().alias("keywords"), F.lit(None).cast("string").alias("normalized_value"),
    )
    rows = evidence(t).withColumn("evidence_id", F.col("source_name"))
    return X.evaluate_matching(requirements, rows, _as_of()).select(*_MATCH_OUT)


@query("m1_ads_against_profiles", f"with {AD_ITEMS}, {REQUIREMENT_ROWS}, {_MATCH} {_LEVELS}")
def m1_ads(t: Tables):
    """Extracted requirements of every ad against the evidence of the profile with the ad's number."""
    jobs = ST.with_structure(B.ads(t).select("job_id", "content"))
    requirements = ST.requirement_rows(jobs).select(
        "job_id", F.col("job_id").alias("profile_id"), F.col("position").alias("requirement_id"), "requirement",
        "category", "priority", "keywords", "normalized_value",
    )
    rows = evidence(t).withColumn("evidence_id", F.col("source_name"))
    return X.evaluate_matching(requirements, rows, _as_of()).select(*_MATCH_OUT)


# years of experience: a requirement per customer, skill and station rows per supplier, nations as profiles
_YEARS = f"""need as (select c_custkey as job_id, c_nationkey as profile_id, c_custkey % 13 as years, c_custkey % 3 = 0 as generic from customer),
ev as (select s_suppkey as evidence_id, s_nationkey as profile_id, s_suppkey % 7 = 3 as station,
    case when s_suppkey % 7 = 3 then null when s_suppkey % 5 <> 2 then s_suppkey % 12 end as skill,
    case when s_suppkey % 7 = 3 then datediff('day', date '2000-01-01', date '2000-01-01' + cast((s_suppkey % 4000) as int)) / 365.25 end as stay
  from supplier where s_suppkey % 4 <> 0 and s_nationkey % 6 <> 5),
top as (select profile_id, max(stay) as stay, max(skill) as skill from ev group by profile_id),
ruled as (select need.*, case when generic and stay >= years then 'years_station_met' when generic and stay is not null then 'years_station_short'
    when skill is null then 'years_unknown' when skill >= years then 'years_met' else 'years_short' end as rule
  from need left join top using (profile_id))"""


def _years_matches(t: Tables):
    number = (F.col("c_custkey") % 13).cast("string")
    generic = F.col("c_custkey") % 3 == 0
    requirements = t.customer.select(
        F.col("c_custkey").alias("job_id"), F.col("c_nationkey").alias("profile_id"), F.lit("r").alias("requirement_id"),
        F.concat(F.lit("Mindestens "), number, F.when(generic, " Jahre Berufserfahrung").otherwise(" Jahre Erfahrung mit Webrahmen"))
        .alias("requirement"),
        F.lit("experience").alias("category"), F.lit("must").alias("priority"), T.empty_words().alias("keywords"),
        F.lit(None).cast("string").alias("normalized_value"),
    )
    key = F.col("s_suppkey")
    end = F.date_add(F.lit("2000-01-01").cast("date"), (key % 4000).cast("int"))
    skill = (key % 12).cast("string")
    silent = F.col("s_nationkey") % 6 == 5  # profiles whose evidence names no years
    source = (
        F.when(silent, "{}").when(key % 7 == 3, F.concat(F.lit('{"start_date":"2000-01-01","end_date":"'), end.cast("string"), F.lit('"}')))
        .when((key % 5 != 2) & (key % 2 == 0), F.concat(F.lit('{"years_experience":'), skill, F.lit("}"))).otherwise("{}")
    )
    rows = t.supplier.select(
        F.col("s_nationkey").alias("profile_id"), key.alias("evidence_id"), source.alias("source_content"),
        F.lit("Skill").alias("label"), F.when(key % 4 == 0, "project").otherwise("professional").alias("experience_context"),
        F.when(~silent & (key % 7 != 3) & (key % 5 != 2) & (key % 2 == 1), F.concat(F.lit("Jahre: "), skill)).otherwise("Webstuhl").alias("evidence_text"),
        T.empty_words().alias("keywords"),
    )
    return X.evaluate_matching(requirements, rows, _as_of()), rows


@query("m1_years_rules", f"""with {_YEARS}
select job_id, rule, case when rule in ('years_station_met', 'years_met') then 'strong_match' when rule = 'years_unknown' then 'unknown' else 'gap' end as match_level,
  case when rule = 'years_unknown' then 0.3::double else 0.95::double end as confidence,
  case when rule in ('years_met', 'years_short') then 'professional' else 'none' end as profile_source from ruled""")
def m1_years(t: Tables):
    return _years_matches(t)[0].select("job_id", "rule", "match_level", "confidence", "profile_source")


@query("m1_years_citations", f"""with {_YEARS}
select job_id, cast(evidence_id as varchar) as evidence_id, 'professional' as context from ruled join top using (profile_id)
join ev on ev.profile_id = ruled.profile_id and ev.skill = top.skill where rule in ('years_met', 'years_short')""")
def m1_years_citations(t: Tables):
    return X.match_citations(*_years_matches(t)).select("job_id", "evidence_id", "context")


@query("j11_nest_localizations", """
with loc as (select p_partkey, 'de' as language, p_name as title from part where p_size > 10
  union all select p_partkey, 'en', p_type from part where p_size % 2 = 0)
select p.p_partkey, coalesce(string_agg(concat(language, ':', title), '|' order by language) filter (where language is not null), '') as localizations
from part p left join loc using (p_partkey) group by p.p_partkey""")
def j11(t: Tables):
    german = t.part.where("p_size > 10").select("p_partkey", F.lit("de").alias("language"), F.col("p_name").alias("title"))
    english = t.part.where("p_size % 2 = 0").select("p_partkey", F.lit("en").alias("language"), F.col("p_type").alias("title"))
    nested = P.nest_localizations(t.part.select("p_partkey"), english.unionByName(german), "p_partkey", ["title"])
    shown = F.transform("localizations", lambda e: F.concat(e["language"], F.lit(":"), e["title"]))
    return nested.select("p_partkey", F.coalesce(F.array_join(shown, "|"), F.lit("")).alias("localizations"))


_CHANGES = """select c_custkey + 1000 as id, case when c_mktsegment = 'HOUSEHOLD' then 'delete' else 'upsert' end as action,
  case when c_acctbal > 5000 then c_name end as name, c_mktsegment as kind from customer"""
UPSERT = f"""ch as ({_CHANGES}), cur as (select p_partkey as id, p_name as name, p_type as kind, p_size as revision from part),
j as (select coalesce(cur.id, ch.id) as id, cur.id is not null as stored, ch.action, coalesce(ch.name, cur.name) as name, coalesce(ch.kind, cur.kind) as kind,
  case when cur.id is null then 1 else cur.revision + case when ch.id is null then 0 else 1 end end as revision
  from cur full join ch on ch.id = cur.id)"""


def _upsert(t: Tables):
    current = t.part.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.col("p_size").alias("revision")
    )
    changes = t.customer.select(
        (F.col("c_custkey") + 1000).alias("id"),
        F.when(F.col("c_mktsegment") == "HOUSEHOLD", "delete").otherwise("upsert").alias("action"),
        F.when(F.col("c_acctbal") > 5000, F.col("c_name")).alias("name"), F.col("c_mktsegment").alias("kind"),
    )
    return P.upsert_resources(current, changes, "id", ["name", "kind"])


@query("c5_upsert_resources", f"with {UPSERT} select id, name, kind, revision from j where (stored or action = 'upsert') and action is distinct from 'delete'")
def c5(t: Tables):
    return _upsert(t)[0]


@query("c5_resource_revisions", f"""with {UPSERT} select id, revision, case when action = 'delete' then 'deleted' when not stored then 'created' else 'updated' end as action
from j where action is not null and (stored or action = 'upsert')""")
def c5_revisions(t: Tables):
    return _upsert(t)[1].select("id", "revision", "action")


@query("c5_merge_localizations", """
with cur as (select p_partkey as id, 'de' as language, p_name as title from part),
ch as (select c_custkey as id, case when c_nationkey > 12 then 'de' else 'en' end as language, c_name as title from customer)
select coalesce(cur.id, ch.id) as id, coalesce(cur.language, ch.language) as language, coalesce(ch.title, cur.title) as title
from cur full join ch on cur.id = ch.id and cur.language = ch.language""")
def c5_localizations(t: Tables):
    current = t.part.select(F.col("p_partkey").alias("id"), F.lit("de").alias("language"), F.col("p_name").alias("title"))
    changes = t.customer.select(
        F.col("c_custkey").alias("id"), F.when(F.col("c_nationkey") > 12, "de").otherwise("en").alias("language"),
        F.col("c_name").alias("title"))
    return P.merge_localizations(current, changes, "id", ["title"])


@query("f16_clean_preference_lists", """
select c_custkey, array_to_string(list_filter(list_transform(generate_series(1, len(v)),
    lambda i: case when list_position(k, k[i]) = i then v[i] end), lambda x: x is not null), '|') as cleaned
from (select c_custkey, v, list_transform(v, lambda x: lower(x)) as k from (select c_custkey,
  list_filter(list_transform([c_mktsegment, lower(c_mktsegment), '  Berlin ', '', c_name, 'berlin', upper(c_name)], lambda x: trim(x)), lambda x: x <> '') as v
  from customer))""")
def f16(t: Tables):
    values = F.array("c_mktsegment", F.lower("c_mktsegment"), F.lit("  Berlin "), F.lit(""), "c_name", F.lit("berlin"), F.upper("c_name"))
    return t.customer.select("c_custkey", F.array_join(P.clean_preferences(values), "|").alias("cleaned"))


_URLS = ("case p_size % 5 when 0 then 'https://www.linkedin.com/in/x' when 1 then 'https://lnkd.in/x' when 2 then 'https://evil.example/linkedin.com' "
         "when 3 then 'https://linkedin.com.evil.example/' end")


@query("p27_unique_within_row", f"""
select p_partkey, lower(p_name) <> lower(concat(substr(p_name, 1, 4), upper(substr(p_name, 5)), case when p_size % 2 = 0 then 'x' else '' end)) as roles_unique,
  p_size % 3 <> 0 as languages_unique,
  {_URLS} is null or regexp_extract({_URLS}, '^https?://([^/]+)', 1) in ({B.sql_words(vocab.LINKEDIN_HOSTS)}) as linkedin_valid from part""")
def p27(t: Tables):
    other = F.expr("concat(substr(p_name, 1, 4), upper(substr(p_name, 5)), case when p_size % 2 = 0 then 'x' else '' end)")
    languages = F.when(F.col("p_size") % 3 == 0, T.word_list(["de", "de"])).otherwise(T.word_list(["de", "en"]))
    return t.part.select(
        "p_partkey", P.has_unique(F.array("p_name", other), lambda r: T.casefold(r)).alias("roles_unique"),
        P.has_unique(languages, lambda x: x).alias("languages_unique"), P.is_linkedin(F.expr(_URLS)).alias("linkedin_valid"),
    )


@query("a13_longest_station_years", f"""
select o_custkey as profile_id, greatest(0, max(date_diff('day', cast(o_orderdate as date),
  case when o_orderstatus <> 'O' then cast(o_orderdate as date) + 400 else date '{AS_OF}' end) / 365.25::double)) as years from orders group by o_custkey""")
def a13(t: Tables):
    return P.longest_station(resources(t)[1], _as_of())


_SOURCE = ("case when k % 4 = 0 then concat('{\"years_experience\":', cast(k as string), '}') "
           "when k % 4 = 1 then '{\"source_type\":\"manual_training\"}' when k % 4 = 2 then 'not json' else '{\"years_experience\":\"many\"}' end")
_TEXT = "case when k % 3 = 0 then concat('Skill: X; Jahre: ', cast(k as string), ',5') else 'Skill: X' end"
_CTX = "case event_type when 'purchase' then 'professional' when 'view' then 'project' when 'click' then 'training' else 'other' end"
SKILL_EVENTS = f"""ke as (select event_id, user_id, event_type, cast(json_extract_string(props, '$.k') as int) as k from events),
se as (select event_id, user_id, {_SOURCE} as source_content, {_TEXT} as evidence_text, {_CTX} as context,
  case when k % 4 = 0 then k::double when k % 4 = 3 then null when k % 3 = 0 then k + 0.5::double end as years,
  case when k % 4 = 1 then 0.5::double else case event_type when 'purchase' then 1.0::double when 'view' then 0.9::double when 'click' then 0.8::double else 0.5::double end end as weight from ke)"""


def _skill_events(t: Tables):
    rows = t.events.withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return rows.select(
        F.col("user_id").alias("profile_id"), F.col("event_id").alias("evidence_id"), F.expr(_SOURCE).alias("source_content"),
        F.expr(_TEXT).alias("evidence_text"), F.expr(_CTX).alias("experience_context"),
    )


@query("f04_skill_years", f"with {SKILL_EVENTS} select event_id as evidence_id, years from se")
def f04(t: Tables):
    return _skill_events(t).select("evidence_id", M.skill_years(F.col("source_content"), F.col("evidence_text")).alias("years"))


@query("f05_evidence_weight", f"with {SKILL_EVENTS} select event_id as evidence_id, weight from se")
def f05(t: Tables):
    return _skill_events(t).select("evidence_id", M.evidence_weight(F.col("source_content"), F.col("experience_context")).alias("weight"))


@query("a14_skill_years_evaluation", f"""with {SKILL_EVENTS},
b as (select user_id, max(years) as years from se where context = 'professional' group by user_id)
select user_id as profile_id, b.years as skill_years, case when b.years >= 90 then 'strong_match' when b.years is not null then 'gap' else 'unknown' end as match_level,
  (select count(*) from se where se.user_id = b.user_id and context = 'professional' and se.years = b.years) as citations from b""")
def a14(t: Tables):
    rows = _skill_events(t)
    best = X.profile_years(rows, _as_of())
    cited = X.skill_year_citations(rows).groupBy("profile_id").agg(F.count(F.lit(1)).alias("n"))
    years = F.col("skill_years")
    return best.join(cited, "profile_id", "left").select(
        "profile_id", "skill_years",
        F.when(years >= 90, "strong_match").when(years.isNotNull(), "gap").otherwise("unknown").alias("match_level"),
        F.coalesce("n", F.lit(0)).alias("citations"),
    )


@query("f03_minimum_years", f"""with {AD_ITEMS}, {REQUIREMENT_ROWS}
select job_id, position, requirement, try_cast(replace(regexp_extract(requirement,
  '(?i)(\\d+(?:[.,]\\d+)?)\\s*(?:\\+|plus)?\\s*(?:jahr(?:e|en)?|years?)\\s*(?:of\\s+)?(?:berufs?\\s*|profession(?:al)?\\s+)?(?:erfahrung|experience)', 1), ',', '.') as double)
  as minimum_years from reqs""")
def f03(t: Tables):
    rows = ST.requirement_rows(ST.with_structure(B.ads(t).select("job_id", "content")))
    return rows.select(
        "job_id", "position", "requirement", M.minimum_years(F.col("requirement"), F.col("normalized_value")).alias("minimum_years")
    )


_DATE = """case o_orderkey % 7 when 0 then cast(cast(o_orderdate as date) as string)
  when 1 then concat(lpad(cast(month(o_orderdate) as string), 2, '0'), ' ', cast(year(o_orderdate) as string))
  when 2 then concat(cast(month(o_orderdate) as string), '/', cast(year(o_orderdate) as string))
  when 3 then concat(cast(year(o_orderdate) as string), '-', cast(month(o_orderdate) as string))
  when 4 then concat(case when month(o_orderdate) = 3 then 'März' when month(o_orderdate) = 10 then 'Okt.' else 'December' end, ' ', cast(year(o_orderdate) as string))
  when 5 then 'bis heute' else '' end"""


@query("f11_normalize_cv_date", f"""
with d as (select o_orderkey, o_orderdate, {_DATE} as txt from orders),
m as (select *, case when o_orderkey % 7 in (1, 2, 3) then make_date(year(o_orderdate), month(o_orderdate), 1)
  when o_orderkey % 7 = 4 then make_date(year(o_orderdate), case when month(o_orderdate) in (3, 10) then month(o_orderdate) else 12 end, 1) end as first_day from d)
select o_orderkey, txt, cast(case when o_orderkey % 7 = 0 then cast(o_orderdate as date) else first_day end as varchar) as start_date,
  cast(case when o_orderkey % 7 = 0 then cast(o_orderdate as date) else last_day(first_day) end as varchar) as end_date from m""")
def f11(t: Tables):
    rows = t.orders.select("o_orderkey", F.expr(_DATE).alias("txt"))
    return rows.select(
        "o_orderkey", "txt", dates.cv_date(F.col("txt")).alias("start_date"),
        dates.cv_date(F.col("txt"), end_of_month=True).alias("end_date"),
    )


_KINDS = "skills experiences education certificates references projects profile".split()


def _identity_rows(t: Tables):
    kind = F.get(T.word_list(_KINDS), (F.col("c_custkey") % 7).cast("int"))
    name, segment = F.col("c_name"), F.col("c_mktsegment")
    empty = F.when(F.col("c_nationkey") % 4 == 0, "").otherwise(segment)
    data = F.to_json(F.struct(
        name.alias("canonical_name"), F.concat(F.lit("Fa. "), name).alias("company"), empty.alias("institution"), name.alias("official_name"),
        empty.alias("issuer"), name.alias("full_name"), segment.alias("organization"),
        F.when(F.col("c_nationkey") % 2 == 0, F.concat(name, F.lit("@Mail.example"))).alias("email"),
        F.array(F.struct(F.concat(F.lit("Ärztin "), segment).alias("title"))).alias("localizations"),
    ))
    return t.customer.select(F.col("c_custkey").alias("id"), kind.alias("kind"), data.alias("data"))


@query("f13_identity_key", """
with n as (select c_custkey as id, c_custkey % 7 as k, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g')) as nm, lower(c_mktsegment) as seg,
  case when c_nationkey % 4 = 0 then '' else lower(c_mktsegment) end as emp, c_nationkey % 2 = 0 as mail from customer)
select id, case k when 0 then nm when 1 then concat('fa ', nm, '/', 'arztin ', seg) when 2 then case when emp <> '' then concat(emp, '/', 'arztin ', seg) end
  when 3 then case when emp <> '' then concat(nm, '/', emp) end
  when 4 then case when mail then concat('email/', nm, ' mail example') else concat('name/', nm, '/', seg) end
  when 5 then nm else 'profile' end as identity_key from n""")
def f13(t: Tables):
    rows = _identity_rows(t)
    key = F.replace(C.identity_key(F.col("kind"), F.col("data")), F.lit("\x1f"), F.lit("/"))
    return rows.select("id", key.alias("identity_key"))


@query("a17_next_document_version", """
with stored as (select source, lang, count(*) as latest from documents where doc_id in (select doc_id from labels) group by source, lang)
select d.doc_id, coalesce(s.latest, 0) + row_number() over (partition by d.source, d.lang order by d.doc_id) as version
from documents d left join stored s on s.source = d.source and s.lang = d.lang where d.doc_id not in (select doc_id from labels)""")
def a17(t: Tables):
    docs = t.documents.select("doc_id", "source", "lang")
    labels = t.labels.select("doc_id")
    stored = docs.join(labels, "doc_id", "left_semi").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("latest"))
    fresh = docs.join(labels, "doc_id", "left_anti")
    numbered = ranking.number_rows(fresh, ["source", "lang"], [F.col("doc_id")], "n")
    return numbered.join(stored, ["source", "lang"], "left").select(
        "doc_id", (F.coalesce("latest", F.lit(0)) + F.col("n")).alias("version")
    )
