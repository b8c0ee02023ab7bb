"""Queries on target fit, stored reports and the vocabulary functions behind them."""

from __future__ import annotations

from pyspark.sql import functions as F

from fitweave import vocab
from fitweave.functions import taxonomy
from fitweave.functions import text as T
from fitweave.operators import reports as R
from fitweave.operators import scoring as S
from fitweave.operators import target as G
from fitweave.plans import bindings as B
from fitweave.plans.registry import Tables, query
from fitweave.plans.scoring import FIT

_JOB = """p_partkey as job_id,
  case p_size % 4 when 0 then concat('Senior Data Engineer ', p_name) when 1 then 'Machine Learning Engineer'
    when 2 then concat('Lead ', p_type, ' Analyst') else concat('Data Science ', p_name) end as title,
  case when p_size % 6 = 0 then 'Workflow Architect' end as role,
  case when p_size % 5 = 0 then null else concat('City ', p_brand) end as location,
  case p_size % 6 when 0 then 'Remote möglich' when 1 then 'Hybrid' when 2 then 'Vor Ort' when 3 then 'Präsenz in Köln'
    when 4 then p_type end as work_model,
  case p_size % 8 when 0 then 'Unbefristete Vollzeitstelle' when 1 then 'Werkstudent (m/w/d)' when 2 then 'Freelance'
    when 3 then 'Angestellte/r' when 4 then 'befristet' when 5 then p_type when 6 then 'Internship' end as employment_type,
  case when p_size % 3 = 0 then null else concat(p_type, ' Industrie') end as industry,
  case when p_size % 7 = 0 then '' else concat('Entwicklung von Machine-Learning-Anwendungen für ', p_name) end as activity_text,
  concat('Statistik und Automatisierung für ', p_type, ' ', p_name, case when p_size % 11 = 0 then ' nur immatrikulierte' else '' end) as content,
  case p_size % 5 when 0 then 'senior' when 1 then 'junior' when 2 then 'lead' when 3 then 'professional' end as seniority_level"""
_SEG = "c_mktsegment"


def jobs(t: Tables):
    from fitweave.plans.ingest import _split

    return t.part.selectExpr(*_split(_JOB))


def profiles(t: Tables):
    k = F.col("c_custkey")

    def pref(role, level, priority):
        return F.struct(F.lit(role).alias("role"), level.alias("level"), F.lit(priority).alias("priority"))

    none = F.lit(None).cast("string")
    prefs = F.when(
        k % 3 != 0,
        F.array(
            pref("Data Scientist", F.when(k % 4 == 1, "Lead").otherwise(none), 2),
            pref("Data Engineer", F.when(k % 2 == 0, "Senior").otherwise("Mid"), 7),
            pref("Learning Analyst", F.lit("Junior"), 1),
        ),
    )
    return t.customer.select(
        k.alias("profile_id"),
        F.when(k % 4 == 0, " ").when(k % 4 == 1, "Machine Learning, Entwicklung von KI-Anwendungen")
        .otherwise(F.concat(F.lit("Automatisierung im Bereich "), F.lower(_SEG))).alias("career_goal"),
        T.word_list(["Workflow Architect", "Machine Learning Engineer"]).alias("target_roles"),
        prefs.alias("target_role_preferences"),
        F.when(k % 2 == 0, T.word_list(["Economy Industrie", "Promo"])).otherwise(T.empty_words()).alias("target_industries"),
        T.word_list(["City Brand#5", " ", "Berlin Brand#1"]).alias("target_locations"),
        F.when(k % 5 == 0, T.empty_words()).otherwise(T.word_list(["remote", "hybrid"])).alias("preferred_work_models"),
        T.word_list(["permanent"]).alias("preferred_employment_types"),
        F.array(F.when(k % 2 == 0, "Freiberuflich").otherwise("Werkstudent"), F.lit("Statistik und Economy"))
        .alias("deal_breakers"),
    )


def pairs(t: Tables):
    """Three profiles per job, spread over the customers."""
    total = t.customer.agg(F.count(F.lit(1)).alias("n"))
    return t.part.select(
        F.col("p_partkey").alias("job_id"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("k")
    ).select("job_id", ((F.col("job_id") * 7 + F.col("k") * 13) % total.scalar()).alias("profile_id")).distinct()


def fold_sql(value: str) -> str:
    return (f"trim(regexp_replace(replace(replace(replace(replace(lower(coalesce({value}, '')), 'ä', 'ae'), 'ö', 'oe'), "
            "'ü', 'ue'), 'ß', 'ss'), '[^a-z0-9+#]+', ' ', 'g'))")


def concepts_sql(folded: str) -> str:
    rows = ", ".join(
        "case when " + " or ".join(f"contains({folded}, '{m}')" for m in markers) + f" then '{name}' end"
        for name, markers in vocab.TARGET_CONCEPTS.items()
    )
    return f"list_filter([{rows}], lambda c: c is not null)"


def markers_sql(value: str, table, default: str) -> str:
    cases = " ".join(
        "when " + " or ".join(f"contains({value}, '{m}')" for m in markers) + f" then '{label}'"
        for label, markers in table
    )
    return f"case {cases} else {default} end"


_FOLD_EMP = fold_sql("employment_type")
_FOLD_WORK = fold_sql("work_model")
CANON_EMP = markers_sql(
    _FOLD_EMP, vocab.EMPLOYMENT_MARKERS,
    f"case when {_FOLD_EMP} in ({B.sql_words(vocab.EMPLOYMENT_UNKNOWN)}) then null else nullif({_FOLD_EMP}, '') end")
CANON_WORK = markers_sql(_FOLD_WORK, vocab.WORK_MODEL_MARKERS, f"nullif({_FOLD_WORK}, '')")

TARGET = f"""jobs as (select {_JOB} from part),
pairs as (select distinct p_partkey as job_id, (p_partkey * 7 + k * 13) % (select count(*) from customer) as profile_id
  from part, (values (1), (2), (3)) ks(k)),
actual as (
  select job_id, 'role' as key, nullif(coalesce(role, title), '') as raw from jobs
  union all select job_id, 'activities', nullif(activity_text, '') from jobs
  union all select job_id, 'industry', industry from jobs
  union all select job_id, 'location', location from jobs
  union all select job_id, 'work_model', {CANON_WORK} from jobs
  union all select job_id, 'employment_type', {CANON_EMP} from jobs),
roles as (
  select c_custkey as profile_id, 1 as ord, 'Data Scientist' as role, case when c_custkey % 4 = 1 then 'lead' end as lvl, 2 as pr from customer where c_custkey % 3 <> 0
  union all select c_custkey, 2, 'Data Engineer', case when c_custkey % 2 = 0 then 'senior' else 'mid' end, 5 from customer where c_custkey % 3 <> 0
  union all select c_custkey, 3, 'Learning Analyst', 'junior', 1 from customer where c_custkey % 3 <> 0
  union all select c_custkey, 1, 'Workflow Architect', null, 1 from customer where c_custkey % 3 = 0
  union all select c_custkey, 2, 'Machine Learning Engineer', null, 2 from customer where c_custkey % 3 = 0),
wanted as (
  select profile_id, 'role' as key, ord, role as raw from roles
  union all select c_custkey, 'activities', 1, case when c_custkey % 4 = 1 then 'Machine Learning, Entwicklung von KI-Anwendungen'
    else concat('Automatisierung im Bereich ', lower(c_mktsegment)) end from customer where c_custkey % 4 <> 0
  union all select c_custkey, 'industry', o, v from customer, (values (1, 'Economy Industrie'), (2, 'Promo')) x(o, v) where c_custkey % 2 = 0
  union all select c_custkey, 'location', o, v from customer, (values (1, 'City Brand#5'), (2, 'Berlin Brand#1')) x(o, v)
  union all select c_custkey, 'work_model', o, v from customer, (values (1, 'remote'), (2, 'hybrid')) x(o, v) where c_custkey % 5 <> 0
  union all select c_custkey, 'employment_type', 1, 'permanent' from customer),
fa as (select job_id, key, raw, {fold_sql('raw')} as f, string_split({fold_sql('raw')}, ' ') as w, {concepts_sql(fold_sql('raw'))} as c from actual),
fw as (select profile_id, key, ord, {fold_sql('raw')} as f, list_distinct(string_split({fold_sql('raw')}, ' ')) as w, {concepts_sql(fold_sql('raw'))} as c from wanted),
ov as (select p.job_id, p.profile_id, fa.key, fw.ord, fa.raw,
    case when fw.ord is null then null when fa.f = '' or fw.f = '' then 0.0::double
      else greatest(len(list_intersect(fw.w, fa.w))::double / len(fw.w),
        coalesce(len(list_intersect(fw.c, fa.c))::double / nullif(len(fw.c), 0), 0)) end as o
  from pairs p join fa on fa.job_id = p.job_id left join fw on fw.profile_id = p.profile_id and fw.key = fa.key),
best as (select job_id, profile_id, key, max(o) as o, count(ord) as n, any_value(raw) as raw from ov group by all),
rbest as (select ov.job_id, ov.profile_id, first(struct_pack(o := o, lvl := r.lvl, pr := r.pr) order by o desc, ov.ord) as b,
    first(struct_pack(o := o, lvl := r.lvl) order by o desc, ov.ord) filter (where r.lvl is not null and o > 0) as lb
  from ov join roles r on r.profile_id = ov.profile_id and r.ord = ov.ord where ov.key = 'role' group by all),
ranks as (select * from (values ('entry', 0), ('junior', 1), ('mid', 2), ('senior', 3), ('staff', 4), ('principal', 5), ('lead', 6), ('manager', 6)) r(l, k)),
sen as (select rb.job_id, rb.profile_id, case when lb is null or jr.k is null then null else jr.k - coalesce(pr.k, 2) end as delta
  from rbest rb join jobs j using (job_id) left join ranks jr on jr.l = j.seniority_level left join ranks pr on pr.l = rb.lb.lvl),
crit as (
  select best.job_id, best.profile_id, best.key, case when n = 0 then 'not_configured' when raw is null then 'unknown' when best.o >= 1 then 'match'
      when best.o >= 0.5 then 'partial' else 'mismatch' end as status,
    case best.key when 'activities' then 35 when 'location' then 15 when 'role' then
      case when rb.b.o > 0 then 2 * (6 - rb.b.pr) else 10 end else 10 end as weight
  from best left join rbest rb on rb.job_id = best.job_id and rb.profile_id = best.profile_id),
crits as (
  select job_id, profile_id, key, status, case status when 'match' then 100 when 'partial' then 60 when 'mismatch' then 0 end as percent, weight from crit
  union all
  select job_id, profile_id, 'seniority', case when delta is null then 'unknown' when delta = 0 then 'match' when delta >= -1 then 'partial' else 'mismatch' end,
    case when delta = 0 then 100 when delta > 0 then 80 when delta = -1 then 60 when delta is not null then 0 end, 20 from sen),
src as (select job_id, {fold_sql("concat_ws(' ', nullif(title, ''), location, work_model, employment_type, content)")} as f, {CANON_EMP} as emp from jobs),
brk as (select c_custkey as profile_id, case when c_custkey % 2 = 0 then 'Freiberuflich' else 'Werkstudent' end as criterion from customer
  union all select c_custkey, 'Statistik und Economy' from customer),
fb as (select *, {fold_sql('criterion')} as f from brk),
excl as (select p.job_id, p.profile_id, criterion, case
    when (contains(fb.f, 'freiberuf') and emp = 'freelance') or (contains(fb.f, 'student') and (emp = 'working_student' or contains(src.f, 'immatrikul')))
      then 'conflict'
    when greatest(len(list_intersect(list_distinct(string_split(fb.f, ' ')), string_split(src.f, ' ')))::double / len(list_distinct(string_split(fb.f, ' '))),
      coalesce(len(list_intersect({concepts_sql('fb.f')}, {concepts_sql('src.f')}))::double / nullif(len({concepts_sql('fb.f')}), 0), 0)) >= 0.5 then 'review'
    else 'clear' end as status
  from pairs p join src using (job_id) join fb using (profile_id)),
tsum as (select job_id, profile_id, sum(percent * weight) filter (where percent is not null) as pts, sum(weight) filter (where percent is not null) as w
  from crits group by all),
esum as (select job_id, profile_id, bool_or(status = 'conflict') as conflict, count(*) filter (where status = 'review') as review_exclusions from excl group by all),
target as (select *, case when conflict then 'conflict' when score is null then 'unknown' when score >= 75 then 'strong' when score >= 45 then 'partial'
    else 'weak' end as level from (
  select t.job_id, t.profile_id, cast(round_even(pts::double / w, 0) as int) as score, conflict, review_exclusions from tsum t join esum using (job_id, profile_id)))"""


def fit(t: Tables):
    return G.target_fit(pairs(t), jobs(t), profiles(t))


@query("a04_target_fit", f"with {TARGET} select job_id, profile_id, score, level, review_exclusions from target")
def a04(t: Tables):
    return fit(t).select("job_id", "profile_id", "score", "level", F.col("review_exclusions").cast("long").alias("review_exclusions"))


def _criteria(t: Tables):
    return fit(t).select("job_id", "profile_id", F.explode_outer("criteria").alias("c")).where("c is not null").select(
        "job_id", "profile_id", "c.key", "c.status", "c.percent", "c.weight"
    )


@query("a05_criterion_scores", f"with {TARGET} select job_id, profile_id, key, status, percent, weight from crits")
def a05(t: Tables):
    return _criteria(t)


@query("a07_role_seniority_criterion", f"with {TARGET} select job_id, profile_id, status, percent from crits where key = 'seniority'")
def a07(t: Tables):
    return _criteria(t).where("key = 'seniority'").select("job_id", "profile_id", "status", "percent")


@query("a08_role_priority_weight", f"with {TARGET} select job_id, profile_id, weight from crits where key = 'role'")
def a08(t: Tables):
    return _criteria(t).where("key = 'role'").select("job_id", "profile_id", "weight")


@query("a09_deal_breakers", f"with {TARGET} select job_id, profile_id, criterion, status from excl")
def a09(t: Tables):
    return fit(t).select("job_id", "profile_id", F.explode_outer("exclusions").alias("e")).where("e is not null").select(
        "job_id", "profile_id", "e.criterion", "e.status"
    )


@query("a06_target_overlap", f"""
select p_partkey as job_id, case when d = '' or a = '' then 0.0::double else greatest(
    len(list_intersect(list_distinct(string_split(d, ' ')), string_split(a, ' ')))::double / len(list_distinct(string_split(d, ' '))),
    coalesce(len(list_intersect({concepts_sql('d')}, {concepts_sql('a')}))::double / nullif(len({concepts_sql('d')}), 0), 0)) end as overlap
from (select p_partkey, {fold_sql("concat(p_name, ' Data Science ', case when p_size % 2 = 0 then 'Prototyp' else '' end)")} as d,
  {fold_sql("concat(p_type, ' ', p_brand, case when p_size % 3 = 0 then ' Datenanalyse mit KI' else ' ring' end)")} as a from part)""")
def a06(t: Tables):
    size = F.col("p_size")
    desired = F.concat("p_name", F.lit(" Data Science "), F.when(size % 2 == 0, "Prototyp").otherwise(""))
    actual = F.concat("p_type", F.lit(" "), "p_brand", F.when(size % 3 == 0, " Datenanalyse mit KI").otherwise(" ring"))
    return t.part.select(F.col("p_partkey").alias("job_id"), taxonomy.target_overlap(desired, actual).alias("overlap"))


# --- recommendation and reports ---------------------------------------------------------

REPORT = f"""{FIT}, {TARGET},
rep as (select f.job_id, t.profile_id, f.score as q, t.score as s, t.level as tl, f.must_gaps as g, t.review_exclusions as r
  from fit f join target t on t.job_id = f.job_id),
ver as (select *, case when tl = 'conflict' then 'deprioritize' when q is null then 'review' when s is null then 'review'
    when q >= 60 and s >= 60 and g = 0 then 'apply' when q >= 40 and s >= 60 then 'consider'
    when q >= 60 and s < 45 then 'review' when q < 40 then 'deprioritize' else 'review' end as verdict from rep)"""
_REPORT_OUT = """select job_id, profile_id, q as qualification_score, s as target_score, verdict,
  verdict in ('consider', 'review') or g > 0 or r > 0 as requires_manual_review,
  concat_ws('|', concat('Qualifikations-Fit: ', coalesce(concat(cast(q as varchar), ' %'), 'unklar')),
    concat('Ziel-Fit: ', coalesce(concat(cast(s as varchar), ' %'), 'unklar')),
    case when g > 0 then concat(cast(g as varchar), ' unbelegte oder unklare Muss-Anforderung(en)') end,
    case when r > 0 then concat(cast(r as varchar), ' Ausschlusskriterium/-kriterien manuell prüfen') end) as reasons from ver"""


@query("a10_recommendation", f"{REPORT} {_REPORT_OUT}")
def a10(t: Tables):
    q = S.qualification_fit(B.scored_matches(t), ["job_id"]).select(
        "job_id", F.col("score").alias("qualification_score"), "must_gaps")
    target = fit(t).select("job_id", "profile_id", F.col("score").alias("target_score"),
                           F.col("level").alias("target_level"), "review_exclusions")
    return S.recommendation(q.join(target, "job_id")).select(
        "job_id", "profile_id", "qualification_score", "target_score", "verdict", "requires_manual_review",
        F.array_join("reasons", "|").alias("reasons"),
    )


@query("m2_stored_matching_report", f"{REPORT} {_REPORT_OUT}")
def m2(t: Tables):
    # a job has the same matches for every profile here, so its fit is aggregated once
    fits = S.fit_and_levels(B.scored_matches(t), ["job_id"])
    return R.report_of_fits(fits, fit(t), ["job_id"]).select(
        "job_id", "profile_id", "qualification_score", "target_score", "verdict", "requires_manual_review",
        F.array_join("reasons", "|").alias("reasons"),
    )


# --- vocabulary functions -----------------------------------------------------------------

@query("f07_canonical_work_model", f"select job_id, {CANON_WORK} as work_model from (select {_JOB} from part)")
def f07(t: Tables):
    return jobs(t).select("job_id", taxonomy.canonical_work_model(F.col("work_model")).alias("work_model"))


@query("f08_canonical_employment_type", f"select job_id, {CANON_EMP} as employment_type from (select {_JOB} from part)")
def f08(t: Tables):
    return jobs(t).select("job_id", taxonomy.canonical_employment_type(F.col("employment_type")).alias("employment_type"))


_SKILL = ("case p_size % 12 when 0 then 'Programmiersprachen' when 1 then 'Frameworks' when 2 then 'Data & KI' when 3 then 'SQL' "
          "when 4 then 'Cloud Deployment' when 5 then 'Werkzeuge' when 6 then 'Agile Methoden' when 7 then 'Social Skills' "
          "when 8 then 'Fachwissen' when 9 then p_name when 10 then '' end")
_LEVEL = ("case p_size % 8 when 0 then 'Muttersprache' when 1 then 'C1' when 2 then 'gut' when 3 then 'Grundkenntnisse' "
          "when 4 then 'Fluent' when 5 then '' when 6 then p_type end")
_ROLE = ("case p_size % 7 when 0 then 'Principal Lead' when 1 then 'Teamleiterin' when 2 then 'Head of Data' when 3 then 'Senior Manager' "
         "when 4 then 'Junior Staff' when 5 then 'Product Manager' else p_name end")


@query("f09_skill_category", f"select p_partkey, {markers_sql(f'lower(coalesce({_SKILL}, {chr(39) * 2}))', vocab.SKILL_CATEGORY_MARKERS, chr(39) + 'other' + chr(39))} as category from part")
def f09(t: Tables):
    return t.part.select("p_partkey", taxonomy.skill_category(F.expr(_SKILL)).alias("category"))


@query("f10_skill_level", f"select p_partkey, case when coalesce({_LEVEL}, '') <> '' then {markers_sql(f'lower({_LEVEL})', vocab.SKILL_LEVEL_MARKERS, chr(39) + 'basic' + chr(39))} end as level from part")
def f10(t: Tables):
    return t.part.select("p_partkey", taxonomy.skill_level(F.expr(_LEVEL)).alias("level"))


@query("f15_target_role_level", f"""select p_partkey, {markers_sql(f'lower({_ROLE})', vocab.ROLE_LEVEL_MARKERS, 'null')} as level,
  concat({_ROLE}, ':', coalesce({markers_sql(f'lower({_ROLE})', vocab.ROLE_LEVEL_MARKERS, 'null')}, '-'), ':1|Data Lead:Lead:2') as preferences from part""")
def f15(t: Tables):
    shown = F.transform(
        taxonomy.role_preferences(F.array(F.expr(_ROLE), F.lit("Data Lead"))),
        lambda p: F.concat_ws(":", p["role"], F.coalesce(p["level"], F.lit("-")), p["priority"].cast("string")),
    )
    return t.part.select(
        "p_partkey", taxonomy.role_level(F.expr(_ROLE)).alias("level"), F.array_join(shown, "|").alias("preferences")
    )
