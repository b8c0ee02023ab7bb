"""Queries on CV and portfolio imports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fitweave.functions import text as T
from fitweave.operators import cv as C
from fitweave.plans.registry import Tables, query
from fitweave.session import spread

# --- one CV per order: contact from the customer, one station from the order -------------


def cvs(t: Tables):
    rows = spread(t.orders.join(t.customer, t.orders.o_custkey == t.customer.c_custkey))
    k = F.col("o_orderkey")
    day = F.col("o_orderdate").cast("date")
    blank = F.lit(None).cast("string")

    def some(when, value):
        return F.when(when, value)

    cv = F.struct(
        F.struct(
            F.concat(F.lit(" "), "c_name", F.lit(" ")).alias("name"), some(k % 3 == 0, F.lit("deutsch")).alias("nationality"),
            blank.alias("phone"), F.lit("").alias("email"), F.lit("text to ignore").alias("summary"),
        ).alias("profile"),
        F.struct(
            F.array(F.struct(
                some(k % 4 != 0, F.lit("Programming")).alias("category"),
                F.array(F.lit("Python"), F.lit(" "), F.col("c_mktsegment")).alias("skills"))).alias("categories"),
            F.array(F.struct(F.lit("Deutsch").alias("language"), some(k % 2 == 0, F.lit("Muttersprache")).alias("level"))).alias("languages"),
        ).alias("skills"),
        F.array(F.struct(
            F.concat(F.lit("Firma "), "o_orderpriority").alias("company"),
            some(k % 5 != 0, F.lit("Engineer")).alias("job_title"), F.date_format(day, "MM/yyyy").alias("start_date"),
            F.lit("heute").alias("end_date"), F.array(F.lit("Built")).alias("activities"))).alias("work_experience"),
        F.array(F.struct(
            F.lit("TU").alias("institution"), F.lit("M.Sc.").alias("qualification"), blank.alias("field"),
            F.date_format(day, "yyyy-MM").alias("date"))).alias("education"),
        F.array(F.struct(F.lit("Cert").alias("name"), some(k % 2 == 0, F.lit("Issuer")).alias("institution"), blank.alias("date")))
        .alias("certificates"),
        F.array(F.struct(F.lit("Ada").alias("name"), some(k % 3 == 1, F.lit("Example AG")).alias("company"), blank.alias("job_title"),
                         F.lit("https://x").alias("linkedin"))).alias("references"),
    )
    return rows.select(k.alias("cv_id"), F.to_json(cv).alias("cv_json"))


CV_ROWS = """src as (select o_orderkey as cv_id, c_name, c_mktsegment, o_orderpriority, cast(o_orderdate as date) as d from orders join customer on c_custkey = o_custkey),
sug as (
  select cv_id, 'profile' as resource_type, c_name as main, null as detail, 'Stabile Kontakt- und Profillinks aus dem CV' as source_excerpt from src
  union all select cv_id, 'skills', 'Python', case when cv_id % 4 <> 0 then 'programming_languages' else 'other' end,
    concat(case when cv_id % 4 <> 0 then 'Programming' else 'Uncategorized' end, ': Python') from src
  union all select cv_id, 'skills', c_mktsegment, case when cv_id % 4 <> 0 then 'programming_languages' else 'other' end,
    concat(case when cv_id % 4 <> 0 then 'Programming' else 'Uncategorized' end, ': ', c_mktsegment) from src
  union all select cv_id, 'skills', 'Deutsch', 'natural_languages', case when cv_id % 2 = 0 then 'Deutsch: Muttersprache' else 'Deutsch' end from src
  union all select cv_id, 'experiences', concat('Firma ', o_orderpriority), strftime(d, '%Y-%m-01'),
    concat('Engineer · Firma ', o_orderpriority, ' · ', strftime(d, '%m/%Y'), '–heute') from src where cv_id % 5 <> 0
  union all select cv_id, 'education', 'TU', cast(last_day(d) as varchar), concat('M.Sc. · TU · ', strftime(d, '%Y-%m')) from src
  union all select cv_id, 'certificates', 'Cert', 'Issuer', 'Cert · Issuer' from src where cv_id % 2 = 0
  union all select cv_id, 'references', 'Ada', case when cv_id % 3 = 1 then 'Example AG' end, case when cv_id % 3 = 1 then 'Ada · Example AG' else 'Ada' end from src)"""


def _field(name):
    return F.get_json_object("proposed_data", f"$.{name}")


@query("s03_scan_structured_cv", """
select o_orderkey as cv_id, trim(c_name) as name, concat('Firma ', o_orderpriority) as company, 2 as list_fields from orders join customer on c_custkey = o_custkey""")
def s03(t: Tables):
    return C.scan_cvs(cvs(t)).select(
        "cv_id", F.trim("cv.profile.name").alias("name"), F.col("cv.work_experience")[0]["company"].alias("company"),
        (F.size("cv.education") + F.size("cv.certificates")).alias("list_fields"),
    )


@query("c1_cv_to_suggestions", f"with {CV_ROWS} select * from sug")
def c1(t: Tables):
    rows = C.cv_to_suggestions(C.scan_cvs(cvs(t)))
    kind = F.col("resource_type")
    main = F.coalesce(*[_field(f) for f in ("full_name", "canonical_name", "company", "institution", "official_name")])
    detail = (
        F.when(kind == "skills", _field("category")).when(kind == "experiences", _field("start_date"))
        .when(kind == "education", _field("end_date")).when(kind == "certificates", _field("issuer"))
        .when(kind == "references", _field("organization"))
    )
    return rows.select("cv_id", "resource_type", main.alias("main"), detail.alias("detail"), "source_excerpt")


def _portfolio(t: Tables):
    size = F.col("p_size")
    project = F.struct(
        F.when(size % 4 != 0, F.col("p_name")).alias("name"), F.when(size % 2 == 0, F.lit("Titel")).alias("title"),
        F.col("p_type").alias("description"),
        F.when(size % 3 == 0, F.lit("Eins\n\nZwei")).alias("bullets"),
        F.when(size % 3 == 1, F.array(F.lit("A"), F.lit(" "))).alias("highlights"),
        F.concat("p_brand", F.lit(", SQL,")).alias("technologies"), F.lit("2024-2").alias("end_date"),
        F.lit("https://git.example").alias("repository"),
    )
    return t.part.select("p_partkey", F.to_json(F.array(project)).alias("projects"))


@query("c2_portfolio_to_suggestions", """
select p_partkey, p_name as canonical_name, case when p_size % 2 = 0 then 'Titel' else p_name end as title, p_type as summary,
  case p_size % 3 when 0 then 'Eins|Zwei' when 1 then 'A' else '' end as bullets, '2024-02-29' as end_date, 'https://git.example' as repository_url,
  concat(p_name, ' · ', p_brand, ', SQL') as source_excerpt
from part where p_size % 4 <> 0""")
def c2(t: Tables):
    rows = C.portfolio_to_suggestions(_portfolio(t))
    bullets = F.from_json(_field("localizations[0].bullets"), "array<string>")
    return rows.select(
        "p_partkey", _field("canonical_name").alias("canonical_name"), _field("localizations[0].title").alias("title"),
        _field("localizations[0].summary").alias("summary"), F.array_join(bullets, "|").alias("bullets"),
        _field("end_date").alias("end_date"), _field("repository_url").alias("repository_url"), "source_excerpt",
    )


@query("s04_scan_translated_portfolio", """
select p_partkey, p_name as canonical_name, case when p_size % 3 = 1 then 'en' when p_size % 3 = 0 then 'de,en' else 'de' end as languages,
  concat('ai, ', p_type) as project_type, 'Python|SQL' as technologies,
  concat(case when p_size % 3 = 1 then 'Project ' else 'Projekt ' end, p_name, ' · Python, SQL') as source_excerpt
from part where p_size % 5 <> 0""")
def s04(t: Tables):
    size = F.col("p_size")
    blank = F.lit(None).cast("string")

    def translation(title, when):
        return F.struct(
            F.when(when, F.concat(F.lit(title), "p_name")).otherwise(" ").alias("title"), blank.alias("summary"),
            F.array(F.lit(" x "), F.lit("")).alias("highlights"))

    project = F.struct(
        F.when(size % 5 != 0, F.col("p_name")).alias("id"), F.array(F.lit("ai"), F.lit(""), F.col("p_type")).alias("tags"),
        F.lit("2026-07").alias("date"), F.array(F.lit("Python"), F.lit(" SQL")).alias("stack"),
        F.struct(F.lit("https://x").alias("repo"), blank.alias("live")).alias("resources"),
        F.struct(translation("Projekt ", size % 3 != 1).alias("de"), translation("Project ", size % 3 != 2).alias("en")).alias("translations"),
    )
    source = t.part.select("p_partkey", F.to_json(F.array(project)).alias("projects"))
    rows = C.translated_portfolio_to_suggestions(source)
    languages = F.from_json(_field("localizations"), "array<struct<language:string>>")
    return rows.select(
        "p_partkey", _field("canonical_name").alias("canonical_name"), F.array_join(languages["language"], ",").alias("languages"),
        _field("project_type").alias("project_type"),
        F.array_join(F.from_json(_field("technologies"), "array<string>"), "|").alias("technologies"), "source_excerpt",
    )


# --- entity resolution: suppliers against their upper-cased names ----------------------------


def entities(t: Tables):
    """Every supplier is a stored skill of profile nation; two customers per name share a key."""
    data = F.to_json(F.struct(F.col("s_name").alias("canonical_name"), F.concat(F.lit("nation "), F.col("s_nationkey").cast("string")).alias("category"),
                              F.lit("active").alias("status")))
    suppliers = t.supplier.select(
        F.lit(1).alias("profile_id"), F.lit("skills").alias("resource_type"), F.col("s_suppkey").cast("string").alias("entity_id"),
        data.alias("data"), F.col("s_suppkey").alias("created_at"))
    copies = suppliers.where("created_at < 50").select(
        "profile_id", "resource_type", F.concat(F.lit("copy"), "entity_id").alias("entity_id"), "data",
        (F.col("created_at") + 1000).alias("created_at"))
    return suppliers.unionByName(copies)


def suggestions(t: Tables):
    key = F.col("s_suppkey")
    name = F.when(key % 11 == 0, F.concat(F.lit("Unknown "), key.cast("string"))).otherwise(
        F.replace(F.upper("s_name"), F.lit("#"), F.lit(" ")))
    nation = F.col("s_nationkey") + F.when(key % 7 == 0, 1).otherwise(0)
    data = F.to_json(F.struct(name.alias("canonical_name"), F.concat(F.lit("Nation "), nation.cast("string")).alias("category"),
                              F.lit("draft").alias("status")))
    return t.supplier.select(
        key.alias("suggestion_id"), F.lit(1).alias("profile_id"), F.lit("skills").alias("resource_type"), data.alias("proposed_data"),
        F.when(key % 13 == 0, ((key + 1) % 100).cast("string")).alias("matched_entity_id"),
        F.when(key % 10 == 9, "applied").otherwise("pending").alias("status"),
    )


RESOLVED = """sg as (select s_suppkey as k, case when s_suppkey % 11 = 0 then null else s_suppkey end as by_name,
    case when s_suppkey % 13 = 0 and (s_suppkey + 1) % 100 in (select s_suppkey from supplier) then (s_suppkey + 1) % 100 end as by_id,
    s_nationkey + case when s_suppkey % 7 = 0 then 1 else 0 end as nation,
    case when s_suppkey % 11 = 0 then concat('unknown ', cast(s_suppkey as varchar)) else lower(replace(s_name, '#', ' ')) end as nm,
    case when s_suppkey % 10 = 9 then 'applied' else 'pending' end as status from supplier),
mt as (select *, coalesce(by_id, by_name) as existing from sg),
cf as (select mt.*, e.s_suppkey is not null as known,
    case when e.s_suppkey is null then '' else concat_ws(',', case when lower(replace(e.s_name, '#', ' ')) <> nm then 'canonical_name' end,
      case when e.s_nationkey <> nation then 'category' end) end as fields
  from mt left join supplier e on e.s_suppkey = mt.existing),
st as (select *, case when not known then 'none' when fields = '' then 'duplicate' else 'conflict' end as conflict_status from cf)"""


@query("j08_identity_key_join", f"with {RESOLVED} select k as suggestion_id, cast(existing as varchar) as existing_id from mt")
def j08(t: Tables):
    return C.match_entities(suggestions(t), entities(t)).select("suggestion_id", "existing_id")


@query("c3_match_and_conflict", f"with {RESOLVED} select k as suggestion_id, conflict_status, fields from st")
def c3(t: Tables):
    rows = C.with_conflicts(C.match_entities(suggestions(t), entities(t)))
    return rows.select(
        "suggestion_id", "conflict_status",
        F.array_join(F.array_sort(F.transform("differences", lambda d: d["field"])), ",").alias("fields"),
    )


# nested values of parts, stored with other key order, other ignored values, other case, other places or other numbers
NESTED = """docs as (select p_partkey as k, json_object('canonical_name', p_name, 'details', json_object('brand', p_brand, 'made',
      json_array(json_object('by', p_brand, 'size', p_size), null), 'id', json_object('z', p_partkey)), 'stack', json_array(p_type, p_brand)) as new,
    json_object('stack', case when p_size % 6 = 2 then json_array(p_brand, p_type) else json_array(p_type, p_brand) end,
      'canonical_name', case when p_size % 6 = 3 then upper(p_name) else p_name end, 'details', json_object('made', json_array(json_object(
        'size', case when p_size % 6 = 4 then p_size + 0.5 else p_size end, 'by', replace(p_brand, '#', ' '), 'revision', null), null),
      'id', case when p_size % 6 = 1 then json_array(1) end, 'brand', p_brand, 'note', case when p_size % 6 = 5 then 'new' end)) as old from part),
sides as (select k, 'new' as side, t.* from docs, json_tree(new) as t union all select k, 'old', t.* from docs, json_tree(old) as t),
leaves as (select distinct k, side, split_part(fullkey, '.', 2) as f, fullkey, case when type in ('VARCHAR') then
      trim(regexp_replace(lower(json_extract_string(value, '$')), '[^a-z0-9]+', ' ', 'g')) else cast(try_cast(atom as double) as varchar) end as v
  from sides where type not in ('OBJECT', 'ARRAY') and not regexp_matches(fullkey, '[.](id|revision)([.\\[]|$)')
    and not (type = 'NULL' and not ends_with(fullkey, ']'))),
fields as (select k, split_part(regexp_replace(f, '\\[.*$', ''), '[', 1) as field, count(distinct side) as sides, fullkey, v from leaves group by all),
odd as (select k, string_agg(distinct field, ',' order by field) as fields from fields where sides = 1 group by k)"""


@query("c3_nested_values", f"""with {NESTED}
select k as suggestion_id, case when fields is null then 'duplicate' else 'conflict' end as conflict_status, coalesce(fields, '') as fields
from docs left join odd using (k)""")
def c3_nested(t: Tables):
    size = F.col("p_size")

    def side(code: int, odd: Column, plain: Column) -> Column:
        return F.when(size % 6 == code, odd).otherwise(plain)

    blank = F.lit(None).cast("struct<by: string, size: double>")
    made = F.struct(F.col("p_brand").alias("by"), size.cast("double").alias("size"))
    new = F.struct(
        F.col("p_name").alias("canonical_name"),
        F.struct(F.col("p_brand").alias("brand"), F.array(made, blank).alias("made"), F.struct(F.col("p_partkey").alias("z")).alias("id")).alias("details"),
        F.array("p_type", "p_brand").alias("stack"),
    )
    stored = F.struct(side(4, size + 0.5, size.cast("double")).alias("size"), F.replace("p_brand", F.lit("#"), F.lit(" ")).alias("by"))
    old = F.struct(
        side(2, F.array("p_brand", "p_type"), F.array("p_type", "p_brand")).alias("stack"),
        side(3, F.upper("p_name"), F.col("p_name")).alias("canonical_name"),
        F.struct(
            F.array(stored, F.lit(None).cast("struct<size: double, by: string>")).alias("made"),
            F.when(size % 6 == 1, F.array(F.lit(1))).alias("id"), F.col("p_brand").alias("brand"),
            F.when(size % 6 == 5, F.lit("new")).alias("note"),
        ).alias("details"),
    )
    rows = t.part.select(
        F.col("p_partkey").alias("suggestion_id"), F.lit("projects").alias("resource_type"), F.to_json(new).alias("proposed_data"),
        F.to_json(old).alias("existing_data"), F.col("p_partkey").cast("string").alias("existing_id"),
    )
    return C.with_conflicts(rows).select(
        "suggestion_id", "conflict_status",
        F.array_join(F.array_sort(F.transform("differences", lambda d: d["field"])), ",").alias("fields"),
    )


@query("c4_apply_resolutions", f"""with {RESOLVED},
dc as (select *, case when k % 6 = 5 then null when k % 6 = 4 then 'reject' else 'apply' end as decision,
  case k % 6 when 0 then 'merge' when 1 then 'keep_existing' when 2 then 'create_new' else '' end as resolution from st)
select k as suggestion_id, case when decision is null then 'pending' when status <> 'pending' then 'cv_suggestion_already_reviewed'
  when decision = 'reject' then 'rejected' when known and resolution = '' then 'cv_conflict_resolution_required'
  when resolution = 'create_new' then 'cv_create_new_not_allowed' when resolution = 'keep_existing' and not known then 'cv_matched_entry_not_found'
  when resolution = 'keep_existing' then 'keep' when known then 'update' else 'create' end as outcome from dc""")
def c4(t: Tables):
    matched = C.match_entities(suggestions(t), entities(t))
    k = F.col("s_suppkey")
    decisions = t.supplier.where(k % 6 != 5).select(
        k.alias("suggestion_id"), F.when(k % 6 == 4, "reject").otherwise("apply").alias("decision"),
        F.when(k % 6 == 0, "merge").when(k % 6 == 1, "keep_existing").when(k % 6 == 2, "create_new").alias("resolution"),
    )
    return C.apply_decisions(matched, decisions).select("suggestion_id", "outcome")


@query("k07_import_batches", """
select n_nationkey as batch_id, s_suppkey as suggestion_id from nation left join supplier on s_nationkey = n_nationkey
order by n_nationkey desc, s_suppkey""")
def k07(t: Tables):
    batches = t.nation.select(F.col("n_nationkey").alias("batch_id"), F.col("n_nationkey").alias("batch_created_at"))
    rows = t.supplier.select(
        F.col("s_nationkey").alias("batch_id"), F.col("s_suppkey").alias("suggestion_id"), F.col("s_suppkey").alias("created_at"))
    return C.import_history(batches, rows).select("batch_id", "suggestion_id")
