"""Queries on the import of jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from fitweave import vocab
from fitweave.functions import text as T
from fitweave.operators import ingest as I
from fitweave.operators import metadata as D
from fitweave.operators import structure as X
from fitweave.plans import bindings as B
from fitweave.plans.corpus import AD_ITEMS, AD_LINES, METADATA, REQUIREMENT_ROWS
from fitweave.plans.registry import Tables, query
from fitweave.session import materialize, scratch_path

# Labelled documents are already stored; all others arrive as one batch.
_COLUMNS = """doc_id, sha256(text) as content_hash, text as content,
  case when n_chars % 5 = 0 then concat('https://jobs.example/', source, '/', cast(n_chars % 40 as string)) end as source_url,
  case when n_chars % 2 = 0 then 'pdf' else 'url' end as source_type,
  case when n_chars % 6 = 0 then 'mineru' else 'native' end as retrieval_method,
  n_chars % 17 = 0 as replace_existing, concat('Title ', cast(doc_id as string)) as title,
  case when n_chars % 4 = 0 then concat('Company ', source) else '' end as company,
  cast(null as string) as source_portal, case when n_chars % 3 = 1 then concat('City ', lang) end as location,
  cast(null as string) as work_model, cast(null as string) as employment_type, cast(null as string) as contract_term,
  case when n_chars % 3 = 0 then '' else lang end as language, n_chars % 7 as req_count"""

BATCH = f"""allrows as (select {_COLUMNS} from documents),
sto as (select * from allrows where doc_id in (select doc_id from labels)),
imp as (select * from allrows where doc_id not in (select doc_id from labels)),
existing as (select imp.doc_id as import_id, min(sto.doc_id) as existing_id from imp
  join (select content_hash as k, doc_id from sto union all select source_url, doc_id from sto where source_url is not null) sto
    on sto.k = imp.content_hash or sto.k = imp.source_url group by imp.doc_id)"""


def batch(t: Tables):
    rows = t.documents.selectExpr(*[c.strip() for c in _split(_COLUMNS.replace("sha256(text)", "sha2(text, 256)"))])
    req = F.transform(
        F.sequence(F.lit(1), F.col("req_count")), lambda i: F.concat(F.lit("req "), i.cast("string"))
    )
    rows = rows.withColumn("requirements", F.when(F.col("req_count") > 0, req).otherwise(T.empty_words()))
    rows = rows.withColumn("activities", T.empty_words()).drop("req_count")
    labels = t.labels.select("doc_id")
    stored = rows.join(labels, "doc_id", "left_semi").withColumnRenamed("doc_id", "job_id").withColumn(
        "imported_at", F.col("job_id")
    )
    return rows.join(labels, "doc_id", "left_anti").withColumnRenamed("doc_id", "import_id"), stored


def _split(columns: str) -> list[str]:
    """Top-level comma split of a select list."""
    parts, depth, current = [], 0, ""
    for c in columns:
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            parts.append(current)
            current = ""
        else:
            current += c
    return [*parts, current]


@query("j06_duplicate_lookup", f"with {BATCH} select import_id, existing_id from existing")
def j06(t: Tables):
    return I.find_duplicates(*batch(t))


_NORMAL = "trim(regexp_replace(strip_accents(replace(lower(text), 'ß', 'ss')), '[^\\p{L}\\p{N}]+', ' ', 'g'))"


@query("j06_normalized_lookup", f"""with {BATCH}, n as (select doc_id, {_NORMAL} as normal from documents),
met as (select imp.doc_id as import_id, s.doc_id as job_id from imp join n i on i.doc_id = imp.doc_id
    join n s on s.normal = i.normal and s.normal <> '' join sto on sto.doc_id = s.doc_id
  union all select imp.doc_id, sto.doc_id from imp join sto on sto.source_url = imp.source_url)
select import_id, min(job_id) as existing_id from met group by 1""")
def j06_normalized(t: Tables):
    incoming, stored = batch(t)
    # a third of the imports arrive in capitals, with other punctuation
    loud = F.concat(F.lit(" "), F.upper(F.replace("content", F.lit(" "), F.lit("  "))), F.lit("!"))
    third = F.col("import_id") % 3 == 0
    incoming = incoming.withColumn("content", F.when(third, loud).otherwise(F.col("content")))
    keys = ("normalized_hash", "source_url")
    incoming = I.normalized_keys(incoming, "import_id", "source_url")
    return I.find_duplicates(incoming, I.normalized_keys(stored, "job_id", "imported_at", "source_url"), keys)


@query("j06_reposted_jobs", f"""with n as (select doc_id, {_NORMAL} as normal from documents),
k as (select doc_id, case when normal = '' then concat('alone ', cast(doc_id as varchar)) else concat('text ', normal) end as k from n)
select doc_id as job_id, min(doc_id) over (partition by k) as first_id, count(*) over (partition by k) as postings from k""")
def j06_reposted(t: Tables):
    return I.reposted_jobs(t.documents.select(
        F.col("doc_id").alias("job_id"), F.col("doc_id").alias("imported_at"), F.col("text").alias("content")))


@query("k06_first_duplicate", """
select sha256(text) as content_hash, min(doc_id) as job_id from documents group by 1""")
def k06(t: Tables):
    jobs = t.documents.select(
        F.sha2("text", 256).alias("content_hash"), F.col("doc_id").alias("job_id"), F.col("doc_id").alias("imported_at")
    )
    return I.one_per_hash(jobs).select("content_hash", "job_id")


INGEST = f"""with recursive {BATCH},
um as (select *, row_number() over (order by doc_id) as rn from imp where doc_id not in (select import_id from existing)),
seq(rn, hashes, urls, leaders) as (
  select cast(0 as bigint), cast([] as varchar[]), cast([] as varchar[]), cast([] as bigint[])
  union all
  select um.rn,
    case when not list_contains(hashes, content_hash) and not coalesce(list_contains(urls, source_url), false)
      then list_append(hashes, content_hash) else hashes end,
    case when source_url is not null and not list_contains(hashes, content_hash) and not list_contains(urls, source_url)
      then list_append(urls, source_url) else urls end,
    case when not list_contains(hashes, content_hash) and not coalesce(list_contains(urls, source_url), false)
      then list_append(leaders, doc_id) else leaders end
  from seq join um on um.rn = seq.rn + 1),
lead as (select unnest(leaders) as doc_id from seq where rn = (select max(rn) from um)),
lk as (select u.doc_id, u.content_hash, u.source_url from um u join lead using (doc_id)),
tgt as (
  select import_id, cast(existing_id as varchar) as job, false as is_new from existing
  union all
  select u.doc_id, concat('new:', cast(min(lk.doc_id) as varchar)), u.doc_id in (select doc_id from lead)
  from um u join lk on lk.content_hash = u.content_hash or lk.source_url = u.source_url group by u.doc_id),
ev as (select i.*, t.job, t.is_new, i.source_type = 'pdf' and i.retrieval_method = 'mineru' as ocr,
    s.retrieval_method as stored_method
  from tgt t join imp i on i.doc_id = t.import_id left join sto s on cast(s.doc_id as varchar) = t.job),
ev2 as (select *, min(case when ocr then doc_id end) over (partition by job) as first_ocr,
    bool_or(is_new and ocr) over (partition by job) as new_by_ocr from ev),
ev3 as (select *, not is_new and (replace_existing or (ocr and doc_id = first_ocr and not new_by_ocr
    and coalesce(stored_method, '') <> 'mineru')) as replaces from ev2)"""


@query("g1_ingest_outcomes", f"""{INGEST}
select doc_id as import_id, case when is_new then 'inserted' when replaces then 'replaced' else 'duplicate' end as outcome,
  case when starts_with(job, 'new:') then 'batch' else job end as target from ev3""")
def g1_outcomes(t: Tables):
    incoming, stored = batch(t)
    outcomes, _ = I.ingest_jobs(incoming, stored)
    return outcomes.select(
        "import_id", "outcome",
        F.when(F.length("job_id") == 64, "batch").otherwise(F.col("job_id")).alias("target"),
    )


CHANGED = f"""{INGEST},
bases as (select job, max(case when is_new or replaces then doc_id end) as base from ev3 group by job),
x as (select e.*, b.base from ev3 e join bases b using (job)),
agg as (select job, any_value(base) as base,
    first(title order by doc_id) filter (where doc_id = base) as b_title,
    first(company order by doc_id) filter (where doc_id = base) as b_company,
    first(location order by doc_id) filter (where doc_id = base) as b_location,
    first(language order by doc_id) filter (where doc_id = base) as b_language,
    first(req_count order by doc_id) filter (where doc_id = base) as b_req,
    first(company order by doc_id) filter (where company <> '' and doc_id > coalesce(base, -1)) as f_company,
    first(location order by doc_id) filter (where location <> '' and doc_id > coalesce(base, -1)) as f_location,
    first(language order by doc_id) filter (where language <> '' and doc_id > coalesce(base, -1)) as f_language,
    first(req_count order by doc_id) filter (where req_count > 0 and doc_id > coalesce(base, -1)) as f_req
  from x group by job),
changed as (select case when a.base is null then s.title else b_title end as title,
  coalesce(nullif(case when a.base is null then s.company else b_company end, ''), f_company) as company,
  coalesce(nullif(case when a.base is null then s.location else b_location end, ''), f_location) as location,
  coalesce(nullif(case when a.base is null then s.language else b_language end, ''), f_language) as language,
  coalesce(nullif(case when a.base is null then s.req_count else b_req end, 0), f_req, 0) as requirement_count
from agg a left join sto s on cast(s.doc_id as varchar) = a.job)"""


@query("g1_ingest_jobs", f"{CHANGED} select * from changed")
def g1_jobs(t: Tables):
    incoming, stored = batch(t)
    _, jobs = I.ingest_jobs(incoming, stored)
    return jobs.select(
        "title", "company", "location", "language",
        F.coalesce(F.size("requirements"), F.lit(0)).cast("long").alias("requirement_count"),
    ).withColumn("requirement_count", F.greatest("requirement_count", F.lit(0)))


@query("g1_merged_table", f"""{CHANGED}
select title, company, location, language from changed
union all select title, company, location, language from sto where cast(doc_id as varchar) not in (select job from ev3)""")
def g1_merged(t: Tables):
    incoming, stored = batch(t)
    _, jobs = I.ingest_jobs(incoming, stored)
    return I.merge_jobs(stored, materialize(jobs, "changed-jobs")).select("title", "company", "location", "language")


@query("j07_company_get_or_create", """
with known as (select s_suppkey, s_name from supplier where s_acctbal > 0),
wanted as (select distinct trim(case when s_suppkey % 2 = 0 then upper(s_name) else concat(' ', s_name, ' ') end) as name from supplier)
select lower(s_name) as name_key, true as known from known
union all
select lower(name), false from wanted where lower(name) not in (select lower(s_name) from known) group by 1""")
def j07(t: Tables):
    companies = t.supplier.where("s_acctbal > 0").select(
        F.col("s_suppkey").cast("string").alias("company_id"), F.col("s_name").alias("name")
    )
    name = F.when(F.col("s_suppkey") % 2 == 0, F.upper("s_name")).otherwise(
        F.concat(F.lit(" "), "s_name", F.lit(" ")))
    return I.resolve_companies(t.supplier.select(name.alias("company")), companies).select(
        "name_key", (F.length("company_id") < 64).alias("known")
    )


@query("a12_child_counts", """
select o_orderkey as job_id, count(l_orderkey) as requirement_count from orders left join lineitem on l_orderkey = o_orderkey
group by o_orderkey""")
def a12(t: Tables):
    jobs = t.orders.select(F.col("o_orderkey").alias("job_id"))
    children = t.lineitem.select(F.col("l_orderkey").alias("job_id"))
    return I.child_counts(jobs, children, "requirement_count")


_DOC_META = """doc_id as job_id, text as content, case when n_chars % 2 = 0 then '' else concat('Title ', lang) end as title,
  cast(null as string) as company, case when n_chars % 3 = 0 then 'Berlin' end as location,
  cast(null as string) as work_model, cast(null as string) as employment_type, cast(null as string) as contract_term,
  case when n_chars % 5 = 0 then lang end as language"""
# candidates quote a piece of the text, sometimes altered; confidence and values vary
_CANDIDATES = {
    "title": ("concat(' Found ', lang)", "(n_chars % 100) / 100.0e0", "substr(text, 5, 40)"),
    "company": ("case when n_chars % 4 = 0 then ' ' else source end", "0.9e0", "upper(substr(text, 3, 30))"),
    "language": ("upper(lang)", "1.0e0", "substr(text, 1, 20)"),
    "work_model": ("'Remote'", "0.95e0", "case when n_chars % 2 = 0 then 'Benefit' else substr(text, 1, 12) end"),
    "location": ("'Nowhere'", "0.99e0", "'this sentence is not in the text'"),
}


@query("p11_accept_candidates", f"""
with jobs as (select {_DOC_META} from documents),
cand as ({" union all ".join(
    f"select doc_id as job_id, '{f}' as field, {v} as value, {c} as confidence, {e} as evidence from documents"
    for f, (v, c, e) in _CANDIDATES.items())}),
ok as (select c.job_id, field, case when field = 'language' then lower(trim(value)) else trim(value) end as value
  from cand c join jobs using (job_id)
  where trim(value) <> '' and (field <> 'language' or lower(trim(value)) in ('de', 'en')) and confidence >= 0.85 and evidence <> ''
    and contains(replace(lower(trim(regexp_replace(content, '\\s+', ' ', 'g'))), 'ß', 'ss'),
                 replace(lower(trim(regexp_replace(evidence, '\\s+', ' ', 'g'))), 'ß', 'ss'))
    and not (field = 'work_model' and contains(lower(evidence), 'benefit')))
select job_id, coalesce(nullif(title, ''), (select value from ok where ok.job_id = jobs.job_id and field = 'title')) as title,
  coalesce(company, (select value from ok where ok.job_id = jobs.job_id and field = 'company')) as company,
  coalesce(location, (select value from ok where ok.job_id = jobs.job_id and field = 'location')) as location,
  coalesce(work_model, (select value from ok where ok.job_id = jobs.job_id and field = 'work_model')) as work_model,
  coalesce(language, (select value from ok where ok.job_id = jobs.job_id and field = 'language')) as language
from jobs""")
def p11(t: Tables):
    jobs = t.documents.selectExpr(*_split(_DOC_META))
    rows = [
        t.documents.selectExpr("doc_id as job_id", f"'{f}' as field", f"{v} as value", f"{c} as confidence", f"{e} as evidence")
        for f, (v, c, e) in _CANDIDATES.items()
    ]
    candidates = rows[0]
    for other in rows[1:]:
        candidates = candidates.unionByName(other)
    return I.accept_candidates(jobs, candidates).select("job_id", "title", "company", "location", "work_model", "language")


_STORED_AD = "case when p_size % 3 = 0 then '' when p_size % 3 = 1 then concat('Stored ', p_name) end"


def _ads_with_metadata(t: Tables):
    return D.with_metadata(B.ads(t))


@query("p12_display_metadata", f"""with {AD_LINES}, {METADATA}
select meta.job_id, coalesce(nullif({_STORED_AD}, ''), meta.title) as title,
  coalesce(case when p_size % 2 = 0 then p_brand end, meta.company) as company
from meta join ads using (job_id)""")
def p12(t: Tables):
    jobs = _ads_with_metadata(t)
    company_row = F.when(F.col("p_size") % 2 == 0, F.col("p_brand"))
    return jobs.select(
        "job_id", I.display_value(F.expr(_STORED_AD), F.col("title")).alias("title"),
        I.display_value(company_row, F.col("company")).alias("company"),
    )


@query("p16_metadata_override", f"""with {AD_LINES}, {METADATA}
select meta.job_id, coalesce(nullif({_STORED_AD}, ''), meta.location) as location from meta join ads using (job_id)""")
def p16(t: Tables):
    return _ads_with_metadata(t).select(
        "job_id", I.override(F.col("location"), F.expr(_STORED_AD)).alias("location")
    )


@query("p17_edit_metadata", """
select s_suppkey as job_id,
  case when s_nationkey % 3 = 0 then nullif(trim(concat('  New ', s_name, ' ')), '') else s_name end as title,
  case when s_nationkey % 3 in (0, 1) then case when s_nationkey % 2 = 0 then null else 'Bonn' end
    else concat('City ', cast(s_nationkey as varchar)) end as location
from supplier""")
def p17(t: Tables):
    nation = F.col("s_nationkey")
    jobs = t.supplier.select(
        F.col("s_suppkey").alias("job_id"), F.col("s_name").alias("title"),
        F.concat(F.lit("City "), nation.cast("string")).alias("location"),
    )
    patches = t.supplier.where(nation % 3 != 2).select(
        F.col("s_suppkey").alias("job_id"),
        F.when(nation % 3 == 0, T.word_list(["title", "location"])).otherwise(T.word_list(["location"])).alias("set_fields"),
        F.concat(F.lit("  New "), "s_name", F.lit(" ")).alias("title"),
        F.when(nation % 2 == 0, "  ").otherwise("Bonn").alias("location"),
    )
    return I.edit_metadata(jobs, patches, ["title", "location"])


@query("p23_normalize_requirements", """
with l as (select doc_id, i - 1 as pos, ls[i] as line from (select doc_id, string_split(text, chr(10)) as ls from documents),
  unnest(generate_series(1, len(ls))) u(i)),
n as (select doc_id, pos, trim(line) as requirement,
    case when pos % 4 = 0 then 'other' else concat('cat', cast(pos % 4 as varchar)) end as category,
    case when pos % 3 = 0 then 'must' else 'should' end as priority,
    case when pos % 2 = 0 then 'Python,SQL' else '' end as keywords
  from l where length(trim(line)) >= 3)
select doc_id, requirement, category, priority, keywords from n""")
def p23(t: Tables):
    def item(line, i):
        blank = F.lit(None).cast("string")
        return F.struct(
            F.when(i % 5 == 4, "").otherwise(line).alias("requirement"), line.alias("activity"),
            F.when(i % 4 == 0, " ").otherwise(F.concat(F.lit("cat"), (i % 4).cast("string"))).alias("category"),
            F.when(i % 3 == 0, "must").when(i % 3 == 1, "urgent").otherwise(blank).alias("priority"),
            F.when(i % 2 == 0, T.word_list([" Python", "SQL", "Python ", ""])).otherwise(T.empty_words()).alias("keywords"),
        )

    lines = t.documents.select("doc_id", F.transform(F.split("text", "\n"), item).alias("items"))
    none = F.filter("items", lambda _: F.lit(False))
    rows = lines.select(
        "doc_id", F.explode(I.preferred_requirements(none, F.col("items"))).alias("r")
    )
    return rows.select("doc_id", "r.requirement", "r.category", "r.priority",
                       F.array_join("r.keywords", ",").alias("keywords"))


@query("g2_reimport_jobs", f"""with {AD_ITEMS}, {REQUIREMENT_ROWS}, clean as (select *, {'v'} as w from (
    select *, raw as v from lines)),
reqc as (select job_id, count(*) as requirement_count from reqs group by job_id),
actc as (select job_id, count(*) as activity_count from kept where section = 'activity' group by job_id)
select job_id, coalesce(requirement_count, 0) as requirement_count, coalesce(activity_count, 0) as activity_count,
  case when p_size % 2 = 0 then 'title_not_detected' else '' end as warnings, 'analyzing' as status
from ads left join reqc using (job_id) left join actc using (job_id)""")
def g2(t: Tables):
    from fitweave.plans.extraction import reimport_jobs

    stored = B.ads(t).withColumn(
        "import_warnings",
        F.when(F.col("p_size") % 2 == 0, T.word_list(["semantic_metadata_fallback_used", "title_not_detected"]))
        .otherwise(T.word_list(["semantic_metadata_incomplete"])),
    )
    return reimport_jobs(stored).select(
        "job_id", F.size("requirements").cast("long").alias("requirement_count"),
        F.size("activities").cast("long").alias("activity_count"),
        F.array_join("import_warnings", ",").alias("warnings"), "status",
    )


@query("g2_incremental_reimport", f"""with {AD_ITEMS}, {REQUIREMENT_ROWS},
reqc as (select job_id, count(*) as requirement_count from reqs group by job_id),
actc as (select job_id, count(*) as activity_count from kept where section = 'activity' group by job_id)
select job_id, coalesce(requirement_count, 0) as requirement_count, coalesce(activity_count, 0) as activity_count,
  'analyzing' as status, p_size % 5 = 0 as fresh
from ads left join reqc using (job_id) left join actc using (job_id)""")
def g2_incremental(t: Tables):
    """The second of two runs: a fifth of the texts was touched since, only these are extracted again."""
    from fitweave.plans.extraction import reimport_incremental

    folder = scratch_path(t.spark, "extractions")
    stored = B.ads(t).withColumn("import_warnings", T.empty_words())
    reimport_incremental(stored, folder, 0)
    touched = F.when(F.col("p_size") % 5 == 0, F.concat("content", F.lit("\n\n"))).otherwise(F.col("content"))
    return reimport_incremental(stored.withColumn("content", touched), folder, 1).select(
        "job_id", F.size("requirements").cast("long").alias("requirement_count"),
        F.size("activities").cast("long").alias("activity_count"), "status", "fresh",
    )


@query("g3_backfill_fill", f"""with {AD_LINES}, {METADATA}
select ads.job_id, coalesce(case when p_size % 3 = 0 then p_type end, meta.location) as location,
  coalesce(case when p_size % 2 = 0 then p_brand end, meta.work_model) as work_model
from ads join meta using (job_id)""")
def g3_fill(t: Tables):
    jobs = _ads_with_metadata(t)
    return I.backfill(_stored_ads(jobs), jobs.select("job_id", "location", "work_model"), ["location", "work_model"])


@query("g3_backfill_repair", f"""with {AD_LINES}, {METADATA}
select ads.job_id, coalesce(meta.location, case when p_size % 3 = 0 then p_type end) as location,
  coalesce(meta.work_model, case when p_size % 2 = 0 then p_brand end) as work_model
from ads join meta using (job_id)""")
def g3_repair(t: Tables):
    jobs = _ads_with_metadata(t)
    return I.backfill(
        _stored_ads(jobs), jobs.select("job_id", "location", "work_model"), ["location", "work_model"], repair=True
    )


def _stored_ads(jobs):
    return jobs.select(
        "job_id", F.when(F.col("p_size") % 3 == 0, F.col("p_type")).alias("location"),
        F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("work_model"),
    )


@query("g5_assign_single_profile", """
select l_orderkey as job_id, l_linenumber as requirement_id, coalesce(case when l_quantity > 25 then cast(l_suppkey as varchar) end,
  (select case when count(*) = 1 then min(cast(n_nationkey as varchar)) end from nation where n_nationkey = 7)) as profile_id,
  coalesce(case when l_quantity > 25 then cast(l_suppkey as varchar) end,
  (select case when count(*) = 1 then min(cast(c_custkey as varchar)) end from customer)) as profile_of_many
from lineitem""")
def g5(t: Tables):
    known = F.when(F.col("l_quantity") > 25, F.col("l_suppkey").cast("string"))
    matches = t.lineitem.select(
        F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("requirement_id"), known.alias("profile_id"),
        known.alias("kept"),
    )
    single = t.nation.where("n_nationkey = 7").select(F.col("n_nationkey").cast("string").alias("profile_id"))
    many = t.customer.select(F.col("c_custkey").cast("string").alias("profile_id"))
    one = I.assign_single_profile(matches, single)
    return I.assign_single_profile(
        one.withColumnRenamed("profile_id", "first").withColumnRenamed("kept", "profile_id"), many
    ).select("job_id", "requirement_id", F.col("first").alias("profile_id"), F.col("profile_id").alias("profile_of_many"))


@query("s06_sink_jobs", f"""with {AD_ITEMS}, {REQUIREMENT_ROWS}
select 'requirement' as child, job_id, position, requirement as text from reqs
union all select section, job_id, position, text from kept where section <> 'requirement'""")
def s06(t: Tables):
    from fitweave.session import scratch_path
    from fitweave.sources import tables

    folder = scratch_path(t.spark, "jobs")
    jobs = X.with_structure(B.ads(t).select("job_id", "content"))
    for part in (0, 1):
        tables.write_jobs(jobs.where(F.pmod(F.xxhash64("job_id"), F.lit(2)) == part), folder, part)
    parts = [("requirement", "job_requirements", "requirement"), ("activity", "job_activities", "activity"),
             ("benefit", "job_benefits", "benefit")]
    frames = [
        tables.read_batches(t.spark, folder, name).select(
            F.lit(kind).alias("child"), "job_id", "position", F.col(column).alias("text"))
        for kind, name, column in parts
    ]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query("w06_positions", """
select doc_id as job_id, i - 1 as position, trim(ls[i]) as activity from (
  select doc_id, list_filter(string_split(text, chr(10)), lambda l: trim(l) <> '') as ls from documents),
  unnest(generate_series(1, len(ls))) u(i)""")
def w06(t: Tables):
    lines = F.filter(F.split("text", "\n"), lambda v: F.trim(v) != "")
    return t.documents.select(F.col("doc_id").alias("job_id"), F.posexplode(lines).alias("position", "line")).select(
        "job_id", "position", F.trim("line").alias("activity")
    )


@query("w05_first_seen_values", """
select doc_id, position, line from (
  select doc_id, pos as position, line, row_number() over (partition by doc_id, lower(line) order by pos) as n from (
    select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos
    from documents) where trim(line) <> '') where n = 1""")
def w05_values(t: Tables):
    placed = F.transform(F.split("text", "\n"), lambda line, i: F.struct(i.alias("position"), line.alias("line")))
    firsts = T.distinct_by(F.filter(placed, lambda p: F.trim(p["line"]) != ""), lambda p: F.lower(p["line"]))
    return t.documents.select("doc_id", F.inline(firsts))


@query("w05_first_seen_lines", """
select doc_id, min(pos) as first_position, count(*) as copies from (
  select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from documents)
where trim(line) <> '' group by doc_id, lower(line)""")
def w05(t: Tables):
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.where(F.trim("line") != "").groupBy("doc_id", F.lower("line").alias("key")).agg(
        F.min("pos").alias("first_position"), F.count(F.lit(1)).alias("copies")
    ).drop("key")


@query("s05_scan_job_table", """
select 'count' as what, cast(count(*) as varchar) as value from documents
union all select concat('source:', source), cast(count(*) as varchar) from documents group by source
union all select 'latest', cast(max(doc_id) as varchar) from documents""")
def s05(t: Tables):
    jobs = t.documents.select("doc_id", "source")
    total = jobs.agg(F.count(F.lit(1)).cast("string").alias("value")).select(F.lit("count").alias("what"), "value")
    by_source = jobs.groupBy("source").agg(F.count(F.lit(1)).cast("string").alias("value")).select(
        F.concat(F.lit("source:"), "source").alias("what"), "value")
    latest = jobs.orderBy(F.desc("doc_id")).limit(1).select(
        F.lit("latest").alias("what"), F.col("doc_id").cast("string").alias("value"))
    return total.unionByName(by_source).unionByName(latest)


@query("a18_job_count", "select count(*) as jobs from documents")
def a18(t: Tables):
    return t.documents.agg(F.count(F.lit(1)).alias("jobs"))


@query("k01_latest_job", "select doc_id as job_id from documents order by doc_id desc limit 1")
def k01(t: Tables):
    jobs = t.documents.select(F.col("doc_id").alias("job_id"), F.col("doc_id").alias("imported_at"))
    return I.latest_import(jobs).select("job_id")


@query("p18_match_context", f"""with {B.CONTEXT}
select 'pair' as part, job_id, profile_id, null::bigint as evidence_id from pairs
union all select distinct 'job', job_id, null::bigint, null::bigint from pairs
union all select 'evidence', null::bigint, profile_id, evidence_id from ev where profile_id in (select profile_id from pairs)""")
def p18(t: Tables):
    from fitweave.operators.reports import matching_context

    return B.shown_context(*matching_context(*B.context_inputs(t)))
