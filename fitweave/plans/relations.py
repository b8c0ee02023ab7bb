"""Queries on jobs, applications and companies: joins, lists, dashboard."""

from __future__ import annotations

from pyspark.sql import functions as F

from fitweave import vocab
from fitweave.functions import text as T
from fitweave.operators import dashboard as D
from fitweave.operators import reports as R
from fitweave.operators import structure as ST
from fitweave.plans import bindings as B
from fitweave.plans.corpus import AD_ITEMS, REQUIREMENT_ROWS
from fitweave.operators.search import search_many
from fitweave.plans.registry import Tables, query
from fitweave.session import spread_rows


def companies(t: Tables):
    return t.nation.select(F.col("n_nationkey").alias("company_id"), F.col("n_name").alias("company"))


def jobs(t: Tables):
    """Orders as jobs; every fourth nation key has no company row."""
    return t.orders.join(t.customer, t.orders.o_custkey == t.customer.c_custkey).select(
        F.col("o_orderkey").alias("job_id"),
        F.when(F.col("c_nationkey") % 4 != 0, F.col("c_nationkey")).alias("company_id"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("title"),
        F.col("o_orderdate").alias("imported_at"),
        F.when(F.col("o_orderstatus") == "P", F.col("o_orderdate")).alias("archived_at"),
        F.col("o_custkey").alias("profile_id"),
        F.concat(F.lit("Straße "), "c_mktsegment").alias("location"),
        F.lit("Remote möglich").alias("work_model"), F.lit(None).cast("string").alias("employment_type"),
        F.lit("").alias("source_portal"),
    )


JOBS = """jobs as (select o_orderkey as job_id, case when c_nationkey % 4 <> 0 then c_nationkey end as company_id,
    case when o_orderpriority <> '5-LOW' then o_orderpriority end as title, o_orderdate as imported_at,
    case when o_orderstatus = 'P' then o_orderdate end as archived_at, o_custkey as profile_id, concat('Straße ', c_mktsegment) as location
  from orders join customer on c_custkey = o_custkey),
named as (select j.*, n_name as company from jobs j left join nation on n_nationkey = j.company_id),
matched as (select distinct l_orderkey as job_id from lineitem where l_quantity > 30),
apps as (select l_orderkey as job_id, l_linenumber as n, case l_returnflag when 'A' then 'applied' when 'R' then 'rejected' else 'interview' end as status
  from lineitem where l_linenumber <= 2)"""


def matches(t: Tables):
    return t.lineitem.where("l_quantity > 30").select(F.col("l_orderkey").alias("job_id"))


def applications(t: Tables):
    flag = F.col("l_returnflag")
    return t.lineitem.where("l_linenumber <= 2").select(
        F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("n"),
        F.when(flag == "A", "applied").when(flag == "R", "rejected").otherwise("interview").alias("status"),
    )


@query("j01_jobs_with_companies", f"with {JOBS} select job_id, title, company from named")
def j01(t: Tables):
    return R.with_companies(jobs(t), companies(t)).select("job_id", "title", "company")


@query("j02_applications_report", f"""with {JOBS}
select job_id, n, status, title, company, c_name as display_name from apps join named using (job_id) join customer on c_custkey = named.profile_id""")
def j02(t: Tables):
    profiles = t.customer.select(F.col("c_custkey").alias("profile_id"), F.col("c_name").alias("display_name"))
    return R.applications_report(applications(t), jobs(t), companies(t), profiles).select(
        "job_id", "n", "status", "title", "company", "display_name"
    )


@query("j03_requirements_with_matches", f"""with {B.SCORED},
r as (select l_orderkey as job_id, l_linenumber as requirement_id, max(l_quantity) as quantity from lineitem group by all)
select job_id, requirement_id, quantity, priority, match_level from r join scored using (job_id, requirement_id)""")
def j03(t: Tables):
    requirements = t.lineitem.groupBy(
        F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("requirement_id")
    ).agg(F.max("l_quantity").alias("quantity"))
    stored = B.scored_matches(t).select("job_id", "requirement_id", "priority", "match_level")
    return R.stored_matches(requirements, stored)


@query("j09_has_matching", f"with {JOBS} select job_id, job_id in (select job_id from matched) as has_matching from jobs")
def j09(t: Tables):
    return R.with_has_matching(jobs(t), matches(t)).select("job_id", "has_matching")


@query("j10_open_jobs", "select c_custkey as job_id from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'F')")
def j10(t: Tables):
    applied = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("job_id"))
    return R.open_jobs(t.customer.select(F.col("c_custkey").alias("job_id")), applied)


@query("j12_cascade_delete", """
with gone as (select o_orderkey from orders where o_orderstatus = 'P')
select 'orders' as child, o_orderkey as job_id, 0 as n from orders where o_orderkey not in (select * from gone)
union all select 'lineitem', l_orderkey, l_linenumber from lineitem where l_orderkey not in (select * from gone)""")
def j12(t: Tables):
    gone = t.orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("job_id"))
    children = {
        "orders": t.orders.select(F.col("o_orderkey").alias("job_id"), F.lit(0).alias("n")),
        "lineitem": t.lineitem.select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("n")),
    }
    left = R.cascade_delete(gone, children)
    return left["orders"].withColumn("child", F.lit("orders")).unionByName(
        left["lineitem"].withColumn("child", F.lit("lineitem"))
    )


@query("j14_application_lookup", """
with pairs as (select distinct p_partkey as job_id, p_size as profile_id from part),
a as (select distinct o_orderkey as job_id, o_custkey % 50 as profile_id, o_orderstatus as status from orders)
select p.job_id, p.profile_id, a.status from pairs p left join a using (job_id, profile_id)""")
def j14(t: Tables):
    pairs = t.part.select(F.col("p_partkey").alias("job_id"), F.col("p_size").cast("long").alias("profile_id")).distinct()
    found = t.orders.select(
        F.col("o_orderkey").alias("job_id"), (F.col("o_custkey") % 50).alias("profile_id"), F.col("o_orderstatus").alias("status")
    ).distinct()
    return R.find_applications(pairs, found)


@query("j14_repeated_pairs", """
select l_orderkey as job_id, l_suppkey as profile_id, count(*) as n from lineitem group by all having count(*) > 1""")
def j14_repeated(t: Tables):
    return R.repeated_pairs(t.lineitem.select(F.col("l_orderkey").alias("job_id"), F.col("l_suppkey").alias("profile_id")))


@query("p13_active_jobs", f"with {JOBS} select job_id, archived_at is null as active from jobs")
def p13(t: Tables):
    rows = jobs(t)
    return R.active(rows).select("job_id", F.lit(True).alias("active")).unionByName(
        R.active(rows, archived=True).select("job_id", F.lit(False).alias("active"))
    )


@query("p14_keyword_search", """
select p_partkey from part where contains(strip_accents(lower(concat_ws(' ', p_name, p_brand, 'Zürich', p_type))), 'small')
  and contains(strip_accents(lower(concat_ws(' ', p_name, p_brand, 'Zürich', p_type))), 'brand#1')
  and contains(strip_accents(lower(concat_ws(' ', p_name, p_brand, 'Zürich', p_type))), 'zurich')""")
def p14(t: Tables):
    rows = t.part.withColumn("place", F.lit("Zürich"))
    return D.keyword_search(rows, "Small  BRAND#1 zürich", ["p_name", "p_brand", "place", "p_type"]).select("p_partkey")


# one search per supplier: two terms, one of a single sign, accents and capitals, one with no hit, one without terms
_SEARCH = """case when s_suppkey % 50 = 7 then ' ' when s_suppkey % 5 = 0 then concat('Ring  brand#', cast(s_nationkey as string))
  when s_suppkey % 5 = 1 then concat(cast(s_nationkey % 10 as string), ' small ZÜRICH')
  when s_suppkey % 5 = 2 then concat('d w #', cast(s_nationkey as string))
  when s_suppkey % 5 = 3 then concat('e ', cast(s_suppkey as string), '0') else 'econ RÏNG zürichs' end"""


@query("p14_search_table", f"""with s as (select s_suppkey as search_id, strip_accents(lower({_SEARCH})) as terms from supplier),
q as (select search_id, list_filter(string_split_regex(terms, '\\s+'), lambda t: t <> '') as terms from s),
j as (select p_partkey as job_id, strip_accents(lower(concat_ws(' ', p_name, p_brand, 'Zürich', p_type))) as text from part)
select search_id, job_id from q, j where len(list_filter(terms, lambda t: not contains(text, t))) = 0""")
def p14_table(t: Tables):
    rows = spread_rows(t.part, t.part).withColumn("place", F.lit("Zürich")).withColumnRenamed("p_partkey", "job_id")
    searches = t.supplier.select(F.col("s_suppkey").alias("search_id"), F.expr(_SEARCH).alias("terms"))
    return search_many(rows, searches, ["p_name", "p_brand", "place", "p_type"])


@query("p15_status_filter", f"""with {JOBS}, f as (select *, job_id in (select job_id from matched) as has_matching from named)
select 'archived' as filter, job_id, null as status from f where archived_at is not null
union all select 'open', job_id, null from f where archived_at is null and has_matching and job_id not in (select job_id from apps)
union all select 'applied', f.job_id, a.status from f join apps a using (job_id) where archived_at is null and not has_matching and a.status = 'applied'""")
def p15(t: Tables):
    rows = R.with_has_matching(jobs(t), matches(t))
    shown = [("archived", ""), ("open", "matched"), ("applied", "unmatched")]
    frames = [
        D.status_filter(rows, applications(t), status, matching).select(F.lit(status).alias("filter"), "job_id", "status")
        for status, matching in shown
    ]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query("a16_duplicate_name_counts", f"""with {JOBS}
select job_id, count(*) over (partition by lower(coalesce(title, '')), lower(coalesce(company, ''))) as same_name from named""")
def a16(t: Tables):
    return D.name_counts(R.with_companies(jobs(t), companies(t))).select("job_id", "same_name")


@query("d1_dashboard", f"""with {JOBS}, f as (select *, job_id in (select job_id from matched) as has_matching,
  count(*) over (partition by lower(coalesce(title, '')), lower(coalesce(company, ''))) as same_name from named)
select f.job_id, f.title, f.company, f.same_name, f.has_matching, a.status from f join apps a using (job_id)
where archived_at is null and a.status = 'interview'
  and contains(lower(concat_ws(' ', title, company, location)), 'nation_1') and contains(lower(concat_ws(' ', title, company, location)), 'straße build')""")
def d1(t: Tables):
    rows = R.with_companies(jobs(t), companies(t))
    # "straße" and the segment are one neighbouring phrase in the text, searched as two terms
    found = D.dashboard(rows, applications(t), matches(t), "nation_1 straße build", "interview")
    return found.select("job_id", "title", "company", "same_name", "has_matching", "status")


@query("k04_newest_first", f"""with {JOBS}
select 'application' as what, job_id as id, {B.shown_sql('imported_at')} as at from jobs
union all select 'event', event_id, {B.shown_sql('ts')} from events order by 3 desc, 2 desc""")
def k04(t: Tables):
    applications_ = jobs(t).select(F.lit("application").alias("what"), F.col("job_id").alias("id"), F.col("imported_at").alias("at"))
    events = t.events.select(F.lit("event").alias("what"), F.col("event_id").alias("id"), F.col("ts").alias("at"))
    both = applications_.unionByName(events).orderBy(F.desc("at"), F.desc("id"))
    return both.withColumn("at", B.shown(F.col("at")))


@query("m3_job_detail", f"""with {AD_ITEMS}, {REQUIREMENT_ROWS},
r as (select job_id, string_agg(concat(category, '/', priority, '/', requirement), '|' order by category, priority, requirement) as requirements from reqs group by job_id),
a as (select job_id, string_agg(text, '|' order by position) as activities from kept where section = 'activity' group by job_id)
select ads.job_id, 'Unbenannte Stelle' as title, n_name as company, requirements, activities
from ads left join nation on n_nationkey = ads.job_id % 30 left join r using (job_id) left join a using (job_id)""")
def m3(t: Tables):
    detail = ST.with_structure(B.ads(t).select("job_id", "content"))
    rows = detail.select("job_id", (F.col("job_id") % 30).cast("int").alias("company_id"), F.lit(None).cast("string").alias("title"))
    shown = R.job_detail(rows, companies(t), ST.requirement_rows(detail), ST.activity_rows(detail))
    return shown.select(
        "job_id", "title", "company",
        F.array_join(F.transform("requirements", lambda r: F.concat_ws("/", r["category"], r["priority"], r["requirement"])), "|").alias("requirements"),
        F.array_join(F.transform("activities", lambda a: a["activity"]), "|").alias("activities"),
    )


@query("m3_detail_chunks", """
select l_suppkey as job_id, n // 100 as chunk, min(n) + 1 as first, string_agg(concat(l_orderkey, ':', l_linenumber), ',' order by n) as items
from (select l_suppkey, l_orderkey, l_linenumber, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber) - 1 as n from lineitem)
group by 1, 2""")
def m3_chunks(t: Tables):
    children = t.lineitem.select(F.col("l_suppkey").alias("job_id"), "l_orderkey", "l_linenumber")
    chunks = R.detail_chunks(children, ["l_orderkey", "l_linenumber"], size=100)
    shown = F.transform("items", lambda i: F.concat_ws(":", i["l_orderkey"], i["l_linenumber"]))
    return chunks.select("job_id", "chunk", "first", F.array_join(shown, ",").alias("items"))


@query("m4_job_list", f"""with {JOBS}
select job_id, coalesce(title, 'Unbenannte Stelle') as title, company, {B.shown_sql('imported_at')} as imported_at,
  job_id in (select job_id from matched) as has_matching from named where archived_at is null order by named.imported_at desc, job_id desc""")
def m4(t: Tables):
    return R.job_list(jobs(t), companies(t), matches(t)).select(
        "job_id", "title", "company", B.shown(F.col("imported_at")).alias("imported_at"), "has_matching"
    )


@query("p19_document_context", f"""with {B.CONTEXT}, {B.REQUIREMENTS},
m as (select distinct job_id from requirements where length(requirement) > 200),
kept as (select * from pairs where job_id in (select job_id from m) and (job_id + profile_id) % 3 <> 0)
select 'pair' as part, job_id, profile_id, null::bigint as evidence_id from kept
union all select distinct 'job', job_id, null::bigint, null::bigint from kept
union all select 'evidence', null::bigint, profile_id, evidence_id from ev where profile_id in (select profile_id from kept)
union all select 'rejected', job_id, profile_id, null::bigint from pairs
  where not (job_id in (select job_id from m) and (job_id + profile_id) % 3 <> 0)""")
def p19(t: Tables):
    pairs, docs, evidence = B.context_inputs(t)
    long_lines = B.document_requirements(t).where(F.length("requirement") > 200).select("job_id")
    stored = pairs.join(long_lines.distinct(), "job_id", "left_semi").where((F.col("job_id") + F.col("profile_id")) % 3 != 0)
    kept, rejected = R.document_pairs(pairs, stored)
    return B.shown_context(*R.matching_context(kept, docs, evidence)).unionByName(
        rejected.select(F.lit("rejected").alias("part"), "job_id", "profile_id", F.lit(None).cast("long").alias("evidence_id"))
    )


@query("p20_review_payload", """
with l as (select doc_id, string_split(text, chr(10)) as ls from documents)
select doc_id, len(ls) as items, array_to_string(list_transform(ls, lambda x: md5(x)), ',') as digests from l""")
def p20(t: Tables):
    evidence = F.transform(
        F.split("text", "\n"), lambda line, i: F.struct(i.cast("string").alias("evidence_id"), line.alias("evidence_text"))
    )
    rows = t.documents.select("doc_id", R.review_evidence(evidence).alias("e"))
    return rows.select(
        "doc_id", F.size("e").cast("long").alias("items"),
        F.array_join(F.transform("e", lambda x: F.md5(x["evidence_text"])), ",").alias("digests"),
    )
