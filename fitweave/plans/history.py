"""Queries on application events and reviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from fitweave import vocab
from fitweave.functions import taxonomy
from fitweave.operators import history as H
from fitweave.operators import ranking
from fitweave.operators import reviews as R
from fitweave.plans import bindings as B
from fitweave.plans.registry import Tables, query

EVENTS = f"with {B.APP_EVENTS}"
REVIEWS = f"with {B.REVIEWS}"


def state_sql(events: str, applications: str = "apps") -> str:
    """Fold by ordered aggregates over filtered rows; one CTE per pick."""
    order = "order by occurred_at, event_id"
    down = "order by occurred_at desc, event_id desc"
    state = "event_type in ('created','status_change') and status is not null and status <> ''"
    return f"""folded as (
  select application_id,
    first(status {down}) filter (where {state}) as s,
    max(occurred_at) filter (where {state}) as s_at,
    coalesce(min(occurred_at) filter (where {state} and status = 'applied'),
             min(occurred_at) filter (where {state} and status = 'followed_up')) as a_at,
    first(channel {order}) filter (where {state} and status = 'applied' and channel <> '') as a_channel,
    first(portal_name {order}) filter (where {state} and status = 'applied'
      and channel = 'job_portal' and portal_name <> '') as a_portal,
    first(channel {down}) filter (where channel <> '' and status is distinct from 'applied') as r_channel,
    first(portal_name {down}) filter (where channel = 'job_portal'
      and status is distinct from 'applied') as r_portal,
    first(note {down}) filter (where note <> '') as n
  from {events} group by application_id),
state as (
  select a.application_id, coalesce(f.s, 'draft') as status,
    case when f.s is null then a.created_at else f.s_at end as status_changed_at,
    case when f.s is not null then f.a_at end as applied_at,
    case when f.s is not null then f.a_channel end as application_channel,
    case when f.s is not null then f.a_portal end as application_portal_name,
    case when f.s is not null then f.r_channel end as response_channel,
    case when f.s is not null then f.r_portal end as response_portal_name,
    f.n as notes
  from {applications} a left join folded f using (application_id))"""


STATE_OUT = f"""select application_id, status, {B.shown_sql('status_changed_at')} as status_changed_at,
  {B.shown_sql('applied_at')} as applied_at, application_channel, application_portal_name,
  response_channel, response_portal_name, notes from state"""
APPS = "apps as (select application_id, min(occurred_at) as created_at from app_events group by application_id)"


def _shown_state(state):
    return state.withColumn("status_changed_at", B.shown(F.col("status_changed_at"))).withColumn(
        "applied_at", B.shown(F.col("applied_at"))
    )


@query("h1_rebuild_application_state", f"{EVENTS}, {APPS}, {state_sql('app_events')} {STATE_OUT}")
def h1(t: Tables):
    events = B.application_events(t)
    return _shown_state(H.rebuild_application_state(events, B.applications_of(events)))


@query("h2_apply_status", f"""{EVENTS}
select application_id,
  first(status order by event_id desc) filter (where status is not null) as status,
  {B.shown_sql("first(occurred_at order by event_id desc) filter (where status is not null)")} as status_changed_at,
  {B.shown_sql("first(occurred_at order by event_id) filter (where status in ('applied','followed_up'))")} as applied_at,
  first(channel order by event_id desc) filter (where status = 'applied' and channel <> '') as application_channel,
  first(case when channel = 'job_portal' then portal_name end order by event_id desc)
    filter (where status = 'applied') as application_portal_name,
  first(channel order by event_id desc) filter (where status <> 'applied' and channel <> '') as response_channel,
  first(case when channel = 'job_portal' then portal_name end order by event_id desc)
    filter (where status = 'followed_up' or (status <> 'applied' and channel <> '')) as response_portal_name
from app_events group by application_id""")
def h2(t: Tables):
    return _shown_state(H.apply_statuses(B.application_events(t)))


def event_changes(events):
    """Late corrections and deletions found in the event log itself."""
    patches = events.where((F.col("event_type") == "status_change") & (F.col("value") > 40)).select(
        "event_id", F.lit(None).cast("string").alias("event_type"),
        F.lit("interview").alias("status"),
        (F.col("occurred_at") + F.expr("interval 3 days")).alias("occurred_at"),
        F.lit("job_portal").alias("channel"), F.lit("PX").alias("portal_name"),
        F.lit("edited").alias("note"),
    )
    tombstones = events.where((F.col("event_type") == "note") & (F.col("k") > 60)).select("event_id")
    return patches, tombstones


@query("h3_edit_and_rebuild", f"""{EVENTS}, {APPS},
edited as (
  select event_id, application_id, event_type,
    case when p then 'interview' else status end as status,
    case when p then occurred_at + interval 3 day else occurred_at end as occurred_at,
    case when p then 'job_portal' else channel end as channel,
    case when p then 'PX' else portal_name end as portal_name,
    case when p then 'edited' else note end as note
  from (select *, event_type = 'status_change' and value > 40 as p from app_events)
  where not (event_type = 'note' and k > 60)),
touched as (select distinct application_id from app_events
  where (event_type = 'status_change' and value > 40) or (event_type = 'note' and k > 60)),
touched_apps as (select * from apps where application_id in (select application_id from touched)),
{state_sql('edited', 'touched_apps')} {STATE_OUT}""")
def h3(t: Tables):
    events = B.application_events(t)
    patches, tombstones = event_changes(events)
    touched = H.touched_applications(events, patches, tombstones)
    edited = H.edit_events(events, patches, tombstones).join(touched, "application_id", "left_semi")
    applications = B.applications_of(events).join(touched, "application_id", "left_semi")
    return _shown_state(H.rebuild_application_state(edited, applications))


@query("h4_application_timeline", f"""{EVENTS}, {APPS}, {state_sql('app_events')}
select e.application_id, e.event_id, e.event_type, e.status, {B.shown_sql('e.occurred_at')} as occurred_at,
  e.channel, e.note, s.status as current_status, {B.shown_sql('s.applied_at')} as applied_at
from app_events e join state s using (application_id)""")
def h4(t: Tables):
    events = B.application_events(t)
    state = H.rebuild_application_state(events, B.applications_of(events))
    return H.timeline(events, state).select(
        "application_id", "event_id", "event_type", "status", B.shown(F.col("occurred_at")).alias("occurred_at"),
        "channel", "note", "current_status", B.shown(F.col("applied_at")).alias("applied_at"),
    )


@query("w9_first_last_events", f"""{EVENTS}
select application_id, min(event_id) as first_event, max(event_id) as last_event,
  {B.shown_sql('min(occurred_at)')} as first_at, {B.shown_sql('max(occurred_at)')} as last_at,
  first(event_type order by occurred_at, event_id) as first_type,
  first(event_type order by occurred_at desc, event_id desc) as last_type
from app_events group by application_id""")
def w9(t: Tables):
    order = F.struct(*H.ORDER)
    return B.application_events(t).groupBy("application_id").agg(
        F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"),
        B.shown(F.min("occurred_at")).alias("first_at"), B.shown(F.max("occurred_at")).alias("last_at"),
        F.min_by("event_type", order).alias("first_type"), F.max_by("event_type", order).alias("last_type"),
    )


@query("w8_revision_numbers", """
select user_id as entity_id, event_id, event_type as action,
  row_number() over (partition by user_id order by ts, event_id) as revision from events""")
def w8(t: Tables):
    return ranking.number_rows(
        t.events.select(F.col("user_id").alias("entity_id"), "event_id", F.col("event_type").alias("action"), "ts"),
        ["entity_id"], [F.col("ts"), F.col("event_id")], "revision",
    ).drop("ts")


@query("p24_validate_vocabulary", f"""{EVENTS},
odd as (select event_id,
    case when k > 95 then 'imported' else event_type end as event_type,
    case when k between 90 and 95 then 'waiting_response' else status end as status,
    case when k between 80 and 85 then 'fax' else channel end as channel from app_events)
select event_id, case when event_type not in ({B.sql_words(vocab.EVENT_TYPES)}) then 'event_type'
  when status not in ({B.sql_words(vocab.APPLICATION_STATUSES)}) then 'status'
  when channel not in ({B.sql_words(vocab.APPLICATION_CHANNELS)}) then 'channel' end as reject_reason
from odd""")
def p24(t: Tables):
    k = F.col("k")
    odd = (
        B.application_events(t)
        .withColumn("event_type", F.when(k > 95, "imported").otherwise(F.col("event_type")))
        .withColumn("status", F.when(k.between(90, 95), "waiting_response").otherwise(F.col("status")))
        .withColumn("channel", F.when(k.between(80, 85), "fax").otherwise(F.col("channel")))
    )
    accepted, rejected = H.validate_events(odd)
    return accepted.select("event_id", F.lit(None).cast("string").alias("reject_reason")).unionByName(
        rejected.select("event_id", "reject_reason")
    )


@query("g4_remap_status", f"""{EVENTS},
both_tables as (
  select 'event' as source, event_id as row_id, case when k > 90 then 'waiting_response' else status end as status
  from app_events
  union all
  select 'application', o_orderkey, case o_orderstatus when 'P' then 'waiting_response' when 'F' then 'applied'
    else 'draft' end from orders)
select source, row_id, case when status = 'waiting_response' then 'followed_up' else status end as status
from both_tables""")
def g4(t: Tables):
    events = B.application_events(t).select(
        F.lit("event").alias("source"), F.col("event_id").alias("row_id"),
        F.when(F.col("k") > 90, "waiting_response").otherwise(F.col("status")).alias("status"),
    )
    status = F.col("o_orderstatus")
    applications = t.orders.select(
        F.lit("application").alias("source"), F.col("o_orderkey").alias("row_id"),
        F.when(status == "P", "waiting_response").when(status == "F", "applied").otherwise("draft").alias("status"),
    )
    both = H.remap_status(events, "waiting_response", "followed_up").unionByName(
        H.remap_status(applications, "waiting_response", "followed_up")
    )
    return both


_STATUS_SQL = " ".join(f"when '{k}' then '{v}'" for k, v in vocab.STATUS_LABELS.items())
_CHANNEL_SQL = " ".join(f"when '{k}' then '{v}'" for k, v in vocab.CHANNEL_LABELS.items())


@query("f19_status_and_channel_labels", f"""{EVENTS}
select event_id, case status {_STATUS_SQL} end as status_label, case channel {_CHANNEL_SQL} end as channel_label
from app_events""")
def f19(t: Tables):
    return B.application_events(t).select(
        "event_id",
        taxonomy.label(F.col("status"), vocab.STATUS_LABELS).alias("status_label"),
        taxonomy.label(F.col("channel"), vocab.CHANNEL_LABELS).alias("channel_label"),
    )


# --- reviews -------------------------------------------------------------------

@query("w1_keep_latest_review", f"""{REVIEWS}
select subject_type, subject_id, review_type, review_id, attempt, decision from (
  select *, row_number() over (partition by subject_type, subject_id, review_type
    order by attempt desc, review_id desc) as rn from reviews) where rn = 1""")
def w1(t: Tables):
    runs = B.reviews(t).withColumn("created_at", F.col("attempt"))
    return R.keep_latest_review(runs).select(*R.KEY, "review_id", "attempt", "decision")


def _with_issues(reviews):
    """Sentences of the review text stand for its issues."""
    parts = F.filter(F.split(F.coalesce("text", F.lit("")), r"\."), lambda p: F.trim(p) != "")
    return reviews.withColumn(
        "issues",
        F.transform(
            parts,
            lambda p, i: F.struct(
                F.concat(F.lit("f"), i.cast("string")).alias("field"), F.trim(p).alias("message")
            ),
        ),
    )


@query("v1_store_review", f"""{REVIEWS},
latest as (select * from (select *, row_number() over (partition by subject_type, subject_id, review_type
    order by attempt desc, review_id desc) as rn from reviews) where rn = 1),
parts as (select review_id, list_filter(string_split(coalesce(text, ''), '.'), lambda p: trim(p, ' ') <> '') as ps
  from latest)
select review_id, cast(i - 1 as int) as position, concat('f', cast(i - 1 as varchar)) as field, trim(ps[i], ' ') as message
from parts, unnest(generate_series(1, len(ps))) as u(i)""")
def v1(t: Tables):
    runs = B.reviews(t).withColumn("created_at", F.col("attempt"))
    return R.review_issues(_with_issues(R.keep_latest_review(runs)))


@query("w10_reviews_newest_first", f"""{REVIEWS}
select subject_id, review_type, attempt, review_id from reviews
order by subject_id, attempt desc, review_id desc""")
def w10(t: Tables):
    return B.reviews(t).select("subject_id", "review_type", "attempt", "review_id").orderBy(
        "subject_id", F.desc("attempt"), F.desc("review_id")
    )


@query("v3_retry_outcome", f"""{REVIEWS},
renumbered as (select subject_type, subject_id, attempt + 1 as attempt,
  case when length(coalesce(text, '')) % 3 = 0 then 'retry' else decision end as decision from reviews),
pv as (select subject_type, subject_id, 'job_extraction' as review_type,
  max(case when attempt = 1 then decision end) as first_decision,
  max(case when attempt = 2 then decision end) as second_decision
  from renumbered group by subject_type, subject_id)
select *, case when first_decision <> 'retry' then first_decision
    when first_decision = 'retry' and (second_decision is null or second_decision = 'retry') then 'manual_review'
    else second_decision end as outcome,
  case when first_decision is null then 0 when first_decision <> 'retry' then 1 else 2 end as attempts_used
from pv""")
def v3(t: Tables):
    renumbered = B.reviews(t).select(
        "subject_type", "subject_id", F.lit("job_extraction").alias("review_type"),
        (F.col("attempt") + 1).alias("attempt"),
        F.when(F.length(F.coalesce("text", F.lit(""))) % 3 == 0, "retry")
        .otherwise(F.col("decision")).alias("decision"),
    )
    return R.retry_outcome(renumbered)


@query("p22_normalize_confidence", """
select event_id, case when value > 1 and value <= 100 then value / 100 else value end as overall_confidence,
  case when value * 2 > 1 and value * 2 <= 100 then value * 2 / 100 else value * 2 end as title_confidence,
  (case when value > 1 and value <= 100 then value / 100 else value end between 0 and 1)
  and (case when value * 2 > 1 and value * 2 <= 100 then value * 2 / 100 else value * 2 end between 0 and 1) as valid
from events""")
def p22(t: Tables):
    runs = t.events.select(
        "event_id", F.col("value").alias("overall_confidence"),
        F.create_map(F.lit("title"), F.col("value") * 2).alias("field_confidence"),
    )
    return R.normalize_review_confidences(runs).select(
        "event_id", "overall_confidence",
        F.col("field_confidence")["title"].alias("title_confidence"), "valid",
    )


@query("p21_apply_review", f"""{REVIEWS},
o as (select review_id, decision, text, concat('corrected ', review_id) as fixed_title,
    case when decision <> 'correct' then 'none'
      when length(coalesce(text, '')) % 4 = 0 then 'blank_item'
      when length(coalesce(text, '')) % 4 = 1 then 'no_metadata' else 'full' end as shape
  from reviews),
r as (select *, case decision when 'accept' then 'original' when 'manual_review' then 'original_manual'
    when 'correct' then case when shape = 'full' then 'corrected' else 'invalid_correction' end
    else 'unsupported' end as outcome from o)
select review_id, outcome, outcome = 'original_manual' as requires_manual_review,
  case when outcome = 'corrected' then fixed_title when outcome like 'original%' then concat('title ', review_id) end
    as final_title,
  case when outcome = 'corrected' then concat('fixed ', review_id)
    when outcome like 'original%' then concat('requirement ', review_id) end as final_requirement
from r""")
def p21(t: Tables):
    size = F.length(F.coalesce("text", F.lit("")))
    corrected = F.col("decision") == "correct"
    rid = F.col("review_id")

    def item(name, text):
        return F.array(F.struct(text.alias(name)))

    extractions = B.reviews(t).select(
        "review_id", "decision",
        F.struct(F.concat(F.lit("title "), rid).alias("title")).alias("metadata"),
        item("activity", F.concat(F.lit("activity "), rid)).alias("activities"),
        item("requirement", F.concat(F.lit("requirement "), rid)).alias("requirements"),
        F.when(corrected & (size % 4 != 1), F.struct(F.concat(F.lit("corrected "), rid).alias("title")))
        .alias("corrected_metadata"),
        F.when(corrected, item("activity", F.lit("done"))).alias("corrected_activities"),
        F.when(
            corrected,
            item("requirement", F.when(size % 4 == 0, F.lit("  ")).otherwise(F.concat(F.lit("fixed "), rid))),
        ).alias("corrected_requirements"),
    )
    return R.apply_review(extractions).select(
        "review_id", "outcome", "requires_manual_review", F.col("final_metadata.title").alias("final_title"),
        F.col("final_requirements")[0]["requirement"].alias("final_requirement"),
    )


@query("v2_review_outcome_selection", """
select d.doc_id, case when l.quality = 1 and l.toxic = 0 then concat('corrected ', cast(d.doc_id as varchar))
  else sha256(d.text) end as final_result
from documents d left join labels l using (doc_id)""")
def v2(t: Tables):
    generated = t.documents.select("doc_id", F.sha2("text", 256).alias("generated_result"))
    reviews = t.labels.select(
        "doc_id",
        F.when(F.col("toxic") == 1, "failed").otherwise("accepted").alias("review_status"),
        F.when(F.col("quality") == 1, F.concat(F.lit("corrected "), F.col("doc_id").cast("string")))
        .otherwise("").alias("corrected_result"),
    )
    return R.select_review_result(generated, reviews, "doc_id").select("doc_id", "final_result")
