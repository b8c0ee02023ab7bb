"""How the given tables stand in for jobs, requirements, evidence, events and reviews.

Each binding exists twice: as DataFrame code and as a SQL fragment for the twins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitweave import vocab
from fitweave.functions import text as T
from fitweave.plans.registry import Tables
from fitweave.session import spread_rows


def shown(value: Column) -> Column:
    """Timestamp as text, so that zones and precision cannot differ between engines."""
    return F.date_format(value, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def shown_sql(value: str) -> str:
    return f"strftime({value}, '%Y-%m-%d %H:%M:%S.%f')"


# --- scored matches: lineitem -------------------------------------------------

def scored_matches(t: Tables) -> DataFrame:
    third = F.col("l_linenumber") % 3
    flags = F.concat("l_returnflag", "l_linestatus")
    return t.lineitem.select(
        F.col("l_orderkey").alias("job_id"),
        F.lit("p0").alias("profile_id"),
        F.col("l_linenumber").alias("requirement_id"),
        F.concat(F.lit("R"), F.col("l_linenumber").cast("string")).alias("requirement"),
        F.when(third == 0, "must").when(third == 1, "should").otherwise("nice_to_have").alias("priority"),
        F.when(flags == "RO", "gap").when(flags == "RF", "unknown").when(flags == "NO", "transferable")
        .when(flags == "NF", "partial_match").when(F.col("l_returnflag") == "A", "strong_match")
        .alias("match_level"),
    )


SCORED = """scored as (
  select l_orderkey as job_id, 'p0' as profile_id, l_linenumber as requirement_id,
    concat('R', cast(l_linenumber as varchar)) as requirement,
    case l_linenumber % 3 when 0 then 'must' when 1 then 'should' else 'nice_to_have' end as priority,
    case when l_returnflag = 'R' and l_linestatus = 'O' then 'gap'
         when l_returnflag = 'R' then 'unknown'
         when l_returnflag = 'N' and l_linestatus = 'O' then 'transferable'
         when l_returnflag = 'N' then 'partial_match'
         else 'strong_match' end as match_level
  from lineitem)"""


# --- application events: events -------------------------------------------------

def application_events(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    channels = ["email", "company_portal", "job_portal", "phone", "personal", "other"]
    channel = F.get(T.word_list(channels), k % 7)
    return t.events.select(
        "event_id",
        F.col("user_id").alias("application_id"),
        F.when(kind == "signup", "created").when(kind.isin("purchase", "error"), "status_change")
        .when(kind == "view", "communication").otherwise("note").alias("event_type"),
        F.when(kind == "signup", "draft").when(kind == "purchase", "applied")
        .when(kind == "error", "rejected").alias("status"),
        F.col("ts").alias("occurred_at"),
        F.col("ts").alias("created_at"),
        channel.alias("channel"),
        F.when(channel == "job_portal", F.concat(F.lit("P"), k.cast("string"))).alias("portal_name"),
        F.when(k % 2 == 0, F.concat(F.lit("n"), k.cast("string"))).alias("note"),
        "value",
        k.alias("k"),
    )


APP_EVENTS = """app_events as (
  select event_id, user_id as application_id,
    case event_type when 'signup' then 'created' when 'purchase' then 'status_change'
      when 'error' then 'status_change' when 'view' then 'communication' else 'note' end as event_type,
    case event_type when 'signup' then 'draft' when 'purchase' then 'applied'
      when 'error' then 'rejected' end as status,
    ts as occurred_at, ts as created_at, channel,
    case when channel = 'job_portal' then concat('P', cast(k as varchar)) end as portal_name,
    case when k % 2 = 0 then concat('n', cast(k as varchar)) end as note, value, k
  from (select *, case k % 7 when 0 then 'email' when 1 then 'company_portal' when 2 then 'job_portal'
      when 3 then 'phone' when 4 then 'personal' when 5 then 'other' end as channel
    from (select *, cast(json_extract_string(props, '$.k') as int) as k from events)))"""


def applications_of(events: DataFrame) -> DataFrame:
    return events.groupBy("application_id").agg(F.min("occurred_at").alias("created_at"))


# --- reviews: conversations -----------------------------------------------------

def reviews(t: Tables) -> DataFrame:
    turn = F.col("turn")
    return t.conversations.select(
        F.lit("job").alias("subject_type"),
        F.col("conv_id").alias("subject_id"),
        F.col("role").alias("review_type"),
        turn.cast("int").alias("attempt"),
        F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string")).alias("review_id"),
        F.get(T.word_list(["accept", "correct", "retry", "manual_review"]), (turn % 4).cast("int"))
        .alias("decision"),
        F.when(F.length("text") > 0, F.col("text")).alias("text"),
        (F.length("text") % 130).cast("double").alias("overall_confidence"),
    )


REVIEWS = """reviews as (
  select 'job' as subject_type, conv_id as subject_id, role as review_type, cast(turn as int) as attempt,
    concat(cast(conv_id as varchar), ':', cast(turn as varchar)) as review_id,
    case turn % 4 when 0 then 'accept' when 1 then 'correct' when 2 then 'retry' else 'manual_review' end
      as decision,
    case when length(text) > 0 then text end as text,
    cast(length(text) % 130 as double) as overall_confidence
  from conversations)"""


# --- rendered ads: one per part -------------------------------------------------
# The statement is a fixture: both engines run the same text.  Seven layouts cover the
# portals' header styles; {nl} is a line break.

ADS = """
select p.p_partkey as job_id,
  case p.p_partkey % 7
  when 0 then concat_ws(chr(10),
    concat('# ', case when p.p_size % 3 = 0 then 'Senior ' when p.p_size % 3 = 1 then 'Junior ' else '' end,
           'Data Engineer ', p.p_name),
    concat(s.s_name, ' GmbH'),
    concat('Arbeitsort: ', n.n_name),
    'Anstellungsart: Vollzeit, unbefristet',
    '## Deine Aufgaben',
    concat('- Betreuung von ', p.p_name),
    concat('- Betrieb von ', p.p_type, ' Anlagen'),
    '  und angrenzenden Systemen,',
    '  auch im Schichtdienst.',
    concat('- betreuung von ', p.p_name),
    '## Anforderungen',
    concat('- Mindestens ', cast(p.p_size % 10 + 1 as string), ' Jahre Erfahrung mit ', p.p_brand),
    concat('- Idealerweise Kenntnisse in ', p.p_type),
    '- Python muss sicher beherrscht werden',
    '## Benefits',
    '- Flexible Arbeitszeiten',
    '- Obst')
  when 1 then concat_ws(chr(10),
    concat('Data Engineer ', p.p_name, ' (m/w/d)'),
    concat(s.s_name, ' Group · ', n.n_name,
           case when p.p_size % 3 = 0 then ' (Hybrid)' when p.p_size % 3 = 1 then ' (Remote)' else ' (On-site)' end),
    '',
    'Sailing days',
    'You and the crew are with us for all of the season and the work will be yours.',
    '**Your role** build things:',
    concat('- Design pipelines for ', p.p_name),
    concat('- Operate ', p.p_type, ' plants; '),
    '**About you**',
    concat('- ', cast(p.p_size % 5 + 2 as string), ' - ', cast(p.p_size % 5 + 4 as string),
           ' years of professional experience with ', p.p_brand),
    concat('- Knowledge of ', p.p_type, ' is a plus'),
    '**Our culture**',
    '- Nothing to extract from here',
    '**Perks**',
    '- Free fruit every day')
  when 2 then concat_ws(chr(10),
    '> #### Arbeitsort',
    '>',
    concat('> ', n.n_name),
    '>',
    '> #### Anstellungsart',
    '>',
    '> Vollzeit',
    '>',
    concat('> Veröffentlichungsdatum: Vor ', cast(p.p_size as string), ' Tagen ausgehängt'),
    concat('Arbeitgeber: ', s.s_name, ' AG'),
    'Your team shares the work, and remote days are with us for all crews.',
    'Du wirst eigenverantwortlich und mit Verantwortung arbeiten.',
    '## Tätigkeiten',
    concat('* Pflege der Anlage ', p.p_name),
    concat('* Ausbau von ', p.p_type),
    '## Qualifikationen und Benefits',
    '* Firmenwagen und mehr')
  when 3 then concat_ws(chr(10),
    concat('Junior ', p.p_name),
    'Loom Engineer',
    '(m/w/d)',
    concat(s.s_name, ' GmbH'),
    'Remote in DE',
    n.n_name,
    'Bürostandorte',
    '31.500 - 36.500 €',
    'Vollzeit',
    'Einzelheiten',
    '## Kompetenzprofil',
    concat('1. Erfahrung mit ', p.p_brand, ' ist zwingend'),
    concat('2) Idealerweise ', p.p_type, ' und Statistik'),
    '3. SQL',
    '## Über uns',
    '- Wir sind ein Team')
  when 4 then concat_ws(chr(10),
    concat('[![', s.s_name, ' Logo](https://pics.invalid/mark.svg)](https://yard.invalid)'),
    '',
    concat('# Lead Data Architect ', p.p_name),
    '',
    concat(n.n_name, ', Germany'),
    '',
    'Apply Now',
    'Arbeitsort',
    concat(cast(p.p_size as string), ' Minuten ab Fischmarkt'),
    'Job address',
    concat('Kaistraße ', cast(p.p_size as string), ', ', n.n_name),
    'Beschäftigungsart',
    ':   Teilzeit, befristet',
    'Vertragsdauer: 24 Monate',
    '## Ihre Rolle',
    concat('- Architectural leadership for ', p.p_type),
    '## Must-haves',
    concat('- At least ', cast(p.p_size % 4 + 3 as string), ' years experience'),
    concat('- Team lead for ', p.p_brand))
  when 5 then concat_ws(chr(10),
    concat('## Data Engineer (all genders) in ', n.n_name),
    '',
    concat('# ', p.p_name, ' Analyst (m/w/d) NEU'),
    '',
    'Gespeichert!',
    '',
    concat(n.n_name, ' Bürostandorte'),
    '',
    'Vollzeit',
    '',
    '## Firmendetails',
    '',
    concat('## ', s.s_name, ' Labs'),
    '',
    'Hybrides Arbeiten ist bei uns und mit der Familie möglich.',
    '### Das bringst du mit',
    concat('- Drei Jahre Berufserfahrung sowie ', p.p_brand),
    '- Mehrjährige Praxis',
    '  - Teilpunkt ohne Verbindung')
  else concat_ws(chr(10),
    concat('[![', s.s_name, ' GmbH](https://cdn.join.com/mark.svg)'),
    '',
    concat(s.s_name, ' GmbH](https://join.com/companies/x', cast(s.s_suppkey as string), ')'),
    '',
    concat('# Head of ', p.p_name, ' (m/w/d)'),
    '',
    concat('[', n.n_name, ', Deutschland](https://www.google.com/maps/search/?api=1)'),
    '',
    concat('Die ', s.s_name, ' Innovation Labs GmbH entwickelt Anlagen.'),
    '## Responsibilities',
    concat('- Own the roadmap for ', p.p_name),
    '## Education',
    concat('- Degree in ', p.p_type, ' required'),
    '## Weitere Hinweise',
    '- Homeoffice nach Absprache')
  end as content,
  case p.p_partkey % 7
    when 1 then concat('Ad_', cast(p.p_partkey as string), '_LinkedIn.pdf')
    when 3 then concat('Ad_', cast(p.p_partkey as string), '_-_Indeed.com.pdf')
    when 5 then concat('Ad_', cast(p.p_partkey as string), '___Instaffo.pdf') end as source_filename,
  case p.p_partkey % 7
    when 2 then concat('https://www.stepstone.de/job/', cast(p.p_partkey as string))
    when 4 then concat('https://www.arbeitsagentur.de/', cast(p.p_partkey as string))
    when 6 then concat('https://join.com/companies/x/', cast(p.p_partkey as string)) end as source_url,
  p.p_size, p.p_brand, p.p_type, p.p_name
from part p
join supplier s on s.s_suppkey = p.p_partkey % (select count(*) from supplier) + (select min(s_suppkey) from supplier)
join nation n on n.n_nationkey = s.s_nationkey
"""

ADS_CTE = f"ads as ({ADS})"


def ads(t: Tables) -> DataFrame:
    """Narrow rows of the join are dealt over tasks, then each ad is rendered where its extraction runs."""
    rendering, tables = ADS.split("\nfrom part p\n")
    joined = t.spark.sql(
        "select struct(p.p_partkey, p.p_size, p.p_brand, p.p_type, p.p_name) as p, struct(s.s_suppkey, s.s_name) as s, "
        "struct(n.n_name) as n from {part} p "
        + tables.replace("from supplier)", "from {supplier})")
        .replace("join supplier s", "join {supplier} s")
        .replace("join nation n", "join {nation} n"),
        part=t.part, supplier=t.supplier, nation=t.nation,
    )
    return t.spark.sql(rendering + " from {joined}", joined=spread_rows(joined, t.part))


# --- requirements and evidence: documents and benchmark ---------------------------

def document_requirements(t: Tables) -> DataFrame:
    """One requirement per non-empty line of every document."""
    third = F.col("pos") % 3
    return (
        t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "requirement"))
        .where(F.trim("requirement") != "")
        .select(
            F.col("doc_id").alias("job_id"),
            F.lit("p0").alias("profile_id"),
            F.concat_ws(":", F.col("doc_id").cast("string"), F.col("pos").cast("string"))
            .alias("requirement_id"),
            "requirement",
            F.lit("other").alias("category"),
            F.when(third == 0, "must").when(third == 1, "should").otherwise("nice_to_have")
            .alias("priority"),
            T.empty_words().alias("keywords"),
            F.lit(None).cast("string").alias("normalized_value"),
        )
    )


REQUIREMENTS = """requirements as (
  select doc_id as job_id, 'p0' as profile_id,
    concat(cast(doc_id as varchar), ':', cast(pos - 1 as varchar)) as requirement_id, requirement,
    case (pos - 1) % 3 when 0 then 'must' when 1 then 'should' else 'nice_to_have' end as priority
  from (select doc_id, unnest(string_split(text, chr(10))) as requirement,
          generate_subscripts(string_split(text, chr(10)), 1) as pos from documents)
  where trim(requirement, ' ') <> '')"""


def benchmark_evidence(t: Tables) -> DataFrame:
    fifth = (F.col("item_id") % 5).cast("int")
    contexts = ["professional", "project", "training", "education", "other"]
    return t.benchmark.select(
        F.lit("p0").alias("profile_id"),
        F.col("item_id").alias("evidence_id"),
        F.concat(F.lit("item:"), F.col("item_id").cast("string")).alias("source_name"),
        F.lit("manual").alias("source_type"),
        F.lit("{}").alias("source_content"),
        F.lit("Passage").alias("label"),
        F.col("text").alias("evidence_text"),
        F.get(T.word_list(contexts), fifth).alias("experience_context"),
        T.empty_words().alias("keywords"),
    )


EVIDENCE = """evidence as (
  select 'p0' as profile_id, item_id as evidence_id, text as evidence_text,
    case item_id % 5 when 0 then 'professional' when 1 then 'project' when 2 then 'training'
      when 3 then 'education' else 'other' end as experience_context
  from benchmark)"""

def sql_words(words) -> str:
    """Words as a SQL list body."""
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def terms_sql(value: str) -> str:
    """Distinct terms of a text in DuckDB, concepts included."""
    words = (
        f"list_filter(list_distinct(regexp_extract_all(lower({value}), "
        f"'[A-Za-zÀ-ÖØ-öø-ÿ0-9+#.]{{2,}}')), lambda w: w not in ({sql_words(vocab.MATCH_STOPWORDS)}))"
    )
    concepts = ", ".join(
        f"case when list_has_any(ws, [{sql_words(aliases)}]) then 'concept:{name}' end"
        for name, aliases in vocab.TERM_CONCEPTS.items()
    )
    return (
        f"(select list_concat(ws, list_filter([{concepts}], lambda c: c is not null)) "
        f"from (select {words} as ws))"
    )


# --- context of pairs: seven profiles that share the benchmark, two per document -----

CONTEXT = """ev as (select item_id as evidence_id, item_id % 7 as profile_id from benchmark),
pairs as (select doc_id as job_id, doc_id % 7 as profile_id from documents
  union all select doc_id, (doc_id + 3) % 7 from documents)"""


def context_inputs(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs, jobs and evidence of several profiles."""
    job = F.col("doc_id").alias("job_id")
    pairs = t.documents.select(job, (F.col("doc_id") % 7).alias("profile_id")).unionByName(
        t.documents.select(job, ((F.col("doc_id") + 3) % 7).alias("profile_id"))
    )
    jobs = t.documents.select(job, F.lit(None).cast("string").alias("title"), F.col("lang").alias("language"), F.col("text").alias("content"))
    evidence = benchmark_evidence(t).withColumn("profile_id", F.col("evidence_id") % 7)
    return pairs, jobs, evidence


def shown_context(pairs: DataFrame, texts: DataFrame, evidence: DataFrame) -> DataFrame:
    """The three tables of a context under one another, by their keys."""
    none = F.lit(None).cast("long")
    return (
        pairs.select(F.lit("pair").alias("part"), "job_id", "profile_id", none.alias("evidence_id"))
        .unionByName(texts.select(F.lit("job").alias("part"), "job_id", none.alias("profile_id"), none.alias("evidence_id")))
        .unionByName(evidence.select(F.lit("evidence").alias("part"), none.alias("job_id"), "profile_id", "evidence_id"))
    )
