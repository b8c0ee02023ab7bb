"""Queries on pages, documents and rendered ads."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from fitweave import vocab
from fitweave.functions import text as T
from fitweave.functions import urls
from fitweave.operators import metadata as D
from fitweave.operators import quality as Q
from fitweave.operators import seniority as S
from fitweave.operators import structure as X
from fitweave.plans import bindings as B
from fitweave.plans.registry import Tables, query

NW = "[^\\p{L}\\p{N}_]"


def word_sql(options, end: bool = True) -> str:
    """Word-bounded alternatives without look-around."""
    body = "|".join(options).replace("'", "''")
    return f"(?i)(?:^|{NW})(?:{body})" + (f"(?:{NW}|$)" if end else "")


def has(value: str, options, end: bool = True) -> str:
    return f"regexp_matches({value}, '{word_sql(options, end)}')"


def one_of(value: str, words) -> str:
    return f"{value} in ({B.sql_words(words)})"


# --- documents ---------------------------------------------------------------------

@query("s02_scan_text_documents", """
select doc_id as job_id, source as source_type, lang as language, length(text) as text_length from documents""")
def s02(t: Tables):
    return t.documents.select(
        F.col("doc_id").alias("job_id"), F.col("source").alias("source_type"),
        F.col("lang").alias("language"), F.length("text").alias("text_length"),
    )


def _quality_sql(text: str, title: str, source: str, key: str) -> str:
    markers = " + ".join(f"(contains(low, '{m}'))::int" for m in vocab.JOB_MARKERS)
    blocked = " or ".join(f"contains(low, '{m}')" for m in vocab.BLOCK_PAGE_MARKERS)
    return f"""
with n as (select {key}, {title} as title, trim(regexp_replace({text}, '\\s+', ' ', 'g')) as flat from {source}),
f as (select *, lower(flat) as low from n),
m as (select *, length(flat) < 500 as short, coalesce(title, '') = '' as untitled, ({blocked}) as blocked,
  {markers} as marks from f)
select {key}, length(flat) as text_length,
  not (short or untitled or (blocked and (lower(trim(title)) in ({B.sql_words(vocab.BLOCK_PAGE_TITLES)}) or marks < 2)))
    as sufficient,
  concat_ws(',', case when short then 'content_below_minimum_length' end,
    case when untitled then 'title_not_detected' end,
    case when blocked then 'possible_login_or_bot_protection' end) as warnings
from m"""


# every text has a title line; frequent words are swapped for marker phrases so that all rules fire
_QTEXT = ("replace(replace(replace(text, ' the ', ' captcha '), ' of ', ' Aufgaben '), ' and ', ' Requirements ')")
_QTITLE = "case when lang = 'es' then null when lang = 'fr' then 'Just a moment' else concat('Title ', source) end"


@query("p05_assess_quality", _quality_sql(_QTEXT, _QTITLE, "documents", "doc_id"))
def p05(t: Tables):
    docs = t.documents.select("doc_id", F.expr(_QTEXT).alias("body"), F.expr(_QTITLE).alias("title"))
    return docs.select("doc_id", *[c.alias(n) for n, c in Q.quality_columns(F.col("body"), F.col("title")).items()]) \
        .withColumn("warnings", F.array_join("warnings", ","))


@query("p06_job_description_not_found", f"""
with q as ({_quality_sql(_QTEXT, _QTITLE, "documents", "doc_id")})
select q.doc_id, concat_ws(',', nullif(warnings, ''), case when contains(d.text, 'junk') or d.lang = 'de' then
  case when not sufficient then 'job_description_not_found' end end) as warnings
from q join documents d using (doc_id)""")
def p06(t: Tables):
    docs = t.documents.select(
        "doc_id", F.expr(_QTEXT).alias("body"), F.expr(_QTITLE).alias("title"),
        (F.col("text").contains("junk") | (F.col("lang") == "de")).alias("removed"),
    )
    checked = docs.withColumns(Q.quality_columns(F.col("body"), F.col("title")))
    warnings = Q.with_missing_description(F.col("warnings"), F.col("removed"), F.col("sufficient"))
    return checked.select("doc_id", F.array_join(warnings, ",").alias("warnings"))


# the doubling of short words imitates a broken font mapping in some texts
_GLYPHS = "case when lang = 'es' then replace(text, ' de ', ' d de el la as sa ar ') else text end"


@query("p07_extracted_text_sufficient", f"""
with src as (select doc_id, {_GLYPHS} as text from documents),
n as (select doc_id, text, trim(regexp_replace(text, '\\s+', ' ', 'g')) as flat from src),
ls as (select doc_id, len(x) as n, list_sum(list_transform(x, lambda l: length(l))) as total,
    len(list_filter(x, lambda l: length(l) <= 45)) as short
  from (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(l)), lambda l: l <> '') as x from src)),
toks as (select doc_id, ln, i, tk[i] as tok, case when i > 1 then tk[i-1] end as prev from (
    select doc_id, ln, regexp_extract_all(line, '\\p{{L}}+') as tk from (
      select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as ln
      from src)), unnest(generate_series(1, len(tk))) as u(i)),
links as (select *, coalesce(length(prev) <= 2 and length(tok) = 2 and lower(right(prev, 1)) = lower(left(tok, 1)), false) as link
  from toks),
islands as (select doc_id, ln, link, i - row_number() over (partition by doc_id, ln, link order by i) as grp from links),
glyphs as (select distinct doc_id from (select doc_id from islands where link group by doc_id, ln, grp having count(*) >= 5))
select n.doc_id, length(flat) >= 500
  and not (length(flat) - length(replace(flat, chr(65533), '')) >= 3
    and (length(flat) - length(replace(flat, chr(65533), '')))::double / length(flat) >= 0.001)
  and length(regexp_replace(flat, '[^\\p{{L}}\\p{{N}}]+', '', 'g'))::double / length(replace(flat, ' ', '')) >= 0.5
  and g.doc_id is null
  and not (ls.n >= 20 and ls.short::double / ls.n >= 0.65 and ls.total::double / ls.n < 55) as sufficient,
  g.doc_id is not null as broken_glyphs
from n join ls using (doc_id) left join glyphs g on g.doc_id = n.doc_id""")
def p07(t: Tables):
    docs = t.documents.select("doc_id", F.expr(_GLYPHS).alias("text"))
    return docs.select(
        "doc_id", Q.text_is_sufficient(F.col("text")).alias("sufficient"),
        Q.has_broken_glyphs(F.col("text")).alias("broken_glyphs"),
    )


@query("w07_broken_glyph_runs", f"""
with src as (select doc_id, {_GLYPHS} as text from documents),
toks as (select doc_id, ln, i, tk[i] as tok, case when i > 1 then tk[i-1] end as prev from (
    select doc_id, ln, regexp_extract_all(line, '\\p{{L}}+') as tk from (
      select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as ln
      from src)), unnest(generate_series(1, len(tk))) as u(i)),
links as (select *, coalesce(length(prev) <= 2 and length(tok) = 2 and lower(right(prev, 1)) = lower(left(tok, 1)), false) as link
  from toks),
islands as (select doc_id, ln, link, i - row_number() over (partition by doc_id, ln, link order by i) as grp from links)
select distinct doc_id from (select doc_id from islands where link group by doc_id, ln, grp having count(*) >= 5)""")
def w07(t: Tables):
    return t.documents.select("doc_id", F.expr(_GLYPHS).alias("text")).where(
        Q.has_broken_glyphs(F.col("text"))
    ).select("doc_id")


_LAYOUT = "replace(replace(text, '. ', '-' || chr(13) || chr(10) || ' '), ', ', chr(10) || '• ')"


@query("p08_normalize_extracted_text", f"""
select doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(
  {_LAYOUT}, chr(13) || chr(10), chr(10)),
  '-[ \\t]*\\n[ \\t]*(\\p{{L}})', '-\\1', 'g'),
  '(?m)^[ \\t]*(?:&nbsp;|\\x{{a0}})[ \\t]*$', '', 'g'),
  '(?m)^[ \\t]*[•●▪][ \\t]+', '- ', 'g'),
  '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9))) as digest
from documents""")
def p08(t: Tables):
    return t.documents.select(
        "doc_id", F.md5(Q.normalized_extracted_text(F.expr(_LAYOUT))).alias("digest")
    )


_LANG_SQL = {
    lang: f"len(list_filter(ws, lambda w: w in ({B.sql_words(words)})))"
    for lang, words in vocab.LANGUAGE_WORDS.items()
}


def language_sql(source: str, key: str, text: str) -> str:
    return f"""lw as (select {key}, regexp_extract_all(replace(lower({text}), 'ß', 'ss'), '\\p{{L}}+') as ws,
    case when regexp_matches(lower({text}), '[äöüß]') then 2 else 0 end as bonus from {source}),
lc as (select {key}, {_LANG_SQL['de']} + bonus as de, {_LANG_SQL['en']} as en from lw),
lang as (select {key}, case when de >= en and de >= 3 and de >= en * 1.5 then 'de'
    when en > de and en >= 3 and en >= de * 1.5 then 'en' end as language from lc)"""


@query("x01_detect_language", f"with {language_sql('documents', 'doc_id', 'text')} select doc_id, language from lang")
def x01(t: Tables):
    return t.documents.select("doc_id", D.detect_language(F.col("text")).alias("language"))


_KEYWORDS_SQL = """(select array_to_string(list_transform(
    list_filter(list_transform(generate_series(1, len(tk)), lambda i: struct_pack(
      w := tk[i], first := list_position(lows, lows[i]) = i and lows[i] not in ({stop}))), lambda p: p.first),
    lambda p: p.w), ' ')
  from (select tk, list_transform(tk, lambda w: replace(lower(w), 'ß', 'ss')) as lows
    from (select regexp_extract_all({text}, '[A-Za-zÄÖÜäöüß0-9+#.-]{{3,}}') as tk)))"""


def keywords_sql(text: str) -> str:
    return _KEYWORDS_SQL.format(text=text, stop=B.sql_words(vocab.KEYWORD_STOPWORDS))


@query("x21_keywords", f"select doc_id, {keywords_sql('text')} as keywords from documents")
def x21(t: Tables):
    return t.documents.select("doc_id", F.array_join(X.keywords(F.col("text")), " ").alias("keywords"))


@query("f06_normalized_target_text", """
select doc_id, md5(trim(regexp_replace(replace(replace(replace(replace(lower(text), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'),
  'ß', 'ss'), '[^a-z0-9+#]+', ' ', 'g'))) as digest from documents""")
def f06(t: Tables):
    return t.documents.select("doc_id", F.md5(T.target_text(F.col("text"))).alias("digest"))


@query("f12_normalized_text", """
select doc_id, md5(trim(regexp_replace(strip_accents(replace(lower(text), 'ß', 'ss')), '[^\\p{L}\\p{N}]+', ' ', 'g')))
  as digest from documents""")
def f12(t: Tables):
    return t.documents.select("doc_id", F.md5(T.comparable_text(F.col("text"))).alias("digest"))


@query("p25_merge_warnings", """
with w as (select doc_id, list_filter([case when n_chars > 1000 then 'semantic_metadata_incomplete' end,
    case when lang = 'de' then 'title_not_detected' end, case when n_chars % 2 = 0 then 'shared' end],
    lambda x: x is not null) as old_w,
  list_filter(['semantic_metadata_fallback_used', case when n_chars % 3 = 0 then 'shared' end,
    case when lang <> 'en' then 'title_not_detected' end], lambda x: x is not null) as new_w from documents)
select doc_id, array_to_string(list_concat(old_w, list_filter(new_w, lambda x: not list_contains(old_w, x))), ',') as merged,
  array_to_string(list_concat(kept, list_filter(new_w, lambda x: not list_contains(kept, x))), ',') as reimported
from (select *, list_filter(old_w, lambda x: not starts_with(x, 'semantic_metadata_')) as kept from w)""")
def p25(t: Tables):
    n, lang = F.col("n_chars"), F.col("lang")
    old = F.array_compact(F.array(
        F.when(n > 1000, "semantic_metadata_incomplete"), F.when(lang == "de", "title_not_detected"),
        F.when(n % 2 == 0, "shared")))
    new = F.array_compact(F.array(
        F.lit("semantic_metadata_fallback_used"), F.when(n % 3 == 0, "shared"),
        F.when(lang != "en", "title_not_detected")))
    rows = t.documents.select("doc_id", old.alias("old"), new.alias("new"))
    return rows.select(
        "doc_id", F.array_join(Q.merged_warnings(F.col("old"), F.col("new")), ",").alias("merged"),
        F.array_join(Q.merged_warnings(F.col("old"), F.col("new"), reimport=True), ",").alias("reimported"),
    )


@query("p26_matchable_jobs", "select doc_id from documents where length(trim(text, ' ' || chr(10) || chr(9) || chr(13))) >= 80")
def p26(t: Tables):
    return t.documents.where(Q.is_matchable(F.col("text"))).select("doc_id")


# --- page URLs -----------------------------------------------------------------------

_URL = """case page_id % 9 when 0 then upper(substr(url, 1, 4)) || substr(url, 5) || '#part'
  when 1 then replace(url, 'http', 'ftp') when 2 then replace(url, '://', '://user:pw@')
  when 3 then 'http://localhost:8080/x' when 4 then 'https://10.0.0.' || cast(page_id % 250 as string) || '/a?b=1'
  when 5 then 'https://Jobs.Example.COM:8443' when 6 then 'http://intranet.local/job'
  when 7 then 'https://8.8.8.8/job/' || cast(page_id as string) else url end"""


@query("p09_normalize_url", f"""
with u as (select page_id, {_URL} as url from pages),
p as (select page_id, url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) as scheme,
  regexp_extract(url, '^[^:]+://([^/?#]*)', 1) as authority,
  regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1) as path,
  regexp_extract(url, '^[^?#]*(\\?[^#]*)', 1) as query from u),
h as (select *, lower(regexp_extract(regexp_replace(authority, '^.*@', ''), '^([^:]*)', 1)) as host,
  regexp_extract(regexp_replace(authority, '^.*@', ''), ':([0-9]+)$', 1) as port from p)
select page_id, case when scheme not in ('http', 'https') then 'invalid_url_scheme'
    when contains(authority, '@') then 'url_credentials_forbidden'
    when host = 'localhost' or ends_with(host, '.local') or ends_with(host, '.internal') or starts_with(host, '10.')
      then 'private_network_forbidden' end as reject_reason,
  concat(scheme, '://', host, case when port <> '' then concat(':', port) else '' end,
    case when path = '' then '/' else path end, query) as normalized_url
from h""")
def p09(t: Tables):
    rows = t.pages.select("page_id", F.expr(_URL).alias("url"))
    return rows.select(
        "page_id", urls.reject_reason(F.col("url")).alias("reject_reason"),
        urls.normalized_url(F.col("url")).alias("normalized_url"),
    )


# --- ads: line table in SQL -------------------------------------------------------------

LINES = """lines as (select job_id, i as line_no, ls[i] as raw from (
    select job_id, string_split(content, chr(10)) as ls from ads), unnest(generate_series(1, len(ls))) as u(i))"""


def clean_sql(value: str) -> str:
    steps = f"trim(regexp_replace({value}, '^\\s*>\\s?', ''))"
    steps = f"regexp_replace(regexp_replace({steps}, '^\\s*[-*]\\s+', ''), '^:\\s*', '')"
    steps = f"trim(regexp_replace({steps}, '^(?:!\\[[^\\]]*\\]\\([^)]+\\)\\s*)+', ''))"
    return f"trim(regexp_replace({steps}, '^\\[([^\\]]+)\\]\\([^)]+\\)$', '\\1'))"


def norm_sql(value: str) -> str:
    return (f"replace(lower(regexp_replace(trim(trim(trim(regexp_replace({value}, '^#+', '')), '*_')), "
            f"'^[^\\p{{L}}\\p{{N}}_]+', '')), 'ß', 'ss')")


CLEAN = f"clean as (select *, {norm_sql('v')} as norm from (select *, {clean_sql('raw')} as v from lines))"
USABLE = "{0}.v <> '' and not starts_with({0}.v, '#') and {0}.v <> '&nbsp;'"


def section_cte(name: str, headings) -> str:
    return f"""{name} as (select h.job_id, first(c.v order by h.line_no, c.line_no) as value
  from clean h join clean c on c.job_id = h.job_id and c.line_no between h.line_no + 1 and h.line_no + 5
  where {one_of('h.norm', headings)} and {USABLE.format('c')} group by h.job_id)"""


def before_cte(name: str, headings) -> str:
    return f"""{name} as (select h.job_id, first(c.v order by h.line_no, c.line_no desc) as value
  from clean h join clean c on c.job_id = h.job_id and c.line_no between h.line_no - 3 and h.line_no - 1
  where {one_of('h.norm', headings)} and {USABLE.format('c')} group by h.job_id)"""


def extract_sql(value: str, pattern: str) -> str:
    return f"nullif(regexp_extract({value}, '{pattern}', 1), '')"


def inline_sql(headings) -> str:
    names = "|".join(re.escape(h).replace("\\ ", " ") for h in sorted(headings, key=len, reverse=True))
    return clean_sql(extract_sql(
        "content", f"(?im)^[ \\t]*(?:>[ \\t]*)?(?:{names})[ \\t]*[:\\-–]?[ \\t]+(.+?)[ \\t]*$"))


AD_LINES = f"{B.ADS_CTE}, {LINES}, {CLEAN}"


def _lines(t: Tables):
    return D.with_lines(B.ads(t))


@query("x02_clean_line", f"with {AD_LINES} select job_id, line_no - 1 as pos, v as cleaned, norm as heading from clean")
def x02(t: Tables):
    both = _lines(t).select("job_id", F.posexplode(F.arrays_zip("_clean", "_norm")).alias("pos", "l"))
    return both.select("job_id", "pos", F.col("l._clean").alias("cleaned"), F.col("l._norm").alias("heading"))


_TITLE = "concat('# ', replace(p_name, 'small', 'Al Engineer'), case when p_size % 2 = 0 then ' - NEU' else '' end)"


def title_sql(value: str) -> str:
    cleaned = f"trim(regexp_replace({clean_sql(value)}, '^#+', ''))"
    ai = f"regexp_replace({cleaned}, '(?i)^Al(\\s+(?:Engineer|Scientist|Developer|Researcher))', 'AI\\1')"
    return (f"nullif(regexp_replace({ai}, '(?i)^(?:\\[?NEU\\]?\\s*[-|·:]?\\s+)|(?:\\s*[-|·:]?\\s*\\[?NEU\\]?)$', '', 'g'), '')")


@query("x03_clean_title", f"select p_partkey as job_id, {title_sql(_TITLE)} as title from part")
def x03(t: Tables):
    rows = t.part.select(F.col("p_partkey").alias("job_id"), F.expr(_TITLE).alias("raw"))
    return rows.select("job_id", D.clean_title(F.col("raw")).alias("title"))


_HEADING1 = title_sql(extract_sql("content", "(?m)^\\s*#\\s+(.+?)\\s*$"))


@query("x04_main_heading", f"with {B.ADS_CTE} select job_id, {_HEADING1} as heading from ads")
def x04(t: Tables):
    return B.ads(t).select("job_id", D.main_heading(F.col("content")).alias("heading"))


@query("x05_section_value", f"""with {AD_LINES}, {section_cte('loc', vocab.LOCATION_HEADINGS)},
{section_cte('emp', vocab.EMPLOYMENT_HEADINGS)}
select job_id, loc.value as location, emp.value as employment from ads left join loc using (job_id) left join emp using (job_id)""")
def x05(t: Tables):
    clean, norm = F.col("_clean"), F.col("_norm")
    return _lines(t).select(
        "job_id", D.section_value(clean, norm, vocab.LOCATION_HEADINGS).alias("location"),
        D.section_value(clean, norm, vocab.EMPLOYMENT_HEADINGS).alias("employment"),
    )


@query("x06_inline_value", f"""with {B.ADS_CTE} select job_id, {inline_sql(vocab.LOCATION_HEADINGS)} as location,
  {inline_sql(vocab.EMPLOYMENT_HEADINGS)} as employment, {inline_sql(vocab.CONTRACT_HEADINGS)} as contract from ads""")
def x06(t: Tables):
    content = F.col("content")
    return B.ads(t).select(
        "job_id", D.inline_value(content, vocab.LOCATION_HEADINGS).alias("location"),
        D.inline_value(content, vocab.EMPLOYMENT_HEADINGS).alias("employment"),
        D.inline_value(content, vocab.CONTRACT_HEADINGS).alias("contract"),
    )


@query("x07_value_before_heading", f"""with {AD_LINES}, {before_cte('b', vocab.LOCATION_FOOTINGS)}
select job_id, b.value as location from ads left join b using (job_id)""")
def x07(t: Tables):
    return _lines(t).select(
        "job_id",
        D.value_before_heading(F.col("_clean"), F.col("_norm"), vocab.LOCATION_FOOTINGS).alias("location"),
    )


_MAP = clean_sql(extract_sql(
    "content", "(?i)\\[([^\\]\\r\\n]{2,150})\\]\\(https?://(?:www\\.)?google\\.[^/\\s]+/maps/[^)\\r\\n]+\\)"))


@query("x08_map_link_location", f"with {B.ADS_CTE} select job_id, {_MAP} as location from ads")
def x08(t: Tables):
    return B.ads(t).select("job_id", D.map_link_location(F.col("content")).alias("location"))


HEADER = """header as (select *, row_number() over (partition by job_id order by line_no) as hn from clean
    where v <> '' and v <> '&nbsp;' qualify hn <= 15)"""
COMPACT = f"""{HEADER},
chit as (select job_id, min(hn) as at from header where regexp_matches(v, '\\s+[·•|]\\s+')
    and regexp_matches(v, '(?i)\\((?:hybrid|remote|on-?site)\\)') group by job_id),
compact as (select l.job_id, nullif(trim(regexp_replace(p.v, '^#+', '')), '') as title,
    trim(regexp_split_to_array(l.v, '\\s+[·•|]\\s+')[1]) as company,
    nullif(trim(regexp_replace(trim(regexp_split_to_array(l.v, '\\s+[·•|]\\s+')[2]),
      '(?i)\\s*\\((?:hybrid|remote|on-?site)\\)\\s*$', '')), '') as location,
    case lower(regexp_extract(l.v, '(?i)\\((hybrid|remote|on-?site)\\)', 1)) when 'hybrid' then 'Hybrid'
      when 'remote' then 'Remote' when 'on-site' then 'On-Site' else 'Onsite' end as work_model
  from chit join header l on l.job_id = chit.job_id and l.hn = chit.at
  left join header p on p.job_id = chit.job_id and p.hn = chit.at - 1)"""


@query("x10_compact_header", f"""with {AD_LINES}, {COMPACT}
select job_id, title, company, location, work_model from ads left join compact using (job_id)""")
def x10(t: Tables):
    return _lines(t).select("job_id", "_compact.title", "_compact.company", "_compact.location", "_compact.work_model")


INSTAFFO = f"""insta as (select job_id,
    {clean_sql(extract_sql('content', '(?m)^#\\s+([^#\\r\\n]+?)\\s*$'))} as title,
    {clean_sql(extract_sql('content', '(?im)^##\\s+\\**(?:Firmendetails|Company details)\\**\\s*$\\s*^#{1,3}\\s+([^#\\r\\n]+?)\\s*$'))} as company,
    trim({extract_sql('content', '(?im)^\\s*([^\\r\\n]{2,100}?)\\s+Bürostandorte\\s*$')}) as location,
    {extract_sql('content', '(?im)^\\s*[^A-Za-z\\r\\n]{0,3}(Vollzeit|Teilzeit|Full[- ]time|Part[- ]time)\\b')} as employment
  from ads where contains(lower(source_filename), 'instaffo'))"""


@query("x11_instaffo_details", f"""with {B.ADS_CTE}, {INSTAFFO}
select job_id, insta.title, insta.company, insta.location, insta.employment from ads left join insta using (job_id)""")
def x11(t: Tables):
    return _lines(t).select(
        "job_id", "_instaffo.title", "_instaffo.company", "_instaffo.location",
        F.col("_instaffo.employment_type").alias("employment"),
    )


LEGAL = "(?:" + "|".join(vocab.LEGAL_FORMS) + ")"
LEGAL_LONG = "(?:" + "|".join(vocab.LEGAL_FORMS_LONG) + ")"
PLAIN = f"""phit as (select job_id, min(hn) as at from header where regexp_matches(v, '(?i)(?:^|{NW}){LEGAL}(?:{NW}|$)') group by job_id),
plain as (select phit.job_id, any_value(c.v) as company,
    nullif(trim(string_agg(trim(regexp_replace(p.v, '^#+', '')), ' ' order by p.hn)), '') as title
  from phit join header c on c.job_id = phit.job_id and c.hn = phit.at
  left join header p on p.job_id = phit.job_id and p.hn < phit.at and not starts_with(p.v, '[')
    and length(p.v) <= 100 and not ({one_of(norm_sql('p.v'), vocab.PORTAL_CHROME)})
  group by phit.job_id)"""
BELOW = f"""h1 as (select job_id, min(line_no) as at from lines where regexp_matches(raw, '^\\s*(?:>\\s*)?#\\s+\\S') group by job_id),
after1 as (select h1.job_id, c.line_no, c.v, starts_with(c.v, '#') or c.v = '&nbsp;' as stop from h1
  join clean c on c.job_id = h1.job_id and c.line_no between h1.at + 1 and h1.at + 4 where c.v <> ''),
below as (select job_id, first(v order by line_no) as company from after1 a
  where not exists (select 1 from after1 s where s.job_id = a.job_id and s.stop and s.line_no <= a.line_no)
    and not ({one_of(norm_sql(clean_sql('v')), vocab.CALLS_TO_ACTION)}) and not contains(v, ',')
    and v not in ('Berlin', 'Munich', 'Hamburg', 'Cologne') and length(v) <= 200
    and not regexp_matches(v, '^(https?://|www\\.)') group by job_id)"""
COMPANY = f"""{COMPACT}, {INSTAFFO}, {PLAIN}, {BELOW}, {section_cte('info', vocab.INFORMATION_HEADINGS)},
standalone as (select job_id, last(v2 order by line_no) as company from (
    select job_id, line_no, {clean_sql('trim(raw)')} as v2 from lines
    where regexp_matches(raw, '(?i)^\\s*(?:>\\s*)?[^\\r\\n]{{2,180}}{NW}{LEGAL_LONG}\\s*$')) group by job_id),
company as (select ads.job_id, coalesce(nullif(insta.company, ''),
    case when regexp_matches(source_url, '(?i)https?://(?:www\\.)?join\\.com/') then
      {clean_sql(extract_sql('content', '(?is)\\[\\s*(?:!\\[[^\\]]*\\]\\([^)]+\\)\\s*)*([^\\[\\]\\r\\n]{2,200}?)\\s*\\]\\(https?://(?:www\\.)?join\\.com/companies/[^)]+\\)'))} end,
    trim({extract_sql('content', '(?im)^\\s*(?:>\\s*)?(?:Arbeitgeber|Unternehmen|Company|Employer)\\s*:\\s*(.+?)\\s*$')}),
    {extract_sql('content', '(?im)^\\s*(?:>\\s*)?\\[([^\\]\\r\\n]+)\\]\\(https?://[^)\\r\\n]*/cmp/[^)\\r\\n]*\\)\\s*$')},
    nullif(regexp_replace({extract_sql('content', '(?im)^\\s*\\[!\\[([^\\]\\r\\n]+?)\\]\\([^)]*\\)\\]\\([^)]*\\)\\s*$')}, '(?i)\\s+logo\\s*$', ''), ''),
    below.company, info.value, compact.company,
    {clean_sql(extract_sql('content', f'(?im)^\\s*(?:Die|Bei)\\s+([A-ZÄÖÜ][^\\r\\n.!?]{{1,160}}?{NW}{LEGAL_LONG})(?:{NW}|$)'))},
    plain.company, standalone.company) as company
  from ads left join insta using (job_id) left join compact using (job_id) left join plain using (job_id)
  left join below using (job_id) left join info using (job_id) left join standalone using (job_id))"""


def _metadata(t: Tables):
    return D.with_metadata(B.ads(t).select("job_id", "content", "source_filename", "source_url"))


@query("x09_company", f"with {AD_LINES}, {COMPANY} select job_id, company from company")
def x09(t: Tables):
    return _metadata(t).select("job_id", "company")


LOCATION = f"""{section_cte('sloc', vocab.LOCATION_HEADINGS)}, {before_cte('bloc', vocab.LOCATION_FOOTINGS)},
{section_cte('sadr', vocab.ADDRESS_HEADINGS)},
loc0 as (select ads.job_id, content, coalesce(nullif(insta.location, ''), {inline_sql(vocab.LOCATION_HEADINGS)}, sloc.value,
    bloc.value, compact.location, {_MAP}) as location, sadr.value as address
  from ads left join insta using (job_id) left join sloc using (job_id) left join bloc using (job_id)
  left join compact using (job_id) left join sadr using (job_id)),
location as (select job_id, case when regexp_matches(location, '(?i)^\\d+\\s*(?:min(?:ute)?n?|stunden?|hours?)\\s+ab(?:{NW}|$)')
    then coalesce({inline_sql(vocab.ADDRESS_HEADINGS)}, address) else location end as location from loc0)"""


@query("x12_location", f"""with {AD_LINES}, {COMPACT}, {INSTAFFO}, {LOCATION} select job_id, location from location""")
def x12(t: Tables):
    return _metadata(t).select("job_id", "location")


WORK = f"""work as (select ads.job_id, case
    when {has('lower(content)', ['100\\s*%\\s*remote', 'fully remote', 'vollständig remote', 'remote in (?:de|germany|deutschland)'])} then 'Remote'
    when {has('lower(content)', ['hybrid', 'hybrides arbeiten'])} then 'Hybrid'
    when {has('lower(content)', ['homeoffice', 'remote work', 'work remotely', 'remotely'])} then 'Remote möglich'
    else compact.work_model end as work_model from ads left join compact using (job_id))"""


@query("x13_work_model", f"with {AD_LINES}, {COMPACT}, {WORK} select job_id, work_model from work")
def x13(t: Tables):
    return _metadata(t).select("job_id", "work_model")


_IS_CONTRACT = has("p", ["unbefristet", "befristet", "permanent", "fixed[- ]term", "temporary"])
EMPLOYMENT = f"""{section_cte('semp', vocab.EMPLOYMENT_HEADINGS)}, {section_cte('scon', vocab.CONTRACT_HEADINGS)},
bare as (select job_id, first(trim(raw) order by line_no) as value from lines where line_no <= 40 and
  regexp_matches(raw, '(?i)^\\s*(?:(?:Teilzeit,\\s*)?Vollzeit|Teilzeit|Full[- ]time|Part[- ]time)\\s*$') group by job_id),
emp0 as (select ads.job_id, coalesce(nullif(insta.employment, ''), {inline_sql(vocab.EMPLOYMENT_HEADINGS)}, semp.value, bare.value) as value,
    coalesce({inline_sql(vocab.CONTRACT_HEADINGS)}, scon.value) as explicit
  from ads left join insta using (job_id) left join semp using (job_id) left join scon using (job_id) left join bare using (job_id)),
emp1 as (select job_id, explicit, list_filter(regexp_split_to_array(value, '\\s*[,;|]\\s*'), lambda p: p <> '') as parts from emp0),
employment as (select job_id,
    nullif(array_to_string(list_filter(parts, lambda p: not {_IS_CONTRACT}), ', '), '') as employment_type,
    coalesce(explicit, nullif(array_to_string(list_filter(parts, lambda p: {_IS_CONTRACT}), ', '), '')) as contract_term
  from emp1)"""


@query("x14_employment_and_contract", f"""with {AD_LINES}, {INSTAFFO}, {EMPLOYMENT}
select job_id, employment_type, contract_term from employment""")
def x14(t: Tables):
    return _metadata(t).select("job_id", "employment_type", "contract_term")


def portal_sql(source: str) -> str:
    return "case " + " ".join(f"when contains({source}, '{m}') then '{label}'" for m, label in vocab.PORTALS) + " end"


PORTAL = portal_sql("lower(concat(coalesce(source_filename, ''), ' ', coalesce(source_url, '')))")


@query("x15_source_portal", f"with {B.ADS_CTE} select job_id, {PORTAL} as source_portal from ads")
def x15(t: Tables):
    return B.ads(t).select(
        "job_id", D.source_portal(F.col("source_filename"), F.col("source_url")).alias("source_portal")
    )


METADATA = f"""{COMPANY}, {LOCATION}, {WORK}, {EMPLOYMENT}, {language_sql('ads', 'job_id', 'content')},
meta as (select ads.job_id,
    {title_sql("coalesce(nullif(insta.title, ''), compact.title, plain.title, " + _HEADING1 + ")")} as title,
    company.company,
    trim({extract_sql('content', '(?im)^\\s*(?:>\\s*)?(?:Veröffentlichungsdatum|Published)\\s*:\\s*(.+?)\\s*$')}) as published_text,
    location.location, employment.employment_type, employment.contract_term, work.work_model,
    {PORTAL} as source_portal, lang.language
  from ads left join insta using (job_id) left join compact using (job_id) left join plain using (job_id)
  join company using (job_id) join location using (job_id) join employment using (job_id) join work using (job_id)
  join lang using (job_id))"""


@query("x_extract_metadata", f"with {AD_LINES}, {METADATA} select * from meta")
def x_metadata(t: Tables):
    return _metadata(t).select("job_id", *D.FIELDS)


@query("p10_needs_fallback", f"""with {AD_LINES}, {METADATA}
select job_id, title is null or company is null or location is null or language is null
  or length(coalesce(location, '')) > 120 or len(string_split(coalesce(location, ''), ' ')) > 12 as needs_fallback from meta""")
def p10(t: Tables):
    return _metadata(t).select(
        "job_id",
        Q.needs_fallback(*[F.col(c) for c in vocab.REQUIRED_METADATA]).alias("needs_fallback"),
    )


# --- ads: structure -----------------------------------------------------------------------

ITEM_SQL = "^\\s*(?:[-*+]|\\d+[.)])\\s+\\S"
JOINED = f"""flagged as (select *, regexp_matches(raw, '^ {{1,3}}[^ ]') and not regexp_matches(trim(raw), '{ITEM_SQL}') as cont from lines),
islands as (select *, sum(case when cont then 0 else 1 end) over (partition by job_id order by line_no) as grp from flagged),
heads as (select *, bool_or(not cont and regexp_matches(raw, '{ITEM_SQL}')) over (partition by job_id, grp) as item from islands),
joined as (select job_id, min(line_no) as line_no,
    string_agg(case when cont then trim(raw) else rtrim(raw) end, ' ' order by line_no) as line
  from heads where item group by job_id, grp
  union all select job_id, line_no, raw from heads where not item)"""


@query("x16_join_continuations", f"""with {B.ADS_CTE}, {LINES}, {JOINED}
select job_id, string_agg(rtrim(line), chr(10) order by line_no) as content from joined group by job_id""")
def x16(t: Tables):
    joined = X.join_continuations(F.col("content"))
    return B.ads(t).select("job_id", F.regexp_replace(joined, r"(?m)[ \t]+$", "").alias("content"))


def item_clean_sql(value: str) -> str:
    return f"trim(regexp_replace({value}, '\\s+', ' ', 'g'), ' :;,.' || chr(9))"


FILLED = f"""marks as (select *, coalesce(nullif(regexp_extract(line, '^\\s{{0,3}}#{{1,6}}\\s+(.+?)\\s*$', 1), ''),
    nullif(regexp_extract(line, '^\\s*\\*\\*([^*]{{2,60}})\\*\\*\\s*.{{0,80}}$', 1), '')) as mark from joined),
kinds as (select job_id, line_no, line, mark, {item_clean_sql('mark')} as head from marks),
tagged as (select *, case when mark is null then null
    when {has('head', vocab.BENEFIT_HEADINGS)} then 'benefit'
    when {has('head', vocab.ACTIVITY_HEADINGS)} or {has('head', [o.replace(chr(92) + 'b', '') for o in vocab.ACTIVITY_OPENERS])} then 'activity'
    when {has('head', vocab.REQUIREMENT_HEADINGS)} then 'requirement' else 'none' end as kind from kinds),
filled as (select *, last_value(kind ignore nulls) over w as section, last_value(head ignore nulls) over w as heading
  from tagged window w as (partition by job_id order by line_no rows between unbounded preceding and current row)),
items as (select job_id, line_no, section, heading,
    {item_clean_sql("regexp_extract(line, '^\\s*(?:[-*+]|\\d+[.)])\\s+(.+?)\\s*$', 1)")} as text
  from filled where mark is null and section <> 'none' and regexp_matches(line, '{ITEM_SQL}')),
firsts as (select *, row_number() over (partition by job_id, section, replace(lower(text), 'ß', 'ss') order by line_no) as rn
  from items where length(text) >= 8),
kept as (select *, row_number() over (partition by job_id, section order by line_no) - 1 as position from firsts where rn = 1)"""
AD_ITEMS = f"{B.ADS_CTE}, {LINES}, {JOINED}, {FILLED}"


@query("x17_section_fill", f"""with {AD_ITEMS}
select job_id, section, heading, count(*) as items from items group by all""")
def x17(t: Tables):
    parts = B.ads(t).select("job_id", F.explode(X.segments(F.col("content"))).alias("s"))
    counted = parts.where("s.kind is not null and size(s.items) > 0").groupBy(
        "job_id", F.col("s.kind").alias("section"), F.col("s.heading").alias("heading")
    )
    return counted.agg(F.sum(F.size("s.items")).alias("items"))


def _structured(t: Tables):
    return X.with_structure(B.ads(t).select("job_id", "content"))


@query("x18_activities", f"""with {AD_ITEMS},
acts as materialized (select job_id, position, text from kept where section = 'activity')
select job_id, position, text as activity, {keywords_sql('text')} as keywords, 0.85::double as confidence from acts""")
def x18_activities(t: Tables):
    return X.activity_rows(_structured(t)).select(
        "job_id", "position", "activity", F.array_join("keywords", " ").alias("keywords"), "confidence"
    )


@query("x18_benefits", f"""with {AD_ITEMS}
select job_id, position, text as benefit from kept where section = 'benefit'""")
def x18_benefits(t: Tables):
    return X.benefit_rows(_structured(t)).select("job_id", "position", "benefit")


_YEARS_SQL = (
    "(?i)(?:mindestens|min\\.|at\\s+least|minimum|mehr\\s+als|over)?\\s*"
    "(\\d+(?:[.,]\\d+)?(?:\\s*(?:bis|-|–)\\s*\\d+(?:[.,]\\d+)?)?|" + "|".join(vocab.NUMBER_WORDS) + ")\\s*"
    "(?:jahr(?:e|en)?|years?)\\s*(?:of\\s+)?(?:berufs?\\s*|profession(?:al)?\\s+)?(?:erfahrung|experience)"
)
_WORD_CASE = " ".join(f"when '{w}' then {n}" for w, n in vocab.NUMBER_WORDS.items())
REQUIREMENT_ROWS = f"""req0 as (select *, lower(regexp_extract(text, '{_YEARS_SQL}', 1)) as yw,
    case when {has("concat(heading, ' ', text)", vocab.OPTIONAL_WORDS)} then 'nice_to_have'
      when {has("concat(heading, ' ', text)", vocab.MUST_WORDS)} then 'must' else 'should' end as priority
  from kept where section = 'requirement'),
req1 as (select *, coalesce(try_cast(replace(regexp_extract(yw, '^(\\d+(?:[.,]\\d+)?)', 1), ',', '.') as double),
    case yw {_WORD_CASE} end) as years,
    {item_clean_sql(f"regexp_replace(regexp_replace(text, '{_YEARS_SQL}', ''), '(?i)^\\s*(?:with|of|in|and|oder|mit|sowie|für)\\s+', '')")} as rest
  from req0),
req2 as (
  select job_id, line_no, 0 as part, concat('Mindestens ', cast(cast(years as int) as varchar), ' Jahre Berufserfahrung') as requirement,
    'experience' as category, priority, 'Berufserfahrung years_experience' as keywords,
    concat('min_years:', cast(cast(years as int) as varchar)) as normalized_value, 0.95::double as confidence, text as evidence
  from req1 where years is not null
  union all select job_id, line_no, 1, rest, 'other', priority, {keywords_sql('rest')}, null, 0.8::double, text
  from req1 where years is not null and length(rest) >= 3
  union all select job_id, line_no, 0, text, 'other', priority, {keywords_sql('text')}, null, 0.8::double, text
  from req1 where years is null),
reqs as (select *, cast(row_number() over (partition by job_id order by line_no, part) - 1 as int) as position
  from req2)"""


@query("x18_requirements", f"""with {AD_ITEMS}, {REQUIREMENT_ROWS}
select job_id, position, requirement, category, priority, keywords, normalized_value, confidence, evidence from reqs""")
def x18_requirements(t: Tables):
    return X.requirement_rows(_structured(t)).withColumn("keywords", F.array_join("keywords", " "))


@query("x19_priority", f"""with {AD_ITEMS}, {REQUIREMENT_ROWS} select job_id, position, text, priority from req0""")
def x19(t: Tables):
    rows = X.item_rows(B.ads(t), "requirement")
    return rows.select(
        "job_id", "position", "text", X.priority(F.col("text"), F.col("heading")).alias("priority")
    )


@query("x20_years_requirement", f"""with {AD_ITEMS}, {REQUIREMENT_ROWS}
select job_id, requirement, normalized_value, priority from reqs where category = 'experience'""")
def x20(t: Tables):
    return X.requirement_rows(_structured(t)).where("category = 'experience'").select(
        "job_id", "requirement", "normalized_value", "priority"
    )


_YEAR_LINE = (
    "(?i)(?:mindestens|mind\\.?|at least|minimum|over|mehr als)?\\s*(\\d+(?:[.,]\\d+)?)"
    "(?:\\s*(?:bis|-|–)\\s*\\d+(?:[.,]\\d+)?)?\\s*(?:\\+|plus)?\\s*(?:jahr(?:e|en)?|years?)\\s*(?:of\\s+)?"
    "(?:berufs?|professional)?\\s*(?:erfahrung|experience)\\b"
)
# no look-ahead in the twin: "lead times" is blanked before the words are searched
_NO_TIMES = "regexp_replace(line, '(?i)lead\\s+times', '', 'g')"
_RULES = ", ".join(
    has(_NO_TIMES, [o.replace("(?!\\s+times)", "") for o in options]) + f" as r{i}"
    for i, (_, options) in enumerate(vocab.SENIORITY_RULES, 1)
)
SENIORITY = f"""sl as (select job_id, line_no, trim(raw) as line from lines where trim(raw) <> ''),
sr as (select *, {_RULES}, {has('line', vocab.OWNERSHIP_WORDS)} as own, regexp_matches(line, '{_YEAR_LINE}') as yearly from sl),
sy as (select job_id, list_max(list_transform(regexp_extract_all(content, '{_YEAR_LINE}', 1),
    lambda y: cast(replace(y, ',', '.') as double))) as years from ads),
sx as (select job_id, bool_or(r1) as r1, bool_or(r2) as r2, bool_or(r3) as r3, bool_or(r4) as r4, bool_or(own) as own from sr group by job_id),
sp as (select sx.job_id, years, case when r1 then 'r1' when r2 then 'r2' when r3 then 'r3' when r4 then 'r4'
    when own then 'own' when years is not null then 'years' end as rule from sx join sy using (job_id)),
sg as (select job_id, string_agg(line, '|' order by line_no) as signals from (
    select sr.job_id, line_no, line, row_number() over (partition by sr.job_id order by line_no) as n from sr join sp using (job_id)
    where (rule = 'r1' and r1) or (rule = 'r2' and r2) or (rule = 'r3' and r3) or (rule = 'r4' and r4)
      or (rule = 'own' and own) or (rule = 'years' and yearly)) group by job_id),
seniority as (select sp.job_id, case rule when 'r1' then 'senior' when 'r2' then 'lead' when 'r3' then 'senior'
      when 'r4' then 'junior' when 'own' then 'professional' when 'years' then 'professional' end as level,
    case when rule in ('r1','r2','r3','r4') then 0.95::double when rule is null then null
      when years is not null then 0.92::double else 0.7::double end as confidence,
    case when rule is not null then years end as years_required, signals
  from sp left join sg using (job_id))"""


@query("x22_seniority", f"with {B.ADS_CTE}, {LINES}, {SENIORITY} select * from seniority")
def x22(t: Tables):
    return B.ads(t).select("job_id", S.seniority(F.col("content")).alias("s")).select(
        "job_id", "s.level", "s.confidence", "s.years_required", F.array_join("s.signals", "|").alias("signals")
    )


@query("x23_ensure_seniority_requirement", f"""with {AD_ITEMS}, {REQUIREMENT_ROWS}, {SENIORITY}
select job_id, requirement, category, priority, normalized_value, evidence from reqs
union all
select job_id, concat('Mindestens ', cast(cast(years_required as int) as varchar), ' Jahre Berufserfahrung'), 'experience', 'must',
  concat('min_years:', cast(cast(years_required as int) as varchar)), replace(signals, '|', '; ')
from seniority where years_required is not null
  and job_id not in (select job_id from reqs where category = 'experience')""")
def x23(t: Tables):
    level = S.seniority(F.col("content"))
    jobs = _structured(t).withColumn("seniority", level).withColumn(
        "requirements", S.ensure_seniority_requirement(F.col("requirements"), F.col("seniority"))
    )
    return X.requirement_rows(jobs).select(
        "job_id", "requirement", "category", "priority", "normalized_value", "evidence"
    )


_ROLE_PREFIX = ("(?i)^.*?(?:your role|the role|position|we are looking for|you will be|mission|responsibilities)"
                "\\s*[:\\-]?\\s*")


@query("x24_job_role", f"""with {AD_LINES}, {METADATA},
cand as (select job_id, 0 as n, trim(title) as c from meta where title is not null
  union all select job_id, n, c from (select job_id, row_number() over (partition by job_id order by line_no) as n,
    trim(raw, ' #-*' || chr(9)) as c from lines where trim(raw) <> '') where n <= 80),
roles as (select *, {has('c', vocab.ROLE_CONTEXTS)} as ctx from cand where {has('c', vocab.ROLE_NOUNS)} and length(c) <= 140),
picked as (select job_id, first(c order by n) filter (where ctx) as contextual, first(c order by n) as any_role from roles group by job_id),
val as (select meta.job_id, coalesce(trim(regexp_replace(regexp_replace(contextual, '{_ROLE_PREFIX}', ''), '(?s)[.!?].*$', '')),
    any_role, trim(meta.title), '') as v from meta left join picked using (job_id))
select job_id, nullif(trim(regexp_replace(regexp_replace(regexp_replace(v, '\\s+', ' ', 'g'),
  '(?i)\\b(?:{'|'.join(vocab.ROLE_LEVELS)})\\b', '', 'g'), '\\s{{2,}}', ' ', 'g'), ' -,:;'), '') as role from val""")
def x24(t: Tables):
    return _metadata(t).select("job_id", "title", "content").select(
        "job_id", S.job_role(F.col("title"), F.col("content")).alias("role")
    )


@query("k02_requirements_by_category_priority_text", f"""with {AD_ITEMS}, {REQUIREMENT_ROWS}
select job_id, category, priority, requirement from reqs order by job_id, category, priority, requirement""")
def k02(t: Tables):
    return X.requirement_rows(_structured(t)).select("job_id", "category", "priority", "requirement").orderBy(
        "job_id", "category", "priority", "requirement"
    )


@query("k05_per_group_caps", f"""with {AD_ITEMS}, {REQUIREMENT_ROWS}
select 'requirement' as kind, job_id, count(*) as n from reqs group by job_id
union all select section, job_id, count(*) from kept where section <> 'requirement' group by section, job_id""")
def k05(t: Tables):
    jobs = _structured(t)
    sizes = jobs.select(
        "job_id",
        F.explode(F.create_map(
            F.lit("requirement"), F.size("requirements"), F.lit("activity"), F.size("activities"),
            F.lit("benefit"), F.size("benefits"))).alias("kind", "n"),
    )
    return sizes.where("n > 0").select("kind", "job_id", F.col("n").cast("long").alias("n"))
