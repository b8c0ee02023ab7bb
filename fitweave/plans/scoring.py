"""Queries on scored matches."""

from __future__ import annotations

from pyspark.sql import functions as F

from fitweave.operators import scoring as S
from fitweave.plans import bindings as B
from fitweave.plans.registry import Tables, query

FIT = f"""with {B.SCORED},
weighed as (select *, case priority when 'must' then 3 when 'should' then 2 else 1 end as w,
  case match_level when 'strong_match' then 100 when 'partial_match' then 65 when 'transferable' then 40
    else 0 end as pct from scored),
sums as (select job_id, profile_id, sum(w * pct) as h, sum(w) as possible_points, count(*) as requirement_count,
  count(*) filter (where priority = 'must' and match_level in ('gap','unknown')) as must_gaps
  from weighed group by job_id, profile_id),
fit as (select job_id, profile_id, cast(round_even(cast(h as double) / possible_points, 0) as int) as score,
  cast(h as double) / 100 as achieved_points, cast(possible_points as bigint) as possible_points,
  requirement_count, must_gaps from sums)"""


@query("a01_qualification_fit", f"""{FIT}
select *, case when score >= 80 then 'strong' when score >= 60 then 'good' when score >= 40 then 'partial'
  else 'weak' end as level from fit""")
def a01(t: Tables):
    return S.qualification_fit(B.scored_matches(t))


@query("a01_weighted_requirements", f"""{FIT}
select job_id, requirement_id, priority, w as priority_weight, match_level, pct as fulfillment_percent,
  w * pct / 100.0::double as weighted_points, w as possible_points from weighed""")
def a01_rows(t: Tables):
    return S.weighted_requirements(B.scored_matches(t)).drop("profile_id", "requirement")


@query("a02_match_level_summary", f"""with {B.SCORED}
select job_id, profile_id, match_level, count(*) as n from scored group by all""")
def a02(t: Tables):
    return S.level_counts(B.scored_matches(t))


@query("a02_level_summary_map", f"""with {B.SCORED},
counts as (select job_id, match_level, count(*) as n from scored group by all)
select job_id, string_agg(concat(match_level, '=', cast(n as varchar)), ',' order by match_level) as summary
from counts group by job_id""")
def a02_map(t: Tables):
    entries = F.array_sort(F.transform(
        F.map_entries("summary"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))
    ))
    return S.level_summary(B.scored_matches(t), ["job_id"]).select(
        "job_id", F.array_join(entries, ",").alias("summary")
    )


@query("a11_must_gaps", f"""{FIT} select job_id, must_gaps from fit""")
def a11(t: Tables):
    return S.qualification_fit(B.scored_matches(t)).select("job_id", "must_gaps")


@query("k3_matches_by_priority_and_text", f"""with {B.SCORED}
select job_id, priority, requirement, match_level from scored order by job_id, priority, requirement""")
def k3(t: Tables):
    return B.scored_matches(t).select("job_id", "priority", "requirement", "match_level").orderBy(
        "job_id", "priority", "requirement"
    )
