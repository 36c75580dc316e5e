"""Registered queries over clinical studies and adverse-event reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from pharmalith.operators import adverse, trials
from pharmalith.plans.registry import query
from pharmalith.session import through_storage

# Fixed value: the country of the bound tables.
HOME = "NATION_19"

_MATCH = """
    select r.request_id, s.nct_id
    from r_conditions r join v_studies s on s.overall_status = 'RECRUITING'
    where (nullif(r.intervention, '') is not null or nullif(r.condition, '') is not null)
      and (nullif(r.condition, '') is null
           or {condition})
      and (nullif(r.intervention, '') is null or s.nct_id in (
           select v.nct_id from v_study_interventions v where {intervention}))"""
_IN_COUNTRY = " and s.nct_id in (select nct_id from v_study_locations where country = 'NATION_19')"
_CONTAINS = _MATCH.format(
    condition="lower(s.condition_name) like concat('%', lower(r.condition), '%')",
    intervention="lower(v.intervention) like concat('%', lower(r.intervention), '%')",
)
_EXACT = _MATCH.format(
    condition="lower(s.condition_name) = lower(r.condition)",
    intervention="lower(v.intervention) = lower(r.intervention)",
)
_TOP = """
    select * from (
        select h.request_id, row_number() over (
                   partition by h.request_id order by s.last_update desc nulls last, s.nct_id) as rank,
               s.nct_id, s.brief_title as title, s.overall_status as status,
               concat('https://clinicaltrials.gov/study/', s.nct_id) as url,
               cast(cast(s.last_update as date) as varchar) as last_update
        from ({hits}) h join v_studies s on h.nct_id = s.nct_id) where rank <= {n}"""


def _studies(t):
    return t.view("v_studies")


def _hits(t, country=HOME, match="contains"):
    studies = _studies(t)
    return trials.matching_studies(
        t.view("r_conditions"),
        studies,
        studies.select("nct_id", F.col("condition_name").alias("condition")),
        t.view("v_study_interventions"),
        None if country is None else t.view("v_study_locations"),
        country or HOME,
        match=match,
    )


def _dated(df):
    return df.withColumn("last_update", F.col("last_update").cast("date").cast("string"))


@query(oracle=_TOP.format(hits=_CONTAINS + _IN_COUNTRY, n=3))
def trials_recruiting(t):
    """The three latest recruiting studies with a site in the country, per request."""
    return _dated(trials.latest(_hits(t), _studies(t), 3))


@query(oracle=_TOP.format(hits=_EXACT + _IN_COUNTRY, n=3))
def trials_exact(t):
    """The same with exact matching of condition and intervention."""
    return _dated(trials.latest(_hits(t, match="exact"), _studies(t), 3))


@query(oracle=_CONTAINS + _IN_COUNTRY)
def trials_matching(t):
    """All recruiting studies with a site in the country, per request."""
    return _hits(t)


@query(
    oracle=f"""
    select distinct h.request_id, h.nct_id, l.city
    from ({_TOP.format(hits=_CONTAINS + _IN_COUNTRY, n=3)}) h join v_study_locations l on h.nct_id = l.nct_id
    where l.country = 'NATION_19' and l.status = 'RECRUITING' and l.city <> ''"""
)
def trials_recruiting_cities(t):
    """Cities with a recruiting site for those studies."""
    top = through_storage(trials.latest(_hits(t), _studies(t), 3), "latest-studies")
    return trials.recruiting_cities(top, t.view("v_study_locations"), HOME)


@query(
    oracle=f"""
    select r.request_id, count(h.nct_id) as n_studies
    from r_conditions r left join ({_CONTAINS}) h on r.request_id = h.request_id group by r.request_id"""
)
def trials_total(t):
    """Recruiting studies of each request in any country."""
    studies = _studies(t)
    conditions = studies.select("nct_id", F.col("condition_name").alias("condition"))
    return trials.count_studies(t.view("r_conditions"), studies, conditions, t.view("v_study_interventions"))


_SITES = """
    select nct_id, coalesce(status, 'UNKNOWN') as site_status, count(*) as n_sites
    from v_study_locations where country = 'NATION_19'
      and nct_id in (select nct_id from v_studies where overall_status = 'RECRUITING') group by 1, 2"""


@query(
    oracle=f"""
    select s.nct_id, cast(coalesce(sum(n_sites), 0) as bigint) as n_sites,
           coalesce(string_agg(concat(n_sites, ' ', site_status), ', ' order by site_status)
                    filter (where site_status is not null), '') as summary
    from v_studies s left join ({_SITES}) c on c.nct_id = s.nct_id
    where s.overall_status = 'RECRUITING' group by s.nct_id"""
)
def trials_site_status(t):
    """Sites per status of every recruiting study, as one line."""
    recruiting = _studies(t).filter("overall_status = 'RECRUITING'")
    return trials.site_status_text(recruiting, t.view("v_study_locations"), HOME)


@query(oracle=_SITES)
def trials_site_counts(t):
    """The same in long form."""
    recruiting = _studies(t).filter("overall_status = 'RECRUITING'")
    return trials.site_status(recruiting, t.view("v_study_locations"), HOME)


@query(
    oracle="""
    select distinct nct_id, coalesce(city, 'N/D') as city from v_study_locations
    where country = 'NATION_19' and status = 'RECRUITING'
      and nct_id in (select nct_id from v_studies where overall_status = 'RECRUITING')"""
)
def trials_site_cities(t):
    """Cities with a recruiting site, for every recruiting study."""
    recruiting = _studies(t).filter("overall_status = 'RECRUITING'")
    return trials.status_cities(recruiting, t.view("v_study_locations"), HOME)


# One report per event: its substance, the family of that substance, and its reactions.
_REPORTS = """
    select event_id as report_id, concat('Substance ', k) as substance,
           concat('family ', substr(k, 1, 1)) as family, event_type as reaction,
           case when value > 50 then concat('severe ', event_type) else event_type end as second_reaction
    from (select event_id, event_type, value, get_json_object(props, '$.k') as k from {events}) as e"""


def reports(t):
    return t.sql(_REPORTS).select(
        "report_id",
        F.array("substance", "family").alias("substances"),
        F.array("reaction", "second_reaction").alias("reactions"),
    )



def adverse_requests(t):
    rows = t.sql(_REPORTS)
    return rows.select(F.lower("substance").alias("substance")).union(rows.select("family")).distinct()


_DUCK_REPORTS = _REPORTS.replace("get_json_object", "json_extract_string").replace("{events}", "events")
ADVERSE_ORACLE = f"""
    with rep as ({_DUCK_REPORTS}),
         pairs as (
            select distinct report_id, upper(s) as s, term
            from (select report_id, substance as s, reaction as term from rep
                  union all select report_id, substance, second_reaction from rep
                  union all select report_id, family, reaction from rep
                  union all select report_id, family, second_reaction from rep)),
         counts as (select s, term, count(*) as count from pairs group by s, term),
         ranked as (select *, row_number() over (partition by s order by count desc, term) as rank from counts)
    select lower(s) as substance, rank, term, count from ranked where rank <= 5"""


@query(oracle=ADVERSE_ORACLE)
def adverse_topk(t):
    """The five most reported reactions of every substance."""
    return adverse.top_reactions(adverse_requests(t), reports(t), 5)
