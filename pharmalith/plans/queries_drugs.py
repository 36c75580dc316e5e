"""Registered queries over the drug relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from pharmalith.operators import drugs, quality
from pharmalith.operators.text_index import TextIndex
from pharmalith.plans.registry import query
from pharmalith.session import scratch_path


@query(oracle="select * from drugs")
def drug_dedup(t):
    """The richest record of each drug id."""
    return t.drugs


@query(oracle="select * from interactions")
def interaction_distinct(t):
    return t.interactions


@query(oracle="select distinct * from v_synonyms_raw where synonym is not null and synonym <> ''")
def synonym_distinct(t):
    return t.synonyms


@query(oracle="select * from atc_codes")
def atc_distinct(t):
    return t.atc_codes


_RESOLVE = """
    with syn as (select lower(synonym) as k, min(drugbank_id) as id from synonyms group by 1),
         nam as (select lower(name) as k, min(drugbank_id) as id from drugs group by 1)
    select r.request_id, r.query, d.drugbank_id, d.name, d.type, d.state
    from r_names r left join syn on syn.k = lower(r.query) left join nam on nam.k = lower(r.query)
    join drugs d on d.drugbank_id = {order}"""


@query(oracle=_RESOLVE.format(order="coalesce(syn.id, nam.id)"))
def drug_resolve(t):
    """Drug record of each name, synonyms first."""
    return drugs.resolve(t.view("r_names"), t.drugs, t.synonyms)


@query(oracle=_RESOLVE.format(order="coalesce(nam.id, syn.id)"))
def drug_resolve_name_first(t):
    """Drug record of each name, drug names first."""
    return drugs.resolve(t.view("r_names"), t.drugs, t.synonyms, priority="name")


@query(oracle=_RESOLVE.format(order="syn.id"))
def drug_resolve_synonym(t):
    """Drug record of each synonym, drug names not tried."""
    return drugs.resolve(t.view("r_names"), t.drugs, t.synonyms, priority="synonym_only")


@query(
    oracle="""
    select r.request_id, r.query, d.drugbank_id, d.name, d.type, d.state
    from r_atc r join (select atc_code, min(drugbank_id) as id from atc_codes group by 1) c
      on c.atc_code = upper(r.query) join drugs d on d.drugbank_id = c.id"""
)
def drug_by_atc(t):
    """Drug record of each ATC code."""
    return drugs.by_atc(t.view("r_atc"), t.drugs, t.atc_codes)


@query(
    oracle="""
    select r.request_id, r.query, case when d.smiles <> '' then d.smiles end as smiles,
           coalesce(d.smiles <> '', false) as found
    from r_names r left join (
        select *, row_number() over (partition by lower(name) order by drugbank_id) as rn from drugs) d
      on lower(d.name) = lower(r.query) and d.rn = 1"""
)
def drug_smiles(t):
    """SMILES text of each drug name."""
    return drugs.smiles_of(t.view("r_names"), t.drugs)


@query(
    oracle="""
    with big as (select request_id from r_drug_lists group by 1 having count(*) >= 2),
         listed as (select distinct request_id, drugbank_id from r_drug_lists
                    where request_id in (select request_id from big))
    select s.request_id, i.source_drug_id, a.name as source_name, i.target_drug_id, b.name as target_name,
           i.description
    from interactions i join listed s on s.drugbank_id = i.source_drug_id
    join listed g on g.drugbank_id = i.target_drug_id and g.request_id = s.request_id
    join drugs a on a.drugbank_id = i.source_drug_id join drugs b on b.drugbank_id = i.target_drug_id"""
)
def drug_interactions(t):
    """Known interactions within each list of drugs."""
    return drugs.interactions_among(t.view("r_drug_lists"), t.interactions, t.drugs)


@query(
    oracle="""
    select i.source_drug_id, a.name as source_name, i.target_drug_id, b.name as target_name, i.description
    from v_interactions_raw i join drugs a on a.drugbank_id = i.source_drug_id
    join drugs b on b.drugbank_id = i.target_drug_id
    where i.source_drug_id in ('DB1', 'DB2', 'DB3', 'DB4', 'DB5', 'DB6')
      and i.target_drug_id in ('DB1', 'DB2', 'DB3', 'DB4', 'DB5', 'DB6')"""
)
def drug_interactions_one_list(t):
    """Known interactions within one list, before full-row dedup."""
    return drugs.interactions_of_list(["DB1", "DB2", "DB3", "DB4", "DB5", "DB6"], t.view("v_interactions_raw"), t.drugs)


@query(oracle="select drugbank_id, synonym from synonyms where regexp_matches(lower(synonym), 'red|s.a')")
def synonym_contains(t):
    """Synonyms that match a pattern."""
    return drugs.synonyms_like(t.synonyms, "red|s.a")


# A pattern per name of two words: its ends, either of its words, and the second word with a sign that may be missing.
_PATTERNS = """
    select concat('ends ', p_name) as request_id, concat('^', substr(p_name, 1, 3), '.*', substr(p_name, length(p_name) - 2, 3), '$') as pattern
    from {part} group by p_name
    union all select concat('either ', p_type), concat(lower(p_type), '|', 'wid.et') from {part} group by p_type
    union all select concat('second ', p_name), concat('\\\\s', substr(p_name, length(p_name) - 3, 4), 's?$') from {part} group by p_name
    union all select 'short', 'r.d'"""


@query(
    oracle=f"""
    select r.request_id, r.pattern, s.drugbank_id, s.synonym from ({_PATTERNS.format(part="part").replace(chr(92) * 2, chr(92))}) r
    join synonyms s on regexp_matches(lower(s.synonym), r.pattern)"""
)
def synonym_patterns(t):
    """A table of patterns, each looked up by the texts that its matches must hold."""
    index = TextIndex(t.spark, scratch_path(t.spark, "synonym-index"), "synonym")
    index.add("synonyms", t.synonyms)
    return index.search_patterns(t.sql(_PATTERNS), "pattern")


_BRIDGE = """
    select c.atc_code, p.denominazione as nome_farmaco_aifa, d.name as principio_attivo_drugbank
    from atc_codes c join drugs d on c.drugbank_id = d.drugbank_id
    join (select distinct codice_atc, denominazione from v_farmaci_anagrafica where codice_atc is not null) p
      on c.atc_code = p.codice_atc"""


@query(oracle=_BRIDGE)
def atc_bridge(t):
    """Register packs next to the drugs that share their ATC code."""
    return drugs.atc_bridge(t.atc_codes, t.drugs, t.view("v_farmaci_anagrafica"))


@query(
    oracle=f"""
    select atc_code, count(*) as n_coppie from ({_BRIDGE}) group by atc_code"""
)
def atc_bridge_counts(t):
    """Number of matches per ATC code, without building the matches."""
    return drugs.atc_bridge_counts(t.atc_codes, t.drugs, t.view("v_farmaci_anagrafica")).select(
        "atc_code", "n_coppie"
    )


# Rows of the bridge by number; the numbers are drawn by md5 as the operator does.
_NUMBERED = """
    select c.atc_code, p.denominazione as nome_farmaco_aifa, d.name as principio_attivo_drugbank,
           row_number() over (order by c.atc_code, c.drugbank_id, p.denominazione nulls first) - 1 as k
    from atc_codes c join drugs d on c.drugbank_id = d.drugbank_id
    join (select distinct codice_atc, denominazione from v_farmaci_anagrafica where codice_atc is not null) p
      on c.atc_code = p.codice_atc"""


@query(
    oracle=f"""
    with b as ({_NUMBERED}),
         t as (select count(*) as n from b),
         d as (select i, cast(concat('0x', substr(md5(concat('5:', i)), 1, 15)) as bigint) % n as k
               from t, range(200) r(i)),
         f as (select k, min(i) as i from d group by k order by i limit 5)
    select atc_code, nome_farmaco_aifa, principio_attivo_drugbank from b join f on b.k = f.k"""
)
def atc_bridge_sample(t):
    """Five matches of equal chance, the same ones on every run."""
    return drugs.atc_bridge_sample(t.atc_codes, t.drugs, t.view("v_farmaci_anagrafica"), 5, 5)


@query(
    oracle="""
    select r.request_id, r.query,
           coalesce(sum(n_name), 0)::bigint as n_name, coalesce(sum(n_synonym), 0)::bigint as n_synonym,
           coalesce(sum(n_part), 0)::bigint as n_synonym_part
    from r_names r left join (
        select k, count(*) filter (where src = 'd') as n_name, count(*) filter (where src = 's') as n_synonym,
               null::bigint as n_part, 'eq' as kind
        from (select lower(name) as k, 'd' as src from drugs union all select lower(synonym), 's' from synonyms)
        group by k
        union all
        select q, null, null, count(*), 'part' from (select distinct lower(query) as q from r_names)
        join synonyms on lower(synonym) like concat('%', q, '%') group by q) h on h.k = lower(r.query)
    group by r.request_id, r.query"""
)
def name_ladder(t):
    """Hits of each name strategy: equal name, equal synonym, part of a synonym."""
    return quality.name_ladder(t.view("r_names"), t.drugs, t.synonyms)
