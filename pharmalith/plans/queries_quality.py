"""Registered data-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pharmalith.functions.text import present
from pharmalith.operators import packs, quality
from pharmalith.plans.queries_packs import _VIEW, OWN_CLASS, _parts
from pharmalith.plans.registry import query

_COUNTS = """
    select codice_aic, count(principio_attivo) as num_principi_attivi
    from v_principi_attivi where principio_attivo is not null group by codice_aic"""

_UNITS = """
    select principio_attivo, unita_misura, count(*) as conteggio from v_principi_attivi
    where principio_attivo is not null and unita_misura is not null
    group by principio_attivo, unita_misura having count(*) > 1"""


@query(oracle=_COUNTS)
def ingredient_counts(t):
    return quality.ingredient_counts(t.view("v_principi_attivi"))


@query(
    oracle=f"""
    select count(*) as n_packs, count(*) filter (where num_principi_attivi > 1) as n_multi,
           case when count(*) > 0
               then count(*) filter (where num_principi_attivi > 1) / count(*)::double * 100 end as pct_multi,
           max(num_principi_attivi) filter (where num_principi_attivi > 1) as max_n
    from ({_COUNTS})"""
)
def multi_ingredient_summary(t):
    return quality.multi_ingredient_summary(t.view("v_principi_attivi"))


@query(
    oracle=f"""
    select * from ({_COUNTS}) where num_principi_attivi > 1
    order by num_principi_attivi desc, codice_aic limit 10"""
)
def multi_ingredient_top10(t):
    return quality.multi_ingredient_top(t.view("v_principi_attivi"), 10)


@query(oracle=_UNITS)
def unit_counts(t):
    return quality.ordered_units(quality.unit_counts(t.view("v_principi_attivi")))


@query(
    oracle=f"""
    with u as ({_UNITS})
    select * from u where principio_attivo in (
        select principio_attivo from u group by principio_attivo having count(*) > 1)"""
)
def unit_inconsistency(t):
    return quality.ordered_units(quality.unit_inconsistency(t.view("v_principi_attivi")))


@query(
    oracle="""
    select 'farmaci_anagrafica' as relation, count(*) as n_rows from v_farmaci_anagrafica
    union all select 'principi_attivi', count(*) from v_principi_attivi
    union all select 'farmaci_carenti', count(*) from v_farmaci_carenti
    union all select 'farmaci_equivalenti', count(*) from v_farmaci_equivalenti
    union all select 'classe_a', count(*) from v_classe_a
    union all select 'classe_h', count(*) from v_classe_h
    union all select 'drugs', count(*) from drugs
    union all select 'interactions', count(*) from interactions
    union all select 'synonyms', count(*) from synonyms
    union all select 'atc_codes', count(*) from atc_codes"""
)
def relation_counts(t):
    names = "farmaci_anagrafica principi_attivi farmaci_carenti farmaci_equivalenti classe_a classe_h".split()
    relations = {n: t.view(f"v_{n}") for n in names}
    relations |= {"drugs": t.drugs, "interactions": t.interactions, "synonyms": t.synonyms, "atc_codes": t.atc_codes}
    return quality.relation_counts(relations)


@query(
    oracle="""
    select 0 as position, 'codice_aic' as column_name, 'bigint' as data_type, count(*) as n_rows,
           count(codice_aic) as n_filled from v_principi_attivi
    union all select 1, 'principio_attivo', 'string', count(*), count(principio_attivo) from v_principi_attivi
    union all select 2, 'quantita', 'double', count(*), count(quantita) from v_principi_attivi
    union all select 3, 'unita_misura', 'string', count(*), count(unita_misura) from v_principi_attivi"""
)
def profile_columns(t):
    return quality.profile_columns(t.view("v_principi_attivi"))


def _rules():
    return {
        **quality.not_null("codice_aic", "denominazione", "is_carente", "data_inizio_carenza"),
        "codice_atc filled": present(F.col("codice_atc")),
    }


@query(
    oracle=f"""
    with v as ({_VIEW})
    select 'codice_aic present' as rule, count(codice_aic) as n_pass, count(*) - count(codice_aic) as n_fail from v
    union all select 'denominazione present', count(denominazione), count(*) - count(denominazione) from v
    union all select 'is_carente present', count(is_carente), count(*) - count(is_carente) from v
    union all select 'data_inizio_carenza present', count(data_inizio_carenza),
                     count(*) - count(data_inizio_carenza) from v
    union all select 'codice_atc filled', count(nullif(codice_atc, '')),
                     count(*) - count(nullif(codice_atc, '')) from v"""
)
def required_fields(t):
    """Rows of the unified view that pass and fail each rule."""
    view = packs.unified_view(*_parts(t), class_column=OWN_CLASS)
    quality.require_columns(view, ["codice_aic", "denominazione", "is_carente"], "the unified view")
    return quality.check_rules(view, _rules())


@query(
    oracle="""
    select codice_aic, principio_attivo, quantita, unita_misura,
           concat_ws('|', case when principio_attivo is null then 'principio_attivo present' end,
                     case when unita_misura is null then 'unita_misura present' end) as broken
    from v_principi_attivi where principio_attivo is null or unita_misura is null"""
)
def required_fields_rejects(t):
    """Ingredient rows without a name or a unit."""
    bad = quality.rejects(t.view("v_principi_attivi"), quality.not_null("principio_attivo", "unita_misura"))
    return bad.withColumn("broken", F.array_join("broken_rules", "|")).drop("broken_rules")


@query(
    oracle="""
    select p_partkey as codice_aic from part
    where p_partkey not in (select codice_aic from v_classe_a)"""
)
def reconcile_missing(t):
    """Packs of the register that are not on the list of class A."""
    return quality.missing_keys(t.view("v_farmaci_anagrafica"), t.view("v_classe_a"), "codice_aic")


def _stock(t):
    return t.sql("select p_partkey as codice_aic, upper(p_name) as farmaco, p_brand as ditta from {part}")


def _sold(t):
    """Offers of all packs, some of them without their company."""
    return t.sql(
        """select l_partkey as codice_aic, upper(p_name) as farmaco,
                  case when l_returnflag = 'R' then null else p_brand end as ditta
           from {lineitem} join {part} on l_partkey = p_partkey"""
    )


_RECONCILED = """
    select s.p_partkey as codice_aic, upper(s.p_name) as source_farmaco, s.p_brand as source_ditta,
           l.farmaco as loaded_farmaco, l.ditta as loaded_ditta, l.codice_aic is not null as found,
           concat_ws('|',
               case when l.codice_aic is not null and upper(s.p_name) is distinct from l.farmaco then 'farmaco' end,
               case when l.codice_aic is not null and s.p_brand is distinct from l.ditta then 'ditta' end) as differs
    from {source} s left join (
        select l_partkey as codice_aic, upper(p_name) as farmaco,
               case when l_returnflag = 'R' then null else p_brand end as ditta
        from lineitem join part on l_partkey = p_partkey{listed}) l on s.p_partkey = l.codice_aic"""


@query(oracle=_RECONCILED.format(source="part", listed=""))
def reconcile_all(t):
    """Every source row next to the loaded rows of its key, with the columns that differ."""
    return quality.reconcile(_stock(t), _sold(t), "codice_aic")


@query(
    oracle=_RECONCILED.format(
        source="(select * from part order by md5(concat('7:', cast(p_partkey as varchar))), p_partkey limit 2)",
        listed=" where l_partkey in (select codice_aic from v_classe_h)",
    )
)
def reconcile_sample(t):
    """The same for two sampled source rows, next to the offers of the packs on the list of class H."""
    sold = _sold(t).join(t.view("v_classe_h"), "codice_aic", "left_semi")
    return quality.reconcile(quality.sample_rows(_stock(t), "codice_aic", 2, 7), sold, "codice_aic")
