"""Registered queries over the register of packs."""

from __future__ import annotations

from pyspark.sql import functions as F

from pharmalith.operators import packs, quality
from pharmalith.operators.text_index import TextIndex
from pharmalith.plans.registry import query
from pharmalith.session import scratch_path

OWN_CLASS = "classe_di_rimborsabilita"

_VIEW = """
    select anag.*,
           case when a.codice_aic is not null then 'A' when h.codice_aic is not null then 'H'
                when s.classe_di_rimborsabilita is not null then s.classe_di_rimborsabilita else 'C' end
               as classe_rimborsabilita,
           s.codice_aic is not null as is_carente, s.data_inizio as data_inizio_carenza,
           s.motivazioni as motivazioni_carenza
    from v_farmaci_anagrafica anag
    left join v_classe_a a on anag.codice_aic = a.codice_aic
    left join v_classe_h h on anag.codice_aic = h.codice_aic
    left join v_farmaci_carenti s on anag.codice_aic = s.codice_aic"""

_FOUND = f"""
    select r.request_id, r.name as nome_ricercato, v.*
    from r_brands r join ({_VIEW}) v on lower(v.denominazione) like concat('%', lower(r.name), '%')"""

_INGREDIENTS = """
    select * from v_principi_attivi
    where principio_attivo is not null and principio_attivo <> '' and lower(principio_attivo) <> 'n.d.'"""


def _parts(t):
    return (t.view("v_farmaci_anagrafica"), t.view("v_classe_a"), t.view("v_classe_h"), t.view("v_farmaci_carenti"))


_NAMED = ("request_id", "name", "codice_aic", "denominazione")


def _brands(t):
    return t.view("r_brands").withColumnRenamed("name", "nome_ricercato")


def _found(t):
    return packs.status_packs(_brands(t), *_parts(t), term="nome_ricercato", class_column=OWN_CLASS)


@query(oracle=_VIEW)
def pack_unified(t):
    """All packs with class and shortage status."""
    return packs.unified_view(*_parts(t), class_column=OWN_CLASS)


@query(
    oracle="""
    select anag.*,
           case when a.codice_aic is not null then 'A'
                when s.classe_di_rimborsabilita is not null then s.classe_di_rimborsabilita else 'C' end
               as classe_rimborsabilita,
           s.codice_aic is not null as is_carente, s.data_inizio as data_inizio_carenza,
           s.motivazioni as motivazioni_carenza
    from v_farmaci_anagrafica anag
    left join v_classe_a a on anag.codice_aic = a.codice_aic
    left join v_farmaci_carenti s on anag.codice_aic = s.codice_aic"""
)
def pack_unified_no_h(t):
    """The same when the list of class H was not delivered."""
    base, class_a, _, shortages = _parts(t)
    return packs.unified_view(base, class_a, None, shortages, class_column=OWN_CLASS)


@query(
    oracle=f"""
    select s.request_id, s.nome_ricercato, n_attive, n_carenti, stato_generale, lista, codice_aic, denominazione_completa,
           classe_rimborsabilita, is_carente, data_inizio_carenza, motivazioni_carenza, principio_attivo
    from (
        select request_id, nome_ricercato, count(*) filter (where not is_carente) as n_attive,
               count(*) filter (where is_carente) as n_carenti,
               case when bool_and(is_carente) then 'Ritirato / Non Disponibile'
                    when bool_or(is_carente)
                        then 'Parzialmente Carente (alcune confezioni disponibili, altre no)'
                    else 'Disponibile' end as stato_generale
        from ({_FOUND}) group by request_id, nome_ricercato) s
    join (
        select request_id, nome_ricercato,
               case when is_carente then 'confezioni_carenti_o_ritirate' else 'confezioni_attive' end as lista,
               codice_aic, denominazione as denominazione_completa, classe_rimborsabilita, is_carente, data_inizio_carenza,
               motivazioni_carenza, null as principio_attivo
        from ({_FOUND})
        union all
        select distinct f.request_id, f.nome_ricercato, 'principi_attivi_rilevati', null, null, null, null, null, null, p.principio_attivo
        from ({_FOUND}) f join ({_INGREDIENTS}) p on f.codice_aic = p.codice_aic) l
      on s.request_id is not distinct from l.request_id and s.nome_ricercato is not distinct from l.nome_ricercato"""
)
def pack_status(t):
    """Commercial status of every brand name with its available packs, its short packs and their ingredients, one row per entry."""
    return packs.status_answer(_found(t), t.view("v_principi_attivi"), ["request_id", "nome_ricercato"])


@query(
    oracle=f"""
    select request_id, nome_ricercato, codice_aic, denominazione as denominazione_completa,
           classe_rimborsabilita, is_carente, data_inizio_carenza, motivazioni_carenza
    from ({_FOUND})"""
)
def pack_status_packs(t):
    """The packs behind each status, available and short ones."""
    return _found(t).select(
        "request_id",
        "nome_ricercato",
        "codice_aic",
        "denominazione_completa",
        "classe_rimborsabilita",
        "is_carente",
        "data_inizio_carenza",
        "motivazioni_carenza",
    )


@query(
    oracle=f"""
    select distinct f.request_id, f.nome_ricercato, p.principio_attivo
    from ({_FOUND}) f join ({_INGREDIENTS}) p on f.codice_aic = p.codice_aic"""
)
def pack_status_ingredients(t):
    """The distinct ingredients of the packs behind each status."""
    found = packs.match_contains(_brands(t), "nome_ricercato", t.view("v_farmaci_anagrafica"), "denominazione")
    return packs.status_ingredients(found, t.view("v_principi_attivi"), ["request_id", "nome_ricercato"])


@query(
    oracle="""
    select r.request_id, r.codice_aic, p.principio_attivo, p.quantita, p.unita_misura
    from r_packs r join v_principi_attivi p on r.codice_aic = p.codice_aic"""
)
def pack_ingredients(t):
    """Ingredient rows of every requested pack."""
    return packs.ingredients_of(t.view("r_packs"), t.view("v_principi_attivi")).select(
        "request_id", "codice_aic", "principio_attivo", "quantita", "unita_misura"
    )


@query(
    oracle=f"""
    with hit as (
        select r.request_id, r.name, min(p.principio_attivo) as first
        from r_brands r
        left join v_farmaci_anagrafica v on lower(v.denominazione) like concat('%', lower(r.name), '%')
        left join ({_INGREDIENTS}) p on v.codice_aic = p.codice_aic
        group by r.request_id, r.name)
    select hit.request_id, hit.name, coalesce(first, name) as cercato, e.codice_aic,
           e.farmaco as denominazione_farmaco, e.ditta as azienda, e.prezzo_riferimento_ssn as prezzo_pubblico
    from hit join v_farmaci_equivalenti e
      on lower(e.principio_attivo) like concat('%', lower(coalesce(first, name)), '%')"""
)
def pack_generics(t):
    """Equivalent drugs of every brand name, cheapest first."""
    return packs.generics(
        t.view("r_brands"),
        t.view("v_farmaci_anagrafica"),
        t.view("v_principi_attivi"),
        t.view("v_farmaci_equivalenti"),
    ).select("request_id", "name", "cercato", "codice_aic", "denominazione_farmaco", "azienda", "prezzo_pubblico")


@query(
    oracle=f"""
    select r.request_id, r.name, v.codice_aic, v.denominazione
    from r_brands r join ({_VIEW}) v on lower(v.denominazione) like concat('%', lower(r.name), '%')"""
)
def pack_search(t):
    """Rows of the unified view by part of the name, in any letter case."""
    return packs.search_view(t.view("r_brands"), *_parts(t), class_column=OWN_CLASS).select(*_NAMED)


_BRAND_CASES = """
    select request_id, name from r_brands
    union all select request_id + 1000000000000, upper(name) from r_brands"""


@query(
    oracle=f"""
    select r.request_id, r.name, v.codice_aic, v.denominazione
    from ({_BRAND_CASES}) r join ({_VIEW}) v on v.denominazione like concat('%', r.name, '%')"""
)
def pack_search_cs(t):
    """The same with the letter case as given; each brand is asked as it is and in capitals."""
    brands = t.view("r_brands")
    asked = brands.union(brands.select(F.col("request_id") + 1000000000000, F.upper("name")))
    return packs.search_view(asked, *_parts(t), ignore_case=False, class_column=OWN_CLASS).select(*_NAMED)


_MANY_TERMS = """
    select min(c_custkey) as request_id, concat(lower(c_mktsegment), '%') as query
    from {customer} group by c_mktsegment
    union all
    select 1000000000000 + min(c_custkey), concat('_i', substr(c_mktsegment, 1, 1))
    from {customer} group by substr(c_mktsegment, 1, 1)
    union all
    select 2000000000000 + min(p_partkey), substr(p_name, 3, 9) from {part} group by substr(p_name, 3, 9)
    union all
    select 3000000000000 + min(p_partkey), concat(p_name, ' ', p_type) from {part} group by p_name, p_type
    union all
    select 4000000000000 + min(s_suppkey), s_name from {supplier} group by s_name"""


@query(
    oracle=f"""
    select r.request_id, r.query, v.codice_aic, v.denominazione
    from ({_MANY_TERMS.format(customer="customer", part="part", supplier="supplier")}) r
    join v_farmaci_anagrafica v on lower(v.denominazione) like concat('%', lower(r.query), '%')"""
)
def pack_search_many(t):
    """Part-of-name search for several hundred different terms, wildcards among them.

    Equal terms are one request: their answers would be the same rows again.
    """
    view = t.view("v_farmaci_anagrafica").select("codice_aic", "denominazione")
    return packs.search(t.sql(_MANY_TERMS), view, term="query")


def _pack_index(t) -> TextIndex:
    """Packs indexed in two batches, one of which is delivered twice and a third that is withdrawn again."""
    view = t.view("v_farmaci_anagrafica").select("codice_aic", "denominazione")
    index = TextIndex(t.spark, scratch_path(t.spark, "pack-index"), "denominazione")
    index.add("even", view.filter("codice_aic % 2 = 0"))
    index.add("odd", view)
    index.add("again", view)
    index.add("odd", view.filter("codice_aic % 2 <> 0"))
    index.remove("again")
    return index


@query(
    oracle=f"""
    select r.request_id, r.query, v.codice_aic, v.denominazione
    from ({_MANY_TERMS.format(customer="customer", part="part", supplier="supplier")}
          union all select 5000000000000 + request_id, name from r_brands) r
    join v_farmaci_anagrafica v on lower(v.denominazione) like concat('%', lower(r.query), '%')"""
)
def pack_search_indexed(t):
    """The same search, and that of all brands, in a stored index that is kept by batch."""
    brands = t.view("r_brands").select(F.col("request_id") + 5000000000000, "name")
    return _pack_index(t).search(t.sql(_MANY_TERMS).union(brands), "query")


@query(
    oracle=f"""
    with names as (select denominazione from ({_VIEW}))
    select r.request_id, r.name as query,
           count(*) filter (where lower(denominazione) like concat('%', lower(r.name), '%')) as n_contains,
           count(*) filter (where denominazione like concat('%', r.name, '%')) as n_contains_case,
           count(*) filter (where lower(denominazione) like concat('%', lower(substr(r.name, 1, 5)), '%'))
               as n_fragment,
           count(*) filter (where lower(denominazione) = lower(r.name)) as n_equal
    from (select request_id, name from r_brands
          union all select request_id + 1000000000000, max(denominazione)
          from r_brands join v_farmaci_anagrafica on request_id = codice_aic group by request_id) r, names
    group by r.request_id, r.name"""
)
def search_ladder(t):
    """Hits of each search strategy for brand names and for full pack names."""
    brands, view = t.view("r_brands"), t.view("v_farmaci_anagrafica")
    full = brands.join(view, brands.request_id == view.codice_aic).select(
        (F.col("request_id") + 1000000000000).alias("request_id"), F.col("denominazione").alias("query")
    )
    asked = brands.withColumnRenamed("name", "query").union(full)
    return quality.search_ladder(asked, packs.pack_copies(*_parts(t)), weight="n")
