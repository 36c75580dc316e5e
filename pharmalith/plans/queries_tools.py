"""Registered queries over what a user calls directly: single lookups, SQL with parameters, builds."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pharmalith.operators import drugs, packs, quality, trials
from pharmalith.plans.build import VIEW, build_profile, build_register, register_view
from pharmalith.plans.queries_files import _pack_file, land
from pharmalith.plans.queries_packs import _FOUND, _VIEW, OWN_CLASS, _parts
from pharmalith.plans.queries_trials import HOME, _studies, reports
from pharmalith.plans.registry import ORACLES, query
from pharmalith.plans.tools import Tools
from pharmalith.session import scratch_path, sibling
from pharmalith.sources import catalog, delimited, generations, tables
from pharmalith.sources.delimited import Layout, TableSpec
from pharmalith.sources.landed_json import Studies


def _tools(t) -> Tools:
    names = "farmaci_anagrafica principi_attivi farmaci_equivalenti classe_a classe_h farmaci_carenti".split()
    register = {n: t.view(f"v_{n}") for n in names}
    register["farmaci_carenti"] = register["farmaci_carenti"].withColumnRenamed(OWN_CLASS, "classe_di_rimborsabilità")
    relations = {"drugs": t.drugs, "interactions": t.interactions, "synonyms": t.synonyms, "atc_codes": t.atc_codes}
    studies = t.view("v_studies")
    landed = Studies(
        studies, t.view("v_study_locations"), studies.select("nct_id", F.col("condition_name").alias("condition")), t.view("v_study_interventions")
    )
    return Tools(t.spark, register, relations, landed, reports(t))


def _stored_tools(t) -> Tools:
    """The same over register tables stored in buckets of the pack key."""
    folder = scratch_path(t.spark, "buckets")
    name = f"register_{folder[-12:]}"
    t.spark.sql(f"create database `{name}` location '{folder}'")
    views = {n: df for n, df in _tools(t).register.items() if n != "farmaci_equivalenti"}
    tables.write_bucketed(views, name, dict.fromkeys(views, "codice_aic"), 16)
    return Tools(t.spark, {n: t.spark.table(f"{name}.{n}") for n in views}, colocated=True)


def _one(t, sql: str):
    return t.sql(sql).first()[0]


_FIRST_BRAND = "(select min(p_name) from part)"


@query(
    oracle=f"""
    select {_FIRST_BRAND} as nome_ricercato, count(*) filter (where not is_carente) as n_attive,
           count(*) filter (where is_carente) as n_carenti,
           case when bool_and(is_carente) then 'Ritirato / Non Disponibile'
                when bool_or(is_carente)
                    then 'Parzialmente Carente (alcune confezioni disponibili, altre no)'
                else 'Disponibile' end as stato_generale
    from ({_VIEW}) where lower(denominazione) like concat('%', lower({_FIRST_BRAND}), '%') having count(*) > 0"""
)
def tool_status(t):
    """Commercial status of one brand."""
    return _tools(t).get_drug_commercial_status(_one(t, "select min(p_name) from {part}"))


@query(
    oracle=f"""
    select codice_aic, denominazione_farmaco, azienda, prezzo_pubblico from ({ORACLES['pack_generics']})
    where name = {_FIRST_BRAND}"""
)
def tool_generics(t):
    """Equivalent drugs of one brand."""
    return _tools(t).find_generics(_one(t, "select min(p_name) from {part}"))


@query(
    oracle="""
    select principio_attivo, quantita, unita_misura from v_principi_attivi
    where codice_aic = (select min(p_partkey) from part)"""
)
def tool_ingredients(t):
    """Ingredients of one pack."""
    return _tools(t).get_active_ingredients_by_aic(_one(t, "select min(p_partkey) from {part}"))


@query(
    oracle=f"""
    select drugbank_id, name, type, state from ({ORACLES['drug_resolve']})
    where request_id = (select concat('customer ', cast(max(c_custkey) as varchar)) from customer)"""
)
def tool_resolve(t):
    """Drug record of one name."""
    name = _one(t, "select c_name from {customer} order by c_custkey desc limit 1")
    return _tools(t).resolve_drug_entity(name.upper())


@query(
    oracle=f"""
    select distinct drugbank_id, name, type, state from ({ORACLES['drug_by_atc']})
    where query = (select lower(min(atc_code)) from atc_codes)"""
)
def tool_by_atc(t):
    """Drug record of one ATC code."""
    return _tools(t).get_drug_by_atc(t.atc_codes.agg(F.lower(F.min("atc_code"))).first()[0])


@query(
    oracle="""
    with listed as (select concat('DB', cast(c_custkey as varchar)) as id from customer order by c_custkey limit 30)
    select i.source_drug_id, a.name as source_name, i.target_drug_id, b.name as target_name, i.description
    from interactions i join drugs a on a.drugbank_id = i.source_drug_id join drugs b on b.drugbank_id = i.target_drug_id
    where i.source_drug_id in (select id from listed) and i.target_drug_id in (select id from listed)"""
)
def tool_interactions(t):
    """Interactions among the first thirty drugs."""
    ids = [r[0] for r in t.sql("select concat('DB', c_custkey) from {customer} order by c_custkey limit 30").collect()]
    return _tools(t).check_drug_interactions(ids)


@query(
    oracle=f"""
    select smiles, found from ({ORACLES['drug_smiles']})
    where request_id = (select concat('customer ', cast(max(c_custkey) as varchar)) from customer)"""
)
def tool_smiles(t):
    """SMILES text of one drug."""
    return _tools(t).get_molecule_smiles(_one(t, "select c_name from {customer} order by c_custkey desc limit 1"))


@query(oracle=f"select term, count from ({ORACLES['adverse_topk']}) where substance = 'family 1'")
def tool_adverse(t):
    """Most reported reactions of one substance."""
    return _tools(t).get_adverse_events("Family 1")


@query(
    oracle="""
    with top as (
        select s.nct_id, s.brief_title as title, s.overall_status as status, s.last_update,
               row_number() over (order by s.last_update desc nulls last, s.nct_id) as rank
        from v_studies s where s.overall_status = 'RECRUITING'
          and lower(s.condition_name) like '%urgent%'
          and s.nct_id in (select nct_id from v_study_locations where country = 'NATION_19'))
    select distinct rank, top.nct_id, title, top.status, concat('https://clinicaltrials.gov/study/', top.nct_id) as url, l.city
    from top left join v_study_locations l on l.nct_id = top.nct_id and l.country = 'NATION_19' and l.status = 'RECRUITING'
    where rank <= 3"""
)
def tool_trials(t):
    """Latest recruiting studies of one condition, with their cities."""
    return _tools(t).find_clinical_trials(condition="Urgent", country=HOME)


@query(
    oracle=f"""
    select codice_aic, denominazione, classe_rimborsabilita, is_carente from ({_VIEW})
    where classe_rimborsabilita = 'H' and codice_aic <= (select max(p_partkey) / 2 from part)"""
)
def view_sql(t):
    """SQL with parameters over the unified view in the catalog."""
    parts = dict(zip(("farmaci_anagrafica", "classe_a", "classe_h", "farmaci_carenti"), _parts(t)))
    parts["farmaci_carenti"] = parts["farmaci_carenti"].withColumnRenamed(OWN_CLASS, "classe_di_rimborsabilità")
    register_view(parts)
    half = _one(t, "select max(p_partkey) / 2 from {part}")
    text = f"select codice_aic, denominazione, classe_rimborsabilita, is_carente from {VIEW} where classe_rimborsabilita = ? and codice_aic <= ?"
    return t.spark.sql(text, args=["H", half])


@query(oracle=f"select codice_aic, is_carente from ({_VIEW})")
def view_table(t):
    """The unified view read by its name."""
    tables.create_view(packs.unified_view(*_parts(t), class_column=OWN_CLASS), "pack_view")
    return tables.read_table(t.spark, "pack_view").select("codice_aic", "is_carente")


@query(oracle="select c_custkey as k, c_name as name from customer")
def sink_overwrite(t):
    """A relation that replaces an earlier one of the same name."""
    folder = scratch_path(t.spark, "replaced")
    for sql in ("select s_suppkey as k, s_name as name from {supplier}", "select c_custkey as k, c_name as name from {customer}"):
        tables.write_relations({"r": t.sql(sql)}, folder)
    return t.spark.read.parquet(f"{folder}/r.parquet")


@query(
    oracle="""
    select 'farmaci_anagrafica' as table_name, count(*) as n_rows from part where p_size < 50
    union all select 'farmaci_anagrafica_rejects', count(*) from part where p_size = 50"""
)
def build_rejects(t):
    """What the register build writes when one file has bad lines and the others are absent."""
    folder = scratch_path(t.spark, "register")
    written = build_register(t.spark, {"farmaci_anagrafica": _pack_file(t), "classe_a": f"{folder}/absent"}, folder)
    parts = [
        t.spark.read.parquet(f"{folder}/{n}.parquet").agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows")
        for n in written
    ]
    return parts[0].unionByName(parts[1])


@query(
    oracle="""
    select 0 as position, 'codice' as column_name, 'bigint' as data_type, count(*) as n_rows, count(*) as n_filled from customer
    union all select 1, 'nome', 'string', count(*), count(*) from customer
    union all select 2, 'saldo', 'double', count(*), count(*) from customer
    union all select 3, 'vuoto', 'string', count(*), 0 from customer"""
)
def profile_build(t):
    """The profile of a landed file: inferred types and filled values."""
    lines = t.sql("select concat_ws(';', c_custkey, c_name, c_acctbal, '') as line from {customer}")
    path = land(t, lines, ["codice;nome;saldo;vuoto"], "profilo")
    folder = scratch_path(t.spark, "profile")
    build_profile(t.spark, {"clienti": path}, folder)
    return t.spark.read.parquet(f"{folder}/profile.parquet").drop("file")


@query(
    oracle="""
    select concat('c ', lpad(cast(c_custkey as varchar), 9, '0'), ' ', c_name) as value from customer order by c_custkey limit 50"""
)
def text_head(t):
    """The first fifty lines of a text file written in order by many tasks."""
    path = scratch_path(t.spark, "text")
    lines = t.sql("select c_custkey, concat('c ', lpad(cast(c_custkey as string), 9, '0'), ' ', c_name) as line from {customer}")
    lines.repartitionByRange("c_custkey").sortWithinPartitions("c_custkey").select("line").write.text(path)
    return delimited.text_head(t.spark, path, 50)


@query(
    oracle="""
    select cast(null as bigint) as codice_aic, cast(null as varchar) as nome, count(*) as n from region
    union all select null, 'Titolo', count(*) from region
    union all select c_custkey, c_name, 1 from customer"""
)
def src_csv_preamble_repeat(t):
    """Data lines that equal the lines above the header."""
    lines = t.sql(
        """select concat_ws(';', c_custkey, c_name) as line from {customer}
           union all select ';Titolo' from {region} union all select ';' from {region}"""
    )
    path = land(t, lines, [";Titolo", ";", "AIC;Nome"], "titoli")
    rows = delimited.clean_table(delimited.read_delimited(t.spark, path, Layout(preamble=2)).rows)
    return rows.groupBy("codice_aic", "nome").agg(F.count(F.lit(1)).alias("n"))


@query(
    oracle="""
    select c_custkey as codice_aic, c_name as nome, c_mktsegment as nota from customer
    union all select s_suppkey, s_name, 'fornitore' from supplier"""
)
def src_csv_header_order(t):
    """Files of one folder with the same columns in another order."""
    folders = [
        land(t, t.sql(sql), [head], folder, everywhere=True)
        for folder, head, sql in (
            ("a", "AIC;Nome;Nota", "select concat_ws(';', c_custkey, c_name, c_mktsegment) as line from {customer}"),
            ("b", "Nota;AIC;Nome", "select concat_ws(';', 'fornitore', s_suppkey, s_name) as line from {supplier}"),
        )
    ]
    landed = delimited.read_delimited(t.spark, folders)
    return delimited.clean_table(landed.rows)


@query(oracle='select c_custkey as codice_aic, c_name as "_nome_", c_acctbal::varchar as "prezzo_(€)" from customer')
def clean_headers_plain(t):
    """The older rule for header names."""
    lines = t.sql("select concat_ws(';', c_custkey, c_name, c_acctbal) as line from {customer}")
    path = land(t, lines, [" AIC;_Nome_;Prezzo (€)"], "vecchi")
    landed = delimited.read_delimited(t.spark, path, Layout(charset="UTF-8"))
    return delimited.clean_table(landed.rows, TableSpec(plain_headers=True))


def _rule_sql(model: str, oracle: str) -> str:
    columns = quality.REQUIRED[model]
    return " union all ".join(
        f"select '{model}' as model, '{c} present' as rule, count({c}) as n_pass, count(*) - count({c}) as n_fail from ({oracle})" for c in columns
    )


_STUDY_RULES = "select nct_id, brief_title as title, overall_status as status, concat('u', nct_id) as url from v_studies"


@query(
    oracle=" union all ".join(
        [
            _rule_sql("drug", "select * from drugs"),
            _rule_sql("interaction", ORACLES["drug_interactions"]),
            _rule_sql("equivalent", "select codice_aic, farmaco as denominazione_farmaco, ditta as azienda from v_farmaci_equivalenti"),
            _rule_sql("study", _STUDY_RULES),
        ]
    )
)
def result_rules(t):
    """Required fields of the results of every kind."""


    offers = t.view("v_farmaci_equivalenti").select(
        "codice_aic", F.col("farmaco").alias("denominazione_farmaco"), F.col("ditta").alias("azienda")
    )
    studies = _studies(t).select(
        "nct_id", trials.study_title(F.col("brief_title")).alias("title"), F.col("overall_status").alias("status"), trials.study_url(F.col("nct_id")).alias("url")
    )
    return quality.check_results(
        {
            "drug": t.drugs,
            "interaction": drugs.interactions_among(t.view("r_drug_lists"), t.interactions, t.drugs),
            "equivalent": offers,
            "study": studies,
        }
    )


@query(oracle=f"select * from ({ORACLES['ingredient_counts']})")
def ingredient_counts_ordered(t):
    """Packs by their number of ingredients."""
    return quality.most_ingredients_first(quality.ingredient_counts(t.view("v_principi_attivi")))


_STORED = "farmaci_anagrafica principi_attivi farmaci_equivalenti classe_a classe_h farmaci_carenti".split()


def _database(t) -> str:
    """A database of its own with the register and the drug relations as tables over stored files."""
    folder = scratch_path(t.spark, "tables")
    relations = {n: t.view(f"v_{n}") for n in _STORED}
    relations |= {"drugs": t.drugs, "interactions": t.interactions, "synonyms": t.synonyms, "atc_codes": t.atc_codes}
    tables.write_relations(relations, folder)
    name = f"pharma_{folder[-12:]}"
    t.spark.sql(f"create database `{name}` location '{folder}/database'")
    catalog.register_relations(t.spark, name, {n: f"{folder}/{n}.parquet" for n in relations})
    catalog.create_register_view(t.spark, name, class_column=OWN_CLASS)
    return name


@query(oracle=_VIEW)
def view_permanent(t):
    """The unified view as the catalog keeps it, read from a second session."""
    return sibling(t.spark).table(f"{_database(t)}.{catalog.VIEW}")


@query(
    oracle=f"""
    select 'status' as question, name as request, stato_generale as a, null::varchar as b, n_attive as n, n_carenti as m from (
        select nome_ricercato as name, count(*) filter (where not is_carente) as n_attive, count(*) filter (where is_carente) as n_carenti,
               case when bool_and(is_carente) then 'Ritirato / Non Disponibile'
                    when bool_or(is_carente) then 'Parzialmente Carente (alcune confezioni disponibili, altre no)' else 'Disponibile' end as stato_generale
        from ({_FOUND}) group by nome_ricercato)
    union all
    select 'generics', name, denominazione_farmaco, azienda, codice_aic, cast(round(prezzo_pubblico * 100) as bigint) from ({ORACLES['pack_generics']})
    union all
    select 'interactions', n_name, source_drug_id, target_drug_id, null, null from nation join interactions
        on source_drug_id in (concat('DB', n_nationkey), concat('DB', n_nationkey + 1), concat('DB', n_nationkey + 2))
        and target_drug_id in (concat('DB', n_nationkey), concat('DB', n_nationkey + 1), concat('DB', n_nationkey + 2))
        join drugs x on x.drugbank_id = source_drug_id join drugs y on y.drugbank_id = target_drug_id"""
)
def tool_sql(t):
    """Status, generics and interactions as table functions in SQL, for whole tables of questions."""
    name = _database(t)
    catalog.create_functions(t.spark, name)
    # Table functions are called by their plain names, so the database is the current one of a session of its own.
    session = sibling(t.spark)
    session.sql(f"use `{name}`")
    brands = t.view("r_brands").select("name")
    lists = t.sql("select n_name, array(concat('DB', n_nationkey), concat('DB', n_nationkey + 1), concat('DB', n_nationkey + 2)) as ids from {nation}")
    for df, asked in ((brands, "brands"), (lists, "lists")):
        path = scratch_path(t.spark, asked)
        df.write.parquet(path)
        session.read.parquet(path).createOrReplaceTempView(asked)
    return session.sql(
        """select 'status' as question, b.name as request, s.stato_generale as a, cast(null as string) as b, s.n_attive as n, s.n_carenti as m
           from brands b, lateral drug_status(b.name) s
           union all
           select 'generics', b.name, g.denominazione_farmaco, g.azienda, g.codice_aic, cast(round(g.prezzo_pubblico * 100) as bigint)
           from brands b, lateral drug_generics(b.name) g
           union all
           select 'interactions', l.n_name, i.source_drug_id, i.target_drug_id, cast(null as bigint), cast(null as bigint)
           from lists l, lateral drug_interactions(l.ids) i"""
    )


@query(
    oracle="""
    select relation, kind, count(*) as n_columns from (values
        ('drugs', 'EXTERNAL', 5), ('interactions', 'EXTERNAL', 3), ('synonyms', 'EXTERNAL', 2), ('atc_codes', 'EXTERNAL', 2), ('classe_a', 'EXTERNAL', 1),
        ('classe_h', 'EXTERNAL', 1), ('farmaci_anagrafica', 'EXTERNAL', 4), ('farmaci_carenti', 'EXTERNAL', 4), ('farmaci_equivalenti', 'EXTERNAL', 5),
        ('principi_attivi', 'EXTERNAL', 4), ('farmaci_completi', 'VIEW', 8)) v(relation, kind, n), range(1, 9) r(k) where k <= n group by relation, kind"""
)
def catalog_listing(t):
    """Tables and views of a database with the number of their columns."""
    return catalog.listing(t.spark, _database(t)).groupBy("relation", "kind").agg(F.count(F.lit(1)).alias("n_columns"))


@query(
    oracle="""
    select 1 as generation, 'v_farmaci_anagrafica' as relation, count(*) as n_rows from part
    union all select 1, 'v_classe_a', count(*) from part where p_size <= 15
    union all select 2, 'v_farmaci_anagrafica', count(*) from part where p_size > 10
    union all select 2, 'v_classe_a', count(*) from part where p_size between 11 and 15"""
)
def build_atomic(t):
    """What readers see of a build after the next one broke off half-way, and after one that ended."""
    root = scratch_path(t.spark, "generations")
    first = {n: t.view(n) for n in ("v_farmaci_anagrafica", "v_classe_a")}
    generations.build(t.spark, root, first)
    torn = {**first, "v_classe_a": first["v_classe_a"].withColumn("torn", F.expr("raise_error(cast(codice_aic as string))"))}
    try:
        generations.build(t.spark, root, torn)
    except PySparkException:
        pass
    seen = [(1, generations.read(t.spark, root))]
    kept = t.table("part").filter("p_size > 10").select(F.col("p_partkey").alias("codice_aic"))
    generations.build(t.spark, root, {n: df.join(kept, "codice_aic", "left_semi") for n, df in first.items()})
    seen.append((2, generations.read(t.spark, root)))
    parts = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(k).alias("generation"), F.lit(n).alias("relation"), "n_rows")
        for k, relations in seen
        for n, df in relations.items()
    ]
    return reduce(DataFrame.unionByName, parts)


@query(oracle=_VIEW)
def pack_unified_stored(t):
    """The unified view over tables in buckets of the pack key, joined bucket by bucket."""
    folder = scratch_path(t.spark, "buckets")
    name = f"buckets_{folder[-12:]}"
    t.spark.sql(f"create database `{name}` location '{folder}'")
    parts = ("farmaci_anagrafica", "classe_a", "classe_h", "farmaci_carenti")
    tables.write_bucketed({n: t.view(f"v_{n}") for n in parts}, name, dict.fromkeys(parts, "codice_aic"), 16)
    return packs.unified_view(*[t.spark.table(f"{name}.{n}") for n in parts], class_column=OWN_CLASS, colocated=True)
