"""Relations, the unified view and the lookups in the catalog, for users of SQL.

``register_relations`` makes tables of stored Parquet folders, ``create_register_view`` a permanent view over them by its SQL
text, ``create_functions`` the lookups as table functions, so that a table of questions is answered by a lateral join:

    select r.request_id, s.* from requests r, lateral pharma.drug_status(r.name) s

A search for part of a text is an equality of grams there too, so a table of questions does not meet every row of the register.

All of it lives in the catalog of the session: other sessions of the application see it; beyond the application it needs a
lasting metastore.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pharmalith.operators.matching import GRAM_SIZES
from pharmalith.schemas import CLASS_A, CLASS_DEFAULT, CLASS_H, PLACEHOLDER_INGREDIENT, STATUS_AVAILABLE, STATUS_PARTIAL, STATUS_WITHDRAWN

VIEW = "farmaci_completi"
# Rows a repeated list entry makes at a time.
_CHUNK = 4096


def register_relations(spark: SparkSession, database: str, folders: Mapping[str, str]) -> None:
    """A table over each Parquet folder; a table of that name is replaced."""
    spark.sql(f"create database if not exists `{database}`")
    for name, folder in folders.items():
        spark.sql(f"drop table if exists `{database}`.`{name}`")
        spark.catalog.createTable(f"{database}.{name}", path=folder, source="parquet")


def _literal(text: str) -> str:
    return "'" + text.replace("'", "\\'") + "'"


def view_sql(spark: SparkSession, database: str, class_column: str = "classe_di_rimborsabilità") -> str:
    """SQL of the unified view over the tables of a database; lists that are not there count as empty."""
    have = {t.name for t in spark.catalog.listTables(database)}
    packs = f"`{database}`.farmaci_anagrafica"
    listed = [
        f"select codice_aic, '{tag}' as list from `{database}`.{name}" if name in have else f"select cast(null as bigint), '{tag}' as list where false"
        for tag, name in (("a", "classe_a"), ("h", "classe_h"))
    ]
    columns = ", ".join(f"f.`{c}`" for c in spark.table(f"{database}.farmaci_anagrafica").columns)
    nothing = "false as is_carente, cast(null as string) as own, cast(null as string) as data_inizio_carenza, cast(null as string) as motivazioni_carenza"
    found = f"select p.*, {nothing} from {packs} p"
    if "farmaci_carenti" in have:
        # An inner and an anti join, as only an inner join is split on both sides where a pack is short very often.
        found = f"""select p.*, true as is_carente, s.`{class_column}` as own, s.data_inizio as data_inizio_carenza,
                           s.motivazioni as motivazioni_carenza
                    from {packs} p join `{database}`.farmaci_carenti s on p.codice_aic = s.codice_aic
                    union all {found} left anti join `{database}`.farmaci_carenti s on p.codice_aic = s.codice_aic"""
    return f"""
        with listed as (
            select codice_aic, count_if(list = 'a') as in_a, count_if(list = 'h') as in_h
            from ({' union all '.join(listed)}) where codice_aic is not null group by codice_aic),
        found as ({found}),
        f as (select found.*, coalesce(in_a, 0) as in_a, coalesce(in_h, 0) as in_h, greatest(coalesce(in_a, 0), 1) * greatest(coalesce(in_h, 0), 1) as copies
              from found left join listed on found.codice_aic = listed.codice_aic),
        b as (select f.*, explode(sequence(0, (copies - 1) div {_CHUNK})) as block from f)
        select {columns},
               case when in_a > 0 then '{CLASS_A}' when in_h > 0 then '{CLASS_H}' else coalesce(own, '{CLASS_DEFAULT}') end as classe_rimborsabilita,
               is_carente, data_inizio_carenza, motivazioni_carenza
        from b f lateral view explode(sequence(1, least({_CHUNK}, copies - block * {_CHUNK}))) as copy"""


def create_register_view(spark: SparkSession, database: str, **options) -> None:
    """The unified view, kept by the catalog with its SQL text; it shows what its tables hold when it is read."""
    spark.sql(f"create or replace view `{database}`.{VIEW} as {view_sql(spark, database, **options)}")


def _part_of(text: str, term: str) -> str:
    """``text`` holds ``term`` in any letter case; ``%`` and ``_`` are wildcards and nothing escapes them."""
    return f"lower({text}) like concat('%', replace(lower({term}), '\\u0001', '\\u0001\\u0001'), '%') escape '\\u0001'"


def _grams(text: str, sizes: str) -> str:
    """Hashes of the distinct substrings of these sizes; cut from the array of characters, which takes time linear in the text."""
    cut = "transform(sequence(1, size(c) - n + 1), i -> xxhash64(array_join(slice(c, i, n), '')))"
    of_size = f"case when n = 0 then array(xxhash64('')) when size(c) >= n then {cut} else cast(array() as array<bigint>) end"
    chars = f"array(regexp_extract_all({text}, '(?s).', 0))"
    return f"array_distinct(flatten(transform({chars}, c -> flatten(transform({sizes}, n -> {of_size})))))"


def _matches(terms: str, table: str, column: str) -> str:
    """SQL of the pairs ``term, text`` of the rows ``term`` of a query and the distinct texts of a column that hold them.

    As in ``matching``: a term is looked up by the rarest gram of its longest piece, and the candidates are verified. Texts travel as
    hashes until then. Only inner joins on equality, so a lateral join with a table of questions keeps them.
    """
    sizes = f"array({', '.join(map(str, GRAM_SIZES))})"
    texts = f"select distinct {column} as text from {table} where {column} is not null"
    held = f"select xxhash64(text) as id, explode({_grams('lower(text)', sizes)}) as gram from ({texts})"
    piece = "array_max(transform(split(lower(term), '[%_]'), p -> struct(length(p) as n, p as piece))).piece"
    fitting = f"array(array_max(filter({sizes}, n -> n <= length(piece))))"
    asked = f"select term, explode({_grams('piece', fitting)}) as gram from (select term, {piece} as piece from ({terms}))"
    return f"""
        select found.term, known.text
        from (select distinct rarest.term, held.id
              from (select asked.term, min(struct(many.n as n, asked.gram as gram)).gram as gram
                    from ({asked}) asked join (select gram, count(*) as n from ({held}) group by gram) many on asked.gram = many.gram
                    group by asked.term) rarest
              join ({held}) held on held.gram = rarest.gram) found
        join (select text, xxhash64(text) as id from ({texts})) known on known.id = found.id
        where {_part_of('known.text', 'found.term')}"""


def function_sql(database: str) -> dict[str, str]:
    """Head and body of each table function."""
    d = f"`{database}`"
    known = f"principio_attivo is not null and principio_attivo <> '' and lower(principio_attivo) <> '{PLACEHOLDER_INGREDIENT}'"
    # The predicates on the names come twice: one name that is asked for is filtered as the packs are read.
    cercato = f"""
        select coalesce(own, query) as term
        from (select min(named.own) as own
              from ({_matches('select query as term', f'{d}.farmaci_anagrafica', 'denominazione')}) found
              join (select p.denominazione, min(i.principio_attivo) as own
                    from {d}.farmaci_anagrafica p join {d}.principi_attivi i on p.codice_aic = i.codice_aic
                    where {known} group by p.denominazione) named on named.denominazione = found.text
              where {_part_of('named.denominazione', 'query')})"""
    info = "drugbank_id string, name string, type string, state string"
    return {
        "drug_status": f"""(nome string) returns table (n_attive bigint, n_carenti bigint, stato_generale string)
            return select n_attive, n_carenti,
                   case when n_attive = 0 then {_literal(STATUS_WITHDRAWN)} when n_carenti > 0 then {_literal(STATUS_PARTIAL)}
                        else {_literal(STATUS_AVAILABLE)} end
            from (select sum(named.n_attive) as n_attive, sum(named.n_carenti) as n_carenti
                  from ({_matches('select nome as term', f'{d}.farmaci_anagrafica', 'denominazione')}) found
                  join (select denominazione, count_if(not is_carente) as n_attive, count_if(is_carente) as n_carenti
                        from {d}.{VIEW} group by denominazione) named on named.denominazione = found.text
                  where {_part_of('named.denominazione', 'nome')}) where n_attive + n_carenti > 0""",
        "drug_generics": f"""(query string) returns table (codice_aic bigint, denominazione_farmaco string, azienda string, prezzo_pubblico double)
            return select e.codice_aic, e.farmaco, e.ditta, e.prezzo_riferimento_ssn
            from ({_matches(cercato, f'{d}.farmaci_equivalenti', 'principio_attivo')}) named
            join {d}.farmaci_equivalenti e on e.principio_attivo = named.text""",
        "pack_ingredients": f"""(aic bigint) returns table (principio_attivo string, quantita double, unita_misura string)
            return select principio_attivo, quantita, unita_misura from {d}.principi_attivi where codice_aic = aic""",
        "drug_interactions": f"""(ids array<string>) returns table (source_drug_id string, source_name string, target_drug_id string, target_name string, description string)
            return select i.source_drug_id, a.name, i.target_drug_id, b.name, i.description
            from (select listed, explode(array_distinct(listed)) as id from (select ids as listed) where size(listed) >= 2) l
            join {d}.interactions i on i.source_drug_id = l.id and array_contains(l.listed, i.target_drug_id)
            join {d}.drugs a on a.drugbank_id = i.source_drug_id join {d}.drugs b on b.drugbank_id = i.target_drug_id""",
        "drug_by_atc": f"""(code string) returns table ({info})
            return select g.drugbank_id, g.name, g.type, g.state
            from (select min(drugbank_id) as id from {d}.atc_codes where atc_code = upper(code)) c join {d}.drugs g on g.drugbank_id = c.id""",
        "drug_resolve": f"""(term string) returns table ({info})
            return select g.drugbank_id, g.name, g.type, g.state
            from (select coalesce(min(syn), min(own)) as id from (
                      select drugbank_id as syn, cast(null as string) as own from {d}.synonyms where lower(synonym) = lower(term)
                      union all select null, drugbank_id from {d}.drugs where lower(name) = lower(term))) c
            join {d}.drugs g on g.drugbank_id = c.id""",
    }


def create_functions(spark: SparkSession, database: str, names: list[str] | None = None) -> list[str]:
    """The lookups whose tables are there, as table functions of the database; their names."""
    have = {t.name for t in spark.catalog.listTables(database)}
    needs = {
        "drug_status": {VIEW, "farmaci_anagrafica"}, "drug_generics": {"farmaci_anagrafica", "principi_attivi", "farmaci_equivalenti"}, "pack_ingredients": {"principi_attivi"},
        "drug_interactions": {"interactions", "drugs"}, "drug_by_atc": {"atc_codes", "drugs"}, "drug_resolve": {"synonyms", "drugs"},
    }
    made = [n for n in function_sql(database) if needs[n] <= have and (names is None or n in names)]
    for name in made:
        spark.sql(f"drop function if exists `{database}`.{name}")
        spark.sql(f"create function `{database}`.{name} {function_sql(database)[name]}")
    return made


def listing(spark: SparkSession, database: str) -> DataFrame:
    """One row per column of every table and view of a database: ``relation, kind, position, column, type``."""
    rows = [
        (t.name, t.tableType, k, c.name, c.dataType)
        for t in spark.catalog.listTables(database)
        if not t.isTemporary
        for k, c in enumerate(spark.catalog.listColumns(f"{database}.{t.name}"))
    ]
    found = spark.createDataFrame(rows, "relation string, kind string, position bigint, column string, type string")
    return found.orderBy("relation", F.col("position"))
