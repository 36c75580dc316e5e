"""Data-quality jobs: ingredient and unit statistics, rules, reconciliation, profiles."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from pharmalith.functions.text import found_in, is_like_pattern
from pharmalith.operators.joins import left_join
from pharmalith.operators.matching import match_contains

KEY = "codice_aic"


def ingredient_counts(ingredients: DataFrame) -> DataFrame:
    """Named ingredients per pack."""
    return (
        ingredients.filter("principio_attivo is not null")
        .groupBy(KEY)
        .agg(F.count("principio_attivo").alias("num_principi_attivi"))
    )


def multi_ingredient_summary(ingredients: DataFrame) -> DataFrame:
    """Packs with ingredients, how many have several, their share and the largest number."""
    n = F.col("num_principi_attivi")
    totals = ingredient_counts(ingredients).agg(
        F.count(F.lit(1)).alias("n_packs"), F.count_if(n > 1).alias("n_multi"), F.max(F.when(n > 1, n)).alias("max_n")
    )
    share = F.try_divide(F.col("n_multi"), F.col("n_packs")) * 100
    return totals.select("n_packs", "n_multi", share.alias("pct_multi"), "max_n")


def multi_ingredient_top(ingredients: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` packs with the most ingredients, among packs with more than one."""
    counts = ingredient_counts(ingredients).filter("num_principi_attivi > 1")
    return counts.orderBy(F.desc("num_principi_attivi"), KEY).limit(n)


def most_ingredients_first(counts: DataFrame) -> DataFrame:
    """Packs by their number of ingredients, largest first."""
    return counts.orderBy(F.desc("num_principi_attivi"), KEY)


def unit_counts(ingredients: DataFrame) -> DataFrame:
    """Uses of each unit per ingredient, for units used more than once."""
    return (
        ingredients.filter("principio_attivo is not null and unita_misura is not null")
        .groupBy("principio_attivo", "unita_misura")
        .agg(F.count(F.lit(1)).alias("conteggio"))
        .filter("conteggio > 1")
    )


def unit_inconsistency(ingredients: DataFrame) -> DataFrame:
    """Unit counts of the ingredients that are written with more than one unit.

    The units of an ingredient are counted, never brought together in one group.
    """
    counts = unit_counts(ingredients)
    mixed = (
        counts.groupBy("principio_attivo").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("principio_attivo")
    )
    return counts.join(mixed, "principio_attivo", "left_semi")


def ordered_units(counts: DataFrame) -> DataFrame:
    return counts.orderBy("principio_attivo", F.desc("conteggio"), "unita_misura")


def require_columns(df: DataFrame, columns: Iterable[str], what: str) -> DataFrame:
    """Fail before the job runs when a column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks the columns {missing}")
    return df


def not_null(*columns: str) -> dict[str, Column]:
    """Rules that ask for a value in each column."""
    return {f"{c} present": F.col(c).isNotNull() for c in columns}


# The columns that every row of a result has to fill.
REQUIRED = {
    "pack": ("codice_aic", "denominazione_completa", "is_carente"),
    "status": ("nome_ricercato", "stato_generale"),
    "equivalent": ("codice_aic", "denominazione_farmaco", "azienda"),
    "drug": ("drugbank_id", "name"),
    "interaction": ("source_drug_id", "source_name", "target_drug_id", "target_name", "description"),
    "reaction": ("term", "count"),
    "study": ("nct_id", "title", "status", "url"),
}


def result_rules(model: str) -> dict[str, Column]:
    """The rules of one kind of result."""
    return not_null(*REQUIRED[model])


def check_results(results: Mapping[str, DataFrame]) -> DataFrame:
    """``model, rule, n_pass, n_fail`` of several results by the rules of their kinds."""
    parts = [
        check_rules(require_columns(df, REQUIRED[m], m), result_rules(m)).select(F.lit(m).alias("model"), "*") for m, df in results.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def check_rules(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rows that pass and fail each rule, counted in one pass."""
    passed = [F.count_if(rule).alias(f"_{i}") for i, rule in enumerate(rules.values())]
    totals = df.agg(F.count(F.lit(1)).alias("_n"), *passed)
    lines = F.array(
        *[
            F.struct(
                F.lit(name).alias("rule"),
                F.col(f"_{i}").alias("n_pass"),
                (F.col("_n") - F.col(f"_{i}")).alias("n_fail"),
            )
            for i, name in enumerate(rules)
        ]
    )
    return totals.select(F.inline(lines))


def rejects(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rows that break a rule, with the names of the broken rules."""
    broken = F.array_compact(
        F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()])
    )
    return df.withColumn("broken_rules", broken).filter(F.size("broken_rules") > 0)


def reconcile(source: DataFrame, loaded: DataFrame, key: str) -> DataFrame:
    """Each source row against the loaded rows of the same key.

    ``found`` tells whether the key was loaded, ``differs`` lists the columns that have
    another value. Rows without a key are left out.
    """
    columns = [c for c in source.columns if c != key and c in loaded.columns]
    ours = source.filter(F.col(key).isNotNull()).select(key, *[F.col(c).alias(f"source_{c}") for c in columns])
    theirs = loaded.select(key, *[F.col(c).alias(f"loaded_{c}") for c in columns], F.lit(True).alias("found"))
    joined = left_join(ours, theirs, key).withColumn("found", F.coalesce("found", F.lit(False)))
    other = [
        F.when(F.col("found") & ~F.col(f"source_{c}").eqNullSafe(F.col(f"loaded_{c}")), F.lit(c)) for c in columns
    ]
    return joined.withColumn("differs", F.concat_ws("|", *other))


def missing_keys(source: DataFrame, loaded: DataFrame, key: str) -> DataFrame:
    """Source keys that were not loaded."""
    return source.select(key).filter(F.col(key).isNotNull()).distinct().join(loaded.select(key), key, "left_anti")


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows in an order that depends only on the key and the seed."""
    ticket = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    return df.filter(F.col(key).isNotNull()).orderBy(ticket, *[F.col(c) for c in df.columns]).limit(n)


def _type_of(n: Column, counts: dict[str, Column]) -> Column:
    """Narrowest type that holds all values of a text column; ``string`` if none does or it has no value."""
    result = F.lit("string")
    for name, fitting in reversed(counts.items()):
        result = F.when((n > 0) & (fitting == n), F.lit(name)).otherwise(result)
    return result


def profile_columns(df: DataFrame, infer: bool = False) -> DataFrame:
    """Rows, filled values and type of each column, in one pass.

    ``infer``: text columns get the narrowest type that all their values can be read as.
    """
    kinds = ("bigint", "double", "date", "boolean")
    texts = [f.dataType.simpleString() == "string" for f in df.schema.fields]
    measures = [F.count(F.lit(1)).alias("_n")]
    for i, field in enumerate(df.schema.fields):
        c = F.col(f"`{field.name}`")
        measures.append(F.count(c).alias(f"_{i}"))
        if infer and texts[i]:
            measures += [F.count(F.trim(c).try_cast(k)).alias(f"_{i}_{k}") for k in kinds]
    totals = df.agg(*measures)

    def kind(i: int, field) -> Column:
        if infer and texts[i]:
            return _type_of(F.col(f"_{i}"), {k: F.col(f"_{i}_{k}") for k in kinds})
        return F.lit(field.dataType.simpleString())

    lines = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"),
                F.lit(field.name).alias("column_name"),
                kind(i, field).alias("data_type"),
                F.col("_n").alias("n_rows"),
                F.col(f"_{i}").alias("n_filled"),
            )
            for i, field in enumerate(df.schema.fields)
        ]
    )
    return totals.select(F.inline(lines))


def head_rows(df: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` rows as one JSON text each."""
    return df.limit(n).select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("row"))


def relation_counts(relations: Mapping[str, DataFrame]) -> DataFrame:
    """Row count of each relation."""
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("relation"), "n_rows") for n, df in relations.items()]
    result = parts[0]
    for part in parts[1:]:
        result = result.union(part)
    return result


def _texts(df: DataFrame, text: str, weight: str | None = None) -> DataFrame:
    """Distinct texts with the number of rows that carry them."""
    n = F.sum(weight) if weight else F.count(F.lit(1))
    return df.filter(F.col(text).isNotNull()).groupBy(F.col(text).alias("text")).agg(n.alias("n"))


def _equal_counts(requests: DataFrame, names: DataFrame, alias: str) -> DataFrame:
    totals = names.groupBy(F.lower("text").alias("_key")).agg(F.sum("n").alias(alias))
    return requests.select("request_id", F.lower("query").alias("_key")).join(totals, "_key").select("request_id", alias)


def _ladder(requests: DataFrame, steps: list[DataFrame]) -> DataFrame:
    result = requests
    for step in steps:
        result = result.join(step, "request_id", "left")
    return result.na.fill(0, [c for c in result.columns if c not in requests.columns])


def _has(text: Column, term: Column) -> Column:
    return found_in(text, term, is_like_pattern(term))


def search_ladder(requests: DataFrame, view: DataFrame, fragment: int = 5, weight: str | None = None) -> DataFrame:
    """Why a brand search finds what it finds: rows per search strategy and request.

    Contains in any case, contains in the given case, contains the first ``fragment``
    characters, equality in any case. The fragment finds whatever the others find, so there is one search for it, and
    the others are counted among its pairs. ``weight``: a column that says how many rows a row of ``view`` stands for.
    """
    asked = requests.select("request_id", "query", F.substring("query", 1, fragment).alias("_start"))
    pairs = match_contains(asked, "_start", _texts(view, "denominazione", weight), "text")
    text, term = F.col("text"), F.col("query")
    same = F.lower(text) == F.lower(term)
    counts = pairs.groupBy("request_id").agg(
        *[
            F.sum(F.when(hit, F.col("n")).otherwise(0)).alias(name)
            for name, hit in (
                ("n_contains", _has(F.lower(text), F.lower(term))),
                ("n_contains_case", _has(text, term)),
                ("n_fragment", F.lit(True)),
                ("n_equal", same),
            )
        ]
    )
    return _ladder(requests, [counts])


def name_ladder(requests: DataFrame, drugs: DataFrame, synonyms: DataFrame) -> DataFrame:
    """The same for drug names: equal name, equal synonym, part of a synonym.

    An equal synonym also has the term as a part, so one search serves both.
    """
    pairs = match_contains(requests.select("request_id", "query"), "query", _texts(synonyms, "synonym"), "text")
    same = F.lower("text") == F.lower("query")
    parts = pairs.groupBy("request_id").agg(
        F.sum(F.when(same, F.col("n")).otherwise(0)).alias("n_synonym"), F.sum("n").alias("n_synonym_part")
    )
    return _ladder(requests, [_equal_counts(requests, _texts(drugs, "name"), "n_name"), parts])


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """``df`` with a row count that is filled in by the write that consumes it."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("n_rows")), seen
