"""Packs of the national register: unified view, status, ingredients and generics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pharmalith.functions.text import found_in, present
from pharmalith.operators.joins import left_join
from pharmalith.operators.matching import match_contains
from pharmalith.schemas import (
    CLASS_A,
    CLASS_DEFAULT,
    CLASS_H,
    LIST_AVAILABLE,
    LIST_INGREDIENTS,
    LIST_SHORT,
    PLACEHOLDER_INGREDIENT,
    SHORTAGES,
    STATUS_AVAILABLE,
    STATUS_PARTIAL,
    STATUS_WITHDRAWN,
)
from pharmalith.session import through_storage

KEY = "codice_aic"
# What a status tells of each of its packs.
PACK = (KEY, "denominazione_completa", "classe_rimborsabilita", "is_carente", "data_inizio_carenza", "motivazioni_carenza")
NARROW_ROWS = 100_000
# Keys of one question that are listed in a filter.
FEW_KEYS = 1000
_CHUNK = 4096


def unified_view(
    packs: DataFrame,
    class_a: DataFrame | None = None,
    class_h: DataFrame | None = None,
    shortages: DataFrame | None = None,
    class_column: str = "classe_di_rimborsabilità",
    dedupe_right: bool = False,
    colocated: bool = False,
) -> DataFrame:
    """Packs with reimbursement class and shortage status.

    A pack that is listed twice on the right comes out twice, as in a plain left join;
    ``dedupe_right`` keeps one class entry per pack instead. A table that is not there is
    passed as None. ``colocated``: all tables are stored in buckets of the pack key, so that every join is done bucket by bucket
    without a shuffle; a pack that is short very often then stays in the task of its bucket.
    """
    spark = packs.sparkSession
    if shortages is None:
        shortages = _no_rows(spark, SHORTAGES)
        class_column = "classe_di_rimborsabilità"
    if colocated:
        listed = packs.join(_counted(packs, class_a, "_in_a"), KEY, "left").join(_counted(packs, class_h, "_in_h"), KEY, "left")
        joined = _marked(listed.join(_entries(shortages, class_column), KEY, "left"))
    else:
        joined = _with_shortages(packs, shortages, class_column).join(_listings(packs, class_a, class_h), KEY, "left")
    in_a, in_h = (F.coalesce(F.col(n), F.lit(0)) for n in ("_in_a", "_in_h"))
    reimbursement = (
        F.when(in_a > 0, F.lit(CLASS_A))
        .when(in_h > 0, F.lit(CLASS_H))
        .otherwise(F.coalesce("_own_class", F.lit(CLASS_DEFAULT)))
    )
    view = joined.select(
        *packs.columns,
        reimbursement.alias("classe_rimborsabilita"),
        "is_carente",
        "data_inizio_carenza",
        "motivazioni_carenza",
        (F.greatest(in_a, F.lit(1)) * F.greatest(in_h, F.lit(1))).alias("_copies"),
    )
    if dedupe_right:
        return view.drop("_copies")
    return _repeat(view, "_copies")


def _no_rows(spark: SparkSession, schema: str) -> DataFrame:
    """An empty relation that the optimizer can see through."""
    columns = ", ".join(f"cast(null as {f.dataType.simpleString()}) as `{f.name}`" for f in StructType.fromDDL(schema))
    return spark.sql(f"select {columns} where false")


def _entries(shortages: DataFrame, class_column: str) -> DataFrame:
    return shortages.select(
        KEY,
        F.col(class_column).alias("_own_class"),
        F.lit(True).alias("is_carente"),
        F.col("data_inizio").alias("data_inizio_carenza"),
        F.col("motivazioni").alias("motivazioni_carenza"),
    )


def _marked(joined: DataFrame) -> DataFrame:
    return joined.withColumn("is_carente", F.coalesce("is_carente", F.lit(False)))


def _with_shortages(packs: DataFrame, shortages: DataFrame, class_column: str) -> DataFrame:
    """Packs with their shortage rows; one pack may own a third of all of these."""
    return _marked(left_join(packs, _entries(shortages, class_column), KEY))


def _counted(packs: DataFrame, listed: DataFrame | None, name: str) -> DataFrame:
    """How often each pack is on one list."""
    rows = _no_rows(packs.sparkSession, f"{KEY} bigint") if listed is None else listed
    return rows.filter(F.col(KEY).isNotNull()).groupBy(KEY).agg(F.count(F.lit(1)).alias(name))


def _listings(packs: DataFrame, class_a: DataFrame | None, class_h: DataFrame | None) -> DataFrame:
    """How often each pack is on the two class lists: one row per pack, one shuffle."""
    spark = packs.sparkSession
    empty = _no_rows(spark, f"{KEY} bigint")
    tagged = [
        (empty if df is None else df).select(KEY, F.lit(tag).alias("_list"))
        for tag, df in (("a", class_a), ("h", class_h))
    ]
    return (
        tagged[0]
        .union(tagged[1])
        .filter(F.col(KEY).isNotNull())
        .groupBy(KEY)
        .agg(F.count_if(F.col("_list") == "a").alias("_in_a"), F.count_if(F.col("_list") == "h").alias("_in_h"))
    )


def pack_copies(
    packs: DataFrame,
    class_a: DataFrame | None = None,
    class_h: DataFrame | None = None,
    shortages: DataFrame | None = None,
) -> DataFrame:
    """Rows of the packs with ``n``, how often each comes out of the unified view, from the sizes of the lists alone."""
    empty = _no_rows(packs.sparkSession, f"{KEY} bigint")
    short = (empty if shortages is None else shortages).filter(F.col(KEY).isNotNull()).groupBy(KEY).agg(F.count(F.lit(1)).alias("_short"))
    times = [F.greatest(F.coalesce(c, F.lit(0)), F.lit(1)) for c in ("_in_a", "_in_h", "_short")]
    joined = packs.join(_listings(packs, class_a, class_h), KEY, "left").join(short, KEY, "left")
    return joined.select(*packs.columns, (times[0] * times[1] * times[2]).alias("n"))


def _repeat(df: DataFrame, copies: str) -> DataFrame:
    """Emit each row as often as ``copies`` says, never holding more than short arrays."""
    columns = [c for c in df.columns if c != copies]
    blocks = F.sequence(F.lit(0).cast("bigint"), F.expr(f"({copies} - 1) div {_CHUNK}"))
    in_block = F.least(F.lit(_CHUNK), F.col(copies) - F.col("_block") * _CHUNK).cast("int")
    return (
        df.withColumn("_block", F.explode(blocks))
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), in_block)))
        .select(*columns)
    )


def search(requests: DataFrame, named: DataFrame, term: str = "name", ignore_case: bool = True) -> DataFrame:
    """Rows of a table whose ``denominazione`` contains the search term of a request."""
    return match_contains(requests, term, named, "denominazione", ignore_case=ignore_case)


def search_view(
    requests: DataFrame,
    packs: DataFrame,
    class_a: DataFrame | None = None,
    class_h: DataFrame | None = None,
    shortages: DataFrame | None = None,
    term: str = "name",
    ignore_case: bool = True,
    **view_options,
) -> DataFrame:
    """Rows of the unified view whose name contains the search term of a request.

    The name filter runs first, so the joins only see packs someone asked for.
    """
    # Stored, as the parts of the view each read it.
    found = through_storage(search(requests, packs, term, ignore_case), "packs-found")
    lists = _narrow([class_a, class_h, shortages], found)
    return unified_view(found, *lists, **view_options)


def status_packs(requests: DataFrame, packs: DataFrame, *lists: DataFrame | None, **options) -> DataFrame:
    """All packs found for each request, with class and shortage columns.

    Arguments as for ``search_view``. The list of a request stays in long form (one row
    per pack), as it has no size bound.
    """
    view = search_view(requests, packs, *lists, **options)
    return view.withColumnRenamed("denominazione", "denominazione_completa")


def status_of_name(
    name: str,
    packs: DataFrame,
    class_a: DataFrame | None = None,
    class_h: DataFrame | None = None,
    shortages: DataFrame | None = None,
    colocated: bool = False,
    **view_options,
) -> DataFrame:
    """The packs of one search term, for a single question: the term is part of the plan, so it is filtered as the packs are read,
    and nothing is counted or stored on the way. Columns as in ``status_packs`` without the request."""
    folded = F.lower(F.lit(name))
    found = packs.filter(found_in(F.lower("denominazione"), folded, F.lit("%" in name or "_" in name)))
    # A few keys are listed in the filters of the other tables, which spares their rows a shuffle; tables in buckets have none.
    keys = None if colocated else [r[0] for r in found.select(KEY).limit(FEW_KEYS + 1).collect()]
    if keys is not None and len(keys) <= FEW_KEYS:
        wanted = F.col(KEY).isin(sorted({k for k in keys if k is not None}))
        class_a, class_h, shortages = (None if t is None else t.filter(wanted) for t in (class_a, class_h, shortages))
    view = unified_view(found, class_a, class_h, shortages, colocated=colocated, **view_options)
    return view.withColumnRenamed("denominazione", "denominazione_completa")


def _narrow(tables: list[DataFrame | None], found: DataFrame) -> list[DataFrame | None]:
    """The tables cut down to the packs found, if these are few.

    ``found`` is stored, so its rows are counted from the file footers. Up to the bound
    its keys are broadcast and spare the tables a shuffle; beyond it, the joins that
    follow do the same work without this step.
    """
    if found.count() > NARROW_ROWS:
        return tables
    keys = F.broadcast(found.select(KEY).distinct())
    return [None if t is None else t.join(keys, KEY, "left_semi") for t in tables]


def status_label(available: Column, short: Column) -> Column:
    return (
        F.when((available == 0) & (short > 0), F.lit(STATUS_WITHDRAWN))
        .when((available > 0) & (short > 0), F.lit(STATUS_PARTIAL))
        .when(available > 0, F.lit(STATUS_AVAILABLE))
    )


def status_summary(found: DataFrame, request: list[str]) -> DataFrame:
    """One row per request with at least one pack: counts and the status text."""
    counted = found.groupBy(*request).agg(
        F.count_if(~F.col("is_carente")).alias("n_attive"),
        F.count_if(F.col("is_carente")).alias("n_carenti"),
    )
    return counted.withColumn("stato_generale", status_label(F.col("n_attive"), F.col("n_carenti")))


def known_ingredients(ingredients: DataFrame) -> DataFrame:
    """Ingredient rows with a real ingredient name."""
    name = F.col("principio_attivo")
    return ingredients.filter(present(name) & (F.lower(name) != PLACEHOLDER_INGREDIENT))


def status_ingredients(found: DataFrame, ingredients: DataFrame, request: list[str]) -> DataFrame:
    """Distinct ingredient names over all packs found for a request, in long form."""
    pairs = found.select(*request, KEY).distinct()
    names = known_ingredients(ingredients).select(KEY, "principio_attivo").distinct()
    return pairs.join(names, KEY).select(*request, "principio_attivo").distinct()


def status_answer(found: DataFrame, ingredients: DataFrame, request: list[str]) -> DataFrame:
    """The whole status of each request with at least one pack: counts, status text, packs and ingredient names.

    One row per entry of its lists, as these have no size bound: ``lista`` says which list, and every row carries the counts and the text
    of its request. A pack that comes out of the view more than once is listed as often, an ingredient name once.
    """
    # Stored, as the counts, the lists and the ingredients each read it.
    found = through_storage(found.select(*request, *PACK), "status-packs")
    listed = found.withColumn("lista", F.when(F.col("is_carente"), F.lit(LIST_SHORT)).otherwise(F.lit(LIST_AVAILABLE)))
    names = status_ingredients(found, ingredients, request).withColumn("lista", F.lit(LIST_INGREDIENTS))
    entries = listed.unionByName(names, allowMissingColumns=True)
    asked = [f"_{c}" for c in request]
    summary = status_summary(found, request).withColumnsRenamed(dict(zip(request, asked)))
    # Requests with a null id have a status too.
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(a)) for c, a in zip(request, asked)])
    return entries.join(summary, same).select(*request, "n_attive", "n_carenti", "stato_generale", "lista", *PACK, "principio_attivo")


def ingredients_of(requests: DataFrame, ingredients: DataFrame) -> DataFrame:
    """Ingredients, quantity and unit of each requested pack."""
    wanted = ingredients.select(KEY, "principio_attivo", "quantita", "unita_misura")
    return requests.join(wanted, KEY)


def ingredient_to_search(
    requests: DataFrame, packs: DataFrame, ingredients: DataFrame, term: str = "name"
) -> DataFrame:
    """Requests with ``cercato``: the first ingredient of the packs a term finds.

    A term that finds no pack with an ingredient is taken as an ingredient itself.
    ``request_id`` must be unique.
    """
    found = through_storage(
        match_contains(
            requests.select("request_id", term), term, packs.select(KEY, "denominazione"), "denominazione"
        ).select("request_id", KEY),
        "packs-found",
    )
    (own,) = _narrow([known_ingredients(ingredients)], found)
    first_of_pack = own.groupBy(KEY).agg(F.min("principio_attivo").alias("_first"))
    first = (
        found.select("request_id", KEY)
        .join(first_of_pack, KEY)
        .groupBy("request_id")
        .agg(F.min("_first").alias("_first"))
    )
    return requests.join(first, "request_id", "left").select(
        *requests.columns, F.coalesce("_first", F.col(term)).alias("cercato")
    )


def generics(
    requests: DataFrame,
    packs: DataFrame,
    ingredients: DataFrame,
    equivalents: DataFrame,
    term: str = "name",
) -> DataFrame:
    """Equivalent drugs for a brand or an ingredient, in no order; ``cheapest_first`` sorts the answer to one request."""
    # Stored, because the second search first counts its terms and then uses them.
    asked = through_storage(ingredient_to_search(requests, packs, ingredients, term), "ingredients-asked")
    offers = equivalents.select(
        KEY,
        F.col("farmaco").alias("denominazione_farmaco"),
        F.col("ditta").alias("azienda"),
        F.col("prezzo_riferimento_ssn").alias("prezzo_pubblico"),
        "principio_attivo",
    )
    return match_contains(asked, "cercato", offers, "principio_attivo").drop("principio_attivo")


def cheapest_first(offers: DataFrame) -> DataFrame:
    """Offers of one request by price, unknown prices last."""
    return offers.orderBy(F.col("prezzo_pubblico").asc_nulls_last(), KEY)
