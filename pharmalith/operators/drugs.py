"""Drug relations: dedup, name and code resolution, interactions, cross-source bridge."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pharmalith.functions.text import present
from pharmalith.session import through_storage

ID = "drugbank_id"
INFO = (ID, "name", "type", "state")


def dedup_drugs(raw: DataFrame) -> DataFrame:
    """The richest record of each drug id: typed records before stubs.

    Ties are settled by the other columns, so a rerun gives the same record. A maximum
    is combined before the shuffle, so a thousandfold stub costs one row per task.
    """
    order = F.struct("type", "smiles", "state", "name")
    best = raw.groupBy(ID).agg(F.max(order).alias("_best"))
    return best.select(ID, "_best.name", "_best.type", "_best.state", "_best.smiles")


def _first_id(df: DataFrame, key: Column) -> DataFrame:
    """Smallest drug id per key."""
    return df.filter(key.isNotNull()).groupBy(key.alias("_key")).agg(F.min(ID).alias("_id"))


def resolve(
    requests: DataFrame, drugs: DataFrame, synonyms: DataFrame, term: str = "query", priority: str = "synonym"
) -> DataFrame:
    """Drug record for a name, matched in any letter case.

    ``priority`` says where to look first. ``synonym``: the drug name is only tried when
    there is no such synonym, even if the synonym leads to a missing drug. ``name``: the
    other way round. ``synonym_only``: drug names are not tried. Requests without a drug
    are left out.
    """
    if priority not in ("synonym", "name", "synonym_only"):
        raise ValueError(f"unknown priority {priority!r}")
    nothing = F.lit(None).cast("string")
    known = synonyms.select(F.lower("synonym").alias("_key"), F.col(ID).alias("_syn"), nothing.alias("_name"))
    if priority != "synonym_only":
        known = known.union(drugs.select(F.lower("name"), nothing, ID))
    wanted = requests.select(F.lower(term).alias("_key")).filter("_key is not null").distinct()
    # Only names someone asked for are grouped.
    hits = (
        known.join(wanted, "_key", "left_semi")
        .groupBy("_key")
        .agg(F.min("_syn").alias("_syn"), F.min("_name").alias("_name"))
    )
    first, second = ("_name", "_syn") if priority == "name" else ("_syn", "_name")
    found = hits.select("_key", F.coalesce(first, second).alias(ID)).join(drugs.select(*INFO), ID)
    return requests.withColumn("_key", F.lower(term)).join(found, "_key").select(*requests.columns, *INFO)


def by_atc(requests: DataFrame, drugs: DataFrame, atc_codes: DataFrame, term: str = "query") -> DataFrame:
    """Drug record for an ATC code; the request is upper-cased, the stored code is not."""
    wanted = requests.select(F.upper(term).alias("_key")).filter("_key is not null").distinct()
    codes = atc_codes.join(wanted, atc_codes.atc_code == wanted["_key"], "left_semi")
    found = _first_id(codes, F.col("atc_code")).withColumnRenamed("_id", ID).join(drugs.select(*INFO), ID)
    return requests.withColumn("_key", F.upper(term)).join(found, "_key").select(*requests.columns, *INFO)


def smiles_of(requests: DataFrame, drugs: DataFrame, term: str = "query") -> DataFrame:
    """SMILES text for a drug name (no synonyms); ``found`` is false without a usable one."""
    wanted = requests.select(F.lower(term).alias("_key")).filter("_key is not null").distinct()
    named = drugs.join(wanted, F.lower(drugs.name) == wanted["_key"], "left_semi")
    first = named.groupBy(F.lower("name").alias("_key")).agg(F.min(F.struct(ID, "smiles")).alias("_first"))
    usable = present(F.col("_first.smiles"))
    return (
        requests.withColumn("_key", F.lower(term))
        .join(first, "_key", "left")
        .select(
            *requests.columns,
            F.when(usable, F.col("_first.smiles")).alias("smiles"),
            F.coalesce(usable, F.lit(False)).alias("found"),
        )
    )


def list_requests(requests: DataFrame, ids: str = "drug_ids") -> DataFrame:
    """Long form ``(request_id, drugbank_id)`` of requests that carry a list of ids."""
    return requests.filter(F.size(ids) >= 2).select("request_id", F.explode(ids).alias(ID))


def interactions_among(requests: DataFrame, interactions: DataFrame, drugs: DataFrame) -> DataFrame:
    """Interactions whose two ends are both in the drug list of a request.

    ``requests`` is in long form, one row per listed id. A list of fewer than two entries
    has no result. Both ends must be known drugs; their names are added.
    """
    long_enough = (
        requests.groupBy("request_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n >= 2").select("request_id")
    )
    listed = (
        requests.select("request_id", ID).filter(f"{ID} is not null").distinct()
        .join(long_enough, "request_id", "left_semi")
    )
    source, target = "source_drug_id", "target_drug_id"
    ids = listed.select(ID).distinct()
    names = drugs.select(ID, "name")
    # Each interaction meets the lists of its source once; names join the few rows that are left. Finding the pairs first would group
    # all interactions a second time and sort them for the way back.
    asked = (
        interactions.select(source, target, "description")
        .join(ids.withColumnRenamed(ID, target), target, "left_semi")
        .join(listed.withColumnRenamed(ID, source), source)
        .join(listed.withColumnRenamed(ID, target), ["request_id", target], "left_semi")
    )
    named = asked.join(names.toDF(source, "source_name"), source).join(names.toDF(target, "target_name"), target)
    return named.select("request_id", source, "source_name", target, "target_name", "description")


def interactions_of_list(drug_ids: list[str], interactions: DataFrame, drugs: DataFrame) -> DataFrame:
    """Interactions within one short list of ids, filtered in the scan."""
    columns = ["source_drug_id", "source_name", "target_drug_id", "target_name", "description"]
    usable = len(drug_ids) >= 2
    edges = interactions.filter(
        F.col("source_drug_id").isin(drug_ids) & F.col("target_drug_id").isin(drug_ids)
        if usable
        else F.lit(False)
    )
    names = drugs.select(ID, "name")
    return (
        edges.join(names.toDF("source_drug_id", "source_name"), "source_drug_id")
        .join(names.toDF("target_drug_id", "target_name"), "target_drug_id")
        .select(*columns)
    )


def synonyms_like(synonyms: DataFrame, pattern: str) -> DataFrame:
    """Synonyms whose lower-case text matches a regular expression."""
    return synonyms.filter(F.lower("synonym").rlike(pattern))


def _named_packs(packs: DataFrame) -> DataFrame:
    return packs.filter("codice_atc is not null").select("codice_atc", "denominazione").distinct()


def _coded_drugs(atc_codes: DataFrame, drugs: DataFrame) -> DataFrame:
    return atc_codes.join(drugs.select(ID, "name"), ID).select("atc_code", "name", ID)


def atc_bridge(atc_codes: DataFrame, drugs: DataFrame, packs: DataFrame) -> DataFrame:
    """Register packs next to the drugs that share their ATC code (many to many)."""
    return _bridge(_coded_drugs(atc_codes, drugs), _named_packs(packs))


def _bridge(coded: DataFrame, named: DataFrame) -> DataFrame:
    # The names of the columns.
    return coded.join(named, coded.atc_code == named.codice_atc).select(
        "atc_code",
        F.col("denominazione").alias("nome_farmaco_aifa"),
        F.col("name").alias("principio_attivo_drugbank"),
    )


def drawn_numbers(total: int, n: int, seed: int) -> list[int]:
    """``n`` different numbers below ``total`` (all of them if there are no more), fixed by the seed.

    Number ``i`` is the md5 of ``seed:i``, its first 15 hex digits, modulo ``total``; repeats are passed over.
    """
    if total <= n:
        return list(range(total))
    found: list[int] = []
    i = 0
    while len(found) < n:
        k = int(hashlib.md5(f"{seed}:{i}".encode()).hexdigest()[:15], 16) % total
        if k not in found:
            found.append(k)
        i += 1
    return found


def atc_bridge_sample(atc_codes: DataFrame, drugs: DataFrame, packs: DataFrame, n: int = 5, seed: int = 0) -> DataFrame:
    """``n`` rows of the bridge, each with the same chance, the same ones on every run, without building it.

    The rows are numbered by code, then drug id, then pack; group sizes tell which code a drawn number falls
    into, and only the drugs and packs of the drawn codes are numbered.
    """
    coded, named = _coded_drugs(atc_codes, drugs), _named_packs(packs)
    # One row per code; read for the total and for the codes of the numbers.
    sizes = through_storage(
        atc_bridge_counts(atc_codes, drugs, packs).withColumn("_upto", F.sum("n_coppie").over(Window.orderBy("atc_code"))),
        "bridge-sizes",
    )
    total = sizes.agg(F.max("_upto")).first()[0] or 0
    numbers = drawn_numbers(total, n, seed)
    drawn = F.array(*map(F.lit, numbers)).cast("array<bigint>") if numbers else F.array().cast("array<bigint>")
    draws = drugs.sparkSession.range(1).select(F.explode(drawn).alias("_number"))
    picked = sizes.join(
        F.broadcast(draws), (F.col("_number") < F.col("_upto")) & (F.col("_number") >= F.col("_upto") - F.col("n_coppie"))
    ).select(
        F.col("atc_code").alias("_code"),
        F.expr("(_number - _upto + n_coppie) div n_confezioni").alias("_drug"),
        F.expr("(_number - _upto + n_coppie) % n_confezioni").alias("_pack"),
    )
    codes = F.broadcast(picked.select("_code").distinct())
    by_drug = Window.partitionBy("atc_code").orderBy(ID)
    by_pack = Window.partitionBy("codice_atc").orderBy(F.col("denominazione").asc_nulls_first())
    coded = coded.join(codes, F.col("atc_code") == F.col("_code"), "left_semi").withColumn("_i", F.row_number().over(by_drug) - 1)
    named = named.join(codes, F.col("codice_atc") == F.col("_code"), "left_semi").withColumn("_j", F.row_number().over(by_pack) - 1)
    return (
        coded.join(F.broadcast(picked), (F.col("atc_code") == F.col("_code")) & (F.col("_i") == F.col("_drug")))
        .join(named, (F.col("codice_atc") == F.col("_code")) & (F.col("_j") == F.col("_pack")))
        # The names of the bridge's columns.
        .select("atc_code", F.col("denominazione").alias("nome_farmaco_aifa"), F.col("name").alias("principio_attivo_drugbank"))
    )


def atc_bridge_counts(atc_codes: DataFrame, drugs: DataFrame, packs: DataFrame) -> DataFrame:
    """Size of the bridge per ATC code, multiplied from group sizes, not from pairs."""
    n_drugs = _coded_drugs(atc_codes, drugs).groupBy("atc_code").agg(F.count(F.lit(1)).alias("n_farmaci"))
    n_packs = (
        _named_packs(packs).groupBy(F.col("codice_atc").alias("atc_code")).agg(F.count(F.lit(1)).alias("n_confezioni"))
    )
    return n_drugs.join(n_packs, "atc_code").withColumn("n_coppie", F.col("n_farmaci") * F.col("n_confezioni"))
