"""Clinical studies over four relations: studies, sites, conditions, interventions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pharmalith.functions.text import present
from pharmalith.operators.matching import match_contains
from pharmalith.schemas import (
    COUNTRY,
    NO_CITY,
    NO_SITE_STATUS,
    NO_STUDY_STATUS,
    NO_TITLE,
    RECRUITING,
    STUDY_URL,
)
from pharmalith.session import through_storage

STUDY = "nct_id"


def study_title(brief: Column, *official: Column) -> Column:
    return F.coalesce(F.nullif(brief, F.lit("")), *[F.nullif(c, F.lit("")) for c in official], F.lit(NO_TITLE))


def study_url(nct_id: Column) -> Column:
    return F.concat(F.lit(STUDY_URL), nct_id)


def _pairs(terms: DataFrame, values: DataFrame, match: str) -> DataFrame:
    """(term, value) of distinct terms and values where the value contains, or with ``exact`` equals, the term.

    Stored: every question that names the term reads it from here.
    """
    terms, values = terms.toDF("term").distinct(), values.toDF("value").distinct()
    if match == "contains":
        found = match_contains(terms, "term", values, "value")
    else:
        found = terms.join(values, F.lower("term") == F.lower("value"))
    return through_storage(found, "term-pairs")


def matching_studies(
    requests: DataFrame,
    studies: DataFrame,
    conditions: DataFrame,
    interventions: DataFrame,
    sites: DataFrame | None = None,
    country: str = COUNTRY,
    status: str | None = RECRUITING,
    match: str = "contains",
) -> DataFrame:
    """Distinct (request_id, nct_id) of studies a request asks for.

    A request names an ``intervention``, a ``condition`` or both; with both, a study must
    have both. A request with neither finds nothing. With ``sites``, a study needs a site
    in ``country``. Case-insensitive ``contains``, or ``exact`` equality.
    """
    if match not in ("contains", "exact"):
        raise ValueError(f"match is 'contains' or 'exact', not {match!r}")
    usable = through_storage(_usable(studies, sites, country, status), "usable-studies")
    # Each relation is read once and kept as distinct pairs of usable studies.
    treated = through_storage(
        interventions.select(STUDY, F.col("intervention").alias("value")).join(usable, STUDY, "left_semi").distinct(), "treated"
    )
    studied = through_storage(
        conditions.select(STUDY, F.col("condition").alias("value")).join(usable, STUDY, "left_semi").distinct(), "studied"
    )
    asked = requests.select(
        "request_id",
        F.nullif("intervention", F.lit("")).alias("_drug"),
        F.nullif("condition", F.lit("")).alias("_illness"),
    ).filter("_drug is not null or _illness is not null")
    drug_pairs = _pairs(asked.select("_drug").filter("_drug is not null"), treated.select("value"), match)
    illness_pairs = _pairs(asked.select("_illness").filter("_illness is not null"), studied.select("value"), match)
    by_drug = (
        asked.filter("_drug is not null")
        .join(drug_pairs.withColumnRenamed("term", "_drug"), "_drug")
        .join(treated, "value")
        .select("request_id", "_illness", STUDY)
        .distinct()
    )
    by_illness = (
        asked.filter("_drug is null")
        .join(illness_pairs.withColumnRenamed("term", "_illness"), "_illness")
        .join(studied, "value")
        .select("request_id", STUDY)
    )
    # The second half of a question for both is asked of the studies the first half found.
    both = (
        by_drug.filter("_illness is not null")
        .join(studied, STUDY)
        .join(illness_pairs.withColumnRenamed("term", "_illness"), ["_illness", "value"], "left_semi")
        .select("request_id", STUDY)
    )
    one = by_drug.filter("_illness is null").select("request_id", STUDY)
    return one.union(both).union(by_illness).distinct()


def _usable(studies: DataFrame, sites: DataFrame | None, country: str, status: str | None) -> DataFrame:
    """Ids of the studies that may be found."""
    usable = studies.filter(F.col(STUDY).isNotNull())
    if status is not None:
        usable = usable.filter(F.col("overall_status") == status)
    usable = usable.select(STUDY)
    if sites is not None:
        usable = usable.join(sites.filter(F.col("country") == country).select(STUDY), STUDY, "left_semi")
    return usable.distinct()


def _bits_of_terms(terms: DataFrame, relation: DataFrame, numbered: DataFrame, match: str) -> DataFrame:
    """``term, block, bits``: the studies that have a value a term asks for, as bits of blocks of study numbers.

    Studies are gathered per value, of the values some term asks for, and then per term; pairs of terms and studies are never made.
    """
    pairs = _pairs(terms, relation.select("value"), match)
    held = relation.join(pairs.select("value").distinct(), "value", "left_semi").join(numbered, STUDY)
    blocks = held.groupBy("value", F.bitmap_bucket_number("number").alias("block")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits")
    )
    return pairs.join(blocks, "value").groupBy("term", "block").agg(F.bitmap_or_agg("bits").alias("bits"))


def count_studies(
    requests: DataFrame,
    studies: DataFrame,
    conditions: DataFrame,
    interventions: DataFrame,
    sites: DataFrame | None = None,
    country: str = COUNTRY,
    status: str | None = RECRUITING,
    match: str = "contains",
) -> DataFrame:
    """``request_id, n_studies``: how many studies ``matching_studies`` finds, zero included. ``request_id`` must be unique.

    Counted from sets of study numbers per term; a question for both takes what the two sets share.
    """
    if match not in ("contains", "exact"):
        raise ValueError(f"match is 'contains' or 'exact', not {match!r}")
    usable = _usable(studies, sites, country, status)
    numbered = through_storage(usable.withColumn("number", F.monotonically_increasing_id()), "numbered-studies")
    asked = requests.select("request_id", F.nullif("intervention", F.lit("")).alias("_drug"), F.nullif("condition", F.lit("")).alias("_illness"))
    asked = asked.filter("_drug is not null or _illness is not null")
    sides = []
    for column, relation, value in (("_drug", interventions, "intervention"), ("_illness", conditions, "condition")):
        named = relation.select(STUDY, F.col(value).alias("value"))
        bits = _bits_of_terms(asked.filter(F.col(column).isNotNull()).select(column), named, numbered, match)
        both = F.col("_drug").isNotNull() & F.col("_illness").isNotNull()
        sides.append(asked.withColumn("_both", both).join(bits.withColumnRenamed("term", column), column).select("request_id", "_both", "block", "bits"))
    found = sides[0].unionByName(sides[1]).groupBy("request_id", "_both", "block").agg(
        F.count(F.lit(1)).alias("n"), F.bitmap_count(F.bitmap_and_agg("bits")).alias("n_studies")
    )
    # A block of a question for both counts if both sides have it.
    counted = found.filter("not _both or n = 2").groupBy("request_id").agg(F.sum("n_studies").alias("n_studies"))
    return requests.join(counted, "request_id", "left").select("request_id", F.coalesce("n_studies", F.lit(0)).alias("n_studies"))


def latest(hits: DataFrame, studies: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` most recently updated studies of each request, with their details."""
    described = studies.select(
        STUDY,
        "last_update",
        study_title(F.col("brief_title"), *[F.col(c) for c in ("official_title",) if c in studies.columns]).alias(
            "title"
        ),
        F.coalesce("overall_status", F.lit(NO_STUDY_STATUS)).alias("status"),
        study_url(F.col(STUDY)).alias("url"),
    )
    newest = Window.partitionBy("request_id").orderBy(F.col("last_update").desc_nulls_last(), STUDY)
    dated = hits.join(studies.select(STUDY, "last_update"), STUDY)
    top = dated.withColumn("rank", F.row_number().over(newest).cast("bigint")).filter(F.col("rank") <= n)
    return top.select("request_id", STUDY, "rank").join(described, STUDY).select(
        "request_id", "rank", STUDY, "title", "status", "url", "last_update"
    )


def recruiting_cities(hits: DataFrame, sites: DataFrame, country: str = COUNTRY) -> DataFrame:
    """Distinct cities with a recruiting site per study, in long form."""
    open_sites = sites.filter(
        (F.col("country") == country) & (F.col("status") == RECRUITING) & present(F.col("city"))
    ).select(STUDY, "city")
    wanted = hits.select(STUDY).distinct()
    cities = open_sites.join(wanted, STUDY, "left_semi").distinct()
    return hits.select("request_id", STUDY).join(cities, STUDY).select("request_id", STUDY, "city")


def site_status(studies: DataFrame, sites: DataFrame, country: str = COUNTRY) -> DataFrame:
    """Sites in the country per study and site status."""
    local = sites.filter(F.col("country") == country).select(
        STUDY, F.coalesce("status", F.lit(NO_SITE_STATUS)).alias("site_status")
    )
    counted = local.groupBy(STUDY, "site_status").agg(F.count(F.lit(1)).alias("n_sites"))
    return counted.join(studies.select(STUDY).distinct(), STUDY, "left_semi")


def site_status_text(studies: DataFrame, sites: DataFrame, country: str = COUNTRY) -> DataFrame:
    """One line per study such as ``3 COMPLETED, 1 RECRUITING``, sorted by status; empty with 0 sites
    for a study without a site in the country.

    Only counts per status reach a group, and a register knows a handful of statuses.
    """
    pairs = F.array_sort(F.collect_list(F.struct("site_status", "n_sites")))
    line = F.array_join(F.transform(pairs, lambda p: F.concat_ws(" ", p.n_sites, p.site_status)), ", ")
    lines = site_status(studies, sites, country).groupBy(STUDY).agg(F.sum("n_sites").alias("n_sites"), line.alias("summary"))
    known = studies.filter(F.col(STUDY).isNotNull()).select(STUDY).distinct()
    return known.join(lines, STUDY, "left").select(
        STUDY, F.coalesce("n_sites", F.lit(0)).alias("n_sites"), F.coalesce("summary", F.lit("")).alias("summary")
    )


def status_cities(studies: DataFrame, sites: DataFrame, country: str = COUNTRY) -> DataFrame:
    """Distinct recruiting cities per study; a site without a city shows the fallback text."""
    open_sites = sites.filter((F.col("country") == country) & (F.col("status") == RECRUITING)).select(
        STUDY, F.coalesce("city", F.lit(NO_CITY)).alias("city")
    )
    return open_sites.join(studies.select(STUDY), STUDY, "left_semi").distinct()


def total_studies(requests: DataFrame, hits: DataFrame) -> DataFrame:
    """Number of studies per request, zero included."""
    counted = hits.groupBy("request_id").agg(F.count(F.lit(1)).alias("n_studies"))
    return requests.join(counted, "request_id", "left").select(
        "request_id", F.coalesce("n_studies", F.lit(0)).alias("n_studies")
    )
