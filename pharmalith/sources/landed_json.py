"""Landed JSON pages of clinical studies and adverse-event reports.

A file holds one document per line: a page with many entries, or a single entry. With
``multi_line`` a file is one pretty-printed document. No page goes without a trace: each is counted with what it held, and the
text of damaged and error pages is kept.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pharmalith.session import through_storage

_PROTOCOL = (
    "struct<identificationModule: struct<nctId: string, briefTitle: string, officialTitle: string>, "
    "officialTitle: string, "
    "statusModule: struct<overallStatus: string, lastUpdatePostDateStruct: struct<date: string>>, "
    "contactsLocationsModule: struct<locations: array<struct<city: string, country: string, status: string>>>, "
    "conditionsModule: struct<conditions: array<string>>, "
    "armsInterventionsModule: struct<interventions: array<struct<name: string>>>>"
)
_STUDIES = f"studies array<struct<protocolSection: {_PROTOCOL}>>, protocolSection {_PROTOCOL}"

_PATIENT = (
    "struct<drug: array<struct<activesubstance: struct<activesubstancename: string>>>, "
    "reaction: array<struct<reactionmeddrapt: string>>>"
)
_REPORTS = (
    f"results array<struct<safetyreportid: string, patient: {_PATIENT}>>, "
    f"safetyreportid string, patient {_PATIENT}"
)


_BAD = "_bad"

# What a page held: entries, entries beside damage, damage only, an error message, nothing.
ROWS, PARTIAL, DAMAGED, ERROR, EMPTY = "rows", "partial", "damaged", "error", "empty"


@dataclass(frozen=True)
class Studies:
    """Studies and the lists inside them, as relations that share ``nct_id``; the pages they come from (``file, state,
    n_entries``) and the text of those that are damaged or an error (``file, state, page``)."""

    studies: DataFrame
    sites: DataFrame
    conditions: DataFrame
    interventions: DataFrame
    pages: DataFrame | None = None
    rejects: DataFrame | None = None


@dataclass(frozen=True)
class Reports:
    """Reports with their substances and reaction terms, and the pages as in ``Studies``."""

    reports: DataFrame
    pages: DataFrame
    rejects: DataFrame


def _read_pages(spark: SparkSession, path, schema: str, single: Column, entries: str, multi_line: bool, name: str) -> DataFrame:
    """One row per page: ``file``, ``entries``, ``state``, and ``page``, the text of a damaged page or an error message.

    Parsed once into the shared folder; every relation then reads only what it shows.
    """
    reader = spark.read.schema(f"{schema}, error string, {_BAD} string").option("multiLine", multi_line)
    docs = reader.option("columnNameOfCorruptRecord", _BAD).json(path)
    found = F.filter(F.coalesce(F.col(entries), single), lambda e: e.isNotNull())
    some = F.coalesce(F.size(found) > 0, F.lit(False))
    bad = F.col(_BAD).isNotNull()
    state = (
        F.when(bad & some, PARTIAL).when(bad, DAMAGED).when(F.col("error").isNotNull() & ~some, ERROR).when(some, ROWS).otherwise(EMPTY)
    )
    pages = docs.select(
        F.col("_metadata.file_path").alias("file"), found.alias("entries"), state.alias("state"), F.coalesce(_BAD, "error").alias("page")
    )
    return through_storage(pages, name)


def _pages(stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pages with their number of entries, and those that are not whole."""
    pages = stored.select("file", "state", F.coalesce(F.size("entries"), F.lit(0)).cast("bigint").alias("n_entries"))
    return pages, stored.filter(F.col("state").isin(PARTIAL, DAMAGED, ERROR)).select("file", "state", "page")


def read_studies(spark: SparkSession, path, multi_line: bool = False) -> Studies:
    """Studies of landed pages. A page that is no JSON, or not of the expected form, is a reject; entries of it that can be
    read are kept."""
    single = F.when(F.col("protocolSection").isNotNull(), F.array(F.struct("protocolSection")))
    stored = _read_pages(spark, path, _STUDIES, single, "studies", multi_line, "study-pages")
    p = stored.select(F.explode("entries").alias("s")).select(F.col("s.protocolSection").alias("p"))
    nct_id = F.col("p.identificationModule.nctId").alias("nct_id")
    sites = p.select(nct_id, F.explode("p.contactsLocationsModule.locations").alias("l")).filter("l is not null")
    return Studies(
        p.select(
            nct_id,
            F.col("p.identificationModule.briefTitle").alias("brief_title"),
            # The title stands in the identification module or, in odd documents, above it.
            F.coalesce("p.identificationModule.officialTitle", "p.officialTitle").alias("official_title"),
            F.col("p.statusModule.overallStatus").alias("overall_status"),
            F.col("p.statusModule.lastUpdatePostDateStruct.date").alias("last_update"),
        ),
        sites.select("nct_id", "l.city", "l.country", "l.status"),
        p.select(nct_id, F.explode("p.conditionsModule.conditions").alias("condition")),
        p.select(nct_id, F.explode("p.armsInterventionsModule.interventions.name").alias("intervention")),
        *_pages(stored),
    )


def read_report_pages(spark: SparkSession, path, multi_line: bool = False) -> Reports:
    """Reports of landed pages; an error page and a damaged page are rejects."""
    single = F.when(F.col("patient").isNotNull(), F.array(F.struct("safetyreportid", "patient")))
    stored = _read_pages(spark, path, _REPORTS, single, "results", multi_line, "report-pages")
    r = stored.select(F.explode("entries").alias("r"))
    reports = r.select(
        F.col("r.safetyreportid").alias("report_id"),
        F.array_compact(F.col("r.patient.drug.activesubstance.activesubstancename")).alias("substances"),
        F.array_compact(F.col("r.patient.reaction.reactionmeddrapt")).alias("reactions"),
    )
    return Reports(reports, *_pages(stored))


def read_reports(spark: SparkSession, path, multi_line: bool = False) -> DataFrame:
    """The reports alone."""
    return read_report_pages(spark, path, multi_line).reports
