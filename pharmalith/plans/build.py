"""The two batch builds: register files to tables and view, drug document to relations."""

from __future__ import annotations

import logging
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pharmalith.operators.packs import unified_view
from pharmalith.operators.quality import head_rows, profile_columns
from pharmalith.sources.delimited import Layout, exists, read_delimited, read_register
from pharmalith.sources.drug_xml import NESTED_PATHS, drug_relations, read_records
from pharmalith.sources.generations import Generation, publish, read, staged
from pharmalith.sources.tables import create_view, write_relations

VIEW = "farmaci_completi"
REJECTS = "_rejects"

log = logging.getLogger(__name__)


def register_view(tables: Mapping[str, DataFrame], name: str = VIEW) -> DataFrame:
    """The unified view over the tables that are there."""
    view = unified_view(
        tables["farmaci_anagrafica"], tables.get("classe_a"), tables.get("classe_h"), tables.get("farmaci_carenti")
    )
    return create_view(view, name)


def build_register(
    spark: SparkSession, paths: Mapping[str, str], folder: str, database: str | None = None
) -> dict[str, int]:
    """Load all delivered files, replace the tables and the view; rows written per table.

    Rejected lines go to ``<table>_rejects``, with their file and number of fields; a table that lost lines is logged.
    """
    register = read_register(spark, paths)
    counts = write_relations(register.tables, folder, database)
    rejected = write_relations({f"{n}{REJECTS}": df for n, df in register.rejects.items()}, folder)
    _warn(rejected)
    counts |= rejected
    stored = {n: spark.read.parquet(f"{folder.rstrip('/')}/{n}.parquet") for n in register.tables}
    if "farmaci_anagrafica" in stored:
        register_view(stored)
    return counts


def rebuild_register(spark: SparkSession, paths: Mapping[str, str], root: str, view: bool = True) -> Generation:
    """The same build as a generation below ``root``: readers see all of it once it is done, and the build before it until then."""
    name, folder = staged(root)
    register = read_register(spark, paths)
    counts = write_relations(register.tables, folder)
    rejected = write_relations({f"{n}{REJECTS}": df for n, df in register.rejects.items()}, folder)
    _warn(rejected)
    done = publish(spark, root, name, counts | rejected)
    if view and "farmaci_anagrafica" in counts:
        register_view(read(spark, root, list(counts), done.number))
    return done


def rebuild_drugs(spark: SparkSession, path: str, root: str, nested_paths: tuple[str, ...] = NESTED_PATHS) -> Generation:
    """The drug relations as a generation below ``root``."""
    name, folder = staged(root)
    return publish(spark, root, name, build_drugs(spark, path, folder, nested_paths))


def _warn(rejected: Mapping[str, int]) -> None:
    for name, n in rejected.items():
        if n:
            log.warning("%s: %d lines left out", name, n)


def build_profile(
    spark: SparkSession, paths: Mapping[str, str], folder: str, layout: Layout = Layout(threshold=None)
) -> dict[str, int]:
    """Profile every delivered file as it is, before cleaning: columns with their types (``profile``) and first rows (``head``);
    rows written."""
    landed = {name: read_delimited(spark, path, layout).rows for name, path in paths.items() if exists(spark, path)}
    profiles = [profile_columns(df, infer=True).select(F.lit(name).alias("file"), "*") for name, df in landed.items()]
    heads = [head_rows(df).select(F.lit(name).alias("file"), "*") for name, df in landed.items()]
    return write_relations({"profile": reduce(DataFrame.union, profiles), "head": reduce(DataFrame.union, heads)}, folder)


def build_drugs(
    spark: SparkSession, path: str, folder: str, nested_paths: tuple[str, ...] = NESTED_PATHS
) -> dict[str, int]:
    """Parse the drug document and replace its four relations; rows written per relation.

    Malformed records go to ``records_rejects``; their sound elements are kept, as ``recovered`` says there.
    """
    parsed = read_records(spark, path, nested_paths, recover=True)
    counts = write_relations(drug_relations(parsed), folder)
    rejected = write_relations({f"records{REJECTS}": parsed.rejects}, folder)
    _warn(rejected)
    return counts | rejected
