"""Stored relations: Parquet tables, views and their listing."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from pharmalith import schemas
from pharmalith.operators.quality import observed

# The relations of the drug document.
DRUG_RELATIONS = {
    "drugs": schemas.DRUGS,
    "interactions": schemas.INTERACTIONS,
    "synonyms": schemas.SYNONYMS,
    "atc_codes": schemas.ATC_CODES,
}


def write_relations(relations: Mapping[str, DataFrame], folder: str, database: str | None = None) -> dict[str, int]:
    """Replace each relation below ``folder`` and return the rows written.

    A relation without rows is written with its columns. With ``database``, the tables are
    also registered in the catalog.
    """
    counts = {}
    for name, df in relations.items():
        counted, seen = observed(df, name)
        writer = counted.write.mode("overwrite")
        path = f"{folder.rstrip('/')}/{name}.parquet"
        if database:
            writer.option("path", path).format("parquet").saveAsTable(f"{database}.{name}")
        else:
            writer.parquet(path)
        counts[name] = seen.get["n_rows"]
    return counts


def write_bucketed(relations: Mapping[str, DataFrame], database: str, keys: Mapping[str, str], buckets: int = 64) -> None:
    """Replace tables of a database, each in ``buckets`` of its key, sorted by it, with a bloom filter of the key per row group.

    Tables in the same number of buckets join on their keys without a shuffle, and a question for one key reads one bucket. Each
    bucket is written by one task: dealt by the same hash as the buckets, so a table has as many files as buckets.
    """
    for name, df in relations.items():
        key = keys[name]
        writer = df.repartition(buckets, key).write.mode("overwrite").format("parquet")
        bloom = {f"parquet.bloom.filter.enabled#{key}": "true"}
        writer.bucketBy(buckets, key).sortBy(key).options(**bloom).saveAsTable(f"{database}.{name}")


def read_drug_relations(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The four drug relations; a missing folder is an error at once."""
    return {
        name: spark.read.schema(schema).parquet(f"{folder.rstrip('/')}/{name}.parquet")
        for name, schema in DRUG_RELATIONS.items()
    }


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def create_view(df: DataFrame, name: str = "farmaci_completi") -> DataFrame:
    """Replace a view that later SQL can read."""
    df.createOrReplaceTempView(name)
    return df


def list_tables(spark: SparkSession, database: str | None = None) -> list[tuple[str, str]]:
    """Names and kinds of the tables and views in the catalog."""
    return [(t.name, t.tableType) for t in spark.catalog.listTables(database)]


def describe(df: DataFrame) -> list[tuple[str, str]]:
    """Columns and types of a table or view."""
    return df.dtypes
