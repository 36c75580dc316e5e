"""Drug records of one large nested XML document as four relations.

The text reader cuts the document at the start of each record, wherever its splits fall,
so parsing runs in as many tasks as the document has splits. Records keep their nested
``drug`` elements, which carry no attributes and so are no cut points. Where records carry none either, the document is
cut at every ``drug`` element and the pieces of a record are put together by the depth they stand at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pharmalith.functions.text import present
from pharmalith.operators.drugs import dedup_drugs
from pharmalith.session import through_storage
from pharmalith.sources import spanning
from pharmalith.sources.xml_repair import repaired

START, END = "<drug ", "</drug>"
ANY_START = "<drug"
NESTED_PATHS = ("pathways.pathway.drugs.drug",)
SMILES = "SMILES"

_IDS = "`drugbank-id` array<struct<_VALUE: string, _primary: string>>"
_FIELDS = (
    f"_type string, {_IDS}, name string, state string, "
    "`calculated-properties` struct<property: array<struct<kind: string, value: string>>>, "
    "`drug-interactions` struct<`drug-interaction`: array<struct<`drugbank-id`: array<string>, description: string>>>, "
    "synonyms struct<synonym: array<struct<_VALUE: string>>>, "
    "`atc-codes` struct<`atc-code`: array<struct<_code: string>>>"
)
_NESTED = f"struct<{_IDS}, name string>"
_BAD = "_bad"
_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD, "ignoreSurroundingSpaces": "false"}


def record_schema(nested_paths: tuple[str, ...] = NESTED_PATHS) -> str:
    """Schema of a record, with the places where nested drugs may stand.

    On a path, the element before the last and every second one before it repeat as in
    ``pathways.pathway.drugs.drug``: containers are single, their items are lists.
    """
    extra = []
    for path in nested_paths:
        steps = path.split(".")
        kind = f"array<{_NESTED}>"
        for depth in range(len(steps) - 1, 0, -1):
            kind = f"struct<`{steps[depth]}`: {kind}>"
            if depth % 2 == 0:
                kind = f"array<{kind}>"
        extra.append(f"`{steps[0]}` {kind}")
    return ", ".join([_FIELDS, *extra, f"{_BAD} string"])


@dataclass(frozen=True)
class DrugRecords:
    """Parsed records, and the text of those that are not well-formed: with ``damage``, what is wrong, and ``recovered``, whether
    their sound elements are among the records."""

    records: DataFrame
    rejects: DataFrame
    nested_paths: tuple[str, ...] = NESTED_PATHS


def read_records(
    spark: SparkSession, path: str, nested_paths: tuple[str, ...] = NESTED_PATHS, stored: bool = True, recover: bool = False
) -> DrugRecords:
    """Parse the document once; with ``stored`` the parsed records go through the shared
    folder, so that the relations read only their own columns.

    With ``recover`` the sound elements of a damaged record are kept, else it is left out whole.
    """
    schema = record_schema(nested_paths)
    texts = _attributed(spark, path) if _has_attributes(spark, path) else _nested(spark, path)
    parsed = texts.select(F.from_xml("text", schema, _OPTIONS).alias("d")).select("d.*")
    if stored:
        parsed = through_storage(parsed, "drug-records")
    good = parsed.filter(F.col(_BAD).isNull()).drop(_BAD)
    bad = parsed.filter(F.col(_BAD).isNotNull())
    if not recover:
        rejects = bad.select(F.col(_BAD).alias("record"), F.lit(None).cast("string").alias("damage"), F.lit(False).alias("recovered"))
        return DrugRecords(good, rejects, nested_paths)
    again = repaired(bad, _BAD).withColumn("d", F.from_xml("fixed", schema, _OPTIONS))
    # Few beside the records; written once, as records and rejects both read them.
    again = through_storage(again.select("record", "damage", "d"), "recovered")
    sound = F.col(f"d.{_BAD}").isNull()
    good = good.unionByName(again.filter(sound).select("d.*").drop(_BAD))
    return DrugRecords(good, again.select("record", "damage", sound.alias("recovered")), nested_paths)


def _up_to_end(start: str, value: Column) -> Column:
    """A record without what follows its last end tag."""
    tail = F.when(F.contains(value, F.lit(END)), F.length(F.substring_index(value, END, -1))).otherwise(0)
    return F.concat(F.lit(start), F.left(value, F.length(value) - tail)).alias("text")


def _attributed(spark: SparkSession, path: str) -> DataFrame:
    """Records whose tags carry attributes, which nested drugs do not."""
    pieces = spark.read.option("lineSep", START).text(path)
    return pieces.filter(F.contains("value", F.lit(END))).select(_up_to_end(START, F.col("value")))


def _nested(spark: SparkSession, path: str) -> DataFrame:
    """Records of any tags: a drug element is a record if no other is open where it begins."""
    value = F.col("value")
    pieces = spark.read.option("lineSep", ANY_START).text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("place"),
        value.alias("line"),
        # The rest of the tag; names that go on, such as that of the root, open no drug.
        value.rlike(r"^(?:\s[^<>]*)?>").alias("opens"),
        value.rlike(r"^(?:\s[^<>]*)?/>").alias("empty"),
        F.regexp_count(value, F.lit(r"</drug\s*>")).alias("closes"),
    )
    opened = F.when(F.col("opens") & ~F.col("empty"), 1).otherwise(0)
    is_drug = (F.col("opens") | F.col("empty")).cast("bigint")
    changed = pieces.select("file", "start", "place", "line", (opened - F.col("closes")).cast("bigint").alias("a"), is_drug.alias("b"))
    return spanning.joined(changed, spanning.DEPTH, ANY_START).select(_up_to_end(ANY_START, F.col("line")))


def _has_attributes(spark: SparkSession, path: str) -> bool:
    """Whether record tags carry attributes; reads up to the first one."""
    tags = spark.read.option("lineSep", ">").text(path)
    return not tags.filter(F.contains("value", F.lit(START))).isEmpty()


def _first_text(values: Column) -> Column:
    return F.try_element_at(values, F.lit(1))


def _drug_id(ids: Column) -> Column:
    """The primary id; without one, the first id. An empty id counts as missing."""
    primary = _first_text(F.filter(ids, lambda i: i._primary == "true"))
    return F.coalesce(F.nullif(primary._VALUE, F.lit("")), F.nullif(_first_text(ids)._VALUE, F.lit("")))


def _smiles(properties: Column) -> Column:
    return _first_text(F.filter(properties, lambda p: (p.kind == SMILES) & present(p.value))).value


def _known(records: DataFrame) -> DataFrame:
    """Records with id and name."""
    named = records.withColumn("drugbank_id", _drug_id(F.col("drugbank-id")))
    return named.filter(present(F.col("drugbank_id")) & present(F.col("name")))


def drug_rows(parsed: DrugRecords) -> DataFrame:
    """One row per record and per nested drug element, before dedup."""
    rows = _known(parsed.records).select(
        "drugbank_id",
        "name",
        F.col("_type").alias("type"),
        "state",
        _smiles(F.col("calculated-properties.property")).alias("smiles"),
    )
    nothing = F.lit(None).cast("string")
    for path in parsed.nested_paths:
        nested = parsed.records
        steps = path.split(".")
        at = F.col(f"`{steps[0]}`")
        for depth, step in enumerate(steps[1:], start=1):
            at = at.getField(step)
            if depth % 2 == 1:
                nested = nested.select(F.explode(at).alias("_at"))
                at = F.col("_at")
        stubs = _known(nested.select("_at.*"))
        rows = rows.unionByName(
            stubs.select("drugbank_id", "name", nothing.alias("type"), nothing.alias("state"), nothing.alias("smiles"))
        )
    return rows


def interaction_rows(parsed: DrugRecords) -> DataFrame:
    items = _known(parsed.records).select(
        "drugbank_id", F.explode(F.col("drug-interactions").getField("drug-interaction")).alias("i")
    )
    return items.select(
        F.col("drugbank_id").alias("source_drug_id"),
        _first_text(F.col("i").getField("drugbank-id")).alias("target_drug_id"),
        F.col("i.description").alias("description"),
    )


def synonym_rows(parsed: DrugRecords) -> DataFrame:
    items = _known(parsed.records).select("drugbank_id", F.explode("synonyms.synonym").alias("s"))
    return items.select("drugbank_id", F.col("s._VALUE").alias("synonym")).filter(present(F.col("synonym")))


def atc_rows(parsed: DrugRecords) -> DataFrame:
    items = _known(parsed.records).select(
        "drugbank_id", F.explode(F.col("atc-codes").getField("atc-code")).alias("a")
    )
    return items.select("drugbank_id", F.col("a._code").alias("atc_code")).filter(present(F.col("atc_code")))


def drug_relations(parsed: DrugRecords) -> dict[str, DataFrame]:
    """The four relations, free of duplicates."""
    return {
        "drugs": dedup_drugs(drug_rows(parsed)),
        "interactions": interaction_rows(parsed).distinct(),
        "synonyms": synonym_rows(parsed).distinct(),
        "atc_codes": atc_rows(parsed).distinct(),
    }
