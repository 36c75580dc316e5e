"""Drug operators on hand-made edge cases."""

import pytest

from pharmalith.operators import drugs
from tests.conftest import rows


@pytest.fixture(scope="module")
def base(spark):
    return {
        "drugs": spark.createDataFrame(
            [("DB1", "Acetylsalicylic acid", "small molecule", "solid", "CC"), ("DB2", "Aspirin", "biotech", None, ""),
             ("DB3", "Nameless", None, None, None), ("DB4", "NAMELESS", None, None, "N")],
            "drugbank_id string, name string, type string, state string, smiles string",
        ),
        "synonyms": spark.createDataFrame(
            [("DB1", "ASPIRIN"), ("DB9", "Ghost"), ("DB3", "Many"), ("DB1", "many"), ("DB2", None)],
            "drugbank_id string, synonym string",
        ),
    }


def test_dedup_prefers_typed_records(spark):
    raw = spark.createDataFrame(
        [("A", "stub", None, None, None), ("A", "full", "biotech", None, "C"), ("A", "other", "small molecule", "s", None),
         ("B", "stub b", None, None, None), ("B", "stub b", None, None, None)],
        "drugbank_id string, name string, type string, state string, smiles string",
    )
    assert rows(drugs.dedup_drugs(raw)) == [
        ("A", "other", "small molecule", "s", None),
        ("B", "stub b", None, None, None),
    ]


def resolve(spark, base, name, **options):
    asked = spark.createDataFrame([(1, name)], "request_id int, query string")
    got = drugs.resolve(asked, base["drugs"], base["synonyms"], **options)
    return [r.drugbank_id for r in got.collect()]


@pytest.mark.parametrize(
    "name, by_synonym, by_name, synonym_only",
    [
        ("aspirin", ["DB1"], ["DB2"], ["DB1"]),
        ("ghost", [], [], []),
        ("many", ["DB1"], ["DB1"], ["DB1"]),
        ("nameless", ["DB3"], ["DB3"], []),
        ("unknown", [], [], []),
        (None, [], [], []),
    ],
)
def test_resolution_order(spark, base, name, by_synonym, by_name, synonym_only):
    assert resolve(spark, base, name) == by_synonym
    assert resolve(spark, base, name, priority="name") == by_name
    assert resolve(spark, base, name, priority="synonym_only") == synonym_only


def test_a_synonym_without_drug_blocks_the_name(spark, base):
    more = base["synonyms"].union(spark.createDataFrame([("DB8", "nameless")], "drugbank_id string, synonym string"))
    asked = spark.createDataFrame([(1, "Nameless")], "request_id int, query string")
    assert drugs.resolve(asked, base["drugs"], more).count() == 0
    assert drugs.resolve(asked, base["drugs"], more, priority="name").count() == 1


def test_code_lookup_upper_cases_the_request_only(spark, base):
    codes = spark.createDataFrame(
        [("DB2", "B01"), ("DB1", "B01"), ("DB3", "b02"), ("DB9", "C01")], "drugbank_id string, atc_code string"
    )
    asked = spark.createDataFrame([(1, "b01"), (2, "b02"), (3, "C01")], "request_id int, query string")
    assert rows(drugs.by_atc(asked, base["drugs"], codes), "request_id", "drugbank_id") == [(1, "DB1")]


def test_smiles_has_a_flag(spark, base):
    asked = spark.createDataFrame(
        [(1, "acetylsalicylic ACID"), (2, "aspirin"), (3, "nameless"), (4, "no")], "request_id int, query string"
    )
    assert rows(drugs.smiles_of(asked, base["drugs"]), "request_id", "smiles", "found") == [
        (1, "CC", True), (2, None, False), (3, None, False), (4, None, False),
    ]


def test_interactions_need_both_ends_in_one_list(spark, base):
    edges = spark.createDataFrame(
        [("DB1", "DB2", "a"), ("DB2", "DB1", "b"), ("DB1", "DB9", "c"), ("DB3", "DB4", "d"), ("DB1", "DB1", "e")],
        "source_drug_id string, target_drug_id string, description string",
    )
    lists = spark.createDataFrame(
        [(1, ["DB1", "DB2"]), (2, ["DB1"]), (3, ["DB1", "DB9"]), (4, ["DB1", "DB3"]), (5, ["DB1", "DB1"]), (6, [])],
        "request_id int, drug_ids array<string>",
    )
    got = drugs.interactions_among(drugs.list_requests(lists), edges, base["drugs"])
    assert rows(got, "request_id", "description") == [
        (1, "a"), (1, "b"), (1, "e"), (3, "e"), (4, "e"), (5, "e"),
    ]
    assert drugs.interactions_of_list(["DB1"], edges, base["drugs"]).count() == 0
    assert rows(drugs.interactions_of_list(["DB1", "DB2"], edges, base["drugs"]), "description", "target_name") == [
        ("a", "Aspirin"), ("b", "Acetylsalicylic acid"), ("e", "Acetylsalicylic acid"),
    ]


def test_bridge_and_its_counts_agree(spark, base):
    codes = spark.createDataFrame([("DB1", "B01"), ("DB2", "B01"), ("DB9", "B01")], "drugbank_id string, atc_code string")
    packs = spark.createDataFrame(
        [("B01", "X"), ("B01", "X"), ("B01", "Y"), (None, "Z"), ("C01", "W")], "codice_atc string, denominazione string"
    )
    bridge = drugs.atc_bridge(codes, base["drugs"], packs)
    assert bridge.count() == 4
    counts = drugs.atc_bridge_counts(codes, base["drugs"], packs)
    assert rows(counts) == [("B01", 2, 2, 4)]
