"""Data-quality operators on hand-made edge cases."""

import pytest
from pyspark.sql import functions as F

from pharmalith.operators import quality
from tests.conftest import rows


def test_summary_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "codice_aic bigint, principio_attivo string, unita_misura string")
    assert quality.multi_ingredient_summary(empty).first() == (0, 0, None, None)


def test_unit_inconsistency_needs_two_frequent_units(spark):
    data = [("a", "mg")] * 2 + [("a", "g")] * 3 + [("b", "mg")] * 2 + [("b", "g")] + [("c", None)] * 4
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "codice_aic int, principio_attivo string, unita_misura string")
    assert rows(quality.unit_inconsistency(df)) == [("a", "g", 3), ("a", "mg", 2)]


def test_rules_and_rejects(spark):
    df = spark.createDataFrame([(1, "x"), (None, "y"), (3, None)], "a int, b string")
    rules = quality.not_null("a", "b")
    assert rows(quality.check_rules(df, rules)) == [("a present", 2, 1), ("b present", 2, 1)]
    assert quality.rejects(df, rules).select("broken_rules").count() == 2
    with pytest.raises(ValueError):
        quality.require_columns(df, ["azienda"], "the view")


def test_reconcile(spark):
    source = spark.createDataFrame([(1, "a", None), (2, "b", "x"), (3, "c", "y"), (None, "d", "z")], "k int, v string, w string")
    loaded = spark.createDataFrame([(1, "a", None), (2, "B", None), (2, "b", "x")], "k int, v string, w string")
    assert rows(quality.reconcile(source, loaded, "k"), "k", "found", "differs", "loaded_v") == [
        (1, True, "", "a"), (2, True, "", "b"), (2, True, "v|w", "B"), (3, False, "", None),
    ]
    assert rows(quality.missing_keys(source, loaded, "k")) == [(3,)]


def test_offers_of_every_size_are_reconciled(spark, tmp_path):
    from pharmalith.plans import catalog

    parts = [(k, "red pen", "brand", "SMALL", size) for k, size in ((1, 1), (2, 20), (3, 50))] + [(4, "old pen", "brand", "SMALL", 50)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    sold = [(1, "N"), (2, "R"), (3, "R"), (3, "N")]
    spark.createDataFrame(sold, "l_partkey long, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = catalog.QUERIES["reconcile_all"](spark, str(tmp_path))
    assert rows(found, "codice_aic", "found", "differs") == [
        (1, True, ""), (2, True, "ditta"), (3, True, ""), (3, True, "ditta"), (4, False, ""),
    ]


def test_sample_is_repeatable(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    first = rows(quality.sample_rows(df, "k", 5, seed=1))
    assert len(first) == 5
    assert first == rows(quality.sample_rows(df.repartition(7), "k", 5, seed=1))
    assert first != rows(quality.sample_rows(df, "k", 5, seed=2))


def test_profile(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, `b c` string")
    got = quality.profile_columns(df.withColumnRenamed("b c", "b_c"))
    assert rows(got) == [(0, "a", "int", 2, 2), (1, "b_c", "string", 2, 1)]


def test_write_reports_its_count(spark):
    df, seen = quality.observed(spark.range(7), "seven")
    df.write.format("noop").mode("overwrite").save()
    assert seen.get["n_rows"] == 7


def test_search_ladder(spark):
    view = spark.createDataFrame([("TACHIPIRINA 500",), ("TACHIPIRINA 500",), ("TACHIDOL",), (None,)], "denominazione string")
    asked = spark.createDataFrame([(1, "Tachipirina"), (2, "tachidol"), (3, "no_such")], "request_id int, query string")
    got = quality.search_ladder(asked, view)
    assert rows(got, "request_id", "n_contains", "n_contains_case", "n_fragment", "n_equal") == [
        (1, 2, 0, 3, 0), (2, 1, 0, 3, 1), (3, 0, 0, 0, 0),
    ]


def test_name_ladder(spark):
    drugs = spark.createDataFrame([("DB1", "Nirmatrelvir")], "drugbank_id string, name string")
    synonyms = spark.createDataFrame([("DB1", "PF-07321332"), ("DB1", "nirmatrelvir anhydrous")], "drugbank_id string, synonym string")
    asked = spark.createDataFrame([(1, "NIRMATRELVIR"), (2, "pf-07321332")], "request_id int, query string")
    assert rows(quality.name_ladder(asked, drugs, synonyms), "request_id", "n_name", "n_synonym", "n_synonym_part") == [
        (1, 1, 0, 1), (2, 0, 1, 1),
    ]


def test_no_python_in_profile_plan(spark):
    plan = quality.profile_columns(spark.range(3))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and F is not None
