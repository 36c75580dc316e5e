"""Builds become visible as a whole."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pharmalith.plans.build import rebuild_drugs, rebuild_register
from pharmalith.sources import generations
from tests.conftest import rows


def relations(spark, k, broken=False):
    one = spark.range(k).selectExpr("id as codice_aic")
    two = spark.range(2 * k).selectExpr("id", "if(id = 1 and %s, raise_error('torn'), 'x') as v" % str(broken).lower())
    return {"one": one, "two": two}


def test_a_build_that_breaks_off_leaves_the_one_before(spark, tmp_path):
    root = str(tmp_path / "r")
    assert generations.current(spark, root) is None
    with pytest.raises(ValueError):
        generations.read(spark, root)
    first = generations.build(spark, root, relations(spark, 3))
    assert first.number == 1 and first.rows == {"one": 3, "two": 6}
    with pytest.raises(PySparkException):
        generations.build(spark, root, relations(spark, 5, broken=True))
    assert {n: df.count() for n, df in generations.read(spark, root).items()} == {"one": 3, "two": 6}
    # The first relation of the torn build was written, and no one sees it.
    assert len(list((tmp_path / "r" / "generations").iterdir())) == 2
    open_reader = generations.read(spark, root)["two"]
    second = generations.build(spark, root, relations(spark, 5))
    assert second.number == 2 and generations.read(spark, root, ["one"])["one"].count() == 5
    assert open_reader.count() == 6 and generations.read(spark, root, number=1)["one"].count() == 3
    assert [g.number for g in generations.history(spark, root)] == [1, 2]


def test_two_builds_that_end_together(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "r")
    generations.build(spark, root, relations(spark, 1))
    seen = generations._numbers
    calls = []

    def late(spark_, root_):
        """The first look misses the other build."""
        calls.append(1)
        return seen(spark_, root_)[:-1] if len(calls) == 1 else seen(spark_, root_)

    monkeypatch.setattr(generations, "_numbers", late)
    done = generations.build(spark, root, relations(spark, 2))
    assert done.number == 2 and len(calls) == 2
    monkeypatch.undo()
    assert [g.rows["one"] for g in generations.history(spark, root)] == [1, 2]


def test_old_and_unfinished_builds_are_removed(spark, tmp_path):
    root = str(tmp_path / "r")
    for k in (1, 2, 3):
        generations.build(spark, root, relations(spark, k))
    with pytest.raises(PySparkException):
        generations.build(spark, root, relations(spark, 4, broken=True))
    assert len(generations.prune(spark, root, keep=2)) == 1
    assert len(list((tmp_path / "r" / "generations").iterdir())) == 3
    assert len(generations.prune(spark, root, keep=2, unfinished=True)) == 1
    assert [g.number for g in generations.history(spark, root)] == [2, 3]
    assert generations.read(spark, root, ["two"])["two"].count() == 6
    assert generations.build(spark, root, {}).number == 4


def test_register_and_drugs_as_generations(spark, tmp_path):
    packs = tmp_path / "p.csv"
    packs.write_text("Codice AIC;Denominazione\n1;OKI\n2;B\n3;x;y;z\n")
    root = str(tmp_path / "out")
    done = rebuild_register(spark, {"farmaci_anagrafica": str(packs)}, root)
    assert done.rows == {"farmaci_anagrafica": 2, "farmaci_anagrafica_rejects": 1}
    view = spark.table("farmaci_completi")
    assert rows(view, "codice_aic", "classe_rimborsabilita") == [(1, "C"), (2, "C")]
    packs.write_text("Codice AIC;Denominazione\n9;NEW\n")
    rebuild_register(spark, {"farmaci_anagrafica": str(packs)}, root)
    assert rows(spark.table("farmaci_completi"), "codice_aic") == [(9,)] and rows(view, "codice_aic") == [(1,), (2,)]
    xml = tmp_path / "d.xml"
    xml.write_text('<drugbank><drug type="t"><drugbank-id primary="true">D1</drugbank-id><name>n</name></drug></drugbank>')
    assert rebuild_drugs(spark, str(xml), root).number == 3
    assert rows(generations.read(spark, root)["drugs"].select(F.col("name"))) == [("n",)]
