"""Table functions of the catalog against brute force, and their plans."""

import re

import pytest

from pharmalith.plans.catalog import QUERIES
from pharmalith.session import sibling
from pharmalith.sources import catalog, tables
from tests.test_scale import LARGE, conf, planned

NAMES = ["OKI 80 mg", "Oki fiale", "Brufen 600", "", None, "ab%c", "a_b\u0001c", "Caffè 𝒳y", "Brufen 600"]
ASKED = ["oki", "OKI 80 MG", "", "%", "_", "b%6", "f_n", "%%n", "\u0001", "è 𝒳", "y", "nulla", None, "brufen 600 x"]
INGREDIENTS = [(0, "Ketoprofene"), (1, "alcol"), (1, "N.D."), (2, "ibuprofene"), (2, ""), (3, None), (5, "k%e"), (7, "caffeina"), (None, "alcol")]
OFFERED = ["KETOPROFENE sale", "Alcol etilico", "alcol etilico", "kappa e", "Ibuprofene", None, "", "Caffeina", "oki", "Alcol etilico"]


def like(text, term):
    """``text like '%term%'`` in any letter case; nothing escapes the wildcards."""
    if text is None or term is None:
        return False
    pattern = "".join({"%": ".*", "_": "."}.get(c, re.escape(c)) for c in term.lower())
    return re.search(pattern, text.lower(), re.DOTALL) is not None


@pytest.fixture(scope="module")
def session(spark, tmp_path_factory):
    folder, name = str(tmp_path_factory.mktemp("tables")), "pharma_functions"
    short = [(0, "C", "2024", "m"), (0, "C", "2025", "m"), (6, None, "2024", "m")]
    relations = {
        "farmaci_anagrafica": spark.createDataFrame(list(enumerate(NAMES)), "codice_aic bigint, denominazione string"),
        "farmaci_carenti": spark.createDataFrame(short, "codice_aic bigint, classe_di_rimborsabilita string, data_inizio string, motivazioni string"),
        "classe_a": spark.createDataFrame([(1,), (1,)], "codice_aic bigint"),
        "principi_attivi": spark.createDataFrame(INGREDIENTS, "codice_aic bigint, principio_attivo string"),
        "farmaci_equivalenti": spark.createDataFrame(
            [(k, text, f"f{k}", "d", 1.0) for k, text in enumerate(OFFERED)],
            "codice_aic bigint, principio_attivo string, farmaco string, ditta string, prezzo_riferimento_ssn double",
        ),
        "drugs": spark.createDataFrame([(f"DB{k}", f"drug {k}") for k in range(4)], "drugbank_id string, name string"),
        "interactions": spark.createDataFrame(
            [("DB0", "DB1", "x"), ("DB1", "DB0", "y"), ("DB2", "DB2", "z"), ("DB3", "DB9", "w"), (None, "DB1", "v")],
            "source_drug_id string, target_drug_id string, description string",
        ),
    }
    tables.write_relations(relations, folder)
    catalog.register_relations(spark, name, {n: f"{folder}/{n}.parquet" for n in relations})
    catalog.create_register_view(spark, name, class_column="classe_di_rimborsabilita")
    # Only the functions that are asked for: the others read columns these tables do not have.
    catalog.create_functions(spark, name, ["drug_status", "drug_generics", "drug_interactions"])
    other = sibling(spark)
    other.sql(f"use {name}")
    other.createDataFrame([(t,) for t in ASKED * 2], "name string").createOrReplaceTempView("asked")
    yield other
    spark.sql(f"drop database {name} cascade")


def test_status_of_a_table_of_names(session):
    copies = {k: (0, 1) for k in range(len(NAMES))} | {0: (2, 0), 1: (0, 2), 6: (1, 0)}
    want = []
    for term in ASKED * 2:
        hit = [copies[k] for k, text in enumerate(NAMES) if like(text, term)]
        if hit:
            want.append((term, sum(a for _, a in hit), sum(c for c, _ in hit)))
    found = session.sql("select a.name, s.* from asked a, lateral drug_status(a.name) s")
    assert sorted(tuple(r)[:3] for r in found.collect()) == sorted(want)
    for term in ("oki", "b%6", "nulla"):
        one = session.sql("select * from drug_status(:term)", args={"term": term}).collect()
        assert [(term, *r[:2]) for r in one] == [w for w in want if w[0] == term][:1]


def test_generics_of_a_table_of_names(session):
    want = []
    for term in ASKED * 2:
        own = [i for k, text in enumerate(NAMES) for n, i in INGREDIENTS if n == k and like(text, term) and i and i.lower() != "n.d."]
        want += [(term, k) for k, text in enumerate(OFFERED) if like(text, min(own, default=term))]
    found = session.sql("select a.name, g.codice_aic from asked a, lateral drug_generics(a.name) g")
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)
    assert {r.codice_aic for r in session.sql("select * from drug_generics('Oki')").collect()} == {0}


def test_interactions_of_a_table_of_lists(session):
    lists = {"a": ["DB0", "DB1"], "b": ["DB2", "DB2"], "c": ["DB2"], "d": None, "e": ["DB1", None, "DB0", "DB1"], "f": ["DB3", "DB9"]}
    session.createDataFrame(list(lists.items()), "k string, ids array<string>").createOrReplaceTempView("lists")
    found = session.sql("select l.k, i.description from lists l, lateral drug_interactions(l.ids) i")
    assert sorted(tuple(r) for r in found.collect()) == [("a", "x"), ("a", "y"), ("b", "z"), ("e", "x"), ("e", "y")]


def test_questions_do_not_meet_every_row(spark, sf):
    """Table functions under a lateral join are joins on equality."""
    with conf(spark, LARGE):
        plan = planned(QUERIES["tool_sql"](spark, sf))
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "BroadcastExchange" not in plan
