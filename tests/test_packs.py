"""Pack operators on hand-made edge cases."""

import pytest

from pharmalith.operators import packs
from tests.conftest import rows


@pytest.fixture(scope="module")
def register(spark):
    return {
        "packs": spark.createDataFrame(
            [(1, "OKI 80 mg"), (2, "OKI fiale"), (3, "Brufen 600"), (4, "Aspirina"), (None, "Senza codice OKI")],
            "codice_aic bigint, denominazione string",
        ),
        "a": spark.createDataFrame([(1,), (1,), (3,), (None,)], "codice_aic bigint"),
        "h": spark.createDataFrame([(2,), (3,), (3,)], "codice_aic bigint"),
        "short": spark.createDataFrame(
            [(2, "2024", "m1", None), (2, "2025", "m2", "A"), (4, "2023", None, "Cnn"), (None, "x", "y", "z")],
            "codice_aic bigint, data_inizio string, motivazioni string, `classe_di_rimborsabilità` string",
        ),
        "ingredients": spark.createDataFrame(
            [(1, "Ketoprofene", 80.0, "mg"), (1, "N.D.", None, None), (2, "Ketoprofene", 1.0, "g"),
             (2, "Alcol", None, "ml"), (2, "", None, None), (3, None, 600.0, "mg"), (4, "n.d.", None, None)],
            "codice_aic bigint, principio_attivo string, quantita double, unita_misura string",
        ),
        "equivalents": spark.createDataFrame(
            [(10, "alcol etilico", "F1", "D1", 2.0), (11, "ALCOL", "F2", "D2", None), (12, "ALCOL", "F3", "D3", 1.5),
             (13, "ibuprofene", "F4", "D4", 3.0)],
            "codice_aic bigint, principio_attivo string, farmaco string, ditta string, prezzo_riferimento_ssn double",
        ),
    }


def test_unified_view_keeps_fan_out(register):
    view = packs.unified_view(register["packs"], register["a"], register["h"], register["short"])
    assert view.columns == [
        "codice_aic", "denominazione", "classe_rimborsabilita", "is_carente", "data_inizio_carenza",
        "motivazioni_carenza",
    ]
    assert rows(view, "codice_aic", "classe_rimborsabilita", "is_carente", "data_inizio_carenza") == [
        (None, "C", False, None),
        (1, "A", False, None),
        (1, "A", False, None),
        (2, "H", True, "2024"),
        (2, "H", True, "2025"),
        (3, "A", False, None),
        (3, "A", False, None),
        (4, "Cnn", True, "2023"),
    ]


def test_unified_view_can_drop_repeated_listings(register):
    view = packs.unified_view(register["packs"], register["a"], register["h"], register["short"], dedupe_right=True)
    assert view.groupBy("codice_aic").count().filter("codice_aic in (1, 3)").agg({"count": "max"}).first()[0] == 1


def test_unified_view_without_lists(register):
    view = packs.unified_view(register["packs"])
    assert {tuple(r) for r in view.select("classe_rimborsabilita", "is_carente").collect()} == {("C", False)}
    assert view.count() == 5


def test_own_class_of_the_shortage_row_counts_last(register):
    view = packs.unified_view(register["packs"], None, None, register["short"])
    assert rows(view.filter("codice_aic = 2"), "classe_rimborsabilita") == [("A",), ("C",)]


def test_large_fan_out_is_whole(spark):
    one = spark.createDataFrame([(1, "x")], "codice_aic bigint, denominazione string")
    many = spark.range(9000).selectExpr("cast(1 as bigint) as codice_aic")
    assert packs.unified_view(one, many).count() == 9000


def status(spark, register, name):
    asked = spark.createDataFrame([(7, name)], "request_id int, name string")
    found = packs.status_packs(asked, register["packs"], register["a"], register["h"], register["short"])
    return found, packs.status_summary(found, ["request_id", "name"])


@pytest.mark.parametrize(
    "name, label, available, short",
    [
        ("oki", "Parzialmente Carente (alcune confezioni disponibili, altre no)", 3, 2),
        ("aspirina", "Ritirato / Non Disponibile", 0, 1),
        ("BRUFEN", "Disponibile", 2, 0),
    ],
)
def test_status_labels(spark, register, name, label, available, short):
    _, summary = status(spark, register, name)
    assert rows(summary, "stato_generale", "n_attive", "n_carenti") == [(label, available, short)]


def test_unknown_name_has_no_status(spark, register):
    assert status(spark, register, "tachipirina")[1].count() == 0


def test_status_ingredients_leave_out_placeholders(spark, register):
    found, _ = status(spark, register, "oki")
    got = packs.status_ingredients(found, register["ingredients"], ["request_id"])
    assert rows(got) == [(7, "Alcol"), (7, "Ketoprofene")]


def test_ingredients_of_a_pack_keep_nulls(spark, register):
    asked = spark.createDataFrame([(1, 3), (2, 99)], "request_id int, codice_aic bigint")
    assert rows(packs.ingredients_of(asked, register["ingredients"]), "request_id", "principio_attivo", "quantita") == [
        (1, None, 600.0)
    ]


def test_generics_use_the_first_ingredient_and_sort_by_price(spark, register):
    asked = spark.createDataFrame([(1, "Oki"), (2, "ibu"), (3, "brufen"), (4, "nulla")], "request_id int, name string")
    got = packs.generics(asked, register["packs"], register["ingredients"], register["equivalents"])
    first = packs.cheapest_first(got.filter("request_id = 1"))
    assert [(r.cercato, r.codice_aic, r.prezzo_pubblico) for r in first.collect()] == [
        ("Alcol", 12, 1.5),
        ("Alcol", 10, 2.0),
        ("Alcol", 11, None),
    ]
    assert rows(got.filter("request_id > 1"), "request_id", "cercato", "codice_aic", "prezzo_pubblico") == [(2, "ibu", 13, 3.0)]


def test_copies_are_those_of_the_view(spark, register):
    """Group sizes tell how often each pack comes out of the unified view."""
    frame = lambda keys: spark.createDataFrame([(k,) for k in keys], "codice_aic bigint")
    base = spark.createDataFrame([(k, f"p{k}") for k in (1, 2, 3, None)], "codice_aic bigint, denominazione string")
    class_a, class_h = frame([1, 1, 2, None]), frame([2, 2, 2])
    short = frame([1, 1, 1, 3, None]).selectExpr("codice_aic", "'x' as data_inizio", "'y' as motivazioni", "'C' as c")
    view = packs.unified_view(base, class_a, class_h, short, class_column="c").groupBy("denominazione").count()
    assert rows(packs.pack_copies(base, class_a, class_h, short), "denominazione", "n") == rows(view)


def test_status_tells_the_packs_and_their_ingredients(spark, register):
    """The whole answer: both lists of packs, repeats kept, and the ingredients of all of them; a request without an id counts too."""
    asked = spark.createDataFrame([(7, "oki"), (None, "aspirina"), (8, "brufen"), (9, "nulla")], "request_id int, name string")
    found = packs.status_packs(asked, register["packs"], register["a"], register["h"], register["short"])
    got = packs.status_answer(found, register["ingredients"], ["request_id", "name"])
    assert rows(got.select("request_id", "name", "n_attive", "n_carenti").distinct()) == [
        (None, "aspirina", 0, 1), (7, "oki", 3, 2), (8, "brufen", 2, 0),
    ]
    assert rows(got.filter("name = 'oki'"), "lista", "codice_aic", "classe_rimborsabilita", "data_inizio_carenza", "principio_attivo") == [
        ("confezioni_attive", None, "C", None, None),
        ("confezioni_attive", 1, "A", None, None),
        ("confezioni_attive", 1, "A", None, None),
        ("confezioni_carenti_o_ritirate", 2, "H", "2024", None),
        ("confezioni_carenti_o_ritirate", 2, "H", "2025", None),
        ("principi_attivi_rilevati", None, None, None, "Alcol"),
        ("principi_attivi_rilevati", None, None, None, "Ketoprofene"),
    ]
    assert rows(got.filter("name = 'aspirina'"), "lista", "denominazione_completa", "motivazioni_carenza", "is_carente") == [
        ("confezioni_carenti_o_ritirate", "Aspirina", None, True)
    ]


def test_the_query_of_status_tells_everything(spark, sf):
    from pharmalith.plans.catalog import QUERIES

    got = QUERIES["pack_status"](spark, sf)
    lists = {"confezioni_attive", "confezioni_carenti_o_ritirate", "principi_attivi_rilevati"}
    assert {r.lista for r in got.select("lista").distinct().collect()} == lists
    assert got.filter("lista <> 'principi_attivi_rilevati'").count() == QUERIES["pack_status_packs"](spark, sf).count()
    assert got.filter("lista = 'principi_attivi_rilevati'").count() == QUERIES["pack_status_ingredients"](spark, sf).count()
    assert got.select("request_id", "nome_ricercato", "n_attive", "n_carenti", "stato_generale").distinct().count() == got.select("request_id").distinct().count()
