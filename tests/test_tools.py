"""Single lookups over tables that the two builds have written."""

import json

import pytest

from pharmalith.plans.build import build_drugs, build_profile, build_register
from pharmalith.plans.tools import Tools
from pharmalith.sources import landed_json
from tests.conftest import rows
from tests.test_sources import FULL, XML, put, study


@pytest.fixture(scope="module")
def tools(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("landed")
    paths = {
        "farmaci_anagrafica": put(
            folder, "p.csv", "Codice AIC;Denominazione;Ditta\n001;TACHIPIRINA 500;Angelini\n2;TACHIPIRINA fiale;A\n3;OKI;D\n"
        ),
        "principi_attivi": put(
            folder, "i.csv",
            "codice_aic;principio_attivo;quantita;unita_misura\n1;Paracetamolo;500;mg\n2;N.D.;;\n3;Ketoprofene;80;mg\n",
        ),
        "farmaci_carenti": put(
            folder, "s.csv", "x\ny\nCodice AIC;Data inizio;Motivazioni;Classe di rimborsabilità\n2;2024;perché;C\n"
        ),
        "farmaci_equivalenti": put(
            folder, "e.csv",
            "AIC;Farmaco;Ditta;Principio attivo;Prezzo riferimento SSN\n7;P1;A;PARACETAMOLO;€ 2,50\n8;P2;B;paracetamolo;\n"
            "9;P3;C;paracetamolo;1,50\n",
        ),
    }
    build_register(spark, paths, str(folder / "register"))
    build_drugs(spark, put(folder, "d.xml", XML.format(records=FULL.format(i=1, next=1))), str(folder / "drugs"))
    site = {"city": "Roma", "country": "Italy", "status": "RECRUITING"}
    doc = study("N1", "Brief", locations=[site])
    doc["protocolSection"] |= {
        "statusModule": {"overallStatus": "RECRUITING", "lastUpdatePostDateStruct": {"date": "2024-01-01"}},
        "conditionsModule": {"conditions": ["Breast Cancer"]},
        "armsInterventionsModule": {"interventions": [{"name": "Drug A"}]},
    }
    (folder / "studies").mkdir()
    put(folder / "studies", "s.json", json.dumps({"studies": [doc]}) + "\n")
    reports = spark.createDataFrame([("1", ["ASPIRIN"], ["Rash", "Nausea"]), ("2", ["ASPIRIN"], ["Rash"])],
                                    "report_id string, substances array<string>, reactions array<string>")
    return Tools.open(
        spark, str(folder / "register"), str(folder / "drugs"), list(paths),
        studies=landed_json.read_studies(spark, str(folder / "studies")), reports=reports,
    ), paths, folder


def test_register_lookups(tools):
    t = tools[0]
    status = t.get_drug_commercial_status("tachipirina").first()
    assert (status.n_attive, status.n_carenti) == (1, 1)
    assert status.stato_generale.startswith("Parzialmente Carente")
    assert rows(t.get_status_packs("tachi", short=True), "codice_aic", "motivazioni_carenza") == [(2, "perché")]
    assert t.get_status_packs("tachi").count() == 2
    assert rows(t.get_status_ingredients("tachi")) == [("Paracetamolo",)]
    assert t.get_drug_commercial_status("nothing").count() == 0
    assert [r.codice_aic for r in t.find_generics("Tachipirina").collect()] == [9, 7, 8]
    assert rows(t.get_active_ingredients_by_aic(3)) == [("Ketoprofene", 80.0, "mg")]


def test_drug_lookups(tools):
    t = tools[0]
    assert rows(t.resolve_drug_entity("one 1")) == [("DB1", "Drug & 1", "biotech", "liquid")]
    assert rows(t.resolve_drug_entity("DRUG & 1", priority="name"), "drugbank_id") == [("DB1",)]
    assert rows(t.get_drug_by_atc("b01"), "drugbank_id") == [("DB1",)]
    assert rows(t.check_drug_interactions(["DB1", "DB2"]), "description") == [("d < 1",)]
    assert t.check_drug_interactions(["DB1"]).count() == 0
    assert rows(t.get_molecule_smiles("drug & 1")) == [("CC", True)]


def test_landed_lookups(tools):
    t = tools[0]
    assert [tuple(r) for r in t.get_adverse_events("aspirin").collect()] == [("Rash", 2), ("Nausea", 1)]
    assert rows(t.find_clinical_trials(condition="breast"), "rank", "nct_id", "city") == [(1, "N1", "Roma")]
    assert t.find_clinical_trials("Drug A", "flu").count() == 0
    assert t.find_clinical_trials("drug", match="exact").count() == 0
    with pytest.raises(ValueError):
        t.find_clinical_trials()


def test_view_takes_sql_parameters(spark, tools):
    got = spark.sql("select denominazione from farmaci_completi where codice_aic = ? and is_carente = ?", args=[2, True])
    assert rows(got) == [("TACHIPIRINA fiale",)]


def test_profile_of_delivered_files(spark, tools):
    _, paths, folder = tools
    plain = {k: paths[k] for k in ("farmaci_anagrafica", "principi_attivi")} | {"absent": str(folder / "absent.csv")}
    assert build_profile(spark, plain, str(folder / "profile")) == {"profile": 7, "head": 6}
    got = spark.read.parquet(str(folder / "profile/profile.parquet")).filter("file = 'principi_attivi'")
    assert rows(got, "column_name", "n_rows", "n_filled") == [
        ("codice_aic", 3, 3), ("principio_attivo", 3, 3), ("quantita", 3, 2), ("unita_misura", 3, 2),
    ]
    assert rows(got, "column_name", "data_type")[::2] == [("codice_aic", "bigint"), ("quantita", "bigint")]
    head = spark.read.parquet(str(folder / "profile/head.parquet")).filter("file = 'principi_attivi'")
    assert '{"codice_aic":"1","principio_attivo":"Paracetamolo","quantita":"500","unita_misura":"mg"}' in [r.row for r in head.collect()]


def test_stored_layout_joins_without_a_shuffle(spark, sf):
    """Tables in buckets of the pack key: no exchange in the unified view, one bucket for one key, bloom filters in the files."""
    import pyarrow.parquet as pq

    from pharmalith.plans.bindings import Tables
    from pharmalith.plans.catalog import QUERIES
    from pharmalith.plans.queries_tools import _stored_tools
    from tests.test_scale import LARGE, conf

    with conf(spark, LARGE):
        view = QUERIES["pack_unified_stored"](spark, sf)
        assert "Exchange" not in view._jdf.queryExecution().executedPlan().toString()
    tools = _stored_tools(Tables(spark, sf))
    one = tools.get_active_ingredients_by_aic(7)
    # A file that costs as much to open as a partition holds is a partition of its own.
    with conf(spark, {"spark.sql.files.openCostInBytes": "1g"}):
        assert tools.register["principi_attivi"].rdd.getNumPartitions() >= 16
        assert tools.get_active_ingredients_by_aic(7).rdd.getNumPartitions() == 1
    path = tools.register["principi_attivi"].inputFiles()[0].replace("file://", "").replace("file:", "")
    column = next(c for c in map(pq.ParquetFile(path).metadata.row_group(0).column, range(4)) if c.path_in_schema == "codice_aic")
    assert column.statistics.has_min_max


def test_status_of_one_name_equals_the_batch(spark, sf):
    from pharmalith.plans.bindings import Tables
    from pharmalith.plans.queries_tools import _stored_tools, _tools

    t = Tables(spark, sf)
    for name in (r[0] for r in t.sql("select p_name from {part} group by p_name order by p_name limit 2").collect()):
        plain, kept = _tools(t), _stored_tools(t)
        assert rows(plain.get_status_packs(name)) == rows(kept.get_status_packs(name).select(*plain.get_status_packs(name).columns))
        assert rows(plain.get_drug_commercial_status(name)) == rows(kept.get_drug_commercial_status(name))
    assert rows(plain.get_drug_commercial_status("100% no such name")) == []
