"""Readers on small files written by the test."""

import json

import pytest
from pyspark.sql import functions as F

from pharmalith.functions.text import HEADER_DROPPED_PLAIN, clean_header, clean_headers, price
from pharmalith.plans.build import VIEW, build_drugs, build_register
from pharmalith.sources import delimited, drug_xml, landed_json, tables
from pharmalith.sources.delimited import Layout
from tests.conftest import rows


def put(folder, name, text, charset="utf-8"):
    path = folder / name
    path.write_bytes(text.encode(charset))
    return str(path)


def test_header_names():
    assert clean_headers([" Codice  AIC ", "Quantità (mg)", "_Prezzo.€_", "Unnamed: 3"]) == [
        "codice_aic", "quantità_mg", "prezzo", "Unnamed: 3",
    ]
    assert clean_headers(["AIC"]) == clean_headers(["codice"]) == ["codice_aic"]
    with pytest.raises(ValueError):
        clean_headers(["aic", "codice"])
    assert clean_header("Nome. del  farmaco*", HEADER_DROPPED_PLAIN, keep_ends=True) == "nome_del_farmaco*"


@pytest.mark.parametrize(
    "text, value",
    [
        ("€ 1,50", 1.5), ("\u0080 1,50", 1.5), ("1.234,50", None), ("  ", None), ("n.d.", None), ("1.5", 1.5),
        ("-3", -3.0), ("1e2", 100.0), ("1d", None), ("1,2,3", None), (" 2,0\t", 2.0), (None, None), ("12€", 12.0),
        ("1.5F", None), ("0x1p3", None), ("NaN", None), ("-inf", float("-inf")), ("", None),
    ],
)
def test_price(spark, text, value):
    df = spark.createDataFrame([(text,)], "c string").select(price(F.col("c")))
    assert df.first()[0] == value


def test_ragged_file(spark, tmp_path):
    path = put(
        tmp_path, "confezioni.csv",
        'Codice AIC;Denominazione;Note\n000012;"Oki; bustina";x\n13;"a ""b""";\n14\n\n15;a;b;c\n16;a;b;\n;N/A;null\n',
    )
    landed = delimited.read_delimited(spark, path)
    got = delimited.clean_table(landed.rows)
    assert got.dtypes == [("codice_aic", "bigint"), ("denominazione", "string"), ("note", "string")]
    assert rows(got) == [(None, None, None), (12, "Oki; bustina", "x"), (13, 'a "b"', None), (14, None, None)]
    assert rows(landed.rejects, "line", "n_fields") == [("15;a;b;c", 4), ("16;a;b;", 4)]


@pytest.mark.parametrize("charset", ["utf-8", "latin-1", "utf-8-sig"])
def test_charset_is_found(spark, tmp_path, charset):
    path = put(tmp_path, "f.csv", "città;perché\nà;è\nò;ù\n", charset)
    assert rows(delimited.read_delimited(spark, path).rows) == [("à", "è"), ("ò", "ù")]
    assert delimited.read_delimited(spark, path).rows.columns == ["città", "perché"]


def test_little_evidence_is_not_trusted(spark, tmp_path):
    path = put(tmp_path, "f.csv", "a;b\nè;1\n")
    found = delimited.detect_charsets(spark, path).first()
    assert (found.charset, round(found.confidence, 3)) == ("ISO-8859-1", 0.505)
    assert delimited.detect_charsets(spark, path, threshold=None).first().charset == "UTF-8"
    assert rows(delimited.read_delimited(spark, path, Layout(charset="UTF-8")).rows) == [("è", "1")]


def test_single_byte_currency(spark, tmp_path):
    path = put(tmp_path, "f.csv", "AIC;Farmaco;Prezzo\n1;x;€ 1,50\n2;perché;n.d.\n", "cp1252")
    spec = delimited.REGISTER["farmaci_equivalenti"]
    got = delimited.clean_table(delimited.read_delimited(spark, path).rows, spec)
    assert rows(got) == [(1, "x", 1.5), (2, "perché", None)]


def test_files_of_two_charsets_in_one_folder(spark, tmp_path):
    put(tmp_path, "a.csv", "codice;città\n1;à\n2;è\n3;ì\n")
    put(tmp_path, "b.csv", "codice;città\n4;ò\n", "latin-1")
    got = delimited.clean_table(delimited.read_delimited(spark, str(tmp_path)).rows)
    assert got.columns == ["codice_aic", "città"]
    # The header of the second file is written in other bytes, but reads the same.
    assert rows(got) == [(1, "à"), (2, "è"), (3, "ì"), (4, "ò")]


def test_repaired_header(spark, tmp_path):
    path = put(tmp_path, "a.csv", '" Codice AIC ";"Farmaco" ; Ditta\n1;a;b;extra\n2;c;d\n3;e;f;g;h\n')
    landed = delimited.read_delimited(spark, path, Layout(repair_header=True))
    assert rows(delimited.clean_table(landed.rows)) == [(1, "a", "b"), (2, "c", "d")]
    assert landed.rejects.count() == 1


def test_preamble(spark, tmp_path):
    path = put(tmp_path, "c.csv", "Elenco;;\n\nAIC;Data inizio\n1;2024\n;2025\n")
    got = delimited.clean_table(delimited.read_delimited(spark, path, Layout(preamble=2)).rows)
    assert got.columns == ["codice_aic", "data_inizio"]
    assert rows(got) == [(None, "2025"), (1, "2024")]


def test_separator_is_found(spark, tmp_path):
    for name, sep in (("a", ","), ("b", ";")):
        path = put(tmp_path, f"{name}.csv", f"x{sep}y\n1{sep}2\n")
        assert rows(delimited.read_delimited(spark, path, Layout(sep=None)).rows) == [("1", "2")]


def test_line_breaks_in_quotes(spark, tmp_path):
    path = put(tmp_path, "q.csv", 'codice;note;note\n1;"two\nlines";à\n2;è;ì\n3;a;b;c\n')
    landed = delimited.read_delimited(spark, path, Layout(quoted_newlines=True))
    assert landed.rows.columns == ["codice", "note", "note.1"]
    assert rows(landed.rows) == [("1", "two\nlines", "à"), ("2", "è", "ì")]
    assert landed.rejects.count() == 1


def test_text_head(spark, tmp_path):
    path = tmp_path / "t.txt"
    path.write_bytes(b"first\xff line\n" + b"x\n" * 100)
    got = delimited.text_head(spark, str(path), 50).collect()
    assert len(got) == 50 and got[0].value == "first line"


def test_large_file_is_read_in_parallel(spark, tmp_path):
    path = put(tmp_path, "big.csv", "codice;nome\n" + "".join(f"{i};nome perché {i}\n" for i in range(20000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        got = delimited.read_delimited(spark, path).rows
        assert got.rdd.getNumPartitions() > 4
        assert got.agg(F.count_distinct("codice"), F.count("*")).first() == (20000, 20000)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_register_build(spark, tmp_path):
    paths = {
        "farmaci_anagrafica": put(tmp_path, "p.csv", "Codice AIC;Denominazione\n001;OKI\n2;BRUFEN\n"),
        "farmaci_carenti": put(
            tmp_path, "s.csv",
            "x\ny\nCodice AIC;Data inizio;Motivazioni;Classe di rimborsabilità\n2;2024;perché;C\n",
        ),
        "classe_a": put(tmp_path, "a.csv", '"Codice AIC";"Nome"\n1;OKI\n'),
        "classe_h": str(tmp_path / "absent.csv"),
    }
    counts = build_register(spark, paths, str(tmp_path / "out"))
    tables_written = {"farmaci_anagrafica": 2, "farmaci_carenti": 1, "classe_a": 1}
    assert counts == {**tables_written, **{f"{n}_rejects": 0 for n in tables_written}}
    assert (VIEW, "TEMPORARY") in tables.list_tables(spark)
    got = spark.sql("select codice_aic, classe_rimborsabilita, is_carente from farmaci_completi")
    assert rows(got) == [(1, "A", False), (2, "C", True)]


XML = """<?xml version="1.0" encoding="UTF-8"?>
<drugbank xmlns="http://www.drugbank.ca" version="5.1">
{records}</drugbank>
"""
FULL = """<drug type="biotech" created="2005">
  <drugbank-id>SECOND{i}</drugbank-id><drugbank-id primary="true">DB{i}</drugbank-id>
  <name>Drug &amp; {i}</name><state>liquid</state>
  <synonyms><synonym language="english">One {i}</synonym><synonym/><synonym>Two</synonym><synonym>Two</synonym></synonyms>
  <atc-codes><atc-code code="B01"><level code="B">x</level></atc-code><atc-code/></atc-codes>
  <pathways><pathway><name>p</name><drugs><drug><drugbank-id>DB{next}</drugbank-id><name>stub</name></drug>
    <drug><drugbank-id>DB0</drugbank-id></drug></drugs></pathway></pathways>
  <drug-interactions><drug-interaction><drugbank-id>DB{next}</drugbank-id><description>d &lt; 1</description>
    </drug-interaction><drug-interaction><name>no id</name></drug-interaction></drug-interactions>
  <calculated-properties><property><kind>logP</kind><value>1</value></property>
    <property><kind>SMILES</kind><value>CC</value></property><property><kind>SMILES</kind><value>NN</value></property>
  </calculated-properties>
</drug>
"""
BARE = '<drug type="small molecule"><drugbank-id>DBX</drugbank-id><name>Bare</name></drug>\n'
NO_NAME = '<drug type="small molecule"><drugbank-id primary="true">DBY</drugbank-id><name></name></drug>\n'
NO_ID = '<drug type="small molecule"><drugbank-id primary="true"></drugbank-id><name>No id</name></drug>\n'
BROKEN = '<drug type="small molecule"><drugbank-id>DBZ</drugbank-id><name>Bad</nam></drug>\n'


def test_drug_document(spark, tmp_path):
    path = put(tmp_path, "d.xml", XML.format(records=FULL.format(i=1, next=2) + BARE + NO_NAME + NO_ID + BROKEN))
    parsed = drug_xml.read_records(spark, path)
    assert parsed.rejects.count() == 1
    got = drug_xml.drug_relations(parsed)
    assert rows(got["drugs"]) == [
        ("DB1", "Drug & 1", "biotech", "liquid", "CC"),
        ("DB2", "stub", None, None, None),
        ("DBX", "Bare", "small molecule", None, None),
    ]
    assert rows(got["interactions"]) == [("DB1", None, None), ("DB1", "DB2", "d < 1")]
    assert rows(got["synonyms"]) == [("DB1", "One 1"), ("DB1", "Two")]
    assert rows(got["atc_codes"]) == [("DB1", "B01")]


def test_drug_document_is_split_at_records(spark, tmp_path):
    n = 3000
    path = put(tmp_path, "d.xml", XML.format(records="".join(FULL.format(i=i, next=i + 1) for i in range(n))))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300000")
    try:
        parsed = drug_xml.read_records(spark, path, stored=False)
        assert parsed.records.rdd.getNumPartitions() > 8
        assert parsed.rejects.count() == 0
        got = drug_xml.drug_rows(parsed).filter("type is not null").agg(F.count("*"), F.count_distinct("drugbank_id"))
        assert got.first() == (n, n)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_drug_records_without_attributes(spark, tmp_path):
    records = "<drug><drugbank-id>DB1</drugbank-id><name>One</name></drug>\n<drug><drugbank-id>DB2</drugbank-id></drug>\n"
    path = put(tmp_path, "d.xml", XML.format(records=records))
    assert rows(drug_xml.drug_rows(drug_xml.read_records(spark, path)), "drugbank_id", "name", "type") == [
        ("DB1", "One", None)
    ]


def test_document_without_records_gives_typed_empty_relations(spark, tmp_path):
    path = put(tmp_path, "d.xml", XML.format(records=""))
    counts = build_drugs(spark, path, str(tmp_path / "out"))
    assert counts == {"drugs": 0, "interactions": 0, "synonyms": 0, "atc_codes": 0, "records_rejects": 0}
    stored = tables.read_drug_relations(spark, str(tmp_path / "out"))
    assert stored["drugs"].columns == ["drugbank_id", "name", "type", "state", "smiles"]
    assert stored["drugs"].count() == 0


def test_rebuild_replaces_relations(spark, tmp_path):
    out = str(tmp_path / "out")
    first = put(tmp_path, "1.xml", XML.format(records=FULL.format(i=1, next=2)))
    second = put(tmp_path, "2.xml", XML.format(records=BARE))
    assert build_drugs(spark, first, out)["drugs"] == 2
    counts = build_drugs(spark, second, out)
    assert counts == {"drugs": 1, "interactions": 0, "synonyms": 0, "atc_codes": 0, "records_rejects": 0}
    assert tables.read_drug_relations(spark, out)["drugs"].count() == 1


def study(nct, brief="", official=None, above=None, locations=None):
    protocol = {"identificationModule": {"nctId": nct, "briefTitle": brief, "officialTitle": official}}
    if above:
        protocol["officialTitle"] = above
    if locations is not None:
        protocol["contactsLocationsModule"] = {"locations": locations}
    return {"protocolSection": protocol}


def test_study_documents(spark, tmp_path):
    site = {"city": "Roma", "country": "Italy", "status": "RECRUITING"}
    page = {"studies": [study("N1", "Brief", locations=[site, None]), study("N2", above="Above"), {}], "nextPageToken": "t"}
    put(tmp_path, "p.json", json.dumps(page) + "\n" + json.dumps(study("N3", None, "Official")) + "\n{}\n")
    got = landed_json.read_studies(spark, str(tmp_path))
    assert rows(got.studies, "nct_id", "brief_title", "official_title") == [
        (None, None, None), ("N1", "Brief", None), ("N2", "", "Above"), ("N3", None, "Official"),
    ]
    assert rows(got.sites) == [("N1", "Roma", "Italy", "RECRUITING")]
    assert got.conditions.count() == got.interventions.count() == 0


def test_pretty_printed_page(spark, tmp_path):
    put(tmp_path, "p.json", json.dumps({"studies": [study("N1", "Brief")]}, indent=2))
    assert landed_json.read_studies(spark, str(tmp_path), multi_line=True).studies.count() == 1


def test_report_documents(spark, tmp_path):
    report = {
        "safetyreportid": "7",
        "patient": {
            "drug": [{"activesubstance": {"activesubstancename": "ASPIRIN"}}, {"medicinalproduct": "x"}],
            "reaction": [{"reactionmeddrapt": "Nausea"}, {"reactionmeddrapt": "Rash"}],
        },
    }
    put(tmp_path, "r.json", json.dumps({"results": [report]}) + "\n" + json.dumps({"error": {"message": "no"}}) + "\n")
    assert landed_json.read_reports(spark, str(tmp_path)).collect() == [("7", ["ASPIRIN"], ["Nausea", "Rash"])]


def test_relations_in_the_catalog(spark, tmp_path):
    df = spark.createDataFrame([("DB1", "x")], "drugbank_id string, synonym string")
    try:
        assert tables.write_relations({"test_synonyms": df}, str(tmp_path), "default") == {"test_synonyms": 1}
        assert tables.write_relations({"test_synonyms": df.union(df)}, str(tmp_path), "default") == {"test_synonyms": 2}
        assert ("test_synonyms", "EXTERNAL") in tables.list_tables(spark, "default")
        stored = tables.read_table(spark, "default.test_synonyms")
        assert tables.describe(stored) == [("drugbank_id", "string"), ("synonym", "string")]
        assert stored.count() == 2
    finally:
        spark.sql("drop table if exists default.test_synonyms")


def test_missing_relations_are_an_error(spark, tmp_path):
    from pyspark.errors import AnalysisException

    with pytest.raises(AnalysisException):
        tables.read_drug_relations(spark, str(tmp_path / "nothing"))


def test_random_lines_parse_like_the_csv_module(spark, tmp_path):
    import csv
    import io
    import random

    random.seed(11)

    def value():
        text = "".join(random.choices('ab è,.;"\'|\\', k=random.randint(0, 6)))
        if ";" in text or text.startswith('"') or random.random() < 0.2:
            return '"' + text.replace('"', '""') + '"'
        return text

    lines = [";".join(value() for _ in range(random.randint(1, 5))) for _ in range(1500)]
    lines = [line for line in lines if line.strip()]
    path = put(tmp_path, "r.csv", "\n".join(["x;y;z", *lines]) + "\n")
    landed = delimited.read_delimited(spark, path)
    parsed = [next(csv.reader(io.StringIO(line), delimiter=";")) for line in lines]
    want = [tuple((v or None) for v in (r + [None] * 3)[:3]) for r in parsed if len(r) <= 3]
    assert rows(landed.rows) == sorted(want, key=lambda r: [(v is not None, str(v)) for v in r])
    assert landed.rejects.count() == sum(len(r) > 3 for r in parsed)


def test_lines_like_the_head_are_data_elsewhere(spark, tmp_path):
    folder = tmp_path / "f"
    folder.mkdir()
    put(folder, "1.csv", "titolo\n;;;\na;b;c;d\n1;2;3;4\ntitolo\n;;;\n;;;\na;b;c;d\n")
    put(folder, "2.csv", "titolo\n;;;\na;b;c;d\n5;6;7;8\ntitolo\n")
    put(folder, "3.csv", "9;9;9;9\n;;;\n")
    landed = delimited.read_delimited(spark, str(folder), Layout(preamble=2))
    assert rows(landed.rows) == sorted(
        [("1", "2", "3", "4"), ("5", "6", "7", "8"), ("9", "9", "9", "9"), ("a", "b", "c", "d")]
        + [("titolo", None, None, None)] * 2
        + [(None,) * 4] * 3,
        key=lambda r: [(v is not None, str(v)) for v in r],
    )
    assert landed.rejects.count() == 0


def test_columns_in_another_order(spark, tmp_path):
    folder = tmp_path / "f"
    folder.mkdir()
    put(folder, "1.csv", "aic;nome;nota\n1;x;p\n")
    put(folder, "2.csv", '"nota";aic;nome\nq;2;y\nr;3;z;extra\n')
    put(folder, "3.csv", "4;w;s\n")
    landed = delimited.read_delimited(spark, str(folder))
    assert rows(landed.rows) == [("1", "x", "p"), ("2", "y", "q"), ("4", "w", "s")]
    assert rows(landed.rejects, "line") == [("r;3;z;extra",)]


def test_rejects_are_written_and_counted(spark, tmp_path):
    paths = {"farmaci_anagrafica": put(tmp_path, "p.csv", "Codice AIC;Denominazione\n1;OKI\n2;B;too;many\n")}
    counts = build_register(spark, paths, str(tmp_path / "out"))
    assert counts == {"farmaci_anagrafica": 1, "farmaci_anagrafica_rejects": 1}
    kept = spark.read.parquet(str(tmp_path / "out" / "farmaci_anagrafica_rejects.parquet"))
    assert rows(kept, "line", "n_fields") == [("2;B;too;many", 4)]
    broken = put(tmp_path, "d.xml", XML.format(records=FULL.format(i=1, next=2) + '<drug type="x"><name></drug>\n'))
    assert build_drugs(spark, broken, str(tmp_path / "drugs"))["records_rejects"] == 1


def test_older_header_rule(spark, tmp_path):
    path = put(tmp_path, "p.csv", "_Ragione. Sociale_;Prezzo (€)\nx;1\n")
    landed = delimited.read_delimited(spark, path, Layout(charset="UTF-8")).rows
    assert delimited.clean_table(landed).columns == ["ragione_sociale", "prezzo"]
    assert delimited.clean_table(landed, delimited.TableSpec(plain_headers=True)).columns == ["_ragione_sociale_", "prezzo_(€)"]


def test_scratch_folder_is_removed(spark, tmp_path, monkeypatch):
    from pharmalith import session

    # A folder of its own, as other tests still read their tables.
    monkeypatch.setitem(session._scratch, spark.sparkContext.applicationId, str(tmp_path / "scratch"))
    spark.range(3).write.parquet(session.scratch_path(spark, "probe"))
    assert list((tmp_path / "scratch").iterdir())
    session.clear_scratch(spark)
    assert not (tmp_path / "scratch").exists()


@pytest.mark.parametrize("named", ["spark.checkpoint.dir", "spark.sql.warehouse.dir"])
def test_a_cluster_may_share_a_mounted_folder(spark, tmp_path, monkeypatch, named):
    from pharmalith import session

    monkeypatch.delitem(session._scratch, spark.sparkContext.applicationId, raising=False)
    monkeypatch.setattr(spark.sparkContext, "master", "spark://driver:7077")
    monkeypatch.setattr(type(spark.sparkContext), "getCheckpointDir", lambda self: None)
    get = type(spark.conf).get
    # Only the folder named is set; it has the scheme of a mount.
    held = {"spark.checkpoint.dir": None, named: f"file://{tmp_path}/shared"}
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, *a: held[key] if key in held else get(self, key, *a))
    df = session.through_storage(spark.range(5), "probe")
    assert str(tmp_path) in session._scratch[spark.sparkContext.applicationId]
    assert df.count() == 5
    session.clear_scratch(spark)
    # A folder in which the driver does not find what the tasks write is refused before anything is stored there.
    monkeypatch.setattr(session, "_reaches_all", lambda *_: False)
    with pytest.raises(RuntimeError, match="does not see"):
        session.scratch_path(spark, "probe")


def test_executors_of_a_local_cluster_get_a_folder_that_all_share(spark, tmp_path, monkeypatch):
    from pharmalith import session

    monkeypatch.delitem(session._scratch, spark.sparkContext.applicationId, raising=False)
    monkeypatch.setattr(spark.sparkContext, "master", "local-cluster[3,4,10240]")
    monkeypatch.setattr(type(spark.sparkContext), "getCheckpointDir", lambda self: None)
    monkeypatch.setattr("tempfile.mkdtemp", lambda **_: pytest.fail("a temporary folder of the driver"))
    get = type(spark.conf).get
    held = {"spark.checkpoint.dir": None, "spark.sql.warehouse.dir": f"file://{tmp_path}/warehouse"}
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, *a: held[key] if key in held else get(self, key, *a))
    assert session.through_storage(spark.range(5), "probe").count() == 5
    assert str(tmp_path / "warehouse") in session._scratch[spark.sparkContext.applicationId]
    session.clear_scratch(spark)
    # A folder that is set but not shared, or cannot be written, is passed over for the next one.
    reaches = session._reaches_all
    held["spark.checkpoint.dir"] = f"{tmp_path}/own"
    monkeypatch.setattr(session, "_reaches_all", lambda s, path: "/own/" not in path and reaches(s, path))
    assert session.through_storage(spark.range(5), "probe").count() == 5
    assert str(tmp_path / "warehouse") in session._scratch[spark.sparkContext.applicationId]
    assert not any((tmp_path / "own").glob("*"))
    session.clear_scratch(spark)
    (tmp_path / "file").write_text("")
    assert not reaches(spark, f"file://{tmp_path}/file/probe")


def test_settings_of_the_session_are_respected(spark):
    from pharmalith.session import RUNTIME_CONF, tune

    assert all(tune(spark).conf.get(k) == v for k, v in RUNTIME_CONF.items())
