"""Damaged XML records, documents without attributes, and damaged JSON pages."""

import json
import random
import xml.etree.ElementTree as ET

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pharmalith.sources import drug_xml, landed_json
from pharmalith.sources.xml_repair import repair
from tests.conftest import rows
from tests.test_spanning import small_splits  # noqa: F401

SOUND = '<drug type="x"><name>A &amp; B</name><synonyms><synonym>s</synonym></synonyms><!-- <b --><c/></drug>'


@pytest.mark.parametrize(
    "text, fixed, damage",
    [
        (SOUND, SOUND, []),
        ("<a></b><c>1</c></a>", "<a><c>1</c></a>", ["unexpected </b>"]),
        ("<a><b>x<c>1</c></a>", "<a><b>x</b><c>1</c></a>", ["unclosed <b>"]),
        ("<a><b><c>1</c>", "<a><b></b><c>1</c></a>", ["unclosed <b>", "unclosed <a>"]),
        ("<a>1 & 2 &nbsp; < 3</a>tail", "<a>1 &amp; 2 &amp;nbsp; &lt; 3</a>", ["stray &", "broken tag"]),
        ("<a>\x01<b x='1' x='2'>t</b></a>", "<a><b>t</b></a>", ["forbidden character", "repeated attribute in <b>"]),
        ('<a><b code="</a>', '<a>&lt;b code="</a>', ["broken tag"]),
        ("<a><![CDATA[<x> & ]]></a>", "<a><![CDATA[<x> & ]]></a>", []),
        ("", "", []),
        ("no tags & <", "no tags &amp; &lt;", ["stray &", "broken tag"]),
    ],
)
def test_repairs(text, fixed, damage):
    assert repair(text) == (fixed, damage)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<b>", "</b>", "<c/>", "</a>", "<a>", "x", "&", "<", ">", "&lt;", '<b q="1">', "<!--", "-->", "\x02"]), max_size=14))
def test_repaired_text_is_well_formed(parts):
    ET.fromstring(repair("<r>" + "".join(parts) + "</r>")[0])


def test_a_long_record_is_repaired_in_linear_time():
    text = "<drug>" + "<s>x &</s>" * 100_000 + "</broken></drug>"
    fixed, damage = repair(text)
    assert len(damage) == 100_001 and fixed.count("</s>") == 100_000


DRUG = "<drug><drugbank-id>D{k}</drugbank-id><name>n{k}</name>{inner}</drug>"
STUB = "<pathways><pathway><drugs><drug\n><drugbank-id>S{k}</drugbank-id><name>stub</name></drug><drug/></drugs></pathway></pathways>"


@pytest.mark.parametrize("seed", range(3))
def test_records_without_attributes_over_splits(spark, tmp_path, small_splits, seed):  # noqa: F811
    rnd = random.Random(seed)
    nested = [rnd.random() < 0.5 for _ in range(120)]
    body = "\n".join(DRUG.format(k=k, inner=(STUB.format(k=k) if n else "") + "<state>" + "s" * rnd.randint(0, 400) + "</state>") for k, n in enumerate(nested))
    path = tmp_path / "plain.xml"
    path.write_text(f'<?xml version="1.0"?>\n<drugbank version="5">\n{body}\n</drugbank>\n')
    assert spark.read.option("lineSep", "<drug").text(str(path)).rdd.getNumPartitions() > 10
    found = drug_xml.read_records(spark, str(path))
    assert found.rejects.count() == 0
    want = [(f"D{k}", f"n{k}") for k in range(120)] + [(f"S{k}", "stub") for k in range(120) if nested[k]]
    assert rows(drug_xml.drug_rows(found), "drugbank_id", "name") == sorted(want)


def test_records_without_attributes_and_a_torn_end(spark, tmp_path):
    path = tmp_path / "plain.xml"
    path.write_text(" \n<drugbank>" + DRUG.format(k=1, inner="") + "<drug/>" + DRUG.format(k=2, inner="<state>solid</state>")[:-7])
    found = drug_xml.read_records(spark, str(path))
    assert rows(drug_xml.drug_rows(found), "drugbank_id") == [("D1",)] and found.rejects.count() == 1
    found = drug_xml.read_records(spark, str(path), recover=True)
    assert rows(drug_xml.drug_rows(found), "drugbank_id", "state") == [("D1", None), ("D2", "solid")]
    assert rows(found.rejects, "damage", "recovered") == [("unclosed <drug>", True)]


def test_recovered_records_keep_their_sound_lists(spark, tmp_path):
    record = (
        '<drug type="t"><drugbank-id primary="true">D1</drugbank-id><name>n</name></oops><synonyms><synonym>a</synonym><synonym>b & c</synonym></synonyms>'
        '<atc-codes><atc-code code="X"/><atc-code code="Y></atc-codes></drug>'
    )
    path = tmp_path / "d.xml"
    path.write_text(f"<drugbank>{record}\n{SOUND}</drugbank>")
    left = drug_xml.read_records(spark, str(path))
    assert rows(drug_xml.drug_rows(left)) == [] and rows(left.rejects, "damage", "recovered") == [(None, False)]
    found = drug_xml.read_records(spark, str(path), recover=True)
    assert rows(drug_xml.drug_rows(found), "drugbank_id", "type") == [("D1", "t")]
    assert rows(drug_xml.synonym_rows(found)) == [("D1", "a"), ("D1", "b & c")]
    assert rows(drug_xml.atc_rows(found)) == [("D1", "X")]
    assert found.rejects.first().record.startswith('<drug type="t">')


def study(k):
    return {"protocolSection": {"identificationModule": {"nctId": f"N{k}"}}}


def test_no_page_goes_without_a_trace(spark, tmp_path):
    lines = [
        json.dumps({"studies": [study(1), study(2)]}),
        '{"studies": [{"protocolSection": {"ident',
        json.dumps({"error": {"code": 404}}),
        json.dumps(study(3)),
        json.dumps({"studies": []}),
        json.dumps({"studies": [study(4)], "protocolSection": "odd"}),
        json.dumps({"studies": [None, study(5)]}),
        "not json",
        "[]",
        "null",
        json.dumps({"something": 1}),
        "",
    ]
    (tmp_path / "s.json").write_text("\n".join(lines) + "\n")
    read = landed_json.read_studies(spark, str(tmp_path))
    assert rows(read.studies, "nct_id") == [("N1",), ("N2",), ("N3",), ("N4",), ("N5",)]
    states = sorted(r.state for r in read.pages.collect())
    assert states.count("rows") == 3 and states.count("partial") == 1 and states.count("error") == 1
    assert states.count("damaged") >= 2 and len(states) >= len([x for x in lines if x]) - 1
    pages = {(r.state, r.page) for r in read.rejects.collect()}
    assert ("damaged", lines[1]) in pages and ("damaged", "not json") in pages and ("partial", lines[5]) in pages
    assert ("error", '{"code": 404}') in pages


def test_damaged_report_pages(spark, tmp_path):
    good = json.dumps({"results": [{"safetyreportid": "7", "patient": {"drug": [], "reaction": [{"reactionmeddrapt": "Rash"}]}}]})
    (tmp_path / "r.json").write_text(good + "\n" + good[:-9] + "\n")
    read = landed_json.read_report_pages(spark, str(tmp_path))
    assert read.reports.collect() == [("7", [], ["Rash"])]
    assert rows(read.pages, "state", "n_entries") == [("damaged", 0), ("rows", 1)]


def test_a_damaged_file_of_one_document(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"studies": [study(1)]}, indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"studies": [study(2)]}, indent=1)[:-5])
    read = landed_json.read_studies(spark, str(tmp_path), multi_line=True)
    assert rows(read.studies, "nct_id") == [("N1",)]
    assert [(r.file[-6:], r.state) for r in read.rejects.collect()] == [("b.json", "damaged")]
