"""Charsets of files written by the test."""

import random

import pytest
from pyspark.sql import functions as F

from pharmalith.sources import charsets, delimited
from pharmalith.sources.delimited import Layout
from tests.conftest import rows

WORDS = "perché più città medicinale è già sarà compresse qualità Però così farmaco l’equivalente «bustina» 5° 12 € – caffè né L’Aquila Forlì".split()
CODECS = {"UTF-8": "utf-8", "ISO-8859-1": "latin-1", "windows-1252": "cp1252", "IBM850": "cp850", "macintosh": "mac_roman", "UTF-16LE": "utf-16-le", "UTF-16BE": "utf-16-be"}


def body(rnd, codec, n=40):
    lines = [f"{k};{' '.join(rnd.choice(WORDS) for _ in range(4))}" for k in range(n)]
    return [line.encode(codec, "ignore").decode(codec) for line in ["AIC;Qualità", *lines]]


@pytest.mark.parametrize("mark", [False, True])
def test_every_charset_is_found_and_read(spark, tmp_path, mark):
    rnd = random.Random(1)
    want, folder = [], tmp_path / "f"
    folder.mkdir()
    for name, codec in CODECS.items():
        lines = body(rnd, codec)
        sign = "﻿" if mark and name.startswith("UTF") else ""
        (folder / f"{name}.csv").write_bytes((sign + "\r\n".join(lines) + "\r\n").encode(codec))
        want += [tuple(line.split(";")) for line in lines[1:]]
    found = {r.file.rsplit("/", 1)[1][:-4]: r.charset for r in delimited.detect_charsets(spark, str(folder)).collect()}
    assert found == {name: name for name in CODECS}
    landed = delimited.read_delimited(spark, str(folder))
    assert landed.rows.columns == ["AIC", "Qualità"]
    assert rows(landed.rows) == sorted(want) and landed.rejects.count() == 0


@pytest.mark.parametrize("name", ["ISO-8859-1", "windows-1252", "IBM850", "macintosh"])
def test_short_italian_texts(spark, tmp_path, name):
    path = tmp_path / "s.csv"
    path.write_bytes("AIC;Nota\n1;perché così è già\n2;la qualità però".encode(CODECS[name]))
    found = delimited.detect_charsets(spark, str(path)).first()
    same = name == "windows-1252"  # nothing in it that tells it from the first
    assert found.charset == ("ISO-8859-1" if same else name) and found.confidence > 0.7


def test_no_evidence_is_the_first_charset(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_bytes(b"AIC;Nota\n1;x \xa0 y\n")
    found = delimited.detect_charsets(spark, str(path)).first()
    assert found.charset == "ISO-8859-1"


def test_plain_files_are_not_read_again(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x;y\n1;2\n")
    assert delimited.detect_charsets(spark, str(tmp_path)).first().charset == "UTF-8"
    assert rows(delimited.read_delimited(spark, str(tmp_path)).rows) == [("1", "2")]


def test_a_two_byte_file_over_splits(spark, tmp_path):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    lines = ["AIC;Nota"] + [f"{k};nota è {k}" for k in range(3000)]
    path = tmp_path / "w.csv"
    path.write_bytes("\n".join(lines).encode("utf-16"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9999")
    try:
        landed = delimited.read_delimited(spark, str(path))
        assert landed.rows.count() == 3000 and landed.rows.agg(F.count_distinct("Nota")).first()[0] == 3000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_quoted_breaks_in_two_byte_files(spark, tmp_path):
    path = tmp_path / "w.csv"
    path.write_bytes('AIC;Nota\r\n1;"a\r\nè"\r\n2;b\r\n'.encode("utf-16"))
    assert rows(delimited.read_delimited(spark, str(path), Layout(quoted_newlines=True)).rows) == [("1", "a\nè"), ("2", "b")]


def test_tables_follow_from_the_charsets():
    for name, codec in charsets.SINGLE.items():
        text = charsets.alphabet(name)
        assert len(text) == 128 and all(c == "�" or c.encode(codec) == bytes([128 + k]) for k, c in enumerate(text))
    assert len(charsets.pair_weights()) == 4 * 256 * 128


def test_pairs_overlap(spark):
    lines = spark.createDataFrame([("f", bytearray("àè x°".encode("latin-1")))], "file string, value binary")
    got = {(r.a, r.b): r.n for r in charsets.pair_counts(lines).collect()}
    assert got == {(" ", "à"): 1, ("à", "è"): 1, ("x", "°"): 1}


@pytest.mark.parametrize("name, codec", [("windows-1252", "cp1252"), ("latin-1", "latin-1"), ("utf8", "utf-8"), ("utf-16-be", "utf-16-be"), ("cp850", "cp850")])
def test_a_charset_that_is_named(spark, tmp_path, name, codec):
    path = tmp_path / "n.csv"
    path.write_bytes("AIC;Nota\n1;già é\n".encode(codec))
    assert rows(delimited.read_delimited(spark, str(path), Layout(charset=name)).rows) == [("1", "già é")]


def test_an_unknown_charset_is_an_error(spark, tmp_path):
    path = tmp_path / "n.csv"
    path.write_text("AIC\n1\n")
    with pytest.raises((ValueError, LookupError)):
        delimited.read_delimited(spark, str(path), Layout(charset="koi8-r"))
