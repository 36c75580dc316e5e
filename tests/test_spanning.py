"""Records over splits: quoted line breaks and nested elements, against readers that see the whole text."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from pharmalith.sources import delimited, spanning
from pharmalith.sources.delimited import Layout
from tests.conftest import rows


@pytest.fixture
def small_splits(spark):
    """Splits of a few hundred bytes, so that records cross them."""
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def values(rnd):
    text = "".join(rnd.choices(['a', 'b', 'è', ' ', ',', ';', '"', "\n", "'", "\\", "long word "], k=rnd.randint(0, 9)))
    if any(c in text for c in ';"\n') or rnd.random() < 0.2:
        return '"' + text.replace('"', '""') + '"'
    return text


def parsed(text):
    return [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=";") if r]


def check(spark, path, text, width):
    landed = delimited.read_delimited(spark, str(path), Layout(quoted_newlines=True))
    data = parsed(text)[1:]
    want = [tuple((v or None) for v in (r + [None] * width)[:width]) for r in data if len(r) <= width]
    assert rows(landed.rows) == sorted(want, key=lambda r: [(v is not None, str(v)) for v in r])
    assert landed.rejects.count() == sum(len(r) > width for r in data)


@pytest.mark.parametrize("seed", range(4))
def test_random_values_over_splits(spark, tmp_path, small_splits, seed):
    rnd = random.Random(seed)
    lines = [";".join(values(rnd) for _ in range(rnd.randint(2, 4))) for _ in range(150)]
    text = "\n".join(['x;y;"z\nz"', *[x for x in lines if x.strip()]]) + "\n"
    path = tmp_path / "q.csv"
    path.write_text(text, encoding="utf-8")
    assert spark.read.text(str(path)).rdd.getNumPartitions() > 3
    check(spark, path, text, 3)


def test_a_value_longer_than_splits(spark, tmp_path, small_splits):
    long = "\n".join(f"line {k} of a long note" for k in range(200))
    text = f'aic;nota\n1;"{long}"\n2;b\n3;"x\n""y"""\n'
    path = tmp_path / "q.csv"
    path.write_text(text)
    check(spark, path, text, 2)


def test_shuffled_by_split(spark, tmp_path, small_splits, monkeypatch):
    monkeypatch.setattr(spanning, "FEW_SPLITS", -1)
    text = "aic;nota\n" + "".join(f'{k};"note {k}\n""of"" two lines; or more"\n' for k in range(100))
    path = tmp_path / "q.csv"
    path.write_text(text)
    check(spark, path, text, 2)


def test_many_files_preamble_and_carriage_returns(spark, tmp_path, small_splits):
    folder = tmp_path / "f"
    folder.mkdir()
    for k in range(3):
        body = "".join(f'{k}{i};"a\r\nb {i}"\r\n' for i in range(30))
        (folder / f"{k}.csv").write_bytes(f'"Elenco\r\ndei medicinali";\r\nAIC;"Nota\r\nlunga"\r\n{body}'.encode())
    landed = delimited.read_delimited(spark, str(folder), Layout(preamble=1, quoted_newlines=True))
    assert landed.rows.columns == ["AIC", "Nota\nlunga"]
    assert rows(landed.rows) == sorted((f"{k}{i}", f"a\nb {i}") for k in range(3) for i in range(30))
    assert landed.rejects.count() == 0


def test_a_quote_that_never_closes_is_a_reject(spark, tmp_path, small_splits):
    path = tmp_path / "q.csv"
    path.write_text("aic;nota\n1;a\n" + '2;"open\n' + "3;b\n" * 200)
    landed = delimited.read_delimited(spark, str(path), Layout(quoted_newlines=True))
    assert rows(landed.rows) == [("1", "a")]
    lost = landed.rejects.collect()
    assert len(lost) == 1 and lost[0].line.startswith('2;"open\n3;b\n') and lost[0].n_fields is None


def test_files_with_any_number_of_column_orders(spark, tmp_path):
    names, want = ["aic", "nome", "nome", "nota", "ditta", "classe"], []
    folder = tmp_path / "f"
    folder.mkdir()
    rnd = random.Random(2)
    for k in range(130):
        order = rnd.sample(range(6), 6) if k else list(range(6))
        # Equal names keep their order among themselves.
        order = [x if x not in (1, 2) else None for x in order]
        twins = iter((1, 2))
        order = [x if x is not None else next(twins) for x in order]
        (folder / f"{k:03}.csv").write_text(";".join(names[x] for x in order) + "\n" + ";".join(f"{k}-{x}" for x in order) + "\n")
        want.append(tuple(f"{k}-{x}" for x in range(6)))
    landed = delimited.read_delimited(spark, str(folder))
    assert rows(landed.rows) == sorted(want)
    assert str(landed.rows._jdf.queryExecution().optimizedPlan()).count("Union") <= 1


def test_change_of_a_split_is_that_of_its_pieces():
    rnd = random.Random(1)
    for kind, low in ((spanning.QUOTES, (0, 1)), (spanning.DEPTH, (-2, 2))):
        for _ in range(300):
            pieces = [(rnd.randint(*low), rnd.randint(0, 1)) for _ in range(rnd.randint(0, 8))]
            change = spanning._unchanged(kind)
            for a, b in pieces:
                change = spanning._composed(kind, change, a, b)
            for state in (0, 1) if kind == spanning.QUOTES else range(6):
                after = state
                for a, b in pieces:
                    after = spanning._after(kind, after, a, b)
                assert spanning._applied(kind, state, change) == after


def test_splits_are_read_where_they_are(spark, tmp_path, small_splits):
    path = tmp_path / "q.csv"
    path.write_text("aic;nota\n" + "".join(f'{k};"a\nb"\n' for k in range(300)))
    lines = delimited.read_lines(spark, str(path)).withColumn("line", F.col("value"))
    records = delimited.whole_records(lines, ";")
    assert records.count() == 301 and records.filter("not complete").count() == 0
