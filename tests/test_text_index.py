"""The stored index answers as a scan does, and reads little."""

import random
import re

import pytest
from pyspark.sql import functions as F

from pharmalith.operators import text_index
from pharmalith.operators.text_index import BUCKETS, TextIndex, literals
from tests.conftest import rows
from tests.test_scale import stored


@pytest.mark.parametrize(
    "pattern, want",
    [
        ("aspirin", ["aspirin"]), ("red|blue", ["red", "blue"]), ("red|s.a", None), ("^acid.*salic", ["salic"]), ("colou?r", ["colo"]),
        ("ab+cde", ["cde"]), ("(foo|bar)baz", ["baz"]), ("[abc]xyz[^]q]", ["xyz"]), (r"a\.b\+c", ["a.b+c"]), (r"\d+mg tab", ["mg tab"]),
        ("x{2}yyy", ["yyy"]), ("ab", None), (".*", None), ("(?i)aspirin", None), ("", None), (r"\Qa\E", None), ("abc{0,1}d", None), ("(", None),
        ("abcd*", ["abc"]), (r"abc\x41", None), ("ab(c)?def", ["def"]), ("[[:alpha:]]abc", None),
    ],
)
def test_literals_of_patterns(pattern, want):
    assert literals(pattern) == want


def test_a_match_always_holds_a_literal():
    rnd = random.Random(4)
    parts = ["abc", "d", "e?", "f*", "g+", "(hi|j)", "[kl]", ".", "|", "mno", r"\.", "p{2}", "q{0,3}", "^", "$", "rst"]
    texts = ["".join(rnd.choice(["abc", "d", "e", "f", "g", "hi", "j", "k", "mno", ".", "pp", "q", "rst"]) for _ in range(rnd.randint(0, 9))) for _ in range(300)]
    seen = 0
    for _ in range(800):
        pattern = "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 6)))
        needed = literals(pattern)
        if needed is not None:
            for text in texts:
                if re.search(pattern, text):
                    seen += 1
                    assert any(n in text for n in needed), (pattern, text)
    assert seen > 1000


def table(spark, n=400):
    rnd = random.Random(7)
    words = ["Oki", "TACHIPIRINA", "aspirina", "100%", "a_b", "bustine", "è", "mg", "Σας", "compresse", "back\\slash"]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 4))) for _ in range(n)] + [None, "", "ok"]
    return spark.createDataFrame(list(enumerate(texts)), "codice_aic long, denominazione string")


TERMS = ["oki", "PIRINA", "a_b", "100%", "%irina%mg", "è", "", "nothing here", "se", "k\\s", "σας", "%", "oki", None, "spirina 100"]


@pytest.mark.parametrize("ignore_case", [True, False])
def test_search_equals_a_scan(spark, tmp_path, ignore_case):
    packs = table(spark)
    index = TextIndex(spark, str(tmp_path), "denominazione", ignore_case)
    index.add("a", packs.filter("codice_aic % 2 = 0"))
    index.add("b", packs.filter("codice_aic % 2 = 1"))
    asked = spark.createDataFrame(list(enumerate(TERMS)), "request_id long, name string")
    from pharmalith.operators.matching import match_contains

    want = match_contains(asked, "name", packs, "denominazione", ignore_case, strategy="scan")
    assert rows(index.search(asked, "name")) == rows(want)
    assert rows(index.rows()) == rows(packs.filter("denominazione is not null"))


def test_many_terms_are_joined(spark, tmp_path, monkeypatch):
    packs = table(spark)
    index = TextIndex(spark, str(tmp_path), "denominazione")
    index.add("a", packs)
    asked = spark.createDataFrame(list(enumerate(TERMS)), "request_id long, name string")
    few = rows(index.search(asked, "name"))
    monkeypatch.setattr(text_index, "FEW", 1)
    assert rows(index.search(asked, "name")) == few


def test_batches_come_and_go(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path), "denominazione")
    with pytest.raises(ValueError):
        index.rows()
    one = spark.createDataFrame([(1, "OKI bustine")], "codice_aic long, denominazione string")
    two = spark.createDataFrame([(2, "oki 80 mg")], "codice_aic long, denominazione string")
    asked = spark.createDataFrame([(7, "oki")], "request_id long, name string")
    index.add("x", one)
    index.add("y", two)
    assert rows(index.search(asked, "name"), "codice_aic") == [(1,), (2,)]
    index.add("x", two.withColumn("codice_aic", F.lit(3).cast("long")))
    assert rows(index.search(asked, "name"), "codice_aic") == [(2,), (3,)]
    index.remove("y")
    assert index.batches() == ["x"] and rows(index.search(asked, "name"), "codice_aic") == [(3,)]
    # A batch that broke off before its end is not seen.
    one.write.parquet(f"{tmp_path}/batches/torn/rows")
    assert index.batches() == ["x"]
    index.add("none", one.filter("false"))
    assert rows(index.search(asked, "name"), "codice_aic") == [(3,)]
    with pytest.raises(ValueError):
        index.add("../z", one)


def scans(df):
    """Files read by the scans of an executed plan."""
    df.collect()

    def walk(node):
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            return walk(node.executedPlan())
        if "QueryStage" in name:
            return walk(node.plan())
        below, metrics = node.children(), node.metrics()
        own = [metrics.apply("numFiles").value()] if metrics.contains("numFiles") else []
        return own + [x for i in range(below.size()) for x in walk(below.apply(i))]

    return walk(df._jdf.queryExecution().executedPlan())


def test_a_single_search_reads_only_its_buckets(spark, tmp_path):
    packs = spark.range(3000).selectExpr("id as codice_aic", "concat('pack ', md5(cast(id as string))) as denominazione")
    index = TextIndex(spark, str(tmp_path), "denominazione")
    index.add("a", packs)
    name = packs.filter("codice_aic = 77").first().denominazione[5:17]
    wanted = spark.createDataFrame([(text_index_hash(spark, name[:3]),)], "gram long")
    read = index._at(index._read("grams"), "gram", wanted)
    assert 0 < sum(scans(read.select("gram"))) <= 2 + BUCKETS // 16
    asked = spark.createDataFrame([(1, name)], "request_id long, name string")
    found = index.search(asked, "name")
    assert rows(found, "codice_aic") == [(77,)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket#" in plan.split("PartitionFilters")[1][:80]
    assert "NestedLoop" not in plan


def text_index_hash(spark, gram):
    return spark.range(1).select(F.xxhash64(F.lit(gram))).first()[0]


def test_a_text_that_many_rows_share_is_many_files(spark, tmp_path):
    packs = spark.range(0, 40000, 1, 8).selectExpr("id as codice_aic", "if(id % 3 = 0, 'common name', concat('pack ', id)) as denominazione")
    index = TextIndex(spark, str(tmp_path), "denominazione")
    index.add("a", packs)
    asked = spark.createDataFrame([(1, "common")], "request_id long, name string")
    assert index.search(asked, "name").count() == 13334


def test_patterns_equal_a_scan(spark, tmp_path, monkeypatch):
    names = table(spark).withColumnRenamed("denominazione", "synonym")
    index = TextIndex(spark, str(tmp_path), "synonym")
    index.add("a", names)
    patterns = ["pirina.*mg", "oki|compresse", "^a_b", "è$", r"100%", "(bus)+tine", "[ab]spirina", "x.y", "", None, "Oki"]
    asked = spark.createDataFrame(list(enumerate(patterns)), "request_id long, pattern string")
    want = names.join(F.broadcast(asked), F.rlike(F.lower("synonym"), F.col("pattern"))).select(*asked.columns, *names.columns)
    assert rows(index.search_patterns(asked, "pattern")) == rows(want)
    monkeypatch.setattr(text_index, "PAIR_TERMS", 2)
    assert rows(index.search_patterns(asked, "pattern")) == rows(want)
    told = asked.filter("request_id in (0, 1, 4)")
    assert "NestedLoop" not in index.search_patterns(told, "pattern")._jdf.queryExecution().executedPlan().toString()
