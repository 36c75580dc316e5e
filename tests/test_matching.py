"""Substring search: wildcards, letter case, and agreement of the three strategies."""

import random

import pytest
from pyspark.sql import functions as F

from pharmalith.operators.matching import PAIR_TERMS, SCAN_TERMS, choose_strategy, match_contains
from tests.conftest import rows

STRATEGIES = ["scan", "pairs", "grams"]


def like(text, term):
    """LIKE '%term%' by hand: ``%`` any run, ``_`` any one character, nothing else special."""
    import re

    parts = {"%": ".*", "_": "."}
    return re.search("".join(parts.get(c) or re.escape(c) for c in term), text, re.S) is not None


def brute(terms, texts, fold):
    return sorted(
        (i, j)
        for i, term in enumerate(terms)
        for j, text in enumerate(texts)
        if term is not None and text is not None and like(fold(text), fold(term))
    )


@pytest.mark.parametrize("strategy", STRATEGIES)
@pytest.mark.parametrize("ignore_case", [True, False])
def test_agrees_with_brute_force(spark, strategy, ignore_case):
    random.seed(3)
    letters = "aAbè%_\\1"
    texts = ["".join(random.choices("aAbBè\\1 ", k=random.randint(0, 9))) for _ in range(150)] + [None, "", "a\nb"]
    terms = ["".join(random.choices(letters, k=random.randint(0, 5))) for _ in range(60)]
    terms += [None, "", "%", "_", "a%b", "\\", "\u0001", "__________", "aaaaaaaaaaaaaaaa"]
    requests = spark.createDataFrame(list(enumerate(terms)), "i int, term string")
    data = spark.createDataFrame(list(enumerate(texts)), "j int, text string")
    got = match_contains(requests, "term", data, "text", ignore_case=ignore_case, strategy=strategy)
    fold = str.lower if ignore_case else str
    assert sorted((r.i, r.j) for r in got.select("i", "j").collect()) == brute(terms, texts, fold)


def test_duplicate_rows_and_requests_are_kept(spark):
    requests = spark.createDataFrame([(1, "oki"), (2, "OKI")], "i int, term string")
    data = spark.createDataFrame([(1, "Oki 80"), (2, "Oki 80")], "j int, text string")
    for strategy in STRATEGIES:
        got = match_contains(requests, "term", data, "text", strategy=strategy)
        assert rows(got, "i", "j") == [(1, 1), (1, 2), (2, 1), (2, 2)]


def test_strategy_follows_the_number_of_terms(spark):
    def terms(n, width=1):
        return spark.range(n).select(F.concat(F.lit("x" * width), F.col("id").cast("string")).alias("_term"))

    assert choose_strategy(terms(SCAN_TERMS)) == "scan"
    assert choose_strategy(terms(SCAN_TERMS + 1)) == "pairs"
    assert choose_strategy(terms(PAIR_TERMS + 1)) == "grams"
    assert choose_strategy(terms(3, width=1 << 20)) == "grams"


def test_gram_join_spreads_a_gram_that_all_texts_share(spark):
    data = spark.range(2000).select(F.concat(F.lit("abc"), F.col("id")).alias("text"))
    requests = spark.createDataFrame([(1, "abc")], "i int, term string")
    got = match_contains(requests, "term", data, "text", strategy="grams")
    assert got.count() == 2000


def test_shared_column_names_are_refused(spark):
    df = spark.createDataFrame([(1, "a")], "i int, text string")
    with pytest.raises(ValueError):
        match_contains(df, "text", df, "text")


def test_no_python_in_the_plan(spark):
    requests = spark.createDataFrame([(1, "a")], "i int, term string").filter("i > 0")
    plan = match_contains(requests, "term", spark.range(3).select(F.col("id").cast("string").alias("t")), "t")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text
