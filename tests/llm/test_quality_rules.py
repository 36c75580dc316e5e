import collections
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pharmalith.llm import quality_rules as q
from tests.llm.conftest import LONG, edge_rows

SMALL = "/root/testdata/sf0.01"


def plain_counts(text):
    """The stated counts, word by word."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    hit = {k + d for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for d in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit))


@pytest.mark.parametrize("text", [None, "", " \n", "a", "a b c a b c", "a a a a", "x\nx\n\n \nx", "é ß # 😀|", "a b a b a", LONG])
def test_counts_of_odd_texts(text):
    assert q.text_counts(text)[:5] == plain_counts(text)


def test_counts_match_brute_force(spark, documents):
    got = {r.doc_id: r for r in q.judge(documents).collect()}
    for d in documents.collect():
        r = got[d.doc_id]
        n, chars, symbols, lines, repeated = plain_counts(d.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeated)
        assert r.base_failed == (n < 50 or 100 * repeated > 50 * n)
        assert not (r.base_failed and r.kept)


def test_labelled_documents(spark):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    judged = q.judge(docs).join(labels, "doc_id").filter("not base_failed")
    share = {r.quality: r.kept for r in judged.groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("kept")).collect()}
    assert share[1] >= 0.99 and share[0] <= 0.05


def test_estimate_withstands_outliers(spark):
    rng = np.random.default_rng(1)
    good, bad = rng.normal(1, 0.3, (800, 6)), rng.normal(9, 0.1, (160, 6))
    rows = [("p", *map(float, x)) for x in np.vstack([good, bad])]
    frame = spark.createDataFrame(rows, "pool string, " + ", ".join(f"{x} double" for x in q.FEATURES))
    estimate = q.mcd_estimates(frame).first()
    assert np.allclose(estimate["mean"], 1, atol=0.1)
    far = frame.crossJoin(spark.createDataFrame([estimate.asDict()], "pool string, mean array<double>, prec array<double>, scale double").drop("pool"))
    out = far.select((q._distance() / F.col("scale") > q.cutoff()).alias("out"), "x_word").collect()
    assert all(r.out for r in out if r.x_word > 5) and sum(r.out for r in out if r.x_word < 5) <= 8


def test_each_feature_alone_rejects(spark):
    rng = np.random.default_rng(3)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnoprstu"), rng.integers(3, 9))) for _ in range(2000)]

    def words(n):
        return [vocabulary[k] for k in rng.choice(len(vocabulary), n, replace=False)]

    def lines(w):
        return "\n".join(" ".join(w[k : k + 11]) for k in range(0, len(w), 11))

    w, twice = words(120), words(29)
    short = words(25)
    planted = {
        "x_word": lines([a + b for a, b in zip(words(120), words(120))]),
        "x_symbol": lines([x + "#" * (k % 3 == 0) for k, x in enumerate(w)]),
        "x_upper": lines([x.upper() if k % 2 else x for k, x in enumerate(w)]),
        "x_mark": lines([x + "!" * (k % 2) for k, x in enumerate(w)]),
        "x_repeat": lines([*twice, *w[:62], *twice]),
        "x_line": "\n".join([*(x for _ in range(4) for x in rng.permutation(short)), *words(5)]),
    }
    rows = [(k, lines(words(120)), "en", "a") for k in range(300)] + [(1000 + k, planted[x], "en", "a") for k, x in enumerate(q.FEATURES)]
    judged = {r.doc_id: r for r in q.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(r.base_failed for r in judged.values())
    assert [x for k, x in enumerate(q.FEATURES) if judged[1000 + k].kept] == []
    assert all(judged[k].kept for k in range(300))


def plain_mcd(x, tries=200):
    """Location and scatter of the densest three quarters by many random starts, rows one by one."""
    rng = np.random.default_rng(9)
    floor = np.diag(np.square(q.FLOORS))
    h, best = int(np.ceil(q.SUBSET * len(x))), (np.inf, None)
    for _ in range(tries):
        subset = x[rng.choice(len(x), 12, replace=False)]
        for _ in range(12):
            mean, cov = subset.mean(0), np.cov(subset.T, bias=True) + floor
            d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            subset = x[np.argsort(d, kind="stable")[:h]]
        det = np.linalg.slogdet(np.cov(subset.T, bias=True) + floor)[1]
        if det < best[0]:
            best = (det, subset)
    return best


@pytest.mark.parametrize("seed", range(3))
def test_estimate_against_brute_force(spark, seed):
    """The determinant comes within a few hundredths of the best of many random starts, and the same rows are outliers."""
    rng = np.random.default_rng(seed)
    mix = rng.normal(0, 1, (6, 6)) * 0.4 + np.eye(6)
    good = rng.normal(0, 1, (400, 6)) @ mix.T
    far = rng.normal(0, 0.3, (90, 6)) + rng.choice([-7, 7], 6)
    x = np.vstack([good, far])
    frame = spark.createDataFrame([("p", *map(float, r)) for r in x], "pool string, " + ", ".join(f"{c} double" for c in q.FEATURES))
    estimate = q._estimate(q.starts(frame, 50))
    assert estimate.count() == 3
    for _ in range(q.STEPS):
        estimate = q._estimate(q._concentrate(frame, estimate))
    found = min(r.det for r in estimate.collect())
    best, subset = plain_mcd(x)
    assert found <= best + 0.35
    final = q.mcd_estimates(frame).first()
    prec = np.array(final["prec"]).reshape(6, 6)
    d = np.einsum("ij,jk,ik->i", x - final["mean"], prec, x - final["mean"]) / final["scale"]
    assert (d[400:] > q.cutoff()).all() and (d[:400] > q.cutoff()).sum() <= 2
    assert np.allclose(final["mean"], good.mean(0), atol=0.35)


def test_small_sources_are_judged_by_their_language(spark):
    base = [("en", "big", False, *map(float, np.random.default_rng(k).normal(1, 0.2, 6))) for k in range(300)]
    odd = [("en", "tiny", False, *[9.0] * 6), ("en", "tiny", False, *[1.0] * 6)]
    rows = spark.createDataFrame(base + odd, "lang string, source string, base_failed boolean, " + ", ".join(f"{c} double" for c in q.FEATURES))
    pools = q.assign_pools(rows, 50)
    held = q.members(rows, pools)
    count = {r.pool: r["count"] for r in held.groupBy("pool").count().collect()}
    assert sorted(count.values()) == [300, 302]
    estimate = {r.pool: r for r in q.mcd_estimates(held).collect()}
    assert set(estimate) == set(count)


def test_sparse_groups_are_pooled(spark):
    rows = [("en", "big", False)] * 60 + [("en", f"s{k}", False) for k in range(55)] + [("de", "x", False)] * 3
    pools = {(r.lang, r.source): r.pool for r in q.assign_pools(spark.createDataFrame(rows, "lang string, source string, base_failed boolean"), 50).collect()}
    assert pools["en", "big"].startswith('{"k":"s"') and pools["en", "s1"].startswith('{"k":"l"') and pools["de", "x"] == "all"


def test_edge_cases(edge, nothing):
    judged = q.judge(edge).collect()
    assert len(judged) == len(edge_rows())
    assert not any(r.kept for r in judged if r.n_words < 50)
    assert q.judge(nothing).count() == 0
    kept = q.keep_good(edge)
    assert kept.columns == edge.columns and [r.doc_id for r in kept.collect()] == [r.doc_id for r in judged if r.kept]
    assert q.keep_good(nothing).count() == 0
