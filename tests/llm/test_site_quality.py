import numpy as np
from pyspark.sql import functions as F

from pharmalith.llm import site_quality as s
from tests.llm.conftest import edge_rows

SMALL = "/root/testdata/sf0.01"


def test_labels_are_told_apart(spark):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    # Labels of odd ids are held back.
    scored = s.score(docs, labels.filter("doc_id % 2 = 0")).join(labels.filter("doc_id % 2 = 1"), "doc_id").collect()
    right = [r.kept == bool(r.quality) for r in scored]
    assert len(right) > 100 and np.mean(right) > 0.93
    assert np.mean([r.kept for r in scored if r.quality]) > 0.97


def test_sparse_sites_are_shrunk(spark):
    """A bad site with many documents keeps its own mean; one bad document does not make a bad site."""
    rows, marks = [], []
    good, bad = "word " * 30 + " ".join(f"w{k}" for k in range(60)), "%%% ### " * 60
    for k in range(600):
        host = "big" if k < 200 else "rest%d" % (k % 8)
        poor = host == "big" or k % 10 == 0
        rows.append((k, bad if poor else good + f" n{k}", host, "p"))
        marks.append((k, 0 if poor else 1, 0))
    rows.append((1000, bad, "small", "p"))
    rows.append((1001, good, "big", "p"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    out = {r.doc_id: r for r in s.score(docs, spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).collect()}
    everywhere = sum(r.host_mean for r in out.values()) / len(out)
    assert out[0].host_mean < 0.1 < out[1000].host_mean
    assert abs(out[1000].host_mean - everywhere) < abs(out[0].host_mean - everywhere)
    assert out[1001].posterior < out[601 - 1 if 600 in out else 599].posterior


def test_strength_follows_the_spread(spark):
    rng = np.random.default_rng(1)

    def groups(spread):
        rows = []
        for m in np.clip(rng.normal(0.5, spread, 300), 0.02, 0.98):
            x = rng.random(50) < m
            rows.append((50, float(x.sum()), float(x.sum())))
        return spark.createDataFrame(rows, "n long, s double, q double").withColumn("m", F.lit(0.5))

    assert s.strength(groups(0.3), "m") < 6 < 60 < s.strength(groups(0.02), "m")


def brute(rows, labels):
    """Means, strengths and posteriors from the evidence, document by document."""
    chance, marks = {}, {}
    for d, q in labels:
        if d is not None and q is not None:
            marks.setdefault(d, []).append(q)
    base = np.mean([round(np.mean(q)) for q in marks.values()])
    logit = lambda p: float(np.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6))))
    squash = lambda x: 1 / (1 + np.exp(-x))
    for k, r in enumerate(rows):
        chance[k] = float(np.mean(marks[r.doc_id])) if r.doc_id in marks else squash(r.evidence + logit(base))
    everywhere = np.mean(list(chance.values()))

    def strength(groups, centre):
        n, g = sum(map(len, groups.values())), len(groups)
        if n <= g:
            return 1.0
        within = max(sum(sum((x - np.mean(v)) ** 2 for x in v) for v in groups.values()) / (n - g), 1e-9)
        true = (sum(len(v) * (np.mean(v) - centre(key)) ** 2 for key, v in groups.items()) - g * within) / n
        return 1e6 if true <= 0 else min(1e6, max(1.0, within / true))

    hosts, paths = {}, {}
    for k, r in enumerate(rows):
        hosts.setdefault(r.host, []).append(chance[k])
        paths.setdefault((r.host, r.path), []).append(chance[k])
    a = strength(hosts, lambda h: everywhere)
    whole = {h: (sum(v) + a * everywhere) / (len(v) + a) for h, v in hosts.items()}
    b = strength(paths, lambda p: whole[p[0]])
    out = []
    for k, r in enumerate(rows):
        v = hosts[r.host]
        host = (sum(v) - chance[k] + a * everywhere) / (len(v) - 1 + a)
        v = paths[r.host, r.path]
        path = (sum(v) - chance[k] + b * host) / (len(v) - 1 + b)
        out.append((host, path, squash(r.evidence + logit(path))))
    return out


def test_posteriors_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    # Sites of very different quality: bad documents gather on two of them.
    sites = docs.join(labels, "doc_id", "left").withColumn(
        "source", F.when((F.col("quality") == 0) & (F.col("doc_id") % 3 > 0), F.lit("bad")).otherwise(F.col("source"))
    ).drop("quality", "toxic")
    half = labels.filter("doc_id % 2 = 0")
    rows = s.score(sites, half).collect()
    want = brute(rows, [(r.doc_id, r.quality) for r in half.collect()])
    assert np.allclose([(r.host_mean, r.path_mean, r.posterior) for r in rows], want, atol=1e-6)


def test_sites_change_verdicts(spark):
    """Documents between good and bad go with their site, and a document of its own does not make its site."""
    good = " ".join(f"word{k}" for k in range(80))
    bad = " ".join("#%d!" % k for k in range(80))
    between = lambda share: " ".join(f"word{k}" if k >= share * 2 else "#%d!" % k for k in range(80))
    rows, marks = [], []
    for k in range(800):
        host = "poor" if k % 2 else "fine"
        kind = (bad if k % 2 else good) if k % 10 < 8 else (good if k % 2 else bad)
        rows.append((k, kind + f" n{k}", host, "p"))
        marks.append((k, int(kind is good)))
    rows += [(2000 + k, between(k // 2) + f" n{k}", "poor" if k % 2 else "fine", "p") for k in range(80)]
    out = {r.doc_id: r for r in s.score(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), spark.createDataFrame(marks, "doc_id long, quality int")).collect()}
    assert out[0].path_mean > 0.7 > 0.3 > out[1].path_mean
    same = [(out[2000 + k], out[2001 + k]) for k in range(0, 80, 2)]
    assert all(a.posterior >= b.posterior for a, b in same)
    assert any(a.kept and not b.kept for a, b in same)


def test_address_parts(spark):
    rows = [("http://www.A.com/x/y?z",), ("https://u@b.org:8080",), (None,), ("no address",)]
    host, path = s.site_of_url(F.col("url"))
    got = [tuple(r) for r in spark.createDataFrame(rows, "url string").select(host, path).collect()]
    assert got == [("a.com", "x"), ("b.org", ""), (None, None), ("", "")]


def test_edge_cases(spark, edge, nothing):
    labels = spark.createDataFrame([(1, 0), (5, 1), (5, 0), (7, None), (None, 1), (6, 1)], "doc_id long, quality int")
    rows = s.score(edge, labels).collect()
    assert len(rows) == len(edge_rows()) and all(0 <= r.posterior <= 1 for r in rows)
    none = s.score(edge, labels.filter("doc_id = 99")).collect()
    assert {round(r.posterior, 6) for r in none} == {0.5}
    assert s.score(nothing, labels).count() == 0
