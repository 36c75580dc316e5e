"""Quality classifier: document evidence with empirical-Bayes priors of host and path.

A logistic classifier over text statistics gives every document its evidence. Two levels of sites, hosts and paths below
them, give priors: the mean quality of a host is shrunk toward that of all documents, that of a path toward its host's, each
with a strength found from the data (method of moments on the spread of the means beyond what their sizes
explain). The posterior of a document adds the prior odds of its path to the evidence; the means leave the document itself out.
Site means are grouped sums over all documents; labelled documents count with their label.

The classifier is fitted on at most ``FIT_ROWS`` labelled documents (smallest hash of the id first); everything else covers all rows.

Defined results: a null or empty text has no words and gets the evidence of such a text; null hosts and paths are
sites; several labels of one id count with their mean, null labels not at all; without labels of both kinds the evidence is neutral and every
document gets the prior 0.5; rows that repeat are judged alike. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pharmalith.llm.common import bounded_sample, with_columns
from pharmalith.llm.quality_rules import COUNTS, FEATURES, text_statistics
from pharmalith.session import through_storage, tune

FIT_ROWS = 50_000
RIDGE = 1.0
INPUTS = [*FEATURES, "x_length"]
LIMIT = 12.0
# Strengths of a prior, in documents, if the spread of the means gives none.
STRENGTH_LEAST, STRENGTH_MOST = 1.0, 1e6


def site_of_url(url: Column) -> tuple[Column, Column]:
    """Host without ``www.`` and first part of the path of an address, for tables that have one."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"^www\.", "")
    return host, F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]*)", 1)


def fit(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float] | None:
    """Means, spreads, weights (bias last) and the share of good rows; None unless there are both kinds."""
    if not rows:
        return None
    table = np.array(rows, float)
    x, y = table[:, :-1], table[:, -1]
    base = float(y.mean())
    if not 0 < base < 1:
        return None
    mean, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    z = np.c_[(x - mean) / spread, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    penalty = np.diag([RIDGE] * (z.shape[1] - 1) + [1e-6])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (y - p) - penalty @ w
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, grad)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return mean, spread, w, base


def logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(q / (1 - q))


def strength(groups: DataFrame, mean: str) -> float:
    """Documents that the prior of a level is worth, from groups with ``n``, ``s`` (sum), ``q`` (sum of squares).

    The variance of the true means is what the squared distances of the observed means from ``mean`` hold beyond the
    variance within the groups; the strength is the ratio of the variance within to it.
    """
    m = F.col("s") / F.col("n")
    row = groups.filter("n > 0").agg(
        F.sum("n").alias("n"),
        F.count("*").alias("g"),
        F.sum(F.col("q") - F.col("s") * m).alias("within"),
        F.sum(F.col("n") * F.pow(m - F.col(mean), 2)).alias("between"),
    ).first()
    if not row["n"] or row["n"] <= row["g"]:
        return STRENGTH_LEAST
    within = max(row["within"] / (row["n"] - row["g"]), 1e-9)
    true = (row["between"] - row["g"] * within) / row["n"]
    return STRENGTH_MOST if true <= 0 else min(STRENGTH_MOST, max(STRENGTH_LEAST, within / true))


def score(docs: DataFrame, labels: DataFrame, host_col: str = "source", path_col: str = "lang") -> DataFrame:
    """``doc_id, host, path, evidence, host_mean, path_mean, posterior, kept`` per document."""
    tune(docs.sparkSession)
    named = with_columns(docs, ["doc_id", host_col, path_col, "text"], {"doc_id": "long"}).toDF("doc_id", "source", "lang", "text")
    rows = text_statistics(named).select(
        "doc_id", F.col("source").alias("host"), F.col("lang").alias("path"), *COUNTS, *FEATURES, F.log1p("n_words").alias("x_length")
    )
    marks = (
        with_columns(labels, ["doc_id", "quality"], {}).filter("doc_id is not null and quality is not null")
        .groupBy(F.col("doc_id").cast("long").alias("m_id"))
        .agg(F.avg(F.col("quality").cast("double")).alias("label"))
    )
    rows = through_storage(rows.join(marks, rows["doc_id"] == marks["m_id"], "left").drop("m_id"), "evidence")
    labelled = rows.filter("label is not null")
    sample = bounded_sample(labelled, "doc_id", labelled.count(), FIT_ROWS)
    model = fit([tuple(r) for r in sample.select(*INPUTS, F.round("label").alias("label")).collect()])
    if model is None:
        evidence, base = F.lit(0.0), 0.5
    else:
        mean, spread, w, base = model
        evidence = F.lit(float(w[-1]))
        for k, c in enumerate(INPUTS):
            evidence = evidence + (F.col(c) - float(mean[k])) / float(spread[k]) * float(w[k])
        # The odds of the labelled sample are a prior of their own and go out again.
        evidence = evidence - float(np.log(base / (1 - base)))
    judged = rows.withColumn("evidence", F.least(F.greatest(evidence, F.lit(-LIMIT)), F.lit(LIMIT)))
    chance = 1 / (1 + F.exp(-(F.col("evidence") + logit(F.lit(base)))))
    judged = judged.withColumn("chance", F.coalesce("label", chance))
    paths = through_storage(
        judged.groupBy("host", "path").agg(
            F.count("*").alias("n"), F.sum("chance").alias("s"), F.sum(F.col("chance") * F.col("chance")).alias("q")
        ),
        "paths",
    )
    total = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    everywhere = total["s"] / total["n"] if total["n"] else 0.5
    hosts = paths.groupBy("host").agg(*[F.sum(c).alias(c) for c in "nsq"]).withColumn("all_mean", F.lit(float(everywhere)))
    k = strength(hosts, "all_mean")
    shrunk = lambda s, n, k, prior: (s + k * prior) / (n + k)
    hosts = through_storage(
        hosts.select(
            F.col("host").alias("h_host"), F.col("s").alias("h_s"), F.col("n").alias("h_n"), shrunk(F.col("s"), F.col("n"), k, F.lit(float(everywhere))).alias("host_mean")
        ),
        "hosts",
    )
    below = paths.join(hosts, F.col("host").eqNullSafe(F.col("h_host")))
    j = strength(below, "host_mean")
    priors = through_storage(
        below.select(F.col("host").alias("p_host"), F.col("path").alias("p_path"), "h_s", "h_n", F.col("s").alias("p_s"), F.col("n").alias("p_n")), "priors"
    )
    out = judged.join(priors, F.col("host").eqNullSafe(F.col("p_host")) & F.col("path").eqNullSafe(F.col("p_path")))
    # What a document's site says is said by the others there: its own chance would count twice beside its evidence.
    out = out.withColumn("host_mean", shrunk(F.col("h_s") - F.col("chance"), F.col("h_n") - 1, k, F.lit(float(everywhere))))
    out = out.withColumn("path_mean", shrunk(F.col("p_s") - F.col("chance"), F.col("p_n") - 1, j, F.col("host_mean")))
    posterior = 1 / (1 + F.exp(-(F.col("evidence") + logit(F.col("path_mean")))))
    return out.select("doc_id", "host", "path", "evidence", "host_mean", "path_mean", posterior.alias("posterior")).withColumn(
        "kept", F.col("posterior") >= 0.5
    )
