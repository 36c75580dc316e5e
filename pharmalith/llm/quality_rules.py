"""Quality rules: robust multivariate outliers among text statistics.

Each text is read once, whole, and becomes one narrow row of counts. Per language and source the minimum
covariance determinant estimate (location and scatter of the densest three quarters of the rows) is approached from three
starts by concentration steps, every one of which is a single grouped aggregation: squared distances fall into bins, each
bin carries its count, sums and products, and the bins up to three quarters of the rows make the next
estimate. The start that ends with the smallest determinant wins, and all rows that are no outliers to it make the final,
reweighted estimate. Only per-group matrices (6 x 6) are handled by numpy, three rows per group.

Defined results: a null or empty text has no words and fails the base rule. Null languages and sources are
groups of their own. Repeated rows are judged alike. Groups with fewer than ``MIN_GROUP`` usable rows are judged by the estimate of
all rows of their language, then of the whole table; only if that is smaller still there is no verdict, and its rows
are kept unless the base rule fails. Other columns of the input are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pharmalith.llm.common import keep_rows, row_hash, with_columns
from pharmalith.session import through_storage, tune

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_marks"]
FEATURES = ["x_word", "x_symbol", "x_upper", "x_mark", "x_repeat", "x_line"]
# Standard deviation that each feature has at least, against singular scatter: so small that every feature alone can go beyond the
# cutoff (x_repeat is at most 0.71 where the base rule passed, the shares at most 1).
FLOORS = [0.08, 0.06, 0.08, 0.08, 0.1, 0.12]
MIN_WORDS = 50
MIN_GROUP = 50
ALL = "all"
SUBSET = 0.75
STEPS = 3
# Rows up to this quantile make the last, reweighted estimate.
REWEIGHT_QUANTILE = 0.975
# A row is an outlier beyond this quantile of the chi-squared distribution, one degree per feature.
CUTOFF_QUANTILE = 1 - 1e-5

_SPACES = np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8)
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_MARKS = np.frombuffer(b"!?;:()[]{}=~^@/\\_+", np.uint8)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words found at least twice."""
    n = len(words)
    if n < 4:
        return 0
    h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    # Odd 64-bit multipliers make the order of the three words count.
    key = h[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ (h[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:] * np.uint64(0x165667B19E3779F9))
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    hit = np.zeros(n, bool)
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = np.flatnonzero(twice)
    for k in range(3):
        hit[at + k] = True
    return int(hit.sum())


def text_counts(text: str | None) -> tuple[int, ...]:
    """The values of ``COUNTS`` of one text."""
    if not text:
        return (0,) * len(COUNTS)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    points = len(raw) - int(seen[0x80:0xC0].sum())
    upper = int(seen[65:91].sum())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (
        len(words),
        points - int(seen[_SPACES].sum()),
        int(seen[_SYMBOLS].sum()),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        upper,
        upper + int(seen[97:123].sum()),
        int(seen[_MARKS].sum()),
    )


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([text_counts(t.as_py()) for t in batch.column("text")], np.int64).reshape(-1, len(COUNTS))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], *[pa.array(found[:, k]) for k in range(len(COUNTS))]],
            names=[*batch.schema.names[:-1], *COUNTS],
        )


def text_statistics(docs: DataFrame) -> DataFrame:
    """One narrow row per document: id, hash, language, source, counts, features and the base rule."""
    rows = with_columns(docs, ["doc_id", "lang", "source", "text"], {"doc_id": "long"}).select(
        F.col("doc_id").cast("long").alias("doc_id"), row_hash("text", "lang", "source").alias("k_hash"), "lang", "source", "text"
    )
    schema = "doc_id long, k_hash long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS)
    counted = rows.mapInArrow(_count_batches, schema)
    per_word = F.greatest(F.col("n_words"), F.lit(1))

    def share(c: str, of: Column) -> Column:
        return F.sqrt(F.col(c) / of)

    return counted.select(
        "*",
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        F.log((F.col("word_chars") + 1) / per_word).alias("x_word"),
        share("n_symbols", per_word).alias("x_symbol"),
        share("n_upper", F.greatest(F.col("n_letters"), F.lit(1))).alias("x_upper"),
        share("n_marks", per_word).alias("x_mark"),
        share("n_repeat_words", per_word).alias("x_repeat"),
        share("n_dup_lines", F.greatest(F.col("n_lines"), F.lit(1))).alias("x_line"),
    )


def assign_pools(rows: DataFrame, min_group: int) -> DataFrame:
    """Language and source with the pool whose estimate judges them: their own, that of the whole language, or that of all rows."""
    sites = rows.filter("not base_failed").groupBy("lang", "source").agg(F.count("*").alias("n"))
    by_lang = sites.groupBy(F.col("lang").alias("l_lang")).agg(F.sum("n").alias("n_lang"))
    joined = sites.join(by_lang, F.col("lang").eqNullSafe(F.col("l_lang")), "left")
    level = F.when(F.col("n") >= min_group, "source").when(F.col("n_lang") >= min_group, "lang").otherwise("all")
    return joined.select("lang", "source", F.when(level == "source", _of_source()).when(level == "lang", _of_lang()).otherwise(ALL).alias("pool"))


def _of_source() -> Column:
    return F.to_json(F.struct(F.lit("s").alias("k"), "lang", "source"))


def _of_lang() -> Column:
    return F.to_json(F.struct(F.lit("l").alias("k"), "lang"))


def members(rows: DataFrame, pools: DataFrame) -> DataFrame:
    """``pool`` and features: every usable row once for each pool it counts in, of those that judge some row. A pool of a language holds
    all rows of the language, so that a small source is judged by its large neighbours too."""
    usable = rows.filter("not base_failed").select(F.explode(F.array(_of_source(), _of_lang(), F.lit(ALL))).alias("pool"), *FEATURES)
    return usable.join(pools.select("pool").distinct(), "pool", "left_semi")


def _binned_median(rows: DataFrame, values: list[Column]) -> DataFrame:
    """Median of each value per pool, to a 512th, from counts of bins."""
    long = rows.select("pool", F.posexplode(F.array(*[F.round(v * 512).cast("long") for v in values])).alias("dim", "bin"))
    bins = long.groupBy("pool", "dim", "bin").agg(F.count("*").alias("n"))
    w = Window.partitionBy("pool", "dim")
    ranked = bins.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("total", F.sum("n").over(w))
    mid = ranked.filter("2 * upto >= total").groupBy("pool", "dim").agg(F.min("bin").alias("bin"), F.max("total").alias("total"))
    return mid.groupBy("pool").agg(
        F.max("total").alias("n"),
        F.transform(F.array_sort(F.collect_list(F.struct("dim", "bin"))), lambda x: x["bin"] / 512.0).alias("mid"),
    )


def _median_distance(rows: DataFrame) -> DataFrame:
    """Median of the squared distance per pool, to a 64th of its size: logarithmic bins, so that far rows make few of them."""
    bins = rows.select("pool", F.floor(F.log2(_distance() + 1e-6) * 64).alias("bin")).groupBy("pool", "bin").agg(F.count("*").alias("n"))
    w = Window.partitionBy("pool")
    ranked = bins.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("total", F.sum("n").over(w))
    return ranked.filter("2 * upto >= total").groupBy("pool").agg(F.pow(F.lit(2.0), (F.min("bin") + 0.5) / 64).alias("middle"))


def _precision(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Inverse and log determinant of each scatter, no direction of which is narrower than the floors."""
    d = len(FEATURES)
    floor = np.diag(np.square(FLOORS))
    for f in frames:
        scatter = [np.asarray(c, float).reshape(d, d) + floor for c in f["cov"]]
        yield pd.DataFrame(
            {
                "pool": f["pool"],
                "start": f["start"],
                "mean": f["mean"],
                "prec": [np.linalg.inv(c).ravel() for c in scatter],
                "det": [float(np.linalg.slogdet(c)[1]) for c in scatter],
            }
        )


def _estimate(table: DataFrame) -> DataFrame:
    return through_storage(table.mapInPandas(_precision, "pool string, start int, mean array<double>, prec array<double>, det double"), "mcd")


def _distance() -> Column:
    d = len(FEATURES)
    off = [F.col(x) - F.col("mean")[i] for i, x in enumerate(FEATURES)]
    terms = []
    for i in range(d):
        inner = F.col("prec")[i * d + i] * off[i]
        for j in range(i + 1, d):
            inner = inner + 2 * F.col("prec")[i * d + j] * off[j]
        terms.append(off[i] * inner)
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return F.greatest(total, F.lit(0.0))


_PAIRS = [(i, j) for i in range(len(FEATURES)) for j in range(i, len(FEATURES))]
_SUMS = ["n", *[f"s{i}" for i in range(len(FEATURES))], *[f"p{i}_{j}" for i, j in _PAIRS]]


def _moments() -> list[Column]:
    """Count, sums and products of the features."""
    return [
        F.count("*").alias("n"),
        *[F.sum(x).alias(f"s{i}") for i, x in enumerate(FEATURES)],
        *[F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"p{i}_{j}") for i, j in _PAIRS],
    ]


def _location(sums: DataFrame) -> DataFrame:
    """Mean and scatter of grouped moments."""
    d = len(FEATURES)

    def cov(i: int, j: int) -> Column:
        i, j = min(i, j), max(i, j)
        return F.col(f"p{i}_{j}") / F.col("n") - F.col(f"s{i}") / F.col("n") * F.col(f"s{j}") / F.col("n")

    return sums.select(
        "pool",
        "start",
        F.array(*[F.col(f"s{i}") / F.col("n") for i in range(d)]).alias("mean"),
        F.array(*[cov(i, j) for i in range(d) for j in range(d)]).alias("cov"),
    )


def _concentrate(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """Mean and scatter of the bins of distance that hold the nearest share of each pool, from each start."""
    near = rows.join(estimate, "pool").withColumn("bin", F.floor(F.log2(_distance() + 1e-3) * 16))
    bins = near.groupBy("pool", "start", "bin").agg(*_moments())
    w = Window.partitionBy("pool", "start")
    upto = F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    inside = bins.withColumn("before", F.coalesce(upto, F.lit(0))).withColumn("total", F.sum("n").over(w))
    return _location(inside.filter(F.col("before") < SUBSET * F.col("total")).groupBy("pool", "start").agg(*[F.sum(c).alias(c) for c in _SUMS]))


def starts(rows: DataFrame, min_group: int) -> DataFrame:
    """Three first estimates per pool, all around the medians: median deviations alone, and with the correlations of squashed
    values (hyperbolic tangent) and of directions (spatial signs), both of which far rows cannot pull far."""
    d = len(FEATURES)
    mid = through_storage(_binned_median(rows, [F.col(x) for x in FEATURES]).filter(F.col("n") >= min_group), "mcd")
    away = [F.abs(F.col(x) - F.col("mid")[i]) for i, x in enumerate(FEATURES)]
    spread = _binned_median(rows.join(mid.select("pool", "mid"), "pool"), away).select("pool", F.col("mid").alias("mad"))
    # 1.4826 turns a median deviation into a standard deviation.
    width = F.array(*[F.greatest(1.4826 * F.col("mad")[i], F.lit(FLOORS[i])) for i in range(d)])
    first = through_storage(mid.select("pool", F.col("mid").alias("mean")).join(spread, "pool").select("pool", "mean", width.alias("width")), "mcd")
    scaled = rows.join(first, "pool").select("pool", *[((F.col(x) - F.col("mean")[i]) / F.col("width")[i]).alias(f"z{i}") for i, x in enumerate(FEATURES)])
    squares = F.lit(0.0)
    for i in range(d):
        squares = squares + F.col(f"z{i}") * F.col(f"z{i}")
    pulled = scaled.withColumn("far", F.greatest(F.sqrt(squares), F.lit(1e-9)))
    together = pulled.groupBy("pool").agg(
        *[F.corr(F.tanh(f"z{i}"), F.tanh(f"z{j}")).alias(f"t{i}_{j}") for i, j in _PAIRS if i < j],
        *[F.sum(F.col(f"z{i}") * F.col(f"z{j}") / (F.col("far") * F.col("far"))).alias(f"u{i}_{j}") for i, j in _PAIRS],
    )

    def entry(kind: int, i: int, j: int) -> Column:
        low, high = min(i, j), max(i, j)
        if i == j:
            share = F.lit(1.0)
        elif kind == 0:
            share = F.lit(0.0)
        elif kind == 1:
            share = F.nanvl(F.coalesce(F.col(f"t{low}_{high}"), F.lit(0.0)), F.lit(0.0))
        else:
            both = F.sqrt(F.col(f"u{i}_{i}") * F.col(f"u{j}_{j}"))
            share = F.when(both > 0, F.col(f"u{low}_{high}") / both).otherwise(F.lit(0.0))
        # Less than one, so that the scatter has an inverse.
        return (share if i == j else 0.99 * share) * F.col("width")[i] * F.col("width")[j]

    kinds = [F.array(*[entry(kind, i, j) for i in range(d) for j in range(d)]) for kind in range(3)]
    return first.join(together, "pool").select("pool", "mean", F.posexplode(F.array(*kinds)).alias("start", "cov")).select("pool", "start", "mean", "cov")


def _scaled(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """The estimate with ``scale``, which puts the median distance where it belongs."""
    d = len(FEATURES)
    expected = d * (1 - 2 / (9 * d)) ** 3  # median of a chi-squared variable with d degrees
    middle = _median_distance(rows.join(estimate, "pool"))
    return through_storage(estimate.join(middle.select("pool", F.greatest(F.col("middle") / expected, F.lit(1.0)).alias("scale")), "pool"), "mcd")


def mcd_estimates(rows: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """Per pool: ``mean``, ``prec`` (inverse scatter) and ``scale``.

    ``rows`` has a pool and the features, base failures left out. From each start the densest subset is approached by concentration
    steps; the one of smallest determinant wins, and the rows it does not reject make the final estimate.
    """
    estimate = _estimate(starts(rows, min_group))
    for _ in range(STEPS):
        estimate = _estimate(_concentrate(rows, estimate))
    least = estimate.groupBy("pool").agg(F.min(F.struct("det", "start", "mean", "prec")).alias("best")).select("pool", "best.*")
    raw = _scaled(rows, least)
    near = rows.join(raw, "pool").filter(_distance() / F.col("scale") <= cutoff(REWEIGHT_QUANTILE))
    return _scaled(rows, _estimate(_location(near.groupBy("pool", "start").agg(*_moments()))))


def cutoff(quantile: float = CUTOFF_QUANTILE) -> float:
    """Squared distance of the quantile, by Wilson and Hilferty."""
    d = len(FEATURES)
    return d * (1 - 2 / (9 * d) + NormalDist().inv_cdf(quantile) * math.sqrt(2 / (9 * d))) ** 3


def judge(docs: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """Counts and verdict per document: ``doc_id``, ``k_hash``, counts, ``base_failed``, ``distance``, ``kept``."""
    tune(docs.sparkSession)
    rows = through_storage(text_statistics(docs), "stats")
    pools = through_storage(assign_pools(rows, min_group), "pools")
    keyed = rows.join(
        pools.select(F.col("lang").alias("p_lang"), F.col("source").alias("p_source"), "pool"),
        F.col("lang").eqNullSafe(F.col("p_lang")) & F.col("source").eqNullSafe(F.col("p_source")),
        "left",
    ).drop("p_lang", "p_source")
    usable = through_storage(members(rows, pools), "usable")
    estimate = mcd_estimates(usable, min_group)
    judged = keyed.join(estimate, "pool", "left").withColumn("distance", _distance() / F.col("scale"))
    return judged.select(
        "doc_id",
        "k_hash",
        *COUNTS,
        "base_failed",
        F.col("distance"),
        (~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff(), F.lit(True))).alias("kept"),
    )


def keep_good(docs: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """The rows of ``docs`` that pass, with the columns they came with."""
    kept = judge(docs, min_group).filter("kept").select(F.col("doc_id").alias("k_id"), "k_hash")
    return keep_rows(docs, kept, "doc_id", ["text", "lang", "source"])
