"""Substring search of many terms in many texts.

The match is not an equality, so Spark can only run it as a nested loop. How it is done
depends on the number of distinct terms, which is counted first:

``scan``   few terms are broadcast and tried on every row as it is read;
``pairs``  more terms are broadcast and tried once per distinct text, and the pairs found
           are joined back to the rows;
``grams``  any number of terms: a text that contains a term also contains every short
           substring (gram) of it, so each term is looked up by its rarest gram in an
           equi-join, and the candidates are verified.

All three give the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pharmalith.functions.text import found_in, is_like_pattern
from pharmalith.session import through_storage

SCAN_TERMS = 16
PAIR_TERMS = 256
TERM_BYTES = 1 << 20
# A term is looked up by a gram of the largest of these sizes that fits into it.
GRAM_SIZES = (0, 1, 2, 3, 6, 12)


def choose_strategy(terms: DataFrame, term: str = "_term") -> str:
    """Pick by the size of the distinct terms; reads at most one more than may be broadcast."""
    n, size = (
        terms.select(F.octet_length(term).alias("n"))
        .limit(PAIR_TERMS + 1)
        .agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0)))
        .first()
    )
    if n > PAIR_TERMS or size > TERM_BYTES:
        return "grams"
    return "scan" if n <= SCAN_TERMS else "pairs"


def match_contains(
    requests: DataFrame,
    term: str,
    rows: DataFrame,
    text: str,
    ignore_case: bool = True,
    strategy: str = "auto",
) -> DataFrame:
    """Join every request to the rows whose ``text`` contains its ``term``.

    ``%`` and ``_`` in a term act as wildcards. All columns of both sides are kept.
    """
    shared = set(requests.columns) & set(rows.columns)
    if shared:
        raise ValueError(f"columns on both sides: {sorted(shared)}")
    fold = F.lower if ignore_case else (lambda c: c)
    asked = requests.filter(F.col(term).isNotNull()).withColumn("_term", fold(F.col(term)))
    texts = rows.filter(F.col(text).isNotNull()).withColumn("_text", fold(F.col(text)))
    terms = asked.select("_term").distinct().withColumn("_wild", is_like_pattern(F.col("_term")))
    if strategy == "auto":
        # Stored, as they are counted first and then used.
        terms = through_storage(terms, "terms")
        strategy = choose_strategy(terms)
    hit = found_in(F.col("_text"), F.col("_term"), F.col("_wild"))
    if strategy == "scan":
        found = texts.join(F.broadcast(terms), hit)
    elif strategy == "pairs":
        found = texts.join(_pair(terms, texts, hit), "_text")
    elif strategy == "grams":
        found = texts.join(_pair_by_gram(terms, texts, hit), "_text")
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    return found.join(asked, "_term").select(*requests.columns, *rows.columns)


def _pair(terms: DataFrame, texts: DataFrame, hit: Column) -> DataFrame:
    """Pairs of terms and distinct texts; the terms have been counted."""
    return texts.select("_text").distinct().join(F.broadcast(terms), hit).select("_term", "_text")


def _cut(chars: Column, starts: Column, size: Column) -> Column:
    # The characters are an array of one element that the inner function sees, so they are extracted once.
    pieces = F.transform(F.array(chars), lambda c: F.transform(starts, lambda i: F.array_join(F.slice(c, i, size), "")))
    return F.flatten(pieces)


def _grams(text: Column, size: Column | int) -> Column:
    """Distinct substrings of one size; cut from the array of characters, which takes time linear in the text."""
    size = F.lit(size) if isinstance(size, int) else size
    chars = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    starts = F.sequence(F.lit(1), F.length(text) - size + 1)
    return (
        F.when(size == 0, F.array(F.lit("")))
        .when(F.length(text) >= size, F.array_distinct(_cut(chars, starts, size)))
        .otherwise(F.array().cast("array<string>"))
    )


def _pair_by_gram(terms: DataFrame, texts: DataFrame, hit: Column) -> DataFrame:
    """Pairs of terms and distinct texts, found by equality on one gram."""
    pieces = F.when(F.col("_wild"), F.split("_term", "[%_]")).otherwise(F.array("_term"))
    longest = F.array_max(F.transform(pieces, lambda p: F.struct(F.length(p).alias("n"), p.alias("piece"))))
    fitting = F.filter(F.array(*map(F.lit, GRAM_SIZES)), lambda g: g <= F.col("_longest.n"))
    terms = (
        terms.withColumn("_longest", longest)
        .withColumn("_size", F.array_max(fitting))
        .select("_term", "_wild", "_size", F.col("_longest.piece").alias("_piece"))
    )
    # At most one row per gram size: which sizes the texts have to be cut into.
    sizes = sorted(r[0] for r in terms.select("_size").distinct().collect()) or [GRAM_SIZES[-1]]
    hashed = lambda c: F.xxhash64(c)
    asked = terms.select("_term", "_wild", F.explode(F.transform(_grams(F.col("_piece"), F.col("_size")), hashed)).alias("_gram"))
    # Texts and grams travel as hashes: texts join again where the candidates are verified, so equal hashes do no harm.
    # Only grams of some term leave the task that cut them.
    held = (
        texts.select("_text").distinct()
        .select(F.xxhash64("_text").alias("_id"), F.explode(F.transform(F.concat(*[_grams(F.col("_text"), n) for n in sizes]), hashed)).alias("_gram"))
        .join(asked.select("_gram").distinct(), "_gram", "left_semi")
    )
    how_many = held.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    rarest = (
        asked.join(how_many, "_gram")
        .groupBy("_term", "_wild")
        .agg(F.min(F.struct(F.col("_n").alias("n"), F.col("_gram").alias("gram"))).alias("_best"))
        .select("_term", "_wild", F.col("_best.gram").alias("_gram"))
    )
    # Both joins are inner, so adaptive execution splits a gram that sits in a third of all texts.
    candidates = held.join(rarest, "_gram").select("_id", "_term", "_wild").distinct()
    known = texts.select("_text").distinct().withColumn("_id", F.xxhash64("_text"))
    return known.join(candidates, "_id").filter(hit).select("_term", "_text")
