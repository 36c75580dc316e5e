"""A stored index for substring search: grams of texts, kept by the batch of rows they come from.

Layout below the root, Parquet, valid once Spark's commit has left its mark: ``batches/<name>/grams/bucket=<b>`` with
``gram`` (hash of a substring of ``GRAM`` characters) and ``text_id``, sorted by gram; ``batches/<name>/rows/bucket=<b>`` with the
rows as they came and ``text_id``, sorted by it. A batch is one delivered file or any other part of a table: it is
added, replaced or removed without touching the others. A search reads the buckets of its own grams, then the buckets of the texts
found, and tries each candidate; so its answer is that of a scan. Distinct texts are indexed once; buckets are rebalanced when they
are written, so a frequent gram or a text that many rows share is many files.

Terms shorter than a gram have nothing to look up here and are searched without the index.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pharmalith.functions.text import found_in, is_like_pattern
from pharmalith.operators.matching import PAIR_TERMS, _grams, match_contains
from pharmalith.session import _folder, through_storage

GRAM = 3
BUCKETS = 64
# Distinct values that may be listed in a filter, so that the scan skips buckets and row groups.
FEW = 4096

_ID, _PATTERN = "text_id", "_pattern"


def literals(pattern: str) -> list[str] | None:
    """Texts one of which stands in every match of a pattern; None if the pattern does not tell.

    Only what surely stands there is taken: groups, classes and optional characters are passed over, each alternative gives
    its longest run of plain characters.
    """
    if "(?" in pattern or "\\Q" in pattern:
        return None
    found, runs, run, depth, k = [], [], "", 0, 0

    def close() -> str:
        if run:
            runs.append(run)
        return ""

    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            k += 1
            if k >= len(pattern):
                return None
            c = pattern[k]
            if not c.isalnum() and not depth:
                run += c
            elif not depth:
                if c not in "dDwWsSbBtnr":
                    return None
                run = close()
        elif c == "[":
            end = k + 1
            while end < len(pattern) and (pattern[end] != "]" or end == k + 1 or (pattern[k + 1] == "^" and end == k + 2)):
                if pattern[end] == "[":
                    return None
                end += 2 if pattern[end] == "\\" else 1
            k, run = end, run if depth else close()
        elif c == "(":
            run = run if depth else close()
            depth += 1
        elif c == ")":
            depth -= 1
        elif depth:
            pass
        elif c == "|":
            run = close()
            found.append(max(runs, key=len, default=""))
            runs = []
        elif c in "*?{":
            # The character before it may be missing.
            run = run[:-1]
            run = close()
            if c == "{":
                end = pattern.find("}", k)
                if end < 0:
                    return None
                k = end
        elif c in "+.^$":
            run = close()
        else:
            run += c
        k += 1
    run = close()
    found.append(max(runs, key=len, default=""))
    return found if depth == 0 and all(len(x) >= GRAM for x in found) else None


@dataclass(frozen=True)
class TextIndex:
    """An index over the column ``text`` of rows, in one letter case unless ``ignore_case`` is off."""

    spark: SparkSession
    root: str
    text: str
    ignore_case: bool = True

    def _fold(self, c: Column) -> Column:
        return F.lower(c) if self.ignore_case else c

    def _path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/batches/{name}"

    def add(self, name: str, rows: DataFrame) -> None:
        """Index the rows of a batch; a batch of the same name is replaced. Rows without text are never found and left out."""
        if "/" in name or name.startswith(("_", ".")):
            raise ValueError(f"no batch name: {name!r}")
        folded = self._fold(F.col(self.text))
        kept = rows.filter(F.col(self.text).isNotNull()).withColumn(_ID, F.xxhash64(folded))
        texts = kept.select(folded.alias("_text"), _ID).distinct()
        grams = texts.select(F.explode(F.transform(_grams(F.col("_text"), GRAM), lambda g: F.xxhash64(g))).alias("gram"), _ID)
        self.remove(name)
        written = kept.withColumn("bucket", F.lit(0)).schema.json()
        self.spark.range(1).select(F.lit(written).alias("value")).write.text(f"{self._path(name)}/schema")
        # The grams are written last: a batch counts as there once they are.
        for part, df, key in (("rows", kept, _ID), ("grams", grams, "gram")):
            dealt = df.withColumn("bucket", F.pmod(F.col(key), F.lit(BUCKETS)).cast("int")).hint("rebalance", "bucket")
            dealt.sortWithinPartitions("bucket", key).write.partitionBy("bucket").parquet(f"{self._path(name)}/{part}")

    def remove(self, name: str) -> None:
        fs, folder = _folder(self.spark, self._path(name))
        fs.delete(folder, True)

    def batches(self) -> list[str]:
        """Names of the batches that are there."""
        fs, folder = _folder(self.spark, f"{self.root.rstrip('/')}/batches")
        if not fs.exists(folder):
            return []
        names = sorted(s.getPath().getName() for s in fs.listStatus(folder))
        return [n for n in names if fs.exists(_folder(self.spark, f"{self._path(n)}/grams/_SUCCESS")[1])]

    def _read(self, part: str) -> DataFrame:
        read = []
        for name in self.batches():
            # A batch without rows has no files, so its columns are written beside it.
            schema = f"gram bigint, {_ID} bigint, bucket int"
            if part == "rows":
                schema = StructType.fromJson(json.loads(self.spark.read.text(f"{self._path(name)}/schema").first()[0]))
            read.append(self.spark.read.schema(schema).parquet(f"{self._path(name)}/{part}"))
        if not read:
            raise ValueError(f"nothing is indexed in {self.root}")
        return reduce(DataFrame.unionByName, read)

    def rows(self) -> DataFrame:
        """All indexed rows."""
        return self._read("rows").drop(_ID, "bucket")

    def _at(self, df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
        """Rows of a stored part whose key is wanted; few keys are listed, so that other buckets and row groups are not read."""
        some = [r[0] for r in wanted.select(key).distinct().limit(FEW + 1).collect()]
        if len(some) > FEW:
            return df.join(wanted, key)
        listed = df.filter(F.col("bucket").isin(sorted({x % BUCKETS for x in some})) & F.col(key).isin(some)) if some else df.filter(F.lit(False))
        return listed.join(wanted, key)

    def _candidates(self, terms: DataFrame) -> DataFrame:
        """``_term, text_id`` of texts that hold the rarest gram of a folded term. ``terms`` has ``_term`` and ``_piece``, the part of it
        that is looked up."""
        asked = terms.select("_term", F.explode(F.transform(_grams(F.col("_piece"), GRAM), lambda g: F.xxhash64(g))).alias("gram"))
        asked = through_storage(asked, "asked-grams")
        held = through_storage(self._at(self._read("grams"), "gram", asked.select("gram").distinct()).select("gram", _ID), "postings")
        often = held.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
        # A gram no text holds is the rarest of all.
        counted = asked.join(often, "gram", "left").select("_term", "gram", F.coalesce("n", F.lit(0)).alias("n"))
        rarest = counted.groupBy("_term").agg(F.min(F.struct("n", "gram")).alias("best")).select("_term", F.col("best.gram").alias("gram"))
        return held.join(rarest, "gram").select("_term", _ID).distinct()

    def search(self, requests: DataFrame, term: str) -> DataFrame:
        """Every request beside the rows whose text contains its term; ``%`` and ``_`` are wildcards. All columns of both sides."""
        stored = self._read("rows")
        columns = [c for c in stored.columns if c not in (_ID, "bucket")]
        asked = through_storage(requests.filter(F.col(term).isNotNull()).withColumn("_term", self._fold(F.col(term))), "asked")
        wild = is_like_pattern(F.col("_term"))
        pieces = F.when(wild, F.split("_term", "[%_]")).otherwise(F.array("_term"))
        longest = F.array_max(F.transform(pieces, lambda p: F.struct(F.length(p).alias("n"), p.alias("piece")))).piece
        terms = through_storage(asked.select("_term").distinct().select("_term", longest.alias("_piece")), "terms")
        hit = found_in(self._fold(F.col(self.text)), F.col("_term"), wild)
        long = through_storage(self._candidates(terms.filter(F.length("_piece") >= GRAM)), "candidates")
        parts = [self._at(stored, _ID, long).filter(hit)]
        short = terms.filter(F.length("_piece") < GRAM)
        if not short.isEmpty():
            # Counted there, and tried on rows, on distinct texts or looked up by shorter grams.
            asked_short = short.select(F.col("_term").alias("_asked"))
            tried = match_contains(asked_short, "_asked", stored.select(*columns), self.text, self.ignore_case)
            parts.append(tried.withColumnRenamed("_asked", "_term"))
        found = reduce(DataFrame.unionByName, [p.select("_term", *columns) for p in parts])
        return found.join(asked, "_term").select(*requests.columns, *columns)

    def search_patterns(self, requests: DataFrame, pattern: str) -> DataFrame:
        """Every request beside the rows whose folded text matches its regular expression.

        A pattern is looked up by texts that each match of it holds; only patterns that do not tell any are tried on every row, in
        blocks of about ``PAIR_TERMS``.
        """

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(map(literals, texts), pa.list_(pa.string()))], [_PATTERN, "literals"])

        stored = self._read("rows")
        columns = [c for c in stored.columns if c not in (_ID, "bucket")]
        asked = requests.filter(F.col(pattern).isNotNull()).withColumn(_PATTERN, F.col(pattern))
        told = through_storage(asked.select(_PATTERN).distinct().mapInArrow(run, f"{_PATTERN} string, literals array<string>"), "patterns")
        needed = through_storage(told.select(_PATTERN, F.explode("literals").alias("_term")).distinct(), "literals")
        terms = needed.select("_term").distinct().select("_term", F.col("_term").alias("_piece"))
        known = through_storage(self._candidates(terms).join(needed, "_term").select(_PATTERN, _ID).distinct(), "candidates")
        hit = F.rlike(self._fold(F.col(self.text)), F.col(_PATTERN))
        parts = [self._at(stored, _ID, known).filter(hit)]
        mute = told.filter("literals is null").select(_PATTERN)
        blocks = -(-mute.count() // PAIR_TERMS)
        for block in range(blocks):
            some = mute.filter(F.pmod(F.xxhash64(_PATTERN), F.lit(blocks)) == block)
            parts.append(stored.join(F.broadcast(some), hit))
        found = reduce(DataFrame.unionByName, [p.select(_PATTERN, *columns) for p in parts])
        return found.join(asked, _PATTERN).select(*requests.columns, *columns)
