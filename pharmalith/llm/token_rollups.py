"""Token counts as rollups that are kept up to date by signed changes.

Documents are counted once by each version of a tokenizer. Changes are inserts (+), deletes (-) and revisions
(- the old count, + the new one); a batch of changes is summed by source, language and tokenizer version and committed
under its own name. A batch that is committed again changes nothing; a batch that broke off before its end is
not seen and is written anew. Totals are the sum of all committed batches, or of the newest compaction and
the batches after it, so keeping them up to date costs as much as the change, not the corpus.

Layout below the root folder: ``batches/<name>/`` and ``compactions/<number>/{totals,names}/``, Parquet, each valid
once Spark's commit has left its ``_SUCCESS`` mark.

Defined results: null or empty texts have no tokens; null sources and languages are keys; repeated rows count each; totals
that come to no documents and no tokens are left out; an empty batch can be committed. Other columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pharmalith.llm.common import row_hash, with_columns

KEYS = ["source", "lang", "version"]
TOTALS = ["documents", "tokens"]
SCHEMA = "source string, lang string, version string, documents long, tokens long"

# Fixed value: how byte-level BPE vocabularies cut texts before they merge.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_encoders: dict[str, object] = {}


def encoder(path: str):
    """A function from texts to token counts, by the file's kind; kept for the life of the process."""
    if path not in _encoders:
        if path.endswith(".tiktoken"):
            import tiktoken

            with open(path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            own = tiktoken.Encoding(path, pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
            _encoders[path] = lambda texts: [len(own.encode_ordinary(t)) for t in texts]
        elif path.endswith(".json"):
            from tokenizers import Tokenizer

            whole = Tokenizer.from_file(path)
            whole.encode_special_tokens = True
            _encoders[path] = lambda texts: [len(e.ids) for e in whole.encode_batch(texts, add_special_tokens=False)]
        else:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _encoders[path] = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    return _encoders[path]


def count_tokens(docs: DataFrame, tokenizers: dict[str, str], keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep`` with ``version, tokens``: one row per document and tokenizer version (name to vocabulary file).

    The files have to be readable at these paths on every executor.
    """
    kept = docs.select(*[F.col(f"`{c}`") for c in keep])
    schema = kept.schema.add("version", "string").add("tokens", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            for version, path in tokenizers.items():
                count = encoder(path)
                n = np.array([x for at in range(0, len(texts), 256) for x in count(texts[at : at + 256])], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[1:], pa.array([version] * len(texts), pa.string()), pa.array(n)], [*batch.schema.names[1:], "version", "tokens"]
                )

    return docs.select(F.col(f"`{text_col}`"), *[F.col(f"`{c}`") for c in keep]).mapInArrow(run, schema)


def inserts(counted: DataFrame) -> DataFrame:
    return counted.select(*KEYS, F.lit(1).cast("long").alias("documents"), "tokens")


def deletes(counted: DataFrame) -> DataFrame:
    return counted.select(*KEYS, F.lit(-1).cast("long").alias("documents"), (-F.col("tokens")).alias("tokens"))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changes of documents whose counts, sources, languages or versions are other than before."""
    return deletes(old).unionByName(inserts(new))


class Rollup:
    """Totals by source, language and tokenizer version below one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path

    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _done(self, path: str) -> bool:
        return self._fs().exists(self._path(f"{path}/_SUCCESS"))

    def _names(self, folder: str) -> list[str]:
        fs, path = self._fs(), self._path(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def commit(self, name: str, changes: DataFrame) -> bool:
        """Add a batch of signed changes (``KEYS`` and ``TOTALS``); False if it was committed before."""
        if not name or not all(c.isalnum() or c in "-." for c in name) or name.startswith("."):
            raise ValueError(f"a batch is named by letters, digits, '-' and '.': {name!r}")
        path = f"{self.root}/batches/{name}"
        if self._done(path) or name in self._compacted():
            return False
        summed = changes.groupBy(*KEYS).agg(*[F.sum(c).cast("long").alias(c) for c in TOTALS])
        summed.write.mode("overwrite").parquet(path)
        return True

    def _compactions(self) -> list[int]:
        return sorted(int(n) for n in self._names("compactions") if self._done(f"{self.root}/compactions/{n}/names"))

    def _compacted(self) -> set[str]:
        """Names of the batches in the newest compaction; one per batch ever committed."""
        numbers = self._compactions()
        if not numbers:
            return set()
        return {r.name for r in self.spark.read.parquet(f"{self.root}/compactions/{numbers[-1]}/names").collect()}

    def _parts(self) -> tuple[DataFrame, list[str]]:
        numbers, old = self._compactions(), self._compacted()
        new = [n for n in self._names("batches") if n not in old and self._done(f"{self.root}/batches/{n}")]
        paths = [f"{self.root}/batches/{n}" for n in new]
        if numbers:
            paths.append(f"{self.root}/compactions/{numbers[-1]}/totals")
        rows = self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)
        return rows, sorted(old | set(new))

    def totals(self) -> DataFrame:
        """``KEYS`` and ``TOTALS`` over all committed batches."""
        rows, _ = self._parts()
        return rows.groupBy(*KEYS).agg(*[F.sum(c).cast("long").alias(c) for c in TOTALS]).filter("documents <> 0 or tokens <> 0")

    def compact(self) -> None:
        """Write the totals as one part; batches that went into it are known by name and cannot be committed again."""
        rows, names = self._parts()
        path = f"{self.root}/compactions/{(self._compactions() or [0])[-1] + 1}"
        rows.groupBy(*KEYS).agg(*[F.sum(c).cast("long").alias(c) for c in TOTALS]).write.mode("overwrite").parquet(f"{path}/totals")
        # The names are written last and make the compaction valid.
        self.spark.createDataFrame([(n,) for n in names], "name string").coalesce(1).write.mode("overwrite").parquet(f"{path}/names")


def without_repeated_lines(text):
    """A text whose later copies of a line are dropped."""
    return F.array_join(F.array_distinct(F.split(text, "\n")), "\n")


def crawl_changes(docs: DataFrame, tokenizers: dict[str, str], store) -> dict[str, DataFrame]:
    """Three batches of changes of a corpus: all documents come in; later copies of equal texts go; texts lose
    repeated lines and are counted anew.

    ``store(df, name)`` writes narrow rows once for all batches.
    """
    rows = with_columns(docs, ["doc_id", "source", "lang", "text"], {}).withColumn("k", row_hash("text"))
    slim = without_repeated_lines(F.col("text"))
    # One pass over the texts: each as it is and, where it differs, without repeated lines.
    forms = F.array(F.struct(F.lit("old").alias("form"), F.col("text").alias("t")), F.struct(F.lit("new").alias("form"), slim.alias("t")))
    both = rows.select("doc_id", "source", "lang", "k", F.explode(F.filter(forms, lambda x: (x["form"] == "old") | (x["t"] != F.col("text")))).alias("f"))
    keep = ["doc_id", "source", "lang", "k", "form"]
    counted = store(count_tokens(both.select("doc_id", "source", "lang", "k", "f.form", F.col("f.t").alias("text")), tokenizers, keep), "tokens")
    old, new = counted.filter("form = 'old'"), counted.filter("form = 'new'")
    # The copy that stays is the one of the smallest id, null ids last.
    first = old.groupBy("k").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("first")).select(
        F.col("k").alias("f_k"), F.col("first.doc_id").alias("f_id")
    )
    same = F.col("doc_id").eqNullSafe(F.col("f_id"))
    gone = old.join(first, F.col("k") == F.col("f_k")).filter(~same)
    stays = lambda df: df.join(first, F.col("k") == F.col("f_k")).filter(same)
    changed = stays(new).select("doc_id", "k", "version").distinct().toDF("c_id", "c_k", "c_version")
    before = stays(old).join(
        changed, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("k") == F.col("c_k")) & (F.col("version") == F.col("c_version")), "left_semi"
    )
    return {"crawl": inserts(old), "copies": deletes(gone), "lines": revisions(before, stays(new))}
