"""Sharding by a two-pass external shuffle.

Pass one scatters records into memory-sized buckets by a seeded hash of the whole row; one bucket is one task of the
second pass. Pass two puts the bucket into a fixed order, so that a task that is run again gives the same result, and
shuffles it by Fisher-Yates (Spark's ``shuffle`` with a seed, which adds the number of the task, here
that of the bucket). Buckets in turn make one permutation of all rows, which is cut into shards whose
row counts differ by one at most; every bucket is written where it stands, without a further shuffle.

A row that repeats so often that its copies would fill a good part of a bucket is counted, and its copies are numbered and dealt
over all buckets by their numbers; copies are interchangeable, so a task that is run again still gives the same table.

Only DataFrame functions are used. Memory is bounded by ``bucket_bytes``, or by the longest text.

Defined results: a null text has size 1, as an empty one; fewer rows than shards leave shards empty; rows of a table with maps or
variants are told apart by their other columns only, and their copies are not dealt out; other columns are kept, those named ``shard`` or ``slot`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pharmalith.llm.common import fresh
from pharmalith.session import through_storage, tune

BUCKET_BYTES = 24 << 20
# Copies of a row are dealt out if they would fill one of so many parts of a bucket.
PART = 4
# Copies that one row makes at a time.
CHUNK = 4096


def row_size(text):
    """UTF-8 bytes of a text plus one; a null text has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _has_map(kind.elementType)
    return isinstance(kind, (T.MapType, T.VariantType))


def _numbered(rows: DataFrame, key: str) -> DataFrame:
    """Each row as often as its ``n`` says, with the number of the ``copy``; blocks of copies are dealt over the tasks first."""
    blocks = rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {CHUNK}"))))
    first = F.col("block") * CHUNK
    return blocks.repartition(F.col(key), F.col("block")).withColumn("copy", F.explode(F.sequence(first, F.least(F.col("n"), first + CHUNK) - 1)))


def _scattered(docs: DataFrame, seed: int, bucket_bytes: int) -> tuple[DataFrame, DataFrame, int, int]:
    """Rows as ``b`` (bucket), ``k`` (order in it) and ``r``, rows per bucket (``b, rows``), number of rows, number of buckets."""
    kinds = {f.name: _has_map(f.dataType) for f in docs.schema.fields}
    hashed = [F.col(f"`{c}`") for c, odd in kinds.items() if not odd]
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    # Nulls are skipped by the hash, so their places go in as well.
    key = F.xxhash64(F.lit(seed), *hashed, *[c.isNull() for c in hashed])
    text = F.col("`text`") if "text" in docs.columns else F.lit("")
    keyed = docs.select(key.alias("k"), row_size(text).alias("size"), whole.alias("r"))
    keys = through_storage(keyed.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")), "row-keys")
    total = keys.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
    buckets = max(1, -(-total["size"] // bucket_bytes))
    hot = keys.filter((F.col("n") > 1) & (F.col("size") * PART > bucket_bytes)).select("k", "n")
    # At most PART for each bucket.
    n_hot = 0 if any(kinds.values()) else hot.count()
    bucket = F.pmod(F.col("k"), F.lit(buckets)).cast("int").alias("b")
    if not n_hot:
        return keyed.select(bucket, "k", "r"), keys.groupBy(bucket).agg(F.sum("n").alias("rows")), total["n"], buckets
    few = F.broadcast(hot.select("k")) if n_hot <= 100_000 else hot.select("k")
    own = F.xxhash64("k", "copy").alias("k")
    dealt = F.pmod(F.xxhash64("k", "copy"), F.lit(buckets)).cast("int").alias("b")
    copies = _numbered(keyed.join(few, "k", "left_semi").groupBy("k", "r").agg(F.count(F.lit(1)).alias("n")), "k")
    rows = keyed.join(few, "k", "left_anti").select(bucket, "k", "r").unionByName(copies.select(dealt, own, "r"))
    plain = keys.join(few, "k", "left_anti").groupBy(bucket).agg(F.sum("n").alias("rows"))
    more = _numbered(hot, "k").groupBy(dealt).agg(F.count(F.lit(1)).alias("rows"))
    return rows, plain.unionByName(more).groupBy("b").agg(F.sum("rows").alias("rows")), total["n"], buckets


def shuffle_into_shards(docs: DataFrame, shards: int = 8, seed: int = 42, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``docs`` in random order with ``shard`` and ``slot`` (its place in the shard, from 0, without gaps)."""
    tune(docs.sparkSession)
    docs = docs.drop("shard", "slot")
    whole = fresh(docs, "row")
    scattered, counts, n, buckets = _scattered(docs, seed, bucket_bytes)
    # One row per bucket.
    starts = through_storage(
        counts.selectExpr("b as b_start", "sum(rows) over (order by b rows between unbounded preceding and current row) - rows as before"),
        "starts",
    )
    filled = scattered.repartitionById(buckets, F.col("b")).groupBy("b").agg(F.collect_list(F.struct("k", F.col("r").alias(whole))).alias("rows"))
    ordered = F.array_sort("rows", lambda x, y: F.when(x["k"] < y["k"], -1).when(x["k"] > y["k"], 1).otherwise(0))
    dealt = filled.select("b", F.posexplode(F.shuffle(ordered, seed)).alias("at", "r")).join(
        F.broadcast(starts) if buckets <= 100_000 else starts, F.col("b") == F.col("b_start")
    )
    place = F.col("before") + F.col("at")
    shard = F.expr(f"(before + at) * {shards} div {max(n, 1)}")
    return dealt.select(
        F.col("r")[whole].alias(whole), shard.cast("int").alias("shard_"), place.cast("long").alias("place")
    ).select(
        f"{whole}.*", F.col("shard_").alias("shard"), (F.col("place") - F.expr(f"(shard_ * {n}L + {shards - 1}) div {shards}")).alias("slot")
    )


def write_shards(docs: DataFrame, path: str, shards: int = 8, seed: int = 42, bucket_bytes: int = BUCKET_BYTES) -> None:
    """Write the shuffled rows below ``path``, one folder per shard, each file in the order of its slots."""
    shuffle_into_shards(docs, shards, seed, bucket_bytes).write.partitionBy("shard").parquet(path)
