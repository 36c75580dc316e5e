import zlib

import pytest
from pyspark.sql import functions as F

from pharmalith.llm import sharding as s
from tests.llm.conftest import edge_rows


def check_law(rows, shards):
    """Counts at most one apart, slots without gaps."""
    places = {}
    for r in rows:
        places.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in places.values())
    counts = [len(places.get(k, [])) for k in range(shards)]
    assert set(places) <= set(range(shards)) and max(counts) - min(counts) <= 1


@pytest.mark.parametrize("size", [1 << 30, 40_000])
def test_law_and_contents(documents, size):
    out = s.shuffle_into_shards(documents, 8, bucket_bytes=size)
    rows = out.collect()
    check_law(rows, 8)
    assert sorted(out.drop("shard", "slot").collect()) == sorted(documents.collect())
    again = s.shuffle_into_shards(documents.repartition(5), 8, bucket_bytes=size).collect()
    assert sorted(again) == sorted(rows)
    other = s.shuffle_into_shards(documents, 8, seed=7, bucket_bytes=size).collect()
    assert sorted(other) != sorted(rows)


def test_order_is_random(spark):
    """Ranks of ids after the shuffle look like a uniform permutation: shards are even mixes of the input."""
    docs = spark.range(0, 4000).select(F.col("id").alias("doc_id"), F.lit("x" * 20).alias("text"))
    rows = s.shuffle_into_shards(docs, 4, bucket_bytes=9000).collect()
    check_law(rows, 4)
    for k in range(4):
        mean = sum(r.doc_id for r in rows if r.shard == k) / 1000
        assert abs(mean - 2000) < 6 * 1155 / 1000**0.5
    order = [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert sum(a < b for a, b in zip(order, order[1:])) < 2300


def test_one_exchange_of_the_texts(documents):
    plan = s.shuffle_into_shards(documents, 8)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") - plan.count("BroadcastExchange") <= 1
    assert "Python" not in plan and "Arrow" not in plan


def test_written_files(spark, documents, tmp_path):
    s.write_shards(documents, str(tmp_path / "out"), 4, bucket_bytes=60_000)
    back = spark.read.parquet(str(tmp_path / "out"))
    check_law(back.collect(), 4)
    assert sorted(r.doc_id for r in back.collect()) == sorted(r.doc_id for r in documents.collect())


def test_edge_cases(spark, edge, nothing):
    out = s.shuffle_into_shards(edge, 8)
    rows = out.collect()
    check_law(rows, 8)
    assert len(rows) == len(edge_rows()) and out.columns == [c for c in edge.columns if c not in ("shard", "slot")] + ["shard", "slot"]
    assert s.shuffle_into_shards(nothing, 8).count() == 0
    maps = edge.select("doc_id", "text", F.create_map(F.lit("a"), F.col("doc_id")).alias("m"))
    assert s.shuffle_into_shards(maps, 3).count() == len(rows)
    sizes = edge.select("text", s.row_size(F.col("text")).alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("c")).collect()
    assert all(r.size == len((r.text or "").encode()) + 1 and r.c == zlib.crc32((r.text or "").encode()) for r in sizes)


def test_copies_of_a_row_are_dealt_over_the_buckets(spark):
    """A third of all rows is one row; no bucket holds more than its share, and reruns agree."""
    rows = [(7, "the same text " * 10)] * 3000 + [(k, f"text {k} " * 15) for k in range(100, 6100)] + [(None, None)] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    size = 60_000
    scattered, counts, n, buckets = s._scattered(docs, 42, size)
    held = {r.b: r["count"] for r in scattered.groupBy("b").count().collect()}
    assert held == {r.b: r.rows for r in counts.collect()} and sum(held.values()) == n == len(rows)
    assert buckets > 15 and max(held.values()) < 2.5 * n / buckets
    out = s.shuffle_into_shards(docs, 8, bucket_bytes=size).collect()
    check_law(out, 8)
    assert sorted(((r.doc_id, r.text) for r in out), key=str) == sorted(rows, key=str)
    assert sorted(s.shuffle_into_shards(docs.repartition(3), 8, bucket_bytes=size).collect(), key=str) == sorted(out, key=str)
    # Copies lie all over the order, not side by side.
    order = [r.doc_id for r in sorted(out, key=lambda r: (r.shard, r.slot))]
    assert sum(a == b == 7 for a, b in zip(order, order[1:])) < 0.45 * 3000


def test_more_copies_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(s, "CHUNK", 64)
    docs = spark.createDataFrame([(7, "same")] * 1000 + [(8, "other")], "doc_id long, text string")
    rows = s.shuffle_into_shards(docs, 3, bucket_bytes=500).collect()
    check_law(rows, 3)
    assert sorted(r.doc_id for r in rows) == [7] * 1000 + [8]
