import re

import duckdb
import pytest
from pyspark.sql import functions as F

from pharmalith.llm import mixing as m
from tests.llm.conftest import edge_rows


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Targets by rounds of resharing what goes beyond the bound."""
    names = sorted([s for s in sizes if s is not None]) + [s for s in sizes if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total >= most * sizes[s]}
        if not over:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in over)
        open_ -= over
    return out


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_targets(spark):
    sizes = {"a": 1000, "é": 10, "b": 500, "c": 7000, "d": 0, None: 300, "": 50}
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in m.source_targets(rows).collect()}
    expected = plain_targets(sizes)
    assert got.keys() == expected.keys() and all(abs(got[s] - expected[s]) < 1e-6 for s in got)


def test_targets_are_met(spark):
    rows = m.decisions(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    by_source = rows.groupBy("source").agg(F.max("target").alias("target"), F.sum("taken").alias("taken")).collect()
    assert all(abs(r.taken - r.target) <= 0.02 * r.target for r in by_source)


def test_documents(spark, documents, sf):
    rows = m.decisions(documents, appeal=m.by_length).collect()
    text = {r.doc_id: r for r in documents.collect()}
    sizes, taken = {}, {}
    for r in rows:
        assert r.size == words(text[r.doc_id].text) and r.copies <= 2 and r.taken == r.copies * r.size
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    expected = plain_targets(sizes)
    for r in rows:
        assert abs(r.target - expected[r.source]) < 1e-6 and taken[r.source] <= r.target + 1e-6
    assert sorted(rows) == sorted(m.decisions(documents, appeal=m.by_length).collect())
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    sql = con.execute(m.ORACLE_SQL).fetchall()
    assert sorted(sql) == sorted((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in rows)


@pytest.mark.parametrize("seed", range(8))
def test_sql_follows_the_operator_past_repeated_rows(spark, tmp_path, seed):
    """A group of repeated rows in a source that is partly sampled, wherever it falls in the order."""
    rows = [(-1, f"same {seed} " + "w " * (seed * 20), "b")] * 60 + [(k, f"x{k} " * (1 + k % 90), "abc"[k % 3]) for k in range(220)]
    path = f"{tmp_path}/documents.parquet"
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs.write.parquet(path)
    got = [(r.doc_id, r.size, r.source_size, r.target, r.taken) for r in m.decisions(docs, appeal=m.by_length).collect()]
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{path}/*.parquet'")
    assert sorted(con.execute(m.ORACLE_SQL).fetchall()) == sorted(got)
    sums = {}
    for _, _, _, target, taken in got:
        sums[target] = sums.get(target, 0) + taken
    # The group is drawn whole or not at all; its words bound the miss.
    assert all(0 <= target - taken + 1e-6 <= max(90, 60 * (2 + seed * 20)) for target, taken in sums.items())


def test_mixed_rows_follow_the_decisions(spark, documents):
    rows = m.mix(documents)
    assert rows.columns == documents.columns
    got = {r.doc_id: r.n for r in rows.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert got == {r.doc_id: r.copies for r in m.decisions(documents).collect() if r.copies}


def test_inclusion_is_proportional(spark):
    """With unequal appeal, documents of higher odds are drawn more often."""
    rows = [(k, f"w{k}", "a" if k % 3 else "b", 4.0 if k % 2 else 1.0) for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, appeal double")
    picked = m.decisions(docs, appeal="appeal", weights=(1,), share=0.5).join(docs, "doc_id")
    mean = {r.appeal: r.c for r in picked.groupBy("appeal").agg(F.avg("copies").alias("c")).collect()}
    assert mean[4.0] > 0.6 > 0.4 > mean[1.0]
    assert abs(picked.agg(F.sum("taken")).first()[0] - 1500) <= 2


def test_rounds_go_past_repeated_rows(spark):
    """A third of the source is one row, wherever it falls in the order; its group is left out or drawn whole, and others fill up."""
    rows = [(-1, "same", "a")] * 500 + [(k, f"w{k}", "a") for k in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for seed in (1, 2, 3):
        taken = m.decisions(docs, weights=(1,), share=0.5, seed=seed).agg(F.sum("taken")).first()[0]
        assert 749 <= taken <= 750


def test_edge_cases(edge, nothing):
    rows = m.decisions(edge).collect()
    assert len(rows) == len(edge_rows())
    for r in rows:
        assert r.taken <= 2 * r.size and (r.size or r.taken == 0)
    assert m.decisions(nothing).count() == 0 and m.mix(nothing).count() == 0
    mixed = m.mix(edge)
    assert mixed.columns == edge.columns and mixed.count() == sum(r.copies for r in rows)
