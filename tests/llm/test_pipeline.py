"""The pipeline against brute force, stage by stage, each on what the stage before has kept."""

import re

import numpy as np
import pytest

import corpus_pipeline as c
from pharmalith.llm import mixing, quality_rules
from pharmalith.session import through_storage
from tests.llm.test_mixing import plain_targets
from tests.llm.test_sharding import check_law
from tests.llm.test_simhash_vp import plain_fingerprint, plain_roots


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for name, stage in c.STAGES:
        out.append(through_storage(stage(spark, out[-1], sf), name))
    return out


def test_columns(stages):
    assert [name for name, _ in c.STAGES] == ["quality", "near_duplicates", "decontamination", "mixture", "shards"]
    assert all(s.columns == stages[0].columns for s in stages[1:5])
    assert stages[5].columns == [*stages[0].columns, "shard", "slot"]


def test_quality(stages):
    kept = {r.doc_id for r in quality_rules.judge(stages[0]).collect() if r.kept}
    assert sorted(stages[1].collect()) == sorted(r for r in stages[0].collect() if r.doc_id in kept)
    for r in stages[1].collect():
        assert len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) >= 50 and r.text.count("%%%") < 5


def test_near_duplicates(stages):
    rows = sorted(stages[1].collect(), key=lambda r: r.doc_id)
    roots = plain_roots(np.array([plain_fingerprint(r.text) for r in rows], np.uint64))
    assert sorted(stages[2].collect()) == [rows[k] for k in sorted(set(roots))]


def test_decontamination(spark, sf, stages):
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    clean = [r for r in stages[2].collect() if not any(i.text in r.text for i in items)]
    assert sorted(stages[3].collect()) == sorted(clean)


def test_mixture(stages):
    sizes, taken, seen, longest = {}, {}, {}, {}
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    for r in stages[3].collect():
        sizes[r.source] = sizes.get(r.source, 0) + count(r.text)
        longest[r.source] = max(longest.get(r.source, 0), count(r.text))
    for r in stages[4].collect():
        taken[r.source] = taken.get(r.source, 0) + count(r.text)
        seen[r.doc_id] = seen.get(r.doc_id, 0) + 1
    assert max(seen.values()) <= 2 and set(seen) <= {r.doc_id for r in stages[3].collect()}
    for source, target in plain_targets(sizes).items():
        # A few documents per source here: short of the target by less than one of them.
        assert 0 <= target - taken.get(source, 0) + 1e-6 < longest[source]
    again = {r.doc_id: r.copies for r in mixing.decisions(stages[3]).collect() if r.copies}
    assert again == seen


def test_shards(stages):
    check_law(stages[5].collect(), 8)
    assert sorted(stages[5].drop("shard", "slot").collect()) == sorted(stages[4].collect())


def test_run_gives_the_same(spark, sf, stages):
    assert sorted(c.run(spark, sf).collect()) == sorted(stages[5].collect())
