import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from pharmalith.llm import simhash_vp as s
from tests.llm.conftest import edge_rows


def plain_fingerprint(text, shingle=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + shingle]).encode(), 42) for k in range(max(1, len(words) - shingle + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_roots(points, bits=4):
    """Smallest index of the linked points, by all pairs."""
    root = list(range(len(points)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(points)):
        for j in np.flatnonzero(np.bitwise_count(points[i + 1 :] ^ points[i]) <= bits) + i + 1:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(x) for x in range(len(points))]


def clustered(n, seed):
    """Fingerprints of which many are a few bits from others, so that all borders are met."""
    rng = np.random.default_rng(seed)
    points = list(rng.integers(0, 1 << 63, n // 3, dtype=np.uint64))
    while len(points) < n:
        p = points[rng.integers(len(points))]
        for bit in rng.choice(64, rng.integers(1, 8), replace=False):
            p ^= np.uint64(1 << int(bit))
        points.append(p)
    return np.unique(np.array(points, np.uint64))


def test_documents_match_brute_force(spark, documents):
    rows = sorted(documents.collect(), key=lambda r: r.doc_id)
    points = np.array([plain_fingerprint(r.text) for r in rows], np.uint64)
    roots = plain_roots(points)
    got = {r.doc_id: r for r in s.near_duplicates(documents, 4, 4, shard_size=16).withColumn("h", s.hex_fingerprint("fp")).collect()}
    for k, r in enumerate(rows):
        assert got[r.doc_id].h == f"{int(points[k]):016x}" and got[r.doc_id].component_id == rows[roots[k]].doc_id


def test_tree_loses_no_link(spark, monkeypatch):
    monkeypatch.setattr(s, "LEAF", 8)
    points = clustered(3000, 5)
    nodes = spark.createDataFrame([(int(x),) for x in points.view(np.int64)], "fp long")
    edges = s.forest(nodes, len(points), 4, shard_size=40)
    root = {r.node: r.root for r in s.components(edges).collect()}
    signed = points.view(np.int64).tolist()
    expected = plain_roots(points)
    groups, found = {}, {}
    for k, x in enumerate(signed):
        groups.setdefault(expected[k], set()).add(x)
        found.setdefault(root.get(x, x), set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, found.values()))
    assert edges.count() < 40 * len(points)


def test_one_dense_cluster_stays_linear(spark):
    rng = np.random.default_rng(3)
    centre = np.uint64(rng.integers(1 << 62))
    points = {int(centre)}
    while len(points) < 1500:
        p = int(centre)
        for bit in rng.choice(20, 2, replace=False):
            p ^= 1 << int(bit)
        for bit in rng.choice(64, 1):
            p ^= 1 << int(bit)
        points.add(p)
    array = np.array(sorted(points), np.uint64)
    links = s._Links(len(array))
    every = np.arange(len(array))
    s.link_within(array, every, every, 4, s.THIRDS[2], 1, links)
    assert links.root.tolist() == plain_roots(array)


def test_components_of_chains(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (103, 101), (7, 7)]
    got = {r.node: r.root for r in s.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(1, 41)}, 101: 100, 103: 100}


def test_edge_cases(edge, nothing):
    found = s.near_duplicates(edge).collect()
    assert len(found) == len(edge_rows())
    empty = {(r.doc_id, r.component_id) for r in found if r.fp == 0}
    assert empty == {(1, 1), (2, 1), (3, 1), (9, 1)}
    words = [r for r in found if r.doc_id in (None, 5)]
    assert len(words) == 4 and len({r.root for r in words}) == 1 and {r.component_id for r in words} == {5}
    kept = s.keep_one(edge)
    assert kept.columns == edge.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(5) == 1 and None not in ids and ids.count(7) == 1 and ids.count(1) == 1
    assert s.near_duplicates(nothing).count() == 0 and s.keep_one(nothing).count() == 0


def test_null_ids_only(spark):
    docs = spark.createDataFrame([(None, "a b c"), (None, "a b c")], "doc_id long, text string")
    assert [r.component_id for r in s.near_duplicates(docs).collect()] == [None, None]
    assert s.keep_one(docs).count() == 1
