"""Periodic runs against all lags of all texts."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pharmalith.llm import queries, runs


def brute(words, least=12):
    """Every maximal stretch of every lag, the smallest lag of each stretch."""
    w = np.unique(np.array(words, object), return_inverse=True)[1] if len(words) else np.zeros(0, int)
    n, found = len(w), {}
    for q in range(1, n // 2 + 1):
        same = np.concatenate([[False], w[:-q] == w[q:], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1])
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b - a + q >= max(least, 2 * q):
                found.setdefault((a, b - a + q), q)
    return sorted((a, q, size) for (a, size), q in found.items())


def found(texts, least=12):
    """The same by the operator, all texts in one array."""
    flat, bases = [], []
    for k, words in enumerate(texts):
        bases.append(len(flat))
        flat += [k * 1000 + x for x in words] + [-1]
    out = [[] for _ in texts]
    for a, size, q in zip(*(x.tolist() for x in runs.find_runs(np.array(flat, np.int64), least))):
        k = max(i for i, b in enumerate(bases) if b <= a)
        out[k].append((a - bases[k], q, size))
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), min_size=1, max_size=4), st.sampled_from([2, 3, 5, 8, 12, 13, 20]))
def test_small_alphabets(texts, least):
    assert found(texts, least) == [brute(t, least) for t in texts]


def test_repeated_blocks():
    rnd = random.Random(1)
    for _ in range(200):
        block = [rnd.randrange(4) for _ in range(rnd.randint(1, 25))]
        tail = [rnd.randrange(6) for _ in range(rnd.randint(0, 30))]
        words = (block * rnd.randint(1, 6) + tail) * rnd.randint(1, 4)
        assert found([words]) == [brute(words)]


def test_fibonacci_words():
    a, b = [0], [1]
    while len(b) < 600:
        a, b = b, b + a
    assert found([b]) == [brute(b)]


LONG = [
    ([0] * 400_000, [(0, 1, 400_000)]),
    ([k % 7 for k in range(400_000)], [(0, 7, 400_000)]),
    (list(range(200_000)) * 2, [(0, 200_000, 400_000)]),
    (([0] * 100_000 + [1]) * 3, [(0, 1, 100_000), (0, 100_001, 300_003), (100_001, 1, 100_000), (200_002, 1, 100_000)]),
]


@pytest.mark.parametrize("words, want", LONG)
def test_long_texts(words, want):
    start, length, period = runs.find_runs(np.array(words, np.int64))
    assert list(zip(start.tolist(), period.tolist(), length.tolist())) == want


def test_at_a_phrase_everywhere():
    phrase = list(range(10))
    words = [x for k in range(3000) for x in [*phrase, 100 + k, 5000 + k * k % 997]]
    assert found([[w % 1000 for w in words[:600]]]) == [brute([w % 1000 for w in words[:600]])]
    assert len(runs.find_runs(np.array(words, np.int64))[0]) == len(brute(words))


def collapsed(words, spans):
    gone = {k for a, q, size in spans for k in range(a + q, a + size)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def expected(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    words = [w.decode() for w in words]
    spans = brute(words)
    best = max(spans, key=lambda r: (r[2], -r[0], -r[1]), default=None)
    top = (best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4
    listed = "".join(f"{a},{size},{q}\n" for a, q, size in spans)
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in (listed, collapsed(words, spans))]
    return (doc_id, len(spans), *top, *sha)


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query(spark, sf, documents):
    rows = documents.select("doc_id", "text").filter("length(text) < 12000").collect()
    got = {r.doc_id: tuple(r) for r in queries.op11_periodic_runs(spark, sf).select(*COLUMNS).collect()}
    assert len(got) == documents.count()
    for r in rows:
        assert got[r.doc_id] == expected(r.doc_id, r.text)
    assert sum(got[r.doc_id][1] > 0 for r in rows) > 10


def test_query_on_edges(edge, nothing):
    found = runs.detect(queries.periodic(edge), ["doc_id"])
    assert found.count() == edge.count()
    assert runs.detect(queries.periodic(nothing), ["doc_id"]).collect() == []


def test_edges(spark, edge, nothing):
    long = next(r.text for r in edge.collect() if r.doc_id == 6)
    rows = {}
    for r in runs.detect(edge, ["doc_id", "a.b"]).collect():
        rows.setdefault(r.doc_id, []).append(r)
    for k in (1, 2, 3, 9):
        assert [(r.n_words, r.runs, r.collapsed) for r in rows[k]] == [(0, [], "")]
    assert len(rows[None]) == 2 and len(rows[5]) == 2
    assert rows[6][0].n_words == len(long.split()) and rows[6][0].runs == []
    assert rows[8][0].collapsed == "日本語のテキスト и немного слов 12 Ünïcödé 😀"
    assert runs.detect(nothing, ["doc_id"]).collect() == []


def test_chunks_do_not_matter(spark, monkeypatch):
    texts = [(k, " ".join(["a b c"] * (k % 9)) + " x\x1cy z" * (k % 5)) for k in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    whole = [tuple(r) for r in runs.detect(docs, ["doc_id"]).collect()]
    import pharmalith.llm.runs as module

    monkeypatch.setattr(module, "CHUNK", 20)
    assert [tuple(r) for r in runs.detect(docs, ["doc_id"]).collect()] == whole
    for k, n, spans, left in whole:
        words = [w.decode() for w in texts[k][1].encode().split()]
        assert [(a, q, size) for a, size, q in spans] == brute(words) and left == collapsed(words, brute(words)) and n == len(words)
