"""Trie nodes against a dictionary of all prefixes."""

import hashlib
import random

import pytest

from pharmalith.llm import burst_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(paths):
    """Nodes of ``{conv_id: [(role, text), ...]}``."""
    members, ends = {}, {}
    for c, turns in paths.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    rows = []
    for p, held in members.items():
        below = [q for q in members if q[: len(p)] == p]
        children = [q for q in below if len(q) == len(p) + 1]
        leaves = [q for q in below if not any(len(x) > len(q) and x[: len(q)] == q for x in below)]
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode().split()) for q in below if q)
        digest = hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
        rows.append((min(held), len(p), min(members[p[:-1]]) if p else None, len(held), len(children), len(leaves), saved, digest))
    return sorted(rows, key=str)


def ordered(rows):
    """Turns per conversation, by turn (null first), role, text."""
    paths = {}
    for c, turn, role, text in rows:
        if c is not None:
            paths.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for _, _, r, t in sorted(turns)] for c, turns in paths.items()}


def made(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def random_rows(seed, n=120):
    rnd = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rnd.randint(1, 6)):
            rows.append((c, t, rnd.choice(["user", "bot"]), rnd.choice(["a b", "c", "", "d e f"])))
    return rows


@pytest.mark.parametrize("entries, turns", [(1, 1), (2, 1 << 15), (1 << 11, 6), (20, 50), (1 << 11, 1 << 15)])
def test_bursting_changes_nothing(spark, entries, turns):
    rows = random_rows(entries)
    held = burst_trie.sequences(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert made(burst_trie.nodes(held, entries, turns)) == brute(ordered(rows))


def test_containers_burst_in_rounds(spark):
    held = burst_trie.sequences(spark.createDataFrame(random_rows(3), SCHEMA))
    _, upper, ended, count = burst_trie.burst(burst_trie.entries(held), 3, 1 << 15)
    assert len(upper) == len(ended) >= 2 and count[0] == 1 and count[-1] == 0
    settled, _, _, _ = burst_trie.burst(burst_trie.entries(held), 3, 1 << 15)
    assert max(r["count"] for part in settled for r in part.groupBy("head").count().collect()) <= 3


def test_without_broadcast(spark, monkeypatch):
    rows = random_rows(4)
    held = burst_trie.sequences(spark.createDataFrame(rows, SCHEMA))
    monkeypatch.setattr(burst_trie, "FEW_HEADS", -1)
    assert made(burst_trie.nodes(held, 3, 20)) == brute(ordered(rows))


def test_many_copies_and_a_deep_conversation(spark, monkeypatch):
    rows = [(c, t, "user", f"turn {t}") for c in range(400) for t in range(3)]
    rows += [(1000, t, "user", f"turn {t}" if t < 3 else f"deep {t}") for t in range(60)] + [(1001, t, "bot", f"x {t % 2}") for t in range(30)]
    monkeypatch.setattr(burst_trie, "BLOCK", 64)
    held = burst_trie.sequences(spark.createDataFrame(rows, SCHEMA))
    for most in ((1, 8), (1 << 11, 1 << 15)):
        assert made(burst_trie.nodes(held, *most)) == brute(ordered(rows))


def test_odd_rows(spark):
    rows = [
        (1, None, None, None), (1, 0, "user", "b c"), (1, 0, "user", "a"), (1, 0, "bot", "z"),
        (2, 5, "", ""), (2, 5, "", ""), (None, 0, "user", "lost"), (None, None, None, None), (3, -1, "user", " \t "),
        (-7, 0, "user:", "x"), (-8, 0, "user", ":x"), (4, 0, "日本", "😀 é"), (5, 0, "user", "w " * 100_000),
    ]
    frame = spark.createDataFrame([(*r, "q") for r in rows], SCHEMA + ", path string")
    assert made(burst_trie.trie(frame)) == brute(ordered(rows))


def test_nothing(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert burst_trie.trie(frame).collect() == []
    assert queries.with_shared_starts(burst_trie.sequences(frame)).collect() == []


def test_conversations_without_turns_end_at_the_root(spark):
    rows = spark.createDataFrame([(1, []), (2, []), (9, [(bytearray(16), 3)])], "conv_id long, turns array<struct<id: binary, words: long>>")
    root = [r for r in made(burst_trie.nodes(rows)) if r[1] == 0]
    assert root == [(1, 0, None, 3, 1, 1, 0, hashlib.sha256(b"1,2").hexdigest())]
    assert [r for r in made(burst_trie.nodes(rows, 1, 1)) if r[1] == 0] == root
