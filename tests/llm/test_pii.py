import hashlib
import re

import pytest
from pyspark.sql import functions as F

from pharmalith.llm import pii as p
from tests.llm.conftest import edge_rows

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(number):
    total = 0
    for k, c in enumerate(reversed(number)):
        x = int(c) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            n = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")),
                "card": 13 <= len(n) <= 19 and plain_luhn(n),
                "phone": 9 <= len(n) <= 15,
            }[kind]
            if good:
                out.append((p.KINDS.index(kind), m.start(), m.end()))
    return out


ODD = [
    "a@b.c@d.e", "a@b.com_x@y.org", "x..y@z.a..b@c.d", "%+-@-.-", "a@b", "@b.c", "é.a@b.cé", "a@b.c-", "A_b@c.d.", "😀a@b.co 😀 1.2.3.4",
    "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.255", "01.002.0003.4", "1.2.3", "999999999999999999999999.1.1.1",
    "4111 1111 1111 1111", "4111-1111-1111-1111", "4111  1111 1111 1111", "41111111111111112", "0000000000000", "4111111111111111-", "5 4111111111111111",
    "1" * 500, "1 " * 400, "4111111111111111 4111111111111111", "4111-1111-1111-1111--4111111111111111",
    "+1 (212) 555-0100", "+1 2", "++49 30 1234567.", "+49 30 1234567 +49 30 1234568", "+1234567890123456", "+(1)", "+1.2.3.4.5.6.7.8.9",
    "a@" + "b." * 3000 + "c", "1." * 3000 + "1", "+1" + " (2" * 3000, "a." * 3000,
]


@pytest.mark.parametrize("chunk", [0, 1])
def test_base_spans_of_odd_texts(spark, chunk):
    texts = ODD[chunk::2]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [tuple(b) for b in r.base] for r in p.find(docs).collect()}
    for k, t in enumerate(texts):
        assert got[k] == plain_spans(t), t[:80]


def test_documents_match_brute_force(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = p.detect(docs).select("doc_id", "base", "spans", F.sha2(p.spell(F.col("base")), 256).alias("sha")).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in found:
        expected = plain_spans(text[r.doc_id])
        spelled = ",".join(f"{p.KINDS[k]}:{a}:{b}" for k, a, b in expected)
        assert [tuple(b) for b in r.base] == expected and r.sha == hashlib.sha256(spelled.encode()).hexdigest()
        spans = [tuple(b) for b in r.spans]
        assert set(expected) <= set(spans) and spans == sorted(spans)


def test_reliabilities_find_the_good_labelers():
    """Votes drawn from known chances: the estimates come near them."""
    import random

    random.seed(1)
    counts = {}
    for _ in range(4000):
        true = random.random() < 0.3
        votes = []
        for right, silent in ((0.95, 0.0), (0.9, 0.0), (0.6, 0.2), (0.55, 0.6), (0.8, 0.1)):
            says = true if random.random() < right else not true
            votes.append(0 if random.random() < silent else (1 if says else -1))
        counts[tuple(votes)] = counts.get(tuple(votes), 0) + 1
    share, table = p.reliabilities([(0, v, n) for v, n in counts.items()])[0]
    assert abs(share - 0.3) < 0.05
    assert abs(table[0][1][2] - 0.95) < 0.04 and abs(table[0][0][0] - 0.95) < 0.04 and abs(table[1][1][2] - 0.9) < 0.05


def test_model_adds_spans_the_patterns_miss(spark):
    rows = [(k, f"please write mail to name{k}@site{k}.example.com or call phone +1 (212) 555-01{k % 90 + 10} today") for k in range(60)]
    rows += [(100 + k, f"call phone (212) 555-01{k % 90 + 10} now; version 10.{k}.300.7 of order 12345{k}") for k in range(20)]
    rows += [(200, "nothing of that kind here, page 12")]
    found = {r.doc_id: [tuple(s) for s in r.spans] for r in p.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = dict(rows)
    added = [text[d][a:b] for d in range(100, 120) for k, a, b in found[d]]
    assert added.count("(212) 555-0110") >= 1 and not any(x.startswith("10.") for x in added)
    assert found[200] == []


def test_no_python_on_the_path(documents):
    plan = p.find(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_edge_cases(spark, edge, nothing):
    rows = p.detect(edge).collect()
    assert len(rows) == len(edge_rows()) and all(list(map(tuple, r.base)) == [] for r in rows if r.doc_id in (1, 2, 3, 9))
    assert p.detect(nothing).count() == 0
    docs = spark.createDataFrame([(1, "mail a@b.com or 10.0.0.1 😀"), (1, "mail a@b.com or 10.0.0.1 😀"), (None, None), (2, "none")], "doc_id long, text string")
    out = sorted(((r.doc_id or 0, r.text) for r in p.redact(docs).collect()), key=str)
    assert out == [(0, None), (1, "mail [email] or [ip] 😀"), (1, "mail [email] or [ip] 😀"), (2, "none")]


def dense(n):
    """A text of nothing but spans of several kinds."""
    return " ".join(f"ab{k}@cd.org" if k % 4 else f"call 10.0.{k % 250}.7 or +49 30 {k:07d}" for k in range(n))


def test_a_dense_long_text_by_brute_force(spark):
    text = dense(12_000)
    assert len(text) > 190_000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = p.find(docs).first()
    want = plain_spans(text)
    assert [tuple(b) for b in got.base] == want
    base = {x for x in want}
    wide = {(c.kind, c.s, c.e): c for c in got.candidates}
    assert {k for k, c in wide.items() if c.base} == {k for k in wide if k in base}
    starts = sorted((s, e) for _, s, e in want)
    for (_, s, e), c in list(wide.items())[::97]:
        assert c.touched == any(a < e and s < b for a, b in starts)


def test_time_grows_with_the_matches(spark):
    import time

    took = {}
    for n in (8_000, 8_000, 16_000, 32_000):
        docs = spark.createDataFrame([(1, dense(n))], "doc_id long, text string").coalesce(1)
        start = time.time()
        assert p.find(docs).selectExpr("size(candidates) as n").first().n > n
        took[n] = time.time() - start
    # Four times the matches; a quadratic pass would take sixteen times as long.
    assert took[32_000] < 8 * took[8_000] + 2


def test_running_and_parts(spark):
    row = spark.range(1).select(
        p.running(F.array(*map(F.lit, [3, 1, 4, 1, 5, 9, 2])), lambda a, b: a + b).alias("sum"),
        p.running(F.array(*map(F.lit, [3, 1, 4, 1, 5, 9, 2])), lambda a, b: F.greatest(a, b)).alias("max"),
        p.running(F.array().cast("array<int>"), lambda a, b: a + b).alias("none"),
        p.part_of(p.cut_text(F.lit("é😀x" * 300)), F.lit(254), F.lit(5)).alias("part"),
        p.part_of(p.cut_text(F.lit("abc")), F.lit(3), F.lit(1)).alias("end"),
    ).first()
    assert (row["sum"], row["max"], row["none"], row["part"], row["end"]) == ([3, 4, 8, 9, 14, 23, 25], [3, 3, 4, 4, 5, 9, 9], [], ("é😀x" * 300)[254:259], "")
