import numpy as np
import pytest

from pharmalith.llm import decontaminate as d
from tests.llm.conftest import WORDS


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            row[j + 1], before = (before + 1 if x == y else max(row[j + 1], row[j])), row[j + 1]
    return row[-1]


def test_common_subsequence():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = (rng.integers(1, 6, rng.integers(1, 90)).tolist() for _ in "ab")
        assert d.common_subsequence(d.places(a), len(a), b) == plain_lcs(a, b)


def test_windows_that_share_words_are_those_of_a_plain_count():
    rng = np.random.default_rng(2)
    units = [d.Unit(str(k), (c := rng.integers(1, 40, m).tolist()), c[-2:]) for k, m in enumerate((3, 9, 30, 48, 71))]
    index = d.shared_words(units, rng.integers(1, 50, 40).astype(float))
    pieces = np.array([1, 4, 0, 7])
    row = np.repeat(np.arange(4), pieces)
    piece = np.repeat(np.arange(12), d.STRIDE)
    codes = rng.integers(0, 40, len(piece)) * (rng.random(len(piece)) < 0.7)
    expected = []
    for w in range(12):
        for u, (need, side) in enumerate(zip(index.need, index.side)):
            held = [p for p in range(w - side, w + side + 2) if 0 <= p < 12 and row[p] == row[w]]
            words = codes[np.isin(piece, held)]
            if sum(u in index.unit[index.first[c] : index.first[c + 1]] for c in words) >= need:
                expected.append(w * len(units) + u)
    assert d.sharing(index, codes, piece, row).tolist() == expected


def test_short_rows_count_as_a_piece_of_a_chunk():
    import pyarrow as pa

    # A task holds a table of pieces by units, so rows of one word must not make a chunk of any number of pieces.
    batch = pa.RecordBatch.from_arrays([pa.array([b"\1\0\0\0"] * 100, pa.binary())], ["codes"])
    taken = [len(sizes) for _, _, _, sizes, _, _ in d.chunks(iter([batch]), d.STRIDE, 10 * d.STRIDE)]
    assert taken == [10] * 10


def test_gram_product_and_vectors(spark):
    rng = np.random.default_rng(1)
    codes = [rng.integers(0, 12, rng.integers(1, 200)) for _ in range(30)]
    coded = spark.createDataFrame([(k, k, bytearray(c.astype("<i4").tobytes())) for k, c in enumerate(codes)], "doc_id long, k_hash long, codes binary")
    rows = []
    for c in codes:
        for at in range(0, len(c), d.PASSAGE):
            rows.append(np.bincount(c[at : at + d.PASSAGE], minlength=12))
    scale = rng.random(12)
    scale[0] = 0
    a = np.array(rows) * scale
    x = rng.standard_normal((12, 5))
    x[0] = 0
    assert np.allclose(d.gram_product(coded, [], scale, x), a.T @ a @ x, rtol=1e-3, atol=1e-2)
    counted = d.frequencies(coded, 12)
    plain = np.array(rows)
    assert counted[0][0] == len(rows)
    assert all(counted[t] == ((plain[:, t] > 0).sum(), (plain[:, t] ** 2).sum()) for t in range(1, 12) if t in counted)
    q = d.singular_vectors(coded, [], scale, 1)
    assert np.allclose(q.T @ q, np.eye(q.shape[1]), atol=1e-6)


def plain_matches(docs, items):
    return {(r.doc_id, i.item_id) for r in docs for i in items if i.text in (r.text or "")}


@pytest.mark.parametrize("block", [256, 7])
def test_exact_copies(spark, documents, sf, block):
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in d.matches(documents, benchmark, block_items=block).collect()}
    assert got == plain_matches(documents.collect(), benchmark.collect())


def test_paraphrases_and_clean_documents(spark):
    sf = "/root/testdata/sf0.01"
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    base = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(300).collect()]
    base = [t for t in base if not any(i.text in t for i in items)]
    rows, planted = [], set()
    for k, t in enumerate(base):
        text = t
        if k % 5 == 0:
            item = items[k % len(items)]
            words = item.text.split()
            # Case, punctuation, and every fifth word replaced.
            changed = " ".join("zzz" if n % 5 == 2 else w.upper().strip(".,") + ";" for n, w in enumerate(words))
            half = len(t) // 2
            text = t[:half] + " " + changed + " " + t[half:]
            planted.add((k, item.item_id))
        rows.append((k, text))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in d.matches(docs, spark.createDataFrame(items)).collect()}
    assert got == planted


def brute_force(docs, items):
    """Every window of every document checked against every passage, without a candidate search."""
    words = sorted({w for _, text in items for w in d.plain_words(text)})
    vocabulary = {w: k + 1 for k, w in enumerate(words)}
    units = [(u, d.places(u.codes), d.places(u.answer)) for u in d.make_units([(i, t, None) for i, t in items], vocabulary)]
    found = set()
    for doc, text in docs:
        codes = np.array([vocabulary.get(w, 0) for w in d.plain_words(text)], int)
        found |= {(doc, u.item) for u, p, a in units for at in range(0, len(codes), d.STRIDE) if d.check(codes, at, u, p, a)}
    return found


def test_paraphrases_without_the_rare_words(spark):
    """All words that no other item holds are replaced, rarest first, up to 45% of the item; the closing words stay."""
    sf = "/root/testdata/sf0.01"
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    base = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(150).collect()]
    often = {}
    for t in [*base, *(t for _, t in items)]:
        for w in set(d.plain_words(t)):
            often[w] = often.get(w, 0) + 1
    rows = [(k, t) for k, t in enumerate(base)]
    for share in (0.2, 0.3, 0.45):
        for _, t in items:
            words = [w.decode() for w in d.plain_words(t)]
            rare = sorted(range(max(0, len(words) - d.ANSWER_WORDS)), key=lambda n: often[words[n].encode()])[: int(share * len(words))]
            rows.append((len(rows), " ".join(["lead"] * 30 + [f"new{n}" if n in rare else w for n, w in enumerate(words)] + ["tail"] * 30)))
    expected = brute_force(rows, items)
    assert len({k for k, _ in expected if k >= len(base)}) >= 0.9 * 3 * len(items)
    docs, benchmark = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in d.matches(docs, benchmark).collect()} == expected


def test_excerpts(spark):
    """Half of an item or more, word for word or with a changed word, from any place; words as many but scattered need the answer."""
    item = [f"w{k}" for k in range(50)]
    every = [w if k % 5 < 3 and k < 42 else f"x{k}" for k, w in enumerate(item)]
    texts = {
        1: item[:40],
        2: item[:25],
        3: item[5:35],
        4: [*item[2:14], "new", *item[15:27], "and", *item[28:36]],
        5: every,
        6: item[:12],
        7: item[15:45:2] + item[1:11],
    }
    rows = [(k, " ".join([f"a{n}" for n in range(37)] + t + [f"b{n}" for n in range(37)])) for k, t in texts.items()]
    rows.append((8, " ".join(item[:40])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert sorted(r.doc_id for r in d.matches(docs, benchmark).collect()) == [1, 2, 3, 4, 8]
    # A given answer is still asked for.
    given = spark.createDataFrame([(1, " ".join(item), "forty two")], "item_id long, text string, answer string")
    assert d.matches(docs, given).count() == 0
    short = spark.createDataFrame([(1, " ".join(item[:20]))], "item_id long, text string")
    halves = [(1, " ".join([*item[:10], *["c"] * 30])), (2, " ".join([*item[:7], *["c"] * 30])), (3, " ".join(["c"] * 30 + item[4:14]))]
    assert sorted(r.doc_id for r in d.matches(spark.createDataFrame(halves, "doc_id long, text string"), short).collect()) == [1, 3]


def test_edge_cases(spark, edge, nothing):
    benchmark = spark.createDataFrame(
        [(1, WORDS), (1, WORDS), (None, WORDS), (2, None), (3, ""), (4, "same id"), (5, "fox hill")], "item_id long, text string"
    )
    found = sorted((r.doc_id or 0, r.item_id or 0) for r in d.matches(edge, benchmark).collect())
    # Each row that holds the words, under both ids; the long text and the upper case as well.
    assert found == sorted([(x, i) for x in (0, 0, 5, 5, 6, 7) for i in (1, 0)] + [(7, 4)])
    kept = d.remove_contaminated(edge, benchmark)
    assert kept.columns == edge.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 8, 9]
    empty = benchmark.filter("item_id = 99")
    assert d.matches(edge, empty).count() == 0 and d.remove_contaminated(edge, empty).count() == edge.count()
    assert d.matches(nothing, benchmark).count() == 0
    own = spark.createDataFrame([(1, WORDS, "tree by that lake")], "item_id long, text string, answer string")
    assert d.matches(edge, own).filter("doc_id = 5").count() == 2
