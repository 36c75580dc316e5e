"""SimHash near-duplicates through vantage-point trees over Hamming distance.

Texts become 64-bit fingerprints of their word shingles; equal fingerprints collapse to one node. Two nodes within
``max_bits`` differ in at most ``max_bits // 3`` bits of at least one third of the fingerprint, so there is one
vantage-point tree per third, with the Hamming distance of that third as its metric. Each node of a tree
holds a vantage point and a radius; a branch is left out when the triangle inequality shows that no fingerprint
within the bound lies in it. The leaves of the upper tree are shards: a fingerprint is a member of
one shard per tree and a visitor of those further shards that its ball overlaps (only of later ones, as the pair would
otherwise be found twice). Every shard goes on with the same tree in memory and checks all pairs left over on
the full 64 bits, so no link is lost. A shard returns a spanning forest of its links, never all pairs, and components
are found by large-star and small-star rounds over those edges.

The upper tree is fitted on a sample of at most ``SAMPLE_MOST`` fingerprints (smallest hashes first); the sample
decides only the shape of the tree, every fingerprint is routed through it.

Defined results: a null or wordless text has fingerprint zero. Fewer words than a shingle give one shingle of all words.
Repeated rows come back as often as they came. Null ids never name a component, unless all its ids are null (then null).
Any text length is read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pharmalith.llm.common import bounded_sample, keep_rows, row_hash, with_columns
from pharmalith.session import through_storage, tune

SEED = 42
# Bits of each tree's metric.
THIRDS = tuple(np.uint64(((1 << n) - 1) << at) for at, n in ((0, 21), (21, 21), (42, 22)))
FULL = np.uint64((1 << 64) - 1)
SHARD_SIZE = 8192
SAMPLE_LEAST, SAMPLE_MOST = 4096, 1 << 20
LEAF = 512
BLOCK = 1 << 21


def fingerprint(text: str | None, shingle: int) -> int:
    """Unsigned fingerprint of a whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    size = np.fromiter(map(len, words), np.int64, n)
    end = np.cumsum(size + 1) - 1
    start = (end - size)[: n - shingle + 1].tolist()
    end = end[shingle - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(start, end)), np.uint64, len(start))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 18):  # bounds memory on long texts
        part = h[at : at + (1 << 18)]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """``doc_id``, ``k_hash`` (of the text) and ``fp``, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp.view(np.int64))], ["doc_id", "k_hash", "fp"])

    rows = with_columns(docs, ["doc_id", "text"], {"doc_id": "long"}).select(
        F.col("doc_id").cast("long").alias("doc_id"), row_hash("text").alias("k_hash"), "text"
    )
    return rows.mapInArrow(run, "doc_id long, k_hash long, fp long")


def _distance(a: np.ndarray, b: np.uint64, mask: np.uint64) -> np.ndarray:
    return np.bitwise_count((a ^ b) & mask).astype(np.int16)


def _vantage(points: np.ndarray, mask: np.uint64, radius: int) -> tuple[np.uint64, int] | None:
    """The vantage point and radius that send the fewest points to both sides; None if none parts them."""
    best = None
    tries = points[np.linspace(0, len(points) - 1, min(8, len(points))).astype(int)]
    for v in np.unique(tries):
        d = _distance(points, v, mask)
        for mu in {int(np.median(d)), int(np.median(d)) - 1}:
            left = int((d <= mu).sum())
            if left in (0, len(points)):
                continue
            both = int(((d > mu - radius) & (d <= mu + radius)).sum())
            cost = max(left, len(points) - left) + both
            if best is None or cost < best[0]:
                best = (cost, v, mu)
    return best and (best[1], best[2])


def build_tree(points: np.ndarray, mask: np.uint64, radius: int, depth: int, first: int) -> tuple[object, int]:
    """Nested (vantage, radius, left, right), leaves are shard numbers from ``first``; and the next free number."""
    found = _vantage(points, mask, radius) if depth and len(points) > 1 else None
    if not found:
        return first, first + 1
    d = _distance(points, found[0], mask)
    left, free = build_tree(points[d <= found[1]], mask, radius, depth - 1, first)
    right, free = build_tree(points[d > found[1]], mask, radius, depth - 1, free)
    return (found[0], found[1], left, right), free


def route(tree: object, points: np.ndarray, mask: np.uint64, radius: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, row numbers, whether a member) of all rows; visitors only of shards after their own."""
    out: list[tuple[int, np.ndarray, np.ndarray]] = []

    def go(node: object, at: np.ndarray, member: np.ndarray) -> None:
        if not len(at):
            return
        if not isinstance(node, tuple):
            out.append((node, at, member))
            return
        v, mu, left, right = node
        d = _distance(points[at], v, mask)
        inner = d <= mu
        near = d - radius <= mu
        # A ball that reaches the left side from the right one would visit a shard before its own.
        near &= inner | ~member
        far = d + radius > mu
        go(left, at[near], member[near] & inner[near])
        go(right, at[far], member[far] & ~inner[far])

    go(tree, np.arange(len(points)), np.ones(len(points), bool))
    return out


class _Links:
    """Smallest linked row number of each row."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.root[a], self.root[b]
            differ = ra != rb
            if not differ.any():
                return
            a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
            low, high = np.minimum(ra, rb), np.maximum(ra, rb)
            np.minimum.at(self.root, high, low)
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


def link_within(points: np.ndarray, members: np.ndarray, others: np.ndarray, max_bits: int, mask: np.uint64, radius: int, links: _Links) -> None:
    """Link all pairs of a member and an other (members are among the others) within ``max_bits``."""
    if not len(members) or not len(others):
        return
    if len(members) > LEAF:
        found = _vantage(points[members], mask, radius)
        if found:
            dm, do = _distance(points[members], found[0], mask), _distance(points[others], found[0], mask)
            for side, reach in ((dm <= found[1], do - radius <= found[1]), (dm > found[1], do + radius > found[1])):
                link_within(points, members[side], others[reach], max_bits, mask, radius, links)
            return
        if mask != FULL:  # equal in these bits: go on with all of them
            return link_within(points, members, others, max_bits, FULL, max_bits, links)
    step = max(1, BLOCK // len(others))
    for at in range(0, len(members), step):
        m = members[at : at + step]
        i, j = np.nonzero(np.bitwise_count(points[m][:, None] ^ points[others][None, :]) <= max_bits)
        links.add(m[i], others[j])


def _link_shard(max_bits: int):
    def run(table: pa.Table) -> pa.Table:
        points = table.column("fp").to_numpy().view(np.uint64)
        tree = int(table.column("tree")[0].as_py())
        member = np.flatnonzero(table.column("member").to_numpy(zero_copy_only=False))
        links = _Links(len(points))
        link_within(points, member, np.arange(len(points)), max_bits, THIRDS[tree], max_bits // 3, links)
        tied = np.flatnonzero(links.root != np.arange(len(points)))
        signed = points.view(np.int64)
        return pa.table({"a": signed[tied], "b": signed[links.root[tied]]})

    return run


def forest(nodes: DataFrame, count: int, max_bits: int, shard_size: int = SHARD_SIZE) -> DataFrame:
    """Edges ``a, b`` between distinct fingerprints that connect all that are linked."""
    spark = nodes.sparkSession
    size = min(SAMPLE_MOST, max(SAMPLE_LEAST, 32 * count // shard_size))
    sample = np.array([r.fp for r in bounded_sample(nodes.select("fp"), "fp", count, size).collect()], np.int64).view(np.uint64)
    radius = max_bits // 3
    depth = max(0, int(np.ceil(np.log2(max(1, count / shard_size)))))
    trees, free = [], 0
    for mask in THIRDS:
        tree, free = build_tree(sample, mask, radius, depth, free)
        trees.append(tree)
    shared = spark.sparkContext.broadcast(trees)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signed = batch.column(0).to_numpy(zero_copy_only=False)
            for k, tree in enumerate(shared.value):
                for shard, at, member in route(tree, signed.view(np.uint64), THIRDS[k], radius):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), shard, np.int32)), pa.array(np.full(len(at), k, np.int32)), pa.array(signed[at]), pa.array(member)],
                        ["shard", "tree", "fp", "member"],
                    )

    dealt = nodes.select("fp").mapInArrow(deal, "shard int, tree int, fp long, member boolean")
    return dealt.groupBy("shard").applyInArrow(_link_shard(max_bits), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node each node of ``edges`` (``a, b``) is connected with.

    Large-star and small-star rounds in turn; each is a grouped minimum and an inner join that adaptive execution can split.
    """
    edges = through_storage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), "edges")

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            e = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = e.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        joined = e.join(low, "a")
        if large:
            out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        return out.filter("a > b").distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = mark(edges)
    while before[0]:
        edges = through_storage(star(star(edges, True), False), "edges")
        after = mark(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4, shard_size: int = SHARD_SIZE) -> DataFrame:
    """``doc_id``, ``k_hash``, ``fp``, ``root`` (of the component, a fingerprint) and ``component_id`` per document."""
    tune(docs.sparkSession)
    rows = through_storage(fingerprints(docs, shingle), "fingerprints")
    nodes = through_storage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(forest(nodes, nodes.count(), max_bits, shard_size))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    least = rooted.groupBy(F.col("root").alias("r_root")).agg(F.min("least").alias("component_id"))
    named = rooted.join(least, rooted["root"] == least["r_root"]).select(F.col("fp").alias("n_fp"), "root", "component_id")
    return rows.join(named, rows["fp"] == named["n_fp"]).select("doc_id", "k_hash", "fp", "root", "component_id")


def hex_fingerprint(column: str):
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))


def keep_one(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """One row of each group: that of the smallest id (null last), then of the smallest text hash."""
    found = near_duplicates(docs, shingle, max_bits)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k_hash")).alias("first"))
    kept = first.select(F.col("first.doc_id").alias("k_id"), F.col("first.k_hash").alias("k_hash"))
    return keep_rows(docs, kept, "doc_id", ["text"], once=True)
