"""Benchmark decontamination by latent semantic retrieval.

1. Every document is coded once, whole: its words become numbers of the benchmark's vocabulary (0: any other word).
2. Documents and items are cut into passages; document frequencies of all passages give TF-IDF weights.
3. A randomised SVD finds the leading right singular vectors of the passage-by-term matrix: a Gaussian sketch and a power step,
   each one job in which tasks add up their part of ``A'A X`` and Spark sums the parts; only terms-by-rank matrices reach
   the driver. Columns are scaled to length one, so that words that occur together lead, not words that occur often.
4. Overlapping windows of all documents are projected and compared with all items by cosine. Windows that share so many words with an
   item that step 5 could accept them are candidates as well, whatever their cosine, so the candidate search misses no pair.
5. Candidates are checked on the words themselves: the longest common subsequence with the item (near-verbatim copies), or a shorter one
   together with the item's answer (paraphrases) or, where no answer is given, in one piece (excerpts): ``RUN`` words in a row, or a span of
   half the passage's length of which ``VERBATIM`` is in the passage, in order.

The benchmark is a stated set of queries; it is worked off in blocks of about ``BLOCK_ITEMS`` items, so what is sent to tasks
is bounded. An item is represented in the latent index by its ``INDEX_TERMS`` rarest words; the search by shared words leaves out
its commonest words up to a share of ``LEFT_OUT``, which are taken to be shared; the checks use all its words.

Defined results: null and wordless texts match nothing; an item of fewer than ``SHORT`` words must be found word for word;
null item ids stay null; repeated documents and items are reported each; an empty benchmark flags nothing. Case and ASCII punctuation are of
no account. Extra columns are not read, but for ``answer`` of the benchmark, which is used if it is there; otherwise
the closing words of the passage are the answer, and an excerpt needs none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pharmalith.llm.common import keep_rows, row_hash, with_columns
from pharmalith.session import through_storage, tune

PASSAGE = 48
STRIDE = 24
BLOCK_ITEMS = 256
INDEX_TERMS = 8
OVERSAMPLING = 32
MIN_COSINE = 0.15
VERBATIM = 0.85
PARAPHRASE = 0.5
ANSWER = 0.5
ANSWER_WORDS = 8
SHORT = 8
RUN = 13
# Below PARAPHRASE, so that at least one other word has to be shared.
LEFT_OUT = 0.3
# A word outside the vocabulary counts in the length of a window with this share of a mean index term of the item.
OTHER_SHARE = 0.25
CHUNK = 400_000
# Cells of a table of passages by units, or of words by dimensions, that a task holds at a time.
CELLS = 1 << 21
LANES = 16

_PLAIN = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))


def plain_words(text: str | None) -> list[bytes]:
    """Lower-case words; ASCII characters other than letters and digits part them."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_PLAIN).split() if text else []


def common_subsequence(bits: dict[int, int], length: int, region: list[int]) -> int:
    """Length of the longest common subsequence; ``bits`` holds the places of each code in the pattern."""
    full = (1 << length) - 1
    row = full
    for hit in [bits[c] for c in region if c in bits]:
        both = row & hit
        row = ((row + both) | (row - both)) & full
    return length - bin(row).count("1")


def places(codes: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, c in enumerate(codes):
        out[c] = out.get(c, 0) | 1 << i
    return out


@dataclass
class Unit:
    """A passage of an item: its codes and those of its answer, and whether the item came with one."""

    item: str | None
    codes: list[int]
    answer: list[int]
    given: bool = False


def make_units(items: list[tuple], vocabulary: dict[bytes, int]) -> list[Unit]:
    units = []
    for item, text, answer in items:
        codes = [vocabulary[w] for w in plain_words(text)]
        given = [vocabulary[w] for w in plain_words(answer)]
        # A rest shorter than a stride belongs to the passage before it.
        cuts = [at for at in range(0, len(codes), PASSAGE) if at == 0 or len(codes) - at >= STRIDE]
        for at, end in zip(cuts, [*cuts[1:], len(codes)]):
            part = codes[at:end]
            if part:
                units.append(Unit(item, part, given or part[-ANSWER_WORDS:], bool(given)))
    return units


def code_documents(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``doc_id, k_hash, codes`` (little-endian 32-bit numbers)."""

    class Codes(dict):
        def __missing__(self, word: bytes) -> int:
            return 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = Codes(vocabulary).__getitem__
        for batch in batches:
            coded = []
            for t in batch.column(2):
                words = plain_words(t.as_py())
                coded.append(np.fromiter(map(get, words), "<i4", len(words)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(coded, pa.binary())], ["doc_id", "k_hash", "codes"])

    rows = with_columns(docs, ["doc_id", "text"], {"doc_id": "long"}).select(
        F.col("doc_id").cast("long").alias("doc_id"), row_hash("text").alias("k_hash"), "text"
    )
    return rows.mapInArrow(run, "doc_id long, k_hash long, codes binary")


def chunks(batches: Iterator[pa.RecordBatch], width: int, most: int = CHUNK) -> Iterator[tuple]:
    """(batch, first row, codes, tokens per row, piece of ``width`` words of each token, pieces per row); ``most`` words, if it is
    more than one row, where a row counts as one piece at least."""
    for batch in batches:
        buffers = batch.column(batch.schema.get_field_index("codes")).to_pylist()
        at = 0
        while at < len(buffers):
            end, size = at, 0
            while end < len(buffers) and (end == at or size + max(width, len(buffers[end]) // 4) <= most):
                size += max(width, len(buffers[end]) // 4)
                end += 1
            codes = np.frombuffer(b"".join(buffers[at:end]), "<i4")
            lengths = np.array([len(b) // 4 for b in buffers[at:end]], np.int64)
            pieces = -(-lengths // width)
            start = np.cumsum(lengths) - lengths
            first = np.cumsum(pieces) - pieces
            piece = np.repeat(first, lengths) + (np.arange(len(codes)) - np.repeat(start, lengths)) // width
            yield batch, at, codes, lengths, piece, pieces
            at = end


def frequencies(coded: DataFrame, terms: int) -> dict[int, tuple[int, int]]:
    """Per code: passages that hold it and the sum of its squared counts; code 0 has the number of passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, square = np.zeros(terms, np.int64), np.zeros(terms, np.int64)
        for _, _, codes, _, piece, pieces in chunks(batches, PASSAGE):
            df[0] += int(pieces.sum())
            known = np.flatnonzero(codes)
            pair, n = np.unique(piece[known] * terms + codes[known], return_counts=True)
            df += np.bincount(pair % terms, minlength=terms)
            square += np.bincount(pair % terms, weights=n.astype(float) ** 2, minlength=terms).astype(np.int64)
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(df[seen]), pa.array(square[seen])], ["code", "df", "square"])

    parts = coded.select("codes").mapInArrow(run, "code int, df long, square long")
    # One row per word of the block's items.
    return {r.code: (r.df, r.square) for r in parts.groupBy("code").agg(F.sum("df").alias("df"), F.sum("square").alias("square")).collect()}


def gram_times(codes: np.ndarray, piece: np.ndarray, scale: np.ndarray, x: np.ndarray, out: np.ndarray) -> None:
    """Add ``A'A x`` of some passages to ``out``; A holds counts times ``scale``."""
    known = np.flatnonzero(scale[codes])
    if not len(known):
        return
    c, p = codes[known], piece[known]
    starts = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
    y = np.add.reduceat(x[c] * scale[c][:, None], starts, axis=0)
    back = np.repeat(y, np.diff(np.r_[starts, len(p)]), axis=0)
    order = np.argsort(c, kind="stable")
    c = c[order]
    heads = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
    out[c[heads]] += np.add.reduceat(back[order], heads, axis=0) * scale[c[heads]][:, None]


def gram_product(coded: DataFrame, units: list[Unit], scale: np.ndarray, x: np.ndarray) -> np.ndarray:
    """``A'A x`` over the passages of all documents and, as rows of greater weight, the items."""
    terms, rank = x.shape
    wide = -(-rank // LANES) * LANES
    spark = coded.sparkSession
    shared = spark.sparkContext.broadcast((scale.astype(np.float32), np.pad(x, ((0, 0), (0, wide - rank))).astype(np.float32)))
    lanes = [f"v{k}" for k in range(LANES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, m = shared.value
        out = np.zeros((terms, wide), np.float32)
        for _, _, codes, _, piece, _ in chunks(batches, PASSAGE, 8 * CELLS // wide):
            gram_times(codes, piece, s, m, out)
        seen = np.flatnonzero(out.any(axis=1)).astype(np.int32)
        for lane in range(wide // LANES):
            part = out[seen, lane * LANES : (lane + 1) * LANES]
            yield pa.RecordBatch.from_arrays(
                [pa.array(seen), pa.array(np.full(len(seen), lane, np.int32)), *[pa.array(np.ascontiguousarray(part[:, k])) for k in range(LANES)]],
                ["code", "lane", *lanes],
            )

    parts = coded.select("codes").mapInArrow(run, "code int, lane int, " + ", ".join(f"{v} float" for v in lanes))
    total = np.zeros((terms, wide))
    for r in parts.groupBy("code", "lane").agg(*[F.sum(v).alias(v) for v in lanes]).toLocalIterator():
        total[r[0], r[1] * LANES : (r[1] + 1) * LANES] = r[2:]
    total = total[:, :rank]
    for u in units:
        # No direction of the documents has more than PASSAGE: so much weight lets every item lead.
        row = np.bincount(u.codes, minlength=terms) * scale
        energy = row @ row
        if energy > 0:
            total += np.outer(row, row @ x) * (PASSAGE / energy)
    shared.unpersist()
    return total


def singular_vectors(coded: DataFrame, units: list[Unit], scale: np.ndarray, seed: int) -> np.ndarray:
    """Leading right singular vectors (terms by rank) of all passages, by a randomised sketch and one power step."""
    used = np.flatnonzero(scale)
    rank = min(len(used), len(units) + OVERSAMPLING)
    x = np.zeros((len(scale), rank))
    x[used] = np.random.default_rng(seed).standard_normal((len(used), rank))
    for _ in range(2):
        x, _ = np.linalg.qr(gram_product(coded, units, scale, x))
    return x


@dataclass
class Shared:
    """Units by word: those of code c are ``unit[first[c] : first[c + 1]]``; the words a window needs and its pieces on each side, per unit."""

    first: np.ndarray
    unit: np.ndarray
    need: np.ndarray
    side: np.ndarray


def shared_words(units: list[Unit], df: np.ndarray) -> Shared:
    """A common subsequence is no longer than the words left out and the others that a region shares."""
    code, unit, need = [], [], []
    for k, u in enumerate(units):
        m = len(u.codes)
        own, times = np.unique(u.codes, return_counts=True)
        order = np.argsort(-df[own], kind="stable")
        used = order[np.cumsum(times[order]) > LEFT_OUT * m]
        code.append(own[used])
        unit.append(np.full(len(used), k))
        need.append((m if m < SHORT else math.ceil(PARAPHRASE * m)) - (m - int(times[used].sum())))
    codes = np.concatenate(code)
    order = np.argsort(codes, kind="stable")
    first = np.r_[0, np.cumsum(np.bincount(codes, minlength=len(df)))]
    side = [-(-max(0, len(u.codes) - STRIDE) // STRIDE) for u in units]
    return Shared(first, np.concatenate(unit)[order], np.array(need), np.array(side))


def sharing(index: Shared, codes: np.ndarray, piece: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Windows times units plus unit, of all pairs that share the words needed; ``row`` is the document of a piece."""
    units, n = len(index.need), len(row)
    many = index.first[codes + 1] - index.first[codes]
    at = np.flatnonzero(many)
    many = many[at]
    entry = np.repeat(index.first[codes[at]] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    held = np.bincount(np.repeat(piece[at], many) * units + index.unit[entry], minlength=n * units).reshape(n, units)
    upto = np.zeros((n + 1, units), np.int32)
    np.cumsum(held, axis=0, out=upto[1:])
    # A window is two pieces; its region takes in those on each side, within the document.
    heads = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    size = np.diff(np.r_[heads, n])
    begin, end = np.repeat(heads, size), np.repeat(heads + size, size)
    w = np.arange(n)
    found = []
    for side in np.unique(index.side):
        of = np.flatnonzero(index.side == side)
        low, high = np.maximum(w - side, begin), np.minimum(w + side + 2, end)
        win, unit = np.nonzero(upto[high][:, of] - upto[low][:, of] >= index.need[of])
        found.append(win * units + of[unit])
    return np.sort(np.concatenate(found))


def search(coded: DataFrame, units: list[Unit], weight: np.ndarray, basis: np.ndarray, index: Shared) -> DataFrame:
    """Checked pairs: ``doc_id, k_hash, item, cosine, common, n_words, answer, verbatim``."""
    spark = coded.sparkSession
    projected = (basis * weight[:, None]).astype(np.float32)
    vectors = np.array([projected[u.codes].sum(axis=0) for u in units], np.float32)
    lengths = np.array([np.sqrt((weight[u.codes] ** 2).sum()) for u in units], np.float32)
    vectors /= np.maximum(lengths, 1e-9)[:, None]
    other = OTHER_SHARE * np.array([np.mean(weight[[c for c in set(u.codes) if weight[c] > 0]] ** 2) for u in units], np.float32)
    # A window's product with a unit is the sum of its words' products; only indexed words have one.
    indexed = np.flatnonzero(weight > 0)
    products = projected[indexed] @ vectors.T
    shared = spark.sparkContext.broadcast((indexed, products, (weight**2).astype(np.float32), other, units, index))
    fields = "doc_id long, k_hash long, item string, cosine double, common int, n_words int, answer double, verbatim boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, q, sq, extra, asked, words = shared.value
        place = np.full(len(sq), -1, np.int32)
        place[own] = np.arange(len(own))
        patterns = [(places(u.codes), places(u.answer)) for u in asked]
        block = max(1, CELLS // (STRIDE * len(asked)))
        for batch, at, codes, sizes, piece, pieces in chunks(batches, STRIDE, min(CHUNK, max(1, CELLS // len(asked)) * STRIDE)):
            n = int(pieces.sum())
            if not n:
                continue
            whole = np.bincount(piece, weights=sq[codes], minlength=n).astype(np.float32)
            others = np.bincount(piece[codes == 0], minlength=n).astype(np.float32)
            known = np.flatnonzero(place[codes] >= 0)
            inside, term = piece[known], place[codes[known]]
            starts = np.flatnonzero(np.r_[True, inside[1:] != inside[:-1]]) if len(known) else known
            z = np.zeros((n, len(asked)), np.float32)
            for k in range(0, len(starts), block):
                here = starts[k : k + block]
                upto = starts[k + block] if k + block < len(starts) else len(known)
                z[inside[here]] = np.add.reduceat(q[term[here[0] : upto]], here - here[0], axis=0)
            # A window is a stride and the next of the same document; the last one of a document stands alone.
            row = np.repeat(np.arange(len(sizes)), pieces)
            follows = np.flatnonzero(row[1:] == row[:-1])
            for table in (z, whole, others):
                table[follows] += table[follows + 1]
            # Words outside the vocabulary only lengthen a window, so few pairs have to be divided.
            win, unit = np.nonzero(z >= 0.999 * MIN_COSINE * np.sqrt(np.maximum(whole, 1e-12))[:, None])
            cosine = z[win, unit] / np.sqrt(np.maximum(whole[win] + others[win] * extra[unit], 1e-12))
            near = cosine >= MIN_COSINE
            pairs = np.union1d(win[near] * len(asked) + unit[near], sharing(words, codes, piece, row))
            if not len(pairs):
                continue
            first_piece, first_code = np.cumsum(pieces) - pieces, np.cumsum(sizes) - sizes
            best: dict[tuple, tuple] = {}
            for w, u in zip((pairs // len(asked)).tolist(), (pairs % len(asked)).tolist()):
                r = int(row[w])
                start = int(w - first_piece[r]) * STRIDE
                verdict = check(codes[first_code[r] : first_code[r] + sizes[r]], start, asked[u], *patterns[u])
                if verdict:
                    score = (float(z[w, u] / np.sqrt(max(whole[w] + others[w] * extra[u], 1e-12))), *verdict)
                    key = (r, asked[u].item)
                    if key not in best or verdict[0] / verdict[1] > best[key][1] / best[key][2]:
                        best[key] = score
            if best:
                rows = [r + at for r, _ in best]
                values = list(zip(*best.values()))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(rows)),
                        batch.column(1).take(pa.array(rows)),
                        pa.array([i for _, i in best], pa.string()),
                        pa.array(values[0], pa.float64()),
                        pa.array(values[1], pa.int32()),
                        pa.array(values[2], pa.int32()),
                        pa.array(values[3], pa.float64()),
                        pa.array(values[4], pa.bool_()),
                    ],
                    ["doc_id", "k_hash", "item", "cosine", "common", "n_words", "answer", "verbatim"],
                )

    return coded.select("doc_id", "k_hash", "codes").mapInArrow(run, fields)


def excerpt(unit: Unit, pattern: dict[int, int], region: list[int]) -> bool:
    """Whether a region holds ``RUN`` words of the passage in a row, or a span of half its length that is nearly all from it."""
    m = len(unit.codes)
    runs = {tuple(unit.codes[i : i + RUN]) for i in range(m - RUN + 1)}
    if any(tuple(region[i : i + RUN]) in runs for i in range(len(region) - RUN + 1)):
        return True
    span = max(SHORT, math.ceil(PARAPHRASE * m))
    need = math.ceil(VERBATIM * span)
    upto = np.cumsum([0, *(c in pattern for c in region)])
    return any(
        upto[i + span] - upto[i] >= need and common_subsequence(pattern, m, region[i : i + span]) >= need for i in range(len(region) - span + 1)
    )


def check(codes: np.ndarray, start: int, unit: Unit, pattern: dict[int, int], answer: dict[int, int]) -> tuple | None:
    """(common words, words, answer share, near-verbatim) if the text around a window holds the passage, else None."""
    m = len(unit.codes)
    reach = max(0, m - STRIDE)
    region = codes[max(0, start - reach) : start + PASSAGE + reach].tolist()
    if m < SHORT:
        found = any(region[i : i + m] == unit.codes for i in range(len(region) - m + 1))
        return (m, m, 1.0, True) if found else None
    # No subsequence is longer than the words the region has of the passage.
    if sum(c in pattern for c in region) < PARAPHRASE * m:
        return None
    common = common_subsequence(pattern, m, region)
    if common < PARAPHRASE * m:
        return None
    told = common_subsequence(answer, len(unit.answer), region) / len(unit.answer)
    if common >= VERBATIM * m or told >= ANSWER or not unit.given and excerpt(unit, pattern, region):
        return common, m, told, common >= VERBATIM * m
    return None


def block_matches(docs: DataFrame, items: list[tuple], seed: int) -> DataFrame | None:
    """Matches of a bounded list of (item_id, text, answer)."""
    words = sorted({w for _, text, answer in items for w in plain_words(text) + plain_words(answer)})
    vocabulary = {w: k + 1 for k, w in enumerate(words)}
    units = make_units(items, vocabulary)
    if not units:
        return None
    coded = through_storage(code_documents(docs, vocabulary), "codes")
    counted = frequencies(coded, len(words) + 1)
    n = counted.get(0, (0, 0))[0] + len(units)
    df, square = np.zeros(len(words) + 1), np.zeros(len(words) + 1)
    for code, (a, b) in counted.items():
        if code:
            df[code], square[code] = a, b
    for u in units:
        own, times = np.unique(u.codes, return_counts=True)
        df[own] += 1
        square[own] += times**2
    idf = np.log((n + 1) / np.maximum(df, 1))
    weight = np.zeros(len(words) + 1)
    for u in units:
        rare = sorted(set(u.codes), key=lambda c: (-idf[c], c))[:INDEX_TERMS]
        weight[rare] = np.maximum(idf[rare], 1e-3)
    scale = np.where(weight > 0, 1 / np.sqrt(np.maximum(square, 1)), 0.0)
    return search(coded, units, weight, singular_vectors(coded, units, scale, seed), shared_words(units, df))


def matches(docs: DataFrame, benchmark: DataFrame, seed: int = 42, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """Pairs of a document and a benchmark item it holds: ``doc_id, k_hash, item_id, cosine, common, n_words, answer, verbatim``."""
    spark: SparkSession = tune(docs.sparkSession)
    kind = dict(benchmark.dtypes).get("item_id", "string")
    items = with_columns(benchmark, ["item_id", "text", "answer"], {}).select(F.col("item_id").cast("string"), "text", "answer")
    blocks = max(1, -(-items.count() // block_items))
    found = []
    for b in range(blocks):
        block = items.filter(F.pmod(row_hash("item_id", "text"), F.lit(blocks)) == b)
        rows = sorted((tuple(r) for r in block.collect()), key=lambda r: tuple(x or "" for x in r))
        out = block_matches(docs, rows, seed)
        if out is not None:
            found.append(out)
    if not found:
        return spark.createDataFrame([], f"doc_id long, k_hash long, item_id {kind}, cosine double, common int, n_words int, answer double, verbatim boolean")
    total = found[0]
    for more in found[1:]:
        total = total.unionByName(more)
    return total.withColumn("item", F.col("item").cast(kind)).withColumnRenamed("item", "item_id")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, seed: int = 42) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with the columns they came with."""
    hit = through_storage(matches(docs, benchmark, seed).select(F.col("doc_id").alias("k_id"), "k_hash").distinct(), "hits")
    return keep_rows(docs, hit, "doc_id", ["text"], drop=True)
