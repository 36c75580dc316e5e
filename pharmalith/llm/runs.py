"""Periodic runs of words in whole texts, found by seeds that are extended along diagonals.

A run of period q is a stretch whose words equal those q places before, at least ``least`` words and two periods long, that
no word beside it extends. On the diagonal of lag q it is a row of at least max(least - q, q) equal places, so lags fall
into classes [Q, 2Q) with a guaranteed overlap of Q (the first class also holds all smaller lags). Half of Q is the gram
length k of a class: every overlap holds one whole k-gram at a place divisible by k. Only these places look for the
same gram in their own text, at the lags of the class; each pair found is a seed. Per lag, a seed that begins where the one
before it ends is already covered and opens no extension; what is left is extended to both sides over the grams of
shorter classes, never by k words or more. Grams of a class are pairs of grams of the class before, and a gram that does not come
again in its text is forgotten, so ordinary text ends after one or two classes. A text of n words costs O(n log n) time and
memory for any repetition: places are looked up at one k-th of all places, and a gram has at most 2k / p occurrences in its class
where p is its own period.

The same stretch is found at each multiple of its period; the smallest is kept.

Defined results: null, empty and wordless texts have no words and no runs, and collapse to the empty text. Repeated rows are
answered each. Other columns are not read. Texts are read whole; a task holds one text, or some with about ``CHUNK`` words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from pharmalith.llm.common import beside

# Words of the shortest run.
LEAST = 12
# Words that are searched at once; a longer text is searched alone.
CHUNK = 1 << 19

RUN = StructType([StructField(c, LongType()) for c in ("start", "length", "period")])


def _joined(left: np.ndarray, right: np.ndarray, shift: int) -> np.ndarray:
    """Names of the grams made of ``left`` and, ``shift`` places on, ``right``; -1 where the gram occurs once."""
    names = np.full(len(left), -1, np.int32)
    if len(left) <= shift:
        return names
    at = np.flatnonzero((left[:-shift] >= 0) & (right[shift:] >= 0))
    if len(at):
        key = left[at].astype(np.int64) * (int(right.max()) + 1) + right[at + shift]
        _, name, count = np.unique(key, return_inverse=True, return_counts=True)
        again = count[name] > 1
        names[at[again]] = name[again]
    return names


def _seeds(names: np.ndarray, k: int, near: int, far: int) -> tuple[np.ndarray, np.ndarray]:
    """Place and lag, from ``near`` up to below ``far``, of all equal grams whose first place is divisible by ``k``."""
    n = len(names)
    at = np.flatnonzero(names >= 0)
    places = np.sort(names[at].astype(np.int64) * (n + 1) + at)
    first = at[at % k == 0]
    base = names[first].astype(np.int64) * (n + 1)
    low = np.searchsorted(places, base + np.minimum(first + near, n))
    high = np.searchsorted(places, base + np.minimum(first + far, n))
    count = high - low
    i = np.repeat(first, count)
    rank = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
    return i, places[rank] % (n + 1) - i


def _uncovered(i: np.ndarray, lag: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First place, end and lag of the rows of seeds that touch: per lag, the table of the furthest place covered."""
    order = np.lexsort((i, lag))
    i, lag = i[order], lag[order]
    furthest = i + k
    opens = np.ones(len(i), bool)
    opens[1:] = (lag[1:] != lag[:-1]) | (i[1:] > furthest[:-1])
    closes = np.ones(len(i), bool)
    closes[:-1] = opens[1:]
    return i[opens], furthest[closes], lag[opens]


def _extended(start: np.ndarray, end: np.ndarray, lag: np.ndarray, steps: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the equal places around each row, by grams of the given lengths, longest first."""
    start, end = start.copy(), end.copy()
    for size, names in steps:
        n = len(names)
        at = np.maximum(start - size, 0)
        start -= size * ((start >= size) & (names[at] >= 0) & (names[at] == names[at + lag]))
        at = np.minimum(end, n - 1)
        to = np.minimum(end + lag, n - 1)
        end += size * ((end + lag < n) & (names[at] >= 0) & (names[at] == names[to]))
    return start, end


def find_runs(words: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and smallest period of all runs, by start and period.

    ``words`` holds numbers: equal where the words of one text are equal, different between texts, -1 between texts.
    """
    single = np.full(len(words), -1, np.int32)
    kept = np.flatnonzero(words >= 0)
    if len(kept):
        again = np.bincount(words[kept])[words[kept]] > 1
        single[kept[again]] = words[kept[again]]
    k = max(1, (least + 1) // 2 // 2)
    names = single
    for size in range(1, k):
        names = _joined(names, single, size)
    steps = [(1, single)] * max(k - 1, 0)
    near, far = 1, 4 * k
    found: list[np.ndarray] = []
    while (names >= 0).any():
        i, lag = _seeds(names, k, near, far)
        first, covered, lag = _uncovered(i, lag, k)
        start, end = _extended(first, covered, lag, steps)
        length = end - start + lag
        runs = np.stack([start, length, lag])
        found.append(runs[:, length >= np.maximum(least, 2 * lag)])
        steps = [(k, names), *steps]
        names, k, near, far = _joined(names, names, k), 2 * k, far, 2 * far
    start, length, period = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    smallest = np.ones(len(start), bool)
    smallest[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[smallest], length[smallest], period[smallest]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _searched(texts: list[list[bytes]], least: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Number of words, runs and collapsed text of each text, given as words."""
    size = np.array([len(t) for t in texts], np.int64)
    offset = np.cumsum(size + 1) - size - 1
    words = np.full(int(size.sum()) + len(texts), -1, np.int64)
    base = 0
    for t, at in zip(texts, offset.tolist()):
        seen: dict[bytes, int] = {}
        words[at : at + len(t)] = [base + seen.setdefault(w, len(seen)) for w in t]
        base += len(seen)
    start, length, period = find_runs(words, least)
    # A text's place is followed by a separator, so places tell texts apart.
    text = np.searchsorted(offset, start, "right") - 1
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    dropped = np.cumsum(change) > 0
    held = set(text.tolist())
    collapsed = []
    for k, (t, at) in enumerate(zip(texts, offset.tolist())):
        if k in held:
            t = [w for w, gone in zip(t, dropped[at : at + len(t)].tolist()) if not gone]
        collapsed.append(b" ".join(t))
    runs = pa.StructArray.from_arrays([pa.array(start - offset[text]), pa.array(length), pa.array(period)], ["start", "length", "period"])
    bounds = pa.array(np.searchsorted(text, np.arange(len(texts) + 1)), pa.int32())
    return pa.array(size), pa.ListArray.from_arrays(bounds, runs), pa.array(collapsed, pa.binary()).cast(pa.string())


def detect(docs: DataFrame, keep: list[str], text_col: str = "text", least: int = LEAST) -> DataFrame:
    """Columns ``keep`` with ``n_words``, ``runs`` (by start, then period) and ``collapsed``: the text without the words
    that a run contains after its first period, joined by single spaces."""
    added = StructType().add("n_words", "long").add("runs", ArrayType(RUN)).add("collapsed", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Bytes are split at the six characters that part words.
            texts = batch.column(0).cast(pa.binary())
            done, held, count = 0, [], 0
            for k in range(batch.num_rows):
                held.append((texts[k].as_py() or b"").split())
                count += len(held[-1])
                if count >= CHUNK or k == batch.num_rows - 1:
                    rows = batch.slice(done, k + 1 - done)
                    yield pa.RecordBatch.from_arrays([*rows.columns[1:], *_searched(held, least)], [*batch.schema.names[1:], *added.names])
                    done, held, count = k + 1, [], 0

    return beside(docs, text_col, keep, added, run)


def spelled(runs: Column) -> Column:
    """Every run as ``start,length,period`` and a line feed."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")


def longest(runs: Column) -> Column:
    """The longest run; of equals the one with the smallest start, then period. Null if there is none."""
    first = F.array_max(F.transform(runs, lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    return F.when(first.isNotNull(), F.struct((-first.start).alias("start"), first.length.alias("length"), (-first.period).alias("period")))
