"""Language identification: script ranges, word scores and a Viterbi path with a switching penalty.

Training counts letter trigrams (with word ends) and scripts per language, over whole texts, as one grouped sum. A word is
scored by the logarithms of its trigram shares. Only languages that write the script of the word's first letter are
candidates. The best path over the words of a text, on which every change of language costs
``SWITCH``, labels its spans; the language of a text is the one with most letters.

Numbers are worked out by numpy over batches of whole texts; batches are cut by size, never texts.

Defined results: null or letterless texts are ``und`` with score 0, as is every text if nothing was learned; a script
that no language has learned leaves all languages as candidates; ties go to the first language by code point. Rows of training
without text or language teach nothing. Repeated rows are labelled alike. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNKNOWN = "und"
BUCKETS = 1 << 15
SMOOTHING = 0.5
# A language writes a script if at least this share of its letters is of it.
SCRIPT_SHARE = 0.02
# Cost of a change of language between two words, and the most that one word may count, in natural logarithms.
SWITCH = 12.0
WORD_MOST = 8.0
CHARS = 1 << 20
PATH_CELLS = 8 << 20

# First and last code point of the blocks of each script.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF), (0xFB1D, 0xFB4F)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9D)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)],
}
OTHER_SCRIPT = len(SCRIPTS)
_tables: dict[str, np.ndarray] = {}


def tables() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: its lower case if a letter, else 0; and its script."""
    if not _tables:
        lower = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                small = s.lower()
                lower[c] = ord(small) if len(small) == 1 else c
        script = np.full(0x110000, OTHER_SCRIPT, np.uint8)
        for k, blocks in enumerate(SCRIPTS.values()):
            for first, last in blocks:
                script[first : last + 1] = k
        _tables.update(lower=lower, script=script)
    return _tables["lower"], _tables["script"]


@dataclass
class Scan:
    """Letters of some texts: their places in the joined text, trigram buckets, and the words they make."""

    bucket: np.ndarray  # per letter
    script: np.ndarray  # per letter
    owner: np.ndarray  # text per word
    first: np.ndarray  # number of the first letter per word
    start: np.ndarray  # code point in its text per word
    size: np.ndarray  # letters per word


def scan(texts: list[str | None]) -> Scan:
    lower, scripts = tables()
    # Two separators keep words of neighbouring texts apart.
    raw = "\n".join(t or "" for t in texts)
    points = np.frombuffer(("\n" + raw + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    low = lower[points]
    letters = np.flatnonzero(low)
    low = low.astype(np.uint64)
    a, b, c = low[letters - 1], low[letters], low[letters + 1]
    mixed = (a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F) + c * np.uint64(0x165667B19E3779F9)) * np.uint64(
        0xD6E8FEB86659FD93
    )
    head = a == 0
    first = np.flatnonzero(head)
    lengths = np.fromiter((len(t or "") for t in texts), np.int64, len(texts))
    begin = np.cumsum(lengths + 1) - lengths
    at = letters[first]
    owner = np.searchsorted(begin, at, side="right") - 1
    return Scan(
        (mixed >> np.uint64(64 - 15)).astype(np.int64),
        scripts[points[letters]],
        owner,
        first,
        at - begin[owner],
        np.diff(np.r_[first, len(letters)]),
    )


def by_size(texts: list[str | None], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``most`` characters."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end] or "") <= most):
            size += len(texts[end] or "")
            end += 1
        yield at, end
        at = end


def learn(labelled: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, their log trigram shares and whether they write each script.

    What reaches the driver is one row per language and feature, whatever the size of the corpus.
    """
    width = BUCKETS + OTHER_SCRIPT + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), object)
            for at, end in by_size(texts, CHARS):
                s = scan(texts[at:end])
                of_letter = np.repeat(s.owner, s.size)
                names, number = np.unique(langs[at:end], return_inverse=True)
                lang = number[of_letter]
                for k, name in enumerate(names):
                    mine = lang == k
                    total = seen.setdefault(name, np.zeros(width, np.int64))
                    total += np.bincount(s.bucket[mine], minlength=width)
                    total += np.bincount(BUCKETS + s.script[mine].astype(np.int64), minlength=width)
        for name, total in seen.items():
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(total[some])], ["lang", "feature", "n"]
            )

    rows = labelled.select("text", "lang").filter("text is not null and lang is not null")
    counts = rows.mapInArrow(run, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    found: dict[str, np.ndarray] = {}
    for lang, feature, n in counts.toLocalIterator():
        found.setdefault(lang, np.zeros(width))[feature] = n
    # Code point order, as in the stated tie rule.
    langs = sorted(found)
    if not langs:
        return [], np.zeros((BUCKETS, 0), np.float32), np.zeros((OTHER_SCRIPT + 1, 0), bool)
    table = np.array([found[x] for x in langs])
    grams, scripts = table[:, :BUCKETS], table[:, BUCKETS:]
    logs = np.log((grams + SMOOTHING) / (grams.sum(axis=1, keepdims=True) + SMOOTHING * BUCKETS))
    writes = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=1, keepdims=True), 1)
    return langs, np.ascontiguousarray(logs.T.astype(np.float32)), writes.T


def word_scores(s: Scan, logs: np.ndarray, writes: np.ndarray) -> np.ndarray:
    """Score of every word and language, 0 for the best and not below ``-WORD_MOST``; others than candidates far below."""
    total = np.add.reduceat(logs[s.bucket], s.first, axis=0)
    candidate = writes[s.script[s.first]]
    candidate |= ~candidate.any(axis=1, keepdims=True)
    total[~candidate] = -np.inf
    total -= total.max(axis=1, keepdims=True)
    return np.where(candidate, np.maximum(total, -WORD_MOST), -2 * WORD_MOST).astype(np.float32)


def best_path(scores: np.ndarray, words: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Label of every word on the best path of its text; ``words`` has the number of words per text, none 0.

    All texts take a step at a time, the longest ones first in the order, so those that go on are a head of it.
    """
    order = np.argsort(-words, kind="stable")
    start = (np.cumsum(words) - words)[order]
    length = words[order]
    n, langs = scores.shape
    changed = np.zeros((n, langs), bool)
    source = np.zeros(n, np.int32)
    value = scores[start].copy()
    longest = int(length[0])
    going = np.searchsorted(-length, -np.arange(longest), side="left")  # texts with more than t words
    for t in range(1, longest):
        k = going[t]
        at = start[:k] + t
        v = value[:k]
        best = v.max(axis=1)
        source[at] = v.argmax(axis=1)
        by_change = (best - switch)[:, None]
        changed[at] = v < by_change
        value[:k] = np.maximum(v, by_change) - best[:, None] + scores[at]
    label = np.zeros(n, np.int32)
    state = value.argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        k = going[t]
        at = start[:k] + t
        now = state[:k]
        label[at] = now
        if t:
            state[:k] = np.where(changed[at, now], source[at], now)
    return label


def label_texts(texts: list[str | None], langs: list[str], logs: np.ndarray, writes: np.ndarray) -> tuple[list, list, list]:
    """Per text: language, score, and spans (first and last word of one language as start, end, language)."""
    name, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
    spans: list[list[dict]] = [[] for _ in texts]
    if not langs:
        return name, score, spans
    held: list[tuple[Scan, np.ndarray, int]] = []
    cells = 0

    def flush() -> None:
        nonlocal cells
        if not held:
            return
        owner = np.concatenate([s.owner + base for s, _, base in held])
        size = np.concatenate([s.size for s, _, _ in held])
        start = np.concatenate([s.start for s, _, _ in held])
        scores = np.concatenate([x for _, x, _ in held])
        heads = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        label = best_path(scores, np.diff(np.r_[heads, len(owner)]))
        which = np.cumsum(np.r_[0, owner[1:] != owner[:-1]])
        mass = np.bincount(which * len(langs) + label, weights=size, minlength=len(heads) * len(langs)).reshape(-1, len(langs))
        best = mass.argmax(axis=1)
        part = mass[np.arange(len(heads)), best] / mass.sum(axis=1)
        for k, h in enumerate(heads.tolist()):
            name[owner[h]], score[owner[h]] = langs[best[k]], float(part[k])
        runs = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (label[1:] != label[:-1])])
        ends = np.r_[runs[1:], len(owner)] - 1
        for a, b, o, x in zip(start[runs].tolist(), (start[ends] + size[ends]).tolist(), owner[runs].tolist(), label[runs].tolist()):
            spans[o].append({"start": a, "end": b, "lang": langs[x]})
        held.clear()
        cells = 0

    for at, end in by_size(texts, max(CHARS // 16, 4 * CHARS // max(4, len(langs)))):
        s = scan(texts[at:end])
        if len(s.first):
            held.append((s, word_scores(s, logs, writes), at))
            cells += len(s.first) * len(langs)
        if cells > PATH_CELLS:
            flush()
    flush()
    return name, score, spans


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep`` of ``docs`` with ``lang_pred``, ``score`` (share of letters) and ``spans`` (start, end, lang; code points)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).schema
    span = T.StructType().add("start", "long").add("end", "long").add("lang", "string")
    out = schema.add("lang_pred", "string").add("score", "double").add("spans", T.ArrayType(span))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            name, score, spans = label_texts(batch.column(0).to_pylist(), *shared.value)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(name, pa.string()), pa.array(score, pa.float64()), pa.array(spans, kind)],
                [*batch.schema.names[1:], "lang_pred", "score", "spans"],
            )

    return docs.select(F.col(f"`{text_col}`"), *[F.col(f"`{c}`") for c in keep]).mapInArrow(run, out)


def held_out(id_col: Column) -> Column:
    """Whether a document is kept from training; a null id counts as an empty one."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 5 == 0
