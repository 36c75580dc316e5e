"""Records that go on over the pieces of a split text file, put together without giving up the splits.

The text reader cuts a file at a separator wherever it stands, also inside a record: at a line break between quotes, or at a tag of
an element inside an element of the same name. What tells the two apart is a state that every piece changes: whether a quote is open,
or how many elements are. The change of a piece, and of a row of pieces, is two numbers; so every split is reduced to its change first
(``_changes``), the changes of a file's splits are run through in order (``_states``), and then each split knows the
state it begins in and is cut at its true record starts. Pieces stay in the task that reads them. Only a record that crosses
a split leaves fragments, one or two per split, and those are joined by their file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pharmalith.session import through_storage

# How a piece changes the state: QUOTES, to ``a`` from closed and to ``b`` from open; DEPTH, by ``a``, never below zero
# (``b``: whether the piece begins with an opening tag; others are no records at depth zero).
QUOTES, DEPTH = "quotes", "depth"

# Splits that begin inside a record and may be broadcast; beyond that the pieces are shuffled by split.
FEW_SPLITS = 100_000

_STATE = "file string, start bigint, state bigint"
_FRAGMENT = "file string, start bigint, place bigint, line string, part string"


def _after(kind: str, state: int, a: int, b: int) -> int:
    """The state after a piece."""
    if kind == QUOTES:
        return b if state else a
    return max(0, state + a)


def _composed(kind: str, change: tuple[int, int], a: int, b: int) -> tuple[int, int]:
    """The change of a row of pieces and one more. For DEPTH: ``x`` becomes ``max(low, x + by)``."""
    if kind == QUOTES:
        return _after(kind, change[0], a, b), _after(kind, change[1], a, b)
    return max(0, change[0] + a), change[1] + a


def _applied(kind: str, state: int, change: tuple[int, int]) -> int:
    return change[1 if state else 0] if kind == QUOTES else max(change[0], state + change[1])


def _unchanged(kind: str) -> tuple[int, int]:
    return 0, 1 if kind == QUOTES else 0


def _splits(batch: pa.RecordBatch) -> list[tuple[int, int]]:
    """First row and end of each split in a batch."""
    file, start = batch.column("file"), batch.column("start")
    n = batch.num_rows
    new = np.ones(n, bool)
    if n > 1:
        same = pc.and_(pc.equal(file[1:], file[:-1]), pc.equal(start[1:], start[:-1]))
        new[1:] = ~same.to_numpy(zero_copy_only=False)
    first = np.flatnonzero(new).tolist()
    return list(zip(first, [*first[1:], n]))


def _moving(kind: str, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``a``, ``b`` and the rows that change the state at all."""
    a, b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b"))
    return a, b, np.flatnonzero((a != 0) | (b != 1) if kind == QUOTES else a != 0)


def _changes(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, change = None, _unchanged(kind)
        names = ["file", "start", "low", "by"]

        def row() -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*key, *change), kinds)], names)

        for batch in batches:
            a, b, moving = _moving(kind, batch)
            for first, end in _splits(batch):
                here = (batch.column("file")[first].as_py(), batch.column("start")[first].as_py())
                if here != key:
                    if key:
                        yield row()
                    key, change = here, _unchanged(kind)
                for k in moving[np.searchsorted(moving, first) : np.searchsorted(moving, end)].tolist():
                    change = _composed(kind, change, int(a[k]), int(b[k]))
        if key:
            yield row()

    return run


def _states(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, state = None, 0
        for batch in batches:
            rows = []
            for f, start, low, by in zip(*(c.to_pylist() for c in batch.columns)):
                if f != file:
                    file, state = f, 0
                if state:
                    rows.append((f, start, state))
                state = _applied(kind, state, (low, by))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64()))], ["file", "start", "state"])

    return run


def _cut(kind: str, glue: str):
    """Whole records, and the fragments of those that cross a split: ``trail`` begins one, ``through`` goes on, ``lead`` ends it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, leading, held, at = None, 0, False, [], 0
        names = ["file", "start", "place", "line", "part"]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())

        for batch in batches:
            made: list[tuple] = []
            a, b, moving = _moving(kind, batch)
            place, line = batch.column("place"), batch.column("line")
            before = np.zeros(batch.num_rows, np.int64)
            after = np.zeros(batch.num_rows, np.int64)
            for first, end in _splits(batch):
                here = (batch.column("file")[first].as_py(), batch.column("start")[first].as_py())
                if here != key:
                    if held:
                        made.append((*key, at, glue.join(held), "through" if leading else "trail"))
                    key, state, held = here, batch.column("state")[first].as_py() or 0, []
                    leading, at = state != 0, place[first].as_py()
                done = first
                for k in moving[np.searchsorted(moving, first) : np.searchsorted(moving, end)].tolist():
                    before[done : k + 1] = after[done:k] = state
                    state = after[k] = _after(kind, state, int(a[k]), int(b[k]))
                    done = k + 1
                before[done:end] = after[done:end] = state
                spanning = first + np.flatnonzero((before[first:end] != 0) | (after[first:end] != 0))
                for k in spanning.tolist():
                    if not before[k]:
                        held, at = [], place[k].as_py()
                    held.append(line[k].as_py())
                    if not after[k]:
                        made.append((*key, at, glue.join(held), "lead" if leading else None))
                        held, leading = [], False
            whole = (before == 0) & (after == 0)
            if kind == DEPTH:
                whole &= b == 1
            kept = batch.filter(pa.array(whole)).select(names[:4])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.nulls(kept.num_rows, pa.string())], names)
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), kinds)], names)
        if held:
            made = [(*key, at, glue.join(held), "through" if leading else "trail")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), kinds)], names)

    return run


def joined(pieces: DataFrame, kind: str, glue: str) -> DataFrame:
    """Whole records of pieces ``file, start, place, line, a, b`` (``start``: of their split; ``place``: order in it).

    Columns ``file, start, place, line`` and ``complete``: false for a record that its file ends in the middle of.
    """
    changes = pieces.select("file", "start", "a", "b").mapInArrow(_changes(kind), "file string, start bigint, low bigint, by bigint")
    inside = changes.repartition("file").sortWithinPartitions("file", "start").mapInArrow(_states(kind), _STATE)
    # A row per split that begins inside a record: few, unless records are as long as splits.
    inside = through_storage(inside, "splits")
    few = inside.limit(FEW_SPLITS + 1).count() <= FEW_SPLITS
    known = pieces.join(F.broadcast(inside) if few else inside, ["file", "start"], "left")
    if not few:
        known = known.repartition("file", "start").sortWithinPartitions("file", "start", "place")
    cut = known.select("file", "start", "place", "line", "a", "b", "state").mapInArrow(_cut(kind, glue), _FRAGMENT)
    cut = through_storage(cut, "records")
    number = F.count_if(F.col("part") == "trail").over(Window.partitionBy("file").orderBy("start", "place"))
    fragments = cut.filter("part is not null").withColumn("number", number)
    parts = F.sort_array(F.collect_list(F.struct("start", "place", "line", "part")))
    crossing = fragments.groupBy("file", "number").agg(parts.alias("parts"))
    first = F.col("parts")[0]
    crossing = crossing.select(
        "file",
        first.start.alias("start"),
        first.place.alias("place"),
        F.array_join(F.transform("parts", lambda p: p.line), glue).alias("line"),
        (F.element_at("parts", -1).part == "lead").alias("complete"),
    )
    return cut.filter("part is null").drop("part").withColumn("complete", F.lit(True)).unionByName(crossing)
