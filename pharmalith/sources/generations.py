"""Builds as generations: all relations of a build become visible at once, or none.

A build writes below ``generations/<number>``, which nobody reads yet. When all its relations are written, one small file under
``manifests`` names the generation, its relations and their rows; readers follow the newest manifest. Making that file is the
one step that counts: it is written under another name and renamed, which fails if the number is already taken, so of two builds
that end together the later one takes the next number. A build that breaks off leaves files that no manifest names.
Readers that have begun keep the generation they began with; ``prune`` removes old and unfinished ones.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from pharmalith.session import _folder
from pharmalith.sources.tables import write_relations

MANIFESTS, GENERATIONS = "manifests", "generations"


@dataclass(frozen=True)
class Generation:
    """One finished build: number, folder of its relations, rows of each."""

    number: int
    folder: str
    rows: Mapping[str, int]


def _numbers(spark: SparkSession, root: str) -> list[int]:
    fs, folder = _folder(spark, f"{root}/{MANIFESTS}")
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def _manifest(spark: SparkSession, root: str, number: int) -> Generation:
    text = spark.read.text(f"{root}/{MANIFESTS}/{number:012d}.json", wholetext=True).first()[0]
    held = json.loads(text)
    return Generation(number, f"{root}/{GENERATIONS}/{held['folder']}", held["rows"])


def history(spark: SparkSession, root: str) -> list[Generation]:
    """All finished builds, oldest first."""
    root = root.rstrip("/")
    return [_manifest(spark, root, n) for n in _numbers(spark, root)]


def current(spark: SparkSession, root: str) -> Generation | None:
    """The newest finished build."""
    root = root.rstrip("/")
    numbers = _numbers(spark, root)
    return _manifest(spark, root, numbers[-1]) if numbers else None


def read(spark: SparkSession, root: str, names: list[str] | None = None, number: int | None = None) -> dict[str, DataFrame]:
    """Relations of the newest build, or of an earlier one that is still kept."""
    held = current(spark, root) if number is None else _manifest(spark, root.rstrip("/"), number)
    if held is None:
        raise ValueError(f"no finished build in {root}")
    return {n: spark.read.parquet(f"{held.folder}/{n}.parquet") for n in (names or held.rows)}


def build(spark: SparkSession, root: str, relations: Mapping[str, DataFrame]) -> Generation:
    """Write all relations and make them the current ones in one step."""
    root = root.rstrip("/")
    name = uuid.uuid4().hex
    return publish(spark, root, name, write_relations(relations, f"{root}/{GENERATIONS}/{name}"))


def staged(root: str) -> tuple[str, str]:
    """Name and folder of a generation that nobody reads until it is published."""
    name = uuid.uuid4().hex
    return name, f"{root.rstrip('/')}/{GENERATIONS}/{name}"


def publish(spark: SparkSession, root: str, name: str, rows: Mapping[str, int]) -> Generation:
    """Make a written generation the current one."""
    root = root.rstrip("/")
    held = json.dumps({"folder": name, "rows": dict(rows)}, sort_keys=True)
    fs, draft = _folder(spark, f"{root}/{MANIFESTS}/.{name}.draft")
    out = fs.create(draft, True)
    try:
        out.write(bytearray(held.encode()))
    finally:
        out.close()
    while True:
        number = max(_numbers(spark, root), default=0) + 1
        _, final = _folder(spark, f"{root}/{MANIFESTS}/{number:012d}.json")
        # Renaming never replaces a file: someone else's build with this number stays, and the next number is tried.
        if not fs.exists(final) and fs.rename(draft, final):
            return Generation(number, f"{root}/{GENERATIONS}/{name}", dict(rows))
        if not fs.exists(final):
            raise OSError(f"cannot write {final}")


def prune(spark: SparkSession, root: str, keep: int = 2, unfinished: bool = False) -> list[str]:
    """Remove all builds but the newest ``keep``; ``unfinished``: also folders that no manifest names (no build may be running then).

    Returns the names of the folders removed.
    """
    root = root.rstrip("/")
    builds = history(spark, root)
    old, kept = builds[: max(0, len(builds) - keep)], builds[max(0, len(builds) - keep) :]
    gone = []
    for held in old:
        for path in (f"{root}/{MANIFESTS}/{held.number:012d}.json", held.folder):
            fs, folder = _folder(spark, path)
            fs.delete(folder, True)
        gone.append(held.folder.rsplit("/", 1)[1])
    fs, folder = _folder(spark, f"{root}/{GENERATIONS}")
    if unfinished and fs.exists(folder):
        named = {b.folder.rsplit("/", 1)[1] for b in kept}
        for status in fs.listStatus(folder):
            name = status.getPath().getName()
            if name not in named:
                fs.delete(status.getPath(), True)
                gone.append(name)
    return sorted(gone)
