"""Helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

# Fixed value: the characters that part words, as a class for Spark's patterns.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SPACE_PATTERN = r"[\x20\x09-\x0D]+"


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` is called so (in any letter case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_columns(df: DataFrame, wanted: Iterable[str], kinds: dict[str, str]) -> DataFrame:
    """The ``wanted`` columns; those that are absent are null."""
    have = set(df.columns)
    return df.select(*[F.col(f"`{c}`") if c in have else F.lit(None).cast(kinds.get(c, "string")).alias(c) for c in wanted])


def row_hash(*columns: str) -> Column:
    """64 bits of the named columns; with the id it tells rows of one id apart."""
    return F.xxhash64(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c in columns])


def word_count(text: Column) -> Column:
    """Words of a text as a long; a null text has none."""
    return F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit(WORD_PATTERN))).cast("long")


def keep_rows(docs: DataFrame, marked: DataFrame, id_col: str, hashed: list[str], once: bool = False, drop: bool = False) -> DataFrame:
    """Rows of ``docs`` whose (id, hash of ``hashed``) is in ``marked`` (columns ``k_id``, ``k_hash``), or is not (``drop``).

    The shuffle is by id and hash, which is even unless one whole row repeats; such a partition is split
    by adaptive execution, as the join is a left semi or anti join. ``once`` keeps one of several equal rows. Rows travel as one struct, so
    that no column of theirs meets one of ours.
    """

    def keyed(who: Column, rest: Column) -> list[Column]:
        # No key is null, so the join and ``once`` share one shuffle.
        return [who.isNull().alias("d_none"), F.coalesce(who.cast("string"), F.lit("")).alias("d_id"), rest.alias("d_hash")]

    keys = ["d_none", "d_id", "d_hash"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d_row"), *keyed(F.col(id_col), row_hash(*hashed)))
    out = rows.join(marked.select(*keyed(F.col("k_id"), F.col("k_hash"))), keys, "left_anti" if drop else "left_semi")
    if once:
        out = out.dropDuplicates(keys)
    return out.select("d_row.*")


def bounded_sample(rows: DataFrame, key: str, count: int, most: int) -> DataFrame:
    """At most ``most`` of ``count`` rows: those with the smallest hashes of ``key``.

    Rows that cannot be among them are left out where they are, so what meets in one task is bounded as well.
    """
    part = min(1.0, (1.5 * most + 1000) / max(count, 1))
    rank = F.xxhash64(F.col(key), F.lit(1))
    near = rows if part >= 1.0 else rows.filter(F.pmod(rank, F.lit(1 << 30)) < int(part * (1 << 30)))
    return near.orderBy(F.pmod(rank, F.lit(1 << 30)), key).limit(most)


def beside(docs: DataFrame, read: str, keep: list[str], added: StructType, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """Columns ``keep`` and those that ``run`` adds to each row. Its batches hold the column ``read`` first, then the kept ones; it
    gives back the kept ones, then its own. Names are plain inside, so kept columns may be called anything."""
    kept = docs.select(*[F.col(f"`{c}`") for c in keep])
    plain = [f"kept_{k}" for k in range(len(keep))]
    rows = docs.select(F.col(f"`{read}`").alias("read"), *[F.col(f"`{c}`").alias(n) for c, n in zip(keep, plain)])
    schema = StructType([*[StructField(n, f.dataType) for n, f in zip(plain, kept.schema)], *added])
    return rows.mapInArrow(run, schema).toDF(*keep, *added.names)
