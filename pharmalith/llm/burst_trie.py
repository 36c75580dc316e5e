"""Prefix trie of conversations as a burst trie: containers of suffixes under heads, swept into nodes.

A turn is 128 bits of its role and text, a conversation the row of its turns, its path. Equal conversations become one entry
first, with their number, smallest id and the digest of their ids. All entries start in one container under the root. A
container that is too large bursts: its head becomes a node of the upper trie and its entries go on to one container per next turn; an
entry that ends there stays at the head. Rounds go on until no container is too large, and read only what the round before has burst. The
remaining containers are dealt over shards by their heads, sorted, and swept from the first entry to the last: the
turns an entry shares with the one before it are open nodes, the others open new ones. So a shard holds one container at a
time, at most ``MOST_ENTRIES`` entries and ``MOST_TURNS`` turns (or a single entry, however long). Numbers of the upper trie are grouped
sums from its lowest level to the root.

The digest of a node's ids is of one string in order, so it is taken in one pass: ids are joined in blocks of ``BLOCK`` possible
values, in parallel and bounded, and the blocks of a path are fed to the digest one after the other.

A conversation is a row, as a document is: 16 bytes and a number per turn in the shuffles after the first.

Defined results: rows with a null id belong to no conversation. Null turn numbers come first, turns of equal number are
ordered by role, then text; repeated rows are turns each. Null roles and texts are empty. Other columns are not read.
Without conversations there are no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pharmalith.llm.common import with_columns, word_count
from pharmalith.session import through_storage, tune

# Bytes of a turn in a path.
TURN = 16
# A larger container bursts.
MOST_ENTRIES, MOST_TURNS = 1 << 11, 1 << 15
# Ids of one string on the way to a digest; rows of heads that may be broadcast.
BLOCK = 1 << 16
FEW_HEADS = 100_000
# Rows of a batch that a task hands on.
BATCH = 1 << 14

NO_ENDS = hashlib.sha256(b"").hexdigest()
ENTRY = "path binary, words array<long>, weight long, least long, ends_sha256 string"
NODE = "head binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def sequences(conversations: DataFrame) -> DataFrame:
    """``conv_id, turns``: one row per conversation, its turns in order as ``id`` (128 bits) and ``words``."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = with_columns(conversations, ["conv_id", "turn", "role", "text"], {"conv_id": "long", "turn": "long"}).filter("conv_id is not null")
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    turn = F.struct("turn", "role", "text", F.substring(F.unhex(digest), 1, TURN).alias("id"), word_count(F.col("text")).alias("words"))
    held = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return held.select("conv_id", F.transform("turns", lambda t: F.struct(t.id.alias("id"), t.words.alias("words"))).alias("turns"))


def entries(held: DataFrame) -> DataFrame:
    """One row per distinct path: number, smallest id and digest of the conversations that are this path."""
    path = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t.id)), ""))
    words = F.transform("turns", lambda t: t.words)
    rows = held.select(path.alias("path"), words.alias("words"), "conv_id", F.floor(F.col("conv_id") / BLOCK).alias("block"))
    blocks = rows.groupBy("path", "words", "block").agg(
        F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("ids"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("path", pa.binary()), ("words", pa.list_(pa.int64())), ("weight", pa.int64()), ("least", pa.int64()), ("ends_sha256", pa.string())]
        )
        done: list[list] = []
        digest = hashlib.sha256()
        for batch in batches:
            paths, words, ids, n, least = (batch.column(c).to_pylist() for c in ("path", "words", "ids", "n", "least"))
            for k, p in enumerate(paths):
                if done and done[-1][0] == p:
                    digest.update(b",")
                    done[-1][2] += n[k]
                else:
                    if done:
                        done[-1][4] = digest.hexdigest()
                    if len(done) >= BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
                        done = []
                    done.append([p, words[k], n[k], least[k], None])
                    digest = hashlib.sha256()
                digest.update(ids[k].encode())
        if done:
            done[-1][4] = digest.hexdigest()
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)

    ordered = blocks.repartition("path").sortWithinPartitions("path", "block")
    return ordered.select("path", "words", "ids", "n", "least").mapInArrow(run, ENTRY)


def _head(depth: int) -> Column:
    return F.substring("path", 1, TURN * depth)


def _small(heads: DataFrame, count: int) -> DataFrame:
    """Heads are broadcast only up to a number that is known to fit."""
    return F.broadcast(heads) if count <= FEW_HEADS else heads


def burst(found: DataFrame, most_entries: int, most_turns: int) -> tuple[list[DataFrame], list[DataFrame], list[DataFrame], list[int]]:
    """Containers, burst heads and entries that end at a burst head, by depth, and the number of burst heads."""
    live, depth = found, 0
    settled, upper, ended, count = [], [], [], []
    while True:
        rows = live.withColumn("head", _head(depth))
        rest = F.length("path") / TURN - depth
        last = F.col("words")[depth - 1] if depth else F.lit(0)
        sizes = rows.groupBy("head").agg(F.count(F.lit(1)).alias("n"), F.sum(rest).alias("turns"), F.min(last).cast("long").alias("last_words"))
        large = sizes.filter((F.col("n") > 1) & ((F.col("n") > most_entries) | (F.col("turns") > most_turns)))
        large = through_storage(large.select("head", "last_words"), "burst_heads")
        count.append(large.count())
        if not count[-1]:
            return [*settled, rows], upper, ended, count
        heads = _small(large.select("head"), count[-1])
        settled.append(rows.join(heads, "head", "left_anti").select(*rows.columns))
        part = rows.join(heads, "head", "left_semi")
        ended.append(part.filter(F.length("path") == TURN * depth))
        upper.append(large)
        live = through_storage(part.filter(F.length("path") > TURN * depth).drop("head"), "burst")
        depth += 1


def sweep(head: bytes, held: list[tuple[bytes, list[int], int, int, str]]) -> list[tuple]:
    """Nodes of one container, whose entries are sorted by path."""
    base = len(head) // TURN
    depth, parent, words, n, least, ends, kids = [base], [-1], [held[0][1][base - 1] if base else 0], [0], [held[0][3]], [NO_ENDS], [0]
    open_nodes, before = [0], head
    for path, path_words, weight, low, digest in held:
        shared, most = base, min(len(before), len(path)) // TURN
        while shared < most and before[shared * TURN : (shared + 1) * TURN] == path[shared * TURN : (shared + 1) * TURN]:
            shared += 1
        del open_nodes[shared - base + 1 :]
        for d in range(shared, len(path) // TURN):
            kids[open_nodes[-1]] += 1
            parent.append(open_nodes[-1])
            open_nodes.append(len(depth))
            depth.append(d + 1)
            words.append(path_words[d])
            n.append(0)
            least.append(low)
            ends.append(NO_ENDS)
            kids.append(0)
        at = open_nodes[-1]
        n[at] += weight
        least[at] = min(least[at], low)
        ends[at] = digest
        before = path
    leaves, saved = [int(not k) for k in kids], [0] * len(kids)
    for k in range(len(depth) - 1, -1, -1):  # children stand behind their parents
        saved[k] += (n[k] - 1) * words[k]
        p = parent[k]
        if p >= 0:
            n[p] += n[k]
            least[p] = min(least[p], least[k])
            leaves[p] += leaves[k]
            saved[p] += saved[k]
    above = [least[p] if p >= 0 else None for p in parent]
    heads = [head] + [None] * (len(depth) - 1)
    return list(zip(heads, least, depth, above, n, kids, leaves, saved, ends))


def _sweeping() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("head", pa.binary()), *[(c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]]
            + [("ends_sha256", pa.string())]
        )
        head, held, nodes = None, [], []
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("head", "path", "words", "weight", "least", "ends_sha256"))
            for h, *entry in zip(*columns):
                if h != head and held:
                    nodes += sweep(head, held)
                    held = []
                    if len(nodes) >= BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*nodes), schema)], schema=schema)
                        nodes = []
                head = h
                held.append(tuple(entry))
        if held:
            nodes += sweep(head, held)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*nodes), schema)], schema=schema)

    return run


def nodes(held: DataFrame, most_entries: int = MOST_ENTRIES, most_turns: int = MOST_TURNS) -> DataFrame:
    """All nodes of the trie over ``conv_id, turns`` (as ``sequences`` gives them; turns of any making).

    ``conv_id`` is the smallest member, ``n_convs`` the members, ``saved_tokens`` the words that sharing the node's last texts and
    those below saves, ``ends_sha256`` the digest of the ids of members that end here.
    """
    tune(held.sparkSession)
    found = through_storage(entries(held), "entries")
    settled, upper, ended, count = burst(found, most_entries, most_turns)
    containers = reduce(DataFrame.unionByName, settled)
    shards = containers.repartition("head").sortWithinPartitions("head", "path")
    swept = shards.select("head", "path", "words", "weight", "least", "ends_sha256").mapInArrow(_sweeping(), NODE)
    swept = through_storage(swept, "swept")
    if not upper:
        return swept.drop("head")

    sums = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    heads = swept.filter("head is not null")
    below, levels = None, []
    for depth in range(len(upper) - 1, -1, -1):
        child = heads.filter(F.col("depth") == depth + 1).select("head", "conv_id", "n_convs", "n_leaves", "saved_tokens")
        if below is not None:
            child = child.unionByName(below.select(*child.columns))
        up = F.substring("head", 1, TURN * depth).alias("head")
        none = F.lit(0).cast("long")
        child = child.select(up, "conv_id", "n_convs", F.lit(1).cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.lit(None).cast("string").alias("ends"))
        own = ended[depth].select(
            "head", F.col("least").alias("conv_id"), F.col("weight").alias("n_convs"), *[none.alias(c) for c in sums[1:]], F.col("ends_sha256").alias("ends")
        )
        grouped = child.unionByName(own).groupBy("head").agg(F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in sums], F.max("ends").alias("ends"))
        level = grouped.join(_small(upper[depth], count[depth]), "head").select(
            "head",
            "conv_id",
            F.lit(depth).cast("long").alias("depth"),
            *sums[:3],
            (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("last_words")).alias("saved_tokens"),
            F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"),
        )
        below = through_storage(level, "upper")
        levels.append(below)
    top = reduce(DataFrame.unionByName, levels)
    low = swept.filter("head is null").drop("head")
    parents = top.select(F.col("head").alias("up"), F.col("conv_id").alias("above"))
    seam = heads.drop("parent_conv_id").unionByName(top).withColumn("up", F.expr(f"case when depth > 0 then substring(head, 1, {TURN} * (cast(depth as int) - 1)) end"))
    seam = seam.join(_small(parents, sum(count)), "up", "left").withColumnRenamed("above", "parent_conv_id")
    return low.unionByName(seam.select(*low.columns))


def trie(conversations: DataFrame) -> DataFrame:
    """All nodes of the prefix trie of a table of turns (``conv_id, turn, role, text``)."""
    return nodes(sequences(conversations))


# Unsigned CRC-32 of the decimal digits of an id, by its definition: one byte, then eight shifts.
_CRC = (
    "xor(list_reduce([4294967295::bigint] || flatten(list_transform(string_split(conv_id::varchar, ''), "
    "lambda c: [ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1])), "
    "lambda a, x: case when x >= 0 then xor(a, x) when a % 2 = 1 then xor(a // 2, 3988292384::bigint) else a // 2 end), 4294967295::bigint)"
)

ORACLE_SQL = rf"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as pos from t),
i as (select conv_id, conv_id - conv_id % 20 as base, {_CRC} % 4 as h from (select distinct conv_id from t)),
r as (select i.conv_id, 0 as part, o.pos, o.role, o.text from i join o on o.conv_id = i.base and o.pos <= i.h
  union all select i.conv_id, 1, o.pos, o.role, o.text from i join o on o.conv_id = i.conv_id and o.pos > i.h),
s as (select conv_id, row_number() over (partition by conv_id order by part, pos) as depth,
  sha256(length(role)::varchar || ':' || role || text) as turn_id, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as words from r),
m as (select conv_id, 0 as depth, '' as path, 0 as words, coalesce((select max(depth) from s where s.conv_id = i.conv_id), 0) = 0 as ends from i
  union all select conv_id, depth, string_agg(turn_id, '') over (partition by conv_id order by depth), words,
  depth = max(depth) over (partition by conv_id) from s),
n as (select depth, path, min(conv_id) as conv_id, count(*) as n_convs, any_value(words) as words,
  sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where ends), '')) as ends_sha256 from m group by depth, path),
p as (select n.*, u.conv_id as parent_conv_id from n left join m on m.conv_id = n.conv_id and m.depth = n.depth - 1
  left join n u on u.depth = m.depth and u.path = m.path),
k as (select depth + 1 as depth, parent_conv_id, count(*) as n_children from (select depth - 1 as depth, parent_conv_id from p where depth > 0) group by all),
q as (select p.*, coalesce(k.n_children, 0) as n_children from p left join k on k.depth = p.depth + 1 and k.parent_conv_id = p.conv_id),
a as (select m.depth, m.path, sum((q.n_children = 0)::bigint) as n_leaves, sum((q.n_convs - 1) * q.words) as saved_tokens
  from q join m on m.conv_id = q.conv_id and m.depth <= q.depth group by m.depth, m.path)
select q.conv_id, q.depth::bigint as depth, q.parent_conv_id, q.n_convs, q.n_children, a.n_leaves::bigint as n_leaves,
  a.saved_tokens::bigint as saved_tokens, q.ends_sha256 from q join a on a.depth = q.depth and a.path = q.path
"""
