"""Mixing sources to target weights by Pareto order sampling.

Targets are shares of the corpus by weight, none above ``max_copies`` times its source. A target is met by
certain whole copies of every document of the source, and one more copy of a sample: every document gets a random
number from a hash of its id and text, documents are ranked by its odds divided by their inclusion odds (Pareto
sampling), and the sample is the head of that order that fits into the rest of the target, so its size is fixed, in
words; two further rounds fill what the first document that did not fit left open (what they leave open stays so). Inclusion odds differ
from source to source, and from document to document where an ``appeal`` multiplies them: a column, or a function of the size such as
``by_length``.

Only DataFrame functions are used. The order is never sorted as a whole: ranks fall into ``BUCKETS`` slices per
source, words per slice are summed, and only the slice in which the target is reached is sorted. The result is a few
thresholds per source, so documents are drawn where they stand, without a shuffle of texts.

Defined results: null text has size 0; a null source is a source, the last one; documents of equal id and text have equal
ranks and are drawn together; a source without words has target 0; an empty table gives no rows. Other columns are
kept as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pharmalith.llm.common import fresh, with_columns, word_count
from pharmalith.session import through_storage, tune

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_COPIES = 2
BUCKETS = 2048
ROUNDS = 3


def random_unit(id_col: Column, text: Column, seed: int) -> Column:
    """A number between 0 and 1, both excluded, fixed by seed, id and text."""
    key = F.concat_ws("|", F.lit(str(seed)), F.coalesce(id_col.cast("string"), F.lit("")), F.coalesce(text, F.lit("")))
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def by_length(size: Column) -> Column:
    """Twice the odds for documents that are neither scraps nor whole books, in words."""
    return F.when(size.between(50, 5000), F.lit(2.0)).otherwise(F.lit(1.0))


Appeal = str | Callable[[Column], Column] | None


def _appeal(appeal: Appeal, column: Callable[[str], Column], size: Column) -> Column:
    if appeal is None:
        return F.lit(1.0)
    return appeal(size) if callable(appeal) else column(appeal).cast("double")


def pareto_rank(unit: Column, inclusion: Column, appeal: Column | None = None) -> Column:
    """Random odds over inclusion odds; null if there are none."""
    odds = inclusion / (1.0 - inclusion)
    return (unit / (1.0 - unit)) / F.nullif(odds if appeal is None else odds * appeal, F.lit(0.0))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, max_copies: int = MAX_COPIES) -> DataFrame:
    """``source, source_size`` with ``target``, ``whole`` copies and the ``part`` drawn beside them.

    One row per source; sources are few beside documents, so the two windows over them run in one task.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("weight", F.array(*[F.lit(int(w)) for w in weights])[(F.row_number().over(by_name) - 1) % len(weights)])
    everything = Window.partitionBy()
    by_room = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    earlier = by_room.rowsBetween(Window.unboundedPreceding, -1)
    # Sources in the order in which a common level per weight fills them; the level once the earlier ones are full:
    filled = weighed.withColumn(
        "level",
        (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("source_size").over(earlier), F.lit(0)) * max_copies)
        / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0))),
    ).withColumn("full", F.col("source_size") * max_copies <= F.col("weight") * F.col("level"))
    # Levels fall after the first source that is not full, so the highest is the one that holds.
    level = F.max(F.when(~F.col("full"), F.col("level"))).over(everything)
    return (
        filled.withColumn(
            "target", F.when(F.col("full"), (F.col("source_size") * max_copies).cast("double")).otherwise(F.col("weight") * level)
        )
        .withColumn("copies", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
        .withColumn("whole", F.floor("copies").cast("int"))
        .withColumn("part", F.col("copies") - F.col("whole"))
        .select("source", "source_size", "target", "whole", "part")
    )


def _slice(rank: Column) -> Column:
    return F.floor(rank / (1.0 + rank) * BUCKETS).cast("int")


def _head(ranked: DataFrame) -> DataFrame:
    """Per source the head of the order that fits into ``rest``: ``h_source, h_last`` (its greatest rank), ``h_words``,
    ``h_stop`` (the rank that no longer fits; null if all do).

    ``ranked`` has source, size, rank and rest. Whole slices are summed; only the one that no longer fits is sorted.
    """
    sliced = ranked.withColumn("slice", _slice(F.col("rank")))
    slices = sliced.groupBy("source", "slice").agg(F.sum("size").alias("words"), F.max("rank").alias("top"), F.max("rest").alias("rest"))
    w = Window.partitionBy("source").orderBy("slice")
    summed = slices.withColumn("upto", F.sum("words").over(w)).withColumn("fits", F.col("upto") <= F.col("rest"))
    edge = summed.groupBy("source").agg(
        F.max(F.when(F.col("fits"), F.col("top"))).alias("top"),
        F.coalesce(F.max(F.when(F.col("fits"), F.col("upto"))), F.lit(0)).alias("before"),
        F.min(F.when(~F.col("fits"), F.col("slice"))).alias("e_slice"),
    ).withColumnRenamed("source", "h_source")
    inside = sliced.join(edge, sliced["source"].eqNullSafe(F.col("h_source")) & (sliced["slice"] == F.col("e_slice")))
    ties = inside.groupBy("source", "rank").agg(F.sum("size").alias("words"), F.max("rest").alias("rest"), F.max("before").alias("before"))
    order = Window.partitionBy("source").orderBy("rank")
    drawn = ties.withColumn("upto", F.col("before") + F.sum("words").over(order)).withColumn("fits", F.col("upto") <= F.col("rest"))
    last = drawn.groupBy(F.col("source").alias("d_source")).agg(
        F.max(F.when(F.col("fits"), F.col("rank"))).alias("d_last"),
        F.max(F.when(F.col("fits"), F.col("upto"))).alias("d_words"),
        F.min(F.when(~F.col("fits"), F.col("rank"))).alias("h_stop"),
    )
    return edge.join(last, F.col("h_source").eqNullSafe(F.col("d_source")), "left").select(
        "h_source", F.coalesce("d_last", "top").alias("h_last"), F.coalesce("d_words", "before").alias("h_words"), "h_stop"
    )


def thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """``targets`` with ``starts``, ``lasts`` and ``rooms``: in each round, documents behind that start, up to that rank and size are drawn.

    ``sized`` has source, size, unit and appeal. The first round draws the head of the order. The document after it is too long for
    what is left, so the next rounds go on behind it with the documents that fit; so they do behind a group of repeated rows
    that is too long as a whole.
    """
    state = targets.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("lasts", F.array(F.lit(0.0))).withColumn("starts", F.array(F.lit(0.0)))
    state = state.withColumn("rooms", F.array().cast("array<double>"))
    for _ in range(ROUNDS):
        state = through_storage(state, "round")
        # Only a part above 0 is sampled.
        open_ = state.filter("part > 0").select(F.col("source").alias("t_source"), "part", "rest", F.element_at("starts", -1).alias("last"))
        ranked = (
            sized.join(open_, sized["source"].eqNullSafe(F.col("t_source")))
            .select("source", "size", "rest", "last", pareto_rank(F.col("unit"), F.col("part"), F.col("appeal")).alias("rank"))
            .filter("rank > last and size <= rest")
        )
        state = state.join(_head(ranked), F.col("source").eqNullSafe(F.col("h_source")), "left").select(
            "source",
            "source_size",
            "target",
            "whole",
            "part",
            (F.col("rest") - F.coalesce("h_words", F.lit(0))).alias("rest"),
            F.concat("lasts", F.array(F.coalesce("h_last", F.element_at("lasts", -1)))).alias("lasts"),
            F.concat("starts", F.array(F.coalesce("h_stop", "h_last", F.element_at("starts", -1)))).alias("starts"),
            F.concat("rooms", F.array("rest")).alias("rooms"),
        )
    return state


def plan(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_copies: int = MAX_COPIES, seed: int = 42, appeal: Appeal = None):
    """Narrow rows (``doc_id, source, size, unit, appeal``) and one row per source with its target and threshold."""
    tune(docs.sparkSession)
    rows = with_columns(docs, ["doc_id", "source", "text", *([appeal] if isinstance(appeal, str) else [])], {})
    sized = through_storage(
        rows.select(
            "doc_id",
            "source",
            word_count(F.col("text")).alias("size"),
            random_unit(F.col("doc_id"), F.col("text"), seed).alias("unit"),
            *([F.col(f"`{appeal}`")] if isinstance(appeal, str) else []),
        ).select("doc_id", "source", "size", "unit", _appeal(appeal, lambda c: F.col(f"`{c}`"), F.col("size")).alias("appeal")),
        "mix",
    )
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = through_storage(source_targets(sizes, weights, share, max_copies), "targets")
    return sized, through_storage(thresholds(sized, targets), "thresholds")


def copies(unit: Column, appeal: Column, size: Column) -> Column:
    """Copies of a document joined with the row of its source."""
    rank = pareto_rank(unit, F.col("part"), appeal)
    drawn = F.lit(False)
    for k in range(ROUNDS):
        drawn = drawn | ((rank > F.col("starts")[k]) & (rank <= F.col("lasts")[k + 1]) & (size <= F.col("rooms")[k]))
    return F.col("whole") + F.when(F.coalesce(drawn, F.lit(False)), 1).otherwise(0)


def decisions(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` per document."""
    sized, by_source = plan(docs, **options)
    named = by_source.withColumnRenamed("source", "p_source")
    joined = sized.join(named, F.col("source").eqNullSafe(F.col("p_source")))
    drawn = joined.withColumn("copies", copies(F.col("unit"), F.col("appeal"), F.col("size")))
    return drawn.select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def mix(docs: DataFrame, seed: int = 42, appeal: Appeal = None, **options) -> DataFrame:
    """The mixed corpus: every row as often as it was drawn, with the columns it came with."""
    _, by_source = plan(docs, seed=seed, appeal=appeal, **options)
    named = by_source.withColumnRenamed("source", "p_source")
    whole = fresh(docs, "row")
    rows = docs.select(F.struct("*").alias(whole))
    have = set(docs.columns)
    field = lambda c: F.col(whole)[c] if c in have else F.lit(None).cast("string")
    placed = rows.select(
        whole,
        field("source").alias("m_source"),
        random_unit(field("doc_id"), field("text"), seed).alias("m_unit"),
        word_count(field("text")).alias("m_size"),
    ).withColumn("m_appeal", _appeal(appeal, field, F.col("m_size")))
    joined = placed.join(named, F.col("m_source").eqNullSafe(F.col("p_source")))
    drawn = joined.select(whole, F.explode(F.array_repeat(F.lit(1), copies(F.col("m_unit"), F.col("m_appeal"), F.col("m_size")))).alias("m_copy"))
    return drawn.select(f"{whole}.*")


# The mix of ``decisions(documents, appeal=by_length)``.
ORACLE_SQL = r"""
with d as (
    select doc_id, source,
           case when text is null then 0 else len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) end as size,
           (cast(('0x' || substr(md5('42|' || coalesce(cast(doc_id as varchar), '') || '|' || coalesce(text, '')), 1, 13)) as bigint)
            + 0.5::double) / 4503599627370496.0::double as u
    from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
w as (select *, [3, 1, 2][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight from s),
f as (select *,
        (sum(source_size) over () * 1.5::double
         - coalesce(sum(source_size) over (order by source_size::double / weight, source nulls last
                    rows between unbounded preceding and 1 preceding), 0) * 2)
        / (sum(weight) over ()
           - coalesce(sum(weight) over (order by source_size::double / weight, source nulls last
                      rows between unbounded preceding and 1 preceding), 0)) as level
      from w),
g as (select *, source_size * 2 <= weight * level as full_ from f),
t as (select source, source_size,
        case when full_ then (source_size * 2)::double
             else weight * (max(case when not full_ then level end) over ()) end as target
      from g),
r as (select *, case when source_size > 0 then target / source_size else 0 end as copies from t),
p as (select *, floor(copies) as whole, copies - floor(copies) as part, target - floor(copies) * source_size as rest from r),
q as (select d.doc_id, d.size, p.source_size, p.target, p.whole, p.part, p.rest, p.source,
             case when p.part > 0 then (u / (1 - u)) / (p.part / (1 - p.part) * case when size between 50 and 5000 then 2.0::double else 1.0::double end) end as rnk
      from d join p on d.source is not distinct from p.source),
z as (select source, rest as room1, 0.0::double as start1, 0.0::double as last0 from p),
k1 as (select q.source, rnk, max(room1) as rest, sum(size) as words
       from q join z on q.source is not distinct from z.source
       where part > 0 and rnk > start1 and size <= room1 group by q.source, rnk),
c1 as (select *, sum(words) over (partition by source order by rnk) as upto from k1),
l1 as (select z.*, coalesce(max(case when upto <= c1.rest then rnk end), last0) as last1,
              room1 - coalesce(max(case when upto <= c1.rest then upto end), 0) as room2,
              coalesce(min(case when upto > c1.rest then rnk end), max(case when upto <= c1.rest then rnk end), start1) as start2
       from z left join c1 on c1.source is not distinct from z.source group by z.source, room1, start1, last0),
k2 as (select q.source, rnk, max(room2) as rest, sum(size) as words
       from q join l1 on q.source is not distinct from l1.source
       where part > 0 and rnk > start2 and size <= room2 group by q.source, rnk),
c2 as (select *, sum(words) over (partition by source order by rnk) as upto from k2),
l2 as (select l1.*, coalesce(max(case when upto <= c2.rest then rnk end), last1) as last2,
              room2 - coalesce(max(case when upto <= c2.rest then upto end), 0) as room3,
              coalesce(min(case when upto > c2.rest then rnk end), max(case when upto <= c2.rest then rnk end), start2) as start3
       from l1 left join c2 on c2.source is not distinct from l1.source group by l1.source, room1, start1, last0, last1, room2, start2),
k3 as (select q.source, rnk, max(room3) as rest, sum(size) as words
       from q join l2 on q.source is not distinct from l2.source
       where part > 0 and rnk > start3 and size <= room3 group by q.source, rnk),
c3 as (select *, sum(words) over (partition by source order by rnk) as upto from k3),
l3 as (select l2.source, room1, start1, last1, room2, start2, last2, room3, start3,
              coalesce(max(case when upto <= c3.rest then rnk end), last2) as last3
       from l2 left join c3 on c3.source is not distinct from l2.source
       group by l2.source, room1, start1, last1, room2, start2, last2, room3, start3)
select q.doc_id, q.size::bigint as size, q.source_size, q.target,
       (q.size * (q.whole + case when q.part > 0 and (rnk > start1 and rnk <= last1 and size <= room1
                                                      or rnk > start2 and rnk <= last2 and size <= room2
                                                      or rnk > start3 and rnk <= last3 and size <= room3)
                                 then 1 else 0 end))::bigint as taken
from q join l3 on q.source is not distinct from l3.source
"""
