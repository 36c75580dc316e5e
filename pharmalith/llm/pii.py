"""Personal data by weak supervision, with DataFrame functions only.

Fixed patterns give the base spans (kinds ``KINDS``). Wider patterns give candidates; five labelers vote on each (-1, 0, 1):
the fixed pattern, a checksum or range, a gazetteer, words of the context, and the form of the writing.
Expectation-maximisation estimates, per kind, how reliable each labeler is: candidates are counted by their pattern of votes
once, and the rounds run over those few counts. The posteriors then train the final span classifier (naive Bayes over the
span's own form, neighbours and context), by one grouped sum. Candidates that it accepts and that touch no base
span are added; base spans always stay.

Texts are read once and whole, in time n log n of their matches; what is stored is one narrow row per document with its spans. The tables that reach the
driver are bounded: at most 4 * 3^5 patterns of votes and 4 * 6 * 64 feature counts.

Defined results: a null text is empty; documents without spans come back with empty lists; repeated rows are judged alike;
an empty table gives no rows and an untrained classifier that adds nothing. Positions are code points, the end is excluded.
Columns other than the id and the text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pharmalith.llm.common import with_columns
from pharmalith.session import through_storage, tune

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("pattern", "check", "gazetteer", "context", "form")
FEATURES = ("digits", "length", "shape", "before", "after", "words")
BUCKETS = 64
CONTEXT = 40
# Code points of a piece of a text.
PIECE = 256
ROUNDS = 25
ACCEPT = 0.5

# Fixed patterns. Loops are possessive, and a match starts where its run of characters starts (or right after the match
# before), which gives the matches of the plain patterns in time linear in the text and without recursion.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Wider patterns for candidates.
WIDE = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+(?:@| ?[\(\[]at[\)\]] ?)[a-z0-9-]{1,63}+(?:(?:\.| ?[\(\[]dot[\)\]] ?)[a-z0-9-]{1,63}+)++",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])",
    "phone": r"(?<![0-9+(.-])(?:\+|\()?[0-9][0-9 ().-]{5,18}[0-9](?![0-9])",
}
# Top-level domains, calling codes, card issuers, words of context.
DOMAINS = "com org net edu gov int mil info biz io co de fr es it uk nl be at ch pl pt se no fi dk ie eu us ca au nz in jp cn br mx ru".split()
CALLING = r"^\+(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|30[0-5]|3[689]|6011|65|35)"
SPEAKS_FOR = {
    "email": "mail|contact|write|reach|kontakt|correo|courriel|escrib",
    "ip": r"\bip\b|address|server|host|login|connect|client|adresse",
    "card": "card|visa|master|amex|credit|payment|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|cell|fax|whatsapp|anruf|appel|llam",
}
SPEAKS_AGAINST = r"version|release|isbn|issn|doi|order|invoice|serial|part no|section|chapter|page|figure|price|total|\$|€|£|token|key|hash"


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the digits of a number pass the check sum."""
    back = F.reverse(number)
    doubled = F.transform(
        F.sequence(F.lit(1), F.length(number)),
        lambda i: F.when(i % 2 == 1, F.substring(back, i, F.lit(1)).cast("int")).otherwise(
            (F.substring(back, i, F.lit(1)).cast("int") * 2) % 10 + F.floor(F.substring(back, i, F.lit(1)).cast("int") / 5).cast("int")
        ),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once."""
    return F.transform(F.array(value), use)[0]


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Each element combined with all before it. Round k takes in the element 2^k places before, so an array of n elements takes
    log2(n) rounds of whole-array steps; adding to an array element by element would copy it each time."""

    def round_of(x: Column, reach: Column) -> Column:
        earlier = F.concat(F.array_repeat(F.lit(None).cast("int"), reach), F.slice(x, F.lit(1), F.size(x) - reach))
        return F.zip_with(x, earlier, lambda a, b: F.when(b.isNull(), a).otherwise(combine(a, b)))

    def rounds(x: Column) -> Column:
        reaches = F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.size(x))).cast("int") - 1), lambda k: F.pow(F.lit(2), k).cast("int"))
        return F.when(F.size(x) > 1, F.aggregate(reaches, x, round_of)).otherwise(x)

    return bind(values, rounds)


def located(text: Column, pattern: str) -> Column:
    """Matches with places: array of (s, e, t). The text between matches gives the places, in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))

    def places(x: Column) -> Column:
        advance = F.zip_with(F.slice(x["gap"], F.lit(1), F.size(x["t"])), x["t"], lambda gap, t: gap + F.length(t))
        ends = running(advance, lambda a, b: a + b)
        return F.zip_with(ends, x["t"], lambda e, t: F.struct((e - F.length(t)).alias("s"), e.alias("e"), t.alias("t")))

    some = bind(F.struct(between.alias("gap"), found.alias("t")), places)
    return F.when(text.rlike(pattern), some).otherwise(F.array().cast("array<struct<s:int,e:int,t:string>>"))


def cut_text(text: Column) -> Column:
    """A text in pieces of ``PIECE`` code points, so that a place is found without counting from the start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def part_of(pieces: Column, start: Column, count: Column) -> Column:
    """At most ``PIECE`` code points from a place."""
    first = F.floor(start / PIECE).cast("int")
    near = F.concat(F.coalesce(F.get(pieces, first), F.lit("")), F.coalesce(F.get(pieces, first + 1), F.lit("")))
    return F.substring(near, start % PIECE + 1, count)


def _answers(events: Column, value: Callable[[Column], Column]) -> Column:
    """Values of the events that belong to a candidate, in the order of candidates."""
    return F.transform(F.sort_array(F.filter(F.transform(events, lambda x: F.struct(x["at"].alias("at"), value(x).alias("v"))), lambda x: x["at"] >= 0)), lambda x: x["v"])


def among_base(candidates: Column, base: Column) -> Column:
    """Per candidate, whether it is a base span of its kind; by one sort of both."""

    def event(x: Column, kind: int, at: Column) -> Column:
        return F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"), F.lit(kind).alias("type"), at.alias("at"))

    events = F.concat(F.transform(base, lambda x: event(x, 0, F.lit(-1))), F.transform(candidates, lambda x, i: event(x, 1, i)))

    def marked(x: Column) -> Column:
        before = F.concat(F.array(F.lit(None).cast("struct<kind:int,s:int,e:int,type:int,at:int>")), F.slice(x, F.lit(1), F.size(x) - 1))
        same = lambda a, b: (a["kind"] == b["kind"]) & (a["s"] == b["s"]) & (a["e"] == b["e"]) & (b["type"] == 0)
        pairs = F.zip_with(x, before, lambda a, b: F.struct(a["at"].alias("at"), F.coalesce(same(a, b), F.lit(False)).alias("is")))
        return _answers(pairs, lambda e: e["is"])

    none = F.transform(candidates, lambda x: F.lit(False))
    return F.when((F.size(base) > 0) & (F.size(candidates) > 0), bind(F.sort_array(events), marked)).otherwise(none)


def touched_by_base(candidates: Column, base: Column) -> Column:
    """Per candidate, whether it overlaps a base span of any kind: the furthest end of the base spans that start before its end is
    beyond its start. One sort of both, then a running maximum."""

    def event(pos: Column, kind: int, end: Column, at: Column, start: Column) -> Column:
        return F.struct(pos.alias("pos"), F.lit(kind).alias("type"), end.alias("end"), at.alias("at"), start.alias("start"))

    nothing = F.lit(-1)
    events = F.concat(
        F.transform(base, lambda x: event(x["s"], 1, x["e"], nothing, nothing)),
        F.transform(candidates, lambda x, i: event(x["e"], 0, nothing, i, x["s"])),
    )

    def marked(x: Column) -> Column:
        furthest = running(F.transform(x, lambda e: e["end"]), lambda a, b: F.greatest(a, b))
        pairs = F.zip_with(x, furthest, lambda e, f: F.struct(e["at"].alias("at"), (f > e["start"]).alias("is")))
        return _answers(pairs, lambda e: e["is"])

    none = F.transform(candidates, lambda x: F.lit(False))
    return F.when((F.size(base) > 0) & (F.size(candidates) > 0), bind(F.sort_array(events), marked)).otherwise(none)


def passes(kind: str, t: Column) -> Column:
    """The rule that a match of a fixed pattern has to pass."""
    n = F.length(digits(t))
    if kind == "ip":
        return F.forall(F.split(t, r"\."), lambda x: x.cast("double") <= 255)
    if kind == "card":
        return F.when(n.between(13, 19), luhn(digits(t))).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def passing(kind: str):
    return lambda x: passes(kind, x["t"])


def _vote(yes: Column, no: Column | None = None) -> Column:
    """1, -1 or 0; without ``no`` it is -1 wherever ``yes`` does not hold."""
    return (F.when(yes, 1).otherwise(-1) if no is None else F.when(yes, 1).when(no, -1).otherwise(0)).cast("int")


def votes(kind: str, t: Column, words: Column, base: Column) -> Column:
    number = digits(t)
    n = F.length(number)
    ip_form = t.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")
    if kind == "email":
        last = F.lower(F.regexp_extract(t, r"([A-Za-z0-9-]+)$", 1))
        check = _vote(last.rlike("^[a-z]{2,24}$"))
        gazetteer = _vote(last.isin(DOMAINS))
        form = _vote(t.contains("@"), F.lit(False))
    elif kind == "ip":
        check = _vote(passes("ip", t))
        gazetteer = _vote(t.rlike(r"^(?:0|00|000)\."), F.lit(False)) * -1
        form = _vote(t.rlike(r"[0-9]{2}"))
    elif kind == "card":
        check = _vote(F.when(n.between(12, 19), luhn(number)).otherwise(F.lit(False)))
        gazetteer = _vote(number.rlike(ISSUERS))
        form = _vote(n.isin(15, 16))
    else:
        check = _vote(n.between(9, 15) & ~ip_form)
        gazetteer = _vote(t.rlike(CALLING) | t.rlike(r"^\(?[2-9][0-9]{2}\)?[ .-][2-9][0-9]{2}[ .-][0-9]{4}$"))
        form = _vote(t.startswith("+") | (F.length(F.regexp_replace(t, "[0-9]", "")) >= 2) & ~ip_form)
    context = _vote(words.rlike(SPEAKS_FOR[kind]), words.rlike(SPEAKS_AGAINST))
    return F.array(_vote(base), check, gazetteer, context, form)


def features(kind: str, t: Column, words: Column, after: Column) -> Column:
    shape = F.regexp_replace(F.regexp_replace(t, "[0-9]{1,4}", "9"), "[A-Za-z]+", "a")
    side = lambda c: F.when(c == "", 0).when(c.rlike(r"\s"), 1).when(c.rlike("[0-9]"), 2).when(c.rlike(r"\p{L}"), 3).otherwise(4)
    return F.array(
        F.least(F.length(digits(t)), F.lit(BUCKETS - 1)),
        F.least(F.length(t), F.lit(BUCKETS - 1)),
        F.pmod(F.xxhash64(shape), F.lit(BUCKETS)).cast("int"),
        side(F.substring(words, -1, 1)),
        side(after),
        F.when(words.rlike(SPEAKS_FOR[kind]), 1).when(words.rlike(SPEAKS_AGAINST), 2).otherwise(0),
    )


def find(docs: DataFrame) -> DataFrame:
    """Narrow rows: ``doc_id``, ``base`` (kind, s, e) and ``candidates`` (kind, s, e, base, votes, features)."""
    rows = with_columns(docs, ["doc_id", "text"], {"doc_id": "long"}).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    text = F.col("text")
    hits = rows.select(
        "*",
        *[F.filter(located(text, BASE[k]), passing(k)).alias(f"b_{k}") for k in KINDS],
        *[located(text, WIDE[k]).alias(f"w_{k}") for k in KINDS],
    )

    def placed(kind: str, with_text: bool):
        def make(x: Column) -> Column:
            text_of = [x["t"].alias("t")] if with_text else []
            return F.struct(F.lit(KINDS.index(kind)).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), *text_of)

        return make

    spans = hits.select(
        "doc_id",
        F.concat(*[F.transform(f"b_{k}", placed(k, False)) for k in KINDS]).alias("base"),
        F.concat(*[F.transform(f"w_{k}", placed(k, True)) for k in KINDS]).alias("wide"),
        F.when(F.size(F.concat(*[F.col(f"w_{k}") for k in KINDS])) > 0, cut_text(text)).alias("pieces"),
    )
    flagged = spans.select("*", among_base(F.col("wide"), F.col("base")).alias("is_base"), touched_by_base(F.col("wide"), F.col("base")).alias("touched"))
    together = F.zip_with(
        "wide",
        F.zip_with("is_base", "touched", lambda a, b: F.struct(a.alias("base"), b.alias("touched"))),
        lambda x, f: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["t"].alias("t"), f["base"].alias("base"), f["touched"].alias("touched")),
    )

    def candidate(kind: str):
        def make(x: Column) -> Column:
            words = F.lower(part_of(F.col("pieces"), F.greatest(x["s"] - CONTEXT, F.lit(0)), F.least(x["s"], F.lit(CONTEXT))))
            return F.struct(
                x["kind"].alias("kind"),
                x["s"].alias("s"),
                x["e"].alias("e"),
                x["base"].alias("base"),
                x["touched"].alias("touched"),
                votes(kind, x["t"], words, x["base"]).alias("votes"),
                features(kind, x["t"], words, part_of(F.col("pieces"), x["e"], F.lit(1))).alias("features"),
            )

        return make

    joined = flagged.select("doc_id", "base", "pieces", together.alias("all"))

    def of_kind(kind: str):
        return lambda x: x["kind"] == KINDS.index(kind)

    per_kind = [F.transform(F.filter("all", of_kind(k)), candidate(k)) for k in KINDS]
    return joined.select("doc_id", "base", F.concat(*per_kind).alias("candidates"))


def reliabilities(patterns: list[tuple[int, tuple[int, ...], int]]) -> dict[int, tuple[float, list[list[list[float]]]]]:
    """Per kind: share of true spans, and chance of each vote of each labeler given a false or a true span.

    ``patterns`` are the counted patterns of votes; every round is one pass over them.
    """
    out = {}
    for kind in {k for k, _, _ in patterns}:
        mine = [(v, n) for k, v, n in patterns if k == kind]
        # Labelers are taken to be right more often than not, which tells the two classes apart.
        table = [[[0.6, 0.25, 0.15], [0.15, 0.25, 0.6]] for _ in LABELERS]
        share = 0.5
        for _ in range(ROUNDS):
            sums = [[[1.2, 0.5, 0.3], [0.3, 0.5, 1.2]] for _ in LABELERS]
            true = total = 0.0
            for v, n in mine:
                odds = math.log(share / (1 - share)) + sum(math.log(table[i][1][x + 1] / table[i][0][x + 1]) for i, x in enumerate(v))
                p = 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))
                true += p * n
                total += n
                for i, x in enumerate(v):
                    sums[i][1][x + 1] += p * n
                    sums[i][0][x + 1] += (1 - p) * n
            share = (true + 1) / (total + 2)
            table = [[[x / sum(row) for x in row] for row in pair] for pair in sums]
        out[kind] = (share, table)
    return out


def _look_up(weights: list[float], index: Column) -> Column:
    return F.array(*[F.lit(float(w)) for w in weights])[index]


def posterior(model: dict, kind: Column, vote: Column) -> Column:
    """Chance that a candidate is true, from its votes."""
    odds = F.lit(0.0)
    prior = [math.log(model[k][0] / (1 - model[k][0])) if k in model else 0.0 for k in range(len(KINDS))]
    odds = odds + _look_up(prior, kind)
    for i in range(len(LABELERS)):
        flat = [math.log(model[k][1][i][1][v] / model[k][1][i][0][v]) if k in model else 0.0 for k in range(len(KINDS)) for v in range(3)]
        odds = odds + _look_up(flat, kind * 3 + vote[i] + 1)
    return 1 / (1 + F.exp(-odds))


def train(found: DataFrame) -> dict[int, tuple[float, list[list[float]]]]:
    """The span classifier: per kind the prior log odds, and log odds of each value of each feature."""
    spans = found.select(F.explode("candidates").alias("c"))
    patterns = spans.groupBy(F.col("c.kind").alias("kind"), F.col("c.votes").alias("votes")).count().collect()
    model = reliabilities(sorted((r["kind"], tuple(r["votes"]), r["count"]) for r in patterns))
    if not model:
        return {}
    weighed = spans.select(
        F.col("c.kind").alias("kind"), F.round(posterior(model, F.col("c.kind"), F.col("c.votes")), 6).alias("p"), F.posexplode("c.features").alias("f", "v")
    )
    counts = weighed.groupBy("kind", "f", "v").agg(F.sum("p").alias("true"), F.sum(1 - F.col("p")).alias("false")).collect()
    out = {}
    for kind in model:
        mine = [r for r in counts if r["kind"] == kind]
        true, false = (sum(r[c] for r in mine if r["f"] == 0) for c in ("true", "false"))
        weights = [[0.0] * BUCKETS for _ in FEATURES]
        for f in range(len(FEATURES)):
            values = [r for r in mine if r["f"] == f]
            for r in values:
                weights[f][r["v"]] = math.log((r["true"] + 0.5) / (true + 0.5 * len(values))) - math.log((r["false"] + 0.5) / (false + 0.5 * len(values)))
        out[kind] = (math.log((true + 1) / (false + 1)), weights)
    return out


def classify(model: dict, candidate: Column) -> Column:
    """Chance that a candidate is true, from its features."""
    kind = candidate["kind"]
    odds = _look_up([model[k][0] if k in model else -50.0 for k in range(len(KINDS))], kind)
    for f in range(len(FEATURES)):
        flat = [model[k][1][f][v] if k in model else 0.0 for k in range(len(KINDS)) for v in range(BUCKETS)]
        odds = odds + _look_up(flat, kind * BUCKETS + candidate["features"][f])
    return 1 / (1 + F.exp(-odds))


def detect(docs: DataFrame) -> DataFrame:
    """``doc_id, base, spans`` per document; both are arrays of (kind, s, e) by kind and start."""
    tune(docs.sparkSession)
    found = through_storage(find(docs), "spans")
    model = train(found)
    if not model:
        return found.select("doc_id", "base", F.col("base").alias("spans"))
    added = F.transform(
        F.filter("candidates", lambda c: ~c["touched"] & (classify(model, c) >= ACCEPT)),
        lambda c: F.struct(c["kind"].alias("kind"), c["s"].alias("s"), c["e"].alias("e")),
    )
    return found.select("doc_id", "base", F.array_sort(F.concat("base", added)).alias("spans"))


def spell(spans: Column) -> Column:
    """kind:start:end of all spans, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["kind"]], x["s"].cast("string"), x["e"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == KINDS.index(kind))).cast("long")


def redact(docs: DataFrame, mark: str = "[%s]") -> DataFrame:
    """``doc_id`` and ``text`` with every span replaced by the name of its kind; documents are paired with their spans by id and text."""
    from pharmalith.llm.common import row_hash

    keyed = docs.select("doc_id", "text", row_hash("text").alias("k"))
    spans = detect(keyed.select(F.struct("doc_id", "k").alias("doc_id"), "text")).select("doc_id.*", "spans").distinct()
    named = spans.select(F.col("doc_id").alias("s_id"), F.col("k").alias("s_k"), "spans")
    joined = keyed.join(named, F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("k") == F.col("s_k")))
    names = F.array(*[F.lit(mark % k) for k in KINDS])
    # Spans of different kinds may overlap; the one that starts first counts.
    ordered = F.array_sort(F.transform("spans", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        piece = F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, x["s"] - acc["at"]), names[x["kind"]])
        return F.when(x["s"] < acc["at"], acc).otherwise(F.struct(x["e"].alias("at"), piece.alias("out")))

    done = F.aggregate(ordered, state, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    return joined.select("doc_id", F.when(F.col("text").isNotNull(), done).alias("text"))
