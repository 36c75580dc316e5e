"""Registered queries of the operators, and the SQL that checks those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from pharmalith.llm import (
    burst_trie,
    decontaminate,
    language,
    mixing,
    pieces,
    pii,
    quality_rules,
    runs,
    sharding,
    simhash_vp,
    site_quality,
    token_rollups,
    warc_zstd,
)
from pharmalith.llm.common import WORD_PATTERN
from pharmalith.session import scratch_path, through_storage

# Vocabulary files of public tokenizers; the folder may be set by the environment.
TOKENIZER_DIR = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
PIECE_MODEL = f"{TOKENIZER_DIR}/piece_bpe_32k.model"
TOKENIZERS = {n: f"{TOKENIZER_DIR}/{n}.tiktoken" for n in ("byte_bpe_50k", "byte_bpe_multi_50k")}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query
def op1_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posterior quality of every document; the source is the host, the language section its path."""
    scored = site_quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", *[F.round(c, 6).alias(c) for c in ("evidence", "host_mean", "path_mean", "posterior")], "kept")


@query
def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from four fifths of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", language.held_out(F.col("doc_id")).alias("held_out"))
    model = language.learn(docs.filter("not held_out"))
    return language.identify(docs, model, ["doc_id", "held_out"]).withColumn("n_spans", F.size("spans")).drop("spans")


@query
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as archives and read back."""
    path = scratch_path(spark, "warc")
    warc_zstd.write_archives(table(spark, sf_dir, "pages"), path)
    read = warc_zstd.read_archives(spark, path)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op3_warc"] = warc_zstd.ORACLE_SQL


@query
def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, target of the source and words taken per document; documents of middle length have twice the odds."""
    drawn = mixing.decisions(table(spark, sf_dir, "documents"), appeal=mixing.by_length)
    return drawn.select("doc_id", "size", "source_size", "target", "taken")


ORACLES["op4_mix"] = mixing.ORACLE_SQL


@query
def op5_token_totals(spark: SparkSession, sf_dir: str, tokenizers: dict[str, str] | None = None) -> DataFrame:
    """Totals by source, language and tokenizer version after all documents came in, copies went and lines were
    revised; the second batch is sent twice."""
    store = token_rollups.Rollup(spark, scratch_path(spark, "rollup"))
    changes = token_rollups.crawl_changes(table(spark, sf_dir, "documents"), tokenizers or TOKENIZERS, through_storage)
    for name in ("crawl", "copies", "copies", "lines"):
        store.commit(name, changes[name])
    store.compact()
    store.commit("copies", changes["copies"])
    return store.totals()


@query
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item and the checks."""
    found = decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "common", "n_words", "answer", "verbatim", F.round("cosine", 3).alias("cosine"))


@query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of the robust outlier rule per document."""
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance"
    )


@query
def op8_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document under the law of even row counts."""
    dealt = sharding.shuffle_into_shards(table(spark, sf_dir, "documents"), shards=8)
    text = F.col("text")
    return dealt.select(
        "doc_id",
        sharding.row_size(text).alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op9_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash_vp.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, max_bits=4)
    return found.select("doc_id", simhash_vp.hex_fingerprint("fp").alias("fingerprint"), "component_id")


@query
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: counts and digest of the base spans, and all spans."""
    found = pii.detect(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *[pii.count_kind(F.col("base"), k).alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(pii.spell(F.col("base")), 256).alias("base_sha256"),
        pii.spell(F.col("spans")).alias("spans"),
    )


def periodic(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` of all documents as words; in one tenth of them, by the id's checksum, the words from some place on repeat."""
    words = F.when(F.col("text").isNotNull(), F.regexp_extract_all("text", F.lit(f"({WORD_PATTERN})"), 1)).otherwise(F.array())
    h = F.crc32(F.col("doc_id").cast("string"))
    rows = docs.select("doc_id", words.alias("words"), h.alias("h"), F.floor(h / 10).alias("g"), F.size(words).alias("n"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", F.lit(1) + F.floor((F.col("n") - F.col("a")) / (F.lit(3) + F.col("g") % 8)))
    rebuilt = F.expr("transform(words, (w, i) -> if(i < a, w, words[int(a + (i - a) % p)]))")
    return rows.select("doc_id", F.array_join(F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), rebuilt).otherwise(F.col("words")), " ").alias("text"))


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document: their number, the longest, digests of all and of the text without repeats."""
    found = runs.detect(periodic(table(spark, sf_dir, "documents")), ["doc_id"])
    best = runs.longest(F.col("runs"))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best.start.alias("start"),
        best.length.alias("length"),
        best.period.alias("period"),
        F.floor(1000 * best.length / best.period).alias("exponent_milli"),
        F.sha2(runs.spelled(F.col("runs")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def with_shared_starts(held: DataFrame) -> DataFrame:
    """Conversations rebuilt: the first turns, up to three by the id's checksum, are those of the conversation whose id is the next lower multiple of 20."""
    shared = F.crc32(F.col("conv_id").cast("string")) % 4
    first = held.filter(F.col("conv_id") % 20 == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, 3).alias("start"))
    rows = held.withColumn("base", F.col("conv_id") - F.col("conv_id") % 20).join(first, "base", "left").withColumn("h", shared.cast("int"))
    start = F.coalesce(F.expr("slice(start, 1, h)"), F.expr("slice(turns, 1, 0)"))
    own = F.expr("slice(turns, h + 1, size(turns))")
    return rows.select("conv_id", F.concat(start, own).alias("turns"))


@query
def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all rebuilt conversations."""
    held = through_storage(burst_trie.sequences(table(spark, sf_dir, "conversations")), "sequences")
    return burst_trie.nodes(with_shared_starts(held))


ORACLES["op12_conversation_trie"] = burst_trie.ORACLE_SQL


@query
def op13_pieces(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    """Every document as ids of a SentencePiece model, and read back from them."""
    coded = pieces.encode(table(spark, sf_dir, "documents"), model or PIECE_MODEL, ["doc_id"])
    coded = coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), "ids")
    read = pieces.decode(coded, model or PIECE_MODEL, ["doc_id", "n_tokens", "ids_sha256"])
    return read.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the pipeline over the documents."""
    return corpus_pipeline.run(spark, sf_dir)
