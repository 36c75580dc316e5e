"""Registered queries of this folder: columns, and equality with their SQL."""

import duckdb
import pytest

from pharmalith.llm import queries as q

COLUMNS = {
    "op2_language": "doc_id held_out lang_pred score",
    "op3_warc": "page_id payload_bytes payload_digest record_type refers_to",
    "op4_mix": "doc_id size source_size target taken",
    "op7_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op8_shard": "doc_id size text_crc32 law shard slot grown_shard",
    "op9_simhash_groups": "doc_id fingerprint component_id",
    "op10_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op11_periodic_runs": "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256",
    "op12_conversation_trie": "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256",
    "op13_pieces": "doc_id n_tokens ids_sha256 decoded_sha256",
}


def test_all_are_registered():
    assert sorted(n.split("_")[0] for n in q.QUERIES) == sorted([*[f"op{n}" for n in range(1, 14)], "pipeline"])


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, sf, name):
    assert set(COLUMNS[name].split()) <= set(q.QUERIES[name](spark, sf).columns)


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    result = con.execute(q.ORACLES[name])
    columns = [c[0] for c in result.description]
    got = [tuple(r) for r in q.QUERIES[name](spark, sf).select(*columns).collect()]
    assert sorted(got, key=str) == sorted(result.fetchall(), key=str)
