import collections

import pytest

from pharmalith.llm import token_rollups as t
from pharmalith.session import through_storage
from tests.llm.conftest import edge_rows

FILES = {"a": "/opt/tokenizers/byte_bpe_50k.tiktoken", "b": "/opt/tokenizers/piece_bpe_32k.model"}


def plain_totals(rows, files):
    """What is left after copies went and lines were dropped, counted from the start."""
    first = {}
    for r in rows:
        key = (r.doc_id is None, r.doc_id or 0)
        k = (r.text,)
        if k not in first or key < first[k]:
            first[k] = key
    total = collections.defaultdict(lambda: [0, 0])
    for r in rows:
        if first[(r.text,)] != (r.doc_id is None, r.doc_id or 0):
            continue
        text = r.text and "\n".join(dict.fromkeys(r.text.split("\n")))
        for version, path in files.items():
            cell = total[r.source, r.lang, version]
            cell[0] += 1
            cell[1] += t.encoder(path)([text or ""])[0]
    return {k: tuple(v) for k, v in total.items()}


def as_dict(rollup):
    return {(r.source, r.lang, r.version): (r.documents, r.tokens) for r in rollup.totals().collect()}


def test_batches_lead_to_the_recount(spark, documents, tmp_path):
    rollup = t.Rollup(spark, str(tmp_path / "r"))
    changes = t.crawl_changes(documents, FILES, through_storage)
    assert as_dict(rollup) == {}
    assert all(rollup.commit(n, c) for n, c in changes.items())
    expected = plain_totals(documents.collect(), FILES)
    assert as_dict(rollup) == expected
    assert not rollup.commit("copies", changes["copies"]) and as_dict(rollup) == expected
    rollup.compact()
    assert as_dict(rollup) == expected
    assert not rollup.commit("crawl", changes["crawl"]) and as_dict(rollup) == expected
    assert rollup.commit("again", changes["crawl"]) and as_dict(rollup) != expected


def test_broken_batch_is_not_seen(spark, tmp_path):
    rollup = t.Rollup(spark, str(tmp_path / "r"))
    rows = spark.createDataFrame([("s", None, "v", 1, 10), ("s", None, "v", -1, -10), (None, "l", "v", 1, 5)], t.SCHEMA)
    assert rollup.commit("one", rows)
    (tmp_path / "r" / "batches" / "one" / "_SUCCESS").unlink()
    assert as_dict(rollup) == {}
    assert rollup.commit("one", rows) and as_dict(rollup) == {(None, "l", "v"): (1, 5)}
    assert rollup.commit("none", rows.filter("tokens = 99")) and len(as_dict(rollup)) == 1
    with pytest.raises(ValueError):
        rollup.commit("../x", rows)


def test_kinds_of_files():
    texts = ["", "plain words", "wörter 😀 <|endoftext|>"]
    for path in [*FILES.values(), "/opt/tokenizers/byte_bpe_50k.json"]:
        n = t.encoder(path)(texts)
        assert n[0] == 0 and n[1] >= 2 and n[2] > n[1]
    assert t.encoder("/opt/tokenizers/byte_bpe_50k.json")(texts) == t.encoder(FILES["a"])(texts)


def test_edge_cases(spark, edge, nothing, tmp_path):
    rollup = t.Rollup(spark, str(tmp_path / "r"))
    for name, batch in t.crawl_changes(edge, {"a": FILES["a"]}, through_storage).items():
        assert rollup.commit(name, batch)
    expected = plain_totals(edge.collect(), {"a": FILES["a"]})
    assert as_dict(rollup) == expected and len(edge_rows()) > len(expected)
    empty = t.Rollup(spark, str(tmp_path / "e"))
    for name, batch in t.crawl_changes(nothing, {"a": FILES["a"]}, through_storage).items():
        empty.commit(name, batch)
    assert as_dict(empty) == {}
    empty.compact()
    assert as_dict(empty) == {}
