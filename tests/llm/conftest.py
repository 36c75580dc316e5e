"""Fixtures of the edge cases that every operator has to bear."""

import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, row string, key string, shard string, slot string, "
    "k_id long, k_hash long, pool string, fp long, root long, `_row_hash` string, rank double, unit double, `a.b` string"
)
WORDS = "the red fox runs over a green hill and sees one bird in the old tree by that lake"
LONG = " ".join(f"{WORDS} {k}" for k in range(6000))


def edge_rows():
    extra = ("row", "key", "shard", "slot", 1, 2, "pool", 3, 4, "hash", 0.5, 0.5, "dot")
    rows = [
        (1, None, "en", "a", None),
        (2, "", "en", "a", 0),
        (3, " \t\n\x0b", None, "a", 4),
        (None, WORDS, "en", None, 80),
        (None, WORDS, "en", None, 80),
        (5, WORDS, None, "b", 80),
        (5, WORDS, None, "b", 80),
        (6, LONG, "en", "b", len(LONG)),
        (7, WORDS.upper(), "en", "", 80),
        (7, "another text of the same id", "en", "", 27),
        (8, "日本語のテキスト и немного слов 12 Ünïcödé 😀", "ja", "a", 40),
        (9, None, None, None, None),
    ]
    return [r + extra for r in rows]


@pytest.fixture(scope="session")
def edge(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("edge") / "documents.parquet")
    spark.createDataFrame(edge_rows(), SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
