import glob
import hashlib
import struct

import duckdb
import zstandard
from pyspark.sql import functions as F

from pharmalith.llm import warc_zstd as w


def digest(payload):
    return hashlib.sha1(payload).hexdigest()


def round_trip(spark, pages, path):
    w.write_archives(pages, path)
    return w.read_archives(spark, path)


def test_round_trip(spark, sf, tmp_path):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r for r in round_trip(spark, pages, str(tmp_path / "a")).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    last = {}
    for r in rows:
        last[r.html] = max(last.get(r.html, -1), r.page_id)
    for r in rows:
        payload = (r.html or "").encode()
        g = got[r.page_id]
        again = len(payload) >= 1000 and last[r.html] != r.page_id
        assert (g.url, g.payload_bytes, g.payload_digest) == (r.url, len(payload), digest(payload))
        assert (g.record_type, g.refers_to) == (("revisit", last[r.html]) if again else ("response", None))
        assert g.payload == (None if again else payload)
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf}/pages.parquet'")
    sql = con.execute(w.ORACLE_SQL).fetchall()
    assert sorted(sql, key=str) == sorted(((g.page_id, g.payload_bytes, g.payload_digest, g.record_type, g.refers_to) for g in got.values()), key=str)


def test_format(spark, tmp_path):
    """Read with plain tools: a skippable frame with a dictionary leads, records are frames of their own."""
    pages = spark.range(0, 800, 1, 1).select(
        F.col("id").alias("page_id"), F.lit("http://a.example/").alias("url"),
        F.concat(F.lit("<html>"), F.expr("array_join(transform(sequence(1, 120), x -> hash(x * 7 % 50, id % 9)), ' ')"), F.col("id")).alias("html"),
    )
    w.write_archives(pages, str(tmp_path / "a"))
    (name,) = glob.glob(str(tmp_path / "a" / "*.warc.zst"))
    data = open(name, "rb").read()
    magic, size = struct.unpack_from("<II", data)
    assert magic == w.DICTIONARY_MAGIC
    table = zstandard.ZstdCompressionDict(data[8 : 8 + size])
    assert table.dict_id()
    reader = zstandard.ZstdDecompressor(dict_data=table)
    # A plain reader of concatenated frames passes over the skippable ones.
    whole = reader.stream_reader(data, read_across_frames=True).read()
    assert whole.count(b"WARC/1.1\r\n") == 800
    frames = [f for f in data[8 + size :].split(w.EMPTY_FRAME.encode()) if f]
    assert len(frames) == 800 and all(reader.decompress(f).startswith(b"WARC/1.1\r\nWARC-Type: re") for f in frames)
    alone = sum(len(zstandard.ZstdCompressor(level=w.LEVEL).compress(reader.decompress(f))) for f in frames)
    assert sum(map(len, frames)) < 0.8 * alone


def test_damage_is_found(spark):
    record = w.build_record(1, "u", b"abc", digest(b"abc"), None, "d")
    assert w.parse_record(record)[0] == 1
    try:
        w.parse_record(record.replace(b"abc", b"abd"))
    except ValueError:
        return
    raise AssertionError


def test_edge_cases(spark, tmp_path):
    big, small = "x" * 1000, "y" * 999
    rows = [
        (1, "u\r\nv: w", big), (2, None, big), (2, None, big), (None, "n", big), (3, "s", small), (4, "s", small), (5, "e", None), (6, "e", ""),
        (7, "é", "ü" * 500), (8, "é", "ü" * 500), (9, "l", "long " * 300_000), (10, "z", "a\x00\nP*M\x18\x00\x00\x00\x00 😀"),
    ]
    pages = spark.createDataFrame([r + ("x", 1) for r in rows], "page_id long, url string, html string, digest string, refers_to long")
    got = sorted(
        ((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in round_trip(spark, pages, str(tmp_path / "a")).collect()), key=str
    )
    expected = [
        (1, 1000, "revisit", 2), (2, 1000, "response", None), (2, 1000, "response", None), (None, 1000, "revisit", 2), (3, 999, "response", None),
        (4, 999, "response", None), (5, 0, "response", None), (6, 0, "response", None), (7, 1000, "revisit", 8), (8, 1000, "response", None),
        (9, 1_500_000, "response", None), (10, len("a\x00\nP*M\x18\x00\x00\x00\x00 😀".encode()), "response", None),
    ]
    assert got == sorted(expected, key=str)
    assert round_trip(spark, pages.filter("page_id = 99"), str(tmp_path / "b")).count() == 0
