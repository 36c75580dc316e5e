"""WARC archives of records that share a Zstandard dictionary.

Every archive holds a leading skippable frame with a dictionary, trained on the archive's own first ``SAMPLE_BYTES`` of records,
and then each record as a frame of its own, so records can be read singly. Frames are parted by an empty
skippable frame, which readers pass over; it serves as the line separator of Spark's text writer, so archives are
written by Spark's own commit protocol to any file system and survive lost executors. One task is one
archive. Payloads that were met before become revisit records that refer to the response.

Defined results: a null payload is empty; records shorter than ``min_bytes`` are always responses; of equal payloads the one with the largest id
is the response (rows that share this id are all responses, a null id is below any other); a null address leaves out its
header, line breaks in it are escaped; an archive with too few records for training has no dictionary frame; an empty table writes no
record. Other columns are not read. A payload has to fit in memory, as any value of a row does.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pharmalith.llm.common import with_columns
from pharmalith.session import tune

SAMPLE_BYTES = 4 << 20
DICTIONARY_BYTES = 64 << 10
LEVEL = 6
MIN_BYTES = 1000
# Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
EMPTY_FRAME = "P*M\x18\x00\x00\x00\x00"  # a skippable frame without content, in plain ASCII
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_FORMAT = "<urn:x-page:%s>"

FIELDS = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"


def build_record(page_id, url, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One record of the WARC 1.1 format; a revisit carries no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {ID_FORMAT % ('null' if page_id is None else page_id)}",
        f"WARC-Date: {date}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {ID_FORMAT % refers_to}"]
    head += [
        "WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _id(text: str | None):
    number = text[len("<urn:x-page:") : -1] if text else "null"
    return None if number == "null" else int(number)


def parse_record(raw: bytes) -> tuple:
    """Values of ``FIELDS``; raises if a response does not match its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rsplit(b"Content-Length: ", 1)[1])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    url = fields.get("WARC-Target-URI")
    return _id(fields["WARC-Record-ID"]), url, kind, digest, size, _id(fields.get("WARC-Refers-To")), payload if kind == "response" else None


def train(records: list[bytes]) -> bytes | None:
    """A dictionary from records, or None if they are too few."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, records).as_bytes()
    except zstandard.ZstdError:
        return None


def archive_frames(records: Iterator[bytes]) -> Iterator[bytes]:
    """The frames of an archive: dictionary, then records. Holds at most the sample in memory."""
    sample: list[bytes] = []
    size = 0
    for r in records:
        sample.append(r)
        size += len(r)
        if size >= SAMPLE_BYTES:
            break
    if not sample:
        return
    trained = train(sample)
    if trained:
        yield struct.pack("<II", DICTIONARY_MAGIC, len(trained)) + trained
    writer = zstandard.ZstdCompressor(
        level=LEVEL, dict_data=zstandard.ZstdCompressionDict(trained) if trained else None, write_checksum=True, write_content_size=True
    )
    for r in sample:
        yield writer.compress(r)
    sample.clear()
    for r in records:
        yield writer.compress(r)


def archive_records(data: bytes) -> Iterator[bytes]:
    """The records of an archive."""
    view, at, reader = memoryview(data), 0, zstandard.ZstdDecompressor()
    while at < len(view):
        magic, size = struct.unpack_from("<II", view, at)
        if magic == DICTIONARY_MAGIC:
            reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(view[at + 8 : at + 8 + size])))
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            at += 8 + size
            continue
        if magic != FRAME_MAGIC:
            raise ValueError(f"no frame at byte {at}")
        part, out = reader.decompressobj(), []
        while not part.eof:
            piece = view[at : at + 8192]
            if not len(piece):
                raise ValueError("archive ends inside a frame")
            out.append(part.decompress(piece))
            at += len(piece)
        at -= len(part.unused_data)
        yield b"".join(out)


def with_revisits(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """``page_id, url, html, digest, refers_to``: the revisits found by digests alone, without moving payloads by digest.

    Digests that occur once are dropped before the join; a digest with very many pages is joined on narrow rows only.
    """
    rows = with_columns(pages, ["page_id", "url", "html"], {"page_id": "long"}).select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("html")
    )
    keyed = rows.withColumn("digest", F.sha1("html"))
    narrow = keyed.filter(F.octet_length("html") >= min_bytes).select("page_id", "digest")
    last = narrow.groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).filter("n > 1 and last is not null")
    revisits = (
        narrow.join(last.select(F.col("digest").alias("l_digest"), "last"), F.col("digest") == F.col("l_digest"))
        .filter(~F.col("page_id").eqNullSafe(F.col("last")))
        .select(F.col("page_id").alias("r_id"), F.col("digest").alias("r_digest"), F.col("last").alias("refers_to"))
        .distinct()
    )
    return keyed.join(revisits, keyed["page_id"].eqNullSafe(F.col("r_id")) & (keyed["digest"] == F.col("r_digest")), "left").select(
        "page_id", "url", "html", "digest", "refers_to"
    )


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write all pages as archives below ``path``, named ``*.warc.zst``."""
    spark = tune(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records = (
            build_record(r["page_id"], r["url"], r["html"], r["digest"], r["refers_to"], date)
            for batch in batches
            for part in range(0, batch.num_rows, 64)
            for r in batch.slice(part, 64).to_pylist()
        )
        held, size = [], 0
        for frame in archive_frames(records):
            held.append(frame)
            size += len(frame)
            if size >= 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["frame"])
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["frame"])

    frames = with_revisits(pages, min_bytes).mapInArrow(run, "frame binary")
    # Bytes pass through the text writer unchanged.
    frames.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", EMPTY_FRAME).text(path)
    _rename(spark, path)


def _rename(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.listStatus(folder):
        at = status.getPath()
        if at.getName().endswith(".txt"):
            fs.rename(at, jvm.org.apache.hadoop.fs.Path(folder, at.getName().removesuffix(".txt") + ".warc.zst"))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives below ``path``: the columns ``FIELDS``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in FIELDS.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for raw in archive_records(content.as_buffer().to_pybytes()):
                    rows.append(parse_record(raw))
                    size += len(raw)
                    if size >= 4 << 20:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path).select("content")
    return files.mapInArrow(run, FIELDS)


ORACLE_SQL = """
with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
d as (select page_id, octet_length(payload) as size, sha1(payload) as digest from p),
l as (select digest, max(page_id) as last from d where size >= 1000 group by digest)
select d.page_id, d.size::bigint as payload_bytes, d.digest as payload_digest,
       case when l.last is distinct from d.page_id and l.last is not null then 'revisit' else 'response' end as record_type,
       case when l.last is distinct from d.page_id then l.last end as refers_to
from d left join l on d.digest = l.digest and d.size >= 1000
"""
