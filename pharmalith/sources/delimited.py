"""Delimited files as they are delivered: mixed charsets, ragged lines, odd headers.

A file is read as lines, so one large file is split over many tasks. Decoding, the check
of the line width and the parsing are column expressions on the line.
"""

from __future__ import annotations

import csv
import logging
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pharmalith.functions.text import HEADER_DROPPED_PLAIN, KEY_NAME, clean_headers, is_price_column, number, price
from pharmalith.schemas import MISSING_TEXTS
from pharmalith.session import through_storage
from pharmalith.sources import charsets, spanning
from pharmalith.sources.charsets import SINGLE_BYTE, UTF8

log = logging.getLogger(__name__)

# The candidate separators in the order they are tried, and the confidence a charset guess must exceed.
SEPARATORS = (",", ";")
CONFIDENCE = 0.7


@dataclass(frozen=True)
class Layout:
    """How a delivered file is written.

    ``sep`` None: the separator that cuts the header into the most names. ``preamble``:
    lines above the header. ``repair_header``: the header line is split as it stands,
    quotes are dropped, and rows are cut to its width. ``charset`` 'auto': per file, from
    its bytes. ``quoted_newlines``: values may span lines; the lines of a record are put together over the splits of a file.
    """

    sep: str | None = ";"
    preamble: int = 0
    repair_header: bool = False
    charset: str = "auto"
    threshold: float | None = CONFIDENCE
    quoted_newlines: bool = False


@dataclass(frozen=True)
class Landed:
    """Accepted rows, all strings under the delivered names, and the lines left out."""

    rows: DataFrame
    rejects: DataFrame


def read_lines(spark: SparkSession, path, charset: str | None = None) -> DataFrame:
    """Undecoded lines with the file they come from and their order in it (``start``, ``place``).

    ``charset`` names a charset of two bytes a character, whose line breaks are two bytes as well.
    """
    reader = spark.read.option("encoding", charset).option("lineSep", "\n") if charset else spark.read
    return reader.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("place"),
    )


def file_evidence(spark: SparkSession, path) -> DataFrame:
    """Per file: lines, whether all bytes are valid UTF-8, characters beyond ASCII, first line."""
    value = F.col("value")
    beyond = F.when(
        F.octet_length(value) != F.length(value), F.length(F.regexp_replace(value, r"[\x00-\x7F]+", ""))
    ).otherwise(0)
    valid = F.is_valid_utf8(value)
    return read_lines(spark, path).groupBy("file").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum(F.octet_length(value)).alias("n_bytes"),
        F.sum(F.when(F.contains(value, F.lit("\0")), F.octet_length(value) - F.octet_length(F.replace(value, F.lit("\0")))).otherwise(0)).alias("n_zeros"),
        F.bool_and(valid).alias("valid"),
        F.sum(F.when(valid, beyond).otherwise(0)).cast("bigint").alias("n_beyond_ascii"),
        F.min_by("value", F.struct("start", "place")).alias("first_line"),
    )


def _trust(n):
    """Confidence in UTF-8 after ``n`` characters beyond ASCII, for a number or a column."""
    # Each character halves the doubt of 0.99, down to 0.01.
    if isinstance(n, Column):
        return F.when(n == 0, F.lit(1.0)).when(n < 6, 1 - 0.99 * F.pow(F.lit(0.5), n)).otherwise(F.lit(0.99))
    return 1.0 if n == 0 else 1 - 0.99 * 0.5**n if n < 6 else 0.99


def detect_charsets(spark: SparkSession, path, threshold: float | None = CONFIDENCE) -> DataFrame:
    """Charset of each file, from all of its bytes.

    Text that is valid UTF-8 gains confidence with every character beyond ASCII; up to
    ``threshold`` the file is taken as single-byte. None accepts any valid UTF-8. Of the single-byte charsets the one
    whose characters fit best is taken, if the confidence in it exceeds the threshold too, else the first.
    """
    return _with_charsets(spark, path, through_storage(file_evidence(spark, path), "files"), threshold)


def _with_charsets(spark: SparkSession, path, files: DataFrame, threshold: float | None) -> DataFrame:
    """The evidence of files with ``charset`` and ``confidence``; only files that are neither UTF-8 nor two-byte are read again."""
    wide = charsets.two_byte_charset(F.col("first_line"), F.col("n_zeros"), F.col("n_bytes"))
    seen = files.withColumn("wide", wide).withColumn("trust", F.when(F.col("valid"), _trust(F.col("n_beyond_ascii"))))
    enough = F.lit(True) if threshold is None else F.col("trust") > threshold
    other = seen.filter("wide is null and not valid").select("file")
    if other.isEmpty():
        scored = spark.createDataFrame([], "file string, single string, fit double")
    else:
        scores = charsets.pair_scores(spark, read_lines(spark, path).join(other, "file", "left_semi"))
        scored = through_storage(charsets.best_single_byte(scores).toDF("file", "single", "fit"), "charsets")
    guess = F.col("single") if threshold is None else F.when(F.col("fit") > threshold, F.col("single"))
    charset = (
        F.when(F.col("wide").isNotNull(), F.col("wide"))
        .when(F.col("valid") & enough, F.lit(UTF8))
        .otherwise(F.coalesce(guess, F.lit(SINGLE_BYTE)))
    )
    confidence = F.when(F.col("wide").isNotNull(), F.lit(0.99)).otherwise(F.coalesce("trust", "fit", F.lit(0.73)))
    found = seen.join(scored, "file", "left").withColumn("charset", charset).withColumn("confidence", confidence)
    return found.drop("wide", "trust", "single", "fit")


def file_charsets(spark: SparkSession, path, files: DataFrame, layout: Layout) -> DataFrame:
    """``file, charset`` of a table's files.

    The files of one table share their evidence for UTF-8, as some may hold few characters beyond
    ASCII or none; without enough of it in all of them, all are single-byte text.
    """
    if layout.charset != "auto":
        return files.select("file", F.lit(charsets.known(layout.charset)).alias("charset"))
    found = _with_charsets(spark, path, files, layout.threshold)
    two_byte = F.col("charset").isin(*charsets.UTF16)
    n_single, n_beyond = files.join(found.filter(two_byte).select("file"), "file", "left_anti").agg(
        F.count_if(~F.col("valid")), F.coalesce(F.sum("n_beyond_ascii"), F.lit(0))
    ).first()
    trusted = layout.threshold is None or _trust(n_beyond) > layout.threshold
    if n_single == 0:
        plain = F.lit(UTF8 if trusted else SINGLE_BYTE)
    elif n_beyond == 0 or not trusted:
        plain = F.lit(SINGLE_BYTE)
    else:
        plain = F.lit(UTF8)
    charset = F.when(two_byte | ~F.col("valid"), F.col("charset")).otherwise(plain)
    return through_storage(found.select("file", charset.alias("charset")), "file-charsets")


def decoded_lines(spark: SparkSession, path, found: DataFrame) -> DataFrame:
    """Lines of all files (``file, start, place, line``) by the charsets found."""
    kinds = [r.charset for r in found.select("charset").distinct().collect()]
    parts = []
    for charset in kinds:
        if charset in charsets.UTF16:
            wide = read_lines(spark, path, charset)
            text = charsets.two_byte_text(F.col("value"), charset)
            if len(kinds) > 1:
                # A condition on both sides, so that no filter decodes the lines of other files.
                wide = wide.join(found, "file").filter(F.col("charset") == charset)
                text = F.when(F.col("charset") == charset, text)
            parts.append(wide.withColumn("line", text))
    narrow = [c for c in kinds if c not in charsets.UTF16]
    if narrow:
        raw = read_lines(spark, path)
        if len(kinds) == 1:
            parts.append(raw.withColumn("line", charsets.text_of(F.col("value"), F.lit(narrow[0]))))
        else:
            # One row per file; small beside the lines, so Spark sends it to them.
            joined = raw.join(found.filter(F.col("charset").isin(narrow)), "file")
            parts.append(joined.withColumn("line", charsets.text_of(F.col("value"), F.col("charset"))))
    return reduce(DataFrame.unionByName, [p.select("file", "start", "place", "line") for p in parts])


def count_fields(line: Column, sep: str) -> Column:
    """Fields of a line; separators inside quotes do not count."""
    # A quote opens a field only at its start; inside, two quotes stand for one.
    quoted = rf'(^|{re.escape(sep)})"[^"]*(?:""[^"]*)*"'
    bare = F.when(F.contains(line, F.lit('"')), F.regexp_replace(line, quoted, "$1")).otherwise(line)
    return F.length(bare) - F.length(F.replace(bare, F.lit(sep))) + 1


def sniff_separator(header: str) -> str:
    """The separator with the most names in the header line; the first one wins a tie."""
    return max(SEPARATORS, key=lambda sep: len(next(csv.reader([header], delimiter=sep))))


def header_fields(line: str, sep: str, repair: bool = False) -> list[str]:
    """The fields of a header line."""
    line = line.lstrip("\ufeff").strip("\r\n")
    if repair:
        return [n.replace('"', "").strip() for n in line.strip().split(sep)]
    return next(csv.reader([line], delimiter=sep))


def column_names(fields: list[str]) -> list[str]:
    """Column names of header fields; empty and repeated ones get the usual stand-ins."""
    names: list[str] = []
    for i, n in enumerate(fields):
        n = n or f"Unnamed: {i}"
        again = 0
        while (f"{n}.{again}" if again else n) in names:
            again += 1
        names.append(f"{n}.{again}" if again else n)
    return names


def text_head(spark: SparkSession, path, n: int = 50) -> DataFrame:
    """The first ``n`` lines of a file, or of the files of a folder by name; bytes that are not UTF-8 are dropped."""
    lines = read_lines(spark, path)
    if len(spark.read.text(path).inputFiles()) > 1:
        # Every task keeps its first lines only.
        lines = lines.orderBy("file", "start", "place")
    return lines.limit(n).select(F.replace(F.make_valid_utf8("value"), F.lit("\ufffd")).alias("value"))


def _quoted(sep: str) -> tuple[str, str]:
    """Patterns of a quoted value that ends in the text, and of a quote that opens a value."""
    opens = rf"(^\ufeff?|{re.escape(sep)})\""
    return opens + r'[^"]*+(?:""[^"]*+)*+"(?!")', opens


def ends_open(line: Column, sep: str) -> Column:
    """Whether a quote that the line opens is still open at its end."""
    whole, opens = _quoted(sep)
    return F.when(F.contains(line, F.lit('"')), F.regexp_replace(line, whole, "$1").rlike(opens)).otherwise(F.lit(False))


def whole_records(lines: DataFrame, sep: str) -> DataFrame:
    """Lines (``file, start, place, line``) put together to records where a line break stands inside quotes, and ``complete``."""
    # A line that begins inside quotes is one that begins with a quote.
    inside = F.when(F.contains("line", F.lit('"')), ends_open(F.concat(F.lit('"'), "line"), sep)).otherwise(F.lit(True))
    pieces = lines.select("file", "start", "place", "line", ends_open(F.col("line"), sep).cast("bigint").alias("a"), inside.cast("bigint").alias("b"))
    return spanning.joined(pieces, spanning.QUOTES, "\n")


def _joined_head(lines: list[str], sep: str) -> list[str]:
    """The same for the first lines of a file; an unfinished last record is left out."""
    whole, opens = _quoted(sep)
    records, held = [], []
    for line in lines:
        held.append(line)
        text = "\n".join(held)
        if not re.search(opens, re.sub(whole, r"\1", text)):
            records.append(text)
            held = []
    return records


def _first_lines(spark: SparkSession, layout: Layout, found: DataFrame) -> list[str]:
    """Preamble, header and first data line of the first files by name: the names depend on
    them. Later files may repeat what stands above the data."""
    above, known = layout.preamble + 1, []
    for file, charset in found.select("file", "charset").orderBy("file").toLocalIterator():
        wide = charset if charset in charsets.UTF16 else None
        decoded = read_lines(spark, file, wide).select(
            charsets.two_byte_text(F.col("value"), wide) if wide else charsets.text_of(F.col("value"), F.lit(charset))
        )
        head = [r[0] for r in decoded.limit(above + 1).collect()]
        if layout.quoted_newlines:
            head = _first_records(decoded, head, layout, above + 1)
        known += [line for line in head if line not in known[:above]] if len(known) >= above else head
        if len(known) > above:
            break
    if len(known) < above:
        raise ValueError("no header line in the files")
    return known[: above + 1]


def _first_records(decoded: DataFrame, lines: list[str], layout: Layout, n: int) -> list[str]:
    """The first ``n`` records of a file; twice as many lines are read until they hold them."""
    while True:
        sep = layout.sep or sniff_separator(lines[layout.preamble] if len(lines) > layout.preamble else "")
        records = _joined_head(lines, sep)
        if len(records) >= n:
            return records[:n]
        wanted = 2 * max(len(lines), n)
        more = [r[0] for r in decoded.limit(wanted).collect()]
        if len(more) < wanted:
            return _joined_head(more, sep)[:n]
        lines = more


def _headed(line: Column, known: str, header: list[str], sep: str) -> Column:
    """Whether a line is the known header line or holds its names in any order."""
    plain = F.transform(F.split(F.replace(F.replace(line, F.lit("\ufeff")), F.lit('"')), re.escape(sep)), lambda x: F.trim(x))
    names = F.array(*[F.lit(h.replace('"', "").strip()) for h in header])
    return (line == known) | (F.array_sort(plain) == F.array_sort(names))


def _heads(lines: DataFrame, above: list[str], header: list[str], sep: str) -> DataFrame:
    """Per file: ``head``, its own header line (null if it has none), and ``seen``, how often each line that may stand above the
    data occurs in it."""
    line = F.col("line")
    headed = _headed(line, above[-1], header, sep)
    texts = sorted(set(above[:-1]))
    return lines.groupBy("file").agg(
        F.min_by("line", F.struct("start", "place")).alias("first"),
        F.min_by(F.when(headed, line), F.when(headed, F.struct("start", "place"))).alias("head"),
        F.count_if(headed).alias("n_headed"),
        F.array(*[F.count_if(line == t) for t in texts]).alias("seen") if texts else F.array().cast("array<bigint>").alias("seen"),
    )


def read_delimited(spark: SparkSession, path, layout: Layout = Layout()) -> Landed:
    """Rows of a delivered table.

    Lines with more fields than the header are left out and returned as rejects, short
    lines are filled with nulls, blank lines are skipped. Preamble and header may appear in
    every file of a folder, the header with its columns in another order; a file that does not begin with them is all data.
    Only what stands at the head of a file is skipped: data lines that equal a line of the
    head stay, as often as they occur beyond it.
    """
    files = through_storage(file_evidence(spark, path), "files")
    found = file_charsets(spark, path, files, layout)
    lines = _first_lines(spark, layout, found)
    above, data = lines[: layout.preamble + 1], lines[layout.preamble + 1 :]
    sep = layout.sep or sniff_separator(above[-1])
    header = header_fields(above[-1], sep, layout.repair_header)
    width = len(header)
    if layout.repair_header and data:
        width = max(width, len(header_fields(data[0], sep)))
    decoded = decoded_lines(spark, path, found)
    unfinished = None
    if layout.quoted_newlines:
        records = whole_records(decoded, sep)
        unfinished = records.filter("not complete").select("file", "line", F.lit(None).cast("int").alias("n_fields"))
        decoded = records.filter("complete").drop("complete")
    texts = sorted(set(above[:-1]))
    own = F.col("head").isNotNull() & (F.col("first") == (F.lit(above[0]) if layout.preamble else F.col("head")))
    for i, text in enumerate(texts):
        own = own & (F.col("seen")[i] >= above[:-1].count(text))
    heads = through_storage(_heads(decoded, above, header, sep), "heads").withColumn("own", F.coalesce(own, F.lit(False)))
    headed = _headed(F.col("line"), above[-1], header, sep)
    candidate = headed | F.col("line").isin(texts) if texts else headed
    plain = decoded.filter((F.length(F.trim("line")) > 0) & ~candidate).select("file", "line")
    body = plain
    for i, text in enumerate(texts):
        # Blank lines are no data wherever they stand.
        if text.strip() and text != above[-1]:
            more = F.col("seen")[i] - F.when(F.col("own"), F.lit(above[:-1].count(text))).otherwise(0)
            body = body.unionByName(_again(heads, more, F.lit(text)))
    body = body.unionByName(_again(heads, F.col("n_headed") - F.when(F.col("own"), 1).otherwise(0), F.col("head")))
    counted = body.withColumn("n_fields", count_fields(F.col("line"), sep))
    rejects = counted.filter(F.col("n_fields") > width)
    if unfinished is not None:
        rejects = rejects.unionByName(unfinished)
    schema = ", ".join(f"c{i} string" for i in range(width))
    parse = F.from_csv("line", schema, {"sep": sep, "quote": '"', "escape": '"'}).alias("_row")
    good = counted.filter(F.col("n_fields") <= width)
    names = column_names(header)
    moved = heads.filter(F.col("own") & F.col("head").isNotNull()).select("file", _places(F.col("head"), header, sep).alias("places"))
    moved = moved.filter(~F.forall(F.arrays_zip("places", F.sequence(F.lit(1), F.size("places")).alias("n")), lambda x: x.places == x.n))
    if moved.isEmpty():
        return Landed(_named(good.select(parse).select("_row.*"), names), rejects)
    # One row per file; fields are picked by the places their names have in the file's own header.
    placed = good.join(moved, "file", "left").select(parse, "places")
    fields = F.array(*[F.col(f"_row.c{i}") for i in range(width)])
    picked = [F.coalesce(F.col("places")[i], F.lit(i + 1)) if i < len(header) else F.lit(i + 1) for i in range(width)]
    rows = placed.select(fields.alias("_fields"), *[p.alias(f"p{i}") for i, p in enumerate(picked)])
    return Landed(_named(rows.select(*[F.element_at("_fields", F.col(f"p{i}")).alias(f"c{i}") for i in range(width)]), names), rejects)


def _places(head: Column, header: list[str], sep: str) -> Column:
    """Where the names of the header stand in another header line with the same names; of equal names the first is the first."""
    plain = F.transform(F.split(F.replace(F.replace(head, F.lit("\ufeff")), F.lit('"')), re.escape(sep)), lambda x: F.trim(x))
    numbered = F.transform(plain, lambda x, i: F.struct(x.alias("name"), F.size(F.filter(F.slice(plain, F.lit(1), i + 1), lambda y: y == x)).alias("n")))
    seen: dict[str, int] = {}
    wanted = []
    for h in header:
        name = h.replace('"', "").strip()
        seen[name] = seen.get(name, 0) + 1
        wanted.append(F.struct(F.lit(name).alias("name"), F.lit(seen[name]).alias("n")))
    return F.transform(F.array(*wanted), lambda w: F.array_position(numbered, w).cast("int"))


def _again(heads: DataFrame, n: Column, line: Column) -> DataFrame:
    """``file, line`` as often as ``n`` says."""
    some = heads.select("file", line.alias("line"), n.alias("_n")).filter("_n > 0")
    return some.select("file", "line", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_n"))).alias("_k")).drop("_k")


def _named(parsed: DataFrame, names: list[str]) -> DataFrame:
    """The columns of the header, with texts that stand for a missing value as null."""
    columns = [F.col(c) for c in parsed.columns[: len(names)]]
    return parsed.select(*[F.when(~c.isin(*MISSING_TEXTS), c).alias(n) for c, n in zip(columns, names)])


@dataclass(frozen=True)
class TableSpec:
    """How one delivered file becomes a table: layout, numeric columns, header rule, own step.

    ``plain_headers``: the older rule, by which only blanks and points in names become underscores and ends are kept.
    """

    layout: Layout = Layout()
    numbers: tuple[str, ...] = ()
    plain_headers: bool = False
    transform: Callable[[DataFrame], DataFrame] | None = None


def typed(df: DataFrame, numbers: tuple[str, ...] = ()) -> DataFrame:
    """The pack key as bigint (leading zeros carry no meaning), other numbers as double."""
    changes = {c: number(F.col(f"`{c}`")) for c in numbers if c in df.columns}
    if KEY_NAME in df.columns:
        changes[KEY_NAME] = F.trim(KEY_NAME).try_cast("bigint")
    return df.withColumns(changes) if changes else df


def clean_prices(df: DataFrame) -> DataFrame:
    """Every string column with a price in its name as a number."""
    texts = {f.name for f in df.schema.fields if f.dataType.simpleString() == "string"}
    changes = {c: price(F.col(f"`{c}`")) for c in df.columns if c in texts and is_price_column(c)}
    return df.withColumns(changes) if changes else df


def clean_table(landed: DataFrame, spec: TableSpec = TableSpec()) -> DataFrame:
    """Normalised names, typed columns, then the table's own step."""
    names = clean_headers(landed.columns, HEADER_DROPPED_PLAIN, keep_ends=True) if spec.plain_headers else clean_headers(landed.columns)
    df = typed(landed.toDF(*names), spec.numbers)
    return df.transform(spec.transform) if spec.transform else df


# The tables of the register and how their files are written.
REGISTER: Mapping[str, TableSpec] = {
    "farmaci_anagrafica": TableSpec(),
    "principi_attivi": TableSpec(numbers=("quantita",)),
    "atc": TableSpec(),
    "farmaci_carenti": TableSpec(Layout(preamble=2)),
    "farmaci_equivalenti": TableSpec(transform=clean_prices),
    "classe_a": TableSpec(Layout(repair_header=True)),
    "classe_h": TableSpec(Layout(repair_header=True)),
}


@dataclass(frozen=True)
class Register:
    """The cleaned tables that were delivered, and the rejected lines of each."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    rejects: dict[str, DataFrame] = field(default_factory=dict)


def exists(spark: SparkSession, path) -> bool:
    try:
        spark.read.text(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def read_register(
    spark: SparkSession, paths: Mapping[str, str], specs: Mapping[str, TableSpec] = REGISTER
) -> Register:
    """Read every delivered table; a file that is not there is skipped with a warning."""
    out = Register()
    for name, spec in specs.items():
        path = paths.get(name)
        if path is None or not exists(spark, path):
            log.warning("no file for table %s, skipped", name)
            continue
        landed = read_delimited(spark, path, spec.layout)
        out.tables[name] = clean_table(landed.rows, spec)
        out.rejects[name] = landed.rejects
    return out
