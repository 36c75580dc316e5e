"""Charsets of delivered files, by byte-order marks, zero bytes and the byte pairs of their text.

A file that is no UTF-8 text is scored under every single-byte charset: its byte pairs that end in a byte beyond ASCII are
counted, in one grouped sum over all lines, and joined with a table of weights per charset and pair. The weight says how usual
the character that the charset makes of the byte is behind the character before it. Tables of pairs follow from the charset itself.
"""

from __future__ import annotations

import codecs
import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The charsets, the single-byte ones in the order that settles ties, by the names Python knows them by.
UTF8 = "UTF-8"
UTF16 = {"UTF-16LE": "fffe", "UTF-16BE": "feff"}
SINGLE_BYTE = "ISO-8859-1"
SINGLE = {SINGLE_BYTE: "latin-1", "windows-1252": "cp1252", "IBM850": "cp850", "macintosh": "mac_roman"}

# Lower-case letters beyond ASCII in Italian and in other western languages, and signs of print.
ITALIAN = "àèéìòù"
WESTERN = "áâãäåæçêëíîïðñóôõöøúûüýþÿßœšž"
PRINT = "’‘“”«»–—…€°"

# Weight of a character by its kind and the kind of the one before it.
WEIGHTS = {
    "italian": {"lower": 3.0, "upper": 0.0, "other": 1.0},
    "western": {"lower": 2.0, "upper": 0.0, "other": 0.5},
    "capital": {"lower": -2.0, "upper": 2.0, "other": 1.0},
    "print": {"lower": 1.5, "upper": 1.0, "other": 1.5},
    "sign": {"lower": -2.0, "upper": -1.5, "other": 0.0},
    "strange": {"lower": -3.0, "upper": -3.0, "other": -3.0},
    "control": {"lower": -6.0, "upper": -6.0, "other": -6.0},
}
# Share of zero bytes above which a text has two bytes a character.
ZEROS = 0.2


def known(name: str) -> str:
    """The name used here of a charset that is given by any of its names."""
    names = {codecs.lookup(n).name: n for n in (UTF8, *UTF16)} | {codecs.lookup(python).name: n for n, python in SINGLE.items()}
    found = names.get(codecs.lookup(name).name)
    if found is None:
        raise ValueError(f"unknown charset {name!r}")
    return found


def _kind(character: str) -> str:
    """Kind of a character beyond ASCII."""
    if character in ITALIAN:
        return "italian"
    if character in WESTERN:
        return "western"
    if character in PRINT:
        return "print"
    if character.upper() == character and character.lower() in ITALIAN + WESTERN:
        return "capital"
    category = unicodedata.category(character)
    if character == "�" or category in ("Cc", "Cn", "Co"):
        return "control"
    return "strange" if category[0] == "L" or "─" <= character <= "▟" else "sign"


def _before(character: str) -> str:
    return "lower" if character.islower() else "upper" if character.isupper() else "other"


@cache
def alphabet(charset: str) -> str:
    """What a single-byte charset makes of the bytes 128 to 255; a byte without a character is the replacement character."""
    return "".join(bytes([b]).decode(SINGLE[charset], "replace") for b in range(128, 256))


def pair_weights() -> list[tuple[str, int, int, float]]:
    """Charset, byte, next byte (beyond ASCII) and weight of all pairs."""
    rows = []
    for charset in SINGLE:
        letters = [chr(b) for b in range(128)] + list(alphabet(charset))
        kinds = [_kind(c) for c in letters[128:]]
        for first, character in enumerate(letters):
            before = _before(character)
            rows += [(charset, first, 128 + k, WEIGHTS[kind][before]) for k, kind in enumerate(kinds)]
    return rows


def single_byte_text(value: Column, charset: str) -> Column:
    """Text of a value whose bytes are in a single-byte charset."""
    text = F.decode(value.cast("binary"), SINGLE_BYTE)
    if charset == SINGLE_BYTE:
        return text
    return F.translate(text, "".join(map(chr, range(128, 256))), alphabet(charset))


def text_of(value: Column, charset: Column) -> Column:
    """Text of a value by the charset of its file; two-byte charsets are decoded where their lines are read."""
    out = F.when(charset == UTF8, value)
    for name in SINGLE:
        out = out.when(charset == name, single_byte_text(value, name))
    return out


def two_byte_text(value: Column, charset: str) -> Column:
    """Text of a line of two bytes a character, without mark and carriage return; half a character at its end is left out."""
    whole = F.substring(value.cast("binary"), F.lit(1), F.octet_length(value) - F.octet_length(value) % 2)
    return F.regexp_replace(F.decode(whole, charset), "^\ufeff|\r$", "")


def pair_counts(lines: DataFrame) -> DataFrame:
    """``file, a, b, n``: byte pairs that end beyond ASCII; a line begins behind a blank."""
    # One character per byte; each pair is the byte and the place before it, so overlapping pairs all count.
    text = F.concat(F.lit(" "), F.decode(F.col("value").cast("binary"), SINGLE_BYTE))
    second = F.regexp_extract_all(text, F.lit("(?s)([\u0080-ÿ])"), F.lit(1))
    first = F.regexp_extract_all(text, F.lit("(?s)(.)(?=[\u0080-ÿ])"), F.lit(1))
    pairs = lines.select("file", F.explode(F.arrays_zip(first.alias("first"), second.alias("second"))).alias("p"))
    return pairs.groupBy("file", F.col("p.first").alias("a"), F.col("p.second").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def pair_scores(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """``file, charset, score`` under every single-byte charset."""
    model = spark.createDataFrame([(c, chr(a), chr(b), w) for c, a, b, w in pair_weights()], "charset string, a string, b string, weight double")
    return pair_counts(lines).join(model, ["a", "b"]).groupBy("file", "charset").agg(F.sum(F.col("n") * F.col("weight")).alias("score"))


def best_single_byte(scores: DataFrame) -> DataFrame:
    """``file, charset, confidence``: the best score, the first in order of equal ones, and its chance against the next best score."""
    order = F.array_position(F.array(*map(F.lit, SINGLE)), F.col("charset"))
    ranked = scores.groupBy("file").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("worse"), order.alias("order"), "charset"))).alias("r"))
    first = F.col("r")[0]
    other = F.try_element_at(F.filter("r", lambda x: x.worse > first.worse), F.lit(1))
    gap = F.coalesce(other.worse - first.worse, F.lit(0.0))
    return ranked.select("file", first.charset.alias("charset"), (1 / (1 + F.exp(-F.least(gap, F.lit(30.0))))).alias("confidence"))


def two_byte_charset(first_line: Column, n_zeros: Column, n_bytes: Column) -> Column:
    """``UTF-16LE`` or ``UTF-16BE`` by the mark, or by which byte of the first characters is zero; null for other texts."""
    head = F.lower(F.hex(F.substring(first_line.cast("binary"), 1, 512)))
    pairs = F.regexp_extract_all(head, F.lit("(..)(..)"), F.lit(0))
    zero_first = F.size(F.filter(pairs, lambda p: F.left(p, F.lit(2)) == "00"))
    zero_second = F.size(F.filter(pairs, lambda p: F.right(p, F.lit(2)) == "00"))
    marks = F.left(head, F.lit(4))
    marked = F.when(marks == UTF16["UTF-16LE"], "UTF-16LE").when(marks == UTF16["UTF-16BE"], "UTF-16BE")
    return marked.when(n_zeros > ZEROS * n_bytes, F.when(zero_first > zero_second, "UTF-16BE").otherwise("UTF-16LE"))
