"""Text predicates, header names and number parsing."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters kept in a header, header synonyms of the pack key, the word
# that marks a nameless column, the substrings that mark a price column, and the
# currency sign (with the byte it has when a Windows file is read as ISO-8859-1).
HEADER_DROPPED = r"[^a-z0-9_àèéìòù]+"
HEADER_DROPPED_PLAIN = r"[\s.]+"
KEY_SYNONYMS = ("aic", "codice")
KEY_NAME = "codice_aic"
NAMELESS = "unnamed"
PRICE_MARKS = ("prezzo", "differenza")
CURRENCY_SIGNS = "€\u0080"

_HARD_SPACE = "\u00a0"
_NUMBER = r"^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i)inf(inity)?)\s*$"
_LIKE_ESCAPE = "\u0001"


def is_like_pattern(term: Column) -> Column:
    """True where a search term holds the LIKE wildcards ``%`` or ``_``."""
    return term.rlike("[%_]")


def found_in(text: Column, term: Column, wild: Column) -> Column:
    """``text LIKE '%' || term || '%'`` with no escape character.

    Plain terms, the usual case, take the cheap ``contains`` branch.
    """
    pattern = F.concat(F.lit("%"), F.replace(term, F.lit(_LIKE_ESCAPE), F.lit(_LIKE_ESCAPE * 2)), F.lit("%"))
    return F.when(wild, F.like(text, pattern, F.lit(_LIKE_ESCAPE))).otherwise(F.contains(text, term))


def present(c: Column) -> Column:
    """Neither null nor empty."""
    return c.isNotNull() & (F.length(c) > 0)


def clean_header(name: str, dropped: str = HEADER_DROPPED, keep_ends: bool = False) -> str:
    """One normalised header name; nameless columns keep the name they came with."""
    cleaned = re.sub(dropped, "_", name.strip().lower())
    if not keep_ends:
        cleaned = cleaned.strip("_")
    return name if NAMELESS in cleaned else cleaned


def clean_headers(names: Sequence[str], dropped: str = HEADER_DROPPED, keep_ends: bool = False) -> list[str]:
    """Normalised names of a whole header; the pack key gets its one name."""
    cleaned = [clean_header(n, dropped, keep_ends) for n in names]
    cleaned = [KEY_NAME if n in KEY_SYNONYMS else n for n in cleaned]
    twice = sorted({n for n in cleaned if cleaned.count(n) > 1})
    if twice:
        raise ValueError(f"several columns clean to the same name: {twice}")
    return cleaned


def number(c: Column) -> Column:
    """A decimal number, or null for any other text.

    The pattern comes first: a cast would also read ``1.5d``, hexadecimal and NaN, and is
    slow on text it cannot read.
    """
    text = F.replace(c, F.lit(_HARD_SPACE), F.lit(" "))
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def price(c: Column) -> Column:
    """Price text to double: currency sign off, decimal comma to point, else null.

    A thousands point next to a decimal comma is not a number and gives null.
    """
    for sign in CURRENCY_SIGNS:
        c = F.replace(c, F.lit(sign))
    return number(F.replace(c, F.lit(","), F.lit(".")))


def is_price_column(name: str) -> bool:
    return any(mark in name for mark in PRICE_MARKS)
