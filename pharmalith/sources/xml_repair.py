"""Damaged XML records mended as far as their tags tell."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_NAME = r"[A-Za-z_:][\w:.\-]*"
_MARKUP = re.compile(
    rf"<(?:/\s*(?P<end>{_NAME})\s*>|(?P<tag>{_NAME})(?P<attributes>(?:\s+{_NAME}\s*=\s*(?:\"[^\"<]*\"|'[^'<]*'))*)\s*(?P<empty>/?)>"
    r"|!--(?:(?!--).)*-->|!\[CDATA\[(?:(?!\]\]>).)*\]\]>)",
    re.DOTALL,
)
# The entities every XML text knows, and the characters no XML text may hold.
_STRAY = re.compile(r"&(?!(?:amp|lt|gt|quot|apos|#[0-9]+|#x[0-9A-Fa-f]+);)")
_FORBIDDEN = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


def repair(text: str) -> tuple[str, list[str]]:
    """A well-formed text with all sound elements of ``text``, and what was wrong with it.

    An element whose end tag is missing ends with its own text, before the next tag, so what would be in it stands beside it. An end
    tag without a start tag is left out, and so is what follows the end of the first element. Other signs of markup become text.
    """
    out: list[str] = []
    # Name of each open element, and where its start tag ends in ``out``; its text is the next piece.
    open_tags: list[tuple[str, int]] = []
    damage: list[str] = []

    def plain(piece: str) -> None:
        if _FORBIDDEN.search(piece):
            damage.append("forbidden character")
            piece = _FORBIDDEN.sub("", piece)
        if _STRAY.search(piece):
            damage.append("stray &")
            piece = _STRAY.sub("&amp;", piece)
        if "<" in piece:
            damage.append("broken tag")
            piece = piece.replace("<", "&lt;")
        out.append(piece)

    def unclosed() -> None:
        tag, place = open_tags.pop()
        damage.append(f"unclosed <{tag}>")
        out[place + 1] += f"</{tag}>"

    at, closed = 0, False
    for m in _MARKUP.finditer(text):
        if closed:
            break
        plain(text[at : m.start()])
        at = m.end()
        if m["end"]:
            if all(tag != m["end"] for tag, _ in open_tags):
                damage.append(f"unexpected </{m['end']}>")
                continue
            while open_tags[-1][0] != m["end"]:
                unclosed()
            out.append(f"</{open_tags.pop()[0]}>")
            closed = not open_tags
        elif m["tag"]:
            names = re.findall(rf"({_NAME})\s*=", re.sub(r"\"[^\"]*\"|'[^']*'", "", m["attributes"]))
            out.append(f"<{m['tag']}")
            if len(set(names)) < len(names):
                damage.append(f"repeated attribute in <{m['tag']}>")
            else:
                plain(m["attributes"])
            out.append(f"{m['empty']}>")
            if not m["empty"]:
                open_tags.append((m["tag"], len(out) - 1))
            closed = not open_tags
        else:
            out.append(_FORBIDDEN.sub("", m[0]))
    if not closed:
        plain(text[at:])
        while len(open_tags) > 1:
            unclosed()
        if open_tags:
            damage.append(f"unclosed <{open_tags[0][0]}>")
            out.append(f"</{open_tags[0][0]}>")
    return "".join(out), damage


def repaired(damaged: DataFrame, column: str) -> DataFrame:
    """``record`` (the text as it was), ``fixed`` and ``damage`` of the texts in a column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            done = [repair(t) for t in texts]
            columns = [texts, [f for f, _ in done], ["; ".join(dict.fromkeys(d)) for _, d in done]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["record", "fixed", "damage"])

    return damaged.select(column).mapInArrow(run, "record string, fixed string, damage string")
