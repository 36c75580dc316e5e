"""Byte-pair encoding of whole texts into the ids of a SentencePiece model, and back.

Merging the best pair until none is left gives every prefix of a text one last piece, and a row of pieces is the
encoding exactly if each two neighbours stay apart when they are merged alone. So one pass from left to right
suffices: an automaton over all pieces names those that end at a character, and the one that is compatible with the last
piece of the prefix before it is the last piece of this prefix. Only its number is kept per character; the pieces are
read off backwards from the end. Time and memory are linear in the text, whatever it holds.

No piece has a space mark behind another character (checked when the model is read), so no merge crosses such a place
and a text falls into words that are encoded on their own; words and verdicts on pairs are remembered, up to a bound
each. A model is read once per Python process from a path that every executor can reach.

Defined results: null and empty texts are the begin and end ids alone. Characters the model lacks become byte ids.
Ids without a character (begin, end) decode to nothing, the unknown id to its surface, bytes that are no UTF-8 to one
replacement character each. Repeated rows are coded each; other columns are not read. Any text length is read whole.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from pharmalith.llm.common import beside

# The mark that stands for a space, the surface of the unknown id, the kinds of pieces.
SPACE = "▁"
UNKNOWN = " ⁇ "
NORMAL, UNK, CONTROL, BYTE = 1, 2, 3, 6
BPE = 2

# What a process remembers at most: twice so many words of up to ``LONGEST`` characters, and pairs.
WORDS, PAIRS, LONGEST = 1 << 18, 1 << 19, 48
# Rows that are coded at a time.
ROWS = 512

_codecs: dict[str, "PieceCodec"] = {}


class _Words(dict):
    """Packed ids by word, worked out when first asked for. When ``WORDS`` are held, they become the older half and a new half
    begins; a word asked for again moves over, so frequent words stay."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, word: str) -> bytes:
        packed = self.older.get(word)
        if packed is None:
            packed = self.make(word)
        if len(word) <= LONGEST:
            if len(self) >= WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = packed
        return packed


class _Alone(dict):
    """Number of a character on its own: the id of its piece, or one beyond all ids."""

    def __init__(self, size: int, ids: dict[str, int]):
        super().__init__((p, k) for p, k in ids.items() if len(p) == 1)
        self.size = size

    def __missing__(self, character: str) -> int:
        return self.size + ord(character)


class PieceCodec:
    """Ids of texts and texts of ids under one model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        norm, trained = model.normalizer_spec, model.trainer_spec
        plain = not norm.precompiled_charsmap and norm.add_dummy_prefix and norm.escape_whitespaces
        if not plain or norm.remove_extra_whitespaces or trained.treat_whitespace_as_suffix:
            raise ValueError("only models that leave the text as it is and mark a space before it")
        if trained.model_type != BPE or not trained.byte_fallback or any(p.type not in (NORMAL, UNK, CONTROL, BYTE) for p in model.pieces):
            raise ValueError("only byte-pair models with byte ids and without pieces of the user")

        self.score = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        self.id = {p.piece: k for k, p in enumerate(model.pieces) if p.type == NORMAL}
        self.byte_id = [0] * 256
        self.raw = []
        for k, p in enumerate(model.pieces):
            if p.type == BYTE:
                self.byte_id[int(p.piece[1:-1], 16)] = k
                self.raw.append(bytes([int(p.piece[1:-1], 16)]))
            else:
                self.raw.append({CONTROL: "", UNK: UNKNOWN}.get(p.type, p.piece.replace(SPACE, " ")).encode())
        self.marked = {k for p, k in self.id.items() if p.startswith(SPACE)}
        self.silent = {k for k, p in enumerate(model.pieces) if p.type == CONTROL}
        self.begin, self.end = trained.bos_id, trained.eos_id

        if any(SPACE in p.lstrip(SPACE) for p in self.score):
            raise ValueError("a piece goes on behind a space mark")
        self._joins = {p[k : k + 2] for p in self.score for k in range(len(p) - 1)}
        joined = {c for p in self._joins for c in p}
        alone = "".join(re.escape(c) for c in map(chr, range(128)) if c not in joined)
        self.words = re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+|[{alone}]" if alone else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        # Pieces by number: their ids, then a number for each character that is no piece.
        self.size = len(model.pieces)
        self.piece = [p.piece for p in model.pieces]
        self.length = [len(p) for p in self.piece]
        self._alone = _Alone(self.size, self.id)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for p, k in self.id.items():
            if len(p) > 1:
                self.automaton.add_word(p, k)
        self.automaton.make_automaton()
        self._pairs: dict[int, bool] = {}
        self._known = _Words(self.word_ids)
        self._ends = np.array([self.begin], "<u4").tobytes(), np.array([self.end], "<u4").tobytes()

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by the definition: merge the best pair, the leftmost of equals, until none is left."""
        parts, score = list(text), self.score
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def text_of(self, number: int) -> str:
        return self.piece[number] if number < self.size else chr(number - self.size)

    def compatible(self, left: int, right: int) -> bool:
        """Whether ``right`` can follow ``left`` (-1: nothing, at the start) in an encoding."""
        key = left * self.size + right
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= PAIRS:
                self._pairs.clear()
            apart = [self.text_of(k) for k in (left, right) if k >= 0]
            known = self._pairs[key] = self.merged("".join(apart)) == apart
        return known

    def prefix_table(self, word: str) -> list[int]:
        """Number of the last piece of every prefix; a character that no longer piece ends at stands alone."""
        last = list(map(self._alone.__getitem__, word))
        settled = -1
        known, length, size = self._pairs.get, self.length, self.size
        for end, right in self.automaton.iter(word):
            if end == settled:
                continue
            before = end - length[right]
            left = last[before] if before >= 0 else -1
            fits = known(left * size + right)
            if fits is None:
                fits = self.compatible(left, right)
            if fits:
                last[end] = right
                settled = end
        return last

    def word_ids(self, word: str) -> bytes:
        """Packed ids of a word, read backwards from its prefix table.

        Last characters that no piece holds behind the one before, such as a full stop, stand alone after the rest.
        """
        cut = len(word)
        while cut > 1 and word[cut - 2 : cut] not in self._joins:
            cut -= 1
        if cut < len(word):
            return self._known[word[:cut]] + b"".join([self._known[c] for c in word[cut:]])
        last, at, out = self.prefix_table(word), len(word) - 1, []
        while at >= 0:
            number = last[at]
            if number < self.size:
                out.append(number)
                at -= self.length[number]
            else:
                out.extend(self.byte_id[b] for b in reversed(word[at].encode("utf-8", "surrogatepass")))
                at -= 1
        out.reverse()
        return struct.pack(f"<{len(out)}I", *out)

    def packed(self, text: str | None) -> bytes:
        """Ids of a whole text between the begin and end ids, as little-endian unsigned 32-bit integers."""
        begin, end = self._ends
        if not text:
            return begin + end
        words = self.words.findall(SPACE + text.replace(" ", SPACE))
        return b"".join([begin, *map(self._known.__getitem__, words), end])

    def encode(self, text: str | None) -> np.ndarray:
        """The same as numbers."""
        return np.frombuffer(self.packed(text), "<u4")

    def decode(self, ids: Iterable[int]) -> str:
        """Text of any ids; the space mark before the text goes. Bytes join to characters only with their neighbours."""
        ids = list(ids)
        if ids and ids[0] in self.silent:
            del ids[0]
        if ids and ids[-1] in self.silent:
            del ids[-1]
        runs = [ids]
        if not self.silent.isdisjoint(ids):
            cuts = [-1, *(k for k, x in enumerate(ids) if x in self.silent), len(ids)]
            runs = [ids[a + 1 : b] for a, b in zip(cuts, cuts[1:])]
        out = "".join([b"".join(map(self.raw.__getitem__, r)).decode("utf-8", "surrogateescape") for r in runs])
        first = next((r[0] for r in runs if r), None)
        if first in self.marked:
            out = out[1:]
        return out if out.isascii() else re.sub("[\udc80-\udcff]", "\ufffd", out)


def codec(path: str) -> PieceCodec:
    """The codec of a model file, kept for the life of the process."""
    if path not in _codecs:
        _codecs[path] = PieceCodec(path)
    return _codecs[path]


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch that are handed on one by one, which bounds what a task holds."""
    return (batch.slice(at, ROWS) for at in range(0, batch.num_rows, ROWS))


def encode(docs: DataFrame, model: str, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep`` with ``n_tokens`` and ``ids``: packed unsigned 32-bit integers, little-endian, as token files hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(model)
        for batch in batches:
            for rows in _slices(batch):
                ids = [code.packed(t.as_py()) for t in rows.column(0)]
                added = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays([*rows.columns[1:], *added], [*batch.schema.names[1:], "n_tokens", "ids"])

    return beside(docs, text_col, keep, StructType().add("n_tokens", "long").add("ids", "binary"), run)


def decode(coded: DataFrame, model: str, keep: list[str], ids_col: str = "ids") -> DataFrame:
    """Columns ``keep`` with ``decoded``, the text of packed ids; null ids are the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(model)
        for batch in batches:
            for rows in _slices(batch):
                texts = [code.decode(np.frombuffer(x.as_py() or b"", "<u4").tolist()) for x in rows.column(0)]
                yield pa.RecordBatch.from_arrays([*rows.columns[1:], pa.array(texts, pa.string())], [*batch.schema.names[1:], "decoded"])

    return beside(coded, ids_col, keep, StructType().add("decoded", "string"), run)
