"""Encoding a text as the concatenation of its pieces.

When no match of a tokenizer's pre-split reaches over a cut, the ids of a text are
those of its pieces in order. Corpus texts repeat their words, so a bounded table
of pieces seen by this Python worker saves most calls of the library.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Pieces remembered in each of the two generations of a worker's table.
REMEMBERED_PIECES = 200_000
# A longer piece is encoded but not remembered.
LONGEST_REMEMBERED = 64
# Text bytes encoded at a time.
SLICE_BYTES = 4 << 20

# Characters up to here have had stable classes in every Unicode version, so a
# split written with the classes below equals the library's own split.
_LATIN_END = 0x250
BEYOND_LATIN = re.compile(f"[^\x00-{chr(_LATIN_END - 1)}]")


def latin_class(kind: str) -> str:
    """Latin characters of one general category (L or N), for use inside a character class."""
    return "".join(c for c in map(chr, range(_LATIN_END)) if unicodedata.category(c)[0] == kind)


LATIN_WHITE = "\t-\r \x85\xa0"


def byte_characters() -> list[str]:
    """The stand-in of each byte: itself where printable, else the next code point from 256."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(byte if byte in shown else next(spare)) for byte in range(256)]


class PieceEncoder:
    """Packed ids of texts: each piece is looked up, else encoded and remembered."""

    def __init__(
        self, cut: Callable[[str], Sequence[str]], encode_piece: Callable[[str], list[int]], remembered: int
    ):
        self._cut, self._encode_piece, self._remembered = cut, encode_piece, remembered
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        pieces = self._cut(text)
        found = list(map(self._young.get, pieces))
        if None in found:
            for at, packed in enumerate(found):
                if packed is None:
                    found[at] = self._missing(pieces[at])
        return b"".join(found)

    def _missing(self, piece: str) -> bytes:
        packed = self._young.get(piece) or self._old.get(piece)
        if packed is None:
            packed = array("I", self._encode_piece(piece)).tobytes()
        if len(piece) <= LONGEST_REMEMBERED:
            if len(self._young) >= self._remembered:
                self._old, self._young = self._young, {}
            self._young[piece] = packed
        return packed


class TextEncoder:
    """Latin texts are cut into the matches of the split, all others at white space only."""

    def __init__(
        self,
        tokenizer,
        latin_cut: Callable[[str], Sequence[str]],
        any_cut: Callable[[str], Sequence[str]],
        fold: Callable[[str], str] | None = None,
        remembered: int = REMEMBERED_PIECES,
    ):
        """``fold`` is the tokenizer's own folding of case; its result is cut when it is Latin too."""
        self._fold = fold
        shown, model = byte_characters(), tokenizer.model

        def one_match(piece: str) -> list[int]:
            return [token.id for token in model.tokenize("".join([shown[byte] for byte in piece.encode()]))]

        def whole_chunk(chunk: str) -> list[int]:
            return tokenizer.encode(chunk, add_special_tokens=False).ids

        self._latin = PieceEncoder(latin_cut, one_match, remembered)
        self._any = PieceEncoder(any_cut, whole_chunk, remembered)

    def encode(self, text: str) -> bytes:
        if BEYOND_LATIN.search(text):
            return self._any.encode(text)
        if self._fold is None:
            return self._latin.encode(text)
        folded = self._fold(text)
        return self._any.encode(text) if BEYOND_LATIN.search(folded) else self._latin.encode(folded)


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of each part stay near SLICE_BYTES."""
    if not batch.num_rows:
        return
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    group = np.cumsum(lengths) // SLICE_BYTES
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]).tolist()
    for begin, end in zip(starts, [*starts[1:], len(group)], strict=True):
        yield batch.slice(begin, end - begin)


def id_lists(encoded: Sequence[bytes]) -> pa.Array:
    """Packed ids as an Arrow list of 32-bit integers."""
    offsets = np.zeros(len(encoded) + 1, np.int32)
    np.cumsum([len(ids) // 4 for ids in encoded], out=offsets[1:])
    values = pa.array(np.frombuffer(b"".join(encoded), "<i4"), pa.int32())
    return pa.ListArray.from_arrays(pa.array(offsets), values)
