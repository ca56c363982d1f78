"""Byte-level BPE encoding and decoding with the tokenizers library.

A rank file (base64 token, rank) becomes a BPE model of the library: every byte
has a printable stand-in character, tokens are strings of stand-ins, and every
cut of a token into two tokens is a merge, ordered by the rank of its result. A
match that is itself a token is taken whole. Texts travel in Arrow batches.

Decoding looks the stand-ins up in the reversed byte table. A token may end inside
a character, so bytes are joined for the whole document before they are read as
UTF-8; ``token_spans`` gives the byte and character offsets of every token, where
a character split over tokens counts for the token with its first byte. Texts are
cut before encoding only for the pattern SPLIT; other patterns may match over any
cut and get the whole text.

Defined cases: null text is empty, an empty text has no ids and decodes to no
bytes. Special-token strings are ordinary text. Extra columns stay in ``row``.
"""

from __future__ import annotations

import base64
import os
import re
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from hangarflow.llm.chunked import LATIN_WHITE, TextEncoder, byte_characters, id_lists, latin_class, slices
from hangarflow.llm.texts import carried, text_or_empty

# --- fixed values: white space of the split pattern (Unicode White_Space) -------
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# --- end of fixed values ---------------------------------------------------------
_L, _N, _W = latin_class("L"), latin_class("N"), LATIN_WHITE
# SPLIT over Latin characters, with the classes spelled out.
_LATIN_MATCH = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_W}{_L}{_N}]+|[{_W}]+(?![^{_W}])|[{_W}]+")
# White space starts a new match unless white space stands before it.
_CHUNK = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")


@cache
def token_bytes(path: str) -> tuple[bytes, ...]:
    """Bytes of each id."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    by_rank = {int(rank): base64.b64decode(token) for token, rank in pairs}
    if sorted(by_rank) != list(range(len(by_rank))):
        raise ValueError("ranks must run from 0 without gaps")
    return tuple(by_rank[rank] for rank in range(len(by_rank)))


def bpe_model(path: str, pattern: str):
    """A tokenizer of the library with the vocabulary, merges and split of a rank file."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    tokens = token_bytes(path)
    rank_of = {token: rank for rank, token in enumerate(tokens)}
    shown = byte_characters()
    text = ["".join([shown[byte] for byte in token]) for token in tokens]
    merges = [
        (text[rank_of[token[:cut]]], text[rank_of[token[cut:]]])
        for token in tokens
        for cut in range(1, len(token))
        if token[:cut] in rank_of and token[cut:] in rank_of
    ]
    tokenizer = Tokenizer(models.BPE({t: i for i, t in enumerate(text)}, merges, ignore_merges=True))
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
        [
            pre_tokenizers.Split(Regex(pattern), "isolated"),
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
        ]
    )
    return tokenizer


class WholeEncoder:
    """Packed ids of texts, each encoded by the library in one piece."""

    def __init__(self, tokenizer):
        self._tokenizer = tokenizer

    def encode(self, text: str) -> bytes:
        return array("I", self._tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


@cache
def text_encoder(path: str, pattern: str) -> TextEncoder | WholeEncoder:
    model = bpe_model(path, pattern)
    return TextEncoder(model, _LATIN_MATCH.findall, _CHUNK.findall) if pattern == SPLIT else WholeEncoder(model)


def _decoded(ids: pa.ListArray, table: tuple[bytes, ...]) -> pa.Array:
    """Bytes of each list of ids, joined over the whole list before anything reads them as characters."""
    values, offsets = ids.flatten().to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
    offsets = offsets - offsets[0]
    spans = zip(offsets[:-1], offsets[1:], strict=True)
    return pa.array([b"".join([table[i] for i in values[a:b].tolist()]) for a, b in spans], pa.binary())


def encode(
    docs: DataFrame,
    path: str,
    pattern: str,
    text_column: str = "text",
    decoded: bool = False,
    offsets: bool = False,
) -> DataFrame:
    """``row`` with ``ids``, and with ``decoded`` also the bytes that these ids decode to.

    ``offsets`` adds ``byte_offsets`` and ``char_offsets``: where each token begins, and the text's end last.
    ``path`` must name the rank file on every executor.
    """
    source = carried(docs, content=text_or_empty(text_column))
    fields = [source.schema["row"], T.StructField("ids", T.ArrayType(T.IntegerType(), False))]
    if decoded:
        fields.append(T.StructField("decoded", T.BinaryType()))
    if offsets:
        fields += [T.StructField(name, T.ArrayType(T.IntegerType(), False)) for name in ("byte_offsets", "char_offsets")]
    schema = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(path, pattern)
        for batch in batches:
            for part in slices(batch, "content"):
                ids = id_lists([encoder.encode(text) for text in part.column("content").to_pylist()])
                columns = [part.column("row"), ids]
                if decoded:
                    columns.append(_decoded(ids, token_bytes(path)))
                if offsets:
                    spans = [token_spans(np.array(own, np.int64), path) for own in ids.to_pylist()]
                    columns += [pa.array(kind, pa.list_(pa.int32())) for kind in zip(*spans, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return source.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds ``decoded``: the bytes of ``ids``."""
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())])
    at = encoded.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, _decoded(batch.column(at), table)], schema.names)

    return encoded.mapInArrow(run, schema)


def token_spans(ids: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets and character offsets where each token begins, with the ends last.

    A character belongs to the token with its first byte, so a token that holds
    only continuation bytes spans no character.
    """
    table = token_bytes(path)
    pieces = [table[i] for i in ids]
    byte_offsets = np.cumsum([0, *map(len, pieces)])
    first_bytes = (np.frombuffer(b"".join(pieces), np.uint8) & 0xC0) != 0x80
    return byte_offsets, np.r_[0, np.cumsum(first_bytes)][byte_offsets]
