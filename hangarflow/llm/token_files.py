"""Token ids in files of directly addressable codes.

Ids are split into chunks of LEVEL_BITS bits, lowest first. Level 0 holds the
first chunk of every id, level 1 the second chunk of the ids that have one, and so
on. A continuation bitmap per level says which ids go on; a rank directory holds
the number of set bits before every RANK_BITS-th bit, so the place of an id in the
next level is one directory entry plus the set bits of one short run: any token is
read without decoding its block.

A file set is a Parquet folder of segments. Documents are range-partitioned and
sorted by identifier, each task encodes its range and cuts it into segments of
about SEGMENT_TOKENS ids (a document is never cut). Segments count their tokens
from the start of their part; the totals of the parts, one row per written part,
give every token its global address when the files are read.

Defined cases: null text is empty; every document ends with the end id, so an
empty one has one token. Null identifiers come first, equal ones are ordered by
text. Extra columns are not stored. An empty table gives an empty file set.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hangarflow.llm.chunked import LATIN_WHITE, TextEncoder, latin_class, slices
from hangarflow.llm.texts import text_or_empty

LEVEL_BITS = 8
RANK_BITS = 512
SEGMENT_TOKENS = 1 << 20
# Token addresses are looked up through pages of this many tokens.
PAGE_TOKENS = 1 << 16
# Pieces in each generation of a worker's table; one worker a task leaves room for many.
REMEMBERED_PIECES = 700_000

SEGMENT_SCHEMA = (
    "part int, segment int, first long, n_tokens long, doc_ids array<long>, doc_ends array<long>, "
    "levels array<binary>, bitmaps array<binary>, ranks array<binary>"
)

_L, _N, _W = latin_class("L"), latin_class("N"), LATIN_WHITE
# The split of the word tokenizer over Latin characters, with the classes spelled out.
_LATIN_MATCH = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_W}{_L}{_N}]+")
_CHUNK = re.compile("[^\t-\r ]+")


@cache
def text_encoder(path: str) -> TextEncoder:
    """Encoder of a lower-casing word tokenizer; no match of its split holds white space."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
    return TextEncoder(tokenizer, _LATIN_MATCH.findall, _CHUNK.findall, str.lower, REMEMBERED_PIECES)


# ---------------------------------------------------------------------------
# The code
# ---------------------------------------------------------------------------
def pack(ids: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """Levels, continuation bitmaps and rank directories of unsigned ids."""
    levels, bitmaps, ranks = [], [], []
    rest = np.asarray(ids, np.uint32)
    while True:
        levels.append((rest & ((1 << LEVEL_BITS) - 1)).astype(np.uint8).tobytes())
        rest = rest >> LEVEL_BITS
        goes_on = rest > 0
        bits = np.packbits(goes_on, bitorder="little")
        per_run = np.add.reduceat(goes_on, np.arange(0, len(goes_on), RANK_BITS), dtype=np.uint32) if len(rest) else []
        bitmaps.append(bits.tobytes())
        ranks.append(np.concatenate([[0], np.cumsum(per_run)])[:-1].astype("<u4").tobytes() if len(rest) else b"")
        rest = rest[goes_on]
        if not len(rest):
            return levels, bitmaps, ranks


def unpack(levels: list[bytes], bitmaps: list[bytes], count: int) -> np.ndarray:
    """All ids in order."""
    ids = np.zeros(count, np.uint32)
    alive = np.arange(count)
    for level, (chunks, bits) in enumerate(zip(levels, bitmaps, strict=True)):
        ids[alive] |= np.frombuffer(chunks, np.uint8).astype(np.uint32) << np.uint32(LEVEL_BITS * level)
        goes_on = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(alive), bitorder="little").astype(bool)
        alive = alive[goes_on]
    return ids


def at(levels: list[bytes], bitmaps: list[bytes], ranks: list[bytes], positions: np.ndarray) -> np.ndarray:
    """Ids at some positions, by rank; nothing else of the segment is decoded."""
    places = np.asarray(positions, np.int64)
    ids = np.zeros(len(places), np.uint32)
    alive = np.arange(len(places))
    run_bytes = RANK_BITS // 8
    for level, chunks in enumerate(levels):
        ids[alive] |= np.frombuffer(chunks, np.uint8)[places].astype(np.uint32) << np.uint32(LEVEL_BITS * level)
        bits = np.frombuffer(bitmaps[level], np.uint8)
        goes_on = (bits[places >> 3] >> (places & 7).astype(np.uint8)) & 1 == 1
        alive, places = alive[goes_on], places[goes_on]
        if not len(alive):
            break
        runs = places // RANK_BITS
        directory = np.frombuffer(ranks[level], "<u4")[runs].astype(np.int64)
        padded = np.r_[bits, np.zeros(run_bytes, np.uint8)]
        window = padded[runs[:, None] * run_bytes + np.arange(run_bytes)]
        inside = np.unpackbits(window, axis=1, bitorder="little")
        before = np.arange(RANK_BITS) < (places % RANK_BITS)[:, None]
        places = directory + (inside & before).sum(axis=1, dtype=np.int64)
    return ids


# ---------------------------------------------------------------------------
# Files
# ---------------------------------------------------------------------------
def write(
    docs: DataFrame,
    folder: str,
    tokenizer_path: str,
    end_id: int,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> None:
    """Encode every document and write the segments below ``folder``."""
    ordered = (
        docs.select(F.col(id_column).cast("long").alias("doc_id"), text_or_empty(text_column).alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    end = np.array([end_id], "<u4").tobytes()

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(tokenizer_path)
        part = TaskContext.get().partitionId()
        held: list[bytes] = []
        doc_ids: list[int | None] = []
        tokens = first = segment = 0
        for batch in batches:
            for piece in slices(batch, "text"):
                for doc_id, text in zip(piece.column("doc_id").to_pylist(), piece.column("text").to_pylist(), strict=True):
                    ids = encoder.encode(text) + end
                    held.append(ids)
                    doc_ids.append(doc_id)
                    tokens += len(ids) // 4
                    if tokens >= SEGMENT_TOKENS:
                        yield _segment(part, segment, first, doc_ids, held)
                        first, segment, tokens = first + tokens, segment + 1, 0
                        held, doc_ids = [], []
        if held:
            yield _segment(part, segment, first, doc_ids, held)

    ordered.mapInArrow(segments, SEGMENT_SCHEMA).write.option("compression", "zstd").parquet(folder)


def _segment(part: int, segment: int, first: int, doc_ids: list, held: list[bytes]) -> pa.RecordBatch:
    ids = np.frombuffer(b"".join(held), "<u4")
    ends = np.cumsum([len(one) // 4 for one in held])
    levels, bitmaps, ranks = pack(ids)
    many = pa.list_(pa.binary())
    columns = [
        pa.array([part], pa.int32()),
        pa.array([segment], pa.int32()),
        pa.array([first], pa.int64()),
        pa.array([len(ids)], pa.int64()),
        pa.array([doc_ids], pa.list_(pa.int64())),
        pa.array([ends.tolist()], pa.list_(pa.int64())),
        *[pa.array([one], many) for one in (levels, bitmaps, ranks)],
    ]
    names = ["part", "segment", "first", "n_tokens", "doc_ids", "doc_ends", "levels", "bitmaps", "ranks"]
    return pa.RecordBatch.from_arrays(columns, names)


def read_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Segments with ``start``: the global address of their first token."""
    stored = spark.read.schema(SEGMENT_SCHEMA).parquet(folder)
    parts = stored.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("part", F.coalesce(F.sum("part_tokens").over(before), F.lit(0)).alias("base"))
    # One row per written part, so this is as small as the list of files.
    return stored.join(F.broadcast(bases), "part").withColumn("start", F.col("base") + F.col("first")).drop("base")


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start and ids (packed little-endian unsigned 32-bit integers) of every document."""
    segments = read_segments(spark, folder).select("start", "n_tokens", "doc_ids", "doc_ends", "levels", "bitmaps")

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at_row in range(batch.num_rows):
                row = batch.slice(at_row, 1).to_pylist()[0]
                packed = unpack(row["levels"], row["bitmaps"], row["n_tokens"]).astype("<u4").tobytes()
                ends = np.array(row["doc_ends"], np.int64)
                starts = np.r_[0, ends[:-1]]
                ids = [packed[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(row["start"] + starts), pa.array(ids, pa.binary())],
                    ["doc_id", "start", "ids"],
                )

    return segments.mapInArrow(documents, "doc_id long, start long, ids binary")


def read_tokens(spark: SparkSession, folder: str, positions: DataFrame) -> DataFrame:
    """``token_id`` of each global address in ``positions.position``; unknown addresses are left out."""
    segments = read_segments(spark, folder).select("start", "n_tokens", "levels", "bitmaps", "ranks")
    pages = F.sequence(F.floor(F.col("start") / PAGE_TOKENS), F.floor((F.col("start") + F.col("n_tokens") - 1) / PAGE_TOKENS))
    spans = segments.select("start", "n_tokens", F.explode(pages).alias("page"))
    asked = positions.select("position", F.floor(F.col("position") / PAGE_TOKENS).alias("page"))
    inside = (F.col("position") >= F.col("start")) & (F.col("position") < F.col("start") + F.col("n_tokens"))
    located = asked.join(spans, "page").where(inside).select("start", "position")
    # Addresses of one segment come in lists of bounded length next to one copy of the segment.
    lists = located.groupBy("start", F.floor(F.col("position") / PAGE_TOKENS)).agg(F.collect_list("position").alias("positions"))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at_row in range(batch.num_rows):
                row = batch.slice(at_row, 1).to_pylist()[0]
                asked_for = np.array(row["positions"], np.int64)
                ids = at(row["levels"], row["bitmaps"], row["ranks"], asked_for - row["start"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(asked_for), pa.array(ids.astype(np.int64))], ["position", "token_id"]
                )

    return lists.select("start", "positions").join(segments, "start").mapInArrow(look_up, "position long, token_id long")
