"""Counting hashed keys over a whole corpus in packed form.

A block is a bounded run of documents. It knows its distinct keys (sorted 64-bit
hashes) and how often it holds each. ``entries`` cuts these lists by the leading
bits of the key into buckets; ``merged`` adds up each bucket over all blocks and
answers every block with the global counts in the block's own order. A key that a
third of all documents hold is one entry per block and bucket, and a bucket holds
about BUCKET_KEYS keys because the number of buckets follows the corpus.

Inside a bucket a key is known by its next ``width`` bits, so two keys of a bucket
of n keys are confused with probability n / 2 ** width, at any corpus size.
Lists are stored as differences in byte planes, which the shuffle compresses well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BUCKET_KEYS = 1 << 21
ENTRY_SCHEMA = "bucket long, block long, n long, keys binary, counts binary"
REPLY_SCHEMA = "bucket long, block long, n long, counts binary"
# Replies about a whole bucket go to these block numbers below zero.
SUMMARY_BLOCKS = 1_024
# Bucket numbers of different kinds of keys are this far apart.
KIND = 1 << 48


def bucket_bits(keys: int) -> int:
    """Leading bits that cut ``keys`` keys into buckets of about BUCKET_KEYS."""
    return max(0, int(np.ceil(np.log2(max(1, keys) / BUCKET_KEYS))))


def planes(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of 64-bit values, plane by plane."""
    return np.ascontiguousarray(np.asarray(values, "<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def from_planes(packed: bytes, width: int) -> np.ndarray:
    rows = np.frombuffer(packed, np.uint8).reshape(width, -1)
    wide = np.zeros((rows.shape[1], 8), np.uint8)
    wide[:, :width] = rows.T
    return wide.view("<u8").ravel()


def pack(values: np.ndarray) -> bytes:
    """Values in as many byte planes as the largest needs, the number of planes first."""
    values = np.asarray(values)
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    return bytes([width]) + planes(values, width)


def unpack(packed: bytes) -> np.ndarray:
    return from_planes(packed[1:], packed[0])


def entries(block: int, kind: int, keys: np.ndarray, counts: np.ndarray, bits: int, width: int) -> pa.RecordBatch:
    """Entry rows of one block; ``keys`` are sorted and distinct."""
    many = 1 << bits
    # A shift by 64 bits is undefined for the processor, so one bucket is a case of its own.
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    inside = (keys << np.uint64(bits)) >> np.uint64(64 - width)
    cuts = np.searchsorted(bucket, np.arange(many + 1))
    used = np.flatnonzero(np.diff(cuts))
    packed_keys, packed_counts, sizes = [], [], []
    for b in used:
        part = slice(cuts[b], cuts[b + 1])
        packed_keys.append(planes(np.diff(inside[part], prepend=np.uint64(0)), width // 8))
        packed_counts.append(pack(counts[part]))
        sizes.append(cuts[b + 1] - cuts[b])
    return pa.RecordBatch.from_arrays(
        [
            pa.array(used + kind * KIND, pa.int64()),
            pa.array(np.full(len(used), block), pa.int64()),
            pa.array(sizes, pa.int64()),
            pa.array(packed_keys, pa.binary()),
            pa.array(packed_counts, pa.binary()),
        ],
        ["bucket", "block", "n", "keys", "counts"],
    )


def merged(rows: DataFrame, widths: dict[int, int]) -> DataFrame:
    """Replies to every entry, plus one summary reply per bucket: the number of keys counted at least once."""

    def merge(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        width = widths[bucket // KIND] // 8
        keys = [np.cumsum(from_planes(k, width), dtype=np.uint64) for k in group.column("keys").to_pylist()]
        counts = [unpack(c) for c in group.column("counts").to_pylist()]
        _, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(place, weights=np.concatenate(counts).astype(np.float64)).astype(np.uint64)
        ends = np.cumsum([len(k) for k in keys])[:-1]
        replies = [pack(total[part]) for part in np.split(place, ends)]
        seen = np.array([np.count_nonzero(total)], np.uint64)
        blocks = [*group.column("block").to_pylist(), -1 - bucket % SUMMARY_BLOCKS]
        return pa.table(
            {
                "bucket": pa.array([bucket] * len(blocks), pa.int64()),
                "block": pa.array(blocks, pa.int64()),
                "n": pa.array([*(len(k) for k in keys), 1], pa.int64()),
                "counts": pa.array([*replies, pack(seen)], pa.binary()),
            }
        )

    return rows.groupBy("bucket").applyInArrow(merge, REPLY_SCHEMA)


def replies_in_order(replies: list[dict], kind: int) -> np.ndarray:
    """Global counts of a block's keys of one kind, in the order of its sorted keys."""
    own = sorted((r["bucket"], r["counts"]) for r in replies if r["bucket"] // KIND == kind)
    return np.concatenate([unpack(c) for _, c in own]).astype(np.int64) if own else np.zeros(0, np.int64)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One row at a time, so that only one block is unpacked at once."""
    for batch in batches:
        for at in range(batch.num_rows):
            yield batch.slice(at, 1).to_pylist()[0]
