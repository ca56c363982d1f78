"""Product-quantised vector codes, searched exactly in integers by Walsh-Hadamard transforms.

Components become integers ``floor(scale * x)``; vectors are cut into ``parts``
equal consecutive parts, each with a codebook of ``entries`` entries that a few
rounds of Lloyd's iteration fit. The nearest entry of a part is found without
floating point: parts and entries are zero-padded to a power of two m and sent
through the integer Walsh-Hadamard transform H (rows in sequency order). Since
H Hᵀ = m I, the squared differences of transformed coefficients sum to exactly m
times the squared Euclidean distance. They are accumulated coefficient by
coefficient, low sequency first, where most of the energy of a smooth part lies;
an entry whose partial sum already exceeds the full distance of the provisional
best (the entry nearest in the first coefficient) is dropped from the candidates.
Dropping is exact, ties go to the lower index.

Spark does the work: the integer vectors are stored once; each round ships
the codebook with the tasks (parts × entries × part length integers, bounded by the parameters,
not by the rows), assigns parts in Arrow batches and sums each (part, entry,
position) inside the batch, so the shuffle carries at most that many rows per
batch and a hot entry is already summed. Only these sums reach the driver.

Defined cases: rows whose vector is null or holds a null or a non-finite
component are left out; every other row is coded, however large its components.
Integers travel as doubles, which hold them exactly. Rows with components up to
``NARROW`` are searched in 64 bits, entries too far to be their nearest left
aside; larger ones are searched in Python integers, and large sums travel in
32-bit limbs. An ``error`` beyond 64 bits is null. Vectors shorter than the
longest kept one are zero-padded; the part length is ceil(longest / parts), at
least 1. The initial codebook is that of the ``entries`` rows of smallest
identifier (null last; equal identifiers by vector); with fewer rows the codebook
is shorter. Repeated rows are coded alike, each returned. Extra columns travel
in ``row``; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hangarflow.session import stored

LIMIT = math.inf  # components of this absolute value are left out: the infinite ones
NARROW = 1 << 20  # integers up to this are searched in 64 bits beside any larger ones
_SAFE = 1 << 40  # integers below this are kept, and summed over a batch, in 64 bits
_LIMB = 32
_WIDE_ROWS = 512  # rows searched in Python integers at a time


def _walsh(m: int) -> np.ndarray:
    """Hadamard matrix of order m (Sylvester), rows sorted by their number of sign changes."""
    h = np.ones((1, 1), dtype=np.int64)
    while h.shape[0] < m:
        h = np.block([[h, h], [h, -h]])
    changes = (np.diff(h, axis=1) != 0).sum(axis=1)
    return h[np.argsort(changes, kind="stable")]


def _padded(a: np.ndarray, m: int) -> np.ndarray:
    return np.pad(a, [(0, 0)] * (a.ndim - 1) + [(0, m - a.shape[-1])])


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of each part's nearest entry (ties to the lower index).

    ``parts`` is (rows, p) and ``book`` (entries, p), both integer.
    """
    rows, entries, p = parts.shape[0], book.shape[0], parts.shape[1]
    if rows == 0 or entries == 0:
        return np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    row_size, entry_size = (np.abs(a).max(axis=1, initial=0) for a in (parts, book))
    if _fits(p, int(row_size.max()) + int(entry_size.max())):
        return _nearest(parts.astype(np.int64), book.astype(np.int64))
    code, dist = np.empty(rows, np.int64), np.empty(rows, dtype=object)
    # No two narrow vectors are farther apart than 2 sqrt(p) NARROW, so an entry beyond this reach is never the nearest.
    reach = NARROW * (2 * (math.isqrt(p) + 1) + 1)
    small = (row_size <= NARROW).astype(bool)
    if not _fits(p, NARROW + reach) or not (entry_size <= NARROW).any():
        small[:] = False
    near = np.nonzero((entry_size <= reach).astype(bool))[0]
    if small.any():
        found, dist[small] = _nearest(parts[small].astype(np.int64), book[near].astype(np.int64))
        code[small] = near[found]
    wide = np.nonzero(~small)[0]
    for start in range(0, len(wide), _WIDE_ROWS):
        at = wide[start : start + _WIDE_ROWS]
        code[at], dist[at] = _nearest(parts[at].astype(object), book.astype(object))
    return code, dist


def _fits(p: int, bound: int) -> bool:
    """Whether transformed differences of at most ``bound`` per component stay in 64 bits."""
    m = 1 << max(p - 1, 0).bit_length()
    return m**3 * bound**2 < 2**62


def _nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``nearest`` in the integers of the arrays' type: 64-bit, or Python's as objects."""
    rows, entries, kind = parts.shape[0], book.shape[0], parts.dtype
    m = 1 << max(parts.shape[1] - 1, 0).bit_length()
    h = _walsh(m)
    tp = _padded(parts, m) @ h.T.astype(kind)
    tb = _padded(book, m) @ h.T.astype(kind)
    # Provisional best: nearest in the first (constant) coefficient, its full distance.
    guess = np.abs(tp[:, :1] - tb[None, :, 0]).argmin(axis=1)
    ceiling = ((tp - tb[guess]) ** 2).sum(axis=1)
    row = np.repeat(np.arange(rows), entries)
    entry = np.tile(np.arange(entries), rows)
    partial = np.zeros(row.shape[0], dtype=kind)
    for j in range(m):  # sequency order
        partial = partial + (tp[row, j] - tb[entry, j]) ** 2
        alive = (partial < ceiling[row]) | ((partial == ceiling[row]) & (entry <= guess[row]))
        row, entry, partial = row[alive], entry[alive], partial[alive]
    order = np.lexsort((entry, partial, row))
    first = np.ones(order.shape[0], bool)
    first[1:] = row[order][1:] != row[order][:-1]
    chosen = order[first]
    code = np.empty(rows, np.int64)
    dist = np.empty(rows, dtype=kind)
    code[row[chosen]] = entry[chosen]
    dist[row[chosen]] = partial[chosen] // m
    return code, dist


def _assign(ints: np.ndarray, books: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows, parts) and distances (rows, parts) of integer vectors of length parts * p."""
    n_parts = books.shape[0]
    codes = np.zeros((ints.shape[0], n_parts), np.int64)
    dists = []
    for t in range(n_parts):
        codes[:, t], dist = nearest(ints[:, t * p : (t + 1) * p], books[t])
        dists.append(dist)
    return codes, np.stack(dists, axis=1) if dists else np.zeros((ints.shape[0], 0), np.int64)


def _integers(values: np.ndarray) -> np.ndarray:
    """Whole numbers, as 64-bit integers when all are small, else as Python integers."""
    if not values.size or (np.abs(values) < _SAFE).all():
        return values.astype(np.int64)
    return np.frompyfunc(int, 1, 1)(values)


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    values = batch.column("_ints").flatten().to_numpy(zero_copy_only=False)
    return _integers(values.reshape(-1, width))


def _limbs(totals: np.ndarray):
    """(limb, 64-bit values) whose sum over limbs of value << (32 * limb) is ``totals``; small totals are one limb."""
    limb = 0
    while (np.abs(totals) >= _SAFE).any():
        yield limb, (totals & ((1 << _LIMB) - 1)).astype(np.int64)
        totals, limb = totals >> _LIMB, limb + 1
    yield limb, totals.astype(np.int64)


SUMS = "part int, entry int, pos int, limb int, total long, n long"


def _sums(books: np.ndarray, p: int):
    n_parts, _, _ = books.shape

    def run(batches):
        for batch in batches:
            ints = _matrix(batch, n_parts * p)
            if ints.shape[0] == 0:
                continue
            codes, _ = _assign(ints, books, p)
            for t in range(n_parts):
                used, inverse, counts = np.unique(codes[:, t], return_inverse=True, return_counts=True)
                totals = np.zeros((used.shape[0], p), ints.dtype)
                np.add.at(totals, inverse, ints[:, t * p : (t + 1) * p])
                for limb, values in _limbs(totals.reshape(-1)):
                    yield pa.RecordBatch.from_pydict(
                        {
                            "part": pa.array(np.full(used.shape[0] * p, t), pa.int32()),
                            "entry": pa.array(np.repeat(used, p), pa.int32()),
                            "pos": pa.array(np.tile(np.arange(p), used.shape[0]), pa.int32()),
                            "limb": pa.array(np.full(used.shape[0] * p, limb), pa.int32()),
                            "total": pa.array(values, pa.int64()),
                            "n": pa.array(np.repeat(counts, p) * (limb == 0), pa.int64()),
                        }
                    )

    return run


def _errors(dists: np.ndarray) -> pa.Array:
    """Each row's sum of distances; null where 64 bits do not hold it."""
    if dists.dtype == object or dists.max(initial=0) >= 2**62 // max(1, dists.shape[1]):
        return pa.array([e if e < 2**63 else None for e in map(int, dists.astype(object).sum(axis=1))], pa.int64())
    return pa.array(dists.sum(axis=1), pa.int64())


def _codes(books: np.ndarray, p: int, keep: list[str]):
    n_parts = books.shape[0]

    def run(batches):
        for batch in batches:
            ints = _matrix(batch, n_parts * p)
            codes, dists = _assign(ints, books, p)
            yield pa.RecordBatch.from_arrays(
                [batch.column(name) for name in keep]
                + [
                    pa.ListArray.from_arrays(
                        pa.array(np.arange(0, codes.size + 1, n_parts), pa.int32()),
                        pa.array(codes.reshape(-1), pa.int32()),
                    ),
                    _errors(dists),
                ],
                names=[*keep, "codes", "error"],
            )

    return run


@dataclass
class Coded:
    rows: DataFrame  # row, codes array<int>, code string, error long
    codebooks: np.ndarray  # (parts, entries, part length) integers
    part_length: int

    def digest(self) -> str:
        """SHA-256 of all entries' components by part, entry, position, ``,``-joined."""
        return hashlib.sha256(",".join(str(int(v)) for v in self.codebooks.reshape(-1)).encode()).hexdigest()


def integer_vectors(vectors: DataFrame, id_column: str, vector_column: str, scale: int) -> DataFrame:
    """``row``, ``_id`` and ``_ints`` (floor(scale * x) as doubles, beyond 2^53 whole by themselves) of the rows that take part."""
    vector = F.col(vector_column).cast("array<double>")
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LIMIT))
    taken = vectors.where(F.coalesce(usable, F.lit(False)))
    return taken.select(
        F.struct(*[F.col(f"`{c}`") for c in vectors.columns]).alias("row"),
        F.col(id_column).alias("_id"),
        F.transform(
            vector,
            lambda x: F.when(F.abs(x * scale) < float(1 << 53), F.floor(x * scale).cast("double")).otherwise(x * scale),
        ).alias("_ints"),
    )


def compress(
    vectors: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    parts: int = 16,
    entries: int = 64,
    rounds: int = 2,
    scale: int = 256,
) -> Coded:
    """Fit the codebooks on all rows that take part and code every one of them."""
    spark = vectors.sparkSession
    ints = stored(integer_vectors(vectors, id_column, vector_column, scale), "vector-codes-ints")
    longest = ints.agg(F.max(F.size("_ints"))).first()[0] or 0
    p = max(1, -(-longest // parts))
    width = parts * p
    padded = ints.select(
        "row", "_id", F.concat("_ints", F.array_repeat(F.lit(0.0), width - F.size("_ints"))).alias("_ints")
    )
    first = ints.orderBy(F.col("_id").asc_nulls_last(), "_ints").limit(entries).select("_ints").collect()
    start = np.array([r[0] + [0.0] * (width - len(r[0])) for r in first], np.float64).reshape(len(first), width)
    books = _integers(np.ascontiguousarray(start.reshape(len(first), parts, p).transpose(1, 0, 2)))
    for _ in range(rounds):
        sums = (
            padded.select("_ints")
            .mapInArrow(_sums(books, p), SUMS)
            .groupBy("part", "entry", "pos", "limb")
            .agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
            .collect()
        )
        totals, counts = Counter(), Counter()
        for r in sums:
            at = r["part"], r["entry"], r["pos"]
            totals[at] += r["total"] << (_LIMB * r["limb"])
            counts[at] += r["n"]
        updated = books.astype(object)
        for at, n in counts.items():
            updated[at] = totals[at] // n  # Python floors exactly
        books = _integers(updated)
    schema = T.StructType(
        [padded.schema["row"], T.StructField("codes", T.ArrayType(T.IntegerType())), T.StructField("error", T.LongType())]
    )
    coded = padded.select("row", "_ints").mapInArrow(_codes(books, p, ["row"]), schema)
    code = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    return Coded(coded.select("row", "codes", code.alias("code"), "error"), books, p)
