"""Exact k nearest chunks with the chunks streamed past the queries; nothing is copied per opposite block on disk.

Both sides are packed: one row is a block of vectors with their ids, the chunks of
one row having one manual type (or one sub-ball). The packed chunks are stored
once. A nested-loop join whose inner side is one partition of queries and whose
outer side is the stored chunks then makes tasks of about TASK_QUERIES queries;
each reads the chunks row by row and keeps only the k best so far of every query
and type. A query block travels to Python once, with the first row of chunks.

Written to disk: the queries once (a shuffle), the chunks once, and at most k hits
per query, type and share of the chunks. There is one share unless the queries are
too few to keep the cores busy; shares times query partitions stay within twice
the cores or the number of query partitions. Reads and sums still grow with queries
times chunks.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hangarflow.operators.vectors import _CELLS, _exact_distances
from hangarflow.session import stored

# Queries of one task, and vector components of one packed row of queries and of chunks.
TASK_QUERIES = 2_048
QUERY_COMPONENTS = 1 << 20
CHUNK_COMPONENTS = 1 << 18
# Packed rows are large: small row groups, checked after every row.
_FILES = {"parquet.block.size": str(1 << 24), "parquet.page.size.row.check.min": "1"}

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _element(vectors: DataFrame) -> str:
    """The number type in which the vectors of a table are packed."""
    return "<f4" if isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType) else "<f8"


def _packed_bytes(lists: pa.Array, element: str) -> bytes:
    lengths = pc.min_max(pc.list_value_length(lists)).as_py()
    if lengths["min"] != lengths["max"]:
        raise ValueError(f"embeddings of {lengths['min']} and of {lengths['max']} components in one table")
    return lists.flatten().to_numpy(zero_copy_only=False).astype(element).tobytes()


def _packer(lists: list[str], by: str | None, element: str, rows: int, components: int, runs: bool):
    """Rows of equal ``by`` leave as blocks of bounded size; ``runs`` says that equal ones follow each other."""

    def block(key, held):
        table = pa.Table.from_batches(held).combine_chunks()
        columns = [x.chunk(0) for x in (table.column(name) for name in [*lists, "embedding"])]
        ends = pa.array([0, table.num_rows], pa.int32())
        packed = [pa.ListArray.from_arrays(ends, column) for column in columns[:-1]]
        packed.append(pa.array([_packed_bytes(columns[-1], element)], pa.binary()))
        names = [*lists, "vectors"]
        if by:
            packed.append(pa.array([key], table.schema.field(by).type))
            names.append(by)
        return pa.RecordBatch.from_arrays(packed, names=names)

    def run(batches):
        held = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            most = max(1, min(rows, components // max(1, len(batch.column("embedding")[0]))))
            if by:
                coded = batch.column(by).dictionary_encode()
                codes = coded.indices.to_numpy(zero_copy_only=False)
                parts = [(key, batch.take(pa.array(np.flatnonzero(codes == i)))) for i, key in enumerate(coded.dictionary.to_pylist())]
            else:
                parts = [(None, batch)]
            for key, part in parts:
                if runs:
                    for other in [x for x in held if x != key]:
                        yield block(other, held.pop(other))
                start = 0
                while start < part.num_rows:
                    own = held.setdefault(key, [])
                    piece = part.slice(start, most - sum(x.num_rows for x in own))
                    start += piece.num_rows
                    own.append(piece)
                    if sum(x.num_rows for x in own) >= most:
                        yield block(key, held.pop(key))
        for key, own in held.items():
            yield block(key, own)

    return run


def pack(rows: DataFrame, lists: list[str], by: str | None, block: int, components: int, runs: bool = False) -> DataFrame:
    """Blocks of at most ``block`` rows, made within the partitions: arrays of ``lists``, ``vectors`` and ``by``."""
    fields = [T.StructField(name, T.ArrayType(rows.schema[name].dataType)) for name in lists]
    fields += [T.StructField("vectors", T.BinaryType()), *([rows.schema[by]] if by else [])]
    packer = _packer(lists, by, _element(rows), block, components, runs)
    return rows.select(*lists, *([by] if by else []), "embedding").mapInArrow(packer, T.StructType(fields))


def stored_chunks(chunks: DataFrame, by: str, block: int, label: str, runs: bool = False) -> DataFrame:
    """Packed chunks, written once: one row is a block of equal ``by``."""
    packed = pack(chunks, ["chunk_id", "ata04"], by, block, CHUNK_COMPONENTS, runs)
    return stored(packed, label, **_FILES).withColumn("chunk_element", F.lit(_element(chunks)))


class Best:
    """The k nearest chunks so far of every query of a block, per manual type."""

    def __init__(self, ids: pa.Array, vectors: np.ndarray, k: int, kth: list | None = None):
        self.ids, self.vectors, self.k, self.kth = ids, vectors, k, [dict(x or []) for x in kth or []]
        self.norms = np.einsum("ij,ij->i", vectors, vectors)
        self.scaled = np.hstack([-2.0 * vectors, np.ones((len(vectors), 1))])
        self.limits, self.found, self.waiting = {}, {}, {}
        self.first = None  # ball search: the balls of round one

    def limit(self, kind) -> np.ndarray:
        """The k-th distance so far of every query, or the one it came with; infinite while there are fewer than k."""
        if kind not in self.limits:
            # Another pass may have summed the same distance in another order.
            given = [x.get(kind, np.inf) * (1 + 1e-9) for x in self.kth]
            self.limits[kind] = np.array(given) if given else np.full(len(self.vectors), np.inf)
        return self.limits[kind]

    def add(self, kind, rows: np.ndarray, vectors: np.ndarray, ids: pa.Array, codes: pa.Array) -> None:
        """Lets some queries meet some chunks of one type.

        A matrix product finds the candidates; the distances of the candidates are
        then summed from differences, so equal vectors get equal distances. The
        margin keeps every chunk that rounding could have pushed over the limit.
        """
        limit, norms = self.limit(kind), np.einsum("ij,ij->i", vectors, vectors)
        chunks = np.hstack([vectors, norms[:, None]]).T
        largest = norms.max(where=np.isfinite(norms), initial=0.0)
        height = max(1, _CELLS // len(vectors))
        for start in range(0, len(rows), height):
            some = rows[start : start + height]
            bound, own = limit[some], self.norms[some]
            product = self.scaled[some] @ chunks  # |c|² - 2qc
            unbounded = np.flatnonzero(np.isinf(bound))
            if len(unbounded) and len(vectors) > self.k:
                kth = np.partition(product[unbounded], self.k - 1, axis=1)[:, self.k - 1]
                bound[unbounded] = np.where(np.isnan(kth), np.inf, kth + own[unbounded])
            margin = 1e-9 * (1.0 + own + largest)
            row, col = np.divmod(np.flatnonzero(product <= (bound - own + margin)[:, None]), len(vectors))
            if not len(row):
                continue
            distance = _exact_distances(self.vectors, vectors, some[row], col)
            near = distance <= limit[some[row]]
            row, col, distance = some[row[near]], pa.array(col[near]), distance[near]
            held = self.waiting.setdefault(kind, [])
            held.append(pa.table({"row": row, "distance": distance, "chunk_id": ids.take(col), "ata04": codes.take(col)}))
            if sum(x.num_rows for x in held) >= max(self.k * len(self.vectors), _CELLS >> 8):
                self.settle(kind)

    def settle(self, kind) -> None:
        """Keeps the k best of what is waiting and what was kept; ties go to the lower chunk id."""
        if not self.waiting.get(kind):
            return
        table = pa.concat_tables([*self.found.get(kind, []), *self.waiting.pop(kind)]).combine_chunks()
        keys = [(name, "ascending") for name in ("row", "distance", "chunk_id")]
        order = pc.sort_indices(table, sort_keys=keys, null_placement="at_start").to_numpy()
        row = table.column("row").to_numpy()[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        last = place == self.k - 1
        limit, kth = self.limit(kind), table.column("distance").to_numpy()[order[last]]
        limit[row[last]] = np.minimum(limit[row[last]], kth)
        self.found[kind] = [table.take(pa.array(order[place < self.k]))]

    def hits(self):
        for kind in sorted({*self.found, *self.waiting}):
            self.settle(kind)
            for batch in self.found[kind][0].combine_chunks().to_batches(max_chunksize=_CELLS >> 4):
                yield pa.RecordBatch.from_arrays(
                    [
                        self.ids.take(batch.column("row")),
                        pa.array([kind] * batch.num_rows, pa.string()),
                        batch.column("chunk_id"),
                        batch.column("ata04"),
                        batch.column("distance"),
                    ],
                    names=["query_id", "manual_type", "chunk_id", "ata04", "distance"],
                )


def _vectors(batch: pa.RecordBatch, column: str, element: str, at: int) -> np.ndarray:
    rows = len(batch.column("query_id" if column == "query_vectors" else "chunk_id")[at])
    flat = np.frombuffer(batch.column(column)[at].as_buffer(), element)
    return flat.reshape(rows, len(flat) // rows).astype(np.float64)


def chunk_block(batch: pa.RecordBatch, at: list[int]) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Vectors, ids and codes of some rows of packed chunks."""
    vectors = [_vectors(batch, "vectors", batch.column("chunk_element")[i].as_py(), i) for i in at]
    ids, codes = ([batch.column(name)[i].values for i in at] for name in ("chunk_id", "ata04"))
    return np.concatenate(vectors), pa.concat_arrays(ids), pa.concat_arrays(codes)


def _passing(meet: Callable, k: int):
    def run(batches):
        known = {}
        for batch in batches:
            numbers = batch.column("query_block").to_numpy()
            carried = np.flatnonzero(batch.column("query_vectors").is_valid().to_numpy(zero_copy_only=False))
            for i in carried:
                if numbers[i] not in known:
                    element = batch.column("query_element")[int(i)].as_py()
                    ids = batch.column("query_id")[int(i)].values
                    kth = batch.column("kth")[int(i)].as_py() if "kth" in batch.schema.names else None
                    known[numbers[i]] = Best(ids, _vectors(batch, "query_vectors", element, int(i)), k, kth)
            for number in np.unique(numbers):
                if number not in known:
                    raise RuntimeError("a block of queries came without its vectors")
                meet(known[number], batch, np.flatnonzero(numbers == number).tolist())
        for best in known.values():
            yield from best.hits()

    return run


def layout(queries: DataFrame) -> tuple[int, int]:
    """Partitions of the queries, and shares of the chunks that keep the cores busy when those are few."""
    parts = max(1, -(-queries.count() // TASK_QUERIES))
    return parts, -(-2 * queries.sparkSession.sparkContext.defaultParallelism // parts)


def passed(
    queries: DataFrame,
    chunks: DataFrame,
    meet: Callable,
    k: int,
    hit_schema: T.StructType,
    dealt_to: tuple[int, int],
    query_block: int = TASK_QUERIES,
) -> DataFrame:
    """Hits of all queries, every query block meeting every row of ``chunks`` (from ``stored_chunks``) in one task.

    ``meet(best, batch, rows)`` lets a query block (``Best``) meet the packed rows
    with these numbers. ``dealt_to`` comes from ``layout``; there is one task per
    partition of queries and share of chunks. At most k hits per query, type and
    share come out; the caller ranks them. Queries may bring ``kth``, a map of types
    to a distance that their k-th chunk does not exceed.
    """
    parts, shares = dealt_to
    lists = [x for x in ("query_id", "kth") if x in queries.columns]
    # Dealt out in turn, so that no value of any column gathers in one partition.
    asked = pack(queries.repartition(parts), lists, None, query_block, QUERY_COMPONENTS).select(
        F.monotonically_increasing_id().alias("query_block"),
        *lists,
        F.col("vectors").alias("query_vectors"),
        F.lit(_element(queries)).alias("query_element"),
    )
    # Row numbers start at 0 in each partition of the outer side, whose first row takes the query block along.
    number = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    outer = chunks.coalesce(shares).withColumn("first", number == 0)
    met = outer.hint("shuffle_replicate_nl").crossJoin(asked)
    carried = met.withColumn("query_vectors", F.when(F.col("first"), F.col("query_vectors"))).drop("first")
    return carried.mapInArrow(_passing(meet, k), hit_schema)


def _meet_blocks(best: Best, batch: pa.RecordBatch, rows: list[int]) -> None:
    """All queries of a block meet the chunk blocks, as many at a time as one matrix product holds."""
    kinds = batch.column("manual_type").to_pylist()
    lengths = pc.list_value_length(batch.column("chunk_id")).to_numpy()
    everyone = np.arange(len(best.vectors))
    for kind in {kinds[i]: None for i in rows}:
        run, count = [], 0
        for i in (x for x in rows if kinds[x] == kind):
            run.append(i)
            count += int(lengths[i])
            if count * len(everyone) >= _CELLS:
                best.add(kind, everyone, *chunk_block(batch, run))
                run, count = [], 0
        if run:
            best.add(kind, everyone, *chunk_block(batch, run))


def block_search(
    queries: DataFrame, chunks: DataFrame, k: int, query_block: int, chunk_block: int, hit_schema: T.StructType
) -> DataFrame:
    """Every query block meets every chunk block; up to k hits per query, type and share of the chunks."""
    blocks = stored_chunks(chunks, "manual_type", chunk_block, "chunk-blocks")
    asked = queries.select("query_id", "embedding")
    return passed(asked, blocks, _meet_blocks, k, hit_schema, layout(asked), query_block)
