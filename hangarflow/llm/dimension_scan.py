"""Approximate nearest neighbours by an adaptive scan of dimensions.

Largest inner product becomes smallest distance by one more dimension: with ``M``
the largest norm, ``x`` gets ``sqrt(M^2 - |x|^2)`` and a query gets 0. Vectors lie in
lists around centres (k-means on a bounded sample; every vector is assigned). Inside
a probed list vectors are rotated at random, and a query adds up squared differences
column block by column block. After ``d`` of ``D`` dimensions the partial distance
times D / d estimates the whole one; a candidate is abandoned when the hypothesis
that it lies within the query's threshold can be rejected: when the estimate exceeds
``(1 + SIGNIFICANCE / sqrt(d))^2`` times the squared threshold. The threshold starts as
the distance of the (k + 1)-th best vector of a broadcast sample, which bounds the
true one, and shrinks as candidates survive. Survivors are scored exactly on the
original vectors in double precision.

Equal vectors are one class that carries its k + 1 smallest identifiers: more of them
can never be asked for. So a vector that a third of all rows share is scanned once,
and a query repeated many times is searched once. Neighbouring lists share a shard of
about SHARD_ROWS vectors, where a query visits its lists nearest first and carries its
threshold from one to the next. Shards with larger lists are cut into blocks, and the
queries of a shard into parts.

Defined cases: vectors that are null, all zero, of another length than most, or hold
a null or non-finite component take no part, as query or as candidate. Repeated rows
of one identifier and vector count once. Ties go to the smaller identifier. With no
more than k candidates all are returned. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hangarflow.session import stored

SAMPLE_ROWS = 16_384
SAMPLE_VALUES = 4_000_000
THRESHOLD_ROWS = 2_048
MOST_LISTS = 4_096
CENTRE_STEPS = 8
LEAST_PROBES = 12
TARGET_RECALL = 0.96
CALIBRATION_ROWS = 512
SHARD_ROWS = 8_192
BLOCK_ROWS = 16_384
PART_QUERIES = 512
COLUMNS = 16
SIGNIFICANCE = 1.5


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """vec_id and vector of the rows that take part, the vector as an array of doubles."""
    cast = F.col(vector_column).cast("array<double>")
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    kept = vectors.select(F.col(id_column).alias("vec_id"), cast.alias("vector")).where(
        F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & sound & F.exists("vector", lambda x: x != 0)
    )
    lengths = kept.groupBy(F.size("vector").alias("length")).count()  # one row per length
    most = lengths.orderBy(F.desc("count"), "length").first()
    return kept.where(F.size("vector") == (most["length"] if most else 0))


def _classes(kept: DataFrame, k: int) -> DataFrame:
    """One row per distinct vector: class (smallest identifier), its first identifiers, and the vector."""
    # The identifiers of a vector shared by many rows are cut down inside salts first.
    salts = max(1, kept.count() // 100_000)
    first = F.slice(F.array_sort(F.collect_set("vec_id")), 1, k + 1).alias("ids")
    salted = kept.groupBy("vector", F.pmod(F.xxhash64("vec_id"), F.lit(salts)).alias("salt")).agg(first)
    merged = salted.groupBy("vector").agg(
        F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids")
    )
    return merged.select(F.col("ids")[0].alias("class"), "ids", "vector")


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _lifted(vectors: np.ndarray, most: float) -> np.ndarray:
    rest = np.maximum(most - np.einsum("ij,ij->i", vectors, vectors), 0)
    return np.c_[vectors, np.sqrt(rest)]


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0)


def _centres(sample: np.ndarray, lists: int) -> np.ndarray:
    random = np.random.default_rng(11)
    centres = sample[random.choice(len(sample), lists, replace=False)]
    for _ in range(CENTRE_STEPS):
        nearest = _squared(sample, centres).argmin(axis=1)
        counts = np.bincount(nearest, minlength=lists)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def _rotation(dimensions: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(5).normal(size=(dimensions, dimensions)))
    return q * np.sign(np.diag(r))


def column_blocks(vectors: np.ndarray) -> list[np.ndarray]:
    """The columns in blocks of COLUMNS, each block contiguous, in single precision: they only decide what to abandon."""
    return [
        np.ascontiguousarray(vectors[:, at : at + COLUMNS], dtype=np.float32)
        for at in range(0, vectors.shape[1], COLUMNS)
    ]


def scan(
    query: np.ndarray,
    candidates: list[np.ndarray],
    first: np.ndarray,
    places: np.ndarray,
    threshold: float,
    keep: int,
) -> np.ndarray:
    """The ``places`` of candidates that survive every block of columns, for one rotated query.

    ``first`` holds the squared distances over the first block and ``threshold`` is a squared
    distance. Candidates are visited in the order of ``places``, in slices of growing size;
    each slice can lower the threshold for the next.
    """
    dimensions = len(query)
    found, distances = [], np.zeros(0)
    begin, width = 0, 8 * keep
    while begin < len(places):
        alive = places[begin : begin + width]
        partial = first[alive]
        for number, block in enumerate(candidates):
            end = min((number + 1) * COLUMNS, dimensions)
            if number:
                difference = block[alive] - query[end - block.shape[1] : end]
                partial = partial + np.einsum("ij,ij->i", difference, difference)
            slack = 1 + 1e-5 if end == dimensions else (1 + SIGNIFICANCE / np.sqrt(end)) ** 2 * end / dimensions
            within = partial <= threshold * slack + 1e-6
            alive, partial = alive[within], partial[within]
            if not len(alive):
                break
        if len(alive):
            found.append(alive)
            distances = np.sort(np.r_[distances, partial])[:keep]
            if len(distances) == keep:
                threshold = min(threshold, distances[-1])
        begin, width = begin + width, 2 * width
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def needed_probes(sample: np.ndarray, centres: np.ndarray, most: float, k: int, target: float) -> int:
    """Lists to probe so that, inside the sample, ``target`` of the k nearest of some of its rows are reached.

    Neighbours in a sample lie farther away than those in the whole table, so this errs on the side of more lists.
    """
    some = sample[:: max(1, len(sample) // CALIBRATION_ROWS)][:CALIBRATION_ROWS]
    near = np.argsort(-(some @ sample.T), axis=1)[:, 1 : k + 1]
    if not near.size:
        return len(centres)
    home = _squared(_lifted(sample, most), centres).argmin(axis=1)
    place = np.argsort(np.argsort(_squared(np.c_[some, np.zeros(len(some))], centres), axis=1), axis=1)
    ranks = np.take_along_axis(place, home[near], axis=1)
    return int(np.quantile(ranks, target, method="higher")) + 1


def search(
    vectors: DataFrame,
    is_query: Column,
    k: int,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    target_recall: float = TARGET_RECALL,
) -> DataFrame:
    """query_id, rank, vec_id and score: the k found nearest of each query; ``is_query`` is over ``vec_id``."""
    spark = vectors.sparkSession
    kept = usable(vectors, id_column, vector_column)
    classes = stored(_classes(kept, k), "scan-classes")
    about = classes.agg(
        F.count(F.lit(1)).alias("rows"),
        F.max(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)).alias("most"),
        F.max(F.size("vector")).alias("dimensions"),
    ).first()
    result = "query_id long, rank int, vec_id long, score double"
    if not about["rows"]:
        return spark.createDataFrame([], result)
    rows, most, dimensions = about["rows"], about["most"], about["dimensions"]

    wanted = min(SAMPLE_ROWS, max(THRESHOLD_ROWS, SAMPLE_VALUES // dimensions))
    place = F.pmod(F.xxhash64(F.lit("sample"), "class"), F.lit(1 << 30))
    chosen = classes.where(place < int(min(1.0, wanted / rows) * (1 << 30)) + 1)
    drawn = sorted(chosen.limit(2 * wanted).collect()) or [classes.first()]  # bounded by the sample's size
    sample = np.array([row["vector"] for row in drawn])
    lists = int(min(MOST_LISTS, max(1, np.sqrt(rows)), len(sample)))
    centres = _centres(_lifted(sample, most), lists)
    probes = min(lists, max(LEAST_PROBES, needed_probes(sample, centres, most, k, target_recall)))
    threshold_ids = [list(row["ids"]) for row in drawn[:THRESHOLD_ROWS]]
    shards = int(min(lists, max(1, rows // SHARD_ROWS)))
    shared = spark.sparkContext.broadcast((centres, sample[:THRESHOLD_ROWS], threshold_ids, _rotation(dimensions + 1)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        around = shared.value[0]
        for batch in batches:
            for part in (batch.slice(at, 4096) for at in range(0, batch.num_rows, 4096)):
                nearest = _squared(_lifted(_matrix(part.column("vector")), most), around).argmin(axis=1)
                shard = nearest * shards // lists
                columns = [*part.columns, pa.array(nearest, pa.int32()), pa.array(shard, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, [*part.schema.names, "list", "shard"])

    listed = stored(
        classes.mapInArrow(assign, "class long, ids array<long>, vector array<double>, list int, shard int"), "scan-lists"
    )

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        around, known, _, _ = shared.value
        for batch in batches:
            for part in (batch.slice(at, 1024) for at in range(0, batch.num_rows, 1024)):
                own = _matrix(part.column("vector"))
                lifted = np.c_[own, np.zeros(len(own))]
                near = np.argsort(_squared(lifted, around), axis=1)[:, :probes]
                if len(known) > k:
                    bound = np.partition(_squared(lifted, _lifted(known, most)), k, axis=1)[:, k]
                else:
                    bound = np.full(len(own), np.inf)
                # One row for each shard with a probed list, its lists in order of their nearness.
                row, shard, probed = [], [], []
                for at, mine in enumerate(near):
                    homes = mine * shards // lists
                    for home in np.unique(homes):
                        row.append(at)
                        shard.append(home)
                        probed.append(mine[homes == home])
                times = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("class").take(times),
                        part.column("vector").take(times),
                        pa.array(bound[row]),
                        pa.array(probed, pa.list_(pa.int32())),
                        pa.array(shard, pa.int32()),
                    ],
                    ["class", "vector", "bound", "lists", "shard"],
                )

    # Equal query vectors are searched once.
    asking = stored(
        kept.where(is_query).select("vec_id", "vector").distinct().join(classes.select("class", "vector"), "vector").select(
            F.col("vec_id").alias("query_id"), "class"
        ),
        "scan-queries",
    )
    distinct = classes.join(asking.select("class").distinct(), "class", "left_semi").select("class", "vector")
    probes_schema = "class long, vector array<double>, bound double, lists array<int>, shard int"
    probing = stored(distinct.mapInArrow(probe, probes_schema), "scan-probes")

    # One row per shard, at most MOST_LISTS.
    cuts = (
        listed.groupBy("shard")
        .agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("blocks"))
        .join(probing.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / PART_QUERIES).alias("parts")), "shard")
    )
    cuts = F.broadcast(cuts)
    own_block, own_part = F.pmod(F.xxhash64("class"), F.col("blocks")), F.pmod(F.xxhash64("class"), F.col("parts"))
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))
    held = listed.join(cuts, "shard").select("ids", "vector", "list", "shard", own_block.alias("block"), every("parts").alias("part"))
    asked = probing.join(cuts, "shard").select(
        "class", "vector", "bound", "lists", "shard", every("blocks").alias("block"), own_part.alias("part")
    )

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        rotation = shared.value[3]
        right = right.sort_by("list")
        names, own = left.column("class").to_pylist(), _matrix(left.column("vector").combine_chunks())
        others, ids = _matrix(right.column("vector").combine_chunks()), right.column("ids").to_pylist()
        out: dict[str, list] = {"query": [], "ids": [], "score": []}
        if len(own) and len(others):
            cuts = np.searchsorted(right.column("list").to_numpy(), np.arange(lists + 1))
            # In units of the largest norm, so single precision neither overflows nor vanishes.
            turned = _lifted(others, most) @ rotation / np.sqrt(most)
            queries = (np.c_[own, np.zeros(len(own))] @ rotation / np.sqrt(most)).astype(np.float32)
            blocks = column_blocks(turned)
            first = _squared(queries[:, :COLUMNS], blocks[0])
            asked_of = zip(left.column("bound").to_pylist(), left.column("lists").to_pylist(), strict=True)
            for at, (bound, probed) in enumerate(asked_of):
                # The lists' candidates, nearest list first.
                places = np.concatenate([np.arange(cuts[one], cuts[one + 1]) for one in probed])
                near = scan(queries[at], blocks, first[at], places, bound / most, k + 1)
                scores = np.einsum("ij,j->i", others[near], own[at])
                # Whole classes only: a score shared with the last place stays in.
                last = np.partition(-scores, k)[k] if len(scores) > k + 1 else np.inf
                for place_, score in zip(near.tolist(), scores.tolist(), strict=True):
                    if -score <= last:
                        out["query"].append(names[at])
                        out["ids"].append(ids[place_])
                        out["score"].append(score)
        return pa.table(
            {
                "query": pa.array(out["query"], pa.int64()),
                "ids": pa.array(out["ids"], pa.list_(pa.int64())),
                "score": pa.array(out["score"], pa.float64()),
            }
        )

    hits = (
        asked.groupBy("shard", "block", "part")
        .cogroup(held.groupBy("shard", "block", "part"))
        .applyInArrow(compare, "query long, ids array<long>, score double")
    )
    # The rows of the sample that set the first threshold are candidates themselves.
    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, known, ids, _ = shared.value
        for batch in batches:
            for part in (batch.slice(at, 1024) for at in range(0, batch.num_rows, 1024)):
                own = _matrix(part.column("vector"))
                many = min(k + 1, len(known))
                near = np.argpartition(-(own @ known.T), many - 1, axis=1)[:, :many]
                scores = [np.einsum("ij,j->i", known[n], v) for n, v in zip(near, own, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("class").take(pa.array(np.repeat(np.arange(len(own)), many))),
                        pa.array([ids[at] for at in near.ravel()], pa.list_(pa.int64())),
                        pa.array(np.concatenate(scores) if scores else np.zeros(0)),
                    ],
                    ["query", "ids", "score"],
                )

    # A class found in a list and in the sample counts once.
    hits = (
        hits.unionByName(distinct.mapInArrow(seeds, "query long, ids array<long>, score double"))
        .groupBy("query", "ids")
        .agg(F.max("score").alias("score"))
    )
    # Bounded: probes times blocks times about k + 1 classes of k + 1 identifiers.
    pairs = F.transform("ids", lambda i: F.struct((-F.col("score")).alias("minus"), i.alias("vec_id")))
    best = hits.groupBy("query").agg(
        F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(pairs)))), 1, k + 1).alias("best")
    )
    others = F.slice(F.filter("best", lambda hit: hit["vec_id"] != F.col("query_id")), 1, k)
    return (
        asking.join(best, F.col("class") == F.col("query"))
        .select("query_id", F.posexplode(others).alias("place", "hit"))
        .select(
            "query_id",
            (F.col("place") + 1).cast("int").alias("rank"),
            F.col("hit.vec_id").alias("vec_id"),
            (-F.col("hit.minus")).alias("score"),
        )
    )
