"""Exact k nearest chunks from a stored ball partition; chunks stay where they are stored.

Index: per manual type, centres are drawn from the chunks by a hash of the chunk
id (about one per ``BALL_ROWS`` chunks, at most ``MAX_BALLS`` in all, so the
broadcast centres are bounded by MAX_BALLS × dimension doubles). Every chunk
joins its nearest centre of its own type; a ball keeps its centre, its radius
(largest member distance) and its member count. A ball with more than
BALL_ROWS members is cut by chunk-id hash into sub-balls of that size, which
share centre and radius; the sub-ball is the unit of work, so a ball that holds
a third of all chunks is spread over many tasks. The chunks are written once
with their sub-ball key.

Search, two rounds for all queries, which the stored chunks are streamed past
twice (``block_stream``), a task holding a block of queries and their k best so far:

1. each query probes, per type, its nearest balls by centre distance until they
   hold k chunks; their exact k best give an upper bound t of the k-th distance;
2. it then probes every other ball whose lower bound ``|q - c| - r`` does not
   exceed t, which falls as nearer chunks are found. No chunk outside these balls
   can be nearer than t, so the k best are exact (ties to the lower chunk id, as
   in the block search).

A skipped ball is right whatever the order in which chunks arrive; the rounds only
make t small early. Queries too few to keep the cores busy meet shares of the chunks
in several tasks; then round one is a pass of its own, whose t all tasks of the
second pass start from. Neither probes nor chunks are copied on disk: a search writes
the queries once (a shuffle) and k hits per query and type.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hangarflow.operators import block_stream
from hangarflow.session import stored

BALL_ROWS = 2_048
MAX_BALLS = 4_096
# Vector components in one piece of probes, and cells of one distance matrix to the centres.
PROBE_COMPONENTS = 1 << 20
CENTRE_CELLS = 1 << 20
SEED = 17
FIRST, SECOND, BOTH = 1, 2, 3  # rounds a row of chunks is read for
SALT_BITS = 32  # key = ball << SALT_BITS | sub-ball

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass
class BallIndex:
    chunks: DataFrame  # packed: a row holds chunk_id, ata04 and vectors of one key, or a part of it
    centres: np.ndarray  # (balls, dimension)
    types: np.ndarray  # manual type of each ball
    radius: np.ndarray
    members: np.ndarray
    salts: np.ndarray  # sub-balls of each ball


def _unit_hash(column: str) -> F.Column:
    return F.pmod(F.xxhash64(F.col(column), F.lit(SEED)), F.lit(1 << 30)) / float(1 << 30)


def _nearest_centre(centres: np.ndarray, types: np.ndarray):
    by_type = {t: np.nonzero(types == t)[0] for t in set(types.tolist())}

    def run(frames):
        for frame in frames:
            ball = np.zeros(len(frame), np.int64)
            gap = np.zeros(len(frame))
            for manual_type, rows in frame.groupby("manual_type", sort=False).groups.items():
                rows = np.asarray(rows)
                at = frame.index.get_indexer(rows)
                own = by_type[manual_type]
                c = centres[own]
                height = max(1, CENTRE_CELLS // max(len(own), c.shape[1], 1))
                for start in range(0, len(at), height):
                    some = at[start : start + height]
                    vectors = np.stack(frame["embedding"].to_numpy()[some]).astype(np.float64)
                    squared = (vectors**2).sum(1)[:, None] + (c**2).sum(1)[None, :] - 2 * vectors @ c.T
                    best = squared.argmin(axis=1)
                    ball[some] = own[best]
                    difference = vectors - c[best]
                    gap[some] = np.sqrt(np.einsum("ij,ij->i", difference, difference))
            yield frame.assign(ball=ball, gap=gap)

    return run


def build(chunks: DataFrame, ball_rows: int = BALL_ROWS, max_balls: int = MAX_BALLS) -> BallIndex:
    """The ball partition of ``chunks(chunk_id, manual_type, ata04, embedding)``, written once."""
    searched = chunks.select("chunk_id", "manual_type", "ata04", "embedding")
    counts = {r["manual_type"]: r["count"] for r in searched.groupBy("manual_type").count().collect()}
    total = sum(counts.values())
    wanted = {t: max(1, -(-n // ball_rows)) for t, n in counts.items()}
    if sum(wanted.values()) > max_balls:
        wanted = {t: max(1, b * max_balls // sum(wanted.values())) for t, b in wanted.items()}
    fraction = F.create_map(*[x for t in counts for x in (F.lit(t), F.lit(min(1.0, 3.0 * wanted[t] / counts[t])))])
    limit = F.create_map(*[x for t in counts for x in (F.lit(t), F.lit(wanted[t]))])
    drawn = (
        searched.withColumn("u", _unit_hash("chunk_id"))
        .where(F.col("u") < fraction[F.col("manual_type")])
        .withColumn("n", F.row_number().over(Window.partitionBy("manual_type").orderBy("u", "chunk_id")))
        .where(F.col("n") <= limit[F.col("manual_type")])
        .select("manual_type", "embedding")
        .collect()
    ) if total else []
    # A type with every hash above its fraction still gets one centre: its first chunk.
    missing = set(counts) - {r["manual_type"] for r in drawn}
    if missing:
        drawn += searched.where(F.col("manual_type").isin(list(missing))).dropDuplicates(["manual_type"]).select(
            "manual_type", "embedding"
        ).collect()
    types = np.array([r["manual_type"] for r in drawn], dtype=object)
    centres = np.array([r["embedding"] for r in drawn], dtype=np.float64).reshape(len(drawn), -1)
    schema = T.StructType([*searched.schema.fields, T.StructField("ball", T.LongType()), T.StructField("gap", T.DoubleType())])
    assigned = stored(searched.mapInPandas(_nearest_centre(centres, types), schema), "balls-assigned")
    stats = assigned.groupBy("ball").agg(F.max("gap").alias("radius"), F.count(F.lit(1)).alias("members")).collect()
    radius, members = np.zeros(len(drawn)), np.zeros(len(drawn), np.int64)
    for r in stats:
        radius[r["ball"]], members[r["ball"]] = r["radius"], r["members"]
    salts = np.maximum(1, -(-members // ball_rows))
    salt_of = F.element_at(F.array(*[F.lit(int(s)) for s in salts]), (F.col("ball") + 1).cast("int")) if len(salts) else F.lit(1)
    keyed = assigned.select(
        "chunk_id",
        "manual_type",
        "ata04",
        "embedding",
        F.shiftleft(F.col("ball"), SALT_BITS).bitwiseOR(F.pmod(F.xxhash64("chunk_id"), salt_of.cast("long"))).alias("key"),
    )
    together = keyed.repartition("key").sortWithinPartitions("key")
    packed = block_stream.stored_chunks(together, "key", ball_rows, "balls", runs=True)
    return BallIndex(packed, centres, types, radius, members, salts)


def _first_balls(queries: np.ndarray, centres: np.ndarray, members: np.ndarray, k: int):
    """Distances of the queries to the balls of one type, and which balls each query probes first."""
    squared = (queries**2).sum(1)[:, None] + (centres**2).sum(1)[None, :] - 2 * queries @ centres.T
    near = np.sqrt(np.maximum(squared, 0.0))
    order = np.argsort(near, axis=1, kind="stable")
    held = np.cumsum(members[order], axis=1)
    first = np.minimum((held < k).sum(axis=1), len(centres) - 1)  # last ball of round one
    return near, np.argsort(order, axis=1) <= first[:, None]


def _reached(near: np.ndarray, queries: np.ndarray, centres: np.ndarray, radius: np.ndarray, kth: np.ndarray) -> np.ndarray:
    """Which balls may hold a chunk as near as each query's k-th (a squared distance)."""
    # The product form of |q - c| may err by a few ulps of |q|² + |c|²: a
    # margin of that size only adds probes.
    slack = 1e-6 * np.sqrt((queries**2).sum(1)[:, None] + (centres**2).sum(1)[None, :])
    return near - radius[None, :] <= np.sqrt(kth)[:, None] * (1 + 1e-9) + slack


def _probes(index: BallIndex, k: int, second: bool):
    """Sub-ball keys each query probes in round one, or in round two given its k-th distances."""
    centres, radius, members, salts = index.centres, index.radius, index.members, index.salts  # not the DataFrame
    by_type = {t: np.nonzero(index.types == t)[0] for t in set(index.types.tolist())}
    piece = max(1, PROBE_COMPONENTS // max(1, centres.shape[1]))
    height = max(1, piece // max(1, int(salts.sum())))

    def of_slice(queries, limits):
        """Row numbers and keys of the probes of some queries, all types."""
        at_rows, at_keys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for manual_type, own in by_type.items():
            near, first = _first_balls(queries, centres[own], members[own], k)
            if second:
                kth = np.array([m.get(manual_type, np.nan) for m in limits], dtype=float)
                reach = _reached(near, queries, centres[own], radius[own], np.where(np.isnan(kth), np.inf, kth))
                rows, cols = np.nonzero(reach & ~first)
            else:
                rows, cols = np.nonzero(first)
            keep = members[own[cols]] > 0  # a centre equal to another's gets no members
            rows, cols = rows[keep], cols[keep]
            balls = own[cols]
            many = salts[balls].astype(np.int64)
            at = np.repeat(np.arange(len(balls)), many)
            salt = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
            at_rows.append(rows[at])
            at_keys.append((balls[at] << SALT_BITS) | salt)
        return np.concatenate(at_rows), np.concatenate(at_keys)

    def run(batches):
        # A query leaves once per probed sub-ball: a batch of queries leaves in pieces of
        # bounded size, whatever the number of balls.
        for batch in batches:
            for start in range(0, batch.num_rows, height):
                asked = batch.slice(start, height)
                vectors = asked.column("embedding")
                queries = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(asked.num_rows, -1)
                limits = [dict(m or []) for m in asked.column("kth").to_pylist()] if second else None
                rows, keys = of_slice(queries, limits)
                for cut in range(0, len(rows), piece):
                    at = pa.array(rows[cut : cut + piece])
                    yield pa.RecordBatch.from_arrays(
                        [asked.column("query_id").take(at), vectors.take(at), pa.array(keys[cut : cut + piece])],
                        names=["query_id", "embedding", "key"],
                    )

    return run


def _meeting(index: BallIndex, k: int):
    """Lets a query block meet the rows of the index: in round one those of its first balls, then the others in reach."""
    centres, radius, members = index.centres, index.radius, index.members  # not the DataFrame
    types, by_type = index.types, {t: np.nonzero(index.types == t)[0] for t in set(index.types.tolist())}

    def first_of(queries):
        first = np.zeros((len(queries), len(types)), bool)
        height = max(1, CENTRE_CELLS // max(1, len(types)))
        for own in by_type.values():
            for start in range(0, len(queries), height):
                some = slice(start, start + height)
                first[some, own] = _first_balls(queries[some], centres[own], members[own], k)[1]
        return first

    def meet(best, batch, rows):
        if best.first is None:
            best.first = first_of(best.vectors)
        for i in rows:
            ball = batch.column("key")[i].as_py() >> SALT_BITS
            kind, asking, number = types[ball], best.first[:, ball], batch.column("round")[i].as_py()
            if number != FIRST:
                if np.isinf(best.limit(kind)).any():
                    best.settle(kind)  # the hits of round one bound round two
                own = slice(ball, ball + 1)
                near = np.sqrt(((best.vectors - centres[ball]) ** 2).sum(axis=1))[:, None]
                reach = _reached(near, best.vectors, centres[own], radius[own], best.limit(kind))[:, 0]
                asking = reach if number == BOTH else reach & ~asking
            asking = np.flatnonzero(asking)
            if len(asking):
                best.add(kind, asking, *block_stream.chunk_block(batch, [i]))

    return meet


def _pass(queries: DataFrame, index: BallIndex, k: int, hit_schema: T.StructType, rounds: list[int], dealt_to) -> DataFrame:
    passes = [index.chunks.withColumn("round", F.lit(x)) for x in rounds]
    chunks = passes[0] if len(passes) == 1 else passes[0].unionByName(passes[1])
    return block_stream.passed(queries, chunks, _meeting(index, k), k, hit_schema, dealt_to)


def _bounds(queries: DataFrame, index: BallIndex, k: int, hit_schema: T.StructType, dealt_to) -> DataFrame:
    """The queries with the k-th distances of round one, for types in which it finds k chunks."""
    kth = (
        _best(_pass(queries, index, k, hit_schema, [FIRST], dealt_to), k)
        .groupBy("query_id", "manual_type")
        .agg(F.max("distance").alias("d"), F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= k)
        .groupBy("query_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("manual_type", "d"))).alias("kth"))
    )
    return queries.join(kth, "query_id", "left")


def _best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id", "manual_type").orderBy("distance", "chunk_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(
    queries: DataFrame, index: BallIndex, k: int, hit_schema: T.StructType, report: dict | None = None
) -> DataFrame:
    """The k best (query_id, manual_type, chunk_id, ata04, distance) of every query and type, exact.

    ``report``, if given, receives the number of sub-balls probed in each round, the
    second with the k-th distances of the first, and the number a search of every
    sub-ball would probe (counted by jobs of their own).
    """
    if not len(index.centres):
        return _best(queries.sparkSession.createDataFrame([], hit_schema), k)
    used = index.types[index.members > 0]
    asked = queries.select("query_id", "embedding")
    dealt_to = block_stream.layout(asked)
    # With one ball per type round one probes every ball, so there is no second round.
    one_round = len(set(used.tolist())) == len(used)
    if report is not None:
        probe_schema = T.StructType([*asked.schema.fields, T.StructField("key", T.LongType())])
        report["first"] = asked.mapInArrow(_probes(index, k, False), probe_schema).count()
        report["second"], report["all"] = 0, asked.count() * int(index.salts.sum())
        if not one_round:
            bounded = _bounds(asked, index, k, hit_schema, dealt_to)
            report["second"] = bounded.mapInArrow(_probes(index, k, True), probe_schema).count()
    if one_round:
        hits = _pass(asked, index, k, hit_schema, [FIRST], dealt_to)
    elif dealt_to[1] == 1:
        hits = _pass(asked, index, k, hit_schema, [FIRST, SECOND], dealt_to)
    else:
        hits = _pass(_bounds(asked, index, k, hit_schema, dealt_to), index, k, hit_schema, [BOTH], dealt_to)
    return _best(hits, k).drop("rank")
