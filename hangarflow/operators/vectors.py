"""Exact nearest chunks per query and manual type, and index reports."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hangarflow.functions.vectors import distance_to_score, embedding_or_zero
from hangarflow.schema import MANUAL_TYPES

# --- fixed values: search defaults ------------------------------------------------
TOP_K = 5
TOP_K_BY_ATA = 3
POST_FILTER_FACTOR = 3
DERIVE_TOP_K = 3
DIMENSION = 1536
CASCADE = ("TSM", "FIM", "AMM")
CASCADE_MIN_SCORE = 0.5
# --- end of fixed values ------------------------------------------------------------

# Rows per block of either side (1536 floats: about 25 MB and 100 MB).
QUERY_BLOCK = 4_096
CHUNK_BLOCK = 16_384
# Distances of one matrix product, and vector components refined at a time.
_CELLS = 1 << 20
_COMPONENTS = 1 << 22

_HIT_COLUMNS = ["query_id", "manual_type", "chunk_id", "ata04", "distance"]
# Ship the helpers below with the task, so workers need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _exact_distances(
    queries: np.ndarray, chunks: np.ndarray, row: np.ndarray, col: np.ndarray
) -> np.ndarray:
    """Squared distances of pairs, summed from differences a bounded number of components at a time."""
    found = np.empty(len(row))
    step = max(1, _COMPONENTS // max(1, chunks.shape[1]))
    for start in range(0, len(row), step):
        part = slice(start, start + step)
        difference = queries[row[part]] - chunks[col[part]]
        found[part] = np.einsum("ij,ij->i", difference, difference)
    return found


def _block_hits(q: pd.DataFrame, c: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest chunks of one block per query and type.

    A matrix product finds the candidates; the distances of the candidates are
    then summed from differences, so equal vectors get equal distances. The
    margin keeps every chunk that rounding could have pushed over the k-th place.
    Any number of ties costs index numbers only, never copies of vectors.
    """
    if not len(q) or not len(c):
        # Object columns: Arrow has no single empty string array of an empty float column.
        return pd.DataFrame({name: [] for name in _HIT_COLUMNS}, dtype=object)
    frames = []
    all_queries, all_chunks = _matrix(q["embedding"]), _matrix(c["embedding"])
    for manual_type, rows in c.reset_index(drop=True).groupby("manual_type", sort=False):
        rows = rows.sort_values("chunk_id")
        vectors = all_chunks[rows.index.to_numpy()]
        ids, codes = rows["chunk_id"].to_numpy(), rows["ata04"].to_numpy()
        norms = np.einsum("ij,ij->i", vectors, vectors)
        last = min(k, len(rows)) - 1
        height = max(1, _CELLS // len(rows))
        for start in range(0, len(q), height):
            queries = all_queries[start : start + height]
            query_norms = np.einsum("ij,ij->i", queries, queries)
            product = query_norms[:, None] + norms[None, :] - 2.0 * (queries @ vectors.T)
            limit = np.partition(product, last, axis=1)[:, last]
            margin = 1e-9 * (1.0 + query_norms + norms.max())
            row, col = np.nonzero(product <= (limit + margin)[:, None])
            distance = _exact_distances(queries, vectors, row, col)
            # Chunks are in order of their ids, so the column number breaks ties.
            order = np.lexsort((col, distance, row))
            row, col, distance = row[order], col[order], distance[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            near = place < k
            frames.append(
                pd.DataFrame(
                    {
                        "query_id": q["query_id"].to_numpy()[start + row[near]],
                        "manual_type": manual_type,
                        "chunk_id": ids[col[near]],
                        "ata04": codes[col[near]],
                        "distance": distance[near],
                    }
                )
            )
    return pd.concat(frames)[_HIT_COLUMNS]


def _hit_schema(queries: DataFrame, chunks: DataFrame) -> T.StructType:
    return T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("manual_type", T.StringType()),
            T.StructField("chunk_id", chunks.schema["chunk_id"].dataType),
            T.StructField("ata04", T.StringType()),
            T.StructField("distance", T.DoubleType()),
        ]
    )


def _candidates(
    queries: DataFrame, chunks: DataFrame, k: int, query_block: int, chunk_block: int, within: list[str]
) -> DataFrame:
    """The k nearest of every query and type, per block of the chunks.

    Both sides are cut into blocks of bounded size by row hash, and every query
    block meets every chunk block in one task, whatever the sizes: rows move once
    per opposite block, and only k hits per query, type and block come out.
    ``within`` names columns that must be equal on both sides.
    """
    hit_schema = _hit_schema(queries, chunks)
    n_query_blocks = max(1, -(-queries.count() // query_block))
    n_chunk_blocks = max(1, -(-chunks.count() // chunk_block))

    def blocked(df, key, own, n_own, other, n_other):
        # Both block numbers are longs on both sides: a cogroup hashes its keys as they are,
        # and an int and a long of the same value fall into different partitions.
        return df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(n_own).cast("long"))).withColumn(
            other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_other - 1).cast("long")))
        )

    q = blocked(queries, "query_id", "qb", n_query_blocks, "cb", n_chunk_blocks)
    c = blocked(chunks, "chunk_id", "cb", n_chunk_blocks, "qb", n_query_blocks)

    def meet(left, right):
        return _block_hits(left, right, k)

    keys = [*within, "qb", "cb"]
    return q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInPandas(meet, hit_schema)


def knn_per_type(
    queries: DataFrame,
    chunks: DataFrame,
    k: int = TOP_K,
    manual_types: list[str] | None = None,
    query_block: int | None = None,
    chunk_block: int | None = None,
    within: list[str] | None = None,
) -> DataFrame:
    """The k nearest chunks per query and manual type by squared L2 distance.

    By default the chunks are put in a stored ball partition and stay there
    (``ball_search``). When both sides fit in one block (CHUNK_BLOCK chunks,
    QUERY_BLOCK queries), they meet once per type instead. With given blocks the
    chunk blocks are stored and streamed past the query blocks (``block_stream``);
    with ``within`` columns query blocks meet copies of chunk blocks.

    ``queries(query_id, embedding)``, ``chunks(chunk_id, manual_type, ata04,
    embedding)``; ids are integers or strings. Queries without an embedding give no rows, types
    without chunks are absent, and ties go to the lower chunk id. Chunks without an embedding,
    or flagged by ``is_fallback``, are not searched: a zero vector says nothing about its text.
    ``within`` searches only chunks that agree with the query in these columns.
    """
    within = within or []
    usable = F.col("manual_type").isin(manual_types or MANUAL_TYPES) & F.col("embedding").isNotNull()
    if "is_fallback" in chunks.columns:
        usable &= ~F.coalesce("is_fallback", F.lit(False))
    searched = chunks.where(usable).select("chunk_id", "manual_type", "ata04", "embedding")
    asked = queries.where(F.col("embedding").isNotNull()).select("query_id", "embedding", *within)
    from hangarflow.operators import ball_search, block_stream

    # Both sides within one block: one meeting per type, nothing copied, which a
    # ball partition cannot beat. Above that the chunks stay in their balls, or
    # in the given blocks.
    small = searched.limit(CHUNK_BLOCK + 1).count() <= CHUNK_BLOCK and asked.limit(QUERY_BLOCK + 1).count() <= QUERY_BLOCK
    if within or (small and not query_block and not chunk_block):
        hits = _candidates(asked, searched, k, query_block or QUERY_BLOCK, chunk_block or CHUNK_BLOCK, within)
    elif query_block or chunk_block:
        sizes = query_block or QUERY_BLOCK, chunk_block or CHUNK_BLOCK
        hits = block_stream.block_search(asked, searched, k, *sizes, _hit_schema(asked, searched))
    else:
        hits = ball_search.search(asked, ball_search.build(searched), k, _hit_schema(asked, searched))
    order = Window.partitionBy("query_id", "manual_type").orderBy("distance", "chunk_id")
    return (
        hits.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .withColumn("score", distance_to_score(F.col("distance")))
    )


def knn_merged(hits: DataFrame, keep: int) -> DataFrame:
    """Hits of all types in one list per query, best ``keep`` first."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "manual_type", "chunk_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def knn_by_ata(
    queries: DataFrame,
    chunks: DataFrame,
    k: int = TOP_K_BY_ATA,
    manual_types: list[str] | None = None,
    prefilter: bool = False,
    **blocks,
) -> DataFrame:
    """Hits of the query's own ``ata04`` among its best overall hits.

    The list is ranked first and filtered afterwards, so a query may get fewer
    than ``k`` rows. ``prefilter`` searches only chunks of that code instead.
    """
    types = manual_types or MANUAL_TYPES
    if prefilter:
        return knn_merged(knn_per_type(queries, chunks, k, types, within=["ata04"], **blocks), k)
    wide = k * POST_FILTER_FACTOR
    merged = knn_merged(knn_per_type(queries, chunks, wide, types, **blocks), wide * len(types))
    wanted = queries.select("query_id", F.col("ata04").alias("wanted"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "manual_type", "chunk_id")
    return (
        merged.drop("rank")
        .join(wanted, "query_id")
        .where(F.col("ata04") == F.col("wanted"))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .drop("wanted")
    )


def derive_ata(hits: DataFrame) -> DataFrame:
    """Code of the majority of a query's hits and its nearest chunk; ties by best score, then lower code."""
    votes = (
        hits.where(F.col("ata04").isNotNull())
        .groupBy("query_id", "ata04")
        .agg(
            F.count(F.lit(1)).alias("votes"),
            F.max("score").alias("score"),
            F.min_by("chunk_id", F.struct("distance", "chunk_id", "manual_type")).alias("chunk_id"),
        )
    )
    cost = F.struct((-F.col("votes")).alias("v"), (-F.col("score")).alias("s"), "ata04")
    return (
        votes.groupBy("query_id")
        .agg(F.min_by(F.struct("ata04", "votes", "score", "chunk_id"), cost).alias("best"))
        .select("query_id", "best.*")
    )


def derive_ata_cascade(
    queries: DataFrame,
    chunks: DataFrame,
    order: tuple[str, ...] = CASCADE,
    k: int = DERIVE_TOP_K,
    min_score: float = CASCADE_MIN_SCORE,
) -> DataFrame:
    """Codes derived type by type: only queries without a sure answer go on to the next type.

    Each stage searches the chunks of one manual type for the queries still open,
    derives a code by vote (``derive_ata``) and keeps answers whose score reaches
    ``min_score``; an anti-join removes them from the next stage, and the open
    queries are stored between stages. Returns query_id, manual_type, stage (from 1),
    ata04, votes, score, chunk_id; queries without a sure answer in any stage have
    no row. The vote over all types at once is ``derive_ata``.
    """
    from hangarflow.session import stored

    open_queries = queries
    answers = None
    for stage, manual_type in enumerate(order, 1):
        best = derive_ata(knn_per_type(open_queries, chunks, k, [manual_type]))
        sure = stored(
            best.where(F.col("score") >= min_score).select(
                "query_id", F.lit(manual_type).alias("manual_type"), F.lit(stage).alias("stage"), "ata04", "votes", "score", "chunk_id"
            ),
            "cascade-answers",
        )
        answers = sure if answers is None else answers.unionByName(sure)
        if stage < len(order):
            open_queries = stored(open_queries.join(sure.select("query_id"), "query_id", "left_anti"), "cascade-open")
    return answers


def chunk_lookup(keys: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks by ``(chunk_id, manual_type)``; unknown keys give no row."""
    return keys.join(chunks, ["chunk_id", "manual_type"])


def index_statistics(chunks: DataFrame) -> DataFrame:
    """Vectors and dimension per manual type, and overall as type ``ALL``."""
    # One row per type is left before the overall row is added.
    per_type = (
        chunks.select("manual_type", F.size("embedding").alias("n"))
        .groupBy("manual_type")
        .agg(F.count(F.lit(1)).alias("vectors"), F.max("n").alias("dimension"))
    )
    return (
        per_type.groupingSets([["manual_type"], []], "manual_type")
        .agg(
            F.sum("vectors").alias("vectors"),
            F.max("dimension").alias("dimension"),
            F.grouping_id().alias("level"),
        )
        .select(
            F.when(F.col("level") == 1, F.lit("ALL"))
            .otherwise(F.col("manual_type"))
            .alias("manual_type"),
            "vectors",
            "dimension",
        )
    )


def index_types(chunks: DataFrame) -> DataFrame:
    """The manual types that have chunks."""
    return chunks.select("manual_type").distinct()


def is_available(chunks: DataFrame) -> bool:
    return not chunks.isEmpty()


def with_fallback(chunks: DataFrame, dimension: int = DIMENSION) -> DataFrame:
    """Zero vectors where the embedding is missing, flagged by ``is_fallback``."""
    return chunks.withColumn("is_fallback", F.col("embedding").isNull()).withColumn(
        "embedding", embedding_or_zero(F.col("embedding"), dimension)
    )
