"""Chunks streamed past the queries: what a search writes grows with the rows, not with their square."""

import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hangarflow import session
from hangarflow.operators import ball_search, block_stream, vectors


def _nodes(plan):
    yield plan
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        yield from _nodes(plan.executedPlan())
    elif name.endswith("QueryStageExec"):
        yield from _nodes(plan.plan())
    children = plan.children()
    for i in range(children.size()):
        yield from _nodes(children.apply(i))


def _stored_bytes(spark):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(session.shared_dir(spark)) for f in files)


def _collected(df):
    """The rows of a table, and the bytes shuffled for them."""
    rows = df.collect()
    metrics = [node.metrics().get("shuffleBytesWritten") for node in _nodes(df._jdf.queryExecution().executedPlan())]
    return rows, sum(x.get().value() for x in metrics if x.isDefined())


def _written(spark, search):
    """Rows of a search, and the bytes it stored and shuffled; shuffles of the stages it stores count too."""
    before, shuffled, real = _stored_bytes(spark), [], session.stored

    def counted(df, label, **options):
        if label == "cascade-answers":
            shuffled.append(_collected(df)[1])
        return real(df, label, **options)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(session, "stored", counted)
        rows, last = _collected(search())
    return rows, _stored_bytes(spark) - before + sum(shuffled) + last


def _scattered(spark, n, dim=8):
    """Vectors without clusters; every vector asks, every vector is searched."""
    points = np.random.default_rng(n).normal(size=(n, dim)).astype(np.float32)
    rows = [(i, ["TSM", "FIM", "AMM"][i % 3], f"{i % 5:02d}-00", p.tolist()) for i, p in enumerate(points)]
    chunks = spark.createDataFrame(rows, "chunk_id long, manual_type string, ata04 string, embedding array<float>")
    return chunks.selectExpr("chunk_id AS query_id", "ata04", "embedding"), chunks


def _growth(spark, search):
    sizes = []
    for n in (1_500, 6_000):
        queries, chunks = _scattered(spark, n)
        rows, size = _written(spark, lambda: search(queries, chunks))
        assert rows
        sizes.append(size)
    return sizes[1] / sizes[0]


def test_blocks_write_in_proportion_to_the_rows(spark, monkeypatch):
    """Four times the rows in blocks of the same size: about four times the bytes, not sixteen times."""
    monkeypatch.setattr(block_stream, "TASK_QUERIES", 64)
    assert _growth(spark, lambda q, c: vectors.knn_per_type(q, c, k=3, query_block=64, chunk_block=64)) < 6


SEARCHES = {
    "knn_by_ata": lambda q, c: vectors.knn_by_ata(q, c, k=1),
    "knn_per_type": lambda q, c: vectors.knn_per_type(q, c, k=3),
    "knn_merged": lambda q, c: vectors.knn_merged(vectors.knn_per_type(q, c, k=3), 9),
    "rag_derive_ata": lambda q, c: vectors.derive_ata(vectors.knn_per_type(q, c, k=3)),
    "rag_cascade": lambda q, c: vectors.derive_ata_cascade(q, c, min_score=0.9),
}


@pytest.mark.parametrize("name", SEARCHES)
def test_balls_write_in_proportion_to_the_rows(spark, monkeypatch, name):
    """The same for the ball search over vectors whose balls cannot be skipped."""
    monkeypatch.setattr(block_stream, "TASK_QUERIES", 64)
    monkeypatch.setattr(vectors, "CHUNK_BLOCK", 100)
    monkeypatch.setattr(ball_search.build, "__defaults__", (64, ball_search.MAX_BALLS))
    assert _growth(spark, SEARCHES[name]) < 6


@pytest.mark.parametrize("number", ["float", "double"])
def test_blocks_give_repeated_and_missing_ids_as_one_block_does(spark, monkeypatch, number):
    """Ids and rows that come twice, missing ids, codes and components: the same rows as one meeting per type gives."""
    draw = np.random.default_rng(4)
    points = draw.integers(0, 3, (240, 3)).astype(float)  # many ties
    rows = [
        (f"c{i % 200:03}" if i % 50 else None, ["TSM", "AMM"][i % 2], f"{i % 200 % 7:02d}" if i % 11 else None, [float(x) for x in p])
        for i, p in enumerate(points)
    ]
    rows += rows[:40]
    kind = f"chunk_id string, manual_type string, ata04 string, embedding array<{number}>"
    chunks = spark.createDataFrame(rows, kind)
    queries = spark.createDataFrame([(r[0], r[3]) for r in rows[:90]], f"query_id string, embedding array<{number}>")
    columns = ["query_id", "manual_type", "distance", "rank"]
    one = vectors.knn_per_type(queries, chunks, k=5).select(columns).collect()
    monkeypatch.setattr(block_stream, "TASK_QUERIES", 20)
    blocks = vectors.knn_per_type(queries, chunks, k=5, query_block=8, chunk_block=16).select(columns).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, one), key=key) == sorted(map(tuple, blocks), key=key)


def test_a_missing_component_keeps_only_its_own_chunk_out(spark):
    chunks = spark.createDataFrame(
        [(i, "TSM", "21-00", [float(i), None if i == 3 else 0.0]) for i in range(6)],
        "chunk_id long, manual_type string, ata04 string, embedding array<float>",
    )
    queries = spark.createDataFrame([(1, [3.2, 0.0]), (2, [None, 0.0])], "query_id long, embedding array<float>")
    hits = vectors.knn_per_type(queries, chunks, k=2, query_block=4, chunk_block=2).orderBy("rank").collect()
    assert [(r.query_id, r.chunk_id) for r in hits] == [(1, 4), (1, 2)]


def test_vectors_of_several_lengths_are_refused(spark):
    chunks = spark.createDataFrame(
        [(1, "TSM", "21-00", [1.0]), (2, "TSM", "21-00", [1.0, 2.0])],
        "chunk_id long, manual_type string, ata04 string, embedding array<float>",
    ).coalesce(1)
    queries = chunks.selectExpr("chunk_id AS query_id", "embedding").where(F.col("query_id") == 1)
    with pytest.raises(Exception, match="components in one table"):
        vectors.knn_per_type(queries, chunks, query_block=4, chunk_block=4).collect()


def test_a_query_block_waits_for_few_candidates():
    """Candidates are merged when they pass a bound; equal vectors cost no more than that."""
    vectors_ = np.zeros((64, 2))
    best = block_stream.Best(pa.array(range(64)), vectors_, 3)
    for start in range(0, 40_000, 4_000):
        ids = pa.array(range(start, start + 4_000))
        best.add("TSM", np.arange(64), np.zeros((4_000, 2)), ids, pa.array(["21-00"] * 4_000))
        assert not best.waiting.get("TSM")
    found = pa.Table.from_batches(list(best.hits()))
    assert found.num_rows == 64 * 3 and set(found.column("chunk_id").to_pylist()) == {0, 1, 2}


@pytest.mark.parametrize("kth, met", [([[("TSM", 0.5)]], False), ([[("AMM", 0.5)]], True), ([None], True), (None, True)])
def test_a_share_starts_from_the_bound_of_round_one(kth, met):
    """Few queries meet shares of the chunks: a far ball is skipped though its task has seen no near chunk."""
    far = ball_search.BallIndex(
        None, np.array([[0.0, 0.0], [100.0, 0.0]]), np.array(["TSM", "TSM"], dtype=object), np.ones(2), np.full(2, 2), np.ones(2, int)
    )
    batch = pa.RecordBatch.from_pydict(
        {
            "key": [1 << ball_search.SALT_BITS], "round": [ball_search.BOTH], "chunk_id": [[5, 6]], "ata04": [["21-00", None]],
            "vectors": [np.array([[100, 1], [100, 0]], "<f4").tobytes()], "chunk_element": ["<f4"],
        }
    )
    best = block_stream.Best(pa.array([1]), np.zeros((1, 2)), 1, kth)
    ball_search._meeting(far, 1)(best, batch, [0])
    hits = [x for part in best.hits() for x in part.to_pylist()]
    assert [x["chunk_id"] for x in hits] == ([6] if met else [])


def test_equal_queries_are_dealt_out(spark, monkeypatch):
    """Queries that are all the same row make tasks of the usual size."""
    monkeypatch.setattr(block_stream, "TASK_QUERIES", 50)
    queries = spark.range(400).selectExpr("cast(null AS long) AS query_id", "array(1.0f, 2.0f) AS embedding")
    chunks = spark.createDataFrame(
        [(7, "TSM", "21-00", [1.0, 2.0])], "chunk_id long, manual_type string, ata04 string, embedding array<float>"
    )
    sizes = []
    real = block_stream.pack

    def packed(rows, *rest):
        if "query_id" in rows.columns:
            sizes.extend(r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect())
        return real(rows, *rest)

    monkeypatch.setattr(block_stream, "pack", packed)
    hits = vectors.knn_per_type(queries, chunks, k=2, query_block=20, chunk_block=20).collect()
    assert sum(sizes) == 400 and max(sizes) <= 100 and [r.chunk_id for r in hits] == [7, 7]
