"""The ball partition search against brute force on clustered vectors, and its share of skipped balls."""

import numpy as np

from hangarflow.operators import ball_search
from hangarflow.operators.vectors import _hit_schema


def _tables(spark, draw, n_chunks=3_000, n_queries=150, dim=16, clusters=40):
    centres = draw.normal(0, 10, (clusters, dim))
    pick = draw.integers(0, clusters, n_chunks)
    vectors = (centres[pick] + draw.normal(0, 0.5, (n_chunks, dim))).astype(np.float32)
    vectors[100:400] = vectors[100]  # a hot group of equal vectors: ties by chunk id
    types = np.where(draw.random(n_chunks) < 0.7, "TSM", "AMM")
    chunks = [(int(i), str(t), f"{i % 7:02d}-00", [float(x) for x in v]) for i, (t, v) in enumerate(zip(types, vectors))]
    asked = (centres[draw.integers(0, clusters, n_queries)] + draw.normal(0, 0.5, (n_queries, dim))).astype(np.float32)
    queries = [(10_000 + i, [float(x) for x in v]) for i, v in enumerate(asked)]
    queries.append((99_999, [float(x) for x in vectors[100]]))
    c = spark.createDataFrame(chunks, "chunk_id long, manual_type string, ata04 string, embedding array<float>")
    q = spark.createDataFrame(queries, "query_id long, embedding array<float>")
    return c, q, chunks, queries


def _brute(chunks, queries, k):
    want = set()
    for qid, qv in queries:
        q = np.array(qv, np.float64)
        for manual_type in ("TSM", "AMM"):
            own = [(float(((np.array(v, np.float64) - q) ** 2).sum()), cid) for cid, t, _, v in chunks if t == manual_type]
            for rank, (_, cid) in enumerate(sorted(own)[:k], 1):
                want.add((qid, manual_type, cid, rank))
    return want


def test_ball_search_is_exact_and_skips_balls(spark):
    draw = np.random.default_rng(11)
    c, q, chunks, queries = _tables(spark, draw)
    index = ball_search.build(c, ball_rows=64)
    assert len(index.centres) >= 40 and index.salts.max() > 1  # the hot group is a ball of several sub-balls
    report = {}
    hits = ball_search.search(q, index, 5, _hit_schema(q, c), report)
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    ranked = hits.withColumn(
        "rank", F.row_number().over(Window.partitionBy("query_id", "manual_type").orderBy("distance", "chunk_id"))
    )
    got = {(r.query_id, r.manual_type, r.chunk_id, r.rank) for r in ranked.collect()}
    assert got == _brute(chunks, queries, 5)
    assert report["first"] + report["second"] < 0.3 * report["all"]


def test_ball_search_with_one_ball_and_few_chunks(spark):
    draw = np.random.default_rng(2)
    c, q, chunks, queries = _tables(spark, draw, n_chunks=420, n_queries=20, clusters=3)
    hits = ball_search.search(q, ball_search.build(c), 500, _hit_schema(q, c))
    assert hits.count() == len(queries) * 420  # k above the chunks of a type: all of them


def test_knn_per_type_takes_the_balls_above_one_block(spark, monkeypatch):
    from hangarflow.operators import vectors

    draw = np.random.default_rng(8)
    c, q, chunks, queries = _tables(spark, draw, n_chunks=1_500, n_queries=60, clusters=20)
    taken = []
    monkeypatch.setattr(vectors, "CHUNK_BLOCK", 500)
    monkeypatch.setattr(ball_search, "BALL_ROWS", 64)
    real = ball_search.search
    monkeypatch.setattr(ball_search, "search", lambda *a, **kw: taken.append(1) or real(*a, **kw))
    hits = vectors.knn_per_type(q, c, k=4)
    got = {(r.query_id, r.manual_type, r.chunk_id, r.rank) for r in hits.collect()}
    assert taken and got == _brute(chunks, queries, 4)


def test_blocks_meet_when_the_shuffle_keeps_many_partitions(spark):
    from hangarflow.operators import vectors

    draw = np.random.default_rng(5)
    c, q, chunks, queries = _tables(spark, draw, n_chunks=900, n_queries=60, clusters=6)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        # Blocks of both sides in different partitions, some keys with one side only.
        rows = vectors.knn_per_type(q, c, k=4, query_block=16, chunk_block=100).collect()
        own = q.selectExpr("*", "lpad(cast(query_id % 9 AS string), 2, '0') || '-00' AS ata04")
        within = vectors.knn_per_type(own, c, k=4, within=["ata04"]).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert {(r.query_id, r.manual_type, r.chunk_id, r.rank) for r in rows} == _brute(chunks, queries, 4)
    want = set()
    for code in range(9):
        same = [x for x in chunks if x[2] == f"{code:02d}-00"]
        want |= _brute(same, [x for x in queries if x[0] % 9 == code], 4)
    assert {(r.query_id, r.manual_type, r.chunk_id, r.rank) for r in within} == want


def test_search_within_a_column_that_one_side_lacks(spark):
    """Groups with queries but no chunks, and with chunks but no queries, give nothing and break nothing."""
    from hangarflow.operators import vectors

    draw = np.random.default_rng(6)
    c, q, chunks, queries = _tables(spark, draw, n_chunks=450, n_queries=20, clusters=3)
    own = q.selectExpr("*", "CASE WHEN query_id % 2 = 0 THEN '03-00' ELSE '77-00' END AS ata04")
    hits = vectors.knn_by_ata(own, c, k=2, prefilter=True).collect()
    same = [x for x in chunks if x[2] == "03-00"]
    per_type = _brute(same, [x for x in queries if x[0] % 2 == 0], 2)
    assert {r.query_id for r in hits} == {x[0] for x in per_type}
    assert {(r.query_id, r.manual_type, r.chunk_id) for r in hits} <= {x[:3] for x in per_type}


def test_probes_leave_in_bounded_pieces(monkeypatch):
    """Many queries against many balls: no piece grows with their product."""
    import pyarrow as pa

    draw = np.random.default_rng(3)
    balls, dim, asked = 300, 4, 500
    salts = np.ones(balls, np.int64)
    salts[7] = 900  # one ball of many sub-balls
    index = ball_search.BallIndex(
        None, draw.normal(0, 1, (balls, dim)), np.array(["TSM", "AMM"] * (balls // 2), dtype=object),
        np.full(balls, 50.0), np.full(balls, 10), salts,
    )
    vectors = pa.array(draw.normal(0, 1, (asked, dim)).tolist(), pa.list_(pa.float32()))
    kth = pa.array([[("TSM", 1.0), ("AMM", 1.0)]] * asked, pa.map_(pa.string(), pa.float64()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(asked)), vectors, kth], names=["query_id", "embedding", "kth"])
    monkeypatch.setattr(ball_search, "PROBE_COMPONENTS", 1 << 12)
    pieces = list(ball_search._probes(index, 5, True)(iter([batch])))
    assert max(piece.num_rows for piece in pieces) * dim <= 1 << 12
    found = {(q, key) for piece in pieces for q, key in zip(*(piece.column(n).to_pylist() for n in ("query_id", "key")))}
    first = list(ball_search._probes(index, 5, False)(iter([batch])))
    found |= {(q, key) for piece in first for q, key in zip(*(piece.column(n).to_pylist() for n in ("query_id", "key")))}
    assert len(found) == asked * int(salts.sum())  # every radius reaches: all sub-balls of all balls
