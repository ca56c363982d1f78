"""Queries over chunk vectors: every embedding asks, every embedding is searched."""

from __future__ import annotations

from pyspark.sql import functions as F

from hangarflow.functions.vectors import distance_to_score, squared_l2
from hangarflow.operators import vectors as ops
from hangarflow.session import new_path
from hangarflow.sources import tables
from suite.data import CHUNKS_SQL, table, vector_chunks, vector_queries

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


_DISTANCE = """list_sum(list_transform(range(1, len({a}) + 1),
    lambda i: (CAST({a}[i] AS DOUBLE) - CAST({b}[i] AS DOUBLE)) ** 2))"""
_PAIRS = f"""WITH {CHUNKS_SQL}, pairs AS (SELECT q.query_id, q.ata04 AS wanted, c.chunk_id, c.manual_type, c.ata04,
    {_DISTANCE.format(a='q.embedding', b='c.embedding')} AS d FROM queries q CROSS JOIN chunks c)"""


def _per_type(k):
    return f"""per_type AS (SELECT *, 1 / (1 + d) AS score FROM (SELECT *, row_number() OVER
      (PARTITION BY query_id, manual_type ORDER BY d, chunk_id) AS rank FROM pairs) WHERE rank <= {k})"""


_MERGED = """merged AS (SELECT * EXCLUDE (rank), row_number() OVER
    (PARTITION BY query_id ORDER BY score DESC, manual_type, chunk_id) AS rank FROM per_type)"""


def _rounded(hits):
    return hits.select(
        "query_id", "manual_type", "chunk_id", "ata04", "rank", F.round("score", 6).alias("score")
    )


_OUT = "query_id, manual_type, chunk_id, ata04, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score"


@query(
    "distance_to_score",
    f"""WITH {CHUNKS_SQL}, zero AS (SELECT *, list_transform(embedding, lambda x: 0.0) AS z FROM chunks)
    SELECT chunk_id, round(1 / (1 + {_DISTANCE.format(a='embedding', b='z')}), 6) AS score FROM zero""",
)
def distance_score(spark, sf):
    origin = F.transform("embedding", lambda x: F.lit(0.0))
    score = distance_to_score(squared_l2(F.col("embedding"), origin))
    return vector_chunks(spark, sf).select("chunk_id", F.round(score, 6).alias("score"))


@query("knn_per_type", f"{_PAIRS}, {_per_type(5)} SELECT {_OUT} FROM per_type")
def knn_per_type(spark, sf):
    return _rounded(ops.knn_per_type(vector_queries(spark, sf), vector_chunks(spark, sf)))


@query("knn_blocked", f"{_PAIRS}, {_per_type(5)} SELECT {_OUT} FROM per_type")
def knn_blocked(spark, sf):
    """The same search with both sides cut into blocks, as for many queries."""
    hits = ops.knn_per_type(
        vector_queries(spark, sf), vector_chunks(spark, sf), query_block=256, chunk_block=256
    )
    return _rounded(hits)


@query(
    "knn_prefiltered",
    f"""{_PAIRS}, own AS (SELECT *, row_number() OVER (PARTITION BY query_id, manual_type ORDER BY d, chunk_id) AS place
      FROM pairs WHERE ata04 = wanted), near AS (SELECT * EXCLUDE (place), 1 / (1 + d) AS score, row_number() OVER
      (PARTITION BY query_id ORDER BY 1 / (1 + d) DESC, manual_type, chunk_id) AS rank FROM own WHERE place <= 3)
    SELECT {_OUT} FROM near WHERE rank <= 3""",
)
def knn_prefiltered(spark, sf):
    """Only chunks of the query's own code are searched."""
    return _rounded(ops.knn_by_ata(vector_queries(spark, sf), vector_chunks(spark, sf), prefilter=True))


@query("knn_merged", f"{_PAIRS}, {_per_type(5)}, {_MERGED} SELECT {_OUT} FROM merged WHERE rank <= 15")
def knn_merged(spark, sf):
    hits = ops.knn_per_type(vector_queries(spark, sf), vector_chunks(spark, sf))
    return _rounded(ops.knn_merged(hits, 15))


@query(
    "knn_by_ata",
    f"""{_PAIRS}, {_per_type(9)}, {_MERGED}, own AS (SELECT * EXCLUDE (rank), row_number() OVER
      (PARTITION BY query_id ORDER BY score DESC, manual_type, chunk_id) AS rank FROM merged WHERE rank <= 27 AND ata04 = wanted)
    SELECT {_OUT} FROM own WHERE rank <= 3""",
)
def knn_by_ata(spark, sf):
    return _rounded(ops.knn_by_ata(vector_queries(spark, sf), vector_chunks(spark, sf)))


@query(
    "rag_derive_ata",
    f"""{_PAIRS}, {_per_type(3)}, votes AS (SELECT query_id, ata04, count(*) AS votes, max(score) AS score FROM per_type GROUP BY query_id, ata04),
    best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, score DESC, ata04) AS n FROM votes)
    SELECT query_id, ata04, votes, round(score, 6) AS score FROM best WHERE n = 1""",
)
def rag_derive_ata(spark, sf):
    hits = ops.knn_per_type(vector_queries(spark, sf), vector_chunks(spark, sf), k=ops.DERIVE_TOP_K)
    return ops.derive_ata(hits).select("query_id", "ata04", "votes", F.round("score", 6).alias("score"))


@query(
    "rag_cascade",
    f"""{_PAIRS}, {_per_type(3)}, votes AS (SELECT query_id, manual_type, ata04, count(*) AS votes, max(score) AS score
      FROM per_type WHERE ata04 IS NOT NULL GROUP BY query_id, manual_type, ata04),
    best AS (SELECT *, row_number() OVER (PARTITION BY query_id, manual_type ORDER BY votes DESC, score DESC, ata04) AS n FROM votes),
    sure AS (SELECT *, CASE manual_type WHEN 'TSM' THEN 1 WHEN 'FIM' THEN 2 ELSE 3 END AS stage FROM best WHERE n = 1 AND score >= 0.5),
    firsts AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY stage) AS m FROM sure)
    SELECT query_id, manual_type, CAST(stage AS INTEGER) AS stage, ata04, votes, round(score, 6) AS score FROM firsts WHERE m = 1""",
)
def rag_cascade(spark, sf):
    """Codes from TSM chunks first; queries without a sure answer go on to FIM, then AMM."""
    found = ops.derive_ata_cascade(vector_queries(spark, sf), vector_chunks(spark, sf))
    return found.select("query_id", "manual_type", "stage", "ata04", "votes", F.round("score", 6).alias("score"))


@query(
    "chunk_lookup",
    f"""WITH {CHUNKS_SQL} SELECT k.key_id, c.chunk_id, c.manual_type, c.ata04 FROM
      (SELECT vec_id AS key_id, vec_id + vec_id % 2 * (SELECT count(*) FROM embeddings) AS chunk_id,
         CASE (vec_id + vec_id % 2) % 3 WHEN 0 THEN 'TSM' WHEN 1 THEN 'FIM' ELSE 'AMM' END AS manual_type FROM embeddings
       UNION ALL SELECT -1 - chunk_id, chunk_id, manual_type FROM chunks) k
      JOIN chunks c USING (chunk_id, manual_type)""",
)
def chunk_lookup(spark, sf):
    """Every chunk is asked for, besides keys of unknown ids and of wrong types."""
    chunks = vector_chunks(spark, sf).drop("embedding")
    many = table(spark, sf, "embeddings").count()
    wrong = table(spark, sf, "embeddings").selectExpr(
        "vec_id AS key_id",
        f"vec_id + vec_id % 2 * {many} AS chunk_id",
        "CASE (vec_id + vec_id % 2) % 3 WHEN 0 THEN 'TSM' WHEN 1 THEN 'FIM' ELSE 'AMM' END AS manual_type",
    )
    right = chunks.selectExpr("-1 - chunk_id AS key_id", "chunk_id", "manual_type")
    return ops.chunk_lookup(wrong.unionByName(right), chunks)


@query(
    "index_statistics",
    f"""WITH {CHUNKS_SQL} SELECT coalesce(manual_type, 'ALL') AS manual_type, count(*) AS vectors,
      CAST(max(len(embedding)) AS INTEGER) AS dimension FROM chunks GROUP BY GROUPING SETS ((manual_type), ())""",
)
def index_statistics(spark, sf):
    return ops.index_statistics(vector_chunks(spark, sf))


@query("index_types", f"WITH {CHUNKS_SQL} SELECT DISTINCT manual_type FROM chunks")
def index_types(spark, sf):
    return ops.index_types(vector_chunks(spark, sf))


_MISSING = "chunk_id % 10 = 3"


@query(
    "embedding_fallback",
    f"""WITH {CHUNKS_SQL} SELECT chunk_id, {_MISSING} AS is_fallback, 64 AS n,
      round(CASE WHEN {_MISSING} THEN 0.0 ELSE list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) END, 6) AS total FROM chunks""",
)
def embedding_fallback(spark, sf):
    gaps = vector_chunks(spark, sf).withColumn(
        "embedding", F.when(~F.expr(_MISSING), F.col("embedding"))
    )
    total = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return ops.with_fallback(gaps, 64).select(
        "chunk_id", "is_fallback", F.size("embedding").alias("n"), F.round(total, 6).alias("total")
    )


@query(
    "chunk_sink_sharded",
    f"""WITH {CHUNKS_SQL}, placed AS (SELECT chunk_id, manual_type, ata04,
      row_number() OVER (PARTITION BY manual_type ORDER BY chunk_id) - 1 AS position FROM chunks)
    SELECT chunk_id, manual_type, ata04, position, position // 100 AS shard,
      count(*) OVER (PARTITION BY manual_type, position // 100) AS shard_rows FROM placed""",
)
def chunk_sink_sharded(spark, sf):
    """All chunks in shards of exactly 100 rows per type, numbered by chunk id, and read back with their files."""
    path = new_path(spark, "chunks")
    tables.write_chunk_shards(vector_chunks(spark, sf), path, shard_size=100)
    read = tables.read_chunks(spark, path).withColumn("file", F.input_file_name())
    per_file = read.groupBy("manual_type", "shard").agg(
        F.count(F.lit(1)).alias("shard_rows"), F.count_distinct("file").alias("files")
    )
    # One file per shard: a shard in two files would show up as a row with files > 1 and break the SQL's count.
    joined = read.join(per_file.where("files = 1"), ["manual_type", "shard"])
    return joined.select("chunk_id", "manual_type", "ata04", "position", "shard", "shard_rows")


@query("chunk_source_merged", f"WITH {CHUNKS_SQL} SELECT chunk_id, manual_type, ata04 FROM chunks WHERE manual_type = 'TSM'")
def chunk_source_merged(spark, sf):
    path = new_path(spark, "chunks")
    tables.write_chunks(vector_chunks(spark, sf), path, shard_size=100)
    return tables.read_chunks(spark, path, ["TSM"]).select("chunk_id", "manual_type", "ata04")
