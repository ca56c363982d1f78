"""Exact duplicates by content sort.

Sampled splitters range-partition the texts, an external sort puts equal texts
next to each other, and neighbours are compared in full. The splitter key is
bounded: the first characters of the text, then its SHA-256 digest, then a salt;
whole texts never travel to the driver as splitters.

A text with more copies than ``max(HOT_ROWS, rows / HOT_TEXTS)`` is hot. There are
at most HOT_TEXTS such texts by that definition, so their table (digest, count,
identifier to keep) is broadcast; each is cut into salts of that many rows.
Copies within a salt are compared in full, salts of one text are tied together by
the digest, length included in it.

Defined cases: null text counts as empty. Of equal texts exactly one row is
kept: the one with the largest (or smallest) identifier; null identifiers rank
last; of rows equal in text and identifier one is kept. Extra columns travel
inside ``row``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hangarflow.llm.texts import carried

HOT_ROWS = 1_000
HOT_TEXTS = 10_000
SPLITTER_CHARACTERS = 32


def content_sort(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    keep: str = "smallest",
    normalise: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """``row`` with text_sha256, keep_id, group_size and kept, one per input row."""
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")

    def normalised(text: Column) -> Column:
        text = F.coalesce(text.cast("string"), F.lit(""))
        return normalise(text) if normalise else text

    content = normalised(F.col(text_column))
    chosen = F.max if keep == "largest" else F.min

    hot_rows = max(HOT_ROWS, docs.count() // HOT_TEXTS)
    hot = (
        docs.select(F.sha2(content, 256).alias("digest"), F.col(id_column).alias("id"))
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("hot_size"), chosen("id").alias("hot_keep"))
        .where(F.col("hot_size") > hot_rows)
    )
    keyed = carried(
        docs,
        id=F.col(id_column),
        head=F.substring(content, 1, SPLITTER_CHARACTERS),
        digest=F.sha2(content, 256),
    ).join(F.broadcast(hot), "digest", "left")
    salts = F.ceil(F.col("hot_size") / hot_rows)
    ranged = keyed.select(
        "*",
        F.when(F.col("hot_size").isNotNull() & F.col("id").isNotNull(), F.pmod(F.xxhash64("id"), salts))
        .otherwise(F.lit(0))
        .cast("int")
        .alias("salt"),
    ).repartitionByRange("head", "digest", "salt")
    # Taken from the row on this side of the shuffle, so each text moves once.
    ranged = ranged.withColumn("content", normalised(F.col("row").getField(text_column)))

    order = F.col("id").desc_nulls_last() if keep == "largest" else F.col("id").asc_nulls_last()
    # The range partitioning already holds equal keys together, so no second shuffle follows.
    equal = Window.partitionBy("head", "digest", "salt", "content").orderBy(order)
    whole = equal.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return ranged.select(
        "row",
        "id",
        F.col("digest").alias("text_sha256"),
        F.row_number().over(equal).alias("place"),
        F.coalesce("hot_keep", F.first("id").over(whole)).alias("keep_id"),
        F.coalesce("hot_size", F.count(F.lit(1)).over(whole)).alias("group_size"),
    ).select(
        "row",
        "text_sha256",
        "keep_id",
        "group_size",
        ((F.col("place") == 1) & F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"),
    )
