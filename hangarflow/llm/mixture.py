"""Mixing sources to target weights by a low-discrepancy schedule.

The mix is a sequence of slots. Slot ``j`` takes the golden-ratio point
``frac((j + 1) / phi)`` and falls into the source whose share of the cumulative
targets, counted in blocks, holds it, so every stretch of slots carries the shares
almost exactly. Slots are ranked per source. Each source's documents stand in a
hash-shuffled order and are cut into blocks of equal word counts; the r-th slot of
a source takes its r-th block, starting over after the last, ``MAX_PASSES`` times
at most.

A block holds 1/64 of the source's target, between 1 and ``block_words`` words, and
each source gets the slots of its quota exactly: what the schedule gives beyond it
is left out, what is missing follows at the end. So a source misses its target by
half a block at most, however small it is.

Running sums are taken in two levels, inside bounded hash buckets and then over
bucket totals, so a source with a third of all rows never meets in one task.

Defined cases: null text has no words; documents without words take no part and
have 0 words taken. A null source is a source of its own, last in order. Repeated
rows are documents of their own. An empty table gives no rows. Only named columns
are read, so extra columns cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hangarflow.llm.texts import carried, text_or_empty, word_count
from hangarflow.session import stored

MAX_PASSES = 2
INVERSE_PHI = (math.sqrt(5) - 1) / 2
BUCKET_ROWS = 4_096
GRID = 4_096
LEAST_BLOCKS = 64  # in a target of at least as many words


def sizes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """doc_id, source and size in words, written once because both plans below read it."""
    return stored(
        docs.select(
            F.col(id_column).alias("doc_id"),
            F.col(source_column).alias("source"),
            word_count(text_or_empty(text_column)).alias("size"),
        ),
        "mixture-sizes",
    )


def targets(sized: DataFrame, weights: Sequence[float], share: float, block_words: int = 128) -> DataFrame:
    """One row per source: source_size, target, block_words, quota in slots, and its interval of the cumulative quotas.

    Written once because the mix and its counts both read it. A target stops at MAX_PASSES times the source's size and the rest is shared
    again by weight: with sources ordered by size per weight, the level of the
    others is the largest of "what is left over the weights that are left".
    """
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source
    place = F.row_number().over(by_name)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(place - 1, F.lit(len(weights))) + 1)
    ranked = per_source.select("*", place.alias("place"), weight.alias("weight"))
    limit = F.col("source_size") * float(MAX_PASSES)
    by_need = Window.orderBy(F.col("need"), F.col("place"))
    everything = Window.partitionBy()
    level = (
        ranked.withColumn("need", limit / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything) * float(share))
        .withColumn("before", F.coalesce(F.sum(limit).over(by_need.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weights_left", F.sum("weight").over(by_need.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", F.max((F.col("total") - F.col("before")) / F.col("weights_left")).over(everything))
        .withColumn("target", F.least(limit, F.greatest(F.lit(0.0), F.col("level") * F.col("weight"))))
    )
    words = F.greatest(F.lit(1), F.least(F.lit(block_words), F.floor(F.col("target") / LEAST_BLOCKS))).cast("long")
    # Whole passes take every block, the last one of a pass with fewer words than the others.
    passes = F.floor(F.col("target") / F.col("source_size"))
    rest = F.round((F.col("target") - passes * F.col("source_size")) / F.col("block_words"))
    quota = F.when(F.col("source_size") > 0, passes * _blocks("block_words") + rest).otherwise(0).cast("long")
    by_place = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    planned = (
        level.withColumn("block_words", words)
        .withColumn("quota", quota)
        .withColumn("upto", F.sum("quota").over(by_place))
        .withColumn("all_slots", F.max("upto").over(everything))
        .withColumn("high", F.when(F.col("all_slots") > 0, F.col("upto") / F.col("all_slots")).otherwise(F.lit(0.0)))
        .withColumn("low", F.lag("high", 1, 0.0).over(Window.orderBy("place")))
    )
    return stored(
        planned.select("source", "source_size", "target", "block_words", "quota", "low", "high"), "mixture-targets"
    )


def _blocks(block_words: int | str) -> Column:
    words = F.col(block_words) if isinstance(block_words, str) else F.lit(block_words)
    return F.ceil(F.col("source_size") / words)


def _running(df: DataFrame, keys: list[str], bucket: str, order: Sequence[Column], value: Column) -> DataFrame:
    """Adds ``before``: the sum of ``value`` over earlier rows of the key, in two levels."""
    inner = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, bucket).agg(F.sum(value).alias("bucket_sum"))
    offsets = totals.select(
        *[F.col(k).alias(f"{k}_") for k in [*keys, bucket]],
        F.coalesce(F.sum("bucket_sum").over(outer), F.lit(0)).alias("offset"),
    )
    same = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in [*keys, bucket]]
    return (
        df.withColumn("inside", F.coalesce(F.sum(value).over(inner), F.lit(0)))
        .join(offsets, same)
        .withColumn("before", F.col("inside") + F.col("offset"))
        .drop("inside", "offset", *[f"{k}_" for k in [*keys, bucket]])
    )


def schedule(spark, sources: DataFrame, slots: int, block_words: int | str, grid: int = GRID) -> DataFrame:
    """slot, source, rank (from 0) and block of each slot; ``block_words`` may name a column of ``sources``."""
    point = F.pmod((F.col("slot") + 1) * F.lit(INVERSE_PHI), F.lit(1.0))
    points = spark.range(slots).select(
        F.col("id").alias("slot"), point.alias("point"), F.floor(point * grid).cast("int").alias("cell")
    )
    # Each interval lies in the grid cells it touches: one row per source plus one per cell.
    cells = sources.where(F.col("high") > F.col("low")).select(
        "source",
        _blocks(block_words).alias("blocks"),
        "low",
        "high",
        F.explode(F.sequence(F.floor(F.col("low") * grid).cast("int"), F.floor(F.col("high") * grid).cast("int"))).alias("cell"),
    )
    placed = points.join(cells, "cell").where((F.col("point") >= F.col("low")) & (F.col("point") < F.col("high")))
    chunked = placed.select("slot", "source", "blocks", F.floor(F.col("slot") / BUCKET_ROWS).alias("chunk"))
    ranked = _running(chunked, ["source"], "chunk", [F.col("slot")], F.lit(1))
    return ranked.where(F.col("before") < F.col("blocks") * MAX_PASSES).select(
        "slot", "source", F.col("before").alias("rank"), F.pmod(F.col("before"), F.col("blocks")).alias("block")
    )


def settle(slots: DataFrame, sources: DataFrame, end: int) -> DataFrame:
    """The slots with exactly ``quota`` of each source: later ones go, missing ones are numbered from ``end`` on.

    The schedule is off by a few slots a source, so the added rows stay near the number of sources.
    """
    quotas = sources.select(F.col("source").alias("source_"), "quota", _blocks("block_words").alias("blocks"))
    same = F.col("source").eqNullSafe(F.col("source_"))
    within = slots.join(quotas, same).where(F.col("rank") < F.col("quota")).select("slot", "source", "rank", "block")
    placed = slots.groupBy("source").agg(F.count(F.lit(1)).alias("placed"))
    found = F.coalesce(F.col("placed"), F.lit(0).cast("long"))
    lacking = quotas.join(placed, same, "left").where(found < F.col("quota"))
    ranks = lacking.select(
        F.col("source_").alias("source"), "blocks", F.explode(F.sequence(found, F.col("quota") - 1)).alias("rank")
    )
    number = F.row_number().over(Window.orderBy("rank", F.col("source").asc_nulls_last()))
    added = ranks.select(
        (number + F.lit(end - 1)).cast("long").alias("slot"), "source", "rank", F.pmod("rank", "blocks").alias("block")
    )
    return within.unionByName(added)


def pieces(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """Documents cut along their source's blocks: start, block, first word and words of each piece.

    What lies behind the last block that the quota reaches is one piece. A document
    without words is one row whose block is null.
    """
    rows = sized.count()
    shuffled = sized.select(
        "*",
        F.xxhash64(F.lit("mixture"), "doc_id").alias("shuffle"),
    ).withColumn("bucket", F.pmod("shuffle", F.lit(max(1, rows // BUCKET_ROWS))))
    order = [F.col("shuffle"), F.col("doc_id"), F.col("size")]
    placed = _running(shuffled, ["source"], "bucket", order, F.col("size")).withColumnRenamed("before", "start")
    plan = sources.select(F.col("source").alias("source_"), "block_words", F.least("quota", _blocks("block_words")).alias("used"))
    planned = placed.join(plan, F.col("source").eqNullSafe(F.col("source_")))
    words = F.col("block_words")
    first = F.least(F.col("used"), F.floor(F.col("start") / words))
    last = F.least(F.col("used"), F.floor((F.col("start") + F.col("size") - 1) / words))
    cut = planned.select(
        "doc_id",
        "source",
        "size",
        "start",
        "block_words",
        "used",
        F.explode_outer(F.when(F.col("size") > 0, F.sequence(first, last))).alias("block"),
    )
    begin = F.greatest(F.col("start"), F.col("block") * words)
    upto = F.col("start") + F.col("size")
    end = F.when(F.col("block") < F.col("used"), F.least(upto, (F.col("block") + 1) * words)).otherwise(upto)
    return cut.select("*", (begin - F.col("start")).alias("first_word"), (end - begin).alias("words")).drop("block_words", "used")


def mix(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """The mix: one row per slot and piece of a document, plus one row with a null slot for each piece never taken."""
    spark = sized.sparkSession
    end, count = sources.agg(F.coalesce(F.sum("quota"), F.lit(0)), F.count(F.lit(1))).first()
    slots = settle(schedule(spark, sources, end, "block_words", max(GRID, count)), sources, end)
    cut = pieces(sized, sources).alias("p")
    same = F.col("p.source").eqNullSafe(F.col("s.source")) & (F.col("p.block") == F.col("s.block"))
    return cut.join(slots.alias("s"), same, "left").select("p.*", "s.slot", "s.rank")


def taken_words(mixed: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per document: what the mix takes of it, repeats counted, and its source's target."""
    per_document = mixed.groupBy("doc_id", "source", "size", "start").agg(
        F.sum(F.when(F.col("slot").isNotNull(), F.col("words")).otherwise(0)).alias("taken"),
        F.count(F.lit(1)).alias("parts"),
    )
    # Empty documents of one identifier and place may repeat: one row for each.
    copies = F.when(F.col("size") > 0, F.lit(1)).otherwise(F.col("parts"))
    spread = per_document.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), copies.cast("long"))))
    known = sources.select(F.col("source").alias("source_"), "source_size", "target")
    return spread.join(known, F.col("source").eqNullSafe(F.col("source_"))).select(
        "doc_id", "source", F.col("size").cast("long"), F.col("source_size").cast("long"), "target", F.col("taken").cast("long")
    )


def repeat_documents(docs: DataFrame, taken: DataFrame, id_column: str = "doc_id", source_column: str = "source") -> DataFrame:
    """Rows of ``docs`` as often as the mix takes them, halves rounded up; documents never taken go.

    Rows that share identifier and source are taken alike.
    """
    counts = taken.groupBy(F.col("doc_id").alias("doc_id_"), F.col("source").alias("source_")).agg(
        F.max(F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0)).cast("int").alias("copies")
    )
    keyed = carried(docs, id=F.col(id_column), source=F.col(source_column))
    same = F.col("id").eqNullSafe(F.col("doc_id_")) & F.col("source").eqNullSafe(F.col("source_"))
    kept = keyed.join(counts.where("copies > 0"), same)
    return kept.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
