"""Registry of manual references: batch lookups, statistics, validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hangarflow.functions.citations import extract_citations
from hangarflow.session import lookup_join


def exists(keys: DataFrame, registry: DataFrame, typed: bool = False, **join) -> DataFrame:
    """Add ``ref_exists`` to rows that carry ``task_number`` (and ``manual_type``)."""
    on = ["task_number", "manual_type"] if typed else ["task_number"]
    known = registry.select(*on).dropna("any").distinct().withColumn("_known", F.lit(True))
    return (
        lookup_join(keys, known, on, **join)
        .withColumn("ref_exists", F.col("_known").isNotNull())
        .drop("_known")
    )


def one_per_task(registry: DataFrame) -> DataFrame:
    """One row per task number: the lowest (manual type, file name).

    ``min_by`` keeps one row per task before the shuffle, where a ranking
    window would move and sort every duplicate.
    """
    names = [c for c in registry.columns if c != "task_number"]
    first = F.min_by(F.struct(*names), F.struct("manual_type", "filename")).alias("ref")
    return registry.groupBy("task_number").agg(first).select("task_number", "ref.*")


def get_reference(keys: DataFrame, registry: DataFrame, **join) -> DataFrame:
    """Reference details per requested task number, NULL when unknown."""
    return lookup_join(
        keys, one_per_task(registry), ["task_number"], **join
    )


def search_by_ata(registry: DataFrame, codes: list[str] | DataFrame | None = None) -> DataFrame:
    """References of the given codes (all codes when None), ordered by type and task.

    ``codes`` is a short list or a table whose first column holds the codes; a table
    meets the registry in a semi-join, so any number of codes is asked at once and
    a code asked many times still returns its references once.
    """
    if isinstance(codes, DataFrame):
        asked = codes.select(F.col(codes.columns[0]).alias("ata04")).where(F.col("ata04").isNotNull()).distinct()
        rows = registry.join(asked, "ata04", "left_semi")
    else:
        rows = registry if codes is None else registry.where(F.col("ata04").isin(codes))
    return rows.select("ata04", "manual_type", "task_number", "title").orderBy(
        "ata04", "manual_type", "task_number", "title"
    )


def statistics(registry: DataFrame) -> DataFrame:
    """Rows and distinct codes per manual type, and overall as type ``ALL``.

    Counting per (type, code) first leaves at most a few thousand rows for the
    grouping sets and the distinct count.
    """
    per_code = registry.groupBy("manual_type", "ata04").agg(F.count(F.lit(1)).alias("n"))
    return (
        per_code.groupingSets([["manual_type"], []], "manual_type")
        .agg(
            F.sum("n").alias("total_references"),
            F.count_distinct("ata04").alias("unique_atas"),
            F.grouping_id().alias("level"),
        )
        .select(
            F.when(F.col("level") == 1, F.lit("ALL"))
            .otherwise(F.col("manual_type"))
            .alias("manual_type"),
            "total_references",
            "unique_atas",
        )
    )


def cited(work_orders: DataFrame, key: str, text: str) -> DataFrame:
    """One row per citation, with its position in the list."""
    return work_orders.select(
        key, F.posexplode(extract_citations(F.col(text))).alias("citation_pos", "citation")
    ).select(key, "citation_pos", "citation.*")


def validate_citations(
    citations: DataFrame, registry: DataFrame | None = None, **join
) -> DataFrame:
    """Add ``cited_exists``; without a registry every citation counts as valid."""
    if registry is None:
        return citations.withColumn("cited_exists", F.lit(True))
    return exists(citations, registry, typed=True, **join).withColumnRenamed(
        "ref_exists", "cited_exists"
    )
