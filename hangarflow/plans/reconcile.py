"""Work orders to decisions: filter, cite, derive, decide."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hangarflow.functions.citations import first_citation
from hangarflow.functions.codes import normalize_ata, text_key
from hangarflow.functions.decisions import DEFAULT_THRESHOLD, reconcile
from hangarflow.functions.text import ENGLISH_STOP_WORDS, strip
from hangarflow.operators import tfidf, vectors
from hangarflow.operators.workorders import (
    distinct_texts,
    fill_fields,
    flag_defects,
    map_columns,
    non_defect_outcome,
    passthrough_columns,
)
from hangarflow.schema import RESULT_COLUMNS
from hangarflow.session import lookup_join, stored


@dataclass(frozen=True)
class CatalogModel:
    """The tables that catalog mode compares texts with."""

    catalog: DataFrame
    vocabulary: DataFrame
    vectors: DataFrame
    stop_words: Sequence[str] = tuple(ENGLISH_STOP_WORDS)


_DERIVED = ["ATA04_Derived", "Derived_DocType", "Derived_Score", "Evidence_Snippet", "Evidence_Source"]


def derive_from_catalog(texts: DataFrame, model: CatalogModel) -> DataFrame:
    """Derived columns for distinct texts ``(text_key, Defect_Text)``, hits only."""
    best = tfidf.predict_ata(
        texts,
        "text_key",
        model.vocabulary,
        model.vectors,
        model.catalog,
        text="Defect_Text",
        stop_words=model.stop_words,
    )
    return best.select(
        "text_key",
        F.col("ata04").alias("ATA04_Derived"),
        F.lit("CATALOG").alias("Derived_DocType"),
        F.col("score").alias("Derived_Score"),
        F.coalesce("system_name", F.lit("")).alias("Evidence_Snippet"),
        F.lit("ATA Catalog").alias("Evidence_Source"),
    )


def derive_from_chunks(text_vectors: DataFrame, chunks: DataFrame, **search) -> DataFrame:
    """Derived columns from the nearest manual chunks, for ``mode='rag'``.

    ``text_vectors(text_key, embedding)`` holds the vectors of the distinct
    defect texts. The code is the majority of the nearest chunks over all
    manual types; the snippet is the text of its nearest chunk, or the chunk's
    identifier when ``chunks`` has no text.
    """
    queries = text_vectors.select(F.col("text_key").alias("query_id"), "embedding")
    hits = vectors.knn_per_type(queries, chunks, k=vectors.DERIVE_TOP_K, **search)
    best = vectors.derive_ata(hits)
    snippet = F.col("chunk_id").cast("string")
    if "text" in chunks.columns:
        texts = chunks.groupBy("chunk_id").agg(F.min("text").alias("_text"))
        best, snippet = best.join(texts, "chunk_id", "left"), F.coalesce("_text", F.lit(""))
    return best.select(
        F.col("query_id").alias("text_key"),
        F.col("ata04").alias("ATA04_Derived"),
        F.lit("RAG").alias("Derived_DocType"),
        F.col("score").alias("Derived_Score"),
        snippet.alias("Evidence_Snippet"),
        F.lit("Manual chunks").alias("Evidence_Source"),
    )


def _without_derived(df: DataFrame) -> DataFrame:
    nothing = F.lit(None)
    return df.withColumns(
        {
            name: nothing.cast("double" if name == "Derived_Score" else "string")
            for name in _DERIVED
        }
    )


def process_work_orders(
    work_orders: DataFrame,
    key: str,
    model: CatalogModel | None = None,
    mode: str = "catalog",
    registry: DataFrame | None = None,
    filter_non_defect: bool = True,
    threshold: float = DEFAULT_THRESHOLD,
    derived: DataFrame | None = None,
    **join,
) -> DataFrame:
    """Decision per work order, with the interface's result columns and all extra columns.

    ``key`` names an input column that identifies the rows. ``mode='catalog'``
    derives codes from ``model``; ``mode='rag'`` derives none unless
    ``derived(text_key, ATA04_Derived, ...)`` is given. A registry turns
    ``Cited_Exists`` into a real lookup; without one every citation is valid.

    Only distinct texts of technical defects are scored, and the scores are
    written to the shared folder before they meet the work orders again, so
    the join knows their true size. The flagged rows are written too.
    """
    if mode not in ("catalog", "rag"):
        raise ValueError(f"unknown mode: {mode}")
    extra = passthrough_columns(work_orders)
    rows = flag_defects(fill_fields(map_columns(work_orders).drop("ATA04_Final")), filter_non_defect)

    is_defect = F.col("Is_Technical_Defect")
    citation = F.when(is_defect, first_citation(F.col("Rectification_Text")))
    scorable = is_defect & (strip(F.col("Defect_Text")) != "")
    rows = (
        rows.withColumn("_citation", citation)
        .withColumns(
            {
                "ATA04_From_Cited": F.col("_citation.ata04"),
                "Cited_Manual": F.col("_citation.manual_type"),
                "Cited_Task": F.col("_citation.task_number"),
                "text_key": F.when(scorable, text_key(F.col("Defect_Text"))),
            }
        )
        .drop("_citation")
    )

    scores = mode == "catalog" and derived is None and model is not None
    if scores or derived is not None or registry is not None:
        # Patterns and citations run once; every branch below reads what it needs.
        rows = stored(rows, "cited")
    if scores:
        texts = distinct_texts(rows.where("text_key IS NOT NULL").select("text_key", "Defect_Text"), "text_key", "Defect_Text")
        derived = stored(derive_from_catalog(texts, model), "derived")
    rows = (
        _without_derived(rows)
        if derived is None
        else lookup_join(rows, derived, ["text_key"], **join)
    )

    if registry is None:
        rows = rows.withColumn(
            "Cited_Exists", F.when(F.col("ATA04_From_Cited").isNotNull(), F.lit(True))
        )
    else:
        known = (
            registry.select(
                F.col("task_number").alias("Cited_Task"), F.col("manual_type").alias("Cited_Manual")
            )
            .distinct()
            .withColumn("_known", F.lit(True))
        )
        rows = lookup_join(rows, known, ["Cited_Task", "Cited_Manual"], **join)
        rows = rows.withColumn(
            "Cited_Exists",
            F.when(F.col("Cited_Task").isNotNull(), F.coalesce("_known", F.lit(False))),
        )

    # Codes first, rules second: two projections keep every code one expression.
    rows = rows.withColumns(
        {
            "_e0": normalize_ata(F.col("ATA04_Entered")),
            "_e1": F.when(F.col("Cited_Exists"), normalize_ata(F.col("ATA04_From_Cited"))),
            "_e2": normalize_ata(F.col("ATA04_Derived")),
        }
    )
    decided = reconcile(
        F.col("_e0"), F.col("_e1"), F.col("_e2"), F.col("Derived_Score"), threshold
    )
    routine = non_defect_outcome(F.col("ATA04_Entered"), F.col("Non_Defect_Reason"))
    outcome = F.when(is_defect, decided).otherwise(routine)
    return (
        rows.withColumn("_outcome", outcome)
        .withColumns(
            {
                "Derived_Task": F.lit(None).cast("string"),
                "Decision": F.col("_outcome.decision"),
                "ATA04_Final": F.col("_outcome.ata04_final"),
                "Confidence": F.col("_outcome.confidence"),
                "Reason": F.col("_outcome.reason"),
            }
        )
        .select(*RESULT_COLUMNS, *extra)
    )
