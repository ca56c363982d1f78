"""Manuals to catalog, model, registry rows, and index chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hangarflow.operators import catalog as catalog_ops
from hangarflow.operators import documents, tfidf
from hangarflow.plans.reconcile import CatalogModel
from hangarflow.session import stored


def build_catalog(
    docs: DataFrame,
    keywords_per_tag: int = catalog_ops.KEYWORDS_PER_TAG,
    training_descriptions: int = catalog_ops.TRAINING_DESCRIPTIONS,
    saved_caps: dict[str, int] | None = None,
    **fit,
) -> CatalogModel:
    """Catalog and model of markup documents ``(filename, markup)``.

    The manuals are read once: their distinct values are written to the shared
    folder, and the catalog and the model are both made from that table. ``fit``
    takes ``stop_words``, ``range_digits`` and the limits of the vocabulary.
    """
    parsed = documents.parse_documents(docs)
    items = stored(catalog_ops.catalog_items(parsed, keywords_per_tag), "catalog-items")
    vocabulary, vectors = tfidf.fit(catalog_ops.training_lines(items, training_descriptions), **fit)
    saved = stored(catalog_ops.saved_catalog(items, caps=saved_caps), "catalog")
    stop_words = fit.get("stop_words", tfidf.ENGLISH_STOP_WORDS)
    return CatalogModel(saved, vocabulary, vectors, tuple(stop_words))


def build_index(docs: DataFrame, manual_type: Column | None = None, **split):
    """Registry rows and index chunks of documents ``(manual_type, filename, markup)``.

    The parsed documents are written to the shared folder, so both outputs
    come from one reading.
    """
    parsed = documents.identify(documents.parse_documents(docs))
    parsed = stored(parsed, "parsed-documents")
    manual_type = F.col("manual_type") if manual_type is None else manual_type
    references = documents.document_references(parsed, manual_type)
    return references, documents.manual_chunks(parsed, **split)
