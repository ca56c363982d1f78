"""Training documents from raw ones: the stages below, each over what its predecessor kept.

Every stage is written as Parquet below the shared folder and read again, so a
lost executor never costs more than one stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hangarflow.llm import byte_bpe, exact_dedup, jaccard, language_id, mixture
from hangarflow.llm.queries import MIX_SHARE, SOURCE_WEIGHTS
from hangarflow.llm.texts import carried
from hangarflow.session import stored


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter in their text; null texts and texts without a letter go.

    That is the only rejection: the operator calls just these texts undetermined, so neither the
    predicted language nor its score, learned from the documents' own ``lang``, drops another row.
    The filters are fitted and asked over all texts; the rows equal those of a search for a letter.
    """
    filters = language_id.fit(docs)
    if not filters.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    rows = carried(docs, lang=language_id.predict(spark, filters)["lang"])
    return rows.where(F.col("lang") != language_id.UNDETERMINED).select("row.*")


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays: the one with the largest doc_id."""
    return exact_dedup.content_sort(docs, keep="largest").where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones stays: the one with the smallest doc_id."""
    return jaccard.one_of_each(docs)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, to the nearest whole number of copies."""
    sized = mixture.sizes(docs)
    sources = mixture.targets(sized, SOURCE_WEIGHTS, MIX_SHARE)
    taken = mixture.taken_words(mixture.mix(sized, sources), sources)
    return mixture.repeat_documents(docs, taken)


def byte_bpe_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and whether decoding them gives the text back."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    decoded = byte_bpe.encode(docs, path, public_tokenizers.PATTERN, decoded=True)
    text = F.coalesce(F.col("row.text"), F.lit("")).cast("binary")
    return decoded.select(
        F.col("row.doc_id").alias("doc_id"),
        F.col("row.source").alias("source"),
        "ids",
        (F.col("decoded") == text).alias("round_trip"),
    )


STAGES = [
    ("language", known_language),
    ("exact dedup", exact_duplicates),
    ("near duplicates", near_duplicates),
    ("source mixture", source_mixture),
    ("byte BPE", byte_bpe_ids),
]

# Language prediction, the mix's hash order and BPE cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
