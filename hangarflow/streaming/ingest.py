"""Incremental reading of new manual files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hangarflow.operators import documents

DOCS = T.StructType(
    [
        T.StructField("manual_type", T.StringType()),
        T.StructField("filename", T.StringType()),
        T.StructField("markup", T.StringType()),
    ]
)


def new_files(
    spark: SparkSession, path: str, schema: T.StructType = DOCS, glob: str | None = None
) -> DataFrame:
    """Stream over parquet files of documents; each file is read once per checkpoint."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def ingest_available(stream: DataFrame, output: str, checkpoint: str) -> None:
    """Append everything not read yet to ``output`` and stop.

    The checkpoint remembers the files already taken and the sink commits each
    batch once, so a run that died continues without gaps or repeats.
    """
    query = (
        stream.writeStream.format("parquet")
        .option("path", output)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def index_available(stream: DataFrame, output: str, checkpoint: str, **split) -> None:
    """Append chunks and references of the documents not indexed yet.

    Each batch is parsed once and stored; references and chunks are written from
    that table. All three folders carry the number of the batch and replace it when
    a batch runs again, so a run that died leaves no gaps and no repeats.
    """

    def index(batch: DataFrame, number: int) -> None:
        folder = f"batch={number}"
        parsed_path = f"{output}/parsed/{folder}"
        identified = documents.identify(documents.parse_documents(batch))
        identified.write.mode("overwrite").parquet(parsed_path)
        parsed = batch.sparkSession.read.parquet(parsed_path)
        references = documents.document_references(parsed, F.col("manual_type"))
        references.write.mode("overwrite").parquet(f"{output}/references/{folder}")
        chunks = documents.manual_chunks(parsed, **split)
        chunks.write.mode("overwrite").parquet(f"{output}/chunks/{folder}")

    (
        stream.writeStream.foreachBatch(index)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


def read_index(spark: SparkSession, output: str) -> tuple[DataFrame, DataFrame]:
    """References and chunks written by :func:`index_available`."""
    return tuple(spark.read.parquet(f"{output}/{name}").drop("batch") for name in ("references", "chunks"))
