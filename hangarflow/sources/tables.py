"""Tables this package writes and reads: work orders, catalog, model, registry, chunks."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hangarflow.operators.workorders import require_columns
from hangarflow.schema import REGISTRY

PREVIEW_ROWS = 5
# --- fixed values: rows per index file -------------------------------------------
SHARD_SIZE = 5_000
# --- end of fixed values ----------------------------------------------------------


def read_work_orders(
    spark: SparkSession, path: str, fmt: str = "parquet", multi_line: bool = True
) -> DataFrame:
    """Work orders from CSV or parquet. CSV cells stay text, so codes keep their zeros.

    Texts in CSV may hold line breaks, which makes every file one task; turn
    ``multi_line`` off for files without them and Spark splits the files.
    """
    if fmt == "csv":
        return spark.read.csv(path, header=True, multiLine=multi_line, escape='"')
    return spark.read.format(fmt).load(path)


CORRUPT = "_corrupt_record"


def read_checked_csv(
    spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = True, null_value: str = ""
) -> DataFrame:
    """CSV under a declared schema, good and rejected lines from one pass.

    The cells are read by position under ``schema`` (a header line is skipped), so
    text columns keep leading zeros. A line that does not fit (a cell that does not
    parse as its type, too many or too few cells) becomes a rejected row: its typed
    columns are null, ``rejected`` holds the raw line and ``file`` its file. Good
    rows have ``rejected`` null. Nothing is read twice; split the result with
    ``rejected IS NULL`` after storing it, if both halves are used. ``null_value``
    is the cell that means null; with the default an empty cell is null, so give
    another one (as ``\\N``) for files that hold empty texts apart from missing ones.
    """
    read = (
        spark.read.schema(T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())]))
        .option("header", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("multiLine", multi_line)
        .option("escape", '"')
        .option("nullValue", null_value)
        .csv(path)
    )
    good = F.col(CORRUPT).isNull()
    return read.select(
        *[F.when(good, F.col(f"`{field.name}`")).alias(field.name) for field in schema],
        F.col(CORRUPT).alias("rejected"),
        F.col("_metadata.file_path").alias("file"),
    )


def load_work_orders(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Read work orders and refuse tables without the required columns."""
    return require_columns(read_work_orders(spark, path, fmt))


def preview(df: DataFrame, rows: int = PREVIEW_ROWS) -> DataFrame:
    return df.limit(rows)


# --- fixed values: stem of exported result tables -------------------------------------
RESULT_STEM = "WO_ATA_checked_"
# --- end of fixed values ---------------------------------------------------------------


def write_results(results: DataFrame, folder: str, fmt: str = "parquet") -> str:
    """Write the result table below ``folder`` under a timestamped name."""
    stamp = datetime.now(timezone.utc).strftime("%Y%m%d_%H%M%S_%f")
    path = f"{folder.rstrip('/')}/{RESULT_STEM}{stamp}"
    options = {"header": "true", "escape": '"'} if fmt == "csv" else {}
    results.write.format(fmt).options(**options).save(path)
    return path


def write_catalog(catalog: DataFrame, path: str, fmt: str = "json") -> None:
    catalog.write.mode("overwrite").format(fmt).save(path)


def read_catalog(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Saved catalog; Spark reports a missing path itself."""
    return (
        spark.read.format(fmt)
        .schema(
            "ata04 string, system_name string, keywords array<string>,"
            " warnings array<string>, sample_descriptions array<string>"
        )
        .load(path)
    )


def write_model(vocabulary: DataFrame, vectors: DataFrame, path: str) -> None:
    vocabulary.write.mode("overwrite").parquet(f"{path}/vocabulary")
    vectors.write.mode("overwrite").parquet(f"{path}/vectors")


def read_model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/vocabulary"), spark.read.parquet(f"{path}/vectors")


def append_references(references: DataFrame, path: str) -> int:
    """Append registry rows and return how many, counted while writing."""
    rows = references.withColumns(
        {"is_active": F.lit(True), "created_at": F.current_timestamp()}
    ).select(*REGISTRY.fieldNames())
    added = Observation("added")
    rows.observe(added, F.count(F.lit(1)).alias("rows")).write.mode("append").parquet(path)
    return added.get["rows"]


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REGISTRY).parquet(path)


def clear_registry(spark: SparkSession, path: str) -> None:
    """Delete all references; the table stays readable."""
    spark.createDataFrame([], REGISTRY).write.mode("overwrite").parquet(path)


def write_chunks(chunks: DataFrame, path: str, shard_size: int = SHARD_SIZE) -> None:
    """Append index rows, one folder per manual type, at most ``shard_size`` rows per file."""
    (
        chunks.write.mode("append")
        .option("maxRecordsPerFile", shard_size)
        .partitionBy("manual_type")
        .parquet(path)
    )


def write_chunk_shards(chunks: DataFrame, path: str, shard_size: int = SHARD_SIZE, order: str = "chunk_id") -> None:
    """Index rows in shards of exactly ``shard_size`` rows per manual type (the last one fewer), one file each.

    Rows are numbered within their type in ``order`` by prefix sums on two levels:
    a range partitioning by (type, order) cuts the rows into sorted runs, the
    driver adds up one count per run and type (partitions x types numbers), and
    each row takes its run's offset plus its place in the run. The shard is the
    number divided by ``shard_size``; rows of one shard go to one task, so each
    shard is one file ``manual_type=../shard=../``, its rows by ``position``.
    Equal ``order`` values keep the order of the range sort (ties broken by the
    other columns' hash), so give a unique key.
    """
    from hangarflow.session import stored

    spark = chunks.sparkSession
    runs = int(spark.conf.get("spark.sql.shuffle.partitions"))
    part = F.spark_partition_id().cast("long")
    ranged = chunks.repartitionByRange(runs, "manual_type", order).sortWithinPartitions("manual_type", order)
    placed = stored(
        ranged.select("*", part.alias("_run"), (F.monotonically_increasing_id() - F.shiftleft(part, 33)).alias("_at")),
        "shards-placed",
    )
    counts = sorted(
        (r["_run"], r["manual_type"], r["n"], r["first"])
        for r in placed.groupBy("_run", "manual_type").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("first")).collect()
    )
    seen, offsets = {}, []
    for run, manual_type, n, first in counts:
        offsets.append((run, manual_type, seen.get(manual_type, 0) - first))
        seen[manual_type] = seen.get(manual_type, 0) + n
    table = spark.createDataFrame(offsets, "_run long, manual_type string, _shift long")
    position = (F.col("_at") + F.col("_shift")).alias("position")
    numbered = placed.join(F.broadcast(table), ["_run", "manual_type"]).select(
        *chunks.columns, position, (position / shard_size).cast("long").alias("shard")
    ) if offsets else placed.select(*chunks.columns, F.lit(0).cast("long").alias("position"), F.lit(0).cast("long").alias("shard"))
    (
        numbered.repartition("manual_type", "shard")
        .sortWithinPartitions("manual_type", "shard", "position")
        .write.mode("append")
        .partitionBy("manual_type", "shard")
        .parquet(path)
    )


def read_chunks(spark: SparkSession, path: str, manual_types: list[str] | None = None) -> DataFrame:
    """All shards together; a type list prunes folders."""
    chunks = spark.read.parquet(path)
    return chunks if manual_types is None else chunks.where(F.col("manual_type").isin(manual_types))
