"""Manual files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

def scan_files(spark: SparkSession, path: str, glob: str = "*.{sgm,sgml}") -> DataFrame:
    """``(filename, markup)`` of the files below a folder whose names fit ``glob``, one row per file.

    Bytes that are no UTF-8 are dropped. Listing and reading are Spark's; small
    files are packed into splits by ``spark.sql.files.maxPartitionBytes``.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .load(path)
    )
    return files.select(F.col("path").alias("filename"), decode("content").alias("markup"))


# --- fixed values: the bundle format ------------------------------------------------
RECORD_END = "</manual>\n"
RECORD_HEAD = '<manual name="'
# --- end of fixed values -------------------------------------------------------------


def write_bundles(manuals: DataFrame, folder: str, records_per_file: int = 100_000) -> None:
    """Manuals ``(filename, markup)`` as text files of many records ``<manual name="..">markup</manual>``.

    Markup must not hold the record end; escaped SGML text cannot (its ``<`` of
    text is written as an entity). Names are written with ``"`` and ``&`` escaped.
    """
    name = F.replace(F.replace(F.col("filename"), F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;"))
    record = F.concat(F.lit(RECORD_HEAD), name, F.lit('">'), F.coalesce(F.col("markup"), F.lit("")))
    manuals.select(record.alias("value")).write.option("lineSep", RECORD_END).option(
        "maxRecordsPerFile", records_per_file
    ).text(folder)


def scan_bundles(spark: SparkSession, path: str) -> DataFrame:
    """``(filename, markup, file, split_start, error)``: one row per record of the bundle files below ``path``.

    Spark's text reader cuts each file into splits of ``spark.sql.files.maxPartitionBytes``
    and ends its records at the record end, reading past a split's end to finish a
    record and skipping the part that the previous split finished; so a file of
    many gigabytes is many tasks and no record is cut. A record that does not start
    with the record head (say a truncated file or stray bytes between records)
    becomes an error row: null name and markup, its first 200 characters in
    ``error``. Bytes that are no UTF-8 are dropped, as in ``scan_files``.
    """
    raw = spark.read.option("lineSep", RECORD_END).text(path)
    value = F.replace(F.make_valid_utf8(F.col("value")), F.lit("\ufffd"), F.lit(""))
    parsed = raw.select(
        value.alias("v"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split_start"),
    ).where(F.col("v") != "")
    head = F.regexp_extract("v", '^<manual name="([^"]*)">', 1)
    fits = F.col("v").startswith(RECORD_HEAD) & (F.locate('">', F.col("v")) > 0)
    name = F.replace(F.replace(head, F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&"))
    return parsed.select(
        F.when(fits, name).alias("filename"),
        F.when(fits, F.expr("substr(v, instr(v, '\">') + 2)")).alias("markup"),
        "file",
        "split_start",
        F.when(~fits, F.substring("v", 1, 200)).alias("error"),
    )


def decode(content: str) -> Column:
    """UTF-8 text of a binary column without its malformed bytes."""
    valid = F.make_valid_utf8(F.col(content).cast("string"))
    return F.replace(valid, F.lit("\ufffd"), F.lit(""))


def not_processed(docs: DataFrame, ledger: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Documents whose ``(manual_type, filename)`` is not in the ledger of earlier runs."""
    keys = keys or ["manual_type", "filename"]
    return docs.join(ledger.select(*keys), keys, "left_anti")
