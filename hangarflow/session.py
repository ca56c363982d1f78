"""Session defaults, the shared work folder, and size-checked joins."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# Session setting: spread each given table over so many partitions before anything else.
# For small test files of one row group, which Spark cannot split; unset on a cluster.
INPUT_PARTITIONS = "spark.hangarflow.inputPartitions"


def local_session(
    cores: str | int = 8, app_name: str = "hangarflow", shared: str | None = None
) -> SparkSession:
    """A local session for tests and benchmarks; ``shared`` is its folder for stored results."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config(INPUT_PARTITIONS, str(cores))
    )
    if shared:
        builder = builder.config("spark.checkpoint.dir", shared)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, from ``spark.checkpoint.dir``.

    Only a local master may go without: its stored results lie in the warehouse folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/hangarflow/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write a result to the shared folder and read it back.

    This cuts the lineage in a way that survives lost executors, and the files
    give the optimizer the true size of the table. ``options`` go to the writer.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lookup_join(left: DataFrame, right: DataFrame, on: Sequence[str], shuffle: bool = False) -> DataFrame:
    """Left join to a table with one row per key, safe for very frequent and for NULL keys.

    By default this is one plain left join, so ``left`` is computed once. Spark
    chooses its kind from the size of ``right``: a broadcast join moves no row of
    ``left`` at all, NULL keys included; in a shuffled join, adaptive execution
    splits the partition of a key that many left rows share, the one of NULL keys
    too. ``shuffle`` asks for the shuffled join, as for a table too big to
    broadcast; then rows with a NULL key are split off by a filter and never
    shuffled, and ``left`` appears once per branch, so store an expensive one.
    """
    on = list(on)
    if not shuffle:
        return left.join(right, on, "left")
    any_null = reduce(or_, [F.col(name).isNull() for name in on])
    added = [
        F.lit(None).cast(field.dataType).alias(field.name) for field in right.schema if field.name not in on
    ]
    found = left.where(~any_null).join(right.hint("merge"), on, "left")
    return found.unionByName(left.where(any_null).select("*", *added))
