"""Reports over the result table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hangarflow.functions.codes import validate_ata_format
from hangarflow.functions.text import strip


def _count_if(condition) -> "F.Column":
    return F.count_if(F.coalesce(condition, F.lit(False)))


def summary_metrics(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count(F.lit(1)).alias("total_wos"),
        _count_if(F.col("Is_Technical_Defect")).alias("technical_defects"),
        _count_if(F.col("Decision") == "CONFIRM").alias("confirm"),
        _count_if(F.col("Decision") == "REVIEW").alias("review"),
    )


def decision_breakdown(results: DataFrame) -> DataFrame:
    return (
        results.groupBy("Decision")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "Decision")
    )


def confidence_histogram(results: DataFrame, bins: int = 20) -> DataFrame:
    """Rows per confidence bin of equal width over [0, 1]."""
    bucket = F.least(F.floor(F.col("Confidence") * bins), F.lit(bins - 1)).cast("int")
    return (
        results.where(F.col("Confidence").isNotNull())
        .groupBy(bucket.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("bin_start", F.col("bin") / F.lit(float(bins)))
    )


def filter_results(
    results: DataFrame, decisions: list[str] | None = None, defects: bool | None = None
) -> DataFrame:
    """Rows with one of the decisions and the wanted defect status; None keeps all."""
    if decisions is not None:
        results = results.where(F.col("Decision").isin(decisions))
    if defects is not None:
        results = results.where(F.col("Is_Technical_Defect") == defects)
    return results


def accuracy(results: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """Share of labelled work orders whose final code equals the label."""
    hit = F.coalesce((F.col("ATA04_Final") == F.col(label)).cast("int"), F.lit(0))
    return (
        results.select(key, "ATA04_Final")
        .join(labels.select(key, label), key)
        .agg(
            F.count(F.lit(1)).alias("labelled"),
            F.sum(hit).alias("correct"),
            F.avg(hit).alias("accuracy"),
        )
    )


def review_rate(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count(F.lit(1)).alias("total_wos"),
        F.avg((F.col("Decision") == "REVIEW").cast("int")).alias("review_rate"),
    )


def input_quality(work_orders: DataFrame) -> DataFrame:
    """Counts of rows that fail the input checklist."""
    return work_orders.agg(
        F.count(F.lit(1)).alias("total_wos"),
        _count_if(~validate_ata_format(F.col("ATA"))).alias("bad_code"),
        F.count_if(~F.coalesce(F.col("Issued") < F.col("Closed"), F.lit(False))).alias("bad_dates"),
        F.count_if(strip(F.coalesce("W/O Description", F.lit(""))) == "").alias("no_description"),
    )
