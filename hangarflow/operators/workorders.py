"""Work-order table operators: columns, filter, reuse of equal texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hangarflow.functions.codes import normalize_ata_echo, pair_key
from hangarflow.functions.decisions import NON_DEFECT_CONFIDENCE
from hangarflow.functions.defects import with_verdict
from hangarflow.functions.text import strip
from hangarflow.schema import COLUMN_MAPPING, REQUIRED_COLUMNS, RESULT_COLUMNS
from hangarflow.session import lookup_join

TEXT_FIELDS = ["Defect_Text", "Rectification_Text", "WO_Type", "AC_Registration"]
DATE_FIELDS = ["Open_Date", "Close_Date"]


def missing_columns(df: DataFrame) -> list[str]:
    """Required columns the table lacks, in interface order."""
    return [name for name in REQUIRED_COLUMNS if name not in df.columns]


def require_columns(df: DataFrame) -> DataFrame:
    """Return the table, or refuse it before any job runs."""
    missing = missing_columns(df)
    if missing:
        raise ValueError("missing required columns: " + ", ".join(missing))
    return df


def column_report(df: DataFrame) -> DataFrame:
    """Presence and non-blank row count of each required column, in one pass."""
    present = [name for name in REQUIRED_COLUMNS if name in df.columns]
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[
            F.count_if(strip(F.col(f"`{n}`").cast("string")) != "").alias(n) for n in present
        ],
    )
    rows = [
        F.struct(
            F.lit(name).alias("column"),
            F.lit(name in present).alias("present"),
            (F.col(f"`{name}`") if name in present else F.lit(0)).cast("long").alias("filled"),
        )
        for name in REQUIRED_COLUMNS
    ]
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def map_columns(df: DataFrame) -> DataFrame:
    """Rename the interface columns to internal names; others keep theirs."""
    return df.withColumnsRenamed({k: v for k, v in COLUMN_MAPPING.items() if k in df.columns})


def passthrough_columns(df: DataFrame) -> list[str]:
    """Input columns carried to the result; a clash with a result column is an error."""
    extra = [name for name in df.columns if name not in COLUMN_MAPPING]
    clash = sorted(set(extra) & set(RESULT_COLUMNS))
    if clash:
        raise ValueError("input columns named like result columns: " + ", ".join(clash))
    return extra


def fill_fields(mapped: DataFrame) -> DataFrame:
    """Work-order fields as text, blank where missing; the code in echo form."""
    filled = {
        name: F.coalesce(F.col(name).cast("string"), F.lit(""))
        if name in mapped.columns
        else F.lit("")
        for name in TEXT_FIELDS + DATE_FIELDS
    }
    code = F.col("ATA04_Entered") if "ATA04_Entered" in mapped.columns else F.lit("")
    return mapped.withColumns({"ATA04_Entered": normalize_ata_echo(code), **filled})


def flag_defects(df: DataFrame, filter_non_defect: bool = True) -> DataFrame:
    """Add ``Is_Technical_Defect`` and ``Non_Defect_Reason``."""
    if not filter_non_defect:
        return df.withColumns(
            {
                "Is_Technical_Defect": F.lit(True),
                "Non_Defect_Reason": F.lit(None).cast("string"),
            }
        )
    return with_verdict(
        df, "Defect_Text", "Rectification_Text", "Is_Technical_Defect", "Non_Defect_Reason"
    )


def non_defect_outcome(code: Column, reason: Column) -> Column:
    """Decision struct of a routine work order."""
    return F.struct(
        F.lit("NON_DEFECT").alias("decision"),
        code.alias("ata04_final"),
        F.lit(NON_DEFECT_CONFIDENCE).alias("confidence"),
        F.concat(F.lit("Non-technical: "), reason).alias("reason"),
    )


def distinct_texts(df: DataFrame, *texts: str) -> DataFrame:
    """Distinct text combinations with their row count.

    The partial count leaves one row per text and input split, so a text that
    fills a third of the table costs no more than any other.
    """
    return df.groupBy(*texts).agg(F.count(F.lit(1)).alias("copies"))


def first_row_decision(
    results: DataFrame, order: str, decision_columns: list[str], **join
) -> DataFrame:
    """Give rows with equal texts the decision of the first of them.

    The first row per pair of texts is found by a partial aggregate and joined back.
    Texts are told apart by their full digests; the short fingerprint is too short for that.
    """
    keyed = results.withColumn("_print", pair_key(F.col("Defect_Text"), F.col("Rectification_Text")))
    first = (
        keyed.groupBy("_print")
        .agg(F.min_by(F.struct(*decision_columns), order).alias("_first"))
    )
    joined = lookup_join(keyed.drop(*decision_columns), first, ["_print"], **join)
    return joined.select(
        *[
            F.col(f"_first.{name}").alias(name) if name in decision_columns else F.col(name)
            for name in results.columns
        ]
    )
