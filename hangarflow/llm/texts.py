"""Words of a text, and rows carried whole beside computed columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values ---------------------------------------------------------
BLANKS = r"\x20\x09-\x0D"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
# --- end of fixed values ----------------------------------------------------


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Runs of characters other than blank, tab and line ends."""
    return F.filter(F.split(text, f"[{BLANKS}]+"), lambda word: word != "")


def word_count(text: Column) -> Column:
    """Number of words, without building them: a word starts where a blank run ends."""
    blanks = " \t\n\x0b\x0c\r"
    plain = F.translate(text, blanks, " " * len(blanks))
    return F.when(F.trim(plain) == "", F.lit(0)).otherwise(F.size(F.split(F.trim(plain), " +"))).cast("long")


def bucket_of_id(name: str, modulus: int) -> Column:
    """crc32 of the identifier written as text, modulo; null for a null identifier."""
    return F.pmod(F.crc32(F.col(name).cast("string").cast("binary")), F.lit(modulus))


def carried(docs: DataFrame, **computed: Column) -> DataFrame:
    """The whole row as the struct ``row`` beside computed columns.

    Extra input columns of any name live inside the struct, so they cannot clash
    with what an operator computes.
    """
    return docs.select(
        F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("row"),
        *[column.alias(name) for name, column in computed.items()],
    )


def rows_again(df: DataFrame, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Undo :func:`carried`."""
    return (keep(df) if keep else df).select("row.*")
