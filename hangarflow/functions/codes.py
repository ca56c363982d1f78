"""Chapter-section codes and task numbers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hangarflow.functions.text import strip


def null_if_empty(col: Column) -> Column:
    return F.when(col != "", col)


def normalize_ata(code: Column) -> Column:
    """``dd-dd`` from the first four digits; NULL when there are fewer."""
    digits = F.regexp_replace(code.cast("string"), "[^0-9]", "")
    return F.when(
        F.length(digits) >= 4,
        F.concat(F.substring(digits, 1, 2), F.lit("-"), F.substring(digits, 3, 2)),
    )


def normalize_ata_echo(code: Column) -> Column:
    """Like :func:`normalize_ata`, but a short code comes back trimmed."""
    return F.coalesce(normalize_ata(code), strip(code.cast("string")), F.lit(""))


def validate_ata_format(code: Column) -> Column:
    """``dddd``, ``dd-dd`` or either followed by ``-dd``."""
    return F.coalesce(code.cast("string").rlike(r"^\d{2}-?\d{2}(-\d{2})?$"), F.lit(False))


def validate_ata_strict(code: Column) -> Column:
    """Exactly ``dd-dd``."""
    return F.coalesce(code.rlike(r"^\d{2}-\d{2}$"), F.lit(False))


def normalize_task_number(task: Column) -> Column:
    """Task number as ``AA-BB-CC[-DDD[-EEE]]``.

    Dashed input keeps its pieces; a plain digit run is cut 2-2-2-3-3 and an
    incomplete last piece is left out. Missing pieces up to the third are ``00``.
    """
    clean = F.regexp_replace(task, "[^0-9-]", "")
    cuts = [(1, 2), (3, 2), (5, 2), (7, 3), (10, 3)]
    fixed_width = F.array_compact(
        F.array(
            *[
                F.when(F.length(clean) >= start + width - 1, F.substring(clean, start, width))
                for start, width in cuts
            ]
        )
    )
    pieces = F.when(F.contains(clean, F.lit("-")), F.split(clean, "-", -1)).otherwise(fixed_width)
    missing = F.greatest(F.lit(0), F.lit(3) - F.size(pieces))
    padded = F.concat(pieces, F.array_repeat(F.lit("00"), missing))
    return F.array_join(F.slice(padded, 1, 5), "-")


def _two_groups(text: Column, pattern: str) -> Column:
    first, second = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)
    return F.when(first != "", F.concat(first, F.lit("-"), second))


def ata_from_filename_loose(filename: Column) -> Column:
    """First two digit pairs anywhere in the path, joined by ``-``, ``_`` or nothing."""
    return _two_groups(filename, r"(\d{2})[_-]?(\d{2})")


def ata_from_filename_strict(filename: Column) -> Column:
    """Separated digit pairs first, then a run of exactly four inner digits."""
    return F.coalesce(
        _two_groups(filename, r"(\d{2})[_-](\d{2})"),
        _two_groups(filename, r"[^\d](\d{2})(\d{2})[^\d]"),
    )


def zero_fill(code: Column, width: int) -> Column:
    """Left-pad with zeros; a longer value is kept whole."""
    return F.when(F.length(code) < width, F.lpad(code, width, "0")).otherwise(code)


def text_fingerprint(defect: Column, action: Column) -> Column:
    """Short fingerprint of a (defect, action) text pair."""
    return F.substring(F.sha1(F.concat(defect, F.lit("|"), action)), 1, 16)


def pair_key(defect: Column, action: Column) -> Column:
    """Full-length digest of a (defect, action) text pair; NULL when either is."""
    return F.sha2(F.concat(F.length(defect).cast("string"), F.lit("|"), defect, action), 256)


def text_key(text: Column) -> Column:
    """Full-length digest used as join key for texts."""
    return F.sha2(text, 256)
