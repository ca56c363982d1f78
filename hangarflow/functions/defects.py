"""Routine-maintenance and defect-indicator predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: phrase patterns of the non-defect filter ------------------
NON_DEFECT_PATTERNS = [
    r"\bclean(?:ing|ed)?\b",
    r"\blubrication\b",
    r"\bservicing\b",
    r"\boil\s+replenish(?:ment|ed)?\b",
    r"\bfirst\s+aid\s+kit\b",
    r"\btyre\s+wear\b",
    r"\btire\s+wear\b",
    r"\bscheduled\s+(?:maintenance|inspection|check)\b",
    r"\broutine\s+(?:maintenance|inspection|check)\b",
    r"\bsoftware\s+load(?:ing|ed)?\b",
    r"\bsoftware\s+update\b",
    r"\bnff\b",
    r"\bno\s+fault\s+found\b",
    r"\boperational\s+check\b",
    r"\bfunctional\s+(?:test|check)\b",
    r"\bvisual\s+inspection\b",
    r"\bgeneral\s+inspection\b",
    r"\bperiodic\s+(?:check|inspection)\b",
    r"\breplacement\s+as\s+per\s+schedule\b",
    r"\blife\s+limited\s+part\b",
    r"\bllp\s+replacement\b",
    r"\bcabin\s+(?:cleaning|refurbishment)\b",
    r"\bcosmetic\s+repair\b",
    r"\bseat\s+(?:cleaning|cover)\b",
    r"\bcarpet\s+(?:cleaning|replacement)\b",
    r"\blavatory\s+(?:cleaning|servicing)\b",
    r"\bgalley\s+(?:cleaning|servicing)\b",
    r"\bpassenger\s+(?:seat|entertainment)\s+(?:cleaning|adjustment)\b",
]
DEFECT_OVERRIDE_PATTERNS = [
    r"\bfailure\b",
    r"\bfailed\b",
    r"\bfault\b",
    r"\bfaulty\b",
    r"\bleak(?:ing|age)?\b",
    r"\boverheat(?:ing|ed)?\b",
    r"\bvibration\b",
    r"\becam\b",
    r"\beicas\b",
    r"\bcas\b",
    r"\bwarning\b",
    r"\bsmoke\b",
    r"\binoperative\b",
    r"\binop\b",
    r"\bunserviceable\b",
    r"\bu/s\b",
    r"\bdefect(?:ive)?\b",
    r"\bdamage(?:d)?\b",
    r"\bbroken\b",
    r"\bcrack(?:ed)?\b",
    r"\bcorrosion\b",
    r"\berror\b",
    r"\babnormal\b",
    r"\bmalfunction\b",
    r"\bnot\s+working\b",
    r"\bout\s+of\s+tolerance\b",
    r"\bexceed(?:ed|s)?\s+limit\b",
    r"\bhigh\s+(?:temperature|pressure|vibration)\b",
    r"\blow\s+(?:pressure|oil|fuel)\b",
    r"\bcontamination\b",
    r"\bwear\s+(?:beyond|exceeds)\b",
    r"\bnoise\b",
    r"\bunusual\s+(?:noise|sound|smell)\b",
]
# --- end of fixed values -----------------------------------------------------

_WORD = r"[\p{L}\p{N}_]"


def _any_of(patterns: list[str]) -> str:
    """One pattern for the whole list, in list order.

    Every phrase starts and ends at a word boundary, so the boundary is checked
    once per text position instead of once per phrase. The U flag gives white
    space its Unicode meaning.
    """
    inner = "|".join(p.removeprefix(r"\b").removesuffix(r"\b") for p in patterns)
    return f"(?U)(?<!{_WORD})(?:{inner})(?!{_WORD})"


_NON_DEFECT = _any_of(NON_DEFECT_PATTERNS)
_OVERRIDE = _any_of(DEFECT_OVERRIDE_PATTERNS)


def non_defect_matches(text: Column) -> Column:
    """All routine-maintenance phrases, in text order."""
    return F.regexp_extract_all(F.lower(text), F.lit(_NON_DEFECT), F.lit(0))


def defect_matches(text: Column) -> Column:
    """All defect indicators, in text order."""
    return F.regexp_extract_all(F.lower(text), F.lit(_OVERRIDE), F.lit(0))


def first_indicator(text: Column) -> Column:
    """First defect indicator of a lower-case text, ``''`` when there is none."""
    return F.regexp_extract(text, _OVERRIDE, 0)


def first_routine(text: Column) -> Column:
    """First routine phrase of a lower-case text, ``''`` when there is none."""
    return F.regexp_extract(text, _NON_DEFECT, 0)


def combined_text(description: Column, action: Column) -> Column:
    return F.lower(
        F.concat(F.coalesce(description, F.lit("")), F.lit(" "), F.coalesce(action, F.lit("")))
    )


# --- fixed values: reasons of a verdict --------------------------------------------
FOUND_INDICATOR = "Defect indicator found: '%s'"
FOUND_ROUTINE = "Routine maintenance: '%s'"
FOUND_NOTHING = "Default: no non-defect pattern found"
# --- end of fixed values ----------------------------------------------------------


def verdict_reason(indicator: Column, routine: Column) -> Column:
    return (
        F.when(indicator != "", F.format_string(FOUND_INDICATOR, indicator))
        .when(routine != "", F.format_string(FOUND_ROUTINE, routine))
        .otherwise(F.lit(FOUND_NOTHING))
    )


def with_verdict(
    df: DataFrame, description: str, action: str, flag: str = "is_defect", reason: str = "reason"
) -> DataFrame:
    """Add the defect flag and its reason; an indicator outranks a routine phrase.

    The steps are separate columns, so each pattern runs at most once per row
    inside generated code, and the routine pattern only where no indicator was found.
    """
    text, indicator, routine = F.col("_text"), F.col("_indicator"), F.col("_routine")
    return (
        df.withColumn("_text", combined_text(F.col(description), F.col(action)))
        .withColumn("_indicator", first_indicator(text))
        .withColumn("_routine", F.when(indicator == "", first_routine(text)).otherwise(F.lit("")))
        .withColumns({flag: routine == "", reason: verdict_reason(indicator, routine)})
        .drop("_text", "_indicator", "_routine")
    )
