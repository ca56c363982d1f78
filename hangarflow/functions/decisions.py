"""Reconciliation of the entered, cited and derived codes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from hangarflow.functions.codes import normalize_ata
from hangarflow.schema import DECISIONS

# --- fixed values: score bands, confidences and limits ------------------------
SCORE_BANDS = [(0.8, 0.88), (0.6, 0.83), (0.4, 0.78), (0.2, 0.73)]
LOWEST_BAND = 0.68
DEFAULT_THRESHOLD = 0.75
WEAK_SCORE = 0.3
STRONG_CONFIDENCE = 0.85
NON_DEFECT_CONFIDENCE = 0.99
# --- end of fixed values -----------------------------------------------------


# --- fixed values: reasons, in the order of the rules ---------------------------------
ALL_AGREE = "All sources agree (E0=E1=E2)"
AGREE_AGAINST_ENTERED = "Citation and derived agree on %s, differs from entered %s"
CATALOG_CONFIRMS = "Catalog confirms entered ATA (score: %s)"
CITATION_CONFIRMS = "Valid citation confirms entered ATA"
CITATION_DIFFERS = "Valid citation %s differs from entered %s"
CATALOG_SUGGESTS = "Catalog suggests %s (score: %s)"
LOW_CONFIDENCE = "Low catalog confidence (score: %s)"
CITATION_AGAINST_CATALOG = "Citation confirms E0=%s, catalog suggests %s"
STRONG_CATALOG = "Strong catalog confirms E0=%s, citation suggests %s"
CONFLICT = "Conflict: citation=%s, catalog=%s"
ALL_DIFFER = "All differ: E0=%s, citation=%s, catalog=%s"
NO_MATCH = "No citation or catalog match found"
INSUFFICIENT = "Insufficient data for decision"
# --- end of fixed values ----------------------------------------------------------------


def e2_confidence(score: Column) -> Column:
    """Confidence band of a catalog score; NULL counts as the lowest band."""
    # Highest band first: when() keeps the first hit.
    branch = F.when(score >= SCORE_BANDS[0][0], F.lit(SCORE_BANDS[0][1]))
    for floor, confidence in SCORE_BANDS[1:]:
        branch = branch.when(score >= floor, F.lit(confidence))
    return branch.otherwise(F.lit(LOWEST_BAND))


def _outcome(decision: str, final: Column, confidence, reason: Column) -> Column:
    conf = confidence if isinstance(confidence, Column) else F.lit(float(confidence))
    return F.struct(
        F.lit(decision).alias("decision"),
        final.alias("ata04_final"),
        conf.alias("confidence"),
        reason.alias("reason"),
    )


def _first_rule(rules: list[tuple[Column, Column]], otherwise: Column) -> Column:
    (condition, value), *rest = rules
    chain = reduce(lambda acc, rule: acc.when(*rule), rest, F.when(condition, value))
    return chain.otherwise(otherwise)


def reconcile(
    e0: Column, e1: Column, e2: Column, score: Column, threshold: float = DEFAULT_THRESHOLD
) -> Column:
    """Ordered decision rules over codes that are already ``dd-dd`` or NULL.

    ``e1`` must be NULL unless the citation is valid. Use
    :func:`make_decision` for raw codes.
    """
    has0, has1, has2 = e0.isNotNull(), e1.isNotNull(), e2.isNotNull()
    e0_is_e1, e0_is_e2 = e0.eqNullSafe(e1), e0.eqNullSafe(e2)
    e1_is_e2 = has1 & e1.eqNullSafe(e2)
    points = F.coalesce(score, F.lit(0.0))
    confidence = e2_confidence(score)
    no_usable_e2 = ~has2 | ((points != 0) & (points < WEAK_SCORE))
    e2_alone = has2 & ~has1 & (points >= WEAK_SCORE)
    shown0 = F.coalesce(e0, F.lit("None"))
    shown_score = F.format_string("%.2f", points)

    def say(template: str, *args: Column) -> Column:
        return F.format_string(template, *args) if args else F.lit(template)

    rules = [
        (
            has0 & e1_is_e2 & e0_is_e1,
            _outcome("CONFIRM", e0, 0.97, say(ALL_AGREE)),
        ),
        (
            e1_is_e2,
            _outcome(
                "CORRECT",
                e1,
                0.95,
                say(AGREE_AGAINST_ENTERED, e1, shown0),
            ),
        ),
        (
            has0 & ~has1 & e0_is_e2,
            _outcome(
                "CONFIRM", e0, confidence, say(CATALOG_CONFIRMS, shown_score)
            ),
        ),
        (
            has1 & no_usable_e2 & e0_is_e1,
            _outcome("CONFIRM", e0, 0.92, say(CITATION_CONFIRMS)),
        ),
        (
            has1 & no_usable_e2,
            _outcome(
                "CORRECT", e1, 0.90, say(CITATION_DIFFERS, e1, shown0)
            ),
        ),
        (
            e2_alone & (confidence >= threshold),
            _outcome(
                "CORRECT", e2, confidence, say(CATALOG_SUGGESTS, e2, shown_score)
            ),
        ),
        (
            e2_alone,
            _outcome(
                "REVIEW", e0, confidence, say(LOW_CONFIDENCE, shown_score)
            ),
        ),
        (
            has1 & has2 & e0_is_e1,
            _outcome(
                "CONFIRM", e0, 0.88, say(CITATION_AGAINST_CATALOG, e1, e2)
            ),
        ),
        (
            has1 & has2 & e0_is_e2 & (confidence >= STRONG_CONFIDENCE),
            _outcome(
                "CONFIRM",
                e0,
                0.85,
                say(STRONG_CATALOG, e2, e1),
            ),
        ),
        (
            has1 & has2 & e0_is_e2,
            _outcome("REVIEW", e0, 0.70, say(CONFLICT, e1, e2)),
        ),
        (
            has1 & has2,
            _outcome(
                "REVIEW",
                e0,
                0.65,
                say(ALL_DIFFER, shown0, e1, e2),
            ),
        ),
        (
            has0 & ~has2,
            _outcome("REVIEW", e0, 0.65, say(NO_MATCH)),
        ),
    ]
    return _first_rule(
        rules, _outcome("REVIEW", e0, 0.50, say(INSUFFICIENT))
    )


def make_decision(
    e0: Column,
    e1: Column,
    e1_valid: Column,
    e2: Column,
    e2_score: Column,
    threshold: float = DEFAULT_THRESHOLD,
) -> Column:
    """Struct ``(decision, ata04_final, confidence, reason)`` from raw codes."""
    # A NULL validity flag falls through when() and leaves e1 NULL.
    inputs = F.array(
        F.struct(
            normalize_ata(e0).alias("e0"),
            F.when(e1_valid, normalize_ata(e1)).alias("e1"),
            normalize_ata(e2).alias("e2"),
            e2_score.cast("double").alias("score"),
        )
    )
    return F.element_at(
        F.transform(
            inputs, lambda x: reconcile(x["e0"], x["e1"], x["e2"], x["score"], threshold)
        ),
        1,
    )


def validate_decision(decision: Column, confidence: Column) -> Column:
    """Known decision and a confidence inside [0, 1]."""
    return F.coalesce(
        decision.isin(DECISIONS) & (confidence >= 0) & (confidence <= 1), F.lit(False)
    )
