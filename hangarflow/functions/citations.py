"""Manual citations (TSM/FIM/AMM task numbers) in free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hangarflow.functions.codes import null_if_empty

# --- fixed values: citation patterns, in order of precedence -----------------
TYPED = r"\b(TSM|FIM|AMM)\s*(\d{2})-(\d{2})-(\d{2})(?:-(\d{3}))?(?:-(\d{3}))?\b"
COMPACT = r"\b(TSM|FIM|AMM)(\d{2})-?(\d{2})-?(\d{2})(?:-?(\d{3}))?(?:-?(\d{3}))?\b"
STANDALONE = r"\b(\d{2})-(\d{2})-(\d{2})(?:-(\d{3}))?(?:-(\d{3}))?\b"
KEYWORD = r"\b(?:task|ref|reference)\s*:?\s*(TSM|FIM|AMM)?\s*(\d{2})-?(\d{2})-?(\d{2})\b"
PATTERNS = [TYPED, COMPACT, STANDALONE, KEYWORD]
DEFAULT_TYPE = "TSM"
# --- end of fixed values -----------------------------------------------------

# Position of the digits of a match: chapter, section, subject, two subsections.
_DIGIT_CUTS = [(1, 2), (3, 2), (5, 2), (7, 3), (10, 3)]
# Every form contains three digit pairs; texts without them skip all patterns.
_HAS_DIGITS = r"(?U)\d{2}-?\d{2}-?\d{2}"


def _flagged(pattern: str) -> str:
    return "(?iU)" + pattern


def _parse(raw: Column, pattern: str) -> Column:
    """Citation struct from one raw match of ``pattern``.

    A match holds no digits but those of the task number, whose parts have
    fixed widths, so cutting them is enough.
    """
    if pattern == STANDALONE:
        manual_type = F.lit(DEFAULT_TYPE)
    elif pattern == KEYWORD:
        named = null_if_empty(F.regexp_extract(F.upper(raw), "TSM|FIM|AMM", 0))
        manual_type = F.coalesce(named, F.lit(DEFAULT_TYPE))
    else:
        manual_type = F.upper(F.substring(raw, 1, 3))

    def cut(digits: Column) -> Column:
        parts = [null_if_empty(F.substring(digits, *where)) for where in _DIGIT_CUTS]
        return F.struct(
            manual_type.alias("manual_type"),
            F.concat_ws("-", *parts).alias("task_number"),
            F.concat_ws("-", *parts[:2]).alias("ata04"),
            *[
                part.alias(name)
                for part, name in zip(
                    parts, ("chapter", "section", "subject", "subsection1", "subsection2")
                )
            ],
            raw.alias("raw_match"),
        )

    # The one-element array binds the digits to a lambda variable.
    return F.element_at(F.transform(F.array(F.regexp_replace(raw, r"(?U)\D", "")), cut), 1)


def extract_citations(text: Column, dedup_by_span: bool = False) -> Column:
    """Array of citation structs: pattern order, then position, first per key wins.

    ``dedup_by_span`` lets a later pattern see only what earlier ones have not
    matched, so one mention gives one citation.
    """

    def parsed_matches(pattern: str, rest: Column) -> Column:
        matches = F.regexp_extract_all(rest, F.lit(_flagged(pattern)), F.lit(0))
        return F.transform(matches, lambda raw: _parse(raw, pattern))

    rests = [text]
    for pattern in PATTERNS[:-1]:
        rests.append(F.regexp_replace(rests[-1], _flagged(pattern), "|") if dedup_by_span else text)
    found = F.concat(*[parsed_matches(pattern, rest) for pattern, rest in zip(PATTERNS, rests)])

    def key(citation: Column) -> Column:
        return F.concat(citation["manual_type"], F.lit("-"), citation["task_number"])

    def first_per_key(pack: Column) -> Column:
        return F.filter(
            pack["found"],
            lambda c, i: F.array_position(pack["keys"], key(c)) == i + 1,
        )

    def with_keys(citations: Column) -> Column:
        return F.struct(citations.alias("found"), F.transform(citations, key).alias("keys"))

    # Both one-element arrays bind an intermediate result to a lambda variable.
    packed = F.transform(F.array(found), with_keys)
    deduped = F.element_at(F.transform(packed, first_per_key), 1)
    return F.when(text.rlike(_HAS_DIGITS), deduped).otherwise(F.filter(found, lambda _: F.lit(False)))


def first_citation(text: Column) -> Column:
    """The leading citation as a struct, NULL when the text has none.

    Equals element 1 of :func:`extract_citations`, but later patterns run only
    when the earlier ones found nothing.
    """

    def attempt(pattern: str) -> Column:
        raw = F.regexp_extract(text, _flagged(pattern), 0)
        parsed = F.transform(F.array(raw), lambda m: F.when(m != "", _parse(m, pattern)))
        return F.element_at(parsed, 1)

    return F.when(text.rlike(_HAS_DIGITS), F.coalesce(*[attempt(p) for p in PATTERNS]))


def extract_ata04(text: Column) -> Column:
    """Chapter-section of the leading citation."""
    return first_citation(text)["ata04"]
