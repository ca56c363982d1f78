"""Quality rules as a short-circuit cascade, in Spark SQL functions only.

Each document gets its base figures (words, characters in words, symbols,
duplicate lines, words in repeated 3-word windows) and then a verdict: the base
test first, then the rules of ``RULES``, each a condition that rejects. The rules
are evaluated in one ``CASE WHEN`` so that a document stops at the first rule
that rejects it; their order changes what is computed, never the verdict.

The order comes from a sample: the first rows of a Bernoulli sample, reached
with an incremental limit (only the first partitions are read), are asked for
each rule's rejections while the job is timed; the rules then run by rejected
share per second, most first. Rules that reject nothing on the sample run last,
cheapest first. Everything else covers all rows.

Per document, all figures come from arrays of the document itself: words by one
split, duplicate lines as lines minus distinct lines (hash set), repeated windows
by sorting the window strings with their positions and comparing neighbours, so
a text of n words costs O(n log n) in one task and nothing is shuffled.

Defined cases: a null text has no words and no lines (all figures 0, base
failed). Texts are whole, however long. Lines split at ``\\n`` only; a line counts
when it holds a word and is compared raw. Ties and repeated rows are judged
alike, each row on its own. Extra columns travel inside ``row``; an empty table
gives an empty result without sampling.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hangarflow.llm.texts import BLANKS, carried, words

# --- fixed values: base test and the rules' thresholds -------------------------------
MIN_WORDS = 50
MAX_REPEAT_SHARE = 50  # percent of words in repeated 3-word windows
SYMBOLS = "[#*$%&|<>]"
MIN_MEAN_WORD, MAX_MEAN_WORD = 3, 10
MAX_SYMBOL_RATIO = 0.1
MAX_DUP_LINE_SHARE = 0.3
MIN_ALPHA_WORD_SHARE = 0.8
MAX_ELLIPSIS_LINE_SHARE = 0.3
MAX_BULLET_LINE_SHARE = 0.9
# --- end of fixed values -------------------------------------------------------------

SAMPLE_FRACTION = 0.05
SAMPLE_ROWS = 2_000
SAMPLE_SEED = 12
TIMINGS = 3

_HAS_WORD = f"[^{BLANKS}]"


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(_HAS_WORD))


def _windows(w: Column) -> Column:
    """The 3-word windows of ``w`` with their positions, sorted by window."""
    windows = F.transform(
        F.sequence(F.lit(0), F.size(w) - 3),
        lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("t"), i.alias("p")),
    )
    return F.when(F.size(w) >= 3, F.sort_array(windows)).otherwise(F.array().cast("array<struct<t:string,p:int>>"))


def _repeat_words(ordered: Column) -> Column:
    """Word positions covered by a window that occurs twice or more; ``ordered`` is a column, not an expression."""

    def same(j: Column, k: Column) -> Column:
        return F.coalesce(F.get(ordered, j)["t"] == F.get(ordered, k)["t"], F.lit(False))

    repeated = F.filter(
        F.transform(ordered, lambda x, j: F.when(same(j, j - 1) | same(j, j + 1), x["p"])),
        lambda p: p.isNotNull(),
    )
    covered = F.array_distinct(F.flatten(F.transform(repeated, lambda p: F.array(p, p + 1, p + 2))))
    return F.size(covered).cast("long")


def base_figures(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``row`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    staged = carried(docs, _text=text, _words=words(text), _lines=_lines(text))
    # Each array is a column of its own before a lambda reads it by position: an
    # expression in its place would be evaluated again for every element.
    staged = staged.select("*", _windows(F.col("_words")).alias("_windows"))
    figured = staged.select(
        "row",
        "_text",
        "_words",
        "_lines",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("_text", f"[{BLANKS}]", "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.regexp_replace("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("_windows")).alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_SHARE * F.col("n_words"))
    return figured.withColumn("base_failed", failed)


def _share(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole, F.lit(1))


def _mean_word(f: DataFrame) -> Column:
    mean = _share(F.col("word_chars"), F.col("n_words"))
    return (mean < MIN_MEAN_WORD) | (mean > MAX_MEAN_WORD)


def _symbols(f: DataFrame) -> Column:
    return _share(F.col("n_symbols"), F.col("n_words")) > MAX_SYMBOL_RATIO


def _dup_lines(f: DataFrame) -> Column:
    return _share(F.col("n_dup_lines"), F.col("n_lines")) > MAX_DUP_LINE_SHARE


def _alpha_words(f: DataFrame) -> Column:
    alpha = F.size(F.filter("_words", lambda word: word.rlike(r"\p{L}")))
    return _share(alpha, F.col("n_words")) < MIN_ALPHA_WORD_SHARE


def _ellipsis_lines(f: DataFrame) -> Column:
    ending = F.size(F.filter("_lines", lambda line: line.rlike(f"(\\.\\.\\.|…)[{BLANKS}]*\\z")))
    return _share(ending, F.col("n_lines")) > MAX_ELLIPSIS_LINE_SHARE


def _bullet_lines(f: DataFrame) -> Column:
    bullets = F.size(F.filter("_lines", lambda line: line.rlike(f"^[{BLANKS}]*[•*-]")))
    return _share(bullets, F.col("n_lines")) > MAX_BULLET_LINE_SHARE


# Name and a condition that rejects. Evaluated after the base test.
RULES: list[tuple[str, Callable[[DataFrame], Column]]] = [
    ("mean_word_length", _mean_word),
    ("symbol_ratio", _symbols),
    ("duplicate_lines", _dup_lines),
    ("alphabetic_words", _alpha_words),
    ("ellipsis_lines", _ellipsis_lines),
    ("bullet_lines", _bullet_lines),
]


def _timed(df: DataFrame) -> tuple[float, list]:
    best, rows = float("inf"), []
    for _ in range(TIMINGS):
        began = time.perf_counter()
        rows = df.collect()
        best = min(best, time.perf_counter() - began)
    return best, rows


def rule_order(
    docs: DataFrame, text_column: str = "text", rules: list[tuple[str, Callable[[DataFrame], Column]]] = RULES
) -> list[tuple[str, float, float]]:
    """(name, rejected share, seconds per sampled row) of each rule, in cascade order.

    The sample is the first SAMPLE_ROWS rows of a SAMPLE_FRACTION Bernoulli sample,
    fetched by an incremental limit; only small values come back to the driver.
    """
    figured = base_figures(docs.sample(fraction=SAMPLE_FRACTION, seed=SAMPLE_SEED), text_column)
    floor_s, base = _timed(figured.select("base_failed").limit(SAMPLE_ROWS))
    if not base:
        return [(name, 0.0, 0.0) for name, _ in rules]
    measured = []
    for name, rule in rules:
        seconds, rows = _timed(figured.select(F.coalesce(rule(figured), F.lit(True)).alias("r")).limit(SAMPLE_ROWS))
        share = sum(r["r"] for r in rows) / len(rows)
        measured.append((name, share, max(seconds - floor_s, 1e-4) / len(rows)))
    return sorted(measured, key=lambda m: (m[1] == 0, -m[1] / m[2] if m[1] else m[2]))


def judge(
    docs: DataFrame,
    text_column: str = "text",
    order: list[str] | None = None,
    rules: list[tuple[str, Callable[[DataFrame], Column]]] = RULES,
) -> DataFrame:
    """``row`` with the base figures, base_failed and kept; ``order`` names the rules in cascade order."""
    if order is None:
        order = [name for name, _, _ in rule_order(docs, text_column, rules)]
    by_name = dict(rules)
    figured = base_figures(docs, text_column)
    verdict = F.when(F.col("base_failed"), F.lit(False))
    for name in order:
        verdict = verdict.when(F.coalesce(by_name[name](figured), F.lit(True)), F.lit(False))
    return figured.select(
        "row",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "n_lines",
        "base_failed",
        verdict.otherwise(F.lit(True)).alias("kept"),
    )
