"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

A bounded sample of the labelled rows (``fit_rows``, chosen by hash) teaches three
things in turn: a lexicon (words and word beginnings that toxic documents use far
more often than others), boosted trees over the features below, and an isotonic map
from the trees' probability to the share of toxic rows, fitted on rows that the
trees have not seen. Every document's features are computed from its whole text.

Features: document length, densities and distinct counts of lexicon hits, hits near
a second-person word, second-person words, capitals, words in capitals, exclamation
and question marks, other punctuation, obfuscated words (symbols or digits among
letters), lexicon hits found only after undoing obfuscation, stretched letters.

Defined cases: null text is empty and is scored like any other. A document labelled
more than once is toxic if any label says so; null labels are ignored. With no
labels, or only one class, the score is the share of toxic labels (0 without any).
With too few rows to calibrate, the trees' own probability is the score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hangarflow.llm.texts import text_or_empty
from hangarflow.session import stored

# Labelled rows learned from, about.
FIT_ROWS = 50_000
# Entries of the lexicon, and what an entry needs: rows, share of toxic rows, log odds.
LEXICON_ENTRIES = 4_096
LEAST_ROWS = 3
LEAST_SHARE = 0.005
LEAST_WEIGHT = 2.5
STEM_LETTERS = 5
NEAR_WORDS = 3
CALIBRATION_PART = 4  # every so-many-th labelled row calibrates
LEAST_CALIBRATION_ROWS = 40
# Part of the uncalibrated probability that keeps the order inside a calibrated step.
ORDER_PART = 0.001

FEATURES = (
    "log_words word_hits stem_hits distinct_hits hit_weight hits_near_you you capitals capital_words exclamations "
    "questions punctuation obfuscated hidden_hits stretched"
).split()

SECOND_PERSON = frozenset(
    "you your yours yourself ur u tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer sie usted ustedes ti tus".split()
)
_WORD = re.compile(r"[^\W_]+")
# Matches start only where a run of letters or of digits and signs starts, and runs are taken
# possessively: the same matches as without, in time linear in the text (a long run was
# scanned again from each of its characters before).
_MIXED = re.compile(
    r"(?<![^\W\d_])[^\W\d_]++(?:[0-9@$*!+|]++[^\W\d_]++)+|(?<![0-9@$])[0-9@$]++[^\W\d_]{2,}(?:[0-9@$*!]+[^\W\d_]*)*"
)
_STRETCHED = re.compile(r"([^\W\d_])\1\1")
_CAPITAL_WORD = re.compile(r"\b[^\W\d_a-z]{3,}\b")
_PLAIN = str.maketrans("01345789@$!+|", "oieasTbgasiti".lower(), "*")


@cache
def _kinds() -> np.ndarray:
    """For each code point: 1 capital letter, 2 other letter, 3 punctuation or symbol, 0 anything else."""
    found = np.zeros(0x110000, np.uint8)
    for code in range(0x110000):
        c = chr(code)
        found[code] = 1 if c.isupper() else 2 if c.isalpha() else 0 if c.isspace() or c.isalnum() else 3
    return found


def features_of(text: str, lexicon: dict[str, float], stems: dict[str, float]) -> list[float]:
    """The numbers named in FEATURES."""
    lower = text.lower()
    words = _WORD.findall(lower)
    many = max(1, len(words))
    hits = [at for at, word in enumerate(words) if word in lexicon]
    stem_hits = [word for word in words if word[:STEM_LETTERS] in stems]
    near = sum(
        any(word in SECOND_PERSON for word in words[max(0, at - NEAR_WORDS) : at + NEAR_WORDS + 1]) for at in hits
    )
    weight = sum(lexicon[words[at]] for at in hits) + 0.5 * sum(stems[word[:STEM_LETTERS]] for word in stem_hits)
    mixed = _MIXED.findall(lower)
    hidden = sum(word.translate(_PLAIN) in lexicon for word in mixed)
    kinds = np.bincount(
        _kinds()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)], minlength=4
    ).tolist() if text else [0, 0, 0, 0]
    letters = max(1, kinds[1] + kinds[2])
    return [
        math.log1p(len(words)),
        len(hits) / many,
        len(stem_hits) / many,
        math.log1p(len({words[at] for at in hits}) + len(set(stem_hits))),
        math.log1p(weight),
        near / many,
        sum(word in SECOND_PERSON for word in words) / many,
        kinds[1] / letters,
        len(_CAPITAL_WORD.findall(text)) / many,
        text.count("!") / many,
        text.count("?") / many,
        kinds[3] / max(1, len(text)),
        len(mixed) / many,
        hidden / many,
        len(_STRETCHED.findall(lower)) / many,
    ]


def _learned(rows: DataFrame) -> dict[str, list]:
    """Words and stems by how much more often toxic rows hold them; ``rows`` has text and toxic."""

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[tuple[str, bool], list[int]] = {}
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                words = set(_WORD.findall(text.lower()))
                for term in [(w, False) for w in words] + [(s, True) for s in {w[:STEM_LETTERS] for w in words if len(w) > STEM_LETTERS}]:
                    counts.setdefault(term, [0, 0])[toxic] += 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([t for t, _ in counts], pa.string()),
                    pa.array([s for _, s in counts], pa.bool_()),
                    pa.array([c[0] for c in counts.values()], pa.int64()),
                    pa.array([c[1] for c in counts.values()], pa.int64()),
                ],
                ["term", "is_stem", "clean", "toxic"],
            )

    classes = rows.groupBy("toxic").count().collect()  # two rows
    size = {row["toxic"]: row["count"] for row in classes}
    clean_rows, toxic_rows = size.get(0, 0), size.get(1, 0)
    counted = rows.mapInArrow(terms, "term string, is_stem boolean, clean long, toxic long")
    summed = counted.groupBy("term", "is_stem").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    odds = F.log((F.col("toxic") + 0.5) / (toxic_rows + 1)) - F.log((F.col("clean") + 0.5) / (clean_rows + 1))
    needed = max(LEAST_ROWS, LEAST_SHARE * toxic_rows)
    entries = (
        summed.withColumn("weight", odds)
        .where((F.col("toxic") >= needed) & (F.col("weight") >= LEAST_WEIGHT))
        .orderBy(F.desc(F.col("toxic") * F.col("weight")), "term", "is_stem")
        .limit(LEXICON_ENTRIES)
        .collect()
    )
    return {
        "words": {row["term"]: row["weight"] for row in entries if not row["is_stem"]},
        "stems": {row["term"]: row["weight"] for row in entries if row["is_stem"]},
    }


def _features(spark: SparkSession, found: dict[str, list], text_column: str) -> Column:
    shared = spark.sparkContext.broadcast(found)

    @F.arrow_udf("array<double>")
    def computed(texts: pa.Array) -> pa.Array:
        words, stems = shared.value["words"], shared.value["stems"]
        rows = [features_of(text, words, stems) for text in texts.to_pylist()]
        return pa.array(rows, pa.list_(pa.float64()))

    return computed(text_or_empty(text_column))


def score(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "toxic",
    fit_rows: int = FIT_ROWS,
) -> DataFrame:
    """doc_id and score of every document; ``labels`` holds only rows to learn from."""
    spark = docs.sparkSession
    known = (
        labels.where(F.col(label_column).isNotNull() & F.col(id_column).isNotNull())
        .groupBy(F.col(id_column).alias("doc_id"))
        .agg(F.max(F.col(label_column).cast("int")).alias("toxic"))
    )
    share = min(1.0, fit_rows / max(1, known.count()))
    place = F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    # About fit_rows rows of two numbers, whatever the size of the tables.
    sample = stored(known.where(place < share), "toxicity-labels")
    texts = docs.select(F.col(id_column).alias("doc_id"), text_or_empty(text_column).alias("text"))
    learning = texts.join(F.broadcast(sample), "doc_id").select("text", "toxic")
    found = _learned(learning)
    measured = stored(
        docs.select(F.col(id_column).alias("doc_id"), _features(spark, found, text_column).alias("features")),
        "toxicity-features",
    ).withColumn("vector", array_to_vector("features"))

    fold = F.pmod(F.xxhash64(F.lit("calibrate"), "doc_id"), F.lit(CALIBRATION_PART))
    rows = measured.join(F.broadcast(sample), "doc_id").select("vector", "toxic", (fold == 0).alias("calibrates"))
    sizes = {(r["calibrates"], r["toxic"]): r["count"] for r in rows.groupBy("calibrates", "toxic").count().collect()}
    both = [c for c in (True, False) if sizes.get((c, 0)) and sizes.get((c, 1))]
    if False not in both:
        toxic = sum(n for (_, label), n in sizes.items() if label)
        return measured.select("doc_id", F.lit(toxic / max(1, sum(sizes.values()))).alias("score"))

    trees = GBTClassifier(featuresCol="vector", labelCol="toxic", maxIter=20, maxDepth=3, stepSize=0.3, seed=7)
    model = trees.fit(rows.where(~F.col("calibrates")).select("vector", "toxic"))
    raw = vector_to_array("probability")[1]
    rated = model.transform(measured).select("doc_id", raw.alias("raw"))
    calibrating = sizes.get((True, 0), 0) + sizes.get((True, 1), 0)
    if True not in both or calibrating < LEAST_CALIBRATION_ROWS:
        return rated.select("doc_id", F.col("raw").alias("score"))
    held = model.transform(rows.where("calibrates")).select(raw.alias("raw"), F.col("toxic").cast("double").alias("toxic"))
    steps = IsotonicRegression(featuresCol="raw", labelCol="toxic", predictionCol="calibrated").fit(held)
    smooth = (1 - ORDER_PART) * F.col("calibrated") + ORDER_PART * F.col("raw")
    return steps.transform(rated).select("doc_id", F.least(F.lit(1.0), F.greatest(F.lit(0.0), smooth)).alias("score"))
