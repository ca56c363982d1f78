"""Language identification by language-bitmask n-gram filters.

Fitting: character n-grams inside and at the edges of words, of lengths ORDERS, are
counted per language. A gram belongs to a language when it makes up at least
``min_share`` of that language's grams of its length, so a language has at most
``1 / min_share`` grams per length. All languages share one Bloom filter stored
bit-sliced: a slot holds one bit per language (a byte for every eight of them), and
the AND of a gram's slots is the mask of all languages that contain it.

Predicting: the masks of all grams of the whole text are counted per language. A
filter whose bits are set in a share ``f`` of the slots answers a foreign gram with
probability ``f ** PROBES``; with that rate the expected number of true members is
``(count - grams * rate) / (1 - rate)``. The language with most of them wins; ties
go to the language with more documents, then to the smaller name. The score is the
winner's part of all corrected counts.

Defined cases: null text and text without a letter give ``und`` and score 0, as
does everything when there was nothing to learn from. A text with letters always
gets a learned language. Rows without language are not learned from. Very long
texts are counted in slices of SLICE_CHARACTERS without losing a gram at a cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hangarflow.llm.texts import text_or_empty

UNDETERMINED = "und"
ORDERS = (1, 2, 3, 4)
PROBES = 2
SLOTS_PER_GRAM = 16
# Documents learned from per language, about: the bound of the fitting sample.
FIT_DOCUMENTS = 8_192
MIN_SHARE = 2e-5
SLICE_CHARACTERS = 1 << 19

_SPACE = 32
_STEP = np.uint64(0x9E3779B97F4A7C15)
_FINISH = np.uint64(0xFF51AFD7ED558CCD)


@dataclass
class Filters:
    """``slots[group, slot]`` holds the bits of languages ``8 * group`` to ``8 * group + 7``."""

    languages: list[str]
    slots: np.ndarray
    false_rate: np.ndarray


@cache
def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased code points, every non-letter a space, one space around each text; where each begins; letters."""
    joined = " " + " ".join([text.lower() for text in texts]) + " "
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    lengths = [len(text.lower()) + 1 for text in texts]
    return np.where(letter, codes, _SPACE).astype(np.uint64), np.cumsum([0, *lengths]), letter


def _grams(codes: np.ndarray, letter: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, first positions, hashes): grams whose inner characters are letters, with at least one letter."""
    rolling = np.zeros(len(codes), np.uint64)
    inner = np.ones(len(codes), bool)
    for order in range(1, max(ORDERS) + 1):
        size = len(codes) - order + 1
        if size <= 0:
            return
        rolling = rolling[:size] * _STEP + codes[order - 1 :]
        if order > 2:
            inner = inner[:size] & letter[order - 2 : order - 2 + size]
        inner = inner[:size]
        if order not in ORDERS:
            continue
        fits = inner & (letter[:size] | letter[order - 1 :]) if order < 3 else inner
        first = np.flatnonzero(fits)
        mixed = rolling[first] + np.uint64(order)
        mixed = (mixed ^ (mixed >> np.uint64(31))) * _FINISH
        yield order, first, mixed ^ (mixed >> np.uint64(33))


def _slices(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """(first text, texts): runs of texts of about SLICE_CHARACTERS together."""
    begin = held = 0
    for at, text in enumerate(texts):
        held += len(text)
        if held >= SLICE_CHARACTERS:
            yield begin, texts[begin : at + 1]
            begin, held = at + 1, 0
    if begin < len(texts):
        yield begin, texts[begin:]


def fit(
    labelled: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    lang_column: str = "lang",
    fit_documents: int = FIT_DOCUMENTS,
    min_share: float = MIN_SHARE,
) -> Filters:
    """Filters from the labelled rows, of which about ``fit_documents`` a language are read, chosen by hash."""
    known = labelled.where(F.col(lang_column).isNotNull() & F.col(text_column).isNotNull()).select(
        F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"), F.col(lang_column).alias("lang")
    )
    counted = known.groupBy("lang").count().collect()  # one row per language
    counted = sorted(counted, key=lambda row: (-row["count"], row["lang"]))
    languages = [row["lang"] for row in counted]
    if not languages:
        return Filters([], np.zeros((0, 1), np.uint8), np.zeros(0))

    share = F.element_at(
        F.create_map(*[F.lit(x) for row in counted for x in (row["lang"], min(1.0, fit_documents / row["count"]))]),
        F.col("lang"),
    )
    place = F.pmod(F.xxhash64(F.lit("fit"), "id", F.length("text")), F.lit(1 << 30)) / float(1 << 30)
    sample = known.where(place < share).select("lang", "text")
    index = {language: at for at, language in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            by_language: dict[int, list[str]] = {}
            for lang, text in zip(langs, texts, strict=True):
                by_language.setdefault(index[lang], []).append(text)
            for lang, own in by_language.items():
                for _, part in _slices(own):
                    codes, _, letter = _codes(part)
                    for order, _, grams in _grams(codes, letter):
                        found, times = np.unique(grams, return_counts=True)
                        columns = [np.full(len(found), lang, np.int32), np.full(len(found), order, np.int32)]
                        columns += [found.view(np.int64), times.astype(np.int64)]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c) for c in columns], ["lang", "length", "gram", "times"]
                        )

    grams = sample.mapInArrow(count, "lang int, length int, gram long, times long")
    summed = grams.groupBy("lang", "length", "gram").agg(F.sum("times").alias("times"))
    totals = summed.groupBy("lang", "length").agg(F.sum("times").alias("all_times"))  # languages times lengths
    members = (
        summed.join(F.broadcast(totals), ["lang", "length"])
        .where(F.col("times") >= F.col("all_times") * min_share)
        .groupBy("gram")
        .agg(F.collect_set("lang").alias("langs"))  # at most all languages
        .toPandas()  # at most languages * lengths / min_share grams, by the share
    )
    slots = 1 << int(np.ceil(np.log2(max(64, SLOTS_PER_GRAM * len(members)))))
    table = np.zeros(((len(languages) + 7) // 8, slots), np.uint8)
    if len(members):
        lang = np.concatenate([np.asarray(one, np.int64) for one in members["langs"]])
        gram = np.repeat(members["gram"].to_numpy(np.int64).view(np.uint64), members["langs"].map(len))
        for probe in _probes(gram, slots):
            np.bitwise_or.at(table, (lang // 8, probe), (1 << (lang % 8)).astype(np.uint8))
    filled = np.unpackbits(table[:, None, :], axis=1, bitorder="little").mean(axis=2).reshape(-1)
    return Filters(languages, table, filled[: len(languages)] ** PROBES)


def _probes(grams: np.ndarray, slots: int) -> list[np.ndarray]:
    width = np.uint64(64 // PROBES)
    return [((grams >> (width * np.uint64(k))) & np.uint64(slots - 1)).astype(np.int64) for k in range(PROBES)]


def masks(grams: np.ndarray, filters: Filters) -> np.ndarray:
    """``[group, gram]``: the languages whose filter holds each gram."""
    probes = _probes(grams, filters.slots.shape[1])
    found = filters.slots[:, probes[0]]
    for probe in probes[1:]:
        found &= filters.slots[:, probe]
    return found


_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def corrected_counts(texts: list[str], filters: Filters) -> tuple[np.ndarray, np.ndarray]:
    """``[text, language]`` expected true members, and the number of grams of each text."""
    many = len(filters.languages)
    groups = len(filters.slots)
    counts = np.zeros((len(texts), groups * 8), np.int64)
    grams_of = np.zeros(len(texts), np.int64)
    for begin, part in _slices(texts):
        codes, starts, letter = _codes(part)
        for _, first, grams in _grams(codes, letter):
            # A gram that begins with the space before a text belongs to that text.
            text = np.searchsorted(starts, first, side="right") - 1
            grams_of[begin : begin + len(part)] += np.bincount(text, minlength=len(part))[: len(part)]
            for group, found in enumerate(masks(grams, filters)):
                seen = np.bincount(text * 256 + found, minlength=len(part) * 256).reshape(-1, 256)[: len(part)]
                counts[begin : begin + len(part), 8 * group : 8 * group + 8] += seen @ _BITS
    rate = filters.false_rate
    return (counts[:, :many] - grams_of[:, None] * rate) / np.maximum(1 - rate, 1e-9), grams_of


def predict_texts(texts: list[str], filters: Filters) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    if not filters.languages:
        return [UNDETERMINED] * len(texts), np.zeros(len(texts))
    expected, grams = corrected_counts(texts, filters)
    positive = np.maximum(expected, 0)
    best = expected.argmax(axis=1)
    total = positive.sum(axis=1)
    score = np.where(total > 0, positive[np.arange(len(texts)), best] / np.where(total > 0, total, 1), 0.0)
    names = [filters.languages[at] if n else UNDETERMINED for at, n in zip(best, grams, strict=True)]
    return names, np.where(grams > 0, np.clip(score, 0, 1), 0.0)


def predict(spark: SparkSession, filters: Filters, text_column: str = "text") -> Column:
    """Struct of ``lang`` and ``score`` for a text column."""
    shared = spark.sparkContext.broadcast(filters)

    @F.arrow_udf("struct<lang: string, score: double>")
    def predicted(texts: pa.Array) -> pa.Array:
        names, scores = predict_texts(texts.to_pylist(), shared.value)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    return predicted(text_or_empty(text_column))
