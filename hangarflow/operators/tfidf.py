"""TF-IDF model and cosine similarity over long ``(key, term, weight)`` tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hangarflow.functions.text import ENGLISH_STOP_WORDS, ngrams, tokens
from hangarflow.session import stored

# --- fixed values: model parameters ---------------------------------------------
MAX_FEATURES = 5000
MIN_DF = 1
MAX_DF = 0.8
MIN_SCORE = 0.2
TOP_K = 3
# --- end of fixed values ----------------------------------------------------------
# Hex digits that cut a code's lines into ranges.
RANGE_DIGITS = 2
# Postings of a term per weight block, and the slack that keeps rounding from pruning a tie.
BLOCK = 64
SLACK = 1e-9


def text_grams(
    texts: DataFrame,
    key: str,
    text: str = "text",
    stop_words: Sequence[str] = ENGLISH_STOP_WORDS,
) -> DataFrame:
    """Every n-gram ``(key, term)`` of texts with one row per key.

    The texts are hashed by key before they are exploded. That moves each text
    once instead of its many n-grams, and every later step that groups by the
    key (counts, norms, scores, ranks) finds its rows already together.
    """
    return (
        texts.select(key, text)
        .repartition(key)
        .select(key, F.explode(ngrams(tokens(F.col(text), stop_words))).alias("term"))
    )


def text_terms(
    texts: DataFrame,
    key: str,
    text: str = "text",
    stop_words: Sequence[str] = ENGLISH_STOP_WORDS,
) -> DataFrame:
    """Term counts ``(key, term, tf)`` of texts with one row per key."""
    return (
        text_grams(texts, key, text, stop_words)
        .groupBy(key, "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def text_weights(
    texts: DataFrame,
    key: str,
    vocabulary: DataFrame,
    text: str = "text",
    stop_words: Sequence[str] = ENGLISH_STOP_WORDS,
) -> DataFrame:
    """L2-normalised ``(key, term, weight)`` of texts under a fitted vocabulary.

    Terms outside the vocabulary leave before anything is counted.
    """
    counted = (
        text_grams(texts, key, text, stop_words)
        .join(vocabulary.select("term", "idf"), "term")
        .groupBy(key, "term", "idf")
        .agg(F.count(F.lit(1)).alias("tf"))
    )
    return _normalised(counted, key)


def catalog_terms(
    lines: DataFrame, stop_words: Sequence[str] = ENGLISH_STOP_WORDS, range_digits: int = RANGE_DIGITS
) -> DataFrame:
    """Term counts ``(ata04, term, tf)`` of training texts given as ordered lines.

    n-grams run across line ends. Each part of a code is cut into ranges by the
    first ``range_digits`` hex digits of the line order (256 ranges for two
    digits; use three when one code owns billions of values). A line finds the next two tokens inside its range, and the end of a
    range takes them from a table of range heads (two tokens per range), so no
    task holds a whole code.
    """
    rows = (
        lines.select(
            "ata04",
            "part",
            "line_order",
            "text",
            F.substring("line_order", 1, range_digits).alias("bucket"),
            tokens(F.col("text"), stop_words).alias("own"),
        )
        .where(F.size("own") > 0)
        .withColumn("head", F.slice("own", 1, 2))
    )
    in_range = Window.partitionBy("ata04", "part", "bucket").orderBy("line_order", "text")
    empty = F.array().cast("array<string>")
    rows = rows.withColumn("rank", F.row_number().over(in_range)).withColumn(
        "next",
        F.concat(
            F.coalesce(F.lead("head", 1).over(in_range), empty),
            F.coalesce(F.lead("head", 2).over(in_range), empty),
        ),
    )

    def head_of(rank: int) -> Column:
        return F.coalesce(F.max(F.when(F.col("rank") == rank, F.col("head"))), empty)

    # One row per range: at most 4 x 16 ** range_digits rows per code.
    across = Window.partitionBy("ata04").orderBy("part", "bucket")
    heads = (
        rows.where(F.col("rank") <= 2)
        .groupBy("ata04", "part", "bucket")
        .agg(F.slice(F.concat(head_of(1), head_of(2)), 1, 2).alias("range_head"))
        .select(
            "ata04",
            "part",
            "bucket",
            F.concat(
                F.coalesce(F.lead("range_head", 1).over(across), empty),
                F.coalesce(F.lead("range_head", 2).over(across), empty),
            ).alias("after_range"),
        )
    )
    following = F.slice(F.concat("next", F.coalesce("after_range", empty)), 1, 2)
    return (
        rows.join(heads, ["ata04", "part", "bucket"], "left")
        .select("ata04", F.explode(ngrams(F.col("own"), following)).alias("term"))
        .groupBy("ata04", "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def fit_vocabulary(
    terms: DataFrame,
    key: str,
    max_features: int = MAX_FEATURES,
    min_df: int = MIN_DF,
    max_df: float = MAX_DF,
    n_docs: Column | None = None,
) -> DataFrame:
    """``(term, df, idf)`` of the most frequent terms inside the document-frequency limits.

    ``n_docs`` is the number of texts; by default the keys that have a term.
    """
    if n_docs is None:
        n_docs = terms.agg(F.count_distinct(key)).scalar()
    return (
        terms.groupBy("term")
        .agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))
        .withColumn("n_docs", n_docs)
        .where((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("n_docs")))
        .orderBy(F.desc("total"), "term")
        .limit(max_features)
        .select(
            "term",
            "df",
            (F.log((1.0 + F.col("n_docs")) / (1.0 + F.col("df"))) + 1.0).alias("idf"),
        )
    )


def weigh(terms: DataFrame, vocabulary: DataFrame, key: str) -> DataFrame:
    """L2-normalised ``(key, term, weight)``; terms outside the vocabulary drop out.

    The vocabulary is capped when it is fitted, which also bounds the rows per
    key that the norm window sees.
    """
    return _normalised(terms.join(vocabulary, "term"), key)


def _normalised(counted: DataFrame, key: str) -> DataFrame:
    weighted = counted.select(key, "term", (F.col("tf") * F.col("idf")).alias("raw"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(key)))
    return weighted.select(key, "term", (F.col("raw") / norm).alias("weight"))


def cosine_scores(
    queries: DataFrame, catalog: DataFrame, key: str, min_score: float = 0.0, shuffle: bool = False
) -> DataFrame:
    """``(key, ata04, score)`` of every pair that shares a term and reaches ``min_score``.

    An inverted-index join on the term. Spark broadcasts the catalog side when its
    stored files are small; then nothing shuffles, because the query side is already
    hashed by its key. In the shuffled join, adaptive execution splits a term that
    many texts use. ``shuffle`` asks for that join.

    A text whose terms cannot reach ``min_score`` even if each met the heaviest
    entry of its term leaves before any pair is made.
    """
    side = catalog.select("term", "ata04", F.col("weight").alias("entry_weight"))
    if min_score > 0:
        heaviest = side.groupBy("term").agg(F.max("entry_weight").alias("heaviest"))
        reach = F.sum(F.col("weight") * F.coalesce("heaviest", F.lit(0.0))).over(Window.partitionBy(key))
        queries = (
            queries.join(heaviest, "term", "left").withColumn("reach", reach).where(F.col("reach") >= min_score)
        ).drop("heaviest", "reach")
    pairs = queries.join(side.hint("merge") if shuffle else side, "term")
    scores = pairs.groupBy(key, "ata04").agg(F.sum(F.col("weight") * F.col("entry_weight")).alias("score"))
    return scores.where(F.col("score") >= min_score) if min_score > 0 else scores


def posting_blocks(catalog: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(term, block, ata04, weight, block_max)``: each term's postings by falling weight, cut into blocks."""
    order = Window.partitionBy("term").orderBy(F.desc("weight"), "ata04")
    ranked = catalog.select("term", "ata04", "weight").withColumn(
        "block", F.floor((F.row_number().over(order) - 1) / block)
    )
    return ranked.withColumn("block_max", F.max("weight").over(Window.partitionBy("term", "block")))


def _exact(candidates: DataFrame, queries: DataFrame, postings: DataFrame, key: str) -> DataFrame:
    """Cosine of each candidate pair (with any further columns of ``candidates``), over the query's terms."""
    carried = [c for c in candidates.columns if c not in (key, "ata04")]
    terms = candidates.join(queries.select(key, "term", "weight"), key)
    found = terms.join(postings.select("term", "ata04", F.col("weight").alias("entry_weight")), ["term", "ata04"])
    return found.groupBy(key, "ata04", *carried).agg(F.sum(F.col("weight") * F.col("entry_weight")).alias("score"))


def bounded_scores(
    queries: DataFrame,
    catalog: DataFrame,
    key: str,
    min_score: float = 0.0,
    k: int | None = None,
    block: int = BLOCK,
    report: dict | None = None,
) -> DataFrame:
    """``(key, ata04, score)`` of every pair that can reach ``min_score`` or, given ``k``, the k-th best score.

    Max-score order over weight blocks. A query term's bound is its weight times
    the heaviest posting of the term. Terms are taken by rising bound; those whose
    bounds sum below the threshold are not essential: a code met only there
    cannot reach it, so candidates come from the essential terms only, and of
    those only from blocks whose maximum, with the bounds of all other terms,
    can still reach the threshold. Candidates are then scored exactly over all
    the query's terms. With ``k``, the threshold is first raised per query to the
    k-th exact score among the first block of its strongest term, which the
    true k-th score cannot be below. Pairs at the threshold are kept.

    ``report``, if given, receives the pairs summed (``candidates``) and the pairs
    that share a term (``sharing``), as two more jobs.
    """
    if k and not min_score and catalog.select("ata04").distinct().limit(block + 1).count() <= block:
        # Every term's postings are one block: the extra pass that raises the threshold
        # cannot skip a block, so the pairs that share a term are summed directly.
        return cosine_scores(queries, catalog, key)
    postings = posting_blocks(catalog, block)
    heaviest = postings.where(F.col("block") == 0).groupBy("term").agg(F.max("weight").alias("heaviest"))
    bounded = queries.select(key, "term", "weight").join(heaviest, "term")
    bounded = bounded.withColumn("bound", F.col("weight") * F.col("heaviest"))
    floor = F.lit(float(min_score))
    if k:
        strongest = bounded.withColumn(
            "n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("bound"), "term"))
        ).where("n = 1")
        first = strongest.join(postings.where(F.col("block") == 0).select("term", "ata04"), "term").select(key, "ata04")
        found = _exact(first, queries, postings, key)
        kth = (
            found.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "ata04")))
            .where(F.col("n") == k)
            .select(key, F.col("score").alias("kth"))
        )
        bounded = bounded.join(kth, key, "left")
        floor = F.greatest(floor, F.coalesce("kth", F.lit(0.0)))
    bounded = bounded.withColumn("theta", floor - SLACK)
    by_key = Window.partitionBy(key)
    rising = by_key.orderBy("bound", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    essential = (
        bounded.withColumn("prefix", F.sum("bound").over(rising))
        .withColumn("rest", F.sum("bound").over(by_key) - F.col("bound"))
        .where(F.col("prefix") >= F.col("theta"))
    )
    blocks = postings.select("term", "block", "block_max").distinct()
    reach = essential.join(blocks, "term").where(F.col("weight") * F.col("block_max") + F.col("rest") >= F.col("theta"))
    candidates = (
        reach.select(key, "term", "block", "theta")
        .join(postings.select("term", "block", "ata04"), ["term", "block"])
        .select(key, "ata04", "theta")
        .distinct()
    )
    if report is not None:
        report["candidates"] = candidates.count()
        report["sharing"] = queries.select(key, "term").join(postings.select("term", "ata04"), "term").select(key, "ata04").distinct().count()
    scored = _exact(candidates, queries, postings, key)
    return scored.where(F.col("score") >= F.col("theta")).select(key, "ata04", "score")


def best_match(scores: DataFrame, key: str, min_score: float = MIN_SCORE) -> DataFrame:
    """The best entry per key when it reaches ``min_score``; ties go to the lower code."""
    ranked = F.struct((-F.col("score")).alias("cost"), "ata04")
    return (
        scores.where(F.col("score") >= min_score)
        .groupBy(key)
        .agg(F.min_by(F.struct("ata04", "score"), ranked).alias("best"))
        .select(key, "best.ata04", "best.score")
    )


def top_matches(scores: DataFrame, key: str, k: int = TOP_K) -> DataFrame:
    """The ``k`` best entries per key with their rank."""
    order = Window.partitionBy(key).orderBy(F.desc("score"), "ata04")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def fit(
    lines: DataFrame,
    stop_words: Sequence[str] = ENGLISH_STOP_WORDS,
    range_digits: int = RANGE_DIGITS,
    **limits,
) -> tuple[DataFrame, DataFrame]:
    """Vocabulary and entry vectors of a catalog given as training lines.

    Terms and vocabulary are used more than once, so they are written to the
    shared folder instead of being computed again.
    """
    n_docs = lines.agg(F.count_distinct("ata04")).scalar()
    terms = stored(catalog_terms(lines, stop_words, range_digits), "catalog-terms")
    vocabulary = stored(fit_vocabulary(terms, "ata04", n_docs=n_docs, **limits), "vocabulary")
    return vocabulary, stored(weigh(terms, vocabulary, "ata04"), "catalog-vectors")


def predict_ata(
    texts: DataFrame,
    key: str,
    vocabulary: DataFrame,
    vectors: DataFrame,
    catalog: DataFrame,
    text: str = "text",
    min_score: float = MIN_SCORE,
    stop_words: Sequence[str] = ENGLISH_STOP_WORDS,
) -> DataFrame:
    """Best entry per text with the entry's name and keywords."""
    weights = stored(text_weights(texts, key, vocabulary, text, stop_words), "text-weights")
    best = best_match(bounded_scores(weights, vectors, key, min_score), key, min_score)
    entries = catalog.select("ata04", "system_name", "keywords")
    return best.join(entries, "ata04", "left")
