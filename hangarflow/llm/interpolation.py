"""Language-model scores by deleted interpolation.

The model mixes maximum-likelihood estimates of a word after its predecessor, of
the word alone, and of any word:

    P(w | v) = a2(v) * c(v w) / c(v) + a1(v) * c(w) / N + a0(v) / (V + 1)

The weights depend on the bucket of the predecessor's frequency (powers of two) and
are learned by expectation-maximisation on held-out counts: every training token is
deleted from the counts in turn, so its estimates are (c(v w) - 1) / (c(v) - 1) and
(c(w) - 1) / (N - 1). The end of a document is a token, and the predecessor of its
first one.

Counts cover the whole training part. Documents are cut into blocks of about
BLOCK_TOKENS tokens, their distinct words and word pairs are counted by
``key_counts``, and the answers go back to the blocks, which then hold every number
that scoring needs. Expectation-maximisation runs over a histogram of the log ratios
of the three estimates in steps of 1 / GRID octave: its size is bounded by the grid,
its weight is every training token.

Words are 64-bit hashes: 56 bits beside the bucket tell words apart and 40 bits tell
pairs apart, so a pair shares its count with another one with probability 2e-6.

Defined cases: null text is empty and consists of its end only. Without training
documents every probability is 1, so all scores are 0. A bucket without training
tokens uses the weights of all buckets together. Null identifiers are kept.
Very long documents form a block of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hangarflow.llm import key_counts as K
from hangarflow.llm.texts import lower_ascii, text_or_empty, words
from hangarflow.session import stored

BLOCK_TOKENS = 3 << 19
# Tokens whose estimates are worked out at a time.
SLICE_TOKENS = 1 << 18
WORDS, PAIRS = 0, 1
WIDTHS = {WORDS: 56, PAIRS: 40}
GRID = 4
NOTHING = -10_000  # stands for the log ratio of an estimate of 0
EM_STEPS = 100
BLOCK_SCHEMA = (
    "block long, n_tokens long, n_train long, doc_ids array<long>, lengths array<int>, train array<boolean>, "
    "n_words long, vocabulary binary, places binary"
)
_PAIR = np.uint64(0x9FB21C651E98DF25)
_FINISH = np.uint64(0xD6E8FEB86659FD93)


def hashed_words(text: Column) -> Column:
    return F.transform(words(lower_ascii(text)), lambda word: F.xxhash64(word))


def _blocks(docs: DataFrame) -> DataFrame:
    """Documents packed into blocks: distinct tokens, and the place of every token among them.

    Frequent tokens come first and equally frequent ones in order of their hashes, so
    places are small numbers and neighbouring hashes have small differences.
    """

    def packed(held: list[np.ndarray], doc_ids: list, train: list, sequence: int) -> pa.RecordBatch:
        end = np.zeros(1, np.uint64)
        tokens = np.concatenate([part for words_ in held for part in (words_, end)])
        vocabulary, places, times = np.unique(tokens, return_inverse=True, return_counts=True)
        del tokens
        order = np.argsort(-times, kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        places = rank[places]
        differences = np.diff(vocabulary[order], prepend=np.uint64(0))
        lengths = [len(one) + 1 for one in held]
        n_train = sum(n for n, learns in zip(lengths, train, strict=True) if learns)
        block = (TaskContext.get().partitionId() << 24) + sequence
        compressed = [pa.compress(K.planes(v, w), codec="zstd", asbytes=True) for v, w in ((differences, 8), (places, 4))]
        columns = [
            pa.array([block], pa.int64()),
            pa.array([len(places)], pa.int64()),
            pa.array([n_train], pa.int64()),
            pa.array([doc_ids], pa.list_(pa.int64())),
            pa.array([lengths], pa.list_(pa.int32())),
            pa.array([train], pa.list_(pa.bool_())),
            pa.array([len(vocabulary)], pa.int64()),
            *(pa.array([one], pa.binary()) for one in compressed),
        ]
        names = "block n_tokens n_train doc_ids lengths train n_words vocabulary places".split()
        return pa.RecordBatch.from_arrays(columns, names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        doc_ids: list = []
        train: list = []
        tokens = sequence = 0
        for batch in batches:
            hashes = batch.column("words")
            values = hashes.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            offsets = hashes.offsets.to_numpy() - hashes.offsets[0].as_py()
            ids, learns = batch.column("doc_id").to_pylist(), batch.column("train").to_pylist()
            for at in range(batch.num_rows):
                held.append(values[offsets[at] : offsets[at + 1]].copy())
                doc_ids.append(ids[at])
                train.append(learns[at])
                tokens += len(held[-1]) + 1
                if tokens >= BLOCK_TOKENS:
                    yield packed(held, doc_ids, train, sequence)
                    held, doc_ids, train, tokens, sequence = [], [], [], 0, sequence + 1
        if held:
            yield packed(held, doc_ids, train, sequence)

    return docs.mapInArrow(cut, BLOCK_SCHEMA)


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted vocabulary, place of each token and of its predecessor, and which tokens train."""

    def planes(name: str, count: int, width: int) -> np.ndarray:
        return K.from_planes(pa.decompress(row[name], width * count, codec="zstd", asbytes=True), width)

    stored_order = np.cumsum(planes("vocabulary", row["n_words"], 8), dtype=np.uint64)
    order = np.argsort(stored_order)
    sorted_place = np.empty(len(order), np.int32)
    sorted_place[order] = np.arange(len(order), dtype=np.int32)
    vocabulary = stored_order[order]
    places = sorted_place[planes("places", row["n_tokens"], 4).astype(np.int32)]
    # Every document ends with the end token, so the token before a first word is an end already;
    # only the first document of the block needs one in front.
    before = np.empty_like(places)
    before[0], before[1:] = np.searchsorted(vocabulary, np.uint64(0)), places[:-1]
    return vocabulary, places, before, np.repeat(np.array(row["train"], bool), row["lengths"])


def _pairs(vocabulary: np.ndarray, places: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the block's word pairs, and the place of each token's pair among them."""
    front = (vocabulary + _PAIR) * _FINISH
    front ^= front >> np.uint64(32)
    key = front[before]
    key += vocabulary[places]
    key ^= key >> np.uint64(29)
    key *= _FINISH
    key ^= key >> np.uint64(32)
    return np.unique(key, return_inverse=True)


def _slices(count: int) -> Iterator[slice]:
    return (slice(at, at + SLICE_TOKENS) for at in range(0, count, SLICE_TOKENS))


def _counted(blocks: DataFrame, bits: int) -> DataFrame:
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in K.rows_of(batches):
            vocabulary, places, before, train = _unpacked(row)
            once = np.bincount(places[train], minlength=len(vocabulary))
            yield K.entries(row["block"], WORDS, vocabulary, once, bits, WIDTHS[WORDS])
            pairs, pair = _pairs(vocabulary, places, before)
            yield K.entries(row["block"], PAIRS, pairs, np.bincount(pair[train], minlength=len(pairs)), bits, WIDTHS[PAIRS])

    replies = K.merged(blocks.mapInArrow(listed, K.ENTRY_SCHEMA), WIDTHS)
    # A block gets at most as many replies as it has keys.
    per_block = replies.groupBy("block").agg(F.collect_list(F.struct("bucket", "counts")).alias("replies"))
    return blocks.join(per_block, "block", "full")


def _buckets(context: np.ndarray) -> np.ndarray:
    """0 for an unseen predecessor, else 1 + floor(log2(count))."""
    return np.where(context > 0, 1 + np.floor(np.log2(np.maximum(context, 1))), 0).astype(np.int64)


def _log_ratio(estimate: np.ndarray, uniform: float) -> np.ndarray:
    safe = np.where(estimate > 0, estimate, uniform)
    return np.where(estimate > 0, np.rint(GRID * np.log2(safe / uniform)), NOTHING).astype(np.int32)


def deleted_estimates(pair, context, word, total) -> tuple[np.ndarray, np.ndarray]:
    """Estimates of a training token after taking it out of the counts."""
    return (
        np.where(context > 1, (pair - 1) / np.maximum(context - 1, 1), 0.0),
        (word - 1) / max(total - 1, 1),
    )


def learn_weights(cells: list[tuple[int, int, int, int]], steps: int = EM_STEPS) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """Weights per bucket and for all together, from (bucket, log ratio 2, log ratio 1, tokens)."""

    def maximise(rows: np.ndarray) -> np.ndarray:
        ratio = np.c_[
            np.where(rows[:, 1] == NOTHING, 0, 2.0 ** (rows[:, 1] / GRID)),
            np.where(rows[:, 2] == NOTHING, 0, 2.0 ** (rows[:, 2] / GRID)),
            np.ones(len(rows)),
        ]
        weights = np.full(3, 1 / 3)
        for _ in range(steps):
            parts = ratio * weights
            shares = parts / parts.sum(axis=1, keepdims=True)
            new = (shares * rows[:, 3:]).sum(axis=0) / rows[:, 3].sum()
            done = np.abs(new - weights).max() < 1e-9
            weights = new
            if done:
                break
        return weights

    if not cells:
        return {}, np.array([0.0, 0.0, 1.0])
    table = np.array(sorted(cells), dtype=np.float64)
    return {int(b): maximise(table[table[:, 0] == b]) for b in np.unique(table[:, 0])}, maximise(table)


def score(docs: DataFrame, train: Column, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score and score of every document (log10)."""
    tokens = docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.coalesce(train, F.lit(True)).alias("train"),
        hashed_words(text_or_empty(text_column)).alias("words"),
    )
    blocks = stored(_blocks(tokens), "interpolation-blocks")
    sums = blocks.agg(F.sum("n_tokens").alias("tokens"), F.sum("n_train").alias("train")).first()
    total = sums["train"] or 0
    counted = stored(_counted(blocks, K.bucket_bits(sums["tokens"] or 0)), "interpolation-counts")

    summaries = counted.where("block < 0").select(F.explode("replies").alias("r"))
    words_only = summaries.where(F.col("r.bucket") < K.KIND)
    distinct = sum(
        int(K.unpack(row["counts"])[0]) for row in words_only.select("r.counts").toLocalIterator()
    )
    uniform = 1 / (distinct + 1)
    filled = counted.where("block >= 0")

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in K.rows_of(batches):
            vocabulary, places, before, learns = _unpacked(row)
            if not learns.any():
                continue
            _, pair = _pairs(vocabulary, places, before)
            word = K.replies_in_order(row["replies"], WORDS)
            pair_counts = K.replies_in_order(row["replies"], PAIRS)
            for part in _slices(len(places)):
                train = learns[part]
                context, own = word[before[part][train]], word[places[part][train]]
                p2, p1 = deleted_estimates(pair_counts[pair[part][train]], context, own, total)
                cells = np.c_[_buckets(context - 1), _log_ratio(p2, uniform), _log_ratio(p1, uniform)]
                code = (cells[:, 0] * 65_536 + cells[:, 1] + 32_768) * 65_536 + cells[:, 2] + 32_768
                _, first, times = np.unique(code, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(cells[first, k], pa.int32()) for k in range(3)), pa.array(times, pa.int64())],
                    ["b", "r2", "r1", "tokens"],
                )

    grid = filled.mapInArrow(histogram, "b int, r2 int, r1 int, tokens long")
    # Bounded by the grid: frequency buckets times log ratios, never by the number of documents.
    cells = [tuple(r) for r in grid.groupBy("b", "r2", "r1").agg(F.sum("tokens")).collect()]
    weights, together = learn_weights(cells)
    table = np.array([weights.get(b, together) for b in range(65)])
    # Without a count of the predecessor there is no first estimate: its weight goes to the others.
    rest = table[0, 1:].sum()
    table[0] = [0, *(table[0, 1:] / rest if rest > 0 else (0, 1))]
    if not total:
        table[:] = (0, 0, 1)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in K.rows_of(batches):
            vocabulary, places, before, _ = _unpacked(row)
            _, pair = _pairs(vocabulary, places, before)
            word = K.replies_in_order(row["replies"], WORDS)
            pair_counts = K.replies_in_order(row["replies"], PAIRS)
            known = word[places] > 0
            base, model = np.empty(len(places)), np.empty(len(places))
            for part in _slices(len(places)):
                context, own = word[before[part]], word[places[part]]
                a = table[_buckets(context)]
                chance = a[:, 0] * pair_counts[pair[part]] / np.maximum(context, 1)
                chance += a[:, 1] * own / max(total, 1) + a[:, 2] * uniform
                model[part] = np.log10(chance)
                base[part] = np.log10((own + 0.5) / (total + 0.5 * (distinct + 1)))
            starts = np.r_[0, np.cumsum(row["lengths"])[:-1]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(row["train"], pa.bool_()),
                    pa.array(row["lengths"], pa.int64()),
                    pa.array(np.add.reduceat(known.astype(np.int64), starts)),
                    pa.array(np.full(len(starts), total), pa.int64()),
                    pa.array(np.add.reduceat(base, starts)),
                    pa.array(np.add.reduceat(model, starts)),
                ],
                ["doc_id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return filled.mapInArrow(
        scored,
        "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
