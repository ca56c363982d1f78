"""Operators 11 to 13 against plain Python and numpy versions on small awkward tables."""

import collections
import hashlib
import math

import numpy as np
import pyarrow.parquet as pq
import pytest
import regex
from odd_tables import document_rows

from hangarflow.llm import queries, quality_rules, vector_codes, whitening

WORD = regex.compile(r"[^\x20\x09-\x0D]+")
Q = queries.QUERIES


def counted(rows):
    return collections.Counter(map(tuple, rows))


# --- 11 ----------------------------------------------------------------------------------
def _usable(vector, limit):
    return vector is not None and all(c is not None and math.isfinite(c) and abs(c) < limit for c in vector)


def codes_brute(rows, parts=16, entries=64, rounds=2, scale=256):
    kept = [(i, [math.floor(scale * float(c)) for c in v], label) for i, v, label in rows if _usable(v, vector_codes.LIMIT)]
    if not kept:
        return []
    p = max(1, -(-max(len(v) for _, v, _ in kept) // parts))
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    padded = [(i, v + [0] * (parts * p - len(v)), label) for i, v, label in kept]
    books = [[(v + [0] * (parts * p - len(v)))[t * p : (t + 1) * p] for _, v, _ in first] for t in range(parts)]

    def assign(v, t):
        part = v[t * p : (t + 1) * p]
        dist = [sum((a - b) ** 2 for a, b in zip(part, entry, strict=True)) for entry in books[t]]
        best = min(range(len(dist)), key=lambda j: (dist[j], j))
        return best, dist[best]

    for _ in range(rounds):
        totals = collections.defaultdict(lambda: [0] * p)
        counts = collections.Counter()
        for _, v, _ in padded:
            for t in range(parts):
                e, _ = assign(v, t)
                counts[t, e] += 1
                totals[t, e] = [a + b for a, b in zip(totals[t, e], v[t * p : (t + 1) * p], strict=True)]
        for (t, e), n in counts.items():
            books[t][e] = [s // n for s in totals[t, e]]
    coded = []
    for i, v, label in padded:
        picked = [assign(v, t) for t in range(parts)]
        coded.append((i, "".join(f"{e:02x}" for e, _ in picked), sum(d for _, d in picked), label))
    by_label = collections.Counter()
    for _, _, error, label in coded:
        by_label[label] += error
    digest = hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()
    return [(i, code, error, by_label[label], digest) for i, code, error, label in coded]


def test_vector_codes(spark, odd_dir):
    rows = pq.read_table(f"{odd_dir}/embeddings.parquet").select(["vec_id", "embedding", "label"]).to_pylist()
    want = codes_brute([(r["vec_id"], r["embedding"], r["label"]) for r in rows])
    got = Q["op11_vector_codes"](spark, odd_dir).collect()
    assert counted(got) == counted(want)


def test_vector_codes_of_long_parts(spark):
    draw = np.random.default_rng(5)
    vectors = draw.normal(0, 0.3, (300, 80)).astype(np.float32)
    vectors[:40] = vectors[0]  # one hot entry
    rows = [(i, [float(c) for c in v], i % 3 or None) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    coded = vector_codes.compress(df)
    got = {(r["row"]["vec_id"]): (r["code"], r["error"]) for r in coded.rows.collect()}
    want = codes_brute(rows)
    assert {i: (c, e) for i, c, e, _, _ in want} == got
    assert coded.digest() == want[0][4]


@pytest.mark.parametrize("p", [1, 3, 4, 5, 16])
def test_nearest_by_transform_equals_plain_distances(p):
    draw = np.random.default_rng(p)
    parts = draw.integers(-300, 300, (200, p))
    book = draw.integers(-300, 300, (64, p))
    book[10] = book[3]  # equal entries: the lower index wins
    parts[:20] = book[3]
    code, dist = vector_codes.nearest(parts, book)
    plain = ((parts[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)
    assert (dist == plain.min(axis=1)).all()
    assert (code == plain.argmin(axis=1)).all()


def test_nearest_with_wide_integers():
    parts = np.array([[2**40, -(2**40), 3], [0, 0, 0]], dtype=np.int64)
    book = np.array([[2**40 - 1, -(2**40), 3], [0, 1, 0], [0, 0, 0]], dtype=np.int64)
    code, dist = vector_codes.nearest(parts, book)
    assert code.tolist() == [0, 2] and dist.tolist() == [1, 0]


def test_vector_codes_keep_rows_with_large_components(spark):
    draw = np.random.default_rng(9)
    vectors = draw.normal(0, 1, (200, 32)).astype(np.float32)
    vectors[3] = 5_000.0  # in the codebook
    vectors[70, 4] = -4_096.0
    vectors[71] = 123_456.0
    vectors[72, 5] = 3e7
    vectors[73] = -2e12  # errors beyond 64 bits, an entry's mean moved by them
    vectors[74, 0] = 3e38
    rows = [(i, [float(c) for c in v], i % 3 or None) for i, v in enumerate(vectors)]
    want = codes_brute(rows)
    assert len(want) == 200
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    coded = vector_codes.compress(df)
    got = {r["row"]["vec_id"]: (r["code"], r["error"]) for r in coded.rows.collect()}
    assert got == {i: (c, e if e < 2**63 else None) for i, c, e, _, _ in want}
    assert coded.digest() == want[0][4]


# --- 12 ----------------------------------------------------------------------------------
def quality_brute(text):
    text = text or ""
    words = WORD.findall(text)
    n = len(words)
    lines = [line for line in text.split("\n") if regex.search(r"[^\x20\x09-\x0D]", line)]
    windows = [" ".join(words[i : i + 3]) for i in range(n - 2)]
    seen = collections.Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] >= 2 for k in range(3)}
    chars = sum(len(w) for w in words)
    symbols = len(regex.findall(r"[#*$%&|<>]", text))
    dup = len(lines) - len(set(lines))
    failed = n < 50 or 100 * len(covered) > 50 * n
    share = lambda a, b: a / max(b, 1)
    mean = share(chars, n)
    rejected = (
        mean < 3
        or mean > 10
        or share(symbols, n) > 0.1
        or share(dup, len(lines)) > 0.3
        or share(sum(1 for w in words if regex.search(r"\p{L}", w)), n) < 0.8
        or share(sum(1 for line in lines if regex.search(r"(\.\.\.|…)[\x20\x09-\x0D]*\Z", line)), len(lines)) > 0.3
        or share(sum(1 for line in lines if regex.match(r"[\x20\x09-\x0D]*[•*-]", line)), len(lines)) > 0.9
    )
    return n, chars, symbols, dup, len(covered), failed, not (failed or rejected)


def test_quality_rules(spark, odd_dir):
    want = [(doc_id, *quality_brute(text)) for doc_id, text, *_ in document_rows()]
    assert counted(Q["op12_quality_rules"](spark, odd_dir).collect()) == counted(want)


def test_quality_rules_in_any_order_and_long_texts(spark):
    line = "The quick brown fox jumps over the lazy dog near the river bank today"
    texts = [
        "\n".join([line] * 400),  # duplicate lines
        " ".join(f"w{i}" for i in range(60_000)),  # long, no repeats
        ("a b c " * 20_000) + "x",  # repeated windows
        "... ...\n" * 80,
        "\n".join(f"- item {i} of the list with words" for i in range(100)),
        " ".join(["#$%&"] * 60),
        None,
        "",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = [(i, *quality_brute(t)) for i, t in enumerate(texts)]
    names = [name for name, _ in quality_rules.RULES]
    for order in (names, names[::-1]):
        got = quality_rules.judge(df, order=order).select(
            "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
        )
        assert counted(got.collect()) == counted(want)


def test_rule_order_measures_every_rule(spark, odd_dir):
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    order = quality_rules.rule_order(docs.union(docs).union(docs))
    assert sorted(name for name, _, _ in order) == sorted(name for name, _ in quality_rules.RULES)
    assert all(0 <= share <= 1 and cost >= 0 for _, share, cost in order)


# --- 13 ----------------------------------------------------------------------------------
def whitening_brute(rows, most=16):
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max(len(v) for _, v in kept)
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] + [1_000_000] * (width - len(v)) for _, v in kept])
    fit = np.unique(x, axis=0)
    n, s = fit.shape[0], fit.sum(axis=0)
    cov = np.cov(fit.T, bias=True)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    dev = [int(((n * r.astype(object) - s.astype(object)) ** 2).sum()) for r in x]
    white = (x - s / n) @ vectors / np.sqrt(values)
    return n, dev, white, values / np.trace(cov), [i for i, _ in kept]


def test_whitening(spark, odd_dir):
    rows = pq.read_table(f"{odd_dir}/embeddings.parquet").select(["vec_id", "embedding"]).to_pylist()
    n, dev, white, explained, ids = whitening_brute([(r["vec_id"], r["embedding"]) for r in rows])
    got = Q["op13_whitening"](spark, odd_dir).collect()
    assert len(got) == len(ids) * white.shape[1]
    want = collections.defaultdict(list)
    for at, vec_id in enumerate(ids):  # identifiers repeat: compare per identifier as lists
        for k in range(1, white.shape[1] + 1):
            want[vec_id, k].append((dev[at], white[at, k - 1]))
    have = collections.defaultdict(list)
    for r in got:
        assert r["n"] == n
        assert abs(r["explained"] - explained[r["component"] - 1]) <= 1e-4 * explained[r["component"] - 1]
        have[r["vec_id"], r["component"]].append((r["deviation"], r["whitened"]))
    assert set(want) == set(have)
    signs = {}
    for (vec_id, k), rows in want.items():
        mine = sorted(have[vec_id, k])
        rows = sorted(rows)
        assert [d for d, _ in mine] == [d for d, _ in rows]
        for (_, a), (_, b) in zip(mine, rows, strict=True):
            if abs(b) > 1e-6:
                sign = signs.setdefault(k, math.copysign(1, a * b))
                assert abs(a - sign * b) < 1e-7
    assert 0 <= got[0]["identity_error"] <= 1e-4


@pytest.mark.parametrize("spectrum", [[5, 4, 3, 2, 1], [3, 3, 3, 1, 1, 0], [1e6, 1, 1e-6], [2] * 7, [1, 1 + 1e-12, 7]])
def test_spectral_divide_and_conquer(spectrum):
    draw = np.random.default_rng(len(spectrum))
    basis, _ = np.linalg.qr(draw.standard_normal((len(spectrum), len(spectrum))))
    a = basis @ np.diag(spectrum) @ basis.T
    values, vectors = whitening.spectral(a)
    assert np.allclose(sorted(values), sorted(spectrum), rtol=0, atol=1e-9 * max(spectrum))
    assert np.abs(vectors.T @ vectors - np.eye(len(spectrum))).max() < 1e-12
    assert np.abs(a @ vectors - vectors * values).max() < 1e-9 * max(spectrum)


def test_whitening_of_one_vector_and_copies(spark):
    df = spark.createDataFrame([(1, [0.5, 0.25]), (2, [0.5, 0.25]), (3, None)], "vec_id long, embedding array<float>")
    assert Q["op13_whitening"].__name__ == "op13_whitening"
    fitted = whitening.whiten(df)
    assert fitted.n == 1 and fitted.rows.collect() == []


# --- 7: long runs ------------------------------------------------------------------------
@pytest.mark.parametrize("piece", ["1", "@", "$", "a", "a1", "1a", "é@", "A", "!"])
def test_toxicity_features_of_one_megabyte_runs(piece):
    import time

    from hangarflow.llm import toxicity

    text = piece * (1_000_000 // len(piece))
    began = time.perf_counter()
    toxicity.features_of(text, {"a": 1.0}, {})
    assert time.perf_counter() - began < 10


def test_mixed_pattern_finds_what_it_found_before():
    import random
    import re

    from hangarflow.llm import toxicity

    before = re.compile(r"[^\W\d_]+(?:[0-9@$*!+|]+[^\W\d_]+)+|[0-9@$]+[^\W\d_]{2,}(?:[0-9@$*!]+[^\W\d_]*)*")
    draw = random.Random(7)
    for _ in range(5_000):
        text = "".join(draw.choice("ab1@$*!+|_ Zé9x ") for _ in range(draw.randrange(40)))
        assert toxicity._MIXED.findall(text) == before.findall(text)
