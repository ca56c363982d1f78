"""Catalog, TF-IDF and vector search against brute force on small fixtures."""

import math
import random
import re
from collections import Counter
from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from hangarflow.functions.text import ENGLISH_STOP_WORDS
from hangarflow.operators import catalog as catalog_ops
from hangarflow.operators import tfidf
from hangarflow.operators import vectors as vector_ops
from hangarflow.operators.documents import parse_documents
from hangarflow.plans.build import build_catalog


@pytest.fixture(scope="module")
def lines():
    """Training lines of three codes; the first owns most of them."""
    rng = random.Random(11)
    words = [a + b for a in ("oil", "fuel", "air", "gear", "door", "the") for b in ("", "er", "ing", "s")]
    rows = []
    for code, n in (("21-10", 900), ("22-20", 60), ("23-30", 1)):
        for i in range(n):
            part = 1 if i == 0 else rng.choice([2, 3, 4])
            text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 4)))
            rows.append((code, part, md5(f"{code}{i}".encode()).hexdigest(), text))
    return rows


def _tokens(text):
    return [w for w in re.findall(r"\w\w+", text.lower()) if w not in ENGLISH_STOP_WORDS]


def _grams(tokens):
    return Counter(" ".join(tokens[i : i + n]) for n in (1, 2, 3) for i in range(len(tokens) - n + 1))


def _running_texts(lines):
    texts = {}
    for code, _, _, text in sorted(lines, key=lambda r: r[:3]):
        texts[code] = texts.get(code, "") + " " + text
    return texts


def _line_frame(spark, lines, partitions=8):
    return spark.createDataFrame(lines, "ata04 string, part int, line_order string, text string").repartition(partitions)


@pytest.mark.parametrize("partitions, digits", [(1, 2), (8, 2), (8, 1), (8, 3)])
def test_catalog_terms_cross_lines_and_ranges(spark, lines, partitions, digits):
    terms = tfidf.catalog_terms(_line_frame(spark, lines, partitions), range_digits=digits)
    got = {(r.ata04, r.term): r.tf for r in terms.collect()}
    want = {
        (code, term): n
        for code, text in _running_texts(lines).items()
        for term, n in _grams(_tokens(text)).items()
    }
    assert got == want


def _brute_model(lines, max_features, max_df):
    counts = {code: _grams(_tokens(text)) for code, text in _running_texts(lines).items()}
    n = len(counts)
    df = Counter(t for c in counts.values() for t in c)
    total = sum(counts.values(), Counter())
    allowed = [t for t in df if df[t] <= max_df * n]
    vocab = sorted(allowed, key=lambda t: (-total[t], t))[:max_features]
    idf = {t: math.log((1 + n) / (1 + df[t])) + 1 for t in vocab}
    return counts, idf


def _unit(counts, idf):
    raw = {t: n * idf[t] for t, n in counts.items() if t in idf}
    norm = math.sqrt(sum(w * w for w in raw.values()))
    return {t: w / norm for t, w in raw.items()}


def test_model_and_scores(spark, lines):
    counts, idf = _brute_model(lines, 100, 0.8)
    vocabulary, vectors = tfidf.fit(_line_frame(spark, lines), max_features=100, max_df=0.8)
    assert {r.term: pytest.approx(r.idf) for r in vocabulary.collect()} == idf
    entries = {code: _unit(c, idf) for code, c in counts.items()}
    got = {(r.ata04, r.term): r.weight for r in vectors.collect()}
    assert got == {(c, t): pytest.approx(w) for c, v in entries.items() for t, w in v.items()}

    texts = ["oil fueling doors", "gearing the airs oiler fuels", "nothing known", "", None]
    asked = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    weights = tfidf.text_weights(asked, "id", vocabulary)
    scores = {(r.id, r.ata04): r.score for r in tfidf.cosine_scores(weights, vectors, "id").collect()}
    want = {}
    for i, text in enumerate(texts):
        q = _unit(_grams(_tokens(text or "")), idf)
        for code, v in entries.items():
            if set(q) & set(v):
                want[i, code] = pytest.approx(sum(w * v.get(t, 0) for t, w in q.items()))
    assert scores == want
    assert all(0 < s <= 1 + 1e-9 for s in scores.values())
    salted = tfidf.cosine_scores(weights, vectors, "id", shuffle=True)
    assert {(r.id, r.ata04): r.score for r in salted.collect()} == want

    # Pruning texts by their reach loses no score.
    for least in (0.05, 0.3, 0.9):
        pruned = {(r.id, r.ata04): r.score for r in tfidf.cosine_scores(weights, vectors, "id", least).collect()}
        assert pruned == {pair: score for pair, score in want.items() if scores[pair] >= least}

    # The counted way and the vocabulary-first way agree.
    counted = tfidf.weigh(tfidf.text_terms(asked, "id"), vocabulary, "id")
    assert sorted((r.id, r.term, round(r.weight, 9)) for r in counted.collect()) == sorted(
        (r.id, r.term, round(r.weight, 9)) for r in weights.collect()
    )


def test_ties_and_limits(spark):
    scores = spark.createDataFrame(
        [("a", "22-10", 0.5), ("a", "21-10", 0.5), ("a", "23-10", 0.4), ("b", "21-10", 0.19)],
        "id string, ata04 string, score double",
    )
    best = tfidf.best_match(scores, "id").collect()
    assert [(r.id, r.ata04, r.score) for r in best] == [("a", "21-10", 0.5)]
    top = tfidf.top_matches(scores, "id", 2).orderBy("id", "rank").collect()
    assert [(r.id, r.ata04, r["rank"]) for r in top] == [("a", "21-10", 1), ("a", "22-10", 2), ("b", "21-10", 1)]


MANUALS = [
    ("tsm/21-26-00_b.sgm", "<d><title>Pack</title><para>The pack valve leak was found inside</para></d>"),
    ("tsm/21-26-00_c.sgm", "<d><title>Air packs</title><warning>CAB PR EXCESS ALT seen</warning></d>"),
    ("tsm/21-26-00_d.sgm", "<d><title>Later name</title><description>no sign of it</description></d>"),
    ("dm.sgm", "<d><dmc><systemCode>7</systemCode><subSystemCode>3</subSystemCode></dmc><techName>Lifting gear</techName></d>"),
    ("none.sgm", "<d><title>Dropped document</title></d>"),
]


def test_catalog(spark):
    docs = spark.createDataFrame(MANUALS, "filename string, markup string")
    items = catalog_ops.catalog_items(parse_documents(docs))
    rows = {(r.ata04, r.kind): set() for r in items.collect()}
    for r in items.collect():
        rows[r.ata04, r.kind].add(r.value)
    assert rows["21-26", "keyword"] == {
        "pack", "valve", "leak", "found", "inside", "packs", "excess", "seen", "later", "name", "sign"
    }
    assert rows["21-26", "warning"] == {"CAB PR EXCESS ALT seen", "CAB PR EXCESS"}
    assert rows["21-26", "description"] == {"The pack valve leak was found inside"}
    saved = {r.ata04: r for r in catalog_ops.saved_catalog(items).collect()}
    assert saved["21-26"].system_name == "Air packs"  # "Pack" is too short
    assert saved["7-3"].system_name == "Lifting gear" and saved["7-3"].keywords == []
    assert saved["21-26"].keywords == sorted(rows["21-26", "keyword"])
    found = catalog_ops.search_by_keyword(catalog_ops.saved_catalog(items), "EXCESS").collect()
    assert [r.ata04 for r in found] == ["21-26"]

    model = build_catalog(docs)
    asked = spark.createDataFrame([(1, "pack valve leak"), (2, "lifting gear noise"), (3, " ")], "id int, text string")
    got = tfidf.predict_ata(asked, "id", model.vocabulary, model.vectors, model.catalog).collect()
    assert {(r.id, r.ata04, r.system_name) for r in got} == {(1, "21-26", "Air packs"), (2, "7-3", "Lifting gear")}


def test_first_values_caps(spark):
    rows = [("21-26", kind, f"{kind}{i:03}") for kind in ("keyword", "warning") for i in range(80)]
    items = spark.createDataFrame(rows, "ata04 string, kind string, value string").repartition(8)
    saved = catalog_ops.first_values(items, {"keyword": 50, "warning": 20}).collect()
    got = Counter(r.kind for r in saved)
    assert got == {"keyword": 50, "warning": 20}
    assert max(r.value for r in saved if r.kind == "warning") == "warning019"


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 8)).astype("float32")
    # A third of all chunks are copies of one vector.
    return np.concatenate([base, np.repeat(base[:1], 30, axis=0)])


def _brute(points, k):
    kinds = ["TSM", "FIM", "AMM"]
    hits = set()
    for q in range(len(points)):
        d = ((points[q].astype("float64") - points.astype("float64")) ** 2).sum(axis=1)
        for t, kind in enumerate(kinds):
            ids = [i for i in range(len(points)) if i % 3 == t]
            ids.sort(key=lambda i: (round(d[i], 12), i))
            hits |= {(q, kind, i, rank + 1) for rank, i in enumerate(ids[:k])}
    return hits


@pytest.mark.parametrize("blocks", [{}, {"query_block": 16, "chunk_block": 8}])
@pytest.mark.parametrize("k", [4, 50])
def test_knn(spark, points, blocks, k):
    rows = [(i, ["TSM", "FIM", "AMM"][i % 3], f"2{i % 4}-00", p.tolist()) for i, p in enumerate(points)]
    chunks = spark.createDataFrame(rows, "chunk_id long, manual_type string, ata04 string, embedding array<float>").repartition(5)
    queries = chunks.selectExpr("chunk_id AS query_id", "ata04", "embedding")
    hits = vector_ops.knn_per_type(queries, chunks, k, **blocks)
    got = {(r.query_id, r.manual_type, r.chunk_id, r["rank"]) for r in hits.collect()}
    assert got == _brute(points, k)
    if not blocks and k == 4:
        own = vector_ops.knn_by_ata(queries, chunks, 2)
        codes = {r[0]: r[2] for r in rows}
        seen = own.collect()
        assert all(codes[r.chunk_id] == codes[r.query_id] for r in seen)
        assert max(Counter(r.query_id for r in seen).values()) <= 2
        assert vector_ops.is_available(chunks)
        assert sorted(r[0] for r in vector_ops.index_types(chunks).collect()) == ["AMM", "FIM", "TSM"]


def test_search_with_text_ids(spark, points):
    rows = [(f"c{i:03}", "TSM", "21-00", p.tolist()) for i, p in enumerate(points[:20])]
    chunks = spark.createDataFrame(rows, "chunk_id string, manual_type string, ata04 string, embedding array<float>")
    queries = chunks.selectExpr("chunk_id AS query_id", "embedding")
    for blocks in ({}, {"query_block": 4, "chunk_block": 4}):
        hits = vector_ops.knn_per_type(queries, chunks, 1, **blocks).collect()
        assert sorted((r.query_id, r.chunk_id) for r in hits) == [(r[0], r[0]) for r in rows]


def test_queries_without_vectors_and_absent_types(spark):
    schema = "chunk_id long, manual_type string, ata04 string, embedding array<float>"
    chunks = spark.createDataFrame([(1, "TSM", "21-00", [0.0, 1.0])], schema)
    queries = spark.createDataFrame([(1, [0.0, 0.0]), (2, None)], "query_id long, embedding array<float>")
    hits = vector_ops.knn_per_type(queries, chunks).collect()
    assert [(r.query_id, r.chunk_id, r.score) for r in hits] == [(1, 1, 0.5)]
    filled = vector_ops.with_fallback(chunks.withColumn("embedding", F.lit(None).cast("array<float>")), 3).collect()
    assert filled[0].embedding == [0.0, 0.0, 0.0] and filled[0].is_fallback


def test_other_stop_words(spark, lines):
    """A longer list of stop words takes its words, and n-grams over them, out of model and texts."""
    longer = [*tfidf.ENGLISH_STOP_WORDS, "oil", "fuels"]
    plain, _ = tfidf.fit(_line_frame(spark, lines), max_features=1000, max_df=1.0)
    fewer, vectors = tfidf.fit(_line_frame(spark, lines), stop_words=longer, max_features=1000, max_df=1.0)
    plain, fewer_terms = ({r.term for r in v.collect()} for v in (plain, fewer))
    assert any("oil" in t.split() for t in plain) and not any({"oil", "fuels"} & set(t.split()) for t in fewer_terms)
    asked = spark.createDataFrame([(1, "oil fuels oil"), (2, "oil doors")], "id int, text string")
    weights = tfidf.text_weights(asked, "id", fewer, stop_words=longer)
    assert {r.id for r in weights.collect()} <= {2}
    assert {r.id for r in tfidf.cosine_scores(weights, vectors, "id").collect()} <= {2}


def test_missing_fallback_and_equal_vectors(spark):
    """Chunks without a usable vector are not searched; any number of ties goes to the lowest ids."""
    equal = spark.range(10_000).selectExpr(
        "id AS chunk_id", "'TSM' AS manual_type", "'21-26' AS ata04", "array(1.0f, 0.0f, 0.0f) AS embedding", "false AS is_fallback"
    )
    odd = spark.createDataFrame(
        [(-1, "TSM", "21-26", None, False), (-2, "TSM", "21-26", [0.0, 0.0, 0.0], True), (-3, "TSM", "32-47", [0.9, 0.0, 0.0], None)],
        "chunk_id long, manual_type string, ata04 string, embedding array<float>, is_fallback boolean",
    )
    queries = spark.createDataFrame(
        [(1, "21-26", [1.0, 0.0, 0.0]), (2, "32-47", [0.1, 0.0, 0.0]), (3, "21-26", None)],
        "query_id int, ata04 string, embedding array<float>",
    )
    chunks = equal.unionByName(odd)
    hits = vector_ops.knn_per_type(queries, chunks, k=4).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.chunk_id) for r in hits] == [(1, 0), (1, 1), (1, 2), (1, 3), (2, -3), (2, 0), (2, 1), (2, 2)]
    own = vector_ops.knn_by_ata(queries, chunks, k=3, prefilter=True).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.chunk_id) for r in own] == [(1, 0), (1, 1), (1, 2), (2, -3)]
