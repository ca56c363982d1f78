"""Max-score scoring over weight blocks against all pairs, on skewed sparse vectors."""

import collections
import math

import numpy as np
import pytest

from hangarflow.operators import tfidf


def _vectors(draw, keys, terms, per_key, skew):
    rows = []
    for key in keys:
        chosen = set(np.minimum(draw.zipf(skew, per_key) - 1, terms - 1).tolist())
        # As in TF-IDF, common terms weigh little.
        weights = {t: (draw.random() + 0.05) * math.log(1 + terms / (t + 1)) for t in chosen}
        norm = math.sqrt(sum(w * w for w in weights.values()))
        rows += [(key, f"t{t}", w / norm) for t, w in weights.items()]
    return rows


def _all_pairs(queries, catalog):
    by_term = collections.defaultdict(list)
    for code, term, w in catalog:
        by_term[term].append((code, w))
    scores = collections.Counter()
    for key, term, w in queries:
        for code, v in by_term[term]:
            scores[key, code] += w * v
    return scores


@pytest.fixture(scope="module")
def tables(spark):
    draw = np.random.default_rng(4)
    catalog = _vectors(draw, [f"{c:02d}-{c % 5:02d}" for c in range(300)], 3000, 60, 1.6)
    queries = _vectors(draw, list(range(400)), 3000, 25, 1.6)
    q = spark.createDataFrame(queries, "doc_id long, term string, weight double")
    c = spark.createDataFrame(catalog, "ata04 string, term string, weight double")
    return q, c, _all_pairs(queries, catalog)


def test_threshold(spark, tables):
    q, c, scores = tables
    report = {}
    got = tfidf.best_match(tfidf.bounded_scores(q, c, "doc_id", 0.2, block=8, report=report), "doc_id", 0.2).collect()
    best = {}
    for (key, code), s in scores.items():
        if s >= 0.2 and (key not in best or (-s, code) < (-best[key][1], best[key][0])):
            best[key] = (code, s)
    assert {r.doc_id: r.ata04 for r in got} == {k: v[0] for k, v in best.items()}
    assert all(abs(r.score - best[r.doc_id][1]) < 1e-12 for r in got)
    assert report["candidates"] <= report["sharing"]


def test_top_k(spark, tables):
    q, c, scores = tables
    report = {}
    got = tfidf.top_matches(tfidf.bounded_scores(q, c, "doc_id", k=3, block=8, report=report), "doc_id").collect()
    by_key = collections.defaultdict(list)
    for (key, code), s in scores.items():
        by_key[key].append((-s, code))
    want = {(key, code, rank) for key, pairs in by_key.items() for rank, (_, code) in enumerate(sorted(pairs)[:3], 1)}
    assert {(r.doc_id, r.ata04, r.rank) for r in got} == want
    assert report["candidates"] <= report["sharing"]
