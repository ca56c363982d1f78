"""Every registered operator against a brute-force version on small awkward tables."""

import base64
import collections
import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from odd_tables import document_rows, page_urls
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from hangarflow.llm import byte_bpe, dimension_scan, exact_dedup, jaccard, mixture, queries, token_files, url_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
Q = queries.QUERIES


def rows_of(spark, name, folder):
    return Q[name](spark, folder).collect()


def counted(rows):
    return collections.Counter(map(tuple, rows))


@pytest.mark.parametrize("name", sorted(Q))
def test_empty_tables(spark, empty_dir, name):
    assert rows_of(spark, name, empty_dir) == []


def test_empty_pipeline(spark, empty_dir):
    assert corpus_pipeline.run(spark, empty_dir).collect() == []


# --- 1 ---------------------------------------------------------------------------------
def test_token_files(spark, odd_dir):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.encode_special_tokens = True
    want, start = [], 0
    for doc_id, text, *_ in sorted(document_rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert counted(rows_of(spark, "op1_token_files", odd_dir)) == counted(want)


def test_single_tokens(spark, odd_dir, tmp_path):
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    folder = str(tmp_path / "files")
    token_files.write(docs, folder, public_tokenizers.path("word_bpe_49k.json"), 1)
    whole = sorted(token_files.read_documents(spark, folder).collect(), key=lambda r: r["start"])
    ids = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in whole])
    positions = [0, 1, len(ids) - 1, len(ids) // 2, len(ids) + 5, *range(100, len(ids), 997)]
    asked = spark.createDataFrame([(p,) for p in positions], "position long")
    found = {r["position"]: r["token_id"] for r in token_files.read_tokens(spark, folder, asked).collect()}
    assert found == {p: ids[p] for p in positions if p < len(ids)}


@pytest.mark.parametrize("count", [0, 1, 511, 512, 513, 5000])
def test_codes(count):
    ids = np.random.default_rng(count).choice(np.r_[np.arange(300), np.arange(1 << 24, (1 << 24) + 50)], count).astype(np.uint32)
    levels, bitmaps, ranks = token_files.pack(ids)
    assert (token_files.unpack(levels, bitmaps, count) == ids).all()
    positions = np.arange(count)[::-1]
    assert (token_files.at(levels, bitmaps, ranks, positions) == ids[positions]).all()


# --- 2 ---------------------------------------------------------------------------------
def test_languages(spark, odd_dir):
    rows = rows_of(spark, "op2_language_filters", odd_dir)
    lang = {r[0]: r[2] for r in document_rows()}
    text = {r[0]: r[1] for r in document_rows()}
    assert len(rows) == len(document_rows())
    for r in rows:
        letters = any(c.isalpha() for c in text[r.doc_id] or "")
        assert (r.lang_pred == "und") == (not letters)
        assert 0 <= r.score <= 1
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    prose = [r for r in rows if r.doc_id is not None and 0 <= r.doc_id < 120 and r.held_out]
    assert [r.doc_id for r in prose if r.lang_pred != lang[r.doc_id]] == [] and prose


# --- 3 ---------------------------------------------------------------------------------
def test_interpolation(spark, odd_dir):
    docs = [(r[0], [*WORD.findall((r[1] or "").translate(LOWER)), None]) for r in document_rows()]
    trains = [i is None or zlib.crc32(str(i).encode()) % 5 != 1 for i, _ in docs]
    words, pairs = collections.Counter(), collections.Counter()
    for (_, tokens), train in zip(docs, trains, strict=True):
        if train:
            words.update(tokens)
            pairs.update(zip([None, *tokens], tokens))
    n, v = sum(words.values()), len(words)
    held = collections.defaultdict(list)
    bucket = lambda c: 0 if c <= 0 else 1 + int(math.log2(c))
    for (_, tokens), train in zip(docs, trains, strict=True):
        for a, b in zip([None, *tokens], tokens) if train else ():
            deleted = (pairs[a, b] - 1) / (words[a] - 1) if words[a] > 1 else 0
            held[bucket(words[a] - 1)].append((deleted, (words[b] - 1) / (n - 1), 1 / (v + 1)))

    def learn(estimates):
        estimates, weights = np.array(estimates), np.full(3, 1 / 3)
        for _ in range(100):
            parts = estimates * weights
            weights = (parts / parts.sum(axis=1, keepdims=True)).mean(axis=0)
        return weights

    learned = {b: learn(e) for b, e in held.items()}
    together = learn([e for many in held.values() for e in many])
    learned[0] = np.r_[0, learned.get(0, together)[1:] / learned.get(0, together)[1:].sum()]
    want = collections.defaultdict(list)
    for (doc_id, tokens), train in zip(docs, trains, strict=True):
        base = sum(math.log10((words[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens)
        model = 0.0
        for a, b in zip([None, *tokens], tokens):
            w = learned.get(bucket(words[a]), together)
            model += math.log10(w[0] * pairs[a, b] / max(1, words[a]) + w[1] * words[b] / n + w[2] / (v + 1))
        want[doc_id].append((not train, len(tokens), sum(words[t] > 0 for t in tokens), n, base, model))
    got = rows_of(spark, "op3_deleted_interpolation", odd_dir)
    assert len(got) == len(docs)
    for r in got:
        expected = want[r.doc_id][0]
        assert tuple(r)[1:5] == expected[:4]
        assert r.base_score == pytest.approx(expected[4], rel=1e-9)
        assert r.score == pytest.approx(expected[5], rel=5e-3)  # the weights come from a grid of ratios


# --- 4 ---------------------------------------------------------------------------------
def _targets(sizes, weights, total):
    capped = set()
    while True:
        rest = total - sum(2 * sizes[s] for s in capped)
        whole = sum(weights[s] for s in sizes if s not in capped)
        above = {s for s in sizes if s not in capped and rest * weights[s] / whole > 2 * sizes[s]}
        if not above:
            return {s: 2.0 * sizes[s] if s in capped else rest * weights[s] / whole for s in sizes}
        capped |= above


def test_mixture(spark, odd_dir):
    docs = document_rows()
    size = [len(WORD.findall(r[1] or "")) for r in docs]
    sources = sorted({r[3] for r in docs}, key=lambda s: (s is None, s or ""))
    weights = {s: (5, 2, 1)[at % 3] for at, s in enumerate(sources)}
    sizes = {s: sum(n for n, r in zip(size, docs, strict=True) if r[3] == s) for s in sources}
    targets = _targets(sizes, weights, 1.5 * sum(size))
    rows = rows_of(spark, "op4_source_mixture", odd_dir)
    assert counted((r.doc_id, r["size"], r.source_size) for r in rows) == counted(
        (d[0], n, sizes[d[3]]) for d, n in zip(docs, size, strict=True)
    )
    by_size = {n: s for s, n in sizes.items()}
    taken = collections.Counter()
    for r in rows:
        assert 0 <= r.taken <= 2 * r["size"]
        assert r.target == pytest.approx(targets[by_size[r.source_size]])
        taken[by_size[r.source_size]] += r.taken
    for s in sources:  # within the discrepancy of a few blocks
        assert abs(taken[s] - targets[s]) <= 4 * 128
    assert counted(rows) == counted(rows_of(spark, "op4_source_mixture", odd_dir))


def test_schedule_is_even(spark):
    sources = spark.createDataFrame([("a", 10**6, 0.0, 0.5), ("b", 10**6, 0.5, 0.8), ("c", 10**6, 0.8, 1.0)], "source string, source_size long, low double, high double")
    slots = sorted(mixture.schedule(spark, sources, 1000, 128).collect(), key=lambda r: r["slot"])
    assert [r["slot"] for r in slots] == list(range(1000))
    for end in (10, 100, 500, 1000):
        seen = collections.Counter(r["source"] for r in slots[:end])
        assert all(abs(seen[s] - p * end) <= 3 for s, p in (("a", 0.5), ("b", 0.3), ("c", 0.2)))
    for s in "abc":
        assert [r["rank"] for r in slots if r["source"] == s] == list(range(sum(r["source"] == s for r in slots)))


def test_mixture_of_tiny_sources(spark):
    """Each target is met to half a block of 1/64 of it, by sources of few words and by large ones, in one or more passes."""
    sizes = {f"tiny{at:03}": [7, 1, 12] for at in range(300)} | {f"word{at}": [1] for at in range(20)}
    sizes |= {f"some{at}": [90 + at] * 3 for at in range(20)} | {None: [3, 4], "big": [1000] * 100}
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    rows = [(f"{s}-{at}", s, n) for s in names for at, n in enumerate(sizes[s])]
    sized = spark.createDataFrame(rows, "doc_id string, source string, size int")
    for weights, share in (((5, 2, 1), 0.5), ((1,), 1.5), ((5, 2, 1), 2.0)):
        total = {s: sum(n) for s, n in sizes.items()}
        given = {s: weights[at % len(weights)] for at, s in enumerate(names)}
        want = _targets(total, given, share * sum(total.values()) * (1 - 1e-12))
        sources = mixture.targets(sized, weights, share)
        mixed = mixture.mix(sized, sources)
        taken = collections.Counter()
        for r in mixture.taken_words(mixed, sources).collect():
            taken[r["source"]] += r.taken
            assert r.taken <= 2 * r["size"]
        for s in names:
            assert abs(taken[s] - want[s]) <= max(0.5, want[s] / 128) + 1e-6, s
        slots = [r.slot for r in mixed.where("slot IS NOT NULL").select("slot", "source").distinct().collect()]
        assert len(slots) == len(set(slots)) == sources.agg(F.sum("quota")).first()[0]


# --- 5 ---------------------------------------------------------------------------------
def test_byte_bpe(spark, odd_dir):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for doc_id, text, *_ in document_rows():
        ids = library.encode_ordinary(text or "")
        joined = ",".join(map(str, ids)).encode()
        want.append((doc_id, len(ids), hashlib.sha256(joined).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert counted(rows_of(spark, "op5_byte_bpe", odd_dir)) == counted(want)


def test_decoding_stored_ids(spark, odd_dir):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    encoded = byte_bpe.encode(docs, path, public_tokenizers.PATTERN)
    rows = byte_bpe.decode(encoded, path).select("row.text", "decoded").collect()
    assert len(rows) == len(document_rows()) and all((r["text"] or "").encode() == bytes(r["decoded"]) for r in rows)


def test_spans_of_split_characters():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    text = "naïve 😀😀 漢"
    ids = np.frombuffer(byte_bpe.text_encoder(path, public_tokenizers.PATTERN).encode(text), "<u4")
    in_bytes, in_characters = byte_bpe.token_spans(ids, path)
    assert in_bytes[-1] == len(text.encode()) and in_characters[-1] == len(text)
    for at in range(len(ids)):
        part = text.encode()[in_bytes[at] : in_bytes[at + 1]]
        assert part == byte_bpe.token_bytes(path)[ids[at]]
        assert in_characters[at + 1] - in_characters[at] == sum(b & 0xC0 != 0x80 for b in part)


def test_runs_and_every_character():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {t: i for i, t in enumerate(byte_bpe.token_bytes(path))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoder = byte_bpe.text_encoder(path, public_tokenizers.PATTERN)
    texts = [c * n for c in "a -=_.#\n\u00a0é漢" for n in range(1, 40)]
    texts += ["a" + "".join(map(chr, range(at, at + 64))) + " b" for at in [*range(0, 0x600, 64), 0x2000, 0x3000, 0x1F600]]
    for text in texts:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode_ordinary(text), ascii(text)


@pytest.mark.parametrize("pattern", [r"\p{L}+'?\p{L}*|[^\p{L}]", r"[\s\S]{1,7}", public_tokenizers.PATTERN])
def test_ids_and_offsets_of_any_pattern(spark, pattern):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {t: i for i, t in enumerate(byte_bpe.token_bytes(path))}
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    texts = [None, "", "don't, I said  twice", "naïve 😀😀 漢字\n x", " a\tb ", "word " * 50]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = byte_bpe.encode(docs, path, pattern, offsets=True).select("row.text", "ids", "byte_offsets", "char_offsets").collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = r.text or ""
        assert r.ids == library.encode_ordinary(text), text
        in_bytes, in_characters = [0], [0]
        for token in r.ids:
            part = library.decode_single_token_bytes(token)
            in_bytes.append(in_bytes[-1] + len(part))
            in_characters.append(in_characters[-1] + sum(byte & 0xC0 != 0x80 for byte in part))
        assert (r.byte_offsets, r.char_offsets) == (in_bytes, in_characters)
        assert (in_bytes[-1], in_characters[-1]) == (len(text.encode()), len(text))


# --- 6 ---------------------------------------------------------------------------------
@pytest.mark.parametrize("hot_rows", [1_000, 5])
def test_exact_dedup(spark, odd_dir, monkeypatch, hot_rows):
    monkeypatch.setattr(exact_dedup, "HOT_ROWS", hot_rows)
    groups = collections.defaultdict(list)
    for doc_id, text, *_ in document_rows():
        groups[text or ""].append(doc_id)
    want = collections.Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        first = True
        for doc_id in sorted(ids, key=lambda i: (i is None, -(i or 0))):
            want[doc_id, keep, len(ids), first, hashlib.sha256(text.encode()).hexdigest()] += 1
            first = False
    assert counted(rows_of(spark, "op6_content_sort", odd_dir)) == want


def test_exact_dedup_keeps_smallest_and_all_columns(spark, odd_dir):
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    kept = exact_dedup.content_sort(docs, normalise=F.lower).where("kept").select("row.*")
    assert kept.columns == docs.columns
    first = {}
    for doc_id, text, *_ in document_rows():
        key = (text or "").lower()
        first[key] = min((i for i in (first.get(key), doc_id) if i is not None), default=None)
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted(first.values(), key=str)


# --- 7 ---------------------------------------------------------------------------------
def test_toxicity(spark):
    folder = "/root/testdata/sf0.01"
    rows = rows_of(spark, "op7_toxicity", folder)
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    toxic, clean = [s for s, y in held if y], [s for s, y in held if not y]
    better = sum((a > b) + 0.5 * (a == b) for a in toxic for b in clean) / (len(toxic) * len(clean))
    assert better >= 0.85
    assert sum(s >= 0.5 for s in clean) <= 0.05 * len(clean)


def test_toxicity_of_odd_rows(spark, odd_dir):
    rows = rows_of(spark, "op7_toxicity", odd_dir)
    assert counted((r.doc_id,) for r in rows) == counted((d[0],) for d in document_rows())
    assert all(0 <= r.score <= 1 for r in rows)


# --- 8 ---------------------------------------------------------------------------------
def _nearest(table, k=20):
    rows = {}
    for vec_id, vector in table:
        if vector and len(vector) == 8 and all(x is not None and math.isfinite(x) for x in vector) and any(vector):
            rows[vec_id] = np.array(vector, np.float32).astype(np.float64)
    ids = np.array(sorted(rows))
    matrix = np.array([rows[i] for i in ids])
    found = {}
    for at, vec_id in enumerate(ids):
        if vec_id % 20 == 0:
            scores = matrix @ matrix[at]
            order = [o for o in np.lexsort((ids, -np.round(scores, 9))) if o != at][:k]
            found[int(vec_id)] = [(int(ids[o]), scores[o]) for o in order]
    return found


def test_dimension_scan(spark, odd_dir):
    table = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{odd_dir}/embeddings.parquet").collect()]
    want = _nearest(table)
    got = collections.defaultdict(dict)
    for r in rows_of(spark, "op8_dimension_scan", odd_dir):
        got[r.query_id][r["rank"]] = (r.vec_id, r.score)
    assert set(got) == set(want)
    hits = 0
    for query, expected in want.items():
        found = [got[query][rank] for rank in range(1, len(got[query]) + 1)]
        assert len(found) == len(expected)
        scores = dict(expected)
        for vec_id, score in found:
            if vec_id in scores:
                assert score == pytest.approx(scores[vec_id], abs=1e-12)
        assert found == sorted(found, key=lambda hit: (-hit[1], hit[0]))
        hits += len({v for v, _ in found} & set(scores))
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_scan_keeps_what_is_near():
    random = np.random.default_rng(2)
    points, query = random.normal(size=(3000, 64)), random.normal(size=64)
    distances = ((points - query) ** 2).sum(axis=1)
    blocks = dimension_scan.column_blocks(points)
    first = ((blocks[0] - query[: dimension_scan.COLUMNS]) ** 2).sum(axis=1)
    kept = dimension_scan.scan(query, blocks, first, np.arange(3000)[::-1], np.inf, 21)
    nearest = np.argsort(distances)[:20]
    assert len(set(nearest) & set(kept)) >= 19
    assert len(kept) < 1500


# --- 9 ---------------------------------------------------------------------------------
def test_url_rules(spark, odd_dir):
    want = []
    for page_id, url in enumerate(page_urls()):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = host.translate(LOWER)
        fitting = [
            (len(h + p), h + p, v)
            for h, p, v in queries.URL_RULES
            if (host == h or host.endswith("." + h)) and path.startswith(p)
        ]
        best = max(fitting, default=(0, None, "allow"))
        want.append((page_id, host, path, best[1], best[2]))
    assert counted(rows_of(spark, "op9_url_rules", odd_dir)) == counted(want)


def test_url_rules_without_rules(spark, odd_dir):
    pages = spark.read.parquet(f"{odd_dir}/pages.parquet")
    rules = spark.createDataFrame([(None, "/", "block")], "host string, path string, verdict string")
    judged = url_rules.judge(pages, rules, default="allow").collect()
    assert len(judged) == len(page_urls()) and {(r["rule"], r["verdict"]) for r in judged} == {(None, "allow")}


# --- 10 --------------------------------------------------------------------------------
def _components(docs):
    sets = collections.defaultdict(set)
    nodes = []
    for doc_id, text, *_ in docs:
        words = WORD.findall((text or "").translate(LOWER))
        own = {tuple(words[at : at + 5]) for at in range(len(words) - 4)} or ({tuple(words)} if words else set())
        nodes.append((doc_id, frozenset(own)))
    parent = {i: i for i, _ in nodes if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    known = [(i, s) for i, s in nodes if i is not None and s]
    for at, (a, x) in enumerate(known):
        for b, y in known[:at]:
            both = len(x & y)
            if 100 * both >= 75 * (len(x) + len(y) - both):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    del sets
    return [(i, len(s), None if i is None else root(i)) for i, s in nodes]


def test_jaccard_join(spark, odd_dir):
    assert counted(rows_of(spark, "op10_token_group_join", odd_dir)) == counted(_components(document_rows()))


@pytest.mark.parametrize("small", [3, 40])
def test_jaccard_join_with_small_parts(spark, monkeypatch, small):
    """Many subgroups, chunks, blocks and buckets give the same components."""
    for name in ("SUBGROUP", "CHUNK"):
        monkeypatch.setattr(jaccard, name, small)
    monkeypatch.setattr(jaccard, "BLOCK_TOKENS", 100 * small)
    monkeypatch.setattr(jaccard.K, "BUCKET_KEYS", 500)
    monkeypatch.setattr(jaccard, "LEADERS", 2)
    draw = np.random.default_rng(small)
    rows = []
    for cluster in range(6):
        words = [f"w{cluster}x{at}" for at in range(40)]
        shared = [f"s{at}" for at in range(60)]  # a passage that all clusters share
        for copy in range(12):
            text = words.copy()
            for place in draw.integers(0, 40, copy % 4):
                text[place] = f"e{draw.integers(0, 3)}"
            rows.append((100 * cluster + copy, " ".join(text + shared[: 20 * (cluster % 3)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert counted(jaccard.connect(docs).collect()) == counted(_components(rows))


def test_hot_shingles_are_one_entry_a_block(monkeypatch):
    class Task:
        @staticmethod
        def get():
            return Task

        @staticmethod
        def partitionId():
            return 0

    monkeypatch.setattr(jaccard, "TaskContext", Task)
    hot, own = np.arange(2, 12, 2, dtype=np.uint64) << np.uint64(40), np.uint64(1) << np.uint64(20)
    sets = [np.r_[np.uint64(at + 1) * own, hot] for at in range(500)]
    held = [(at, len(s), s, jaccard._digest(s)) for at, s in enumerate(sets)]
    about, entries = jaccard._half_entries(held + held, 0, 0)
    (keys,), (counts,) = entries.column("keys").to_pylist(), entries.column("counts").to_pylist()
    assert entries.column("n").to_pylist() == [505] and len(keys) == 505 * jaccard.WIDTH // 8
    assert jaccard.K.unpack(counts).tolist() == [1] * 500 + [500] * 5
    often, owner = jaccard._unpack_owners(about.column("keys")[0].as_py())
    assert often.tolist() == [1] * 500 + [500] * 5 and owner.tolist() == [*range(500)] * 6


def test_one_of_each_without_identifiers(spark):
    base, other = [f"w{at}" for at in range(60)], [f"v{at}" for at in range(60)]

    def near(words, at):
        return " ".join([*words[:at], "edit", *words[at + 1 :]])

    rows = [(None, near(base, at), "x") for at in range(0, 60, 9)]  # near copies, none identified
    rows += [(None, near(other, 0), "x"), (4, near(other, 30), "x"), (9, near(other, 50), "x")]
    rows += [(4, "a text of its own under an identifier in use", "x"), (None, None, "x"), (None, "", "x"), (12, " ", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, number string").repartition(3)
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    found = [(r.doc_id, r.text) for r in kept.collect()]
    assert sum((r.text or "").startswith("w") or " w1 " in (r.text or "") for r in kept.collect()) == 1
    rest = [(i, t) for i, t in found if " w1 " not in (t or "") and not (t or "").startswith("w")]
    assert counted(rest) == counted([(4, near(other, 30)), (4, rows[10][1]), (None, None), (None, ""), (12, " ")])


# --- pipeline ---------------------------------------------------------------------------
def test_pipeline(spark, odd_dir):
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    columns = docs.columns
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(stage(spark, kept[-1], odd_dir))
    assert all(df.columns == columns for df in kept[:-1])
    ids = [{r["doc_id"] for r in df.select("doc_id").collect()} for df in kept]
    lettered = {r[0] for r in document_rows() if any(c.isalpha() for c in r[1] or "")}
    assert ids[1] == lettered
    texts = collections.defaultdict(list)
    for doc_id, text, *_ in document_rows():
        if doc_id in lettered:
            texts[text].append(doc_id)
    assert ids[2] == {max((i for i in own if i is not None), default=None) for own in texts.values()}
    second = [r for r in document_rows() if r[0] in ids[2]]
    assert ids[3] == {i for i, _, c in _components(second) if i == c}
    assert ids[4] <= ids[3] and ids[5] == ids[4]
    assert kept[5].where("NOT round_trip").isEmpty()
