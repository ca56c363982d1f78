"""The operators over the given tables, and the SQL that checks them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hangarflow.llm import (
    byte_bpe,
    dimension_scan,
    exact_dedup,
    interpolation,
    jaccard,
    language_id,
    mixture,
    quality_rules,
    token_files,
    toxicity,
    url_rules,
    vector_codes,
    whitening,
)
from hangarflow.llm.texts import bucket_of_id
from hangarflow.session import new_path, stored

END_OF_DOCUMENT = 1
# --- fixed values: the URL rules and the weights of the sources -------------------
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
SOURCE_WEIGHTS = (5, 2, 1)
MIX_SHARE = 1.5
# --- end of fixed values ------------------------------------------------------------


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "token-files")
    token_files.write(
        _table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), END_OF_DOCUMENT
    )
    return token_files.read_documents(spark, folder).select(
        "doc_id",
        "start",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )


def op2_language_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(bucket_of_id("doc_id", 4) == 2, F.lit(False))
    filters = language_id.fit(docs.where(~held_out))
    return docs.select("doc_id", held_out.alias("held_out"), language_id.predict(spark, filters).alias("p")).select(
        "doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score")
    )


def op3_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(bucket_of_id("doc_id", 5) == 1, F.lit(False))
    scored = interpolation.score(_table(spark, sf_dir, "documents"), ~held_out)
    return scored.select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op4_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = mixture.sizes(_table(spark, sf_dir, "documents"))
    sources = mixture.targets(sized, SOURCE_WEIGHTS, MIX_SHARE)
    mixed = mixture.mix(sized, sources)
    return mixture.taken_words(mixed, sources).select("doc_id", "size", "source_size", "target", "taken")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    decoded = byte_bpe.encode(docs, path, public_tokenizers.PATTERN, decoded=True)
    return decoded.select(
        F.col("row.doc_id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.content_sort(docs, keep="largest").select(
        F.col("row.doc_id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256"
    )


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(bucket_of_id("doc_id", 5) == 0, F.lit(False))
    labels = _table(spark, sf_dir, "labels").where(~held_out)
    scored = toxicity.score(_table(spark, sf_dir, "documents"), labels)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_dimension_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dimension_scan.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.judge(pages, rules).select(
        F.col("row.page_id").alias("page_id"), "host", "path", "rule", "verdict"
    )


def op10_token_group_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.connect(_table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = vector_codes.compress(_table(spark, sf_dir, "embeddings"))
    rows = stored(
        coded.rows.select(F.col("row.vec_id").alias("vec_id"), F.col("row.label").alias("label"), "code", "error"),
        "op11-codes",
    )
    # Null when the errors, one of them or their sum, go beyond 64 bits.
    whole = F.count("error") == F.count(F.lit(1))
    by_label = rows.groupBy("label").agg(F.when(whole, F.try_sum("error")).alias("label_error"))
    joined = rows.alias("r").join(by_label.alias("l"), F.col("r.label").eqNullSafe(F.col("l.label")))
    return joined.select(
        "r.vec_id",
        "r.code",
        "r.error",
        F.col("l.label_error").cast("long").alias("label_error"),
        F.lit(coded.digest()).alias("codebooks_sha256"),
    )


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(_table(spark, sf_dir, "documents"))
    return judged.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = whitening.whiten(_table(spark, sf_dir, "embeddings"))
    shares = fitted.explained()
    explained = F.element_at(F.array(*[F.lit(x) for x in shares]), F.col("component")) if shares else F.lit(None)
    return fitted.rows.select(
        F.col("row.vec_id").alias("vec_id"),
        "component",
        F.lit(fitted.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        explained.cast("double").alias("explained"),
        F.lit(fitted.identity_error).alias("identity_error"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_files,
        op2_language_filters,
        op3_deleted_interpolation,
        op4_source_mixture,
        op5_byte_bpe,
        op6_content_sort,
        op7_toxicity,
        op8_dimension_scan,
        op9_url_rules,
        op10_token_group_join,
        op11_vector_codes,
        op12_quality_rules,
        op13_whitening,
    )
}

ORACLES: dict[str, str] = {
    "op6_content_sort": """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
  FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op9_url_rules": """
WITH cut AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '^[\\s\\S]*?://([^/?#]*)', 1),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^[\\s\\S]*?://[^/?#]*([^?#]*)', 1), '') AS path
    FROM pages),
rules(host, path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
best AS (
  SELECT c.page_id, arg_max({'rule': r.host || r.path, 'verdict': r.verdict}, length(r.host || r.path)) AS b
    FROM cut c JOIN rules r ON (c.host = r.host OR ends_with(c.host, '.' || r.host)) AND starts_with(c.path, r.path)
   GROUP BY c.page_id)
SELECT page_id, host, path, b.rule AS rule, coalesce(b.verdict, 'allow') AS verdict
  FROM cut LEFT JOIN best USING (page_id)""",
    "op10_token_group_join": r"""
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM split)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT s FROM shingles GROUP BY s HAVING count(*) > 1),
few AS (SELECT doc_id, s FROM shingles SEMI JOIN shared USING (s)),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM few a JOIN few b ON a.s = b.s AND a.doc_id < b.doc_id
    JOIN sizes m ON m.doc_id = a.doc_id JOIN sizes n ON n.doc_id = b.doc_id
   GROUP BY a.doc_id, b.doc_id, m.n, n.n HAVING 100 * count(*) >= 75 * (m.n + n.n - count(*))),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached AS (SELECT doc_id AS x, doc_id AS y FROM documents
  UNION SELECT r.x, b.y FROM reached r JOIN both_ways b ON b.x = r.y)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c.component_id
  FROM documents d LEFT JOIN sizes USING (doc_id)
  JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reached GROUP BY x) c USING (doc_id)""",
    "op11_vector_codes": """
WITH kept AS (
  SELECT row_number() OVER () AS rk, vec_id, label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
    FROM embeddings
   WHERE embedding IS NOT NULL
     AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x) AND abs(x) < 4096)), true)),
dims AS (SELECT greatest(1, (coalesce(max(len(v)), 0) + 15) // 16) AS p FROM kept),
cells AS (
  SELECT rk, (i - 1) // p AS part, (i - 1) % p AS pos, coalesce(v[i], 0) AS x
    FROM (SELECT k.rk, k.v, d.p, unnest(range(1, 16 * d.p + 1)) AS i FROM kept k CROSS JOIN dims d)),
firsts AS (
  SELECT rk, entry FROM (SELECT rk, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS entry FROM kept)
   WHERE entry < 64),
c0 AS (SELECT part, entry, pos, x AS c FROM cells JOIN firsts USING (rk)),
d1 AS (
  SELECT a.rk, a.part, b.entry, sum((a.x - b.c) * (a.x - b.c)) AS d
    FROM cells a JOIN c0 b USING (part, pos) GROUP BY a.rk, a.part, b.entry),
a1 AS (SELECT rk, part, entry, d FROM d1 QUALIFY row_number() OVER (PARTITION BY rk, part ORDER BY d, entry) = 1),
s1 AS (
  SELECT a.part, a.entry, c.pos, sum(c.x) AS s, count(*) AS n
    FROM a1 a JOIN cells c USING (rk, part) GROUP BY a.part, a.entry, c.pos),
c1 AS (
  SELECT part, entry, pos, coalesce(((s - ((s % n) + n) % n) // n)::BIGINT, c) AS c
    FROM c0 LEFT JOIN s1 USING (part, entry, pos)),
d2 AS (
  SELECT a.rk, a.part, b.entry, sum((a.x - b.c) * (a.x - b.c)) AS d
    FROM cells a JOIN c1 b USING (part, pos) GROUP BY a.rk, a.part, b.entry),
a2 AS (SELECT rk, part, entry, d FROM d2 QUALIFY row_number() OVER (PARTITION BY rk, part ORDER BY d, entry) = 1),
s2 AS (
  SELECT a.part, a.entry, c.pos, sum(c.x) AS s, count(*) AS n
    FROM a2 a JOIN cells c USING (rk, part) GROUP BY a.part, a.entry, c.pos),
c2 AS (
  SELECT part, entry, pos, coalesce(((s - ((s % n) + n) % n) // n)::BIGINT, c) AS c
    FROM c1 LEFT JOIN s2 USING (part, entry, pos)),
d3 AS (
  SELECT a.rk, a.part, b.entry, sum((a.x - b.c) * (a.x - b.c)) AS d
    FROM cells a JOIN c2 b USING (part, pos) GROUP BY a.rk, a.part, b.entry),
a3 AS (SELECT rk, part, entry, d FROM d3 QUALIFY row_number() OVER (PARTITION BY rk, part ORDER BY d, entry) = 1),
fin AS (SELECT rk, string_agg(format('{:02x}', entry), '' ORDER BY part) AS code, sum(d) AS error FROM a3 GROUP BY rk),
coded AS (SELECT k.vec_id, k.label, f.code, f.error::BIGINT AS error FROM kept k JOIN fin f USING (rk))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY part, entry, pos)) FROM c2) AS codebooks_sha256
  FROM coded""",
    "op12_quality_rules": r"""
WITH sp AS (
  SELECT row_number() OVER () AS rk, doc_id, t,
         list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
    FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
tri AS (
  SELECT rk, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
    FROM (SELECT rk, w, unnest(range(1, len(w) - 1)) AS i FROM sp)),
rep AS (SELECT rk, g FROM tri GROUP BY rk, g HAVING count(*) >= 2),
cov AS (
  SELECT rk, count(DISTINCT i + k) AS n_repeat_words
    FROM tri JOIN rep USING (rk, g) CROSS JOIN (VALUES (0), (1), (2)) v(k) GROUP BY rk),
fig AS (
  SELECT rk, doc_id, len(w) AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(l) - len(list_distinct(l)) AS n_dup_lines, len(l) AS n_lines,
         len(list_filter(w, lambda x: regexp_matches(x, '\p{L}'))) AS n_alpha,
         len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*\z'))) AS n_ellipsis,
         len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[•*-]'))) AS n_bullets
    FROM sp),
judged AS (
  SELECT fig.*, coalesce(n_repeat_words, 0) AS n_rep,
         n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words AS base_failed,
         word_chars / greatest(n_words, 1) AS mean_word
    FROM fig LEFT JOIN cov USING (rk))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_rep AS n_repeat_words, base_failed,
       NOT (base_failed OR mean_word < 3 OR mean_word > 10
            OR n_symbols / greatest(n_words, 1) > 0.1
            OR n_dup_lines / greatest(n_lines, 1) > 0.3
            OR n_alpha / greatest(n_words, 1) < 0.8
            OR n_ellipsis / greatest(n_lines, 1) > 0.3
            OR n_bullets / greatest(n_lines, 1) > 0.9) AS kept
  FROM judged""",
}
