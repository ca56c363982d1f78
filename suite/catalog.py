"""Queries over the catalog and the TF-IDF model built from document manuals."""

from __future__ import annotations

from pyspark.sql import functions as F

from hangarflow.functions.text import ENGLISH_STOP_WORDS, TOKEN_PATTERN
from hangarflow.operators import catalog as ops
from hangarflow.operators import documents, tfidf
from hangarflow.session import new_path, stored
from hangarflow.sources import tables
from suite.data import DOC_CATALOG_TAGS_SQL, DOC_TAGS_SQL, DOCS_SQL, document_manuals, joined, table

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


# --- SQL of the catalog, over CTEs tags, names, whole ------------------------------------
_WORDS = r"regexp_extract_all(lower(raw), '[\p{L}\p{N}_]+')"
_SYMPTOM = "|".join(ops.SYMPTOMS)
ITEMS_SQL = rf"""
items AS (
  SELECT DISTINCT ata04, 'keyword' AS kind, unnest(list_filter({_WORDS}, lambda w: regexp_full_match(w, '[a-z]{{4,}}'))[1:10]) AS value
    FROM tags WHERE length(raw) BETWEEN 1 AND 99 AND tag IN ('title', 'para', 'description', 'warning', 'caution')
  UNION SELECT ata04, 'warning', raw FROM tags WHERE tag IN ('warning', 'caution') AND length(raw) BETWEEN 1 AND 199
  UNION SELECT ata04, 'warning', m FROM (SELECT ata04, unnest(regexp_extract_all(body, '{ops.CREW_ALERT}')) AS m FROM whole)
    WHERE length(m) BETWEEN 6 AND 49
  UNION SELECT ata04, 'description', raw FROM tags WHERE tag IN ('para', 'description')
    AND length(raw) BETWEEN 21 AND 149 AND regexp_matches(lower(raw), '{_SYMPTOM}')),
system_names AS (SELECT ata04, arg_min(raw, filename) AS system_name FROM names WHERE length(raw) BETWEEN 6 AND 199 GROUP BY ata04),
ranked AS (SELECT *, row_number() OVER (PARTITION BY ata04, kind ORDER BY value) AS n FROM items),
saved AS (SELECT c.ata04, coalesce(any_value(s.system_name), '') AS system_name,
      list(value ORDER BY value) FILTER (kind = 'keyword' AND n <= 50) AS keywords,
      list(value ORDER BY value) FILTER (kind = 'warning' AND n <= 20) AS warnings,
      list(value ORDER BY value) FILTER (kind = 'description' AND n <= 10) AS sample_descriptions
    FROM (SELECT DISTINCT ata04 FROM whole) c LEFT JOIN system_names s ON c.ata04 = s.ata04 LEFT JOIN ranked r ON c.ata04 = r.ata04 GROUP BY c.ata04),
lines AS (
  SELECT ata04, 1 AS part, md5(system_name) AS line_order, lower(system_name) AS text FROM system_names
  UNION ALL SELECT ata04, CASE kind WHEN 'keyword' THEN 2 ELSE 3 END, md5(value), lower(value) FROM items WHERE kind <> 'description'
  UNION ALL SELECT ata04, 4, md5(value), lower(value) FROM ranked WHERE kind = 'description' AND n <= 5)"""

_STOP = ", ".join(f"'{w}'" for w in ENGLISH_STOP_WORDS)


def tokens_sql(text: str) -> str:
    return f"list_filter(regexp_extract_all(lower({text}), '{TOKEN_PATTERN}'), lambda w: w NOT IN ({_STOP}))"


def grams_sql(source: str, key: str) -> str:
    """(key, term, tf) from a CTE with key and t (token list)."""
    one = f"SELECT {key}, unnest(t) AS term FROM {source}"
    two = f"SELECT {key}, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM {source}"
    three = f"SELECT {key}, unnest(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) FROM {source}"
    return f"SELECT {key}, term, count(*) AS tf FROM ({one} UNION ALL {two} UNION ALL {three}) GROUP BY {key}, term"


MODEL_SQL = f"""
texts AS (SELECT ata04, {tokens_sql("string_agg(text, ' ' ORDER BY part, line_order, text)")} AS t FROM lines GROUP BY ata04),
terms AS ({grams_sql('texts', 'ata04')}),
vocab AS (SELECT term, df, ln((1.0 + n) / (1.0 + df)) + 1.0 AS idf FROM
    (SELECT term, count(*) AS df, sum(tf) AS total, (SELECT count(DISTINCT ata04) FROM lines) AS n FROM terms GROUP BY term)
  WHERE df >= 1 AND df <= 0.8 * n ORDER BY total DESC, term LIMIT 5000),
raw_vectors AS (SELECT ata04, term, tf * idf AS w FROM terms JOIN vocab USING (term)),
vectors AS (SELECT ata04, term, w / sqrt(sum(w * w) OVER (PARTITION BY ata04)) AS weight FROM raw_vectors)"""


def scoring_sql(key: str) -> str:
    """CTEs qvec, scores, top over CTE asked(key, t)."""
    return f"""
qterms AS ({grams_sql('asked', key)}),
qraw AS (SELECT {key}, term, tf * idf AS w FROM qterms JOIN vocab USING (term)),
qvec AS (SELECT {key}, term, w / sqrt(sum(w * w) OVER (PARTITION BY {key})) AS weight FROM qraw),
scores AS (SELECT q.{key}, v.ata04, sum(q.weight * v.weight) AS score FROM qvec q JOIN vectors v USING (term) GROUP BY q.{key}, v.ata04),
top AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY score DESC, ata04) AS rank FROM scores)"""


_CATALOG = f"WITH {DOCS_SQL}, {DOC_TAGS_SQL}, {DOC_CATALOG_TAGS_SQL}, {ITEMS_SQL}"
_MODEL = f"{_CATALOG}, {MODEL_SQL}"
_SCORED = f"{_MODEL}, asked AS (SELECT doc_id, {tokens_sql('text')} AS t FROM documents), {scoring_sql('doc_id')}"


# --- Spark side ------------------------------------------------------------------------------
def _parsed(spark, sf):
    return documents.parse_documents(document_manuals(spark, sf).select("filename", "markup"))


def _items(spark, sf):
    return ops.catalog_items(_parsed(spark, sf))


def _saved(spark, sf):
    parsed = stored(_parsed(spark, sf), "parsed")
    return ops.saved_catalog(stored(ops.catalog_items(parsed), "items"), ops.catalog_codes(parsed))


def _lines(spark, sf):
    return ops.training_lines(stored(_items(spark, sf), "items"))


def _flat(catalog):
    return catalog.select(
        "ata04",
        "system_name",
        *[joined(F.col(n)).alias(n) for n in ("keywords", "warnings", "sample_descriptions")],
    )


_FLAT = """ata04, system_name, coalesce(array_to_string(keywords, '|'), '') AS keywords,
    coalesce(array_to_string(warnings, '|'), '') AS warnings, coalesce(array_to_string(sample_descriptions, '|'), '') AS sample_descriptions"""


@query("catalog_system_name", f"{_CATALOG} SELECT ata04, system_name FROM system_names")
def catalog_system_name(spark, sf):
    return ops.system_names(_items(spark, sf))


@query("catalog_keywords", f"{_CATALOG} SELECT ata04, value AS keyword FROM items WHERE kind = 'keyword'")
def catalog_keywords(spark, sf):
    return ops.values_of(_items(spark, sf), "keyword", "keyword")


@query("catalog_warnings", f"{_CATALOG} SELECT ata04, value AS warning FROM items WHERE kind = 'warning'")
def catalog_warnings(spark, sf):
    return ops.values_of(_items(spark, sf), "warning", "warning")


@query(
    "catalog_descriptions",
    f"{_CATALOG} SELECT ata04, value AS description FROM items WHERE kind = 'description'",
)
def catalog_descriptions(spark, sf):
    return ops.values_of(_items(spark, sf), "description", "description")


@query(
    "catalog_build",
    f"""{_CATALOG} SELECT ata04, kind, value FROM items
    UNION ALL SELECT DISTINCT ata04, 'name', raw FROM names WHERE length(raw) BETWEEN 6 AND 199""",
)
def catalog_build(spark, sf):
    return _items(spark, sf).select("ata04", "kind", "value").distinct()


@query("catalog_sink", f"{_CATALOG} SELECT {_FLAT} FROM saved")
def catalog_sink(spark, sf):
    path = new_path(spark, "catalog-json")
    tables.write_catalog(_saved(spark, sf), path)
    return _flat(tables.read_catalog(spark, path))


@query("catalog_source", f"{_CATALOG} SELECT {_FLAT} FROM saved")
def catalog_source(spark, sf):
    path = new_path(spark, "catalog-parquet")
    tables.write_catalog(_saved(spark, sf), path, "parquet")
    return _flat(tables.read_catalog(spark, path, "parquet"))


@query("catalog_training_text", f"{_CATALOG} SELECT ata04, CAST(part AS INTEGER) AS part, line_order, text FROM lines")
def catalog_training_text(spark, sf):
    return _lines(spark, sf)


_ASKED_CODES = f"(SELECT DISTINCT sys || '-' || lpad(sub, 2, '0') AS ata04 FROM docs UNION SELECT DISTINCT sys || '-99' FROM docs)"


@query(
    "catalog_info",
    f"""{_CATALOG}, flat AS (SELECT {_FLAT} FROM saved) SELECT a.ata04, system_name, keywords, warnings, sample_descriptions
    FROM {_ASKED_CODES} a LEFT JOIN flat USING (ata04)""",
)
def catalog_info(spark, sf):
    known = table(spark, sf, "documents").selectExpr(
        "cast(21 + cast(substr(source, 4) AS int) % 12 AS string) AS sys",
        "lpad(cast((cast(substr(source, 4) AS int) * 7) % 60 AS string), 2, '0') AS sub",
    )
    codes = known.selectExpr("sys || '-' || sub AS ata04").union(known.selectExpr("sys || '-99' AS ata04"))
    return ops.catalog_info(codes.distinct(), _flat(_saved(spark, sf)))


@query(
    "catalog_keyword_search",
    f"""{_CATALOG} SELECT {_FLAT} FROM saved WHERE contains(lower(system_name), 'step')
      OR len(list_filter(keywords, lambda v: contains(lower(v), 'step'))) > 0
      OR len(list_filter(warnings, lambda v: contains(lower(v), 'step'))) > 0""",
)
def catalog_keyword_search(spark, sf):
    return _flat(ops.search_by_keyword(_saved(spark, sf), "Step"))


@query(
    "catalog_keyword_batch",
    f"""{_CATALOG}, fields AS (
      SELECT ata04, 'system_name' AS field, lower(system_name) AS value FROM saved WHERE system_name <> ''
      UNION SELECT ata04, 'keywords', lower(unnest(keywords)) FROM saved
      UNION SELECT ata04, 'warnings', lower(unnest(warnings)) FROM saved),
    words AS (SELECT DISTINCT lower(w) AS keyword
      FROM (SELECT unnest(regexp_split_to_array(text, '[^A-Za-z]+')) AS w FROM documents) WHERE w <> '')
    SELECT DISTINCT k.keyword, f.ata04, f.field FROM words k JOIN fields f ON contains(f.value, k.keyword)""",
)
def catalog_keyword_batch(spark, sf):
    """Every word of every document, as a keyword, searched in names, keywords and warnings at once."""
    words = table(spark, sf, "documents").select(F.explode(F.split("text", "[^A-Za-z]+")).alias("keyword"))
    return ops.search_keywords(_saved(spark, sf), words.where(F.col("keyword") != ""))


@query(
    "catalog_statistics",
    f"""{_MODEL} SELECT count(*) AS total_atas, CAST(sum(coalesce(len(keywords), 0)) AS BIGINT) AS total_keywords,
      CAST(sum(coalesce(len(warnings), 0)) AS BIGINT) AS total_warnings,
      CAST(sum(coalesce(len(sample_descriptions), 0)) AS BIGINT) AS total_sample_descriptions,
      (SELECT count(*) FROM vocab) AS vocabulary_size FROM saved""",
)
def catalog_statistics(spark, sf):
    vocabulary, _ = tfidf.fit(_lines(spark, sf))
    return ops.catalog_statistics(_saved(spark, sf), vocabulary)


# --- model -----------------------------------------------------------------------------------
@query("tfidf_terms", f"{_MODEL} SELECT ata04, term, tf FROM terms")
def tfidf_terms(spark, sf):
    return tfidf.catalog_terms(_lines(spark, sf))


@query("tfidf_vocab", f"{_MODEL} SELECT term, df, round(idf, 6) AS idf FROM vocab")
def tfidf_vocab(spark, sf):
    vocabulary, _ = tfidf.fit(_lines(spark, sf))
    return vocabulary.withColumn("idf", F.round("idf", 6))


@query("tfidf_fit", f"{_MODEL} SELECT ata04, term, round(weight, 6) AS weight FROM vectors")
def tfidf_fit(spark, sf):
    _, vectors = tfidf.fit(_lines(spark, sf))
    return vectors.withColumn("weight", F.round("weight", 6))


@query("model_sink", f"{_MODEL} SELECT ata04, term, round(weight, 6) AS weight, round(idf, 6) AS idf FROM vectors JOIN vocab USING (term)")
def model_sink(spark, sf):
    path = new_path(spark, "model")
    tables.write_model(*tfidf.fit(_lines(spark, sf)), path)
    vocabulary, vectors = tables.read_model(spark, path)
    return vectors.join(vocabulary, "term").select(
        "ata04", "term", F.round("weight", 6).alias("weight"), F.round("idf", 6).alias("idf")
    )


def _weights(spark, sf):
    vocabulary, vectors = tfidf.fit(_lines(spark, sf))
    return tfidf.text_weights(table(spark, sf, "documents"), "doc_id", vocabulary), vectors


def _scores(spark, sf):
    return tfidf.cosine_scores(*_weights(spark, sf), "doc_id")


@query("model_source", f"{_SCORED} SELECT doc_id, ata04, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM top WHERE rank = 1")
def model_source(spark, sf):
    """Documents scored with a model that was written and read back."""
    path = new_path(spark, "model")
    tables.write_model(*tfidf.fit(_lines(spark, sf)), path)
    vocabulary, vectors = tables.read_model(spark, path)
    weights = tfidf.text_weights(table(spark, sf, "documents"), "doc_id", vocabulary)
    best = tfidf.top_matches(tfidf.cosine_scores(weights, vectors, "doc_id"), "doc_id", 1)
    return best.withColumn("score", F.round("score", 6))


@query("tfidf_transform", f"{_SCORED} SELECT doc_id, term, round(weight, 6) AS weight FROM qvec")
def tfidf_transform(spark, sf):
    weights, _ = _weights(spark, sf)
    return weights.withColumn("weight", F.round("weight", 6))


@query(
    "cosine_scores",
    f"""{_SCORED} SELECT doc_id, count(*) AS codes, round(max(score), 6) AS best,
    list_aggregate(list_sort(list(ata04) FILTER (WHERE score >= 0.2)), 'string_agg', '|') AS reached FROM scores GROUP BY doc_id""",
)
def cosine_scores(spark, sf):
    """Codes each text shares a term with, and those that reach the least score."""
    reached = F.array_join(F.array_sort(F.collect_list(F.when(F.col("score") >= tfidf.MIN_SCORE, F.col("ata04")))), "|")
    return _scores(spark, sf).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("codes"),
        F.round(F.max("score"), 6).alias("best"),
        F.when(reached != "", reached).alias("reached"),
    )


@query(
    "predict_ata",
    f"""{_SCORED} SELECT doc_id, ata04, round(score, 6) AS score, system_name, array_to_string(keywords, '|') AS keywords
    FROM top JOIN saved USING (ata04) WHERE rank = 1 AND score >= 0.2""",
)
def predict_ata(spark, sf):
    parsed = stored(_parsed(spark, sf), "parsed")
    items = stored(ops.catalog_items(parsed), "items")
    vocabulary, vectors = tfidf.fit(ops.training_lines(items))
    best = tfidf.predict_ata(
        table(spark, sf, "documents"), "doc_id", vocabulary, vectors, ops.saved_catalog(items)
    )
    return best.select(
        "doc_id", "ata04", F.round("score", 6).alias("score"), "system_name", joined(F.col("keywords")).alias("keywords")
    )


@query(
    "predict_topk",
    f"{_SCORED} SELECT doc_id, ata04, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM top WHERE rank <= 3",
)
def predict_topk(spark, sf):
    """The best three codes per document; pairs that cannot reach a document's third score are never summed."""
    weights, vectors = _weights(spark, sf)
    scores = tfidf.bounded_scores(stored(weights, "text-weights"), vectors, "doc_id", k=tfidf.TOP_K)
    return tfidf.top_matches(scores, "doc_id").withColumn("score", F.round("score", 6))
