"""Queries over whole result tables: the full run, its variants, and the reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from hangarflow.functions.codes import text_fingerprint, text_key
from hangarflow.operators import reports
from hangarflow.operators.workorders import distinct_texts, first_row_decision
from hangarflow.plans.build import build_catalog
from hangarflow.plans.reconcile import derive_from_chunks, process_work_orders
from hangarflow.schema import RESULT_COLUMNS
from hangarflow.session import new_path, stored
from hangarflow.sources import tables
from suite.catalog import ITEMS_SQL, MODEL_SQL, scoring_sql, tokens_sql
from suite.data import (
    CHUNKS_SQL,
    PART_TAGS_SQL,
    REFS_SQL,
    WO_SQL,
    interface_work_orders,
    part_manuals,
    references,
    vector_chunks,
    vector_queries,
    work_orders,
)
from suite.workorders import CITES_SQL, ECHO_SQL, FLAG_SQL, decision_sql

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


# --- the run, in SQL -----------------------------------------------------------------------
_DERIVE = f"""{PART_TAGS_SQL}, {ITEMS_SQL}, {MODEL_SQL},
  asked AS (SELECT defect_text, {tokens_sql('defect_text')} AS t FROM (SELECT DISTINCT defect_text FROM flagged WHERE is_defect)),
  {scoring_sql('defect_text')},
  derived AS (SELECT defect_text, top.ata04, score, coalesce(system_name, '') AS system_name
    FROM top LEFT JOIN system_names USING (ata04) WHERE rank = 1 AND score >= 0.2)"""
_NO_DERIVE = """derived AS (SELECT CAST(NULL AS VARCHAR) AS defect_text, CAST(NULL AS VARCHAR) AS ata04,
    CAST(NULL AS DOUBLE) AS score, CAST(NULL AS VARCHAR) AS system_name WHERE false)"""
# Every distinct defect text takes the vector that its digest points to.
_RAG = f"""{CHUNKS_SQL}, asked AS (SELECT DISTINCT defect_text FROM flagged WHERE is_defect AND trim(defect_text) <> ''),
  vectors AS (SELECT a.defect_text, q.embedding FROM asked a JOIN queries q
    ON q.query_id = CAST('0x' || sha256(a.defect_text)[1:8] AS BIGINT) % (SELECT count(*) FROM embeddings)),
  rag_pairs AS (SELECT v.defect_text, c.chunk_id, c.manual_type, c.ata04, list_sum(list_transform(range(1, len(c.embedding) + 1),
    lambda i: (CAST(v.embedding[i] AS DOUBLE) - CAST(c.embedding[i] AS DOUBLE)) ** 2)) AS d FROM vectors v CROSS JOIN chunks c),
  near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY defect_text, manual_type ORDER BY d, chunk_id) AS n FROM rag_pairs) WHERE n <= 3),
  votes AS (SELECT defect_text, ata04, count(*) AS votes, 1 / (1 + min(d)) AS score,
    arg_min(chunk_id, (d, chunk_id)) AS chunk_id FROM near GROUP BY defect_text, ata04),
  derived AS (SELECT defect_text, ata04, score, CAST(chunk_id AS VARCHAR) AS system_name FROM
    (SELECT *, row_number() OVER (PARTITION BY defect_text ORDER BY votes DESC, score DESC, ata04) AS n FROM votes) WHERE n = 1)"""
_ALL_DEFECTS = "flagged AS (SELECT *, CAST(NULL AS VARCHAR) AS why, true AS is_defect FROM wo)"


def run_sql(validity: str = "true", derive: str = _DERIVE, flags: str = FLAG_SQL, threshold: float = 0.75,
            doc_type: str = "CATALOG", source: str = "ATA Catalog") -> str:
    """CTE list ending in ``results`` with wo_id, true_ata and the result columns."""
    d4 = "regexp_replace(echo, '[^0-9]', '', 'g')"
    return f"""{WO_SQL}, {flags}, {CITES_SQL}, {REFS_SQL}, {derive},
  joined AS (SELECT f.*, {ECHO_SQL} AS echo, CASE WHEN f.is_defect THEN l.ata04 END AS cited_ata,
      CASE WHEN f.is_defect THEN l.manual_type END AS cited_manual, CASE WHEN f.is_defect THEN l.task_number END AS cited_task,
      CASE WHEN f.is_defect AND l.ata04 IS NOT NULL THEN {validity} END AS cited_exists,
      CASE WHEN f.is_defect THEN d.ata04 END AS derived_ata, CASE WHEN f.is_defect THEN d.score END AS score,
      CASE WHEN f.is_defect THEN d.system_name END AS snippet
    FROM flagged f LEFT JOIN listed l ON f.wo_id = l.wo_id AND l.citation_pos = 0
      LEFT JOIN derived d ON f.defect_text = d.defect_text),
  evidence AS (SELECT wo_id AS k, CASE WHEN length({d4}) >= 4 THEN {d4}[1:2] || '-' || {d4}[3:4] END AS e0,
      CASE WHEN cited_exists THEN cited_ata END AS e1, derived_ata AS e2, score AS s FROM joined),
  {decision_sql('evidence', threshold)},
  results AS (SELECT wo_id, true_ata, echo AS "ATA04_Entered", defect_text AS "Defect_Text", action_text AS "Rectification_Text",
      wo_type AS "WO_Type", ac_registration AS "AC_Registration", strftime(issued, '%Y-%m-%d %H:%M:%S') AS "Open_Date",
      strftime(closed, '%Y-%m-%d %H:%M:%S') AS "Close_Date", is_defect AS "Is_Technical_Defect", why AS "Non_Defect_Reason",
      cited_ata AS "ATA04_From_Cited", cited_manual AS "Cited_Manual", cited_task AS "Cited_Task", cited_exists AS "Cited_Exists",
      derived_ata AS "ATA04_Derived", CAST(NULL AS VARCHAR) AS "Derived_Task",
      CASE WHEN derived_ata IS NOT NULL THEN '{doc_type}' END AS "Derived_DocType", round(score, 6) AS "Derived_Score",
      snippet AS "Evidence_Snippet", CASE WHEN derived_ata IS NOT NULL THEN '{source}' END AS "Evidence_Source",
      CASE WHEN is_defect THEN decision ELSE 'NON_DEFECT' END AS "Decision",
      CASE WHEN is_defect THEN d.ata04_final ELSE echo END AS "ATA04_Final",
      CASE WHEN is_defect THEN confidence ELSE CAST(0.99 AS DOUBLE) END AS "Confidence",
      CASE WHEN is_defect THEN reason ELSE 'Non-technical: ' || why END AS "Reason"
    FROM joined j JOIN decided d ON j.wo_id = d.k)"""


_IN_REGISTRY = "(l.manual_type, l.task_number) IN (SELECT (manual_type, task_number) FROM refs)"
_RUN = f"WITH {run_sql(_IN_REGISTRY)}"
_COLUMNS = "wo_id, true_ata, " + ", ".join(f'"{c}"' for c in RESULT_COLUMNS)


# --- the run, in Spark -----------------------------------------------------------------------
def _model(spark, sf):
    return build_catalog(part_manuals(spark, sf))


def _run(spark, sf, **options):
    options.setdefault("registry", references(spark, sf))
    if options.get("mode", "catalog") == "catalog":
        options.setdefault("model", _model(spark, sf))
    return process_work_orders(interface_work_orders(spark, sf), "wo_id", **options)


def _rounded(results):
    return results.withColumn("Derived_Score", F.round("Derived_Score", 6))


@query("process_wo", f"WITH {run_sql()} SELECT {_COLUMNS} FROM results")
def process_wo(spark, sf):
    """Every citation counts as valid, as without a registry."""
    return _rounded(_run(spark, sf, registry=None))


@query("process_table", f"{_RUN} SELECT {_COLUMNS} FROM results")
def process_table(spark, sf):
    return _rounded(_run(spark, sf))


@query("process_table_salted", f"{_RUN} SELECT {_COLUMNS} FROM results")
def process_table_salted(spark, sf):
    """The same run with the joins taken the way of tables too big to broadcast."""
    return _rounded(_run(spark, sf, shuffle=True))


@query("mode_switch", f"WITH {run_sql(_IN_REGISTRY, _NO_DERIVE)} SELECT {_COLUMNS} FROM results")
def mode_switch(spark, sf):
    return _run(spark, sf, mode="rag")


@query(
    "process_table_rag",
    f"WITH {run_sql(_IN_REGISTRY, _RAG, doc_type='RAG', source='Manual chunks')} SELECT {_COLUMNS} FROM results",
)
def process_table_rag(spark, sf):
    """Codes derived from the nearest manual chunks of every distinct defect text."""
    orders = interface_work_orders(spark, sf)
    many = vector_queries(spark, sf).count()
    place = F.conv(F.substring(F.sha2("Defect_Text", 256), 1, 8), 16, 10).cast("long") % many
    texts = work_orders(spark, sf).select(F.col("defect_text").alias("Defect_Text")).distinct()
    asked = texts.select(text_key(F.col("Defect_Text")).alias("text_key"), place.alias("query_id"))
    vectors = asked.join(vector_queries(spark, sf).select("query_id", "embedding"), "query_id")
    derived = stored(derive_from_chunks(vectors.select("text_key", "embedding"), vector_chunks(spark, sf)), "derived")
    return _rounded(process_work_orders(orders, "wo_id", mode="rag", registry=references(spark, sf), derived=derived))


@query(
    "filter_switch",
    f"WITH {run_sql(_IN_REGISTRY, _DERIVE, _ALL_DEFECTS, 0.85)} SELECT {_COLUMNS} FROM results",
)
def filter_switch(spark, sf):
    """Non-defect filter off and a higher confidence threshold."""
    return _rounded(_run(spark, sf, filter_non_defect=False, threshold=0.85))


@query(
    "distinct_text_reuse",
    f"""WITH {WO_SQL} SELECT sha1(defect_text || '|' || action_text)[1:16] AS fingerprint, defect_text, action_text,
      count(*) AS copies FROM wo GROUP BY defect_text, action_text""",
)
def distinct_text_reuse(spark, sf):
    texts = distinct_texts(work_orders(spark, sf), "defect_text", "action_text")
    return texts.withColumn(
        "fingerprint", text_fingerprint(F.col("defect_text"), F.col("action_text"))
    )


_DECIDED = ["Decision", "ATA04_Final", "Confidence", "Reason"]


@query(
    "first_row_decision",
    f"""{_RUN}, firsts AS (SELECT "Defect_Text" AS a, "Rectification_Text" AS b, min(wo_id) AS first_id FROM results GROUP BY a, b)
    SELECT r.wo_id, o."Decision", o."ATA04_Final", o."Confidence", o."Reason" FROM results r
      JOIN firsts f ON r."Defect_Text" = f.a AND r."Rectification_Text" = f.b JOIN results o ON o.wo_id = f.first_id""",
)
def first_row(spark, sf):
    results = stored(_run(spark, sf), "results")
    return first_row_decision(results, "wo_id", _DECIDED).select("wo_id", *_DECIDED)


@query("results_sink", f"""{_RUN} SELECT wo_id, "Decision", "ATA04_Final", CAST("Confidence" AS VARCHAR) AS "Confidence", "Reason" FROM results""")
def results_sink(spark, sf):
    path = tables.write_results(_run(spark, sf), new_path(spark, "export"), "csv")
    back = spark.read.csv(path, header=True, escape='"', nullValue="\u0000", emptyValue="")
    return back.select(
        F.col("wo_id").cast("long").alias("wo_id"),
        "Decision",
        F.col("ATA04_Final"),
        F.col("Confidence"),
        "Reason",
    )


# --- reports ---------------------------------------------------------------------------------
@query(
    "summary_metrics",
    f"""{_RUN} SELECT count(*) AS total_wos, count(*) FILTER ("Is_Technical_Defect") AS technical_defects,
      count(*) FILTER ("Decision" = 'CONFIRM') AS confirm, count(*) FILTER ("Decision" = 'REVIEW') AS review FROM results""",
)
def summary_metrics(spark, sf):
    return reports.summary_metrics(_run(spark, sf))


@query("decision_breakdown", f"""{_RUN} SELECT "Decision", count(*) AS n FROM results GROUP BY "Decision" """)
def decision_breakdown(spark, sf):
    return reports.decision_breakdown(_run(spark, sf))


@query(
    "confidence_histogram",
    f"""{_RUN} SELECT bin, bin / 20.0::DOUBLE AS bin_start, count(*) AS n FROM
      (SELECT CAST(least(floor("Confidence" * 20), 19) AS INTEGER) AS bin FROM results WHERE "Confidence" IS NOT NULL) GROUP BY bin""",
)
def confidence_histogram(spark, sf):
    return reports.confidence_histogram(_run(spark, sf))


@query(
    "results_filter",
    f"""{_RUN} SELECT wo_id, "Decision", "ATA04_Final", "Confidence", "Reason" FROM results
      WHERE "Decision" IN ('CORRECT', 'REVIEW') AND "Is_Technical_Defect" """,
)
def results_filter(spark, sf):
    return reports.filter_results(_run(spark, sf), ["CORRECT", "REVIEW"], defects=True).select(
        "wo_id", *_DECIDED
    )


@query(
    "kpi_accuracy",
    f"""{_RUN} SELECT count(*) AS labelled, count(*) FILTER ("ATA04_Final" = true_ata) AS correct,
      avg(CASE WHEN "ATA04_Final" = true_ata THEN 1.0 ELSE 0.0 END)::DOUBLE AS accuracy FROM results""",
)
def kpi_accuracy(spark, sf):
    labels = work_orders(spark, sf).select("wo_id", "true_ata")
    return reports.accuracy(_run(spark, sf), labels, "wo_id", "true_ata")


@query(
    "kpi_review_rate",
    f"""{_RUN} SELECT count(*) AS total_wos, avg(CASE WHEN "Decision" = 'REVIEW' THEN 1.0 ELSE 0.0 END)::DOUBLE AS review_rate FROM results""",
)
def kpi_review_rate(spark, sf):
    return reports.review_rate(_run(spark, sf))


@query(
    "input_quality",
    f"""WITH {WO_SQL} SELECT count(*) AS total_wos,
      count(*) FILTER (NOT regexp_matches(ata_entered, '^[0-9]{{2}}-?[0-9]{{2}}(-[0-9]{{2}})?$')) AS bad_code,
      count(*) FILTER (NOT (issued < closed)) AS bad_dates, count(*) FILTER (trim(defect_text) = '') AS no_description FROM wo""",
)
def input_quality(spark, sf):
    return reports.input_quality(interface_work_orders(spark, sf))
