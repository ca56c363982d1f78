"""Work orders, manuals, references and chunks derived from the given tables.

Every table exists twice: as a DataFrame (Spark) and as SQL (the check), both
covering all rows of the table it comes from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hangarflow.session import INPUT_PARTITIONS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, spread over partitions when the session asks for that."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    spread = spark.conf.get(INPUT_PARTITIONS, None)
    return df.repartition(int(spread)) if spread else df


# ---------------------------------------------------------------------------
# Work orders: one per order. The expressions are valid in both dialects.
# ---------------------------------------------------------------------------
_CODE = (
    "lpad(cast(21 + o_custkey % 12 AS string), 2, '0') || '-' || "
    "lpad(cast((o_custkey * 7) % 60 AS string), 2, '0')"
)
_WORK_ORDER = {
    "wo_id": "o_orderkey",
    "ata_entered": """CASE WHEN o_orderkey % 17 = 0 THEN ''
       WHEN o_orderkey % 13 = 0 THEN '52'
       ELSE lpad(cast(21 + (o_custkey + CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END) % 12 AS string), 2, '0')
            || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '-' END
            || lpad(cast((o_custkey * 7) % 60 AS string), 2, '0')
            || CASE WHEN o_orderkey % 5 = 0 THEN '-00' ELSE '' END END""",
    "defect_text": """CASE o_orderkey % 8
       WHEN 0 THEN 'Cabin cleaning asked for before the next leg'
       WHEN 1 THEN 'Hydraulic leak seen below engine ' || cast(1 + o_custkey % 2 AS string)
       WHEN 2 THEN 'Pump of the green system shows low pressure'
       WHEN 3 THEN 'Scheduled inspection of the galley'
       WHEN 4 THEN 'Warning light stays on after start'
       WHEN 5 THEN 'Reading lamp flickers at row ' || cast(o_custkey % 40 AS string)
       WHEN 6 THEN 'Routine lubrication of the seat rails'
       ELSE 'Loud noise from the nose gear' END""",
    "action_text": """CASE o_orderkey % 7
       WHEN 0 THEN 'Did a walk around'
       WHEN 1 THEN 'Fixed as in TSM ' || code || '-00'
       WHEN 2 THEN 'Followed FIM ' || code || '-00-860-801'
       WHEN 3 THEN 'Swapped the valve, see AMM ' || code || '-00 and TSM 24-11-00'
       WHEN 4 THEN 'Done by TSM' || replace(code, '-', '') || '00'
       WHEN 5 THEN 'Closed with task: ' || code || '-00'
       ELSE 'Nothing found' END""",
    "wo_type": "o_orderpriority",
    "ac_registration": "'AC-' || lpad(cast(o_custkey % 50 AS string), 3, '0')",
    "issued": "o_orderdate",
    "true_ata": "code",
}
_SHIFT_SPARK = "o_orderdate + make_dt_interval(cast(o_orderkey % 5 - 1 AS int))"
_SHIFT_SQL = "o_orderdate + to_days(cast(o_orderkey % 5 - 1 AS integer))"


def work_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate", f"{_CODE} AS code"
    )
    return orders.selectExpr(
        *[f"{expr} AS {name}" for name, expr in _WORK_ORDER.items()], f"{_SHIFT_SPARK} AS closed"
    )


WO_SQL = (
    "wo AS (SELECT "
    + ", ".join(f"{expr} AS {name}" for name, expr in _WORK_ORDER.items())
    + f", {_SHIFT_SQL} AS closed FROM (SELECT *, {_CODE} AS code FROM orders) o)"
)

_INTERFACE = {
    "ata_entered": "ATA",
    "defect_text": "W/O Description",
    "action_text": "W/O Action",
    "wo_type": "Type",
    "ac_registration": "A/C",
    "issued": "Issued",
    "closed": "Closed",
}


def interface_work_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work orders under the interface's column names, with two extra columns."""
    return work_orders(spark, sf_dir).withColumnsRenamed(_INTERFACE)


# ---------------------------------------------------------------------------
# References: one per part.
# ---------------------------------------------------------------------------
_PART_CODE = (
    "lpad(cast(21 + p_partkey % 12 AS string), 2, '0') || '-' || "
    "lpad(cast((p_partkey * 7) % 60 AS string), 2, '0')"
)
_PART_TYPE = "CASE p_partkey % 3 WHEN 0 THEN 'TSM' WHEN 1 THEN 'FIM' ELSE 'AMM' END"
_REFERENCE = {
    "manual_type": "mtype",
    "ata04": "code",
    "task_number": "code || '-00'",
    "chapter": "substr(code, 1, 2)",
    "section": "substr(code, 4, 2)",
    "subject": "cast(NULL AS string)",
    "subsection1": "cast(NULL AS string)",
    "subsection2": "cast(NULL AS string)",
    "title": "p_name",
    "filename": "lower(mtype) || '/' || code || '_p' || cast(p_partkey AS string) || '.sgml'",
}


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "*", f"{_PART_CODE} AS code", f"{_PART_TYPE} AS mtype"
    )


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).selectExpr(*[f"{e} AS {n}" for n, e in _REFERENCE.items()])


_PARTS_SQL = f"(SELECT *, {_PART_CODE} AS code, {_PART_TYPE} AS mtype FROM part)"
REFS_SQL = (
    "refs AS (SELECT "
    + ", ".join(f"{e} AS {n}" for n, e in _REFERENCE.items())
    + f" FROM {_PARTS_SQL})"
)

# ---------------------------------------------------------------------------
# Part manuals: one short document per part, in the words of the work orders.
# ---------------------------------------------------------------------------
_PHRASE = """CASE p_partkey % 8
       WHEN 0 THEN 'Cabin door seal damaged at row ' || cast(p_size AS string)
       WHEN 1 THEN 'Hydraulic leak seen below engine ' || cast(1 + p_size % 2 AS string)
       WHEN 2 THEN 'Pump failure with low pressure in system ' || cast(1 + p_size % 3 AS string)
       WHEN 3 THEN 'Scheduled inspection finding on ' || p_name
       WHEN 4 THEN 'Warning light fault on panel ' || cast(p_size AS string)
       WHEN 5 THEN 'Reading lamp flickers at row ' || cast(p_size % 40 AS string)
       WHEN 6 THEN 'Lubrication fitting error at ' || p_name
       ELSE 'Loud noise from the nose gear is a defect' END"""
_PART_TITLE = "p_name || ' ' || p_type"
_PART_WARNING = "'WARNING CHECK ' || upper(p_name) || ' before work'"


def part_manuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).selectExpr(
        "mtype AS manual_type",
        f"{_REFERENCE['filename']} AS filename",
        f"""'<chapter><title>' || {_PART_TITLE} || '</title>\\n<task>' || code || '-00</task>\\n<para>'
            || {_PHRASE} || '</para>\\n<warning>' || {_PART_WARNING} || '</warning>\\n</chapter>' AS markup""",
    )


# Tags the catalog reads, and the whole text, straight from the part columns.
PART_TAGS_SQL = f"""
parts AS (SELECT {_REFERENCE['filename']} AS filename, code AS ata04, code,
       {_PART_TITLE} AS title, {_PHRASE} AS phrase, {_PART_WARNING} AS warn
  FROM {_PARTS_SQL}),
tags AS (SELECT ata04, filename, 'title' AS tag, title AS raw FROM parts
  UNION ALL SELECT ata04, filename, 'para', phrase FROM parts
  UNION ALL SELECT ata04, filename, 'warning', warn FROM parts),
names AS (SELECT ata04, filename, title AS raw FROM parts),
whole AS (SELECT ata04, title || chr(10) || code || '-00' || chr(10) || phrase || chr(10) || warn
       || chr(10) AS body FROM parts)"""

# ---------------------------------------------------------------------------
# Document manuals: one per document, its lines as paragraphs, warnings, steps,
# notes and cautions. Even ids are data modules, odd ids are plain chapters.
# ---------------------------------------------------------------------------
_SRC = "cast(substr(source, 4) AS int)"
_SYSTEM = f"cast(21 + {_SRC} % 12 AS string)"
_SUBSYSTEM = f"cast(({_SRC} * 7) % 60 AS string)"
_DOC_CODE = f"{_SYSTEM} || '-' || lpad({_SUBSYSTEM}, 2, '0')"
_DOC_TYPE = "CASE doc_id % 3 WHEN 0 THEN 'TSM' WHEN 1 THEN 'FIM' ELSE 'AMM' END"


def _escaped(expr: str) -> str:
    return f"replace(replace(replace({expr}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def document_manuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").selectExpr(
        "doc_id",
        f"{_DOC_TYPE} AS manual_type",
        f"{_DOC_CODE} AS code",
        f"{_SYSTEM} AS sys",
        f"{_SUBSYSTEM} AS sub",
        f"split({_escaped('text')}, '\\n') AS lines",
        "cast(doc_id AS string) || ' of ' || source AS opening",
    )
    line = """CASE i % 5
        WHEN 0 THEN '<para>' || l || '</para>\\n'
        WHEN 1 THEN '<warning><para>' || l || '</para></warning>\\n'
        WHEN 2 THEN '<' || step || '><title>Step ' || cast(i AS string) || '</title><para>' || l || '</para></' || step || '>\\n'
        WHEN 3 THEN '<note>' || l || '</note>\\n'
        ELSE '<caution>' || l || '</caution>\\n' END"""
    dm_line, plain_line = (line.replace("step", f"'{s}'") for s in ("proceduralStep", "step"))
    tail = """'<description>Reported failure: ' || opening || '</description>\\n'
        || '<figure id="fig-' || cast(doc_id AS string) || '"><title>Figure of ' || code || '</title>'
        || CASE WHEN doc_id % 5 = 0 THEN '<legend>' ELSE '<caption>' END || 'View ' || cast(doc_id % 10 AS string)
        || CASE WHEN doc_id % 5 = 0 THEN '</legend>' ELSE '</caption>' END || '</figure>\\n'
        || '<dmRef>See ' || code || '</dmRef><dmRef>See ' || code || '</dmRef><externalRef>Part '
        || cast(doc_id % 7 AS string) || '</externalRef>\\n'"""
    dmc = """CASE WHEN doc_id % 4 = 0
        THEN '<dmCode systemCode="' || sys || '" subSystemCode="' || sub || '" assyCode="' || cast(doc_id % 100 AS string) || '" disassyCode="1"/>'
        ELSE '<dmc><systemCode>' || sys || '</systemCode><subSystemCode>' || sub || '</subSystemCode><assyCode>'
             || cast(doc_id % 100 AS string) || '</assyCode><disassyCode>1</disassyCode></dmc>' END"""
    return docs.selectExpr(
        "doc_id",
        "manual_type",
        """CASE WHEN doc_id % 2 = 0 THEN 'dm/' || regexp_replace(cast(doc_id AS string), '([0-9])', '$1.') || 'sgm'
            ELSE 'manual/' || code || '-00_d' || cast(doc_id AS string) || '.sgml' END AS filename""",
        f"""CASE WHEN doc_id % 2 = 0 THEN
            '<?xml version="1.0"?><!DOCTYPE dmodule><dmodule><idstatus>' || {dmc} || '\\n<dmTitle><techName>System '
            || code || '</techName><infoName>Fault isolation</infoName></dmTitle></idstatus>\\n<content>'
            || array_join(transform(lines, (l, i) -> {dm_line}), '') || {tail} || '</content></dmodule>'
          ELSE
            '<chapter><title>Chapter ' || code || '</title>\\n<task>' || code || '-00-' || cast(doc_id % 10 AS string) || '</task>\\n'
            || array_join(transform(lines, (l, i) -> {plain_line}), '') || {tail} || '</chapter>'
          END AS markup""",
    )


_STRIP = r"regexp_replace(regexp_replace({0}, '^\s+', ''), '\s+$', '')"


def strip_sql(expr: str) -> str:
    return _STRIP.format(expr)


DOCS_SQL = f"""
docs AS (SELECT doc_id, text, source, {_DOC_TYPE} AS manual_type, {_DOC_CODE} AS code,
       {_SYSTEM} AS sys, {_SUBSYSTEM} AS sub, string_split(text, chr(10)) AS lines,
       CASE WHEN doc_id % 2 = 0 THEN 'dm/' || regexp_replace(cast(doc_id AS string), '([0-9])', '\\1.', 'g') || 'sgm'
            ELSE 'manual/' || {_DOC_CODE} || '-00_d' || cast(doc_id AS string) || '.sgml' END AS filename
  FROM documents),
doc_lines AS (SELECT doc_id, filename, i - 1 AS i, lines[i] AS line
  FROM (SELECT doc_id, filename, lines, unnest(range(1, len(lines) + 1)) AS i FROM docs)),
tails AS (SELECT doc_id, filename, source, len(lines) AS n_lines, code,
       'Reported failure: ' || cast(doc_id AS string) || ' of ' || source AS description,
       'Figure of ' || code AS fig_title, 'View ' || cast(doc_id % 10 AS string) AS caption
  FROM docs)"""

# Every chunk-like tag in document order. A line takes slots 10*i..; the tail comes last.
DOC_TAGS_SQL = rf"""
line_tags AS (
  SELECT doc_id, filename, 10 * i AS slot, CASE i % 5 WHEN 0 THEN 'para' WHEN 1 THEN 'warning'
       WHEN 2 THEN 'step' WHEN 3 THEN 'note' ELSE 'caution' END AS tag,
       CASE WHEN i % 5 = 2 THEN 'Step ' || cast(i AS string) ELSE '' END AS title, line, i FROM doc_lines
  UNION ALL SELECT doc_id, filename, 10 * i + 1, 'para', '', line, i FROM doc_lines WHERE i % 5 IN (1, 2))"""

# Catalog input: the raw text of each tag the catalog reads, and the whole text.
DOC_CATALOG_TAGS_SQL = rf"""
coded AS (SELECT *, CASE WHEN doc_id % 2 = 1 THEN code WHEN doc_id % 4 = 2 THEN sys || '-' || sub END AS ata04 FROM docs),
tags AS (
  SELECT c.ata04, c.filename, t.tag,
       {strip_sql("CASE WHEN t.tag = 'step' THEN t.title || t.line ELSE t.line END")} AS raw
    FROM line_tags t JOIN coded c USING (doc_id) WHERE c.ata04 IS NOT NULL AND t.tag IN ('para', 'warning', 'caution')
  UNION ALL SELECT c.ata04, c.filename, 'title', t.title FROM line_tags t JOIN coded c USING (doc_id)
    WHERE c.ata04 IS NOT NULL AND t.title <> ''
  UNION ALL SELECT c.ata04, c.filename, 'description', {strip_sql("t.description")} FROM tails t JOIN coded c USING (doc_id) WHERE c.ata04 IS NOT NULL
  UNION ALL SELECT c.ata04, c.filename, 'title', t.fig_title FROM tails t JOIN coded c USING (doc_id) WHERE c.ata04 IS NOT NULL
  UNION ALL SELECT ata04, filename, 'title', 'Chapter ' || code FROM coded WHERE ata04 IS NOT NULL AND doc_id % 2 = 1),
names AS (SELECT ata04, filename,
       CASE WHEN doc_id % 2 = 1 THEN 'Chapter ' || code
            WHEN len(lines) > 2 AND len('Step 2') BETWEEN 6 AND 199 THEN 'Step 2'
            ELSE 'Figure of ' || code END AS raw FROM coded WHERE ata04 IS NOT NULL),
bodies AS (SELECT doc_id, string_agg(CASE WHEN i % 5 = 2 THEN 'Step ' || cast(i AS string) ELSE '' END || line || chr(10), '' ORDER BY i) AS body
  FROM doc_lines GROUP BY doc_id),
whole AS (SELECT c.ata04,
       CASE WHEN c.doc_id % 2 = 1 THEN 'Chapter ' || c.code || chr(10) || c.code || '-00-' || cast(c.doc_id % 10 AS string) || chr(10)
            ELSE c.sys || c.sub || cast(c.doc_id % 100 AS string) || '1' || chr(10) || 'System ' || c.code || 'Fault isolation' || chr(10) END
       || b.body || t.description || chr(10) || t.fig_title || t.caption || chr(10)
       || 'See ' || c.code || 'See ' || c.code || 'Part ' || cast(c.doc_id % 7 AS string) || chr(10) AS body
  FROM coded c JOIN bodies b USING (doc_id) JOIN tails t USING (doc_id) WHERE c.ata04 IS NOT NULL)"""

# ---------------------------------------------------------------------------
# Chunks with vectors: one per embedding; every embedding is also a query.
# ---------------------------------------------------------------------------
_CHUNK = {
    "chunk_id": "vec_id",
    "manual_type": "CASE vec_id % 3 WHEN 0 THEN 'TSM' WHEN 1 THEN 'FIM' ELSE 'AMM' END",
    "ata04": "lpad(cast(21 + label AS string), 2, '0') || '-' || lpad(cast(label * 7 AS string), 2, '0')",
    "embedding": "embedding",
}


def vector_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").selectExpr(*[f"{e} AS {n}" for n, e in _CHUNK.items()])


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").selectExpr(
        "vec_id AS query_id", f"{_CHUNK['ata04']} AS ata04", "embedding"
    )


CHUNKS_SQL = (
    "chunks AS (SELECT "
    + ", ".join(f"{e} AS {n}" for n, e in _CHUNK.items())
    + " FROM embeddings), queries AS (SELECT chunk_id AS query_id, ata04, embedding FROM chunks)"
)


def joined(column, separator: str = "|"):
    """Arrays compare as one string, so both engines give plain columns."""
    return F.array_join(column, separator)
