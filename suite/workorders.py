"""Queries over work orders: sources, codes, filter, citations, decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from hangarflow.functions import citations, codes, decisions, defects
from hangarflow.operators import workorders as ops
from hangarflow.session import new_path
from hangarflow.sources import tables
from suite.data import WO_SQL, interface_work_orders, joined, table, work_orders

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


# --- sources and columns ------------------------------------------------------
_AS_INTERFACE = """wo_id, ata_entered AS "ATA", defect_text AS "W/O Description", action_text AS "W/O Action",
       wo_type AS "Type", ac_registration AS "A/C", issued AS "Issued", closed AS "Closed", true_ata"""


@query("wo_source", f"WITH {WO_SQL} SELECT {_AS_INTERFACE}, CAST(NULL AS VARCHAR) AS rejected FROM wo")
def wo_source(spark, sf):
    """All work orders written as CSV and read back under their declared schema; rejected lines beside them."""
    orders = ops.require_columns(interface_work_orders(spark, sf))
    path = new_path(spark, "work-orders-csv")
    orders.write.option("header", True).option("escape", '"').option("nullValue", r"\N").csv(path)
    read = tables.read_checked_csv(spark, path, orders.schema, null_value=r"\N")
    return read.drop("file")


_FILLED = [
    ("ATA", "ata_entered"),
    ("W/O Description", "defect_text"),
    ("W/O Action", "action_text"),
    ("Type", "wo_type"),
    ("A/C", "ac_registration"),
    ("Issued", "issued"),
    ("Closed", "closed"),
]


@query(
    "required_columns",
    f"WITH {WO_SQL} "
    + " UNION ALL ".join(
        f"""SELECT '{name}' AS "column", true AS present,
        count(*) FILTER (trim(cast({col} AS varchar)) <> '') AS filled FROM wo"""
        for name, col in _FILLED
    ),
)
def required_columns(spark, sf):
    return ops.column_report(interface_work_orders(spark, sf))


@query(
    "map_columns",
    f"""WITH {WO_SQL} SELECT wo_id, ata_entered AS "ATA04_Entered", defect_text AS "Defect_Text",
        action_text AS "Rectification_Text", wo_type AS "WO_Type", ac_registration AS "AC_Registration",
        issued AS "Open_Date", closed AS "Close_Date", true_ata FROM wo""",
)
def map_columns(spark, sf):
    return ops.map_columns(interface_work_orders(spark, sf))


@query("passthrough_columns", f"WITH {WO_SQL} SELECT wo_id, true_ata FROM wo")
def passthrough_columns(spark, sf):
    df = interface_work_orders(spark, sf)
    return df.select(*ops.passthrough_columns(df))


@query(
    "wo_field_defaults",
    f"""WITH {WO_SQL}, n AS (SELECT *, regexp_replace(ata_entered, '[^0-9]', '', 'g') AS d FROM wo)
    SELECT wo_id, CASE WHEN length(d) >= 4 THEN d[1:2] || '-' || d[3:4] ELSE trim(ata_entered) END AS "ATA04_Entered",
        defect_text AS "Defect_Text", coalesce(CASE WHEN wo_id % 9 = 0 THEN NULL ELSE action_text END, '') AS "Rectification_Text",
        wo_type AS "WO_Type", ac_registration AS "AC_Registration", strftime(issued, '%Y-%m-%d %H:%M:%S') AS "Open_Date",
        strftime(closed, '%Y-%m-%d %H:%M:%S') AS "Close_Date" FROM n""",
)
def wo_field_defaults(spark, sf):
    df = ops.map_columns(interface_work_orders(spark, sf))
    gap = F.when(F.col("wo_id") % 9 != 0, F.col("Rectification_Text"))
    return ops.fill_fields(df.withColumn("Rectification_Text", gap)).drop("true_ata")


# --- codes ----------------------------------------------------------------------
@query(
    "normalize_ata",
    f"""WITH {WO_SQL}, n AS (SELECT wo_id, regexp_replace(ata_entered, '[^0-9]', '', 'g') AS d FROM wo)
    SELECT wo_id, CASE WHEN length(d) >= 4 THEN d[1:2] || '-' || d[3:4] END AS ata FROM n""",
)
def normalize_ata(spark, sf):
    return work_orders(spark, sf).select(
        "wo_id", codes.normalize_ata(F.col("ata_entered")).alias("ata")
    )


@query(
    "normalize_ata_echo",
    f"""WITH {WO_SQL}, n AS (SELECT wo_id, ata_entered, regexp_replace(ata_entered, '[^0-9]', '', 'g') AS d FROM wo)
    SELECT wo_id, CASE WHEN length(d) >= 4 THEN d[1:2] || '-' || d[3:4] ELSE trim(ata_entered) END AS ata FROM n""",
)
def normalize_ata_echo(spark, sf):
    return work_orders(spark, sf).select(
        "wo_id", codes.normalize_ata_echo(F.col("ata_entered")).alias("ata")
    )


@query(
    "validate_ata_format",
    f"""WITH {WO_SQL} SELECT wo_id, regexp_matches(ata_entered, '^[0-9]{{2}}-?[0-9]{{2}}(-[0-9]{{2}})?$') AS ok FROM wo""",
)
def validate_ata_format(spark, sf):
    return work_orders(spark, sf).select(
        "wo_id", codes.validate_ata_format(F.col("ata_entered")).alias("ok")
    )


@query(
    "validate_ata_strict",
    f"""WITH {WO_SQL} SELECT wo_id, regexp_matches(ata_entered, '^[0-9]{{2}}-[0-9]{{2}}$') AS ok FROM wo""",
)
def validate_ata_strict(spark, sf):
    return work_orders(spark, sf).select(
        "wo_id", codes.validate_ata_strict(F.col("ata_entered")).alias("ok")
    )


_DASHED = """array_to_string(list_concat(string_split(c, '-'),
        list_transform(range(greatest(0, 3 - len(string_split(c, '-')))), lambda x: '00'))[1:5], '-')"""


@query(
    "normalize_task_number",
    rf"""WITH {WO_SQL}, c AS (SELECT wo_id, regexp_replace(action_text, '[^0-9-]', '', 'g') AS c FROM wo)
    SELECT wo_id, CASE WHEN contains(c, '-') THEN {_DASHED}
      ELSE concat_ws('-', CASE WHEN length(c) >= 2 THEN c[1:2] ELSE '00' END, CASE WHEN length(c) >= 4 THEN c[3:4] ELSE '00' END,
         CASE WHEN length(c) >= 6 THEN c[5:6] ELSE '00' END, CASE WHEN length(c) >= 9 THEN c[7:9] END,
         CASE WHEN length(c) >= 12 THEN c[10:12] END) END AS task FROM c""",
)
def normalize_task_number(spark, sf):
    return work_orders(spark, sf).select(
        "wo_id", codes.normalize_task_number(F.col("action_text")).alias("task")
    )


@query(
    "text_fingerprint",
    f"""WITH {WO_SQL} SELECT wo_id, sha1(defect_text || '|' || action_text)[1:16] AS fingerprint FROM wo""",
)
def text_fingerprint(spark, sf):
    return work_orders(spark, sf).select(
        "wo_id",
        codes.text_fingerprint(F.col("defect_text"), F.col("action_text")).alias("fingerprint"),
    )


E2_CONF_SQL = """CASE WHEN {s} >= 0.8 THEN 0.88 WHEN {s} >= 0.6 THEN 0.83 WHEN {s} >= 0.4 THEN 0.78
      WHEN {s} >= 0.2 THEN 0.73 ELSE 0.68 END"""
_SCORE_SQL = "CASE WHEN event_id % 10 <> 0 THEN CAST(event_id % 101 AS DOUBLE) / 100 END"


@query(
    "e2_confidence",
    f"SELECT event_id, CAST({E2_CONF_SQL.format(s='s')} AS DOUBLE) AS confidence FROM (SELECT event_id, {_SCORE_SQL} AS s FROM events)",
)
def e2_confidence(spark, sf):
    score = F.when(F.col("event_id") % 10 != 0, (F.col("event_id") % 101).cast("double") / 100)
    return table(spark, sf, "events").select(
        "event_id", decisions.e2_confidence(score).alias("confidence")
    )


# --- non-defect filter ----------------------------------------------------------
_NON = "|".join(defects.NON_DEFECT_PATTERNS)
_OVR = "|".join(defects.DEFECT_OVERRIDE_PATTERNS)
_TEXT = "lower(defect_text || ' ' || action_text)"
FLAG_SQL = f"""flagged AS (SELECT *, CASE WHEN o <> '' THEN 'Defect indicator found: ''' || o || ''''
        WHEN n <> '' THEN 'Routine maintenance: ''' || n || '''' ELSE 'Default: no non-defect pattern found' END AS why,
      (o <> '' OR n = '') AS is_defect
    FROM (SELECT *, regexp_extract({_TEXT}, '{_OVR}', 0) AS o, regexp_extract({_TEXT}, '{_NON}', 0) AS n FROM wo))"""


@query(
    "is_technical_defect",
    f"WITH {WO_SQL}, {FLAG_SQL} SELECT wo_id, is_defect, why AS reason FROM flagged",
)
def is_technical_defect(spark, sf):
    flagged = defects.with_verdict(work_orders(spark, sf), "defect_text", "action_text")
    return flagged.select("wo_id", "is_defect", "reason")


def _both_texts():
    return F.concat_ws(" ", "defect_text", "action_text")


@query(
    "non_defect_matches",
    f"WITH {WO_SQL} SELECT wo_id, array_to_string(regexp_extract_all({_TEXT}, '{_NON}', 0), '|') AS matches FROM wo",
)
def non_defect_matches(spark, sf):
    return work_orders(spark, sf).select(
        "wo_id", joined(defects.non_defect_matches(_both_texts())).alias("matches")
    )


@query(
    "defect_matches",
    f"WITH {WO_SQL} SELECT wo_id, array_to_string(regexp_extract_all({_TEXT}, '{_OVR}', 0), '|') AS matches FROM wo",
)
def defect_matches(spark, sf):
    return work_orders(spark, sf).select(
        "wo_id", joined(defects.defect_matches(_both_texts())).alias("matches")
    )


ECHO_SQL = """CASE WHEN length(regexp_replace(ata_entered, '[^0-9]', '', 'g')) >= 4
    THEN regexp_replace(ata_entered, '[^0-9]', '', 'g')[1:2] || '-' || regexp_replace(ata_entered, '[^0-9]', '', 'g')[3:4]
    ELSE trim(ata_entered) END"""


@query(
    "non_defect_split",
    f"""WITH {WO_SQL}, {FLAG_SQL} SELECT wo_id, is_defect, why AS non_defect_reason,
      CASE WHEN NOT is_defect THEN 'NON_DEFECT' END AS decision, CASE WHEN NOT is_defect THEN {ECHO_SQL} END AS ata04_final,
      CASE WHEN NOT is_defect THEN CAST(0.99 AS DOUBLE) END AS confidence,
      CASE WHEN NOT is_defect THEN 'Non-technical: ' || why END AS reason FROM flagged""",
)
def non_defect_split(spark, sf):
    df = ops.flag_defects(ops.fill_fields(ops.map_columns(interface_work_orders(spark, sf))))
    outcome = ops.non_defect_outcome(F.col("ATA04_Entered"), F.col("Non_Defect_Reason"))
    return df.select(
        "wo_id",
        F.col("Is_Technical_Defect").alias("is_defect"),
        F.col("Non_Defect_Reason").alias("non_defect_reason"),
        F.when(~F.col("Is_Technical_Defect"), outcome).alias("o"),
    ).select("wo_id", "is_defect", "non_defect_reason", "o.*")


# --- citations ------------------------------------------------------------------
def _form_sql(order, pattern, type_group, digit_groups):
    p = "(?i)" + pattern
    groups = [f"unnest(regexp_extract_all(action_text, '{p}', {g})) AS g{i}" for i, g in enumerate(digit_groups)]
    groups += [f"'' AS g{i}" for i in range(len(digit_groups), 5)]
    kind = f"unnest(regexp_extract_all(action_text, '{p}', {type_group}))" if type_group else "''"
    return f"""SELECT wo_id, {order} AS form, unnest(range(len(regexp_extract_all(action_text, '{p}', 0)))) AS hit,
        unnest(regexp_extract_all(action_text, '{p}', 0)) AS raw_match, {kind} AS kind, {', '.join(groups)} FROM wo"""


# (pattern, group of the manual type or None, groups of the digits)
_FORMS = [
    (citations.TYPED, 1, (2, 3, 4, 5, 6)),
    (citations.COMPACT, 1, (2, 3, 4, 5, 6)),
    (citations.STANDALONE, None, (1, 2, 3, 4, 5)),
    (citations.KEYWORD, 1, (2, 3, 4)),
]
CITES_SQL = (
    "found AS ("
    + " UNION ALL ".join(_form_sql(i, *form) for i, form in enumerate(_FORMS))
    + """), cites AS (SELECT wo_id, CASE WHEN coalesce(kind, '') = '' THEN 'TSM' ELSE upper(kind) END AS manual_type,
        concat_ws('-', g0, g1, g2, nullif(g3, ''), nullif(g4, '')) AS task_number, g0 || '-' || g1 AS ata04,
        g0 AS chapter, g1 AS section, g2 AS subject, nullif(g3, '') AS subsection1, nullif(g4, '') AS subsection2,
        raw_match, form, hit FROM found),
    listed AS (SELECT * EXCLUDE (form, hit, n), row_number() OVER (PARTITION BY wo_id ORDER BY form, hit) - 1 AS citation_pos
      FROM (SELECT *, row_number() OVER (PARTITION BY wo_id, manual_type, task_number ORDER BY form, hit) AS n FROM cites) WHERE n = 1)"""
)


@query(
    "extract_citations",
    f"""WITH {WO_SQL}, {CITES_SQL} SELECT wo_id, CAST(citation_pos AS INTEGER) AS citation_pos, manual_type, task_number, ata04,
      chapter, section, subject, subsection1, subsection2, raw_match FROM listed""",
)
def extract_citations(spark, sf):
    from hangarflow.operators.registry import cited

    return cited(work_orders(spark, sf), "wo_id", "action_text")


@query(
    "parse_citation",
    f"""WITH {WO_SQL}, {CITES_SQL} SELECT raw_match, manual_type, task_number, ata04, count(*) AS n FROM listed
      GROUP BY raw_match, manual_type, task_number, ata04""",
)
def parse_citation(spark, sf):
    from hangarflow.operators.registry import cited

    return (
        cited(work_orders(spark, sf), "wo_id", "action_text")
        .groupBy("raw_match", "manual_type", "task_number", "ata04")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "first_citation",
    f"""WITH {WO_SQL}, {CITES_SQL} SELECT wo.wo_id, l.manual_type, l.task_number, l.ata04, l.raw_match
      FROM wo LEFT JOIN listed l ON wo.wo_id = l.wo_id AND l.citation_pos = 0""",
)
def first_citation(spark, sf):
    first = citations.first_citation(F.col("action_text"))
    return (
        work_orders(spark, sf)
        .select("wo_id", first.alias("c"))
        .select("wo_id", "c.manual_type", "c.task_number", "c.ata04", "c.raw_match")
    )


@query(
    "extract_ata04",
    f"""WITH {WO_SQL}, {CITES_SQL} SELECT wo.wo_id, l.ata04 FROM wo LEFT JOIN listed l
      ON wo.wo_id = l.wo_id AND l.citation_pos = 0""",
)
def extract_ata04(spark, sf):
    return work_orders(spark, sf).select(
        "wo_id", citations.extract_ata04(F.col("action_text")).alias("ata04")
    )


# --- decisions ------------------------------------------------------------------
def decision_sql(source: str, threshold: float = 0.75) -> str:
    """CTE ``decided`` over a CTE with k, e0, e1 (NULL unless valid), e2, s."""
    c = "c"
    rule = [
        ("e0 = e1 AND e1 = e2", "CONFIRM", "e0", "0.97", "'All sources agree (E0=E1=E2)'"),
        ("e1 = e2", "CORRECT", "e1", "0.95", "'Citation and derived agree on ' || e1 || ', differs from entered ' || z"),
        ("e1 IS NULL AND e0 = e2", "CONFIRM", "e0", c, "'Catalog confirms entered ATA (score: ' || p || ')'"),
        ("weak AND e0 = e1", "CONFIRM", "e0", "0.92", "'Valid citation confirms entered ATA'"),
        ("weak AND e1 IS NOT NULL", "CORRECT", "e1", "0.90", "'Valid citation ' || e1 || ' differs from entered ' || z"),
        (f"e1 IS NULL AND e2 IS NOT NULL AND s >= 0.3 AND c >= {threshold}", "CORRECT", "e2", c, "'Catalog suggests ' || e2 || ' (score: ' || p || ')'"),
        ("e1 IS NULL AND e2 IS NOT NULL AND s >= 0.3", "REVIEW", "e0", c, "'Low catalog confidence (score: ' || p || ')'"),
        ("e1 IS NOT NULL AND e2 IS NOT NULL AND e0 = e1", "CONFIRM", "e0", "0.88", "'Citation confirms E0=' || e1 || ', catalog suggests ' || e2"),
        ("e1 IS NOT NULL AND e0 = e2 AND c >= 0.85", "CONFIRM", "e0", "0.85", "'Strong catalog confirms E0=' || e2 || ', citation suggests ' || e1"),
        ("e1 IS NOT NULL AND e0 = e2", "REVIEW", "e0", "0.70", "'Conflict: citation=' || e1 || ', catalog=' || e2"),
        ("e1 IS NOT NULL AND e2 IS NOT NULL", "REVIEW", "e0", "0.65", "'All differ: E0=' || z || ', citation=' || e1 || ', catalog=' || e2"),
        ("e0 IS NOT NULL AND e2 IS NULL", "REVIEW", "e0", "0.65", "'No citation or catalog match found'"),
    ]

    def case(i, last, cast="{}"):
        return "CASE " + " ".join(f"WHEN {r[0]} THEN {cast.format(r[i])}" for r in rule) + f" ELSE {last} END"

    quoted = "CASE " + " ".join(f"WHEN {r[0]} THEN '{r[1]}'" for r in rule) + " ELSE 'REVIEW' END"
    return f"""decided AS (SELECT k, {quoted} AS decision, {case(2, 'e0')} AS ata04_final,
        {case(3, 'CAST(0.50 AS DOUBLE)', 'CAST({} AS DOUBLE)')} AS confidence,
        {case(4, "'Insufficient data for decision'")} AS reason
      FROM (SELECT *, coalesce(e0, 'None') AS z, printf('%.2f', coalesce(s, 0.0)) AS p, {E2_CONF_SQL.format(s='s')} AS c,
        (e2 IS NULL OR (s <> 0 AND s < 0.3)) IS TRUE AS weak FROM {source}))"""


# A derived code and score for every work order, so that each rule has rows.
_E2 = "CASE wo_id % 5 WHEN 0 THEN NULL WHEN 1 THEN true_ata WHEN 2 THEN ata_entered ELSE '99-' || substr(true_ata, 1, 2) END"
_S = "CASE WHEN wo_id % 11 = 0 THEN NULL ELSE CAST(wo_id % 97 AS DOUBLE) / 97 END"
_VALID = "CASE wo_id % 6 WHEN 0 THEN false WHEN 1 THEN NULL ELSE true END"


def _digits(expr):
    d = f"regexp_replace({expr}, '[^0-9]', '', 'g')"
    return f"CASE WHEN length({d}) >= 4 THEN {d}[1:2] || '-' || {d}[3:4] END"


_DECISION_SQL = f"""WITH {WO_SQL}, {CITES_SQL}, evidence AS (SELECT wo.wo_id AS k, {_digits('ata_entered')} AS e0,
      CASE WHEN {_VALID.replace('wo_id', 'wo.wo_id')} THEN l.ata04 END AS e1, {_digits(_E2.replace('wo_id', 'wo.wo_id'))} AS e2,
      {_S.replace('wo_id', 'wo.wo_id')} AS s FROM wo LEFT JOIN listed l ON wo.wo_id = l.wo_id AND l.citation_pos = 0),
    {decision_sql('evidence')}"""


def _decided(spark, sf):
    df = work_orders(spark, sf).withColumns(
        {"e2": F.expr(_E2), "s": F.expr(_S), "valid": F.expr(_VALID)}
    )
    outcome = decisions.make_decision(
        F.col("ata_entered"),
        citations.extract_ata04(F.col("action_text")),
        F.col("valid"),
        F.col("e2"),
        F.col("s"),
    )
    return df.select("wo_id", outcome.alias("o")).select("wo_id", "o.*")


@query(
    "make_decision",
    f"{_DECISION_SQL} SELECT k AS wo_id, decision, ata04_final, confidence, reason FROM decided",
)
def make_decision(spark, sf):
    return _decided(spark, sf)


@query(
    "validate_decision",
    f"""{_DECISION_SQL} SELECT k AS wo_id, (decision IN ('CONFIRM', 'CORRECT', 'REVIEW', 'NON_DEFECT')
      AND conf BETWEEN 0 AND 1) IS TRUE AS valid
      FROM (SELECT k, decision, CASE k % 10 WHEN 0 THEN confidence + 0.5 WHEN 1 THEN NULL ELSE confidence END AS conf FROM decided)""",
)
def validate_decision(spark, sf):
    # Some confidences are spoilt on purpose, so both outcomes occur.
    spoilt = F.when(F.col("wo_id") % 10 == 0, F.col("confidence") + 0.5).when(
        F.col("wo_id") % 10 != 1, F.col("confidence")
    )
    return _decided(spark, sf).select(
        "wo_id", decisions.validate_decision(F.col("decision"), spoilt).alias("valid")
    )
