"""Queries over the reference registry built from parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from hangarflow.operators import registry as ops
from hangarflow.session import new_path
from hangarflow.sources import tables
from suite.data import REFS_SQL, WO_SQL, references, work_orders
from suite.workorders import CITES_SQL

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


_FIELDS = "manual_type, ata04, task_number, chapter, section, subject, subsection1, subsection2, title, filename"
_CITED = f"WITH {WO_SQL}, {CITES_SQL}, {REFS_SQL}"


def _cited(spark, sf):
    return ops.cited(work_orders(spark, sf), "wo_id", "action_text").select(
        "wo_id", "citation_pos", "manual_type", "task_number"
    )


@query(
    "registry_append",
    f"WITH {REFS_SQL} SELECT {_FIELDS}, true AS is_active, (SELECT count(*) FROM refs) AS added FROM refs",
)
def registry_append(spark, sf):
    path = new_path(spark, "registry")
    added = tables.append_references(references(spark, sf), path)
    return (
        tables.read_registry(spark, path).drop("created_at").withColumn("added", F.lit(added).cast("long"))
    )


@query("registry_overwrite", f"WITH {REFS_SQL} SELECT {_FIELDS} FROM refs WHERE manual_type = 'TSM'")
def registry_overwrite(spark, sf):
    """All references, cleared, then one manual type again: only that type is left."""
    path = new_path(spark, "registry")
    tables.append_references(references(spark, sf), path)
    tables.clear_registry(spark, path)
    tables.append_references(references(spark, sf).where("manual_type = 'TSM'"), path)
    return tables.read_registry(spark, path).drop("created_at", "is_active")


@query(
    "ref_exists",
    f"""{_CITED} SELECT wo_id, CAST(citation_pos AS INTEGER) AS citation_pos, task_number,
      task_number IN (SELECT task_number FROM refs) AS ref_exists FROM listed""",
)
def ref_exists(spark, sf):
    keys = _cited(spark, sf).drop("manual_type")
    return ops.exists(keys, references(spark, sf))


@query(
    "ref_exists_typed",
    f"""{_CITED} SELECT wo_id, CAST(citation_pos AS INTEGER) AS citation_pos, manual_type, task_number,
      (manual_type, task_number) IN (SELECT (manual_type, task_number) FROM refs) AS ref_exists FROM listed""",
)
def ref_exists_typed(spark, sf):
    return ops.exists(_cited(spark, sf), references(spark, sf), typed=True)


_ONE = f"one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task_number ORDER BY manual_type, filename) AS n FROM refs) WHERE n = 1)"


@query(
    "ref_get",
    f"""{_CITED}, {_ONE} SELECT l.wo_id, CAST(l.citation_pos AS INTEGER) AS citation_pos, l.task_number, o.manual_type, o.ata04,
      o.chapter, o.section, o.subject, o.subsection1, o.subsection2, o.title, o.filename
      FROM listed l LEFT JOIN one o ON l.task_number = o.task_number""",
)
def ref_get(spark, sf):
    return ops.get_reference(_cited(spark, sf).drop("manual_type"), references(spark, sf))


@query("ref_by_ata", f"WITH {REFS_SQL} SELECT ata04, manual_type, task_number, title FROM refs")
def ref_by_ata(spark, sf):
    return ops.search_by_ata(references(spark, sf))


@query(
    "ref_by_ata_codes",
    f"""WITH {WO_SQL}, {REFS_SQL} SELECT ata04, manual_type, task_number, title FROM refs
      WHERE ata04 IN (SELECT ata_entered FROM wo)""",
)
def ref_by_ata_codes(spark, sf):
    """References of every code entered, as written, on some work order, asked as one table."""
    return ops.search_by_ata(references(spark, sf), work_orders(spark, sf).select("ata_entered"))


@query(
    "ref_stats",
    f"""WITH {REFS_SQL} SELECT coalesce(manual_type, 'ALL') AS manual_type, count(*) AS total_references,
      count(DISTINCT ata04) AS unique_atas FROM refs GROUP BY GROUPING SETS ((manual_type), ())""",
)
def ref_stats(spark, sf):
    return ops.statistics(references(spark, sf))


@query(
    "validate_citations",
    f"""{_CITED} SELECT wo_id, CAST(citation_pos AS INTEGER) AS citation_pos, manual_type, task_number, ata04, raw_match,
      (manual_type, task_number) IN (SELECT (manual_type, task_number) FROM refs) AS cited_exists FROM listed""",
)
def validate_citations(spark, sf):
    cited = ops.cited(work_orders(spark, sf), "wo_id", "action_text").select(
        "wo_id", "citation_pos", "manual_type", "task_number", "ata04", "raw_match"
    )
    return ops.validate_citations(cited, references(spark, sf))
