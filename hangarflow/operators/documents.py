"""Markup documents: elements, identity, chunks, and cross references."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from hangarflow.functions import markup as _markup
from hangarflow.functions import splitting as _splitting
from hangarflow.functions.codes import ata_from_filename_strict, null_if_empty, zero_fill
from hangarflow.functions.text import strip
from hangarflow.schema import ELEMENT

# Ship the helpers with the task, so workers need no installed package.
cloudpickle.register_pickle_by_value(_markup)
cloudpickle.register_pickle_by_value(_splitting)

# --- fixed values: tags and length limits ---------------------------------------
S1000D_CHUNK_TAGS = ["levelledPara", "proceduralStep", "para", "warning", "caution", "note"]
ISPEC_CHUNK_TAGS = ["para", "p", "step", "warning", "caution", "note", "description"]
WARNING_TAGS = ["warning", "caution", "warningAndCautionRef"]
FIGURE_TAGS = ["figure", "graphic"]
REFERENCE_TAGS = ["dmRef", "internalRef", "externalRef"]
TASK_CODES = [
    "systemCode",
    "subSystemCode",
    "subSubSystemCode",
    "assyCode",
    "disassyCode",
    "disassyCodeVariant",
]
CHUNK_MIN, CHUNK_MAX = 20, 2000
WARNING_MIN, WARNING_MAX = 10, 500
# --- end of fixed values ----------------------------------------------------------

# Markup read before its elements are handed back to Spark. Elements are Python objects until then and take many
# times the space of their markup.
_BATCH_CHARS = 1024 * 1024


def lowered(tags: list[str]) -> list[str]:
    return [tag.lower() for tag in tags]


def strings_of(element: Column) -> Column:
    """Text nodes of an element: a run of its document's ``nodes``."""
    return F.slice(F.col("nodes"), element["first"], element["count"])


def spaced_text(strings: Column) -> Column:
    """Text nodes stripped and joined by one space."""
    stripped = F.transform(strings, strip)
    return F.array_join(F.filter(stripped, lambda s: s != ""), " ")


def dense_text(strings: Column) -> Column:
    """Text nodes stripped and joined without a gap."""
    return F.array_join(F.transform(strings, strip), "")


def raw_text(strings: Column) -> Column:
    """Text nodes joined as they stand, outer white space removed."""
    return strip(F.array_join(strings, ""))


def parse_documents(docs: DataFrame, markup_col: str = "markup") -> DataFrame:
    """Replace the markup column by ``format``, ``nodes`` and ``elements``; NULL markup drops out.

    Text is stored once per document, in ``nodes``; elements point into it.

    The only Python stage of document reading. It is narrow: every other column
    passes through in the same Arrow batch and nothing shuffles.
    """
    kept = [f for f in docs.schema.fields if f.name != markup_col]
    names = [f.name for f in kept]
    schema = T.StructType(
        [*kept, T.StructField("format", T.StringType()),
         T.StructField("nodes", T.ArrayType(T.StringType())), T.StructField("elements", T.ArrayType(ELEMENT))]
    )
    read = _markup.read_elements
    arrow_elements = to_arrow_type(T.ArrayType(ELEMENT))

    limit = _BATCH_CHARS

    def emit(batch, elements):
        formats = [
            "S1000D" if any(e["name"] == "dmodule" for e in doc) else "iSpec2200"
            for _, doc in elements
        ]
        columns = [batch.column(name) for name in names]
        columns += [pa.array(formats, pa.string()), pa.array([nodes for nodes, _ in elements], pa.list_(pa.string()))]
        columns.append(pa.array([doc for _, doc in elements], arrow_elements))
        return pa.RecordBatch.from_arrays(columns, names=[*names, "format", "nodes", "elements"])

    def batches(stream):
        for batch in stream:
            if batch.column(markup_col).null_count:
                batch = batch.filter(batch.column(markup_col).is_valid())
            start, chars, elements = 0, 0, []
            for row, markup in enumerate(batch.column(markup_col)):
                text = markup.as_py()
                elements.append(read(text))
                chars += len(text)
                # Long documents leave in small batches, whatever the row limit is.
                if chars > limit:
                    yield emit(batch.slice(start, len(elements)), elements)
                    start, chars, elements = row + 1, 0, []
            if elements:
                yield emit(batch.slice(start, len(elements)), elements)

    return docs.select(*names, markup_col).mapInArrow(batches, schema)


def detect_format(markup: Column) -> Column:
    """Format from the raw text, for jobs that need nothing else."""
    return F.when(markup.rlike(r"(?i)<dmodule[\s/>]"), F.lit("S1000D")).otherwise(
        F.lit("iSpec2200")
    )


def _named(elements: Column, name: str) -> Column:
    return F.filter(elements, lambda e: e["name"] == name.lower())


def _first(elements: Column, *names: str) -> Column:
    """First element of the first name that occurs."""
    return F.coalesce(*[F.try_element_at(_named(elements, n), F.lit(1)) for n in names])


def _inside(elements: Column, outer: Column) -> Column:
    return F.filter(
        elements, lambda e: (e["pos"] > outer["pos"]) & (e["pos"] <= outer["last"])
    )


def doc_title(fmt: Column, elements: Column) -> Column:
    """Technical name, else information name, else the whole title."""

    def s1000d(pack: Column) -> Column:
        title, inner = pack["title"], _inside(pack["elements"], pack["title"])
        node = F.coalesce(_first(inner, "techName"), _first(inner, "infoName"), title)
        return F.coalesce(dense_text(strings_of(node)), F.lit(""))

    pack = F.array(
        F.struct(_first(elements, "dmTitle", "title").alias("title"), elements.alias("elements"))
    )
    plain = F.coalesce(dense_text(strings_of(_first(elements, "title"))), F.lit(""))
    return F.when(fmt == "S1000D", F.element_at(F.transform(pack, s1000d), 1)).otherwise(plain)


def _code_value(pack: Column, name: str) -> Column:
    """A code of the data-module code: child element, else attribute."""
    child = _first(pack["inner"], name)
    return F.when(child.isNotNull(), dense_text(strings_of(child))).otherwise(
        pack["dmc"]["attrs"][name.lower()]
    )


def ata_from_dmc(pack: Column) -> Column:
    """Zero-filled ``system-subsystem``: both as children, else both as attributes."""
    wanted = ("systemCode", "subSystemCode")
    children = [_first(pack["inner"], n) for n in wanted]
    attrs = [pack["dmc"]["attrs"][n.lower()] for n in wanted]
    as_children = F.concat_ws("-", *[zero_fill(dense_text(strings_of(c)), 2) for c in children])
    as_attrs = F.concat_ws("-", *[zero_fill(a, 2) for a in attrs])
    return F.when(children[0].isNotNull() & children[1].isNotNull(), as_children).when(
        attrs[0].isNotNull() & attrs[1].isNotNull(), as_attrs
    )


def task_from_dmc(pack: Column) -> Column:
    """The codes present, two digits wide for the first three found, then three."""
    present = F.array_compact(F.array(*[_code_value(pack, n) for n in TASK_CODES]))
    filled = F.transform(
        present, lambda code, i: F.when(i < 3, zero_fill(code, 2)).otherwise(zero_fill(code, 3))
    )
    return F.array_join(filled, "-")


def _with_dmc(elements: Column, *names: str) -> Column:
    """One-element array binding the data-module code and the elements inside it."""

    def pack(dmc: Column) -> Column:
        return F.struct(dmc.alias("dmc"), _inside(elements, dmc).alias("inner"))

    return F.transform(F.array(_first(elements, *names)), pack)


def dmc_children_ata(elements: Column) -> Column:
    """``system-subsystem`` from the children of ``dmc``, not zero-filled."""

    def join(pack: Column) -> Column:
        system = _first(pack["inner"], "systemCode")
        subsystem = _first(pack["inner"], "subSystemCode")
        return F.when(
            system.isNotNull() & subsystem.isNotNull(),
            F.concat(raw_text(strings_of(system)), F.lit("-"), raw_text(strings_of(subsystem))),
        )

    return F.element_at(F.transform(_with_dmc(elements, "dmc"), join), 1)


def identify(parsed: DataFrame) -> DataFrame:
    """Add ``ata04``, ``task_number`` and ``title`` to parsed documents."""
    elements, is_dm = F.col("elements"), F.col("format") == "S1000D"

    def codes(pack: Column) -> Column:
        return F.struct(ata_from_dmc(pack).alias("ata04"), task_from_dmc(pack).alias("task"))

    dmc = F.element_at(F.transform(_with_dmc(elements, "dmCode", "dmc"), codes), 1)
    task = dense_text(strings_of(_first(elements, "task", "taskNumber")))
    return (
        parsed.withColumn("_dmc", F.when(is_dm, dmc))
        .withColumn(
            "ata04",
            F.when(is_dm, F.col("_dmc.ata04")).otherwise(ata_from_filename_strict(F.col("filename"))),
        )
        .withColumn(
            "task_number",
            F.coalesce(F.when(is_dm, F.col("_dmc.task")).otherwise(task), F.lit("")),
        )
        .withColumn("title", doc_title(F.col("format"), elements))
        .drop("_dmc")
    )


def doc_chunks(parsed: DataFrame, keep: list[str]) -> DataFrame:
    """One row per text chunk, with ``chunk_pos`` in document order.

    Nested chunk tags each give a row, so inner text repeats in its outer chunk.
    """

    def data_module(pack: Column) -> Column:
        return F.filter(
            _inside(pack["elements"], pack["content"]),
            lambda e: e["name"].isin(lowered(S1000D_CHUNK_TAGS)),
        )

    pack = F.array(
        F.struct(
            _first(F.col("elements"), "content", "dmodule").alias("content"),
            F.col("elements").alias("elements"),
        )
    )
    tags = F.when(
        F.col("format") == "S1000D", F.element_at(F.transform(pack, data_module), 1)
    ).otherwise(F.filter("elements", lambda e: e["name"].isin(ISPEC_CHUNK_TAGS)))

    def chunk(tag: Column) -> Column:
        name = tag["name"]
        chunk_type = (
            F.when(name.isin("warning", "caution", "note"), name)
            .when(name.isin("proceduralstep", "step"), F.lit("procedure"))
            .otherwise(F.lit("content"))
        )
        return F.struct(
            chunk_type.alias("chunk_type"),
            tag["title"].alias("chunk_title"),
            spaced_text(strings_of(tag)).alias("text"),
        )

    # Texts are built inside the array, so the length filter works on finished
    # values and does not build them again.
    return (
        parsed.select(*keep, F.posexplode(F.transform(tags, chunk)).alias("chunk_pos", "chunk"))
        .select(*keep, "chunk_pos", "chunk.*", F.length("chunk.text").alias("length"))
        .where(F.col("length").between(CHUNK_MIN, CHUNK_MAX))
    )


def _tags(parsed: DataFrame, keep: list[str], tags: list[str]) -> DataFrame:
    wanted = F.filter("elements", lambda e: e["name"].isin(lowered(tags)))
    return parsed.select(*keep, F.posexplode(wanted).alias("tag_pos", "tag"))


def doc_warnings(parsed: DataFrame, keep: list[str]) -> DataFrame:
    """Warning and caution texts of moderate length."""
    wanted = F.filter("elements", lambda e: e["name"].isin(lowered(WARNING_TAGS)))
    texts = F.transform(wanted, lambda e: dense_text(strings_of(e)))
    return parsed.select(*keep, F.posexplode(texts).alias("tag_pos", "warning")).where(
        (F.length("warning") > WARNING_MIN) & (F.length("warning") < WARNING_MAX)
    )


def doc_figures(parsed: DataFrame, keep: list[str]) -> DataFrame:
    """Figures that carry a title or a caption."""
    return (
        _tags(parsed, keep, FIGURE_TAGS)
        .select(
            *keep,
            "tag_pos",
            F.coalesce(F.col("tag.attrs")["id"], F.lit("")).alias("figure_id"),
            F.col("tag.title").alias("figure_title"),
            F.col("tag.caption").alias("caption"),
        )
        .where((F.col("figure_title") != "") | (F.col("caption") != ""))
    )


def doc_references(parsed: DataFrame, keep: list[str]) -> DataFrame:
    """Distinct cross-reference texts per document, removed inside the row."""
    wanted = F.filter("elements", lambda e: e["name"].isin(lowered(REFERENCE_TAGS)))
    texts = F.array_distinct(F.transform(wanted, lambda e: dense_text(strings_of(e))))
    return parsed.select(*keep, F.explode(texts).alias("reference")).where(
        F.col("reference") != ""
    )


def document_references(identified: DataFrame, manual_type: Column) -> DataFrame:
    """Registry rows for documents that have both a code and a task number."""
    pieces = F.split("ata04", "-")
    nothing = F.lit(None).cast("string")
    return identified.where(
        null_if_empty(F.col("ata04")).isNotNull() & null_if_empty(F.col("task_number")).isNotNull()
    ).select(
        manual_type.alias("manual_type"),
        "ata04",
        "task_number",
        F.get(pieces, 0).alias("chapter"),
        F.get(pieces, 1).alias("section"),
        nothing.alias("subject"),
        nothing.alias("subsection1"),
        nothing.alias("subsection2"),
        "title",
        "filename",
    )


def split_chunks(
    chunks: DataFrame,
    text_col: str = "text",
    size: int = _splitting.CHUNK_SIZE,
    overlap: int = _splitting.CHUNK_OVERLAP,
) -> DataFrame:
    """Pieces of at most ``size`` characters, outer white space removed from all.

    Texts within the limit never leave the JVM: the Python call sees NULL for
    them.
    """
    split = _splitting.split_text

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def pieces(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else split(t, size, overlap))

    text = strip(F.col(text_col))
    long_text = F.when(F.length(text) > size, text)
    return (
        chunks.where(F.length(text) >= CHUNK_MIN)
        .withColumn("_pieces", pieces(long_text))
        .select(
            *[c for c in chunks.columns if c != text_col],
            F.posexplode(F.coalesce("_pieces", F.array(text))).alias("piece_pos", text_col),
        )
    )


def manual_chunks(identified: DataFrame, manual_type: str = "manual_type", **split) -> DataFrame:
    """Index rows: chunk pieces with document identity and a stable ``chunk_id``."""
    keep = [manual_type, "filename", "ata04", "task_number", "title"]
    pieces = split_chunks(doc_chunks(identified, keep), **split)
    chunk_id = F.sha1(F.concat_ws("|", manual_type, "filename", "chunk_pos", "piece_pos"))
    return pieces.select(
        chunk_id.alias("chunk_id"),
        F.col(manual_type).alias("manual_type"),
        "text",
        "ata04",
        "task_number",
        "title",
        "filename",
        "chunk_type",
    )
