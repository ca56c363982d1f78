"""Markup reading, chunks, splitting, and incremental scans."""

import random
import time

import pytest
from pyspark.sql import functions as F

from hangarflow.functions.markup import read_elements
from hangarflow.functions.splitting import split_text
from hangarflow.operators import documents as ops
from hangarflow.plans.build import build_index
from hangarflow.session import new_path
from hangarflow.sources import manuals
from hangarflow.streaming import ingest

DATA_MODULE = """<?xml version="1.0"?><!DOCTYPE dmodule [<!ENTITY x "y">]><dmodule><ident>
<dmCode systemCode="7" subSystemCode="3" subSubSystemCode="0" assyCode="12" disassyCode="1" disassyCodeVariant="A"/>
<dmTitle><techName> Fuel &amp; pumps </techName><infoName>Fault isolation</infoName></dmTitle>
<para>This paragraph is outside of the content part.</para></ident>
<content><levelledPara><title>Checks</title><para>Look at the pump and the   valve.</para></levelledPara>
<proceduralStep><para>Remove the fuel pump carefully.</para></proceduralStep>
<warning>Fuel vapour can explode, keep away.</warning><note>short note</note>
<figure id="f1"><title>Pump</title><legend>Side view</legend></figure><graphic id="g2"/>
<dmRef>28-10-00</dmRef><dmRef>28-10-00</dmRef><internalRef>fig 1</internalRef></content></dmodule>"""
CHAPTER = """<chapter><title>Cabin <b>air</b></title><taskNumber>21-26-00</taskNumber>
<step><title>One</title>Open the <i>left</i> panel first.</step><p>First paragraph of the text<p>Second paragraph of the text</p>
<caution>Do not open both panels.<br>Use gloves at all times.</caution><script>var p = "<p>no text at all, never</p>";</script>
<![CDATA[raw < text]]></chapter>"""
BROKEN = "<para>Never closed paragraph text</b> goes on & on <unknown attr='>'>inside"


@pytest.fixture(scope="module")
def parsed(spark):
    docs = spark.createDataFrame(
        [("dm/a.sgm", DATA_MODULE), ("tsm/21-26-00.sgml", CHAPTER), ("x.sgm", BROKEN), ("null.sgm", None)],
        "filename string, markup string",
    )
    return ops.identify(ops.parse_documents(docs)).cache()


def test_identity(parsed):
    rows = {r.filename: r for r in parsed.collect()}
    assert set(rows) == {"dm/a.sgm", "tsm/21-26-00.sgml", "x.sgm"}
    dm, chapter, broken = rows["dm/a.sgm"], rows["tsm/21-26-00.sgml"], rows["x.sgm"]
    assert (dm.format, dm.ata04, dm.task_number, dm.title) == ("S1000D", "07-03", "07-03-00-012-001-00A", "Fuel & pumps")
    assert (chapter.format, chapter.ata04, chapter.task_number, chapter.title) == ("iSpec2200", "21-26", "21-26-00", "Cabinair")
    assert (broken.ata04, broken.task_number, broken.title) == (None, "", "")


def test_chunks(parsed):
    rows = ops.doc_chunks(parsed, ["filename"]).orderBy("filename", "chunk_pos").collect()
    got = {}
    for r in rows:
        got.setdefault(r.filename, []).append((r.chunk_type, r.chunk_title, r.text))
    assert got["dm/a.sgm"] == [
        ("content", "Checks", "Checks Look at the pump and the   valve."),
        ("content", "", "Look at the pump and the   valve."),
        ("procedure", "", "Remove the fuel pump carefully."),
        ("content", "", "Remove the fuel pump carefully."),
        ("warning", "", "Fuel vapour can explode, keep away."),
    ]
    assert got["tsm/21-26-00.sgml"] == [
        ("procedure", "One", "One Open the left panel first."),
        ("content", "", "First paragraph of the text"),
        ("content", "", "Second paragraph of the text"),
        ("caution", "", "Do not open both panels. Use gloves at all times."),
    ]
    assert got["x.sgm"] == [("content", "", "Never closed paragraph text goes on & on inside")]


def test_warnings_figures_references(parsed):
    warnings = {r.warning for r in ops.doc_warnings(parsed, ["filename"]).collect()}
    assert warnings == {"Fuel vapour can explode, keep away.", "Do not open both panels.Use gloves at all times."}
    figures = ops.doc_figures(parsed, ["filename"]).collect()
    assert [(f.figure_id, f.figure_title, f.caption) for f in figures] == [("f1", "Pump", "Side view")]
    refs = sorted(r.reference for r in ops.doc_references(parsed, ["filename"]).collect())
    assert refs == ["28-10-00", "fig 1"]


def test_references_need_code_and_task(parsed):
    rows = ops.document_references(parsed, F.lit("TSM")).collect()
    assert sorted((r.ata04, r.task_number, r.chapter, r.section) for r in rows) == [
        ("07-03", "07-03-00-012-001-00A", "07", "03"),
        ("21-26", "21-26-00", "21", "26"),
    ]


def test_format_from_raw_text(spark):
    df = spark.createDataFrame([("<dmodule>",), ("<DMODULE id='1'>",), ("<dmodules>",)], "m string")
    assert [r[0] for r in df.select(ops.detect_format(F.col("m"))).collect()] == ["S1000D", "S1000D", "iSpec2200"]


def test_reader_survives_any_text():
    rng = random.Random(3)
    parts = ["<p>", "</p>", "<para", ">", "<", "</", "&amp;", "&", "text ", '"', "<!--", "-->", "<![CDATA[", "]]>", "<script>", "<a b='", "/>"]
    for _ in range(2000):
        _, elements = read_elements("".join(rng.choice(parts) for _ in range(rng.randint(0, 25))))
        assert elements[0]["name"] == "#document"
        for e in elements:
            assert e["pos"] <= e["last"]


@pytest.mark.parametrize(
    "markup",
    ["<?" * 100_000, "<!" * 100_000, "<![x" * 100_000 + ">", "<para>" * 50_000 + "x", "<para>" * 30_000 + "</note>" * 30_000,
     "<title>a" * 20_000, "<para>word &amp; word</para>\n" * 180_000],
    ids=["instructions", "declarations", "subsets", "nested", "mismatched", "titles", "long"],
)
def test_reading_takes_linear_time(markup):
    start = time.monotonic()
    nodes, elements = read_elements(markup)
    assert time.monotonic() - start < 10
    assert sum(map(len, nodes)) <= len(markup) and elements[0]["count"] == len(nodes)


def test_text_is_stored_once():
    nodes, elements = read_elements("<content><para>one <p>two</p></para> three</content>")
    assert nodes == ["one ", "two", " three"]
    runs = {e["name"]: nodes[e["first"] - 1 : e["first"] - 1 + e["count"]] for e in elements}
    assert runs["content"] == nodes and runs["para"] == ["one ", "two"] and runs["p"] == ["two"]


def _splits(text, size, overlap):
    """What has to hold for any split of a text without double line breaks."""
    pieces = split_text(text, size, overlap)
    assert all(0 < len(p) <= size for p in pieces)
    at = 0
    for p in pieces:  # pieces are substrings, in order
        found = text.find(p, max(0, at - overlap - size))
        assert found >= 0
        at = found
    return pieces


def test_split_text():
    assert split_text("aaa bbb ccc", 8, 4) == ["aaa bbb", "bbb ccc"]
    assert split_text("aaa\n\nbbb\n\nccc", 8, 0) == ["aaa\n\nbbb", "ccc"]
    assert split_text("x" * 25, 10, 2) == ["x" * 10, "x" * 10, "x" * 9]
    rng = random.Random(5)
    for _ in range(300):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 14))) for _ in range(rng.randint(1, 60))]
        text = "".join(w + rng.choice([" ", " ", "\n"]) for w in words)
        pieces = _splits(text, 40, 10)
        assert set(text.split()) == {w for w in set(text.split()) if any(w in p for p in pieces)}


def test_split_chunks_keeps_short_texts(spark):
    df = spark.createDataFrame([(1, "short one, kept whole"), (2, "tiny"), (3, "word " * 500)], "id int, text string")
    rows = ops.split_chunks(df).orderBy("id", "piece_pos").collect()
    assert [r.text for r in rows if r.id == 1] == ["short one, kept whole"]
    assert not [r for r in rows if r.id == 2]
    long = [r.text for r in rows if r.id == 3]
    assert len(long) == 3 and all(len(t) <= 1000 for t in long)


def test_scans(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.sgm").write_bytes("<p>é\xe9</p>".encode("latin-1") + "é".encode())
    (tmp_path / "m" / "b.sgml").write_text("<p>b</p>")
    (tmp_path / "m" / "c.txt").write_text("no")
    files = {r.filename.rsplit("/", 1)[1]: r.markup for r in manuals.scan_files(spark, str(tmp_path)).collect()}
    assert files == {"a.sgm": "<p></p>é", "b.sgml": "<p>b</p>"}
    texts = manuals.scan_files(spark, str(tmp_path), glob="*.txt").collect()
    assert [r.markup for r in texts] == ["no"]


def test_incremental_equals_batch(spark, tmp_path):
    source = str(tmp_path / "in")
    output, checkpoint = new_path(spark, "ingested"), new_path(spark, "checkpoint")
    total = []
    for run in range(3):
        rows = [("TSM", f"f{run}-{i}.sgm", f"<p>{i}</p>") for i in range(4)]
        spark.createDataFrame(rows, ingest.DOCS).write.mode("append").parquet(source)
        total += [r[1] for r in rows]
        ingest.ingest_available(ingest.new_files(spark, source), output, checkpoint)
        got = sorted(r.filename for r in spark.read.parquet(output).collect())
        assert got == sorted(total)
    ledger = spark.read.parquet(output)
    assert manuals.not_processed(spark.read.parquet(source), ledger).isEmpty()
    # The same file name under another manual type is another document.
    other = spark.createDataFrame([("FIM", "f0-0.sgm", "")], ingest.DOCS)
    assert manuals.not_processed(other, ledger).count() == 1


def test_build_index(spark):
    docs = spark.createDataFrame(
        [("TSM", "dm/a.sgm", DATA_MODULE), ("FIM", "fim/21-26-00.sgml", CHAPTER)],
        "manual_type string, filename string, markup string",
    )
    references, chunks = build_index(docs)
    assert references.count() == 2
    rows = chunks.collect()
    assert len({r.chunk_id for r in rows}) == len(rows) == 9
    assert {r.manual_type for r in rows} == {"TSM", "FIM"}


def test_streamed_index_equals_batch(spark, tmp_path):
    source, output, checkpoint = str(tmp_path / "in"), new_path(spark, "index"), new_path(spark, "checkpoint")
    docs = [("TSM", "dm/a.sgm", DATA_MODULE), ("FIM", "fim/21-26-00.sgml", CHAPTER), ("AMM", "x.sgm", BROKEN)]
    for doc in docs:
        spark.createDataFrame([doc], ingest.DOCS).write.mode("append").parquet(source)
        ingest.index_available(ingest.new_files(spark, source), output, checkpoint)
    references, chunks = build_index(spark.createDataFrame(docs, ingest.DOCS))
    for streamed, batch in zip(ingest.read_index(spark, output), (references, chunks), strict=True):
        streamed = streamed.select(*batch.columns)
        assert sorted(map(repr, streamed.collect())) == sorted(map(repr, batch.collect()))


def test_bundles_split_at_record_ends(spark, tmp_path):
    from pyspark.sql import functions as F

    from hangarflow.sources import manuals

    rows = [(f'dm/{i}"&.sgm', ("<para>x</para>" * (i * 37 % 400)) + f"<title>{i}</title>") for i in range(300)]
    rows.append(("empty.sgm", ""))
    df = spark.createDataFrame(rows, "filename string, markup string")
    folder = str(tmp_path / "bundles")
    manuals.write_bundles(df.coalesce(1), folder)
    # Stray bytes after the last record, as in a file cut off while it was written.
    extra = tmp_path / "bundles" / "part-zz-stray.txt"
    extra.write_text('<manual name="cut">never ended</manual>\nnot a record at all')
    previous = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        scanned = manuals.scan_bundles(spark, folder)
        assert scanned.rdd.getNumPartitions() > 4
        got = scanned.select("filename", "markup", "error").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", previous)
    good = sorted((r.filename, r.markup) for r in got if r.error is None)
    assert good == sorted(rows + [("cut", "never ended")])
    assert [r.error for r in got if r.error is not None] == ["not a record at all"]


def test_elements_leave_before_much_markup_is_held(spark):
    """One Arrow batch of many short documents goes back in pieces, so a worker's memory does not follow the batch."""
    import pyarrow as pa

    class Docs:
        schema = spark.createDataFrame([], "doc_id long, markup string").schema

        def select(self, *names):
            return self

        def mapInArrow(self, read, schema):  # noqa: N802
            return read

    text = "<chapter><title>T</title>" + "<para>Pump of the green system shows low pressure</para>" * 70 + "</chapter>"
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(1_500)), "markup": pa.array([text] * 1_500)})
    pieces = list(ops.parse_documents(Docs())(iter([batch])))
    assert [i for piece in pieces for i in piece.column("doc_id").to_pylist()] == list(range(1_500))
    assert max(piece.num_rows for piece in pieces) * len(text) < 2 * 1024 * 1024
