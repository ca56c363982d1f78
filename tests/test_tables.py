"""Registry, joins of skewed keys, whole runs, reports, sinks."""

import random

import pytest
from pyspark.sql import functions as F

from hangarflow.operators import registry, reports, workorders
from hangarflow.plans.build import build_catalog
from hangarflow.plans.reconcile import derive_from_chunks, process_work_orders
from hangarflow.schema import RESULT_COLUMNS
from hangarflow.session import lookup_join, new_path
from hangarflow.sources import tables

WORK_ORDERS = [
    # id, code, description, action
    (1, "21-26", "pack valve leak", "Replaced per TSM 21-26-00"),
    (2, "3247", "pack valve leak", "Replaced per TSM 21-26-00"),
    (3, "52", "Cabin cleaning required", "Done"),
    (4, None, "strange smell", None),
    (5, "21-26", "pack valve leak", "Replaced per AMM 99-99-00"),
    (6, "21-26", "   ", "see 21-26-00"),
]
MANUAL = [
    ("tsm/21-26-00_b.sgm", "<d><title>Air packs</title><para>The pack valve leak was found inside</para></d>"),
    ("tsm/32-47-00_c.sgm", "<d><title>Brakes and tyres</title><para>Brake fault found on wheel four</para></d>"),
]


@pytest.fixture(scope="module")
def orders(spark):
    rows = [(*r, "Pilot", "AC-1", "2024-01-01", "2024-01-02") for r in WORK_ORDERS]
    df = spark.createDataFrame(
        rows, "wo_id long, ata string, d string, a string, t string, ac string, i string, c string"
    )
    return df.toDF("wo_id", "ATA", "W/O Description", "W/O Action", "Type", "A/C", "Issued", "Closed")


@pytest.fixture(scope="module")
def model(spark):
    return build_catalog(spark.createDataFrame(MANUAL, "filename string, markup string"))


@pytest.fixture(scope="module")
def refs(spark):
    rows = [("TSM", "21-26", "21-26-00", "21", "26", None, None, None, "Air", f"f{i}.sgm") for i in (2, 1)]
    rows.append(("AMM", "21-26", "21-26-00", "21", "26", None, None, None, "Air AMM", "g.sgm"))
    names = "manual_type, ata04, task_number, chapter, section, subject, subsection1, subsection2, title, filename"
    return spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names.split(", ")))


def _by_id(df):
    return {r.wo_id: r for r in df.collect()}


@pytest.mark.parametrize("join", [{}, {"shuffle": True}])
def test_run(orders, model, refs, join):
    df = process_work_orders(orders, "wo_id", model, registry=refs, **join)
    assert df.columns == [*RESULT_COLUMNS, "wo_id"]
    rows = _by_id(df)
    assert len(rows) == len(WORK_ORDERS)
    assert (rows[1].Decision, rows[1].ATA04_Final, rows[1].Confidence) == ("CONFIRM", "21-26", 0.97)
    assert (rows[2].Decision, rows[2].ATA04_Entered, rows[2].ATA04_Final) == ("CORRECT", "32-47", "21-26")
    assert (rows[3].Decision, rows[3].ATA04_Final, rows[3].Confidence) == ("NON_DEFECT", "52", 0.99)
    assert rows[3].Reason == "Non-technical: Routine maintenance: 'cabin cleaning'"
    assert rows[3].ATA04_From_Cited is None and rows[3].ATA04_Derived is None
    assert (rows[4].Decision, rows[4].ATA04_Final, rows[4].Rectification_Text) == ("REVIEW", None, "")
    assert rows[5].Cited_Exists is False and rows[5].Decision == "CONFIRM"
    assert rows[5].Reason.startswith("Catalog confirms")
    assert rows[6].ATA04_Derived is None and rows[6].Cited_Exists is True
    assert rows[1].Evidence_Snippet == "Air packs" and rows[1].Derived_Task is None


def test_run_variants(orders, model):
    always = _by_id(process_work_orders(orders, "wo_id", model))
    # A citation that counts as valid and a middling catalog score contradict each other.
    assert always[5].Cited_Exists is True and 0.3 < always[5].Derived_Score < 0.8
    assert (always[5].Decision, always[5].Confidence) == ("REVIEW", 0.7)
    rag = _by_id(process_work_orders(orders, "wo_id", model, mode="rag"))
    assert all(r.ATA04_Derived is None for r in rag.values())
    texts = orders.select(F.sha2("W/O Description", 256).alias("text_key")).distinct()
    vectors = texts.withColumn("embedding", F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>"))
    chunks = texts.sparkSession.createDataFrame(
        [("a", "TSM", "21-26", [1.0, 0.0]), ("b", "AMM", "21-26", [1.0, 0.1]), ("c", "FIM", "29-11", [1.0, 0.0])],
        "chunk_id string, manual_type string, ata04 string, embedding array<float>",
    )
    derived = derive_from_chunks(vectors, chunks)
    by_vector = _by_id(process_work_orders(orders, "wo_id", mode="rag", derived=derived))
    assert (by_vector[1].ATA04_Derived, by_vector[1].Derived_DocType) == ("21-26", "RAG")
    assert by_vector[3].ATA04_Derived is None and by_vector[6].ATA04_Derived is None
    unfiltered = _by_id(process_work_orders(orders, "wo_id", model, filter_non_defect=False))
    assert unfiltered[3].Is_Technical_Defect and unfiltered[3].Non_Defect_Reason is None
    with pytest.raises(ValueError, match="unknown mode"):
        process_work_orders(orders, "wo_id", model, mode="other")


def test_partitioning_changes_nothing(orders, model, refs):
    runs = [
        sorted(map(repr, process_work_orders(df, "wo_id", model, registry=refs).collect()))
        for df in (orders.coalesce(1), orders.repartition(7), orders.orderBy(F.desc("wo_id")))
    ]
    assert runs[0] == runs[1] == runs[2]


def test_columns(orders):
    assert workorders.missing_columns(orders.drop("Type", "ATA")) == ["ATA", "Type"]
    with pytest.raises(ValueError, match="missing required columns: Closed"):
        workorders.require_columns(orders.drop("Closed"))
    with pytest.raises(ValueError, match="Decision"):
        workorders.passthrough_columns(orders.withColumn("Decision", F.lit("x")))
    corrected = orders.withColumn("ATA 04 Corrected", F.lit("old"))
    assert "ATA04_Final" in workorders.map_columns(corrected).columns
    done = _by_id(process_work_orders(corrected, "wo_id", mode="rag"))
    assert done[1].ATA04_Final == "21-26"


def test_first_row_decision(orders, model):
    results = process_work_orders(orders, "wo_id", model)
    names = ["Decision", "ATA04_Final", "Confidence", "Reason"]
    reused = _by_id(workorders.first_row_decision(results, "wo_id", names))
    own = _by_id(results)
    assert reused[2].Decision == own[1].Decision == "CONFIRM" and own[2].Decision == "CORRECT"
    assert all(reused[i] == own[i] for i in (1, 3, 4, 5, 6))  # texts of their own
    distinct = {r.copies for r in workorders.distinct_texts(orders, "W/O Description", "W/O Action").collect()}
    assert distinct == {1, 2}


def test_lookup_join_with_hot_and_null_keys(spark):
    rng = random.Random(1)
    keys = ["hot"] * 700 + [None] * 500 + [f"k{rng.randint(0, 99)}" for _ in range(900)]
    left = spark.createDataFrame(list(enumerate(keys)), "id long, k string").repartition(6)
    right = spark.createDataFrame([("hot", 0)] + [(f"k{i}", i) for i in range(0, 100, 2)], "k string, v int")
    known = {r.k: r.v for r in right.collect()}
    for shuffle in (False, True):
        joined = lookup_join(left, right, ["k"], shuffle=shuffle)
        got = sorted(joined.select("id", "k", "v").collect())
        assert [tuple(r) for r in got] == [(i, k, known.get(k)) for i, k in enumerate(keys)]


def test_lookup_join_with_many_heavy_keys(spark):
    """Over a thousand heavy keys; rows with a NULL key are never shuffled."""
    left = spark.range(60_000).selectExpr(
        "id", "CASE WHEN id % 3 = 0 THEN NULL ELSE concat('k', id % 1500) END AS k"
    )
    right = spark.range(2_000).selectExpr("concat('k', id) AS k", "id AS v")
    joined = lookup_join(left, right, ["k"], shuffle=True)
    assert joined.where("k IS NOT NULL AND v <> id % 1500").isEmpty() and joined.count() == 60_000
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan
    assert "SortMergeJoin" in joined._jdf.queryExecution().executedPlan().toString()


def test_registry(spark, refs):
    keys = spark.createDataFrame(
        [(1, "21-26-00", "TSM"), (2, "21-26-00", "FIM"), (3, "99-99-00", "TSM"), (4, None, "TSM")],
        "id int, task_number string, manual_type string",
    )
    found = {r.id: r.ref_exists for r in registry.exists(keys, refs).collect()}
    assert found == {1: True, 2: True, 3: False, 4: False}
    typed = {r.id: r.ref_exists for r in registry.exists(keys, refs, typed=True).collect()}
    assert typed == {1: True, 2: False, 3: False, 4: False}
    got = {r.id: r.title for r in registry.get_reference(keys.drop("manual_type"), refs).collect()}
    assert got == {1: "Air AMM", 2: "Air AMM", 3: None, 4: None}
    assert [r.manual_type for r in registry.search_by_ata(refs, ["21-26"]).collect()] == ["AMM", "TSM", "TSM"]
    stats = {r.manual_type: (r.total_references, r.unique_atas) for r in registry.statistics(refs).collect()}
    assert stats == {"TSM": (2, 1), "AMM": (1, 1), "ALL": (3, 1)}


def test_registry_table(spark, refs):
    path = new_path(spark, "registry")
    assert tables.append_references(refs, path) == 3
    assert tables.append_references(refs.limit(1), path) == 1
    stored = tables.read_registry(spark, path)
    assert stored.count() == 4 and stored.where("is_active").count() == 4
    tables.clear_registry(spark, path)
    assert tables.read_registry(spark, path).count() == 0


def test_reports(orders, model):
    results = process_work_orders(orders, "wo_id", model).cache()
    summary = reports.summary_metrics(results).collect()[0]
    assert (summary.total_wos, summary.technical_defects) == (6, 5)
    counts = {r.Decision: r.n for r in reports.decision_breakdown(results).collect()}
    assert sum(counts.values()) == 6 and counts["NON_DEFECT"] == 1
    bins = {r.bin: r.n for r in reports.confidence_histogram(results, 10).collect()}
    assert sum(bins.values()) == 6 and max(bins) == 9
    assert reports.filter_results(results, defects=False).count() == 1
    assert reports.filter_results(results).count() == 6
    assert reports.review_rate(results).collect()[0].review_rate == counts.get("REVIEW", 0) / 6
    quality = reports.input_quality(orders).collect()[0]
    assert (quality.total_wos, quality.bad_code, quality.bad_dates, quality.no_description) == (6, 2, 0, 1)
    labels = orders.select("wo_id", F.lit("21-26").alias("label"))
    assert reports.accuracy(results, labels, "wo_id", "label").collect()[0].labelled == 6


def test_sources_and_sinks(spark, orders, model, tmp_path):
    csv = str(tmp_path / "orders")
    orders.withColumn("ATA", F.lit("0521")).write.csv(csv, header=True, escape='"')
    loaded = tables.load_work_orders(spark, csv, "csv")
    assert {r.ATA for r in loaded.collect()} == {"0521"}
    assert tables.preview(loaded).count() == 5
    with pytest.raises(ValueError):
        tables.load_work_orders(spark, tables.write_results(orders.drop("A/C"), str(tmp_path)))
    first = tables.write_results(orders, str(tmp_path))
    assert "WO_ATA_checked_" in first and first != tables.write_results(orders, str(tmp_path))

    path = str(tmp_path / "catalog")
    tables.write_catalog(model.catalog, path)
    assert sorted(tables.read_catalog(spark, path).collect()) == sorted(model.catalog.collect())
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.read_catalog(spark, str(tmp_path / "missing"))
    tables.write_model(model.vocabulary, model.vectors, str(tmp_path / "model"))
    vocabulary, vectors = tables.read_model(spark, str(tmp_path / "model"))
    assert vocabulary.count() == model.vocabulary.count() and vectors.count() == model.vectors.count()

    chunks = spark.range(95).select(F.lit("TSM").alias("manual_type"), F.col("id").cast("string").alias("chunk_id"))
    shards = str(tmp_path / "chunks")
    tables.write_chunks(chunks.coalesce(1), shards, shard_size=10)
    back = tables.read_chunks(spark, shards, ["TSM"])
    assert len(back.inputFiles()) == 10 and back.count() == 95
    assert tables.read_chunks(spark, shards, ["FIM"]).count() == 0


def test_checked_csv_keeps_zeros_and_rejects_bad_lines(spark, tmp_path):
    from pyspark.sql import types as T

    from hangarflow.sources import tables

    folder = tmp_path / "orders"
    folder.mkdir()
    lines = [
        "wo_id,ATA,text,issued",
        '1,05-10,"a text, with a comma",2024-01-02',
        '2,"",\\N,2024-01-03',
        "x3,21-00,id is no number,2024-01-04",
        "4,21-00,bad date,yesterday",
        "5,21-00,too,many,cells,2024-01-05",
        '6,00-01,"two\nlines",\\N',
    ]
    (folder / "part-0.csv").write_text("\n".join(lines) + "\n")
    schema = T.StructType(
        [
            T.StructField("wo_id", T.LongType()),
            T.StructField("ATA", T.StringType()),
            T.StructField("text", T.StringType()),
            T.StructField("issued", T.DateType()),
        ]
    )
    rows = tables.read_checked_csv(spark, str(folder), schema, null_value="\\N").collect()
    good = {r.wo_id: (r.ATA, r.text, str(r.issued)) for r in rows if r.rejected is None}
    assert good == {1: ("05-10", "a text, with a comma", "2024-01-02"), 2: ("", None, "2024-01-03"), 6: ("00-01", "two\nlines", "None")}
    bad = sorted(r.rejected for r in rows if r.rejected is not None)
    assert bad == sorted([lines[3], lines[4], lines[5]])
    assert all(r.file.endswith("part-0.csv") for r in rows)
    assert all(r.wo_id is None and r.ATA is None for r in rows if r.rejected is not None)


def test_chunk_shards_have_exact_sizes_and_one_file_each(spark, tmp_path):
    import glob
    import os

    from hangarflow.sources import tables

    rows = [(f"c{i:05d}", ["TSM", "FIM", "AMM"][i % 7 % 3], f"{i % 50:02d}-00") for i in range(1_000)]
    chunks = spark.createDataFrame(rows, "chunk_id string, manual_type string, ata04 string").repartition(16)
    path = str(tmp_path / "shards")
    tables.write_chunk_shards(chunks, path, shard_size=37)
    got = tables.read_chunks(spark, path).select("chunk_id", "manual_type", "position", "shard").collect()
    for manual_type in ("TSM", "FIM", "AMM"):
        mine = sorted((r.position, r.chunk_id, r.shard) for r in got if r.manual_type == manual_type)
        ids = sorted(c for c, t, _ in rows if t == manual_type)
        assert [c for _, c, _ in mine] == ids
        assert [p for p, _, _ in mine] == list(range(len(ids)))
        assert all(s == p // 37 for p, _, s in mine)
        folders = glob.glob(os.path.join(path, f"manual_type={manual_type}", "shard=*"))
        assert len(folders) == -(-len(ids) // 37)
        assert all(len(glob.glob(os.path.join(f, "*.parquet"))) == 1 for f in folders)
