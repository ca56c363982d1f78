"""Golden cases and properties of the column functions."""

import random

import pytest
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import functions as F

from hangarflow.functions import citations, codes, decisions, defects, text, vectors
from hangarflow.functions.codes import zero_fill


def apply(spark, values, fn, schema="x string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {schema}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("x"))).collect()]


def test_normalize_ata(spark):
    given = ["21-26", "2126", "21-26-00", "ABC", "", None, " 21 26 ", "521"]
    want = ["21-26", "21-26", "21-26", None, None, None, "21-26", None]
    assert apply(spark, given, codes.normalize_ata) == want
    again = apply(spark, want, codes.normalize_ata)
    assert again == want


def test_normalize_ata_echo(spark):
    given = ["2126", " 52 ", "", None, "x"]
    assert apply(spark, given, codes.normalize_ata_echo) == ["21-26", "52", "", "", "x"]


def test_format_checks(spark):
    given = ["2126", "21-26", "21-26-00", "2126-00", "212600", "2-126", "", None]
    loose = [True, True, True, True, False, False, False, False]
    strict = [False, True, False, False, False, False, False, False]
    assert apply(spark, given, codes.validate_ata_format) == loose
    assert apply(spark, given, codes.validate_ata_strict) == strict


def test_normalize_task_number(spark):
    given = ["21-26-00", "212600", "21-26-00-860-801", "2126", "21-2", "", "TSM 212600860", "1-2-3-4-5-6"]
    want = [
        "21-26-00",
        "21-26-00",
        "21-26-00-860-801",
        "21-26-00",
        "21-2-00",
        "00-00-00",
        "21-26-00-860",
        "1-2-3-4-5",
    ]
    assert apply(spark, given, codes.normalize_task_number) == want


def test_file_names(spark):
    given = ["tsm/21-26-00.sgm", "m2023/a.sgm", "x_2126_.sgm", "21_26.sgm", "none.sgm"]
    assert apply(spark, given, codes.ata_from_filename_loose) == ["21-26", "20-23", "21-26", "21-26", None]
    assert apply(spark, given, codes.ata_from_filename_strict) == ["21-26", "20-23", "21-26", "21-26", None]
    assert apply(spark, ["7", "123"], lambda c: zero_fill(c, 2)) == ["07", "123"]


@pytest.mark.parametrize(
    "description, action, is_defect, part",
    [
        ("Cabin cleaning required", "Performed general cleaning", False, "clean"),
        ("Scheduled inspection due", "Completed scheduled maintenance check", False, "scheduled"),
        ("Warning light illuminated", "Inspected system, NFF", True, "warning"),
        ("Cleaning system failure", "Replaced faulty component", True, "failure"),
        ("ECAM HYD SYS 1 LO LEVEL", "Replenished hydraulic fluid per TSM 29-11-00", True, "ecam"),
        ("Oil leak observed from engine", "Tightened fitting, leak stopped", True, "leak"),
        ("Routine lubrication required", "Applied lubrication to hinges", False, "lubrication"),
        ("Unusual noise from landing gear", "Inspected landing gear system", True, "unusual noise"),
        ("", "", True, "Default"),
        (None, None, True, "Default"),
        ("Software update required", "Software load completed per AMM", False, "software"),
        ("cleané required", "", True, "Default"),
        ("seat cover", "", True, "Default"),
    ],
)
def test_defect_filter(spark, description, action, is_defect, part):
    if description == "seat cover":  # any white space separates words
        is_defect, part = False, "seat cover"
    df = spark.createDataFrame([(description, action)], "d string, a string")
    row = defects.with_verdict(df, "d", "a").collect()[0]
    assert row.is_defect is is_defect
    assert part in row.reason


def test_match_lists(spark):
    given = ["Cleaned seat cover, NFF", "leak, Leakage and u/s fault"]
    assert apply(spark, given, defects.non_defect_matches)[0] == ["cleaned", "seat cover", "nff"]
    assert apply(spark, given, defects.defect_matches)[1] == ["leak", "leakage", "u/s", "fault"]


CITED = [
    ("Performed troubleshooting per TSM 21-26-00", ["TSM 21-26-00"]),
    ("Ref TSM21-26-00", ["TSM 21-26-00"]),
    ("Per TSM212600", ["TSM 21-26-00"]),
    ("Performed FIM 32-47-00-860-801", ["FIM 32-47-00-860-801", "TSM 32-47-00-860-801"]),
    ("Replaced component per AMM 24-11-00", ["AMM 24-11-00", "TSM 24-11-00"]),
    ("Performed task 21-26-00", ["TSM 21-26-00"]),
    ("Per TSM 21-26-00 and FIM 32-47-00", ["TSM 21-26-00", "FIM 32-47-00", "TSM 32-47-00"]),
    ("Performed general inspection", []),
    ("Completed task: 21-26-00", ["TSM 21-26-00"]),
    ("TSM2126", []),
    ("TSM21-26", []),
    ("xTSM 21-26-00", ["TSM 21-26-00"]),
    ("date 21-03-14 fixed", ["TSM 21-03-14"]),
    ("ref amm 241100", ["AMM 24-11-00"]),
    ("see fim324700860801", ["FIM 32-47-00-860-801"]),
    ("", []),
    (None, []),
]


def test_citations(spark):
    texts = [t for t, _ in CITED]
    found = apply(spark, texts, citations.extract_citations)
    listed = [[f"{c.manual_type} {c.task_number}" for c in row or []] for row in found]
    assert listed == [want for _, want in CITED]
    sub = found[3][0]
    assert (sub.chapter, sub.section, sub.subject, sub.subsection1, sub.subsection2) == ("32", "47", "00", "860", "801")
    assert sub.ata04 == "32-47" and sub.raw_match == "FIM 32-47-00-860-801"


def test_first_citation_is_the_head_of_the_list(spark):
    rng = random.Random(7)
    words = ["TSM", "fim", "AMM ", "task:", "ref", "21-26-00", "212600", "-860", "-801", " ", "x", "32-47-11", "\n", "é"]
    texts = ["".join(rng.choice(words) for _ in range(rng.randint(1, 9))) for _ in range(400)]
    lists = apply(spark, texts, citations.extract_citations)
    heads = apply(spark, texts, citations.first_citation)
    assert heads == [row[0] if row else None for row in lists]
    for row in lists:
        keys = [(c.manual_type, c.task_number) for c in row]
        assert len(keys) == len(set(keys))
    assert sum(map(bool, lists)) > 50


DECIDED = [
    ("21-26", "21-26", True, "21-26", 0.85, "CONFIRM", "21-26", 0.97),
    ("21-26", "21-27", True, "21-27", 0.80, "CORRECT", "21-27", 0.95),
    ("21-26", None, False, "21-26", 0.75, "CONFIRM", "21-26", 0.83),
    ("21-26", "21-26", True, None, None, "CONFIRM", "21-26", 0.92),
    ("21-26", "21-27", True, None, 0.20, "CORRECT", "21-27", 0.90),
    ("21-26", None, False, "21-27", 0.85, "CORRECT", "21-27", 0.88),
    ("21-26", None, False, "21-27", 0.30, "REVIEW", "21-26", 0.73),
    ("21-26", "21-26", True, "21-27", 0.70, "CONFIRM", "21-26", 0.88),
    ("21-27", "21-26", True, "21-27", 0.90, "CONFIRM", "21-27", 0.85),
    ("21-26", "21-27", True, "21-28", 0.80, "REVIEW", "21-26", 0.65),
    ("21-26", None, False, None, None, "REVIEW", "21-26", 0.65),
    (None, None, False, None, None, "REVIEW", None, 0.50),
    ("21-27", "21-26", True, "21-27", 0.50, "REVIEW", "21-27", 0.70),
    ("21-26", None, False, "21-27", 0.25, "REVIEW", "21-26", 0.50),
]
_EVIDENCE = "e0 string, e1 string, valid boolean, e2 string, score double"


def _decide(spark, rows, threshold=0.75):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {_EVIDENCE}")
    outcome = decisions.make_decision(
        F.col("e0"), F.col("e1"), F.col("valid"), F.col("e2"), F.col("score"), threshold
    )
    return [r.o for r in df.select("i", outcome.alias("o")).orderBy("i").collect()]


def test_decisions(spark):
    got = _decide(spark, [row[:5] for row in DECIDED])
    assert [(o.decision, o.ata04_final, o.confidence) for o in got] == [row[5:] for row in DECIDED]


def _band(score):
    return next((c for low, c in decisions.SCORE_BANDS if (score or 0) >= low), decisions.LOWEST_BAND)


def _by_table(e0, e1, valid, e2, score, threshold):
    """The decision table restated on plain values: which sources agree, then the bands."""
    e1 = e1 if valid else None
    band, points = _band(score), score or 0
    weak = e2 is None or 0 < points < 0.3
    if e1 and e1 == e2:
        return ("CONFIRM", e0, 0.97) if e0 == e1 else ("CORRECT", e1, 0.95)
    if e1 is None:
        if e2 is None:
            return ("REVIEW", e0, 0.65 if e0 else 0.50)
        if e0 == e2:
            return ("CONFIRM", e0, band)
        if points < 0.3:
            return ("REVIEW", e0, 0.50)
        return ("CORRECT", e2, band) if band >= threshold else ("REVIEW", e0, band)
    if weak:
        return ("CONFIRM", e0, 0.92) if e0 == e1 else ("CORRECT", e1, 0.90)
    if e0 == e1:
        return ("CONFIRM", e0, 0.88)
    if e0 == e2:
        return ("CONFIRM", e0, 0.85) if band >= 0.85 else ("REVIEW", e0, 0.70)
    return ("REVIEW", e0, 0.65)


@pytest.mark.parametrize("threshold", [0.5, 0.75, 0.85])
def test_decision_grid(spark, threshold):
    code = [None, "21-26", "22-10", "23-11"]
    grid = [
        (e0, e1, valid, e2, score)
        for e0 in code
        for e1 in code
        for valid in (True, False, None)
        for e2 in code
        for score in (None, 0.0, 0.1, 0.2, 0.29, 0.3, 0.4, 0.6, 0.8, 1.0)
    ]
    got = _decide(spark, grid, threshold)
    assert [(o.decision, o.ata04_final, o.confidence) for o in got] == [
        _by_table(*row, threshold) for row in grid
    ]
    assert all(o.reason for o in got)


def test_reasons(spark):
    got = _decide(spark, [(None, "21-27", True, None, None), ("21-26", None, None, "21-27", 0.62)])
    assert got[0].reason == "Valid citation 21-27 differs from entered None"
    assert got[1].reason == "Catalog suggests 21-27 (score: 0.62)"


def test_bands_and_validity(spark):
    assert apply(spark, [0.85, 0.55, 0.25, 0.0, None], decisions.e2_confidence, "x double") == [0.88, 0.78, 0.73, 0.68, 0.68]
    df = spark.createDataFrame(
        [("CONFIRM", 0.95), ("INVALID", 0.9), ("REVIEW", 1.5), ("REVIEW", None), (None, 0.5)],
        "d string, c double",
    )
    ok = [r[0] for r in df.select(decisions.validate_decision(F.col("d"), F.col("c"))).collect()]
    assert ok == [True, False, False, False, False]


def test_white_space_and_stop_words(spark):
    assert set(text.WHITE_SPACE) == {chr(c) for c in range(0x110000) if chr(c).isspace()}
    assert apply(spark, ["  a b \n", "   "], text.strip) == ["a b", ""]
    spark_list = StopWordsRemover.loadDefaultStopWords("english")
    assert sorted(text.ENGLISH_STOP_WORDS) == sorted(
        {w for w in spark_list if len(w) > 1 and w.isalpha()}
    )


def test_ngrams(spark):
    given = ["Oil-leak of engine", "a", "x1 Éclair"]
    grams = apply(spark, given, lambda c: text.ngrams(text.tokens(c)))
    assert sorted(grams[0]) == sorted(["oil", "leak", "engine", "oil leak", "leak engine", "oil leak engine"])
    assert grams[1] == []
    assert sorted(grams[2]) == ["x1", "x1 éclair", "éclair"]


def test_vector_functions(spark):
    df = spark.createDataFrame([([1.0, 2.0], [4.0, 6.0])], "a array<float>, b array<float>")
    distance = vectors.squared_l2(F.col("a"), F.col("b"))
    assert df.select(distance, vectors.distance_to_score(distance)).collect()[0][:] == (25.0, 1 / 26)


@pytest.mark.parametrize(
    ("text", "tasks"),
    [
        ("Per TSM 21-26-00", ["TSM 21-26-00"]),
        ("see FIM 32-47-00-860-801", ["FIM 32-47-00-860-801"]),
        ("AMM 24-11-00 done", ["AMM 24-11-00"]),
        ("task 21-26-00", ["TSM 21-26-00"]),
        ("TSM 21-26-00 and FIM 32-47-00", ["TSM 21-26-00", "FIM 32-47-00"]),
        ("TSM 21-26-00, AMM 21-26-00 and 21-26-00", ["TSM 21-26-00", "AMM 21-26-00"]),
        ("ref: AMM 241100", ["AMM 24-11-00"]),
        ("nothing", []),
    ],
)
def test_one_citation_for_each_mention(spark, text, tasks):
    df = spark.createDataFrame([(text,)], "t string")
    found = df.select(citations.extract_citations(F.col("t"), dedup_by_span=True).alias("c")).first().c
    assert [f"{c.manual_type} {c.task_number}" for c in found] == tasks


def test_ngrams_join_each_pair_of_words_once(spark):
    from hangarflow.functions.text import ngrams

    rows = [([], []), (["a"], []), (["a"], ["b", "c"]), (["a", "b"], ["c"]), (["a", "b", "c", "d"], [])]
    df = spark.createDataFrame(rows, "own array<string>, following array<string>")
    found = df.select("own", "following", ngrams(F.col("own"), F.col("following")).alias("grams"))
    for r in found.collect():
        ext = r.own + r.following
        want = [" ".join(ext[i : i + n]) for n in (1, 2, 3) for i in range(len(r.own)) if i + n <= len(ext)]
        assert sorted(r.grams) == sorted(want)
    # Trigrams grow from the bigrams: one pass for each, no pair of words joined a second time.
    assert found._jdf.queryExecution().analyzed().toString().count("zip_with") == 2
