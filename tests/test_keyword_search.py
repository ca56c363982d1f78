"""Keywords of a table against every name, keyword and warning, by brute force."""

from hangarflow.operators import catalog as ops


def test_keywords_of_any_length(spark):
    entries = [
        ("21-00", "Air Conditioning", ["pack", "Valve"], ["Hot air"]),
        ("29-10", "Hydraulic", ["pump", None, ""], []),
        ("32-00", "", ["Gear"], None),
        ("33-00", "Lights", [], ["do not look into the light"]),
    ]
    catalog = spark.createDataFrame(entries, "ata04 string, system_name string, keywords array<string>, warnings array<string>")
    words = ["a", "Ai", "air", "AIR", "valve", "lve", "x", "light", "o", "gear pack", "", "hydraulics", "ump", "air"]
    keywords = spark.createDataFrame([(w,) for w in words], "keyword string")
    got = {tuple(r) for r in ops.search_keywords(catalog, keywords).collect()}
    want = set()
    for code, name, kws, warns in entries:
        fields = [("system_name", name)] + [("keywords", v) for v in kws or []] + [("warnings", v) for v in warns or []]
        for w in {w.lower() for w in words if w}:
            for field, value in fields:
                if value and w in value.lower():
                    want.add((w, code, field))
    assert got == want
