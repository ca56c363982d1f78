"""Small tables with every awkward case, and empty ones of the same schema."""

import random

import pyarrow as pa

DOCUMENTS = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("text", pa.string()),
        ("lang", pa.string()),
        ("source", pa.string()),
        ("n_chars", pa.int64()),
        # Names that the operators use themselves.
        *[(name, pa.string()) for name in ("row", "size", "kept", "digest", "ids", "block", "content", "id", "words")],
    ]
)
LABELS = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())])
PAGES = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string()), ("rule", pa.string())])
EMBEDDINGS = pa.schema(
    [("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("label", pa.int32()), ("vector", pa.string())]
)
EN = "the of and to in is that it was for on are with as his they at be this from have or by one had".split()
DE = "der die und das nicht für über schön größe straße mädchen können müssen früh ähnlich wörter grün weiß".split()


def document_rows():
    draw = random.Random(3)

    def prose(words, n):
        return " ".join(draw.choice(words) + str(draw.randrange(9)) * draw.randrange(2) for _ in range(n)) + ". End"

    rows = []
    for at in range(120):
        lang = "en" if at % 3 else "de"
        rows.append([at, prose(EN if lang == "en" else DE, 5 + at), lang, f"src{at % 7}"])
    for at in range(120, 150):  # exact copies, one large group
        rows.append([at, rows[7][1], "en", "src0"])
    base = rows[61][1].split()
    for at in range(150, 190):  # near copies: chains of single edits
        base[draw.randrange(len(base))] = f"Edit{at}"
        rows.append([at, " ".join(base), "en", None if at % 9 == 0 else "src1"])
    rows += [
        [200, None, "en", "src2"],
        [201, "", "en", "src2"],
        [202, " \t\n ", None, None],
        [203, "12 34 -- !!", "en", "src3"],
        [204, "one two", "en", "src3"],
        [205, "one  TWO", "en", "src3"],
        [206, prose(EN, 30_000), "en", "src4"],
        [207, "漢字 kana\u3000かな İSTANBUL naïve 😀 <|endoftext|>\u00a0 x\x1cy", None, "src5"],
        [208, "one two", None, "é"],
        [209, "nul\x00byte and \u0301combining", "en", "src5"],
        [5, rows[5][1], "en", "src5"],  # a repeated row
        [None, "no identifier here at all, none", "en", "src6"],
        [-4, rows[61][1], "en", "src6"],
    ]
    return rows


def page_urls():
    return [
        None,
        "",
        "no scheme",
        "http://",
        "https://com/",
        "http://example.com",
        "http://example.com/en/x?y#z",
        "http://www.example.com/en/",
        "http://WWW.Example.COM/EN/",
        "http://a.www.example.com/en/1",
        "ftp://badexample.com/en/",
        "http://x.net/es/1",
        "http://x.net/fr/",
        "http://x.net/fr",
        "http://x.net?/fr/",
        "http://x.net#/es/://com/",
        "http://example.com./en/",
        "http://" + "a." * 3000 + "com/" + "p/" * 3000,
        "http://x.org/en/\n://y",
        "http://x.net/es/1",
    ]
