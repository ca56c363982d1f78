"""Folders with the awkward tables, and with empty ones."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from odd_tables import DOCUMENTS, EMBEDDINGS, LABELS, PAGES, document_rows, page_urls


def _write(folder, name, schema, columns):
    pq.write_table(pa.table(columns, schema=schema), f"{folder}/{name}.parquet")


@pytest.fixture(scope="session")
def odd_dir(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    rows = document_rows()
    columns = [list(c) for c in zip(*rows, strict=True)]
    columns += [[len(t or "") for t in columns[1]]] + [["x"] * len(rows)] * 9
    _write(folder, "documents", DOCUMENTS, columns)
    urls = page_urls()
    _write(folder, "pages", PAGES, [list(range(len(urls))), urls, urls, urls])
    draw = random.Random(1)
    vectors = [[draw.gauss(0, 1) for _ in range(8)] for _ in range(260)]
    vectors += [vectors[3]] * 60 + [None, [0.0] * 8, [float("nan")] * 8, [float("inf")] + [1.0] * 7, [None] + [1.0] * 7, [1.0] * 3, []]
    ids = [*range(len(vectors))]
    ids[-1] = 280
    _write(folder, "embeddings", EMBEDDINGS, [ids, vectors, ids, [str(i) for i in ids]])
    labels = [(r[0], 1, int(r[0] % 6 == 0)) for r in rows if r[0] is not None] + [(7, None, None), (None, 1, 1), (9, 0, 1)]
    _write(folder, "labels", LABELS, [list(c) for c in zip(*labels, strict=True)])
    return folder


@pytest.fixture(scope="session")
def empty_dir(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    for name, schema in (("documents", DOCUMENTS), ("pages", PAGES), ("embeddings", EMBEDDINGS), ("labels", LABELS)):
        _write(folder, name, schema, [[] for _ in schema])
    return folder
