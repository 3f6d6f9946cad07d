"""Tables: chunks, headers, continuation, cells from places; inverted lists."""

import numpy as np
from pyspark.sql import functions as F

from quillspark.operators import ann, tables, vectors


def test_chunks_never_cut_a_row(spark):
    rows = [(1, k, f"row {k:03d}") for k in range(12)] + [(2, 0, "only")]
    df = spark.createDataFrame(rows, "t int, k int, x string")
    got = sorted((r.t, r.chunk_no, r.first_row, r.n_rows, r.body.split("\n")[0]) for r in tables.chunked(df, "t", "k", "x", 5).collect())
    assert got == [(1, 1, 1, 5, "row 000"), (1, 2, 6, 5, "row 000"), (1, 3, 11, 1, "row 000"), (2, 1, 1, 1, "only")]
    small = tables.chunked(df.where("t = 1"), "t", "k", "x", 50, 16, False).collect()
    assert sum(r.n_rows for r in small) == 12 and all(len(r.body) <= 16 for r in small)


def test_markdown_and_headers(spark):
    df = spark.createDataFrame([([["name", "a|b"], ["x", "1.5"], ["y", None]],), ([["1", "2"], ["3", "4"]],)], "r array<array<string>>")
    out = df.select(tables.markdown(F.col("r")).alias("m"), tables.has_header(F.col("r")).alias("h")).collect()
    assert out[0].m == "| name | a\\|b |\n| --- | --- |\n| x | 1.5 |\n| y |  |" and [r.h for r in out] == [True, False]


def test_continued_tables(spark):
    head = ["n", "v"]
    rows = [("d", 1, False, True, [head, ["a", "1"]]), ("d", 2, True, True, [head, ["b", "2"]]), ("d", 3, True, False, [["c", "3"]]), ("d", 5, True, False, [head, ["z", "9"]]), ("d", 6, True, False, [["x", "y", "z"]])]
    df = spark.createDataFrame(rows, "doc string, page int, at_top boolean, at_bottom boolean, rows array<array<string>>")
    got = sorted((r.first_page, r.last_page, len(r.rows)) for r in tables.merged_over_pages(df).collect())
    assert got == [(1, 3, 4), (5, 5, 2), (6, 6, 1)]


def test_cells_from_places(spark):
    words = []
    for k, line in enumerate([("Name", "Score"), ("big model", "1.5"), ("small", "2.5")]):
        for x, cell in zip((10.0, 100.0), line):
            for i, w in enumerate(cell.split()):
                words.append((1, x + 30 * i, x + 30 * i + 25, 20.0 * k + i, 20.0 * k + 10, w))
    df = spark.createDataFrame(words, "page int, x0 double, x1 double, y0 double, y1 double, text string")
    found = tables.cells(tables.visual_rows(df, ["page"]), ["page"])
    bands = tables.columns(found, ["page"])
    assert bands.count() == 2
    got = {(r.row, r.column): r.text for r in tables.grid(found, bands, ["page"]).collect()}
    assert got == {(1, 1): "Name", (1, 2): "Score", (2, 1): "big model", (2, 2): "1.5", (3, 1): "small", (3, 2): "2.5"}


def test_inverted_lists(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 16))
    v = centres[rng.integers(0, 8, 600)] + 0.3 * rng.normal(size=(600, 16))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id bigint, embedding array<double>")
    c = ann.fit(df, 8)
    indexed = ann.index(df, c)
    assert indexed.count() == 600
    q = df.where("vec_id % 20 = 0")
    exact = vectors.nearest_many(df, q, 5)
    assert ann.recall(ann.search(indexed, q, c, 5, 3), exact).first().recall >= 0.9
    assert abs(ann.recall(ann.search(indexed, q, c, 5, 8), exact).first().recall - 1.0) < 1e-9
