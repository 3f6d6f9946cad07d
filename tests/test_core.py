"""Core functions, operators, sources and streams on small inputs."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as t
from quillspark.operators import evaluate, graph, lexical, tree, vectors, verify
from quillspark.sources import bibliography, markup


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column).first()[0]


@pytest.mark.parametrize(
    "doi,arxiv,title,key",
    [
        ("https://doi.org/10.1/AB", None, None, "doi:10.1/ab"), (None, "arXiv:2401.12345v2", None, "arxiv:2401.12345"), (" ", "", "Näher am Ziel!", "title:"), (None, None, "!?", None), (None, None, None, None),
    ],
)
def test_identity(spark, doi, arxiv, title, key):
    got = one(spark, t.norm_key("doi", "arxiv", "title"), doi=doi, arxiv=arxiv, title=title)
    assert got == key if key != "title:" else got.startswith(key) and len(got) == 22


def test_terms(spark):
    assert one(spark, t.rank_terms("s"), s="Near-field MIMO 3.5 信道估计") == ["near-field", "mimo", "3.5", "信道", "道估", "估计"]
    assert one(spark, t.section_terms("s"), s="The Model of x in 2 UAVs") == ["model", "uavs"]
    assert one(spark, t.profile_terms("s"), s="Deep learning for channel estimation") == ["deep", "learning", "channel", "estimation", "deep learning", "channel estimation"]
    assert one(spark, t.query_terms("s"), s=None) == []
    assert one(spark, t.sentences("s"), s="A first sentence. Another one here! Short.") == ["A first sentence.", "Another one here!"]
    assert one(spark, t.numbers("s"), s="82% of R2 at 4.50 and 82 [3]") == ["82%", "4.5", "82"]


def papers(spark):
    return spark.createDataFrame([(1, "channel estimation for massive MIMO", None), (2, "survey of beamforming", None), (3, "machine translation", ""), (3, "machine translation", "")], "id long, title string, body string")


def test_bm25(spark):
    for query, best in (("channel estimation massive MIMO", 1), ("beamforming", 2)):
        assert lexical.bm25(papers(spark), query, {"title": 3.0, "body": 1.0}).orderBy(F.desc("score")).first().id == best
    assert lexical.bm25(papers(spark), "?", {"title": 1.0}).count() == 0
    assert lexical.bm25(papers(spark).where("false"), "beamforming", {"title": 1.0}).count() == 0


def test_fusion(spark):
    r = spark.createDataFrame([(1, 1, 1.0), (2, 2, 1.0), (2, 1, 1.0), (3, 2, 1.0)], "id long, rank int, weight double")
    got = {x.id: x.score for x in lexical.fuse(r).collect()}
    assert got[2] == pytest.approx(1 / 61 + 1 / 62) and got[1] == pytest.approx(1 / 61) and got[3] == pytest.approx(1 / 62)


def test_batch_idf(spark):
    words = spark.createDataFrame([("learning",), ("beamforming",)], "term string")
    batch = spark.createDataFrame([("learning",)] * 28 + [("beamforming",)] * 2, "title string")
    got = {x.term: x.idf for x in lexical.batch_idf(batch, F.col("title"), words).collect()}
    assert got["learning"] == pytest.approx(0.0194, abs=1e-3) and got["beamforming"] == pytest.approx(0.680, abs=1e-3)
    assert {x.idf for x in lexical.batch_idf(batch.limit(2), F.col("title"), words).collect()} == {1.0}


EDGES = [("x", "a"), ("x", "c"), ("y", "a"), ("y", "c"), ("z", "a"), ("z", "d"), ("a", "r1"), ("a", "r2"), ("a", "r3"), ("e", "r1"), ("e", "r2"), ("f", "r1"), ("b", "r1"), ("b", "r9"), ("b", "b"), ("x", "a"), (None, "a")]


def test_graph(spark):
    e = graph.edges(spark.createDataFrame(EDGES, "src_key string, dst_key string"))
    assert e.count() == 14
    seeds = lambda *k: spark.createDataFrame([(x,) for x in k], "norm_key string")
    got = {r.norm_key: r.score for r in graph.related(e, seeds("a")).collect()}
    assert got == pytest.approx({"c": 1 / 3, "e": 1 / 3, "d": 1 / 6, "f": 1 / 6, "b": 1 / 8})
    got = {r.norm_key: r.score for r in graph.related(e, seeds("a", "b")).collect()}
    assert got == pytest.approx({"e": 0.25, "f": 5 / 24, "c": 1 / 6, "d": 1 / 12})
    gap = {r.norm_key: r.cited_by for r in graph.gaps(e, seeds("a", "b").withColumn("id", F.lit(1))).collect()}
    assert gap == {"r1": 2, "r2": 1, "r3": 1, "r9": 1}
    hops = {r.norm_key: r.hop for r in graph.neighbours(e, seeds("b"), 2).collect()}
    assert hops == {"b": 0, "r1": 1, "r9": 1, "a": 2, "e": 2, "f": 2}


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [0.8, 0.6], 1), (3, [0.0, 1.0], 2), (4, [float("nan"), 1.0], 2), (5, [1.0], 2), (6, [1.0, 0.0], 2)], "vec_id long, embedding array<float>, label int")
    got = [(r.id, round(r.score, 3)) for r in vectors.nearest(v, [1.0, 0.0], 3).collect()]
    assert got == [(1, 1.0), (6, 1.0), (2, 0.8)]
    assert [r.id for r in vectors.nearest(v, [1.0, 0.0], 3, F.col("label") == 2).collect()] == [6, 3]
    ok = v.where("vec_id in (1, 2, 3)")
    assert {(r.query_id, r.id) for r in vectors.nearest_many(ok, ok, 1, block=2).collect()} == {(1, 2), (2, 1), (3, 2)}


def test_tree(spark):
    row = spark.createDataFrame([("P3/S1.2.10",)], "node string")
    assert row.select(tree.parent_of("node"), tree.ancestors("node")).first()[:] == ("P3/S1.2", ["P3/S1", "P3/S1.2", "P3/S1.2.10"])
    paths = [["Intro"], ["Related", "Static"], ["Related", "Probing"], ["Approach", "Data"], ["Approach", "Data"], ["Approach"]]
    df = spark.createDataFrame([(1, k, p) for k, p in enumerate(paths)], "paper_id long, seq long, path array<string>")
    assert [r.number for r in tree.number_paths(df).orderBy("seq").collect()] == ["1", "2.1", "2.2", "3.1", "3.2", "4"]
    body = spark.createDataFrame([(1, "One sentence here. " * 60), (2, ""), (3, None)], "id long, body string")
    parts = tree.passages(body).collect()
    assert {p.id for p in parts} == {1} and all(len(p.passage) < 460 for p in parts)


@pytest.mark.parametrize(
    "quote,source,found",
    [
        ("Exact  Words here", "some exact words HERE now", True), ("", "x", False), (None, "x", False), ("short", "another", False), ("a" * 20 + "b" * 20, "a" * 20 + "c" * 20, False), ("the quick brown fox jumps over the lazy dog and then sleeps a lot", "the quick brown fox jumps over the lazy dog and then sleeps a bit", True),
    ],
)
def test_quotes(spark, quote, source, found):
    assert one(spark, verify.quote_found("q", "s"), q=quote, s=source) is found


def test_sign_flip(spark):
    run = lambda rows: evaluate.sign_flip(spark.createDataFrame(rows, "a double, b double"), "a", "b").first()
    assert run([(1.0, 1.0)] * 5).p_value == 1.0
    assert run([(0.0, 1.0)] + [(1.0, 1.0)] * 31).p_value > 0.5
    better = run([(0.0, 1.0)] * 20 + [(1.0, 1.0)] * 12)
    assert better.p_value < 0.01 and better.n_changed == 20 and better.mean_after == 1.0


def test_recall_and_classes(spark):
    hits = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 12, 3)], "query_id long, id long, rank int")
    gold = spark.createDataFrame([(1, 11), (2, 12), (2, 13), (2, 13)], "query_id long, id long")
    assert {r.k: r.recall for r in evaluate.recall_at(hits, gold, (1, 2, 5)).collect()} == {1: 0.0, 2: 0.5, 5: 0.75}
    m = evaluate.confusion(spark.createDataFrame([("x", "x"), ("x", "y"), ("z", "x")], "g string, p string"), "g", "p")
    s = {r.label: (r.precision, r.recall, r.f1) for r in evaluate.class_scores(m).collect()}
    assert s["x"] == (0.5, 0.5, 0.5) and s["z"] == (None, 0.0, 0.0)


BIB = """@string{acm = "ACM Journal"}
@article{k1, title = {A {\\"U}ber {Title}}, author = {Doe, Jane and M\\'{a}rquez, Li and others}, journal = acm # " of X", year = 2020, doi = {https://doi.org/10.1/X}}
@article{broken, title = {never closed
@misc{k2, title = "Second", eprint = {2401.00001}, archivePrefix = {arXiv}}
"""


def test_bibliographies(spark):
    rows = bibliography.read_bibtex(BIB)
    assert [r["title"] for r in rows] == ["A Über Title", None, "Second"]
    assert rows[0]["authors"] == ["Jane Doe", "Li Márquez"] and rows[0]["venue"] == "ACM Journal of X" and rows[0]["doi"] == "10.1/X" and rows[0]["year"] == 2020
    assert "not closed" in rows[1]["error"] and rows[2]["arxiv_id"] == "2401.00001"
    ris = bibliography.read_ris("TY  - JOUR\nTI  - One\n and more\nAU  - Doe, J.\nPY  - 1999/01\nER  - \nTY  - JOUR\nTI  - Two\n")
    assert [r["title"] for r in ris] == ["One and more", "Two"] and ris[0]["year"] == 1999 and ris[1]["error"] == "no end of record"
    csv = bibliography.read_csv('"Title","Author","Publication Year"\n"T","A, B; C, D","2001"\n')
    assert csv[0]["authors"] == ["B A", "D C"] and csv[0]["year"] == 2001
    atom = bibliography.read_atom('<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://x/abs/2401.00001v2</id><title>T\n T</title><published>2024-01-01</published></entry><entry><id>http://x/api/errors</id><title>Error</title></entry></feed>')
    assert [a["title"] for a in atom] == ["T T"]
    df = spark.createDataFrame([("a", BIB), ("b", "nothing"), ("c", None), ("d", "")], "path string, text string")
    assert [(r.source_id, r.entry_no) for r in bibliography.parse_bibliographies(df).orderBy("entry_no").collect()] == [("a", 1), ("a", 2), ("a", 3)]


def test_documents(spark, tmp_path):
    html = "<html><body><nav>menu</nav><h1>Top</h1><p>One <b>two</b></p><h2>Sub</h2><ul><li>x</li></ul><table><tr><td>1</td><td>2</td></tr></table><script>no()</script></body></html>"
    md = "---\ntitle: x\n---\n# Top\ntext\nmore\n\n```\ncode\n```\n- a\n- b\n\n| h | i |\n|---|---|\n| 1 | 2 |\n"
    df = spark.createDataFrame([("h", html), ("m", md), ("t", "plain\n\ntwo"), ("n", None)], "path string, text string")
    rows = {}
    for r in markup.parse_documents(df).orderBy("block_no").collect():
        rows.setdefault(r.source_id, []).append((r.kind, r.section_path, r.text))
    assert rows["h"] == [("heading", "Top", "Top"), ("paragraph", "Top", "One two"), ("heading", "Top > Sub", "Sub"), ("list", "Top > Sub", "x"), ("table", "Top > Sub", "1 | 2")]
    assert [k for k, _, _ in rows["m"]] == ["heading", "paragraph", "code", "list", "list", "table", "table"]
    assert [x for _, _, x in rows["t"]] == ["plain", "two"]
    (tmp_path / "a.txt").write_bytes("中文".encode("gbk"))
    assert markup.read_files(spark, str(tmp_path)).first().text == "中文"


def test_streams(spark, sf, tmp_path):
    from quillspark.streaming import usage

    events = spark.read.parquet(f"{sf}/events.parquet")
    folder = str(tmp_path / "in")
    events.repartition(3).write.parquet(folder)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    q = usage.windowed_usage(stream, "1 day", "400 days").writeStream.outputMode("complete").format("memory").queryName("daily").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination(90)
    batch = usage.windowed_usage(events, "1 day")
    assert spark.table("daily").select("begin", "event_type", "n").exceptAll(batch.select("begin", "event_type", "n")).count() == 0
    target = str(tmp_path / "out")
    q = stream.select("user_id", "event_id").writeStream.foreachBatch(usage.upsert_by_key(target, "user_id")).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination(90)
    last = usage.current(spark, target)
    assert last.count() == last.select("user_id").distinct().count() == events.select("user_id").distinct().count()
    usage.upsert_by_key(target, "user_id")(spark.createDataFrame([(10**9, 1)], "user_id bigint, event_id bigint"), 10**6)
    one = spark.read.parquet(f"{target}/v1000000")
    assert 0 < one.count() < last.count() and usage.current(spark, target).count() == last.count() + 1


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filters(spark):
    from quillspark.operators.filters import compile_filter

    df = spark.createDataFrame([(1, "a", 5), (2, "b", None), (3, None, 7)], "id long, s string, n int")
    run = lambda w: [r.id for r in df.where(compile_filter(w, {"s", "n"})).orderBy("id").collect()]
    assert run({"s": "a"}) == [1] and run({"s": {"$ne": "a"}}) == [2] and run({"n": {"$nin": [5]}}) == [3]
    assert run({"$or": [{"n": {"$gt": 6}}, {"$and": [{"s": {"$in": ["a"]}}, {"n": {"$lte": 5}}]}]}) == [1, 3]
    for bad in ({}, {"s": 1, "n": 2}, {"x": 1}, {"$and": []}, {"n": {"$like": 1}}, {"n": {"$in": []}}):
        with pytest.raises(ValueError):
            compile_filter(bad, {"s", "n"})


def test_segments(spark):
    from quillspark.operators import segment

    parts = segment.pack_paragraphs(["a" * 300, "b" * 300, "One. " * 300, "tail"], 1000)
    assert all(len(p) <= 1000 for p in parts) and "".join(parts).replace("\n", "").replace(" ", "") == "a" * 300 + "b" * 300 + "One." * 300 + "tail"
    refs = '[1] A. Doe, "A long enough title," Venue, 2019. doi:10.1000/xyz.\n[2] B. Roe. Another title of a pa-\nper. arXiv:2401.00001, (2024).\n\nText after.'
    rows = segment.reference_entries(spark.createDataFrame([(1, refs), (2, None), (3, "none")], "id long, body string")).orderBy("entry_no").collect()
    assert [(r.entry_no, r.doi, r.arxiv_id, r.year) for r in rows] == [(1, "10.1000/xyz", None, 2019), (2, None, "2401.00001", 2024)]
    assert rows[0].title == "A long enough title" and "paper" in rows[1].entry


def test_audit(spark):
    from quillspark.operators import audit

    text = "# Head\nSuccess rate was 82% at 4 steps [1]. It was 90% [1]. It rose by 7. See [3]."
    w = spark.createDataFrame([(1, text)], "id long, text string")
    e = spark.createDataFrame([(1, 1, "a success rate of 82% at 4 steps")], "id long, n int, quote string")
    got = {(r.sentence, r.issue) for r in audit.issues(w, e).collect()}
    assert got == {("It was 90% [1].", "numeric_conflict"), ("It rose by 7.", "citation_gap"), ("See [3].", "citation_dangling")}


def test_shared_pages_keep_the_hot_paper(spark, tmp_path):
    from itertools import combinations

    from quillspark import plans

    # more sections on one page than a block holds, on paper 1 and on another
    rows = [(k, 1 if k % 3 else 2, 5 + k % 2, (6 if k % 5 else None)) for k in range(300)] + [(900, 1, None, 6), (901, None, 5, 6), (902, 1, 6, 5)]
    spark.createDataFrame(rows, "id bigint, paper_id bigint, start_page int, end_page int").write.parquet(str(tmp_path / "section_nodes.parquet"))
    on = {i: (p, set(range(min(a, b or a), max(a, b or a) + 1))) for i, p, a, b in rows if a and p}
    want = {(i, j, len(on[i][1] & on[j][1])) for i, j in combinations(sorted(on), 2) if on[i][0] == on[j][0] and on[i][1] & on[j][1]}
    got = plans.QUERIES["shared_pages"](spark, str(tmp_path))
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    assert any(on[i][0] == 1 for i, _, _ in want)
