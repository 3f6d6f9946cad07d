"""Small hand-made cases of the core operators: digests, dialogues, contexts, graphs, sections, readers, streams."""

import math
import random

from pyspark.sql import functions as F

from quillspark.functions import fields as f
from quillspark.operators import context, dialogue, digest, evaluate, fulltext, graph, matrix, sections, vectors
from quillspark.sources import bibliography


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first().v


def test_fields(spark):
    assert one(spark, f.search_terms(F.lit("What is XL-MIMO? C++ 近场估计 GPT-4."))) == ["What", "is", "XL-MIMO", "C++", "近场估计", "近场估", "场估计", "GPT-4"]
    assert one(spark, f.first_doi(F.lit("(see 10.1000/ab(c)d)"))) == "10.1000/ab(c)d"
    assert one(spark, f.latest_year(F.lit("1999, 20201, 2019-2021 and 2099"), 2027)) == 2021
    assert one(spark, f.arxiv_year(F.lit("2413.00001"), 2027)) is None and one(spark, f.arxiv_year(F.lit("9905.00001"), 2027)) == 1999
    text, gone = f.citations_within(F.lit("a [1] b [13] c [00] d [2]"), 2)
    assert one(spark, text) == "a [1] b  c  d [2]" and one(spark, gone) == [0, 13]
    assert one(spark, f.safe_name(F.lit(r"C:\x\..\evil?.pdf."))) == "evil_.pdf" and one(spark, f.safe_name(F.lit(None).cast("string"))) == "upload.pdf"
    assert one(spark, f.mangled(F.array(F.lit("6.72 8.83 9.19"), F.lit("x"), F.lit("1/2")))) and not one(spark, f.mangled(F.array(F.lit("6.72"), F.lit("1 2"))))
    assert one(spark, f.longest_probe(F.lit("short BIBREF3 a longer stretch of the passage INLINEFORM0 end"))) == "a longer stretch of the passage"
    assert [one(spark, f.positive_page(F.lit(v))) for v in ("3", "3.7", "-1", "x", None)] == [3, None, None, None, None]


def test_digest_by_hand(spark):
    items = [(f"k{i}", None, f"learning paper {i}", None) for i in range(28)] + [("b1", "a1", "beamforming", None), ("b2", None, "Massive-MIMO beamforming", "on channel estimation")]
    df = spark.createDataFrame(items, "norm_key string, arxiv_id string, title string, abstract string")
    profile = [("channel estimation", 1.0), ("beamforming", 0.8), ("learning", 0.6), ("channel", 0.5), ("rag", 0.4)]
    rows = {r.norm_key: r for r in digest.score(df, profile).collect()}
    idf = lambda n: math.log(31 / (n + 1)) / math.log(31)
    assert abs(rows["k0"].raw_score - 0.6 * idf(28)) < 1e-9 and rows["k0"].weak
    two = rows["b2"]
    assert [r.term for r in two.reasons] == ["beamforming", "channel estimation"] and two.n_concepts == 2
    assert abs(two.raw_score - (0.8 * idf(2) + 0.4 * idf(1))) < 1e-9 and abs(two.score - two.raw_score / 3.3) < 1e-9
    assert [r.norm_key for r in digest.ranked(digest.score(df, profile), 2).orderBy("rank").collect()] == ["b2", "b1"]
    few = digest.score(df.limit(2), [("storage", 1.0), ("age", 1.0)]).collect()
    assert all(r.score == 0 and not r.reasons for r in few)
    assert digest.score(df.where("false"), profile).count() == 0 and digest.score(df, []).where("score > 0").count() == 0


def test_dialogues(spark):
    goals = {"推荐几篇 agent 综述": "cite", "写一篇 Agent 综述": "survey", "精读论文 12": "read", "why?": "qa", "Which responses were elicited, and what are the findings?": "qa", "recommendation of findings": "qa", None: "qa"}
    df = spark.createDataFrame(list(goals.items()), "g string, k string")
    assert all(r.k == r.got for r in df.select("k", dialogue.intent("g")[0].alias("got")).collect())
    assert one(spark, dialogue.referenced(F.lit("[3] 和第二篇、第 10 篇"))) == [3, 2, 10]
    assert one(spark, dialogue.followup(F.lit("它的局限是什么"), F.lit(True))) and not one(spark, dialogue.followup(F.lit("它的局限是什么"), F.lit(False)))
    assert not one(spark, dialogue.followup(F.lit("对比一下 ZF 和 MMSE 检测器"), F.lit(True)))


def test_history_drops_answers_first(spark):
    turns = [(True, "a" * 10), (False, "b" * 10), (True, "c" * 10), (False, "d" * 10)]
    df = spark.createDataFrame([(turns,)], "t array<struct<asked:boolean,text:string>>")
    block = df.select(dialogue.history_block(F.col("t"), 40).alias("b")).first().b
    assert block == "用户：" + "a" * 10 + "\n用户：" + "c" * 10
    assert df.select(dialogue.history_block(F.col("t"), 0).alias("b")).first().b == ""


def test_contexts(spark):
    df = spark.createDataFrame([(1, 10), (2, 100), (3, 20), (4, 5)], "n int, size int")
    assert sorted(r.n for r in context.within_budget(df, "n", "size", 35).collect()) == [1, 3, 4]
    pinned, ranked = (spark.createDataFrame([(i, r) for r, i in enumerate(x, 1)], "id int, rank int") for x in ([7, 8, 9], [1, 7, 2]))
    assert [r.id for r in context.carried_over(pinned, ranked, 3).orderBy("place").collect()] == [7, 8, 1]
    chunks = spark.createDataFrame([(1, 1, "the beam the the"), (1, 2, "beam codebook"), (2, 3, "nothing here"), (2, 4, "else")], "paper_id int, id int, body string")
    hits = spark.createDataFrame([(2, 4, 1)], "paper_id int, id int, rank int")
    got = {(r.paper_id, r.id, r["rank"]) for r in context.ranked_chunks(chunks, ["codebook", "beam"], hits, 1).collect()}
    assert got == {(1, 2, 1), (2, 4, 1)}


def test_bounded_neighbourhood(spark):
    e = spark.createDataFrame([("s", "a"), ("s", "b"), ("c", "s"), ("a", "d"), ("b", "a")], "src_key string, dst_key string")
    papers = spark.createDataFrame([(1, "b", "B", 2000, 1)], "id bigint, norm_key string, title string, year int, citation_count int")
    nodes = spark.createDataFrame([("a", "A", 2001, 9), ("c", "C", 2002, 5)], "norm_key string, title string, year int, citation_count int").withColumn("updated_at", F.lit("2024-01-01").cast("timestamp"))
    around, inner, truncated = graph.bounded_neighbours(e, "s", papers, nodes, 2, 3)
    assert {(r.norm_key, r.hop, r.in_library) for r in around.collect()} == {("s", 0, False), ("b", 1, True), ("a", 1, False)} and truncated
    assert {tuple(r) for r in inner.collect()} == {("s", "a"), ("s", "b"), ("b", "a")}
    around, _, truncated = graph.bounded_neighbours(e, "s", papers, nodes, 2, 50)
    assert around.count() == 5 and not truncated


def test_sections_of_blocks(spark):
    rows = []
    for p in range(5):
        rows += [("d", 10 * p, p, 8.0, False, f"Journal of Tests {p}"), ("d", 10 * p + 2, p, 10.0, False, "running text of the page " * 8)]
    rows += [("d", 1, 0, 14.0, True, "1 Introduction"), ("d", 11, 1, 12.0, True, "1.1 Data"), ("d", 21, 2, 12.0, False, "1.2 Model"), ("d", 31, 3, 12.0, True, "1.3 Results"), ("d", 41, 4, 14.0, True, "References"), ("d", 42, 4, 10.0, True, "A bold sentence ends here.")]
    blocks = spark.createDataFrame(rows, "doc string, block int, page int, size double, bold boolean, text string")
    found = sections.sections_of_blocks(blocks)
    got = {r.block: (r.number, r.level) for r in found.collect()}
    assert got[1] == ("1", 1) and got[11] == ("1.1", 2) and got[31] == ("1.3", 2) and 41 in got and 42 not in got and 0 not in got
    missing = sections.missing_numbers(found.where("block <> 21"), blocks).collect()
    assert [(r.block, r.number) for r in missing] == [(21, "1.2")]
    assert {r.masked for r in sections.repeated_texts(blocks, "doc").collect()} >= {"journal of tests #"}


def test_bibtex_faults():
    text = """
% @article{old, title = {Gone}}
@article{a, title = {The {\\\\textit{Best}} of~all}, author = {von Neumann, Jr, John and Nguy\\\\~{e}n, \\\\d{a}n}, journaltitle = {J. Tests}, doi = {10.1/ab
  cd}, year = 1999}
@thesis{b, title = {T}, school = {S}, eprint = {hdl-123}}
@misc{c, title = {U}, eprint = {2401.12345v2}}
""".replace("\\\\\\\\", "\\\\").replace("\\\\", "\\")
    a, b, c = bibliography.read_bibtex(text)
    assert a["title"] == "The Best of all" and a["venue"] == "J. Tests" and a["doi"] == "10.1/abcd"
    assert a["authors"][0] == "John von Neumann Jr" and a["authors"][1].startswith("ạn")
    assert b["venue"] == "S" and b["arxiv_id"] is None and c["arxiv_id"] == "2401.12345v2"


def test_blocked_neighbours_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    v = rng.normal(size=(300, 8))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id bigint, embedding array<float>")
    got = {(r.query_id, r["rank"]): r.id for r in vectors.nearest_many(df, df.where("vec_id < 20"), 3, rows=70, block=6).collect()}
    u = np.array([[np.float32(x) for x in r] for r in v], np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    for q in range(20):
        s = u @ u[q]
        s[q] = -np.inf
        assert [got[q, r] for r in (1, 2, 3)] == np.argsort(-s)[:3].tolist()


def test_islands_over_blocks(spark, tmp_path):
    from quillspark import plans
    from quillspark.plans import more

    rng = random.Random(4)
    rows = [(i, rng.randrange(2), rng.choice([1, 2, None])) for i in range(200)]
    spark.createDataFrame(rows, "id bigint, paper_id bigint, level int").write.parquet(str(tmp_path / "section_nodes.parquet"))
    old, more.ISLAND_BLOCK = more.ISLAND_BLOCK, 7
    try:
        got = sorted((r.paper_id, r.island, r.n) for r in plans.QUERIES["level_islands"](spark, str(tmp_path)).collect())
    finally:
        more.ISLAND_BLOCK = old
    want, last = {}, {}
    for _, p, level in rows:
        if p not in last or last[p][0] != level:
            last[p] = (level, last.get(p, (0, 0))[1] + 1)
        want[p, last[p][1]] = want.get((p, last[p][1]), 0) + 1
    assert got == sorted((p, i, n) for (p, i), n in want.items())


def test_exact_and_drawn_sign_tests_agree(spark):
    df = spark.createDataFrame([(0.0, 1.0)] * 9 + [(1.0, 0.0)] * 2 + [(1.0, 1.0)] * 5, "a double, b double")
    exact = evaluate.flips(df, "a", "b").first()
    assert (exact.plus, exact.minus) == (9, 2) and abs(exact.p_value - 2 * (1 + 11 + 55) / 2**11) < 1e-9
    assert abs(evaluate.sign_flip(df, "a", "b").first().p_value - exact.p_value) < 0.02
    assert evaluate.described(evaluate.sign_flip(df, "a", "b")).first().told.startswith("up")


def test_repeats_and_dismissals_on_a_stream(spark, tmp_path):
    from quillspark.streaming import usage

    days = [("a", 1, 0), ("a", 10, 0), ("a", 45, 0), ("b", 1, 1), ("b", 60, 0), ("c", 2, 0)]
    for n, (k, d, x) in enumerate(days):
        spark.createDataFrame([(k, x, d)], "norm_key string, dismissed int, d int").select("norm_key", "dismissed", F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, d)").alias("ts")).write.mode("append").parquet(str(tmp_path / f"in/f{n}"))
    schema = "norm_key string, dismissed int, ts timestamp"
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in/*"))
    q = usage.unrepeated(stream).writeStream.format("memory").queryName("passed").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    assert sorted((r.norm_key, r.ts.day, r.ts.month) for r in spark.table("passed").collect()) == [("a", 2, 1), ("a", 15, 2), ("c", 3, 1)]


def test_broken_lines_go_to_the_side(spark):
    from quillspark.streaming import usage

    df = spark.createDataFrame([('{"k": 1}',), ("{broken",), ('{"k": "x"}',), (None,)], "value string")
    good, bad = usage.split_malformed(df, "k bigint")
    assert [r.k for r in good.collect()] == [1] and {r.rejected for r in bad.collect()} == {"{broken", '{"k": "x"}', None}
    a = usage.fingerprint(df, "value").first()
    assert a == usage.fingerprint(df.orderBy(F.desc("value")), "value").first() != usage.fingerprint(df.limit(2), "value").first()


def test_matrix_formats(spark):
    df = spark.createDataFrame([(1, '=a "b"', "x|y_z", None)], "id int, p string, q string, r string")
    row = lambda form: matrix.lines(df, ["p", "q", "r"], form).first().line
    assert row("csv") == '"\'=a ""b""",x|y_z,' and row("markdown") == '| =a "b" | x\\|y_z |  |' and row("latex") == '=a "b" & x|y\\_z &  \\\\'


def test_fusion_without_a_ranking(spark):
    a, b = (spark.createDataFrame([(i, r) for r, i in enumerate(x, 1)], "id int, rank int") for x in ([1, 2], [2, 3]))
    got = {r.id: r.score for r in fulltext.fuse_named({"a": (a, 1.0), "b": (b, 1.0), "c": (None, 1.0)}, 5).collect()}
    assert abs(got[2] - (1 / 62 + 1 / 61)) < 1e-9 and abs(got[1] - 1 / 61) < 1e-9 and abs(got[3] - 1 / 62) < 1e-9
