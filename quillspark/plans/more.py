"""Further queries: filters over metadata, evidence, outlines, budgets and state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import text as t
from ..operators import filters, verify
from ..operators.lexical import top_per
from .registry import Tables, query


@query("SELECT id FROM papers WHERE source = 's2' AND ((year IS NOT NULL AND year >= 2018) OR (venue IS NOT NULL AND venue IN ('arXiv', 'Imagined Letters')))")
def filtered_by_metadata(x: Tables) -> DataFrame:
    where = {"$and": [{"source": "s2"}, {"$or": [{"year": {"$gte": 2018}}, {"venue": {"$in": ["arXiv", "Imagined Letters"]}}]}]}
    return x.papers.where(filters.compile_filter(where, {"source", "year", "venue"})).select("id")


@query("SELECT id FROM papers WHERE year IS NOT NULL AND year <> 2020 AND source IS NOT NULL AND source NOT IN ('upload', 'bibtex')")
def filtered_by_absence(x: Tables) -> DataFrame:
    return x.papers.where(filters.compile_filter({"$and": [{"year": {"$ne": 2020}}, {"source": {"$nin": ["upload", "bibtex"]}}]}, {"source", "year"})).select("id")


@query("SELECT norm_key, src_paper_id IS NULL AS no_id, count(*) AS n FROM (SELECT dst_key AS norm_key, src_paper_id FROM citation_edges) GROUP BY ALL HAVING count(*) >= 5")
def late_edges(x: Tables) -> DataFrame:
    return x.citation_edges.groupBy(F.col("dst_key").alias("norm_key"), F.col("src_paper_id").isNull().alias("no_id")).agg(F.count(F.lit(1)).alias("n")).where("n >= 5")


@query("SELECT src_key, dst_key, max(fetched_at) AS fetched_at, count(*) AS fetches FROM citation_edges GROUP BY ALL")
def edge_refreshes(x: Tables) -> DataFrame:
    return x.citation_edges.groupBy("src_key", "dst_key").agg(F.max("fetched_at").alias("fetched_at"), F.count(F.lit(1)).alias("fetches"))


@query("SELECT src_key FROM (SELECT src_key, max(fetched_at) AS f FROM citation_edges GROUP BY src_key), (SELECT max(fetched_at) AS now FROM citation_edges) WHERE epoch_us(now) - epoch_us(f) > 30 * 86400000000")
def stale_sources(x: Tables) -> DataFrame:
    e = x.citation_edges.select("src_key", F.unix_micros(F.col("fetched_at").cast("timestamp")).alias("at"))
    return e.groupBy("src_key").agg(F.max("at").alias("f")).crossJoin(F.broadcast(e.agg(F.max("at").alias("now")))).where("now - f > 30 * 86400000000").select("src_key")  # one row


@query(
    "WITH a AS (SELECT item_id, answer, passage FROM eval_items) SELECT item_id, contains(lower(regexp_replace(passage, '[ \\t\\r\\n\\f\\v]+', '', 'g')), lower(regexp_replace(answer, '[ \\t\\r\\n\\f\\v]+', '', 'g'))) AS supported FROM a"
)
def supported_answers(x: Tables) -> DataFrame:
    return x.eval_items.select("item_id", F.contains(t.squeeze("passage"), t.squeeze("answer")).alias("supported"))


_NUM = "list_distinct(list_transform(regexp_extract_all(regexp_replace(regexp_replace({0}, '\\[[0-9]+(, *[0-9]+)*\\]', '', 'g'), '[A-Za-z]+[-_.]?[0-9]+', '', 'g'), '[0-9]+(?:\\.[0-9]+)?(?: percent|%)?'), lambda r: regexp_replace(regexp_replace(regexp_extract(r, '^[0-9.]+'), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') || CASE WHEN regexp_matches(r, 'percent|%') THEN '%' ELSE '' END))"


@query("SELECT item_id, len(list_filter(" + _NUM.format("answer") + ", lambda v: NOT list_contains(" + _NUM.format("passage") + ", v))) AS missing FROM eval_items")
def unsupported_numbers(x: Tables) -> DataFrame:
    return x.eval_items.select("item_id", F.size(verify.missing_numbers("answer", "passage")).alias("missing").cast("bigint"))


@query("SELECT doc_id, norm_key, kind, rank FROM (SELECT doc_id, norm_key, kind, row_number() OVER (PARTITION BY norm_key, kind ORDER BY length(text) DESC, doc_id) AS rank FROM documents WHERE norm_key IS NOT NULL AND text IS NOT NULL) WHERE rank <= 2")
def longest_documents(x: Tables) -> DataFrame:
    d = x.documents.where("norm_key is not null and text is not null").select("doc_id", "norm_key", "kind", F.length("text").alias("n"))
    return top_per(d, ["norm_key", "kind"], 2, F.desc("n"), F.asc("doc_id")).select("doc_id", "norm_key", "kind", "rank")


@query("SELECT text_hash, count(*) AS copies, min(doc_id) AS first_id FROM (SELECT sha256(text) AS text_hash, doc_id FROM documents WHERE text IS NOT NULL) GROUP BY text_hash HAVING count(*) > 1")
def identical_texts(x: Tables) -> DataFrame:
    return x.documents.where("text is not null").groupBy(F.sha2("text", 256).alias("text_hash")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


@query("SELECT kind, source, count(*) AS \"rows\", count(*) FILTER (WHERE n_chars IS DISTINCT FROM length(text)) AS stale, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(least(length(text), 6000)) AS BIGINT) AS billed FROM documents GROUP BY GROUPING SETS ((kind, source), (kind), ())")
def corpus_estimate(x: Tables) -> DataFrame:
    n = F.length("text")
    d = x.documents.select("kind", "source", n.alias("n"), (~F.col("n_chars").eqNullSafe(n.cast("bigint"))).alias("stale"))
    return d.groupingSets([["kind", "source"], ["kind"], []], "kind", "source").agg(F.count(F.lit(1)).alias("rows"), F.count_if("stale").alias("stale"), F.sum("n").alias("chars"), F.sum(F.least("n", F.lit(6000))).alias("billed"))


@query("SELECT event_type, CAST(date_part('hour', ts) AS INT) AS hour, count(*) AS n FROM events GROUP BY ALL")
def usage_by_hour(x: Tables) -> DataFrame:
    return x.events.groupBy("event_type", F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'error') AS error, count(*) FILTER (WHERE event_type = 'purchase') AS purchase, count(*) FILTER (WHERE event_type = 'signup') AS signup, count(*) FILTER (WHERE event_type = 'view') AS view FROM events GROUP BY user_id")
def usage_pivot(x: Tables) -> DataFrame:
    kinds = ["click", "error", "purchase", "signup", "view"]
    return x.events.groupBy("user_id").pivot("event_type", kinds).agg(F.count(F.lit(1))).na.fill(0, kinds)


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def event_properties(x: Tables) -> DataFrame:
    return x.events.select("event_id", F.from_json("props", "k bigint")["k"].alias("k")).where("k is not null")


@query("SELECT user_id, day, round(spent, 4) AS spent, round(greatest(0, 500 - sum(spent) OVER (PARTITION BY user_id ORDER BY day)), 4) AS remaining FROM (SELECT user_id, CAST(ts AS DATE) AS day, sum(value) AS spent FROM events GROUP BY ALL)")
def daily_budget(x: Tables) -> DataFrame:
    d = x.events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sum("value").alias("spent"))
    left = F.greatest(F.lit(0.0), 500 - F.sum("spent").over(Window.partitionBy("user_id").orderBy("day")))
    return d.select("user_id", "day", F.round("spent", 4).alias("spent"), F.round(left, 4).alias("remaining"))


@query("SELECT level, rater, count(*) AS n FROM reading_labels GROUP BY CUBE (level, rater)")
def label_cube(x: Tables) -> DataFrame:
    return x.reading_labels.cube("level", "rater").agg(F.count(F.lit(1)).alias("n"))


ISLAND_BLOCK = 10_000  # ids that one task orders


@query("SELECT paper_id, CAST(i AS BIGINT) AS island, min(level) AS level, count(*) AS n FROM (SELECT *, sum(CASE WHEN level IS DISTINCT FROM before THEN 1 ELSE 0 END) OVER (PARTITION BY paper_id ORDER BY id) AS i FROM (SELECT id, paper_id, level, lag(level) OVER (PARTITION BY paper_id ORDER BY id) AS before FROM section_nodes)) GROUP BY ALL")
def level_islands(x: Tables) -> DataFrame:
    """Islands are counted within blocks of ids; blocks of a paper are few, and only their first and last levels meet in one window."""
    w = Window.partitionBy("paper_id", "block").orderBy("id")
    s = x.section_nodes.select("id", "paper_id", "level", F.floor(F.col("id") / ISLAND_BLOCK).alias("block"))
    s = s.withColumn("before", F.lag("level").over(w)).withColumn("r", F.row_number().over(w))
    s = s.withColumn("inside", F.sum(F.when((F.col("r") > 1) & ~F.col("level").eqNullSafe(F.col("before")), 1).otherwise(0)).over(w))
    blocks = s.groupBy("paper_id", "block").agg(F.min_by("level", "id").alias("first"), F.max_by("level", "id").alias("last"), F.max("inside").alias("changes"))
    v = Window.partitionBy("paper_id").orderBy("block")
    blocks = blocks.withColumn("r", F.row_number().over(v)).withColumn("joins", F.when((F.col("r") == 1) | ~F.col("first").eqNullSafe(F.lag("last").over(v)), 1).otherwise(0))
    blocks = blocks.withColumn("offset", F.sum(F.col("changes") + F.col("joins")).over(v) - F.col("changes")).select("paper_id", "block", "offset")
    return s.join(blocks, ["paper_id", "block"]).groupBy("paper_id", (F.col("inside") + F.col("offset")).alias("island")).agg(F.min("level").alias("level"), F.count(F.lit(1)).alias("n"))


@query("SELECT norm_key, min(digest_id) AS first_digest FROM digest_items WHERE norm_key IS NOT NULL GROUP BY norm_key")
def first_appearance(x: Tables) -> DataFrame:
    return x.digest_items.where("norm_key is not null").groupBy("norm_key").agg(F.min("digest_id").alias("first_digest"))


@query("SELECT o.o_orderpriority, count(*) AS n FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R') GROUP BY ALL")
def orders_with_returns(x: Tables) -> DataFrame:
    r = x.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return x.orders.select("o_orderkey", "o_orderpriority").join(r, "o_orderkey", "left_semi").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n.n_name, r.r_name, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue FROM lineitem l JOIN supplier s ON s.s_suppkey = l.l_suppkey JOIN nation n ON n.n_nationkey = s.s_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey GROUP BY ALL")
def revenue_by_nation(x: Tables) -> DataFrame:
    # summed by supplier before any join
    s = x.lineitem.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    places = x.supplier.select("s_suppkey", "s_nationkey").join(x.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(x.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return s.join(places, "s_suppkey").groupBy("n_name", "r_name").agg(F.round(F.sum("v"), 2).alias("revenue"))
