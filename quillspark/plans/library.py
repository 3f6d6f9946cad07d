"""Joins, aggregations, windows and graph queries over the library."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..operators import graph, tree
from ..operators.lexical import top, top_per
from .registry import Tables, query

E = "(SELECT DISTINCT src_key, dst_key FROM citation_edges WHERE src_key IS NOT NULL AND dst_key IS NOT NULL AND src_key <> dst_key)"
NODE = "(SELECT paper_id, node_id, arg_min(title, id) AS title, arg_min(section_path, id) AS section_path, arg_min(level, id) AS level, arg_min(start_page, id) AS start_page, arg_min(end_page, id) AS end_page, arg_min(coalesce(body, ''), id) AS body FROM section_nodes GROUP BY paper_id, node_id)"


def _edges(x: Tables) -> DataFrame:
    return graph.edges(x.citation_edges)


def _keys(x: Tables) -> DataFrame:
    return x.papers.where("norm_key is not null").select("norm_key").distinct()


@query(f"SELECT e.src_key, e.dst_key, n.title, n.year FROM {E} e JOIN (SELECT norm_key, max(title) AS title, max(year) AS year FROM citation_nodes GROUP BY norm_key) n ON n.norm_key = e.dst_key")
def edges_with_targets(x: Tables) -> DataFrame:
    nodes = x.citation_nodes.groupBy("norm_key").agg(F.max("title").alias("title"), F.max("year").alias("year"))
    return _edges(x).join(nodes, F.col("dst_key") == F.col("norm_key")).select("src_key", "dst_key", "title", "year")


@query(f"SELECT DISTINCT e.dst_key FROM {E} e WHERE NOT EXISTS (SELECT 1 FROM citation_nodes n WHERE n.norm_key = e.dst_key)")
def dangling_targets(x: Tables) -> DataFrame:
    return _edges(x).select("dst_key").distinct().join(x.citation_nodes.select(F.col("norm_key").alias("dst_key")), "dst_key", "left_anti")


@query("SELECT DISTINCT norm_key FROM citation_nodes n WHERE NOT EXISTS (SELECT 1 FROM papers p WHERE p.norm_key = n.norm_key)")
def external_nodes(x: Tables) -> DataFrame:
    return x.citation_nodes.select("norm_key").distinct().join(_keys(x), "norm_key", "left_anti")


@query(f"SELECT p.id FROM papers p WHERE p.norm_key IN (SELECT src_key FROM {E} UNION SELECT dst_key FROM {E})")
def papers_in_graph(x: Tables) -> DataFrame:
    e = _edges(x)
    ends = e.select(F.col("src_key").alias("norm_key")).union(e.select("dst_key")).distinct()
    return x.papers.join(ends, "norm_key", "left_semi").select("id")


@query("SELECT p.id FROM papers p WHERE NOT EXISTS (SELECT 1 FROM section_nodes s WHERE s.paper_id = p.id)")
def papers_without_sections(x: Tables) -> DataFrame:
    return x.papers.join(x.section_nodes.select(F.col("paper_id").alias("id")), "id", "left_anti").select("id")


@query("SELECT p.id, count(DISTINCT s.node_id) AS n_nodes, count(DISTINCT d.doc_id) AS n_docs FROM papers p LEFT JOIN section_nodes s ON s.paper_id = p.id LEFT JOIN documents d ON d.norm_key = p.norm_key GROUP BY p.id")
def linked_counts(x: Tables) -> DataFrame:
    # each side is counted before it is joined: the sides never multiply each other
    nodes = x.section_nodes.select("paper_id", "node_id").distinct().groupBy(F.col("paper_id").alias("id")).agg(F.count(F.lit(1)).alias("n_nodes"))
    docs = x.documents.groupBy("norm_key").agg(F.count_distinct("doc_id").alias("n_docs"))
    return x.papers.select("id", "norm_key").join(nodes, "id", "left").join(docs, "norm_key", "left").select("id", F.coalesce("n_nodes", F.lit(0)).alias("n_nodes"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"))


@query(
    "WITH pages AS (SELECT id, paper_id, unnest(range(least(start_page, coalesce(end_page, start_page)), greatest(start_page, coalesce(end_page, start_page)) + 1)) AS page FROM section_nodes WHERE start_page IS NOT NULL) SELECT a.id AS id_a, b.id AS id_b, count(*) AS pages FROM pages a JOIN pages b ON a.paper_id = b.paper_id AND a.page = b.page AND a.id < b.id GROUP BY ALL"
)
def shared_pages(x: Tables) -> DataFrame:
    """Sections of a paper that share pages, every paper included."""
    return _shared_pages(x.section_nodes)


PAGE_BLOCK = 64  # sections of a page that one task pairs with all others of the page


def _shared_pages(nodes: DataFrame) -> DataFrame:
    # interval overlap as an equi-join on pages: an interval covers few of them; the sections of a full page are spread over blocks
    end = F.coalesce("end_page", "start_page")
    pages = nodes.where("start_page is not null").select("id", "paper_id", F.explode(F.sequence(F.least(F.col("start_page"), end), F.greatest(F.col("start_page"), end))).alias("page"))
    blocks = pages.groupBy("paper_id", "page").agg(F.ceil(F.count(F.lit(1)) / PAGE_BLOCK).alias("blocks"))
    sized = pages.join(blocks, ["paper_id", "page"])
    a = sized.select(F.col("id").alias("id_a"), "paper_id", "page", F.pmod(F.xxhash64("id"), "blocks").alias("block"))
    b = sized.select(F.col("id").alias("id_b"), "paper_id", "page", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"))
    return a.join(b, ["paper_id", "page", "block"]).where("id_a < id_b").groupBy("id_a", "id_b").agg(F.count(F.lit(1)).alias("pages"))


@query("SELECT d.digest_id, d.norm_key, d.title, EXISTS (SELECT 1 FROM papers p WHERE p.norm_key = d.norm_key) AS in_library, coalesce(d.rank_score, d.score) AS sort_score FROM digest_items d")
def digest_with_library(x: Tables) -> DataFrame:
    keys = _keys(x).withColumn("known", F.lit(True))
    return x.digest_items.join(keys, "norm_key", "left").select("digest_id", "norm_key", "title", F.coalesce("known", F.lit(False)).alias("in_library"), F.coalesce("rank_score", "score").alias("sort_score"))


@query("SELECT digest_id, count(*) AS items, count(DISTINCT norm_key) AS works, count(*) FILTER (WHERE dismissed = 1) AS dismissed, round(max(score), 6) AS best FROM digest_items GROUP BY digest_id")
def digest_summary(x: Tables) -> DataFrame:
    return x.digest_items.groupBy("digest_id").agg(F.count(F.lit(1)).alias("items"), F.count_distinct("norm_key").alias("works"), F.count_if(F.col("dismissed") == 1).alias("dismissed"), F.round(F.max("score"), 6).alias("best"))


@query("SELECT source, count(*) AS n, count(DISTINCT norm_key) AS works, count(abstract) AS with_abstract, count(*) FILTER (WHERE year BETWEEN 1900 AND 2026) AS plausible_years, sum(coalesce(citation_count, 0)) AS citations FROM papers GROUP BY source")
def library_by_source(x: Tables) -> DataFrame:
    return x.papers.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("norm_key").alias("works"), F.count("abstract").alias("with_abstract"), F.count_if(F.col("year").between(1900, 2026)).alias("plausible_years"), F.sum(F.coalesce("citation_count", F.lit(0))).alias("citations")
    )


@query(f"SELECT (SELECT count(*) FROM citation_edges) AS stored, (SELECT count(*) FROM {E}) AS edges, (SELECT count(DISTINCT src_key) FROM {E}) AS citing, (SELECT count(DISTINCT dst_key) FROM {E}) AS cited, (SELECT count(DISTINCT norm_key) FROM citation_nodes) AS nodes")
def graph_summary(x: Tables) -> DataFrame:
    e = _edges(x)
    one = lambda df, name, *c: df.agg((F.count_distinct(*c) if c else F.count(F.lit(1))).alias(name))
    return one(x.citation_edges, "stored").crossJoin(one(e, "edges")).crossJoin(one(e, "citing", "src_key")).crossJoin(one(e, "cited", "dst_key")).crossJoin(one(x.citation_nodes, "nodes", "norm_key"))  # one row each


@query("SELECT norm_key, count(*) AS copies, min(id) AS first_id, max(updated_at) AS last_change FROM papers GROUP BY norm_key HAVING count(*) > 1")
def repeated_imports(x: Tables) -> DataFrame:
    return x.papers.groupBy("norm_key").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("first_id"), F.max("updated_at").alias("last_change")).where("copies > 1")


@query("SELECT norm_key, title, year FROM (SELECT *, row_number() OVER (PARTITION BY norm_key ORDER BY updated_at DESC NULLS LAST, title, year) AS r FROM citation_nodes) WHERE r = 1")
def latest_metadata(x: Tables) -> DataFrame:
    # keep-last as an aggregate: partial results merge before the shuffle, a hot key needs no sort
    r = F.struct(F.col("updated_at").isNull().alias("none"), (-F.unix_micros(F.col("updated_at").cast("timestamp"))).alias("age"), F.col("title").isNull().alias("nt"), "title", F.col("year").isNull().alias("ny"), "year")
    return x.citation_nodes.groupBy("norm_key").agg(F.min(r).alias("r")).select("norm_key", "r.title", "r.year")


@query("SELECT p.norm_key, first_value AS first_title, coalesce(nullif(max(CASE WHEN r = 1 THEN venue END), ''), max(venue)) AS venue, coalesce(max(CASE WHEN r = 1 THEN doi END), max(doi)) AS doi FROM (SELECT *, row_number() OVER (PARTITION BY norm_key ORDER BY id) AS r, first_value(title) OVER (PARTITION BY norm_key ORDER BY id) AS first_value FROM papers) p GROUP BY p.norm_key, first_value")
def filled_blanks(x: Tables) -> DataFrame:
    """The first import wins; what it lacks is filled from the others."""
    g = x.papers.groupBy("norm_key").agg(F.min_by(F.struct("title", "venue", "doi"), "id").alias("f"), F.max("venue").alias("v"), F.max("doi").alias("d"))
    return g.select("norm_key", F.col("f.title").alias("first_title"), F.coalesce(F.when(F.col("f.venue") != "", F.col("f.venue")), "v").alias("venue"), F.coalesce("f.doi", "d").alias("doi"))


@query("SELECT source, id, citation_count, rank FROM (SELECT source, id, citation_count, row_number() OVER (PARTITION BY source ORDER BY citation_count DESC NULLS LAST, id) AS rank FROM papers) WHERE rank <= 3")
def most_cited_by_source(x: Tables) -> DataFrame:
    return top_per(x.papers.select("source", "id", "citation_count"), ["source"], 3, F.desc_nulls_last("citation_count"), F.asc("id"))


@query("SELECT id, year, norm_key FROM papers WHERE (year >= 2015 AND year <= 2024) OR year IS NULL")
def year_window(x: Tables) -> DataFrame:
    return x.papers.where("(year >= 2015 and year <= 2024) or year is null").select("id", "year", "norm_key")


@query("SELECT doc_id, kind FROM documents WHERE lang IS DISTINCT FROM 'en'")
def not_english(x: Tables) -> DataFrame:
    return x.documents.where(~F.col("lang").eqNullSafe("en")).select("doc_id", "kind")


@query("SELECT norm_key FROM (SELECT DISTINCT norm_key FROM digest_items WHERE norm_key IS NOT NULL INTERSECT SELECT DISTINCT norm_key FROM citation_nodes)")
def digest_and_graph(x: Tables) -> DataFrame:
    return x.digest_items.where("norm_key is not null").select("norm_key").intersect(x.citation_nodes.select("norm_key"))


@query("SELECT norm_key FROM (SELECT norm_key FROM documents WHERE norm_key IS NOT NULL EXCEPT SELECT norm_key FROM digest_items)")
def documents_not_in_digests(x: Tables) -> DataFrame:
    return x.documents.where("norm_key is not null").select("norm_key").subtract(x.digest_items.select("norm_key"))


@query(f"SELECT e.dst_key AS norm_key, count(*) AS cited_by FROM {E} e WHERE EXISTS (SELECT 1 FROM papers p WHERE p.norm_key = e.src_key) AND NOT EXISTS (SELECT 1 FROM papers p WHERE p.norm_key = e.dst_key) GROUP BY e.dst_key")
def reading_gaps(x: Tables) -> DataFrame:
    return graph.gaps(_edges(x), x.papers)


@query(f"SELECT a.dst_key AS key_a, b.dst_key AS key_b, count(*) AS n FROM {E} a JOIN {E} b ON a.src_key = b.src_key AND a.dst_key < b.dst_key GROUP BY ALL HAVING count(*) >= 2")
def cocited_pairs(x: Tables) -> DataFrame:
    return graph.co_counts(_edges(x), "src_key", "dst_key")


SEEDS = "(SELECT norm_key FROM papers WHERE id IN (1, 2, 3))"


@query(
    f"""WITH e AS {E}, s AS (SELECT DISTINCT norm_key AS seed FROM {SEEDS}), i AS (SELECT dst_key AS norm_key, count(*) AS deg FROM e GROUP BY 1), o AS (SELECT src_key AS norm_key, count(*) AS deg FROM e GROUP BY 1),
    c AS (SELECT seed, e2.dst_key AS norm_key, count(*) AS i FROM s JOIN e ON e.dst_key = seed JOIN e e2 ON e2.src_key = e.src_key WHERE e2.dst_key NOT IN (SELECT seed FROM s) GROUP BY ALL),
    b AS (SELECT seed, e2.src_key AS norm_key, count(*) AS i FROM s JOIN e ON e.src_key = seed JOIN e e2 ON e2.dst_key = e.dst_key WHERE e2.src_key NOT IN (SELECT seed FROM s) GROUP BY ALL),
    cs AS (SELECT c.norm_key, sum(c.i) AS cocitation, sum(c.i / (so.deg + i.deg - c.i)) AS j FROM c JOIN i so ON so.norm_key = seed JOIN i ON i.norm_key = c.norm_key GROUP BY 1),
    bs AS (SELECT b.norm_key, sum(b.i) AS coupling, sum(b.i / (so.deg + o.deg - b.i)) AS j FROM b JOIN o so ON so.norm_key = seed JOIN o ON o.norm_key = b.norm_key GROUP BY 1)
    SELECT norm_key, round((0.5 * coalesce(cs.j, 0) + 0.5 * coalesce(bs.j, 0)) / (SELECT count(*) FROM s), 9) AS score, coalesce(cocitation, 0) AS cocitation, coalesce(coupling, 0) AS coupling FROM cs FULL JOIN bs USING (norm_key)"""
)
def related_works(x: Tables) -> DataFrame:
    seeds = x.papers.where("id in (1, 2, 3)").select("norm_key")
    return graph.related(_edges(x), seeds).withColumn("score", F.round("score", 9))


@query(
    f"""WITH RECURSIVE e AS (SELECT src_key AS a, dst_key AS b FROM {E} UNION SELECT dst_key, src_key FROM {E}), w AS (SELECT DISTINCT norm_key, 0 AS hop FROM {SEEDS} UNION SELECT e.b, w.hop + 1 FROM w JOIN e ON e.a = w.norm_key WHERE w.hop < 2) SELECT norm_key, min(hop) AS hop FROM w GROUP BY norm_key"""
)
def neighbourhood(x: Tables) -> DataFrame:
    return graph.neighbours(_edges(x), x.papers.where("id in (1, 2, 3)").select("norm_key"), 2)


@query(f"SELECT norm_key, cited, row_number() OVER (ORDER BY cited DESC, norm_key) AS rank FROM (SELECT dst_key AS norm_key, count(*) AS cited FROM {E} GROUP BY 1) ORDER BY rank LIMIT 20")
def most_cited(x: Tables) -> DataFrame:
    counts = _edges(x).groupBy(F.col("dst_key").alias("norm_key")).agg(F.count(F.lit(1)).alias("cited"))
    return top(counts, 20, F.desc("cited"), F.asc("norm_key"))


@query("SELECT id, node_id, parent_id, CASE WHEN regexp_matches(node_id, '\\.[0-9]+$') THEN regexp_replace(node_id, '\\.[0-9]+$', '') END AS computed_parent FROM section_nodes")
def section_parents(x: Tables) -> DataFrame:
    return x.section_nodes.select("id", "node_id", "parent_id", tree.parent_of("node_id").alias("computed_parent"))


@query(f"SELECT a.paper_id, a.node_id, count(*) AS n_sections, CAST(sum(length(b.body)) AS BIGINT) AS n_chars FROM {NODE} a JOIN {NODE} b ON a.paper_id = b.paper_id AND (b.node_id = a.node_id OR starts_with(b.node_id, a.node_id || '.')) GROUP BY ALL")
def section_rollup(x: Tables) -> DataFrame:
    nodes = x.section_nodes.select("paper_id", "node_id").distinct()
    return tree.roll_up(x.section_nodes).join(nodes, ["paper_id", "node_id"], "left_semi")


@query(f"SELECT count(DISTINCT paper_id) AS papers, count(*) AS nodes, round(count(*) / count(DISTINCT paper_id), 6) AS per_paper, max(level) AS depth, count(*) FILTER (WHERE body = '') AS empty FROM {NODE}")
def section_summary(x: Tables) -> DataFrame:
    n = tree.one_per_node(x.section_nodes.select("id", "paper_id", "node_id", "level", "body"))
    return n.agg(F.count_distinct("paper_id").alias("papers"), F.count(F.lit(1)).alias("nodes"), F.round(F.count(F.lit(1)) / F.count_distinct("paper_id"), 6).alias("per_paper"), F.max("level").alias("depth"), F.count_if(F.coalesce("body", F.lit("")) == "").alias("empty"))


@query("SELECT id, i AS page_no, substr(text, 1 + 4000 * (i - 1), 4000) AS slice FROM (SELECT doc_id AS id, text, unnest(range(1, CAST(ceil(length(text) / 4000.0) AS INT) + 1)) AS i FROM documents WHERE length(text) > 0)")
def page_slices(x: Tables) -> DataFrame:
    docs = x.documents.where("length(text) > 0").select(F.col("doc_id").alias("id"), "text", F.explode(F.sequence(F.lit(1), F.ceil(F.length("text") / 4000).cast("int"))).alias("page_no"))
    return docs.select("id", "page_no", F.substring("text", 1 + 4000 * (F.col("page_no") - 1), F.lit(4000)).alias("slice"))


@query("SELECT id, row_number() OVER (PARTITION BY id ORDER BY i) AS paragraph_no, paragraph FROM (SELECT id, unnest(range(1, len(p) + 1)) AS i, unnest(p) AS paragraph FROM (SELECT id, string_split(regexp_replace(body, '\\n[ \\t]*\\n+', chr(1), 'g'), chr(1)) AS p FROM section_nodes)) WHERE trim(paragraph) <> ''")
def paragraphs(x: Tables) -> DataFrame:
    parts = F.filter(F.split(F.regexp_replace("body", r"\n[ \t]*\n+", "\u0001"), "\u0001"), lambda p: F.trim(p) != "")
    return x.section_nodes.select("id", F.posexplode(parts).alias("i", "paragraph")).select("id", (F.col("i") + 1).cast("bigint").alias("paragraph_no"), "paragraph")


@query("SELECT user_id, event_id, CAST(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS BIGINT) AS gap_us FROM events")
def usage_gaps(x: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return x.events.select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(w)).alias("gap_us"))


@query("SELECT user_id, CAST(s AS BIGINT) AS session_no, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM (SELECT *, sum(CASE WHEN g IS NULL OR g > 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS g FROM events)) GROUP BY ALL")
def usage_sessions(x: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    e = x.events.withColumn("g", micros - F.lag(micros).over(w)).withColumn("session_no", F.sum(F.when(F.col("g").isNull() | (F.col("g") > 21_600_000_000), 1).otherwise(0)).over(w))
    return e.groupBy("user_id", "session_no").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def usage_by_day(x: Tables) -> DataFrame:
    return x.events.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def pricing_summary(x: Tables) -> DataFrame:
    return x.lineitem.where("l_shipdate <= timestamp_ntz'1998-09-02 00:00:00'").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))
