"""Bounded neighbourhoods, edges, metadata and gaps of the citation graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import graph
from .registry import Tables, query

_E = "e AS (SELECT DISTINCT src_key, dst_key FROM citation_edges WHERE src_key IS NOT NULL AND dst_key IS NOT NULL AND src_key <> dst_key)"
_META = (
    "own AS (SELECT norm_key, arg_min(title, id) AS title, arg_min(year, id) AS y0, arg_min(struct_pack(t := title, y := year, c := citation_count), id) AS p FROM papers WHERE norm_key IS NOT NULL GROUP BY norm_key), "
    "oth AS (SELECT norm_key, arg_max(struct_pack(t := title, y := year, c := citation_count), struct_pack(a := updated_at, t := title, y := year, c := citation_count)) AS n FROM citation_nodes WHERE norm_key IS NOT NULL GROUP BY norm_key), "
    "meta AS (SELECT k.norm_key, CASE WHEN own.norm_key IS NOT NULL THEN p.t ELSE n.t END AS title, CASE WHEN own.norm_key IS NOT NULL THEN p.y ELSE n.y END AS year, coalesce(CASE WHEN own.norm_key IS NOT NULL THEN p.c ELSE n.c END, 0) AS citations, own.norm_key IS NOT NULL AS in_library "
    "FROM (SELECT src_key AS norm_key FROM e UNION SELECT dst_key FROM e) k LEFT JOIN own USING (norm_key) LEFT JOIN oth USING (norm_key))"
)
_SEED = "seed AS (SELECT src_key AS k FROM e GROUP BY src_key ORDER BY count(*) DESC, src_key LIMIT 1)"
_HOP1 = "h1 AS (SELECT norm_key FROM (SELECT DISTINCT CASE WHEN src_key = k THEN dst_key ELSE src_key END AS norm_key FROM e, seed WHERE src_key = k OR dst_key = k) JOIN meta USING (norm_key) ORDER BY in_library DESC, citations DESC, norm_key LIMIT 49)"
_HOP2 = "h2 AS (SELECT norm_key FROM (SELECT src_key AS norm_key FROM e WHERE dst_key IN (SELECT norm_key FROM h1) UNION SELECT dst_key FROM e WHERE src_key IN (SELECT norm_key FROM h1)) JOIN meta USING (norm_key) WHERE norm_key NOT IN (SELECT norm_key FROM h1) AND norm_key NOT IN (SELECT k FROM seed) ORDER BY in_library DESC, citations DESC, norm_key LIMIT greatest(0, 49 - (SELECT count(*) FROM h1)))"


def _edges(x: Tables) -> DataFrame:
    return graph.edges(x.citation_edges)


def _seed(e: DataFrame) -> str | None:
    r = e.groupBy("src_key").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc("src_key")).first()
    return r.src_key if r else None


def _around(x: Tables):
    e = _edges(x)
    return graph.bounded_neighbours(e, _seed(e), x.papers, x.citation_nodes, 2, 50)


@query(f"WITH {_E}, {_META}, {_SEED}, {_HOP1}, {_HOP2}, s AS (SELECT k AS norm_key, 0 AS hop FROM seed UNION ALL SELECT norm_key, 1 FROM h1 UNION ALL SELECT norm_key, 2 FROM h2) SELECT norm_key, CAST(hop AS INT) AS hop, title, year, citations, in_library FROM s JOIN meta USING (norm_key)")
def bounded_neighbourhood(x: Tables) -> DataFrame:
    """At most 50 works around the one with most references, two hops, the library's and the most cited first."""
    return _around(x)[0]


@query(f"WITH {_E}, {_META}, {_SEED}, {_HOP1}, {_HOP2}, s AS (SELECT k AS norm_key FROM seed UNION ALL SELECT norm_key FROM h1 UNION ALL SELECT norm_key FROM h2) SELECT src_key, dst_key FROM e WHERE src_key IN (SELECT norm_key FROM s) AND dst_key IN (SELECT norm_key FROM s)")
def neighbourhood_edges(x: Tables) -> DataFrame:
    return _around(x)[1]


@query(f"WITH {_E} SELECT src_key, dst_key FROM e WHERE src_key IN (SELECT norm_key FROM papers WHERE year = 2020) OR dst_key IN (SELECT norm_key FROM papers WHERE year = 2020)")
def touching_edges(x: Tables) -> DataFrame:
    return graph.touching(_edges(x), x.papers.where("year = 2020 and norm_key is not null"))


@query(f"WITH {_E}, {_META} SELECT norm_key, title, year, citations, in_library FROM meta")
def node_metadata(x: Tables) -> DataFrame:
    e = _edges(x)
    return graph.metadata(e.select(F.explode(F.array("src_key", "dst_key")).alias("norm_key")), x.papers, x.citation_nodes)


@query(
    f"WITH {_E}, {_META}, lib AS (SELECT DISTINCT norm_key FROM papers WHERE norm_key IS NOT NULL), g AS (SELECT dst_key AS norm_key, count(*) AS cited_by FROM e WHERE src_key IN (SELECT norm_key FROM lib) AND dst_key NOT IN (SELECT norm_key FROM lib) GROUP BY dst_key ORDER BY cited_by DESC, norm_key LIMIT 20), "
    "f AS (SELECT norm_key, string_agg(t, ' | ' ORDER BY i) AS citing FROM (SELECT g.norm_key, p.id AS i, p.title AS t, row_number() OVER (PARTITION BY g.norm_key ORDER BY p.id) AS r FROM g JOIN e ON e.dst_key = g.norm_key JOIN (SELECT norm_key, min(id) AS id, arg_min(title, id) AS title FROM papers WHERE norm_key IS NOT NULL GROUP BY norm_key) p ON p.norm_key = e.src_key) WHERE r <= 5 GROUP BY norm_key) "
    "SELECT norm_key, cited_by, title, citing, row_number() OVER (ORDER BY cited_by DESC, norm_key) AS rank FROM g JOIN meta USING (norm_key) LEFT JOIN f USING (norm_key)"
)
def gap_titles(x: Tables) -> DataFrame:
    g = graph.gaps_with_titles(_edges(x), x.papers, x.citation_nodes)
    return g.select("norm_key", "cited_by", "title", F.array_join("citing", " | ").alias("citing"), "rank")


@query("SELECT id, coalesce(nullif(trim(s2_id), ''), 'DOI:' || nullif(trim(regexp_replace(trim(doi), '(?i)^https?://(dx\\.)?doi\\.org/', '')), ''), 'ARXIV:' || nullif(trim(arxiv_id), '')) AS ref FROM papers")
def source_ids(x: Tables) -> DataFrame:
    return x.papers.select("id", graph.source_id().alias("ref"))


@query("SELECT e.src_key, e.dst_key, coalesce(e.src_paper_id, s.id) AS src_paper_id, coalesce(e.dst_paper_id, d.id) AS dst_paper_id FROM (SELECT src_key, dst_key, max(src_paper_id) AS src_paper_id, max(dst_paper_id) AS dst_paper_id FROM citation_edges WHERE src_key IS NOT NULL AND dst_key IS NOT NULL GROUP BY ALL) e LEFT JOIN (SELECT norm_key, min(id) AS id FROM papers GROUP BY norm_key) s ON s.norm_key = e.src_key LEFT JOIN (SELECT norm_key, min(id) AS id FROM papers GROUP BY norm_key) d ON d.norm_key = e.dst_key")
def backfilled_ids(x: Tables) -> DataFrame:
    """Edges with the ids of their papers where the library knows them."""
    ids = x.papers.where("norm_key is not null").groupBy("norm_key").agg(F.min("id").alias("id"))
    e = x.citation_edges.where("src_key is not null and dst_key is not null").groupBy("src_key", "dst_key").agg(F.max("src_paper_id").alias("s"), F.max("dst_paper_id").alias("d"))
    j = e.join(ids.select(F.col("norm_key").alias("src_key"), F.col("id").alias("sid")), "src_key", "left").join(ids.select(F.col("norm_key").alias("dst_key"), F.col("id").alias("did")), "dst_key", "left")
    return j.select("src_key", "dst_key", F.coalesce("s", "sid").alias("src_paper_id"), F.coalesce("d", "did").alias("dst_paper_id"))


@query("SELECT DISTINCT p.id, q.id AS other, d.way FROM (SELECT src_key, dst_key FROM citation_edges WHERE src_key <> dst_key) e JOIN papers p ON p.norm_key = e.src_key JOIN papers q ON q.norm_key = e.dst_key, (VALUES ('cites')) d(way) UNION SELECT DISTINCT q.id, p.id, 'cited by' FROM citation_edges e JOIN papers p ON p.norm_key = e.src_key JOIN papers q ON q.norm_key = e.dst_key WHERE e.src_key <> e.dst_key")
def library_links(x: Tables) -> DataFrame:
    """Which papers of the library cite each other, both ways."""
    e = _edges(x)
    p = x.papers.where("norm_key is not null").select("norm_key", "id")
    j = e.join(p.withColumnRenamed("norm_key", "src_key"), "src_key").join(p.select(F.col("norm_key").alias("dst_key"), F.col("id").alias("other")), "dst_key").select("id", "other").distinct()
    return j.withColumn("way", F.lit("cites")).unionByName(j.select(F.col("other").alias("id"), F.col("id").alias("other"), F.lit("cited by").alias("way")))
