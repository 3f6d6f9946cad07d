"""Full-text, hybrid and typed search over papers, pages and sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import fields as f
from ..operators import fulltext, vectors
from ..operators.lexical import top
from .ranking import QUERY, _cos
from .registry import Tables, query

_TERMS = [w for w in QUERY.split() if len(w) >= 3]


def phrases_sql(name: str, source: str, keys: str, fields: list[str], terms: list[str]) -> str:
    """CTEs <name>b, <name>s and <name>: keys, score."""
    low = [f"lower(coalesce({c}, ''))" for c in fields]
    tf = lambda w: " + ".join(f"(length({c}) - length(replace({c}, '{w}', ''))) / {len(w)}.0" for c in low)
    counts = ", ".join(f"({tf(w)}) AS t{i}" for i, w in enumerate(terms))
    size = " + ".join(f"greatest(length({c}) - 2, 0)" for c in low)
    stats = ", ".join(f"count(*) FILTER (WHERE t{i} > 0) AS f{i}" for i in range(len(terms)))
    score = " + ".join(f"CASE WHEN t{i} > 0 THEN greatest(ln((n - f{i} + 0.5) / (f{i} + 0.5)), 1e-6) * t{i} * 2.2 / (t{i} + 1.2 * (0.25 + 0.75 * d / avg)) ELSE 0 END" for i in range(len(terms)))
    hit = " OR ".join(f"t{i} > 0" for i in range(len(terms)))
    return f"{name}b AS (SELECT {keys}, {size} AS d, {counts} FROM {source}), {name}s AS (SELECT count(*) AS n, avg(d) AS avg, {stats} FROM {name}b), {name} AS (SELECT {keys}, {score} AS score FROM {name}b, {name}s WHERE {hit})"


_PAPERS = phrases_sql("p", "papers", "id", ["title", "abstract"], _TERMS)
_SECTIONS = phrases_sql("c", "section_nodes", "paper_id, id", ["body"], _TERMS)


@query(f"WITH {_PAPERS} SELECT id, round(score, 6) AS score FROM p")
def phrase_search(x: Tables) -> DataFrame:
    return fulltext.search(x.papers, QUERY, "title", "abstract").withColumn("score", F.round("score", 6))


_SHORT = "AI 模型 zz"


@query("SELECT id, CAST(sum(2 * CAST(contains(lower(title), w) AS INT) + CAST(contains(lower(coalesce(abstract, '')), w) AS INT)) AS DOUBLE) AS score FROM papers, (VALUES ('ai'), ('模型'), ('zz')) v(w) GROUP BY id HAVING sum(2 * CAST(contains(lower(title), w) AS INT) + CAST(contains(lower(coalesce(abstract, '')), w) AS INT)) > 0")
def fallback_search(x: Tables) -> DataFrame:
    """No term is long enough for a phrase: containment decides."""
    return fulltext.search(x.papers, _SHORT, "title", "abstract")


_HITS = f"{_SECTIONS}, cr AS (SELECT paper_id, id, score, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank FROM c), ct AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY rank) AS hit_no FROM cr WHERE rank <= 200)"


def _hits(x: Tables) -> DataFrame:
    return fulltext.best_hits(x.section_nodes, QUERY, "body", "paper_id", "id")


@query(f"WITH {_HITS} SELECT paper_id, id, rank, hit_no FROM ct WHERE hit_no <= 4")
def chunk_search(x: Tables) -> DataFrame:
    return _hits(x).select("paper_id", "id", "rank", "hit_no")


@query(f"WITH {_HITS} SELECT paper_id AS id, row_number() OVER (ORDER BY min(rank), paper_id) AS rank FROM ct WHERE hit_no <= 4 GROUP BY paper_id ORDER BY rank LIMIT 30")
def chunk_search_papers(x: Tables) -> DataFrame:
    return fulltext.ranked_groups(_hits(x), "paper_id", 30)


_PAGES = phrases_sql("g", "(SELECT paper_id, start_page, string_agg(body, chr(10) ORDER BY id) AS body FROM section_nodes WHERE start_page IS NOT NULL AND body IS NOT NULL GROUP BY ALL)", "paper_id, start_page", ["body"], _TERMS)


@query(f"WITH {_PAGES} SELECT paper_id, start_page, round(score, 6) AS score FROM g ORDER BY round(score, 9) DESC, paper_id, start_page LIMIT 50")
def page_search(x: Tables) -> DataFrame:
    s = x.section_nodes.where("start_page is not null and body is not null").groupBy("paper_id", "start_page")
    pages = s.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "body"))), lambda r: r["body"]), "\n").alias("body"))
    scored = fulltext.phrase_scores(pages, QUERY, ["body"], ["paper_id", "start_page"]).withColumn("score", F.round("score", 9))
    return scored.orderBy(F.desc("score"), "paper_id", "start_page").limit(50).withColumn("score", F.round("score", 6))


_VECTORS = f"v AS (SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank FROM (SELECT v.vec_id AS id, {_cos('v.embedding', 'q.embedding')} AS score FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)) q) ORDER BY rank LIMIT 30)"
_RANKED = f"{_PAPERS}, {_HITS}, a AS (SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank FROM p ORDER BY rank LIMIT 30), k AS (SELECT paper_id AS id, row_number() OVER (ORDER BY min(rank), paper_id) AS rank FROM ct WHERE hit_no <= 4 GROUP BY paper_id ORDER BY rank LIMIT 30)"


def _rankings(x: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    papers = top(fulltext.search(x.papers, QUERY, "title", "abstract").withColumn("score", F.round("score", 9)), 30, F.desc("score"), F.asc("id"))
    asked = x.embeddings.orderBy("vec_id").select("embedding").first()[0]
    near = top(vectors.nearest(x.embeddings, asked, 30).withColumn("score", F.round("score", 9)), 30, F.desc("score"), F.asc("id"))
    return papers, near, fulltext.ranked_groups(_hits(x), "paper_id", 30)


@query(
    f"WITH {_RANKED}, {_VECTORS}, u AS (SELECT id, 1.0 / (60 + rank) AS s FROM a UNION ALL SELECT id, 1.0 / (60 + rank) FROM v UNION ALL SELECT id, 0.2 / (60 + rank) FROM k) "
    "SELECT id, row_number() OVER (ORDER BY round(sum(s), 12) DESC, id) AS rank, round(sum(s), 9) AS score FROM u GROUP BY id ORDER BY rank LIMIT 10"
)
def hybrid_search(x: Tables) -> DataFrame:
    papers, near, chunks = _rankings(x)
    return fulltext.fuse_named({"words": (papers, 1.0), "vectors": (near, 1.0), "chunks": (chunks, 0.2)}, 10).select("id", "rank", F.round("score", 9).alias("score"))


@query(f"WITH {_RANKED}, u AS (SELECT id, 1.0 / (60 + rank) AS s FROM a UNION ALL SELECT id, 0.2 / (60 + rank) FROM k) SELECT id, row_number() OVER (ORDER BY round(sum(s), 12) DESC, id) AS rank FROM u GROUP BY id ORDER BY rank LIMIT 10")
def hybrid_without_vectors(x: Tables) -> DataFrame:
    """The same where no vectors can be had."""
    papers, _, chunks = _rankings(x)
    return fulltext.fuse_named({"words": (papers, 1.0), "vectors": (None, 1.0), "chunks": (chunks, 0.2)}, 10).select("id", "rank")


_TYPE = "CASE WHEN regexp_matches(coalesce(body, ''), '(^|\\n)Table [0-9]') THEN 'table' WHEN regexp_matches(coalesce(body, ''), '\\\\[()\\[\\]]|\\\\(sum|int|prod|partial|infty)') OR length(body) - length(replace(body, '$', '')) >= 2 THEN 'formula' ELSE 'text' END"


@query(
    f"WITH {phrases_sql('c', f'(SELECT *, {_TYPE} AS kind FROM section_nodes)', 'kind, paper_id, id', ['body'], _TERMS)}, "
    "r AS (SELECT kind, paper_id, row_number() OVER (PARTITION BY kind ORDER BY round(score, 9) DESC, id) AS n FROM c), f AS (SELECT kind, paper_id, min(n) AS n FROM r WHERE n <= 16 GROUP BY ALL), g AS (SELECT kind, paper_id, row_number() OVER (PARTITION BY kind ORDER BY n) AS rank FROM f) "
    "SELECT paper_id AS id, row_number() OVER (ORDER BY round(sum(CASE WHEN kind = 'text' THEN 1.0 ELSE 1.2 END / (60 + rank)), 12) DESC, paper_id) AS rank FROM g GROUP BY paper_id ORDER BY rank LIMIT 8"
)
def search_by_type(x: Tables) -> DataFrame:
    """Rankings of each type of section, tables and formulas counting more, fused."""
    kind = F.when(F.coalesce("body", F.lit("")).rlike(r"(^|\n)Table [0-9]"), "table").otherwise(f.block_type("body"))
    scored = fulltext.phrase_scores(x.section_nodes.withColumn("kind", kind), QUERY, ["body"], ["kind", "paper_id", "id"])
    from ..operators.lexical import top_per

    first = top_per(scored.withColumn("score", F.round("score", 9)), ["kind"], 16, F.desc("score"), F.asc("id")).groupBy("kind", "paper_id").agg(F.min("rank").alias("n"))
    ranks = top_per(first, ["kind"], 16, F.asc("n"))
    weight = F.coalesce(*[F.when(F.col("kind") == k, F.lit(w)) for k, w in fulltext.TYPE_WEIGHTS.items()], F.lit(1.0))
    fused = ranks.groupBy(F.col("paper_id").alias("id")).agg(F.round(F.sum(weight / (60 + F.col("rank"))), 12).alias("score"))
    return top(fused, 8, F.desc("score"), F.asc("id")).select("id", "rank")


@query(
    f"WITH {_HITS}, {_VECTORS}, w AS (SELECT s.paper_id, s.id, min(v.rank) AS r FROM v JOIN section_nodes s ON s.paper_id = v.id WHERE s.level = 1 GROUP BY ALL), u AS (SELECT paper_id, id, 0 AS src, r FROM w UNION ALL SELECT paper_id, id, 1, rank FROM ct WHERE hit_no <= 4), "
    "m AS (SELECT paper_id, id, min(src) AS src, arg_min(r, struct_pack(a := src, b := r)) AS r FROM u GROUP BY ALL) SELECT paper_id, id, CASE src WHEN 0 THEN 'vector' ELSE 'lexical' END AS via, row_number() OVER (PARTITION BY paper_id ORDER BY src, r, id) AS place FROM m"
)
def merged_hits(x: Tables) -> DataFrame:
    """Sections hit by words and top sections of the papers whose vectors are near."""
    _, near, _ = _rankings(x)
    close = x.section_nodes.where("level = 1").select("paper_id", "id").join(F.broadcast(near.select(F.col("id").alias("paper_id"), "rank")), "paper_id")  # 30 rows
    return fulltext.merged_hits(_hits(x), close, "paper_id", "id")


@query(f"WITH {_PAPERS}, {_HITS}, a AS (SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank FROM p ORDER BY rank LIMIT 30), k AS (SELECT paper_id AS id, row_number() OVER (ORDER BY min(rank), paper_id) AS rank FROM ct WHERE hit_no <= 4 GROUP BY paper_id ORDER BY rank LIMIT 30) SELECT id, CAST(min(stage) AS INT) AS stage, CAST(arg_min(rank, stage) AS INT) AS rank FROM (SELECT id, 0 AS stage, rank FROM a UNION ALL SELECT id, 1, rank FROM k) GROUP BY id")
def ordered_union(x: Tables) -> DataFrame:
    papers, _, chunks = _rankings(x)
    return fulltext.first_of(papers, chunks)


@query(f"WITH {_PAPERS}, r AS (SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank FROM p ORDER BY rank LIMIT 10) SELECT r.id, r.rank, p.title, p.year, EXISTS (SELECT 1 FROM section_nodes s WHERE s.paper_id = r.id AND length(s.body) > 0) AS has_fulltext FROM r JOIN papers p USING (id)")
def library_answers(x: Tables) -> DataFrame:
    """The best papers with what a reader is shown, and whether their text is there."""
    best = top(fulltext.search(x.papers, QUERY, "title", "abstract").withColumn("score", F.round("score", 9)), 10, F.desc("score"), F.asc("id")).select("id", "rank")
    text = x.section_nodes.where("length(body) > 0").select(F.col("paper_id").alias("id")).join(F.broadcast(best.select("id")), "id", "left_semi").distinct().withColumn("has", F.lit(True))  # 10 rows
    return x.papers.select("id", "title", "year").join(F.broadcast(best), "id").join(text, "id", "left").select("id", "rank", "title", "year", F.coalesce("has", F.lit(False)).alias("has_fulltext"))
