"""Daily recommendations over the digests and the library."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import digest, lexical
from .ranking import _P
from .registry import Tables, query

#: Parameter of category_scores in these queries: invented categories of the collection.
LEXICON = {"comm": ["channel", "beam", "antenna", "pilot", "uplink"], "ir": ["retrieval", "query", "index", "passage", "context window"], "earth": ["rainfall", "soil", "aerosol", "crop"], "bio": ["protein", "cell"], "edu": ["course", "grading", "reading"]}

_W = " \\t\\r\\n\\f\\v"
_NORM = "lower(trim(regexp_replace(coalesce({}, ''), '[" + _W + "]+', ' ', 'g')))"
_HIT = "CASE WHEN regexp_matches(term, '[一-鿿]') THEN contains({0}, term) ELSE regexp_matches({0}, '(^|[^a-z0-9])' || regexp_replace(term, '([-+.()\\[\\]*?])', '\\\\\\1', 'g') || '([^a-z0-9]|$)') END"
_SCORED = (
    f"WITH RECURSIVE {_P}, prof AS (SELECT term, round(w / (SELECT max(w) FROM p), 9) AS weight FROM p WHERE w > 0 AND length(term) > 0 ORDER BY weight DESC, term LIMIT 60), yard AS (SELECT sum(weight) AS y FROM (SELECT weight FROM prof ORDER BY weight DESC, term LIMIT 5)), "
    f"i AS (SELECT DISTINCT norm_key, arxiv_id, title, abstract FROM digest_items WHERE norm_key IS NOT NULL), k AS (SELECT row_number() OVER () AS item, norm_key, arxiv_id, title, {_NORM.format('title')} AS nt, {_NORM.format('abstract')} AS na FROM i), "
    f"h AS (SELECT item, term, weight, CASE WHEN {_HIT.format('nt')} THEN 'title' WHEN {_HIT.format('na')} THEN 'abstract' END AS place FROM k, prof), s AS (SELECT count(*) AS n FROM k), f AS (SELECT term, count(place) AS df FROM h GROUP BY term), "
    "r AS (SELECT item, term, weight, place, CASE WHEN n < 20 THEN 1.0 ELSE ln((n + 1) / (df + 1)) / ln(n + 1) END AS idf FROM h JOIN f USING (term), s WHERE place IS NOT NULL), c AS (SELECT *, weight * CASE place WHEN 'title' THEN 1.0 ELSE 0.4 END * idf AS contribution FROM r), "
    "e1 AS (SELECT DISTINCT a.item, a.term AS x, b.term AS y FROM c a JOIN c b ON a.item = b.item AND contains(' ' || a.term || ' ', ' ' || b.term || ' ') AND a.term <> b.term), e2 AS (SELECT item, x, y FROM e1 UNION SELECT item, y, x FROM e1), "
    "g AS (SELECT item, term, term AS root FROM c UNION SELECT g.item, g.term, e2.y FROM g JOIN e2 ON e2.item = g.item AND e2.x = g.root), cc AS (SELECT item, term, min(root) AS root FROM g GROUP BY item, term), "
    "best AS (SELECT item, root, arg_max(term, struct_pack(a := contribution, b := length(term), c := term)) AS term, max(contribution) AS contribution, arg_max(place, struct_pack(a := contribution, b := length(term), c := term)) AS place FROM cc JOIN c USING (item, term) GROUP BY item, root), "
    "total AS (SELECT item, sum(contribution) AS raw, count(*) AS n_concepts FROM best GROUP BY item), "
    "scored AS (SELECT k.item, norm_key, arxiv_id, title, coalesce(raw, 0) AS raw_score, least(1.0, coalesce(raw, 0) * CASE WHEN n_concepts = 1 THEN 0.6 ELSE 1.0 END / (SELECT y FROM yard)) AS score, coalesce(n_concepts, 0) AS n_concepts FROM k LEFT JOIN total USING (item))"
)


def _profile(x: Tables) -> list[tuple[str, float]]:
    return digest.profile_rows(lexical.interest_profile(x.papers))


def _scored(x: Tables) -> DataFrame:
    items = x.digest_items.where("norm_key is not null").select("norm_key", "arxiv_id", "title", "abstract").distinct()
    return digest.score(items, _profile(x))


@query(_SCORED + " SELECT norm_key, title, round(raw_score, 6) AS raw_score, round(score, 6) AS score, n_concepts FROM scored")
def digest_scores(x: Tables) -> DataFrame:
    return _scored(x).select("norm_key", "title", F.round("raw_score", 6).alias("raw_score"), F.round("score", 6).alias("score"), F.col("n_concepts").cast("bigint").alias("n_concepts"))


@query(_SCORED + " SELECT DISTINCT norm_key, term, place, round(contribution, 6) AS contribution FROM best JOIN k USING (item)")
def digest_reasons_ranked(x: Tables) -> DataFrame:
    r = _scored(x).select("norm_key", F.explode("reasons").alias("r"))
    return r.select("norm_key", "r.term", "r.place", F.round("r.contribution", 6).alias("contribution")).distinct()


@query(_SCORED + " SELECT norm_key, rank FROM (SELECT norm_key, row_number() OVER (ORDER BY round(score, 6) DESC, coalesce(nullif(arxiv_id, ''), norm_key), norm_key) AS rank FROM (SELECT norm_key, max(arxiv_id) AS arxiv_id, max(score) AS score FROM scored GROUP BY norm_key)) WHERE rank <= 20")
def digest_ranked(x: Tables) -> DataFrame:
    one = _scored(x).groupBy("norm_key").agg(F.max("arxiv_id").alias("arxiv_id"), F.max("title").alias("title"), F.max("score").alias("score"))
    return digest.ranked(one, 20).select("norm_key", "rank")


@query("SELECT DISTINCT norm_key FROM digest_items WHERE norm_key IS NOT NULL AND digest_id = (SELECT max(digest_id) FROM digest_items) AND norm_key NOT IN (SELECT norm_key FROM papers WHERE norm_key IS NOT NULL) AND norm_key NOT IN (SELECT norm_key FROM digest_items WHERE norm_key IS NOT NULL AND (dismissed = 1 OR digest_id BETWEEN (SELECT max(digest_id) FROM digest_items) - 30 AND (SELECT max(digest_id) FROM digest_items) - 1))")
def digest_candidates(x: Tables) -> DataFrame:
    last = x.digest_items.agg(F.max("digest_id")).first()[0]
    d = x.digest_items
    return digest.candidates(d.where(F.col("digest_id") == last).select("norm_key"), x.papers, d, last).distinct()


_CASES = " UNION ALL ".join(f"SELECT '{c}' AS category, weight FROM prof WHERE regexp_matches(term, '(^|[^a-z0-9])({'|'.join(p)})(e?s)?([^a-z0-9]|$)')" for c, p in LEXICON.items())


@query(f"WITH {_P}, prof AS (SELECT term, round(w / (SELECT max(w) FROM p), 9) AS weight FROM p), s AS (SELECT category, round(sum(weight), 9) AS score FROM ({_CASES}) GROUP BY category) SELECT category, round(score, 5) AS score, row_number() OVER (ORDER BY score DESC, category) AS rank FROM s WHERE score >= 0.25 * (SELECT max(score) FROM s) ORDER BY rank LIMIT 3")
def guessed_categories(x: Tables) -> DataFrame:
    profile = lexical.interest_profile(x.papers).select("term", F.round("weight", 9).alias("weight"))
    return digest.category_scores(profile, LEXICON).withColumn("score", F.round("score", 5))


@query("SELECT norm_key, CAST(arg_min(src, struct_pack(a := src, b := id)) AS INT) AS source, arg_min(title, struct_pack(a := src, b := id)) AS title FROM (SELECT norm_key, 0 AS src, id, title FROM papers UNION ALL SELECT norm_key, 1, 0, title FROM citation_nodes WHERE norm_key NOT IN (SELECT norm_key FROM citation_nodes WHERE norm_key IS NOT NULL GROUP BY norm_key HAVING count(*) > 1) UNION ALL SELECT norm_key, 2, digest_id, title FROM (SELECT norm_key, digest_id, max(title) AS title FROM digest_items GROUP BY ALL)) WHERE norm_key IS NOT NULL GROUP BY norm_key")
def merged_sources(x: Tables) -> DataFrame:
    """One row for each work from the first source that has it: the library, clean cached nodes, digests."""
    nodes = x.citation_nodes.where("norm_key is not null").groupBy("norm_key").agg(F.count(F.lit(1)).alias("n"), F.max("title").alias("title")).where("n = 1")
    digests = x.digest_items.groupBy("norm_key", "digest_id").agg(F.max("title").alias("title"))
    every = (
        x.papers.select("norm_key", F.lit(0).alias("src"), "id", "title")
        .unionByName(nodes.select("norm_key", F.lit(1).alias("src"), F.lit(0).cast("bigint").alias("id"), "title"))
        .unionByName(digests.select("norm_key", F.lit(2).alias("src"), F.col("digest_id").alias("id"), "title"))
    )
    best = F.struct("src", "id")
    return every.where("norm_key is not null").groupBy("norm_key").agg(F.min_by("src", best).alias("source"), F.min_by("title", best).alias("title"))


@query("SELECT count(*) AS fetched, count(*) FILTER (WHERE NOT known) AS fresh, count(*) FILTER (WHERE known) AS known FROM (SELECT DISTINCT n.norm_key, n.norm_key IN (SELECT norm_key FROM papers WHERE norm_key IS NOT NULL) AS known FROM citation_nodes n WHERE n.norm_key IS NOT NULL AND n.year BETWEEN 1990 AND 2027)")
def ingest_difference(x: Tables) -> DataFrame:
    """What an import of the cached nodes of some years would add to the library."""
    fetched = x.citation_nodes.where("norm_key is not null and year between 1990 and 2027").select("norm_key").distinct()
    known = x.papers.where("norm_key is not null").select("norm_key").distinct().withColumn("k", F.lit(True))
    return fetched.join(known, "norm_key", "left").agg(F.count(F.lit(1)).alias("fetched"), F.count_if(F.col("k").isNull()).alias("fresh"), F.count("k").alias("known"))
