"""Ranked retrieval, fusion, profiles, vectors, verification and evaluation over the library."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as t
from ..operators import audit, evaluate, lexical, retrieve, segment, vectors, verify
from .registry import Tables, query
from .scalars import PROFILE_STOP, _pairs, rank_terms_sql, section_terms_sql

QUERY = "lexical baseline for the context window"
WORDS = "[" + ", ".join(f"'{w}'" for w in ["lexical", "baseline", "for", "the", "context", "window"]) + "]"
KEPT = "[" + ", ".join(f"'{w}'" for w in ["lexical", "baseline", "context", "window"]) + "]"

_B = f"""b AS (SELECT id, {rank_terms_sql('title')} AS title, {rank_terms_sql("abstract")} AS body FROM papers),
 s AS (SELECT count(*) AS n, avg(len(title)) AS avt, avg(len(body)) AS avb FROM b),
 h AS (SELECT id, len(title) AS lt, len(body) AS lb, term, len(list_filter(title, lambda v: v = term)) AS ft, len(list_filter(body, lambda v: v = term)) AS fb FROM b, unnest({WORDS}) AS q(term)),
 d AS (SELECT term, count(*) FILTER (WHERE ft > 0) AS dt, count(*) FILTER (WHERE fb > 0) AS db FROM h GROUP BY term),
 r AS (SELECT id, sum(CASE WHEN ft > 0 THEN 3.0 * ln(1 + (n - dt + 0.5) / (dt + 0.5)) * ft * 2.5 / (ft + 1.5 * (0.25 + 0.75 * lt / avt)) ELSE 0 END + CASE WHEN fb > 0 THEN ln(1 + (n - db + 0.5) / (db + 0.5)) * fb * 2.5 / (fb + 1.5 * (0.25 + 0.75 * lb / avb)) ELSE 0 END) * (0.5 + count(*) / 6.0) AS score FROM h JOIN d USING (term), s WHERE ft > 0 OR fb > 0 GROUP BY id)"""


def _bm25(x: Tables) -> DataFrame:
    return lexical.bm25(x.papers.select("id", "title", F.col("abstract").alias("body")), QUERY, {"title": 3.0, "body": 1.0})


@query(f"WITH {_B} SELECT id, round(score, 6) AS score FROM r")
def bm25_scores(x: Tables) -> DataFrame:
    return _bm25(x).withColumn("score", F.round("score", 6))


@query(f"WITH {_B} SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank FROM r ORDER BY rank LIMIT 10")
def bm25_top(x: Tables) -> DataFrame:
    return lexical.top(_bm25(x).withColumn("score", F.round("score", 9)), 10, F.desc("score"), F.asc("id")).select("id", "rank")


_O = "o AS (SELECT id, len(list_intersect(" + KEPT[:-1] + ", 'for', 'the'], list_distinct(regexp_extract_all(lower(title || ' ' || coalesce(abstract, '')), '[a-z][a-z0-9-]{2,}')))) / 6.0 AS score FROM papers)"


def _overlap(x: Tables) -> DataFrame:
    return lexical.overlap(x.papers.select("id", F.concat("title", F.lit(" "), F.coalesce("abstract", F.lit(""))).alias("text")), QUERY, "text")


@query(f"WITH {_O} SELECT id, round(score, 6) AS score FROM o")
def overlap_scores(x: Tables) -> DataFrame:
    return _overlap(x).withColumn("score", F.round("score", 6))


@query(
    f"WITH {_B}, {_O}, a AS (SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank, 1.0 AS w FROM r ORDER BY rank LIMIT 50), c AS (SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank, 0.2 AS w FROM o WHERE score > 0 ORDER BY rank LIMIT 50) "
    "SELECT id, round(sum(w / (60 + rank)), 9) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM c) GROUP BY id"
)
def fused_ranking(x: Tables) -> DataFrame:
    a = lexical.top(_bm25(x).withColumn("score", F.round("score", 9)), 50, F.desc("score"), F.asc("id")).select("id", "rank", F.lit(1.0).alias("weight"))
    b = lexical.top(_overlap(x).where("score > 0").withColumn("score", F.round("score", 9)), 50, F.desc("score"), F.asc("id")).select("id", "rank", F.lit(0.2).alias("weight"))
    return lexical.fuse(a.unionByName(b)).withColumn("score", F.round("score", 9))


@query(
    f"WITH n AS (SELECT paper_id, node_id, min(title) AS title, min(section_path) AS path FROM section_nodes GROUP BY ALL), h AS (SELECT paper_id, node_id, lower(term) AS term, max(tf) AS tf FROM section_terms WHERE list_contains({KEPT}, lower(term)) GROUP BY ALL), d AS (SELECT term, count(*) AS df FROM h GROUP BY term) "
    f"SELECT h.paper_id, h.node_id, round(sum(log10(1 + (SELECT count(*) FROM n) / df) * (1 + log10(greatest(coalesce(tf, 1), 1)) + CASE WHEN list_contains({section_terms_sql('title')}, term) THEN 6.0 WHEN list_contains({section_terms_sql('path')}, term) THEN 1.5 ELSE 0 END)), 6) AS score, count(*) AS matched FROM h JOIN n USING (paper_id, node_id) JOIN d USING (term) GROUP BY ALL"
)
def section_scope(x: Tables) -> DataFrame:
    return lexical.section_scope(x.section_terms, x.section_nodes, QUERY).withColumn("score", F.round("score", 6))


def _profile_sql(text: str) -> str:
    low = f"lower(trim(regexp_replace(coalesce({text}, ''), '[ \\t\\r\\n\\f\\v]+', ' ', 'g')))"
    tokens = f"list_transform(regexp_extract_all({low}, '[a-z0-9][a-z0-9+-]*|[一-鿿]+'), lambda v: regexp_replace(v, '^[-+]+|[-+]+$', '', 'g'))"
    fit = lambda v: f"(length({v}) >= 3 AND NOT list_contains({PROFILE_STOP}, {v}) AND NOT regexp_matches({v}, '^[0-9]+$') AND NOT regexp_matches({v}, '[一-鿿]'))"
    return (
        f"list_distinct(list_concat(list_concat(list_filter({tokens}, lambda v: {fit('v')}), list_transform(list_filter(list_zip({tokens}, list_slice({tokens}, 2, len({tokens}))), lambda p: p[2] IS NOT NULL AND {fit('p[1]')} AND {fit('p[2]')}), lambda p: p[1] || ' ' || p[2])), "
        f"list_filter({_pairs(low)}, lambda v: NOT list_contains({PROFILE_STOP}, v))))"
    )


_P = f"""base AS (SELECT max(created_at) AS newest FROM papers), x AS (SELECT id, greatest(0.1, pow(0.5, greatest((epoch_us(newest) - epoch_us(created_at)) / 86400e6, 0) / 365)) AS recency, title, lower(trim(regexp_replace(venue, '[ \\t\\r\\n\\f\\v]+', ' ', 'g'))) AS venue FROM papers, base),
 e AS (SELECT id, recency, unnest({_profile_sql('title')}) AS term, 1.0 AS w FROM x UNION ALL SELECT id, recency, venue, 0.5 FROM x WHERE length(venue) >= 2), m AS (SELECT id, term, max(w) * max(recency) AS w FROM e GROUP BY id, term), p AS (SELECT term, sum(w) AS w, count(*) AS df FROM m GROUP BY term)"""


@query(f"WITH {_P} SELECT term, round(w / (SELECT max(w) FROM p), 6) AS weight, df FROM p")
def interest_profile(x: Tables) -> DataFrame:
    return lexical.interest_profile(x.papers).withColumn("weight", F.round("weight", 6))


_DIGEST = "title || ' ' || coalesce(abstract, '')"


@query(
    f"WITH {_P}, v AS (SELECT term FROM p WHERE w / (SELECT max(w) FROM p) >= 0.05), b AS (SELECT DISTINCT digest_id, norm_key, title, abstract FROM digest_items WHERE title IS NOT NULL), t AS (SELECT unnest({_profile_sql('(' + _DIGEST + ')')}) AS term FROM b), d AS (SELECT term, count(*) AS df FROM t GROUP BY term) "
    "SELECT v.term, coalesce(d.df, 0) AS df, round(ln(((SELECT count(*) FROM b) + 1) / (coalesce(d.df, 0) + 1)) / ln((SELECT count(*) FROM b) + 1), 6) AS idf FROM v LEFT JOIN d USING (term)"
)
def digest_term_idf(x: Tables) -> DataFrame:
    profile = lexical.interest_profile(x.papers).where("weight >= 0.05")
    batch = x.digest_items.where("title is not null").select("digest_id", "norm_key", "title", "abstract").distinct()
    return lexical.batch_idf(batch, F.concat("title", F.lit(" "), F.coalesce("abstract", F.lit(""))), profile).withColumn("idf", F.round("idf", 6))


@query(
    "WITH g AS (SELECT id, unnest(" + _profile_sql("title") + ") AS term FROM papers WHERE list_contains(" + rank_terms_sql("title") + ", 'baseline')) SELECT term, count(DISTINCT id) AS df FROM g WHERE term NOT LIKE '%baseline%' GROUP BY term HAVING count(DISTINCT id) >= 2"
)
def expansion_terms(x: Tables) -> DataFrame:
    found = x.papers.where(F.array_contains(t.rank_terms("title"), "baseline"))
    return found.select("id", F.explode(t.profile_terms("title")).alias("term")).where("term not like '%baseline%'").groupBy("term").agg(F.count_distinct("id").alias("df")).where("df >= 2")


def _cos(a: str, b: str) -> str:
    # normalised as the operator does it: each side over its norm plus 1e-9
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))) / ((sqrt(list_sum(list_transform({a}, lambda v: CAST(v AS DOUBLE) * v))) + 1e-9) * (sqrt(list_sum(list_transform({b}, lambda v: CAST(v AS DOUBLE) * v))) + 1e-9))"


@query(f"SELECT id, score FROM (SELECT v.vec_id AS id, round({_cos('v.embedding', 'q.embedding')}, 6) AS score FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)) q) ORDER BY score DESC, id LIMIT 10")
def nearest_vectors(x: Tables) -> DataFrame:
    v = x.embeddings
    q = v.orderBy("vec_id").select("embedding").first()[0]
    return vectors.nearest(v, q, 10).withColumn("score", F.round("score", 6))


@query(f"SELECT id, score FROM (SELECT v.vec_id AS id, round({_cos('v.embedding', 'q.embedding')}, 6) AS score FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)) q WHERE v.label IN (1, 2)) ORDER BY score DESC, id LIMIT 10")
def nearest_with_filter(x: Tables) -> DataFrame:
    v = x.embeddings
    q = v.orderBy("vec_id").select("embedding").first()[0]
    return vectors.nearest(v, q, 10, F.col("label").isin(1, 2)).withColumn("score", F.round("score", 6))


@query(
    f"SELECT query_id, id, rank FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT q.vec_id AS query_id, v.vec_id AS id, {_cos('q.embedding', 'v.embedding')} AS score FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0)) WHERE rank <= 5"
)
def neighbours_of_queries(x: Tables) -> DataFrame:
    v = x.embeddings
    return vectors.nearest_many(v, v.where("vec_id % 20 = 0"), 5).select("query_id", "id", "rank")


@query(
    "WITH c AS (SELECT label, d, avg(v) AS v FROM (SELECT label, unnest(range(0, len(embedding))) AS d, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) GROUP BY ALL), z AS (SELECT label, list(v ORDER BY d) AS centre FROM c GROUP BY label), "
    f"s AS (SELECT e.label, vec_id, round({_cos('embedding', 'centre')}, 6) AS score FROM embeddings e JOIN z USING (label)) SELECT label, vec_id AS id, score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank = 1"
)
def best_per_label(x: Tables) -> DataFrame:
    """The vector of each label that lies nearest to the label's centre."""
    v = x.embeddings
    centre = v.select("label", F.posexplode("embedding").alias("d", "v")).groupBy("label", "d").agg(F.avg(F.col("v").cast("double")).alias("v")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "v"))), lambda r: r["v"]).alias("centre"))
    scored = v.join(centre, "label").select("label", F.col("vec_id").alias("id"), F.round(vectors.dot(vectors.unit(F.col("embedding")), vectors.unit(F.col("centre"))), 6).alias("score"))
    return lexical.top_per(scored, ["label"], 1, F.desc("score"), F.asc("id")).drop("rank")


_SQ = "lower(regexp_replace(coalesce({0}, ''), '[ \\t\\r\\n\\f\\v]+', '', 'g'))"


@query(
    "WITH j AS (SELECT d.digest_id, d.norm_key, d.arxiv_id, p.id, "
    + _SQ.format("d.abstract")
    + " AS q, "
    + _SQ.format("p.abstract")
    + " AS s FROM (SELECT DISTINCT digest_id, norm_key, arxiv_id, abstract FROM digest_items) d JOIN papers p USING (norm_key)), k AS (SELECT *, list_filter(list_transform(range(0, greatest(least(length(q), 240), 1), greatest(length(q) // 8, 12)), lambda i: substr(q, i + 1, 12)), lambda v: length(v) >= 8) AS probes FROM j) "
    "SELECT digest_id, norm_key, id, CASE WHEN q = '' OR s = '' THEN false WHEN contains(s, q) THEN true WHEN length(q) < 8 THEN false ELSE len(probes) > 0 AND len(list_filter(probes, lambda v: contains(s, v))) * 3 >= len(probes) * 2 END AS verified FROM k"
)
def verified_abstracts(x: Tables) -> DataFrame:
    d = x.digest_items.select("digest_id", "norm_key", "arxiv_id", F.col("abstract").alias("quote")).distinct()
    j = d.join(x.papers.select("id", "norm_key", F.col("abstract").alias("source")), "norm_key")
    return j.select("digest_id", "norm_key", "id", verify.quote_found("quote", "source").alias("verified"))


@query(
    "WITH a AS (SELECT DISTINCT doc_id, level, rater FROM reading_labels), p AS (SELECT a.level AS gold, b.level AS guess FROM a JOIN a b ON a.doc_id = b.doc_id AND a.rater < b.rater), m AS (SELECT gold, guess, count(*) AS n FROM p GROUP BY ALL), "
    "g AS (SELECT gold AS label, sum(n) AS og, sum(CASE WHEN gold = guess THEN n ELSE 0 END) AS r FROM m GROUP BY 1), h AS (SELECT guess AS label, sum(n) AS oh FROM m GROUP BY 1) SELECT label, round(coalesce(r, 0) / nullif(oh, 0), 6) AS precision, round(coalesce(r, 0) / nullif(og, 0), 6) AS recall, round(2 * coalesce(r, 0) / (coalesce(og, 0) + coalesce(oh, 0)), 6) AS f1 FROM g FULL JOIN h USING (label)"
)
def rater_agreement(x: Tables) -> DataFrame:
    a = x.reading_labels.select("doc_id", "level", "rater").distinct()
    b = a.select("doc_id", F.col("level").alias("guess"), F.col("rater").alias("other"))
    pairs = a.join(b, "doc_id").where("rater < other")
    s = evaluate.class_scores(evaluate.confusion(pairs, "level", "guess"))
    return s.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(
    "WITH g AS (SELECT q.vec_id AS query_id, v.vec_id AS id FROM embeddings q JOIN embeddings v ON q.label = v.label AND q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0), "
    f"h AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT q.vec_id AS query_id, v.vec_id AS id, {_cos('q.embedding', 'v.embedding')} AS score FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0)), "
    "e AS (SELECT query_id, k, avg(CASE WHEN h.rank <= k THEN 1.0 ELSE 0.0 END) AS r FROM g LEFT JOIN h USING (query_id, id), unnest([1, 5, 10]) AS u(k) GROUP BY ALL) SELECT CAST(k AS INT) AS k, round(avg(r), 6) AS recall FROM e GROUP BY k"
)
def label_recall(x: Tables) -> DataFrame:
    # gold is everything of the query's label but itself: only its size is needed beside the hits
    v = x.embeddings
    q = v.where("vec_id % 20 = 0")
    hits = vectors.nearest_many(v, q, 10)
    sizes = v.groupBy("label").agg((F.count(F.lit(1)) - 1).alias("gold"))
    asked = q.select(F.col("vec_id").alias("query_id"), "label").join(sizes, "label").where("gold > 0")
    right = hits.join(asked, "query_id").join(v.select(F.col("vec_id").alias("id"), F.col("label").alias("own")), "id").where("label = own").select("query_id", "rank")
    return evaluate.recall_by_size(asked.select("query_id", "gold"), right, (1, 5, 10)).withColumn("recall", F.round("recall", 6))


@query()
def rerank_significance(x: Tables) -> DataFrame:
    """Does BM25 order the digests' scores better than overlap does: paired sign-flip test over papers."""
    pairs = _overlap(x).withColumnRenamed("score", "before").join(_bm25(x).select("id", (F.col("score") > 1).cast("double").alias("after")), "id", "left").na.fill(0.0)
    return evaluate.sign_flip(pairs, "before", "after", 2000)


@query()
def passage_search(x: Tables) -> DataFrame:
    """Two stages: sections by their postings, then the best passage of each."""
    return retrieve.passage_search(x.section_terms, x.section_nodes, QUERY)


@query()
def expanded_search(x: Tables) -> DataFrame:
    return retrieve.expanded_search(x.papers.select("id", "title", F.col("abstract").alias("body")), QUERY, {"title": 3.0, "body": 1.0})


@query()
def section_chunks(x: Tables) -> DataFrame:
    return segment.chunks(x.section_nodes)


@query()
def audited_answers(x: Tables) -> DataFrame:
    """Answers as written sentences with their passage as the only evidence."""
    written = x.eval_items.select(F.col("item_id").alias("id"), F.concat("answer", F.lit(" [1].")).alias("text"))
    return audit.issues(written, x.eval_items.select(F.col("item_id").alias("id"), F.lit(1).alias("n"), F.col("passage").alias("quote")))


_GRAMS = "list_concat(list_concat(" + ", ".join(
    f"list_transform(list_filter(list_transform(range(1, greatest(len(w) - {n - 1}, 1) + 1), lambda i: list_slice(w, i, i + {n - 1})), lambda g: len(g) = {n} AND len(list_intersect(g, stop)) = 0), lambda g: array_to_string(g, ' ')){')' if n == 3 else ''}" for n in (2, 3, 4)
) + ")"


@query("SELECT id, unnest(list_distinct(" + _GRAMS + ")) AS phrase FROM (SELECT id, regexp_extract_all(lower(coalesce(title, '')), '[a-z0-9][a-z0-9-]*') AS w, [" + ", ".join("'" + w.replace("'", "''") + "'" for w in t.SECTION_STOPWORDS) + "] AS stop FROM papers)")
def title_phrases(x: Tables) -> DataFrame:
    return x.papers.select("id", F.explode(segment.title_phrases("title")).alias("phrase"))
