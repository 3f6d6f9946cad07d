"""Rebuilt texts, located evidence, as-of joins, moving windows, centroids and co-authorship."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import text as t
from ..operators import citations, graph, vectors
from .registry import Tables, query
from .scalars import NAMES


@query("SELECT id, array_to_string(list_filter(string_split(regexp_replace(abstract, '[ \\t\\r\\n\\f\\v]+', ' ', 'g'), ' '), lambda w: w <> ''), ' ') AS rebuilt FROM papers WHERE abstract IS NOT NULL AND abstract <> ''")
def rebuilt_abstracts(x: Tables) -> DataFrame:
    """Abstract as word to positions, and back: positions are sorted within a record only."""
    words = x.papers.where("abstract is not null and abstract <> ''").select("id", F.posexplode(F.filter(F.split(F.regexp_replace("abstract", t.SPACE, " "), " "), lambda w: w != "")).alias("pos", "word"))
    inverted = words.groupBy("id", "word").agg(F.collect_list("pos").alias("at"))
    return t.text_from_inverted(inverted, "id")


@query(
    f"SELECT id, regexp_replace(replace(array_to_string(list_slice({NAMES}, 1, 3), ', ') || CASE WHEN len({NAMES}) > 3 THEN ', 等' ELSE '' END || '. ' || title || '[J]. ' || CASE WHEN coalesce(venue, '') <> '' THEN venue WHEN coalesce(arxiv_id, '') <> '' THEN 'arXiv preprint' ELSE '' END "
    "|| ', ' || coalesce(CAST(nullif(year, 0) AS VARCHAR), '') || '.', ' .', '.'), '[ \\t\\r\\n\\f\\v]+', ' ', 'g') AS entry FROM papers"
)
def gbt_references(x: Tables) -> DataFrame:
    return x.papers.select("id", citations.gbt().alias("entry"))


_CELLS = "(VALUES ('coverage'), ('baseline'), ('percent'), ('accuracy'))"


@query(
    f"WITH s AS (SELECT id, unnest(range(1, len(a) + 1)) AS n, unnest(a) AS sentence FROM (SELECT id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(abstract, '([。！？!?])', '\\1' || chr(1), 'g'), '([.]) +([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: trim(s)), lambda s: length(s) >= 12) AS a FROM papers WHERE abstract IS NOT NULL)) "
    f"SELECT id, k AS field, arg_min(sentence, n) AS sentence, min(n) AS sentence_no FROM s JOIN {_CELLS} v(k) ON contains(lower(sentence), k) GROUP BY id, k"
)
def located_cells(x: Tables) -> DataFrame:
    """Papers by fields: the first sentence that names the field."""
    s = x.papers.where("abstract is not null").select("id", F.posexplode(t.sentences("abstract")).alias("i", "sentence")).withColumn("field", F.explode(F.array(*[F.lit(k) for k in ("coverage", "baseline", "percent", "accuracy")])))
    return s.where(F.contains(F.lower("sentence"), F.col("field"))).groupBy("id", "field").agg(F.min_by("sentence", "i").alias("sentence"), (F.min("i") + 1).cast("bigint").alias("sentence_no"))


_Q = "['lexical', 'baseline', 'for', 'the', 'context', 'window']"


@query(f"SELECT id, round(least(1.0, 0.65 * len(list_intersect({_Q}, regexp_extract_all(lower(title), '[a-z][a-z0-9-]{{2,}}|[一-鿿]{{2,}}'))) / 6.0 + 0.35 * len(list_intersect({_Q}, regexp_extract_all(lower(coalesce(abstract, '')), '[a-z][a-z0-9-]{{2,}}|[一-鿿]{{2,}}'))) / 6.0), 6) AS score FROM papers")
def anchor_scores(x: Tables) -> DataFrame:
    pattern = f"[a-z][a-z0-9-]{{2,}}|[{t.HAN}]{{2,}}"
    q = F.array_distinct(t.all_matches(F.lit("lexical baseline for the context window"), pattern))
    share = lambda c: F.size(F.array_intersect(q, t.all_matches(F.lower(F.coalesce(c, F.lit(""))), pattern))) / F.size(q)
    return x.papers.select("id", F.round(F.least(F.lit(1.0), 0.65 * share("title") + 0.35 * share("abstract")), 6).alias("score"))


@query("WITH a AS (SELECT DISTINCT norm_key, unnest(authors) AS author FROM papers WHERE norm_key IS NOT NULL) SELECT a.author AS author_a, b.author AS author_b, count(*) AS works FROM a JOIN a b ON a.norm_key = b.norm_key AND a.author < b.author GROUP BY ALL HAVING count(*) >= 2")
def coauthors(x: Tables) -> DataFrame:
    a = x.papers.where("norm_key is not null").select("norm_key", F.explode("authors").alias("author_a")).distinct()
    return graph.co_counts(a, "norm_key", "author_a").select(F.col("key_a").alias("author_a"), F.col("key_b").alias("author_b"), F.col("n").alias("works"))


@query("SELECT p.id, max(n.updated_at) AS known_since FROM papers p LEFT JOIN citation_nodes n ON n.norm_key = p.norm_key AND n.updated_at <= p.created_at GROUP BY p.id")
def metadata_as_of_import(x: Tables) -> DataFrame:
    """As-of join as one sorted pass: both sides in one stream for each key, the last refresh carried forward."""
    left = x.papers.select("norm_key", F.col("created_at").alias("at"), "id", F.lit(None).cast("timestamp_ntz").alias("seen"), F.lit(1).alias("side"))
    right = x.citation_nodes.select("norm_key", F.col("updated_at").alias("at"), F.lit(None).cast("bigint").alias("id"), F.col("updated_at").alias("seen"), F.lit(0).alias("side"))
    w = Window.partitionBy("norm_key").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    return left.unionByName(right.where("updated_at is not null")).withColumn("known_since", F.max("seen").over(w)).where("side = 1").select("id", "known_since")


@query("SELECT event_type, day, n, round(avg(n) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS weekly, CAST(sum(n) OVER (PARTITION BY event_type ORDER BY day) AS BIGINT) AS so_far FROM (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL)")
def moving_usage(x: Tables) -> DataFrame:
    d = x.events.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("event_type").orderBy("day")
    return d.select("event_type", "day", "n", F.round(F.avg("n").over(w.rowsBetween(-6, 0)), 6).alias("weekly"), F.sum("n").over(w).alias("so_far"))


@query("SELECT label, CAST(d AS INT) AS dimension, round(avg(v), 5) AS centre FROM (SELECT label, unnest(range(0, len(embedding))) AS d, unnest(embedding) AS v FROM embeddings) GROUP BY ALL")
def centroids(x: Tables) -> DataFrame:
    return x.embeddings.select("label", F.posexplode("embedding").alias("dimension", "v")).groupBy("label", "dimension").agg(F.round(F.avg(F.col("v").cast("double")), 5).alias("centre"))


@query("SELECT len(embedding) AS dimension, count(*) AS vectors, count(*) FILTER (WHERE abs(sqrt(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * v))) - 1) < 0.001) AS units FROM embeddings GROUP BY ALL")
def vector_health(x: Tables) -> DataFrame:
    v = F.col("embedding")
    return x.embeddings.groupBy(F.size(v).cast("bigint").alias("dimension")).agg(F.count(F.lit(1)).alias("vectors"), F.count_if(F.abs(F.sqrt(vectors.dot(v, v)) - 1) < 0.001).alias("units"))


@query("SELECT year, n, citations, CAST(sum(n) OVER (ORDER BY year) AS BIGINT) AS up_to FROM (SELECT year, count(*) AS n, sum(coalesce(citation_count, 0)) AS citations FROM papers WHERE year BETWEEN 1900 AND 2026 GROUP BY year)")
def works_by_year(x: Tables) -> DataFrame:
    y = x.papers.where("year between 1900 and 2026").groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("citation_count", F.lit(0))).alias("citations"))
    return y.withColumn("up_to", F.sum("n").over(Window.orderBy("year")))  # at most one row for each year of the range


@query("SELECT digest_id, norm_key, reason, CAST(count(*) AS BIGINT) AS n FROM (SELECT digest_id, norm_key, unnest(CAST(json_extract_string(reasons_json, '$[*]') AS VARCHAR[])) AS reason FROM digest_items WHERE reasons_json IS NOT NULL) GROUP BY ALL")
def digest_reasons(x: Tables) -> DataFrame:
    return x.digest_items.where("reasons_json is not null").select("digest_id", "norm_key", F.explode(F.from_json("reasons_json", "array<string>")).alias("reason")).groupBy("digest_id", "norm_key", "reason").agg(F.count(F.lit(1)).alias("n"))
