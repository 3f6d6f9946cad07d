"""Batch runs of the stream operators: the same code on a finished table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import vectors
from ..streaming import usage
from .registry import Tables, query


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS begin, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def hourly_usage(x: Tables) -> DataFrame:
    return usage.windowed_usage(x.events).select(F.col("begin").cast("timestamp_ntz").alias("begin"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    "SELECT user_id, min(ts) AS begin, max(ts) + INTERVAL 6 HOUR AS \"end\", count(*) AS n FROM (SELECT *, sum(CASE WHEN g IS NULL OR g >= 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS g FROM events)) GROUP BY user_id, s"
)
def session_windows(x: Tables) -> DataFrame:
    return usage.sessions(x.events).select("user_id", F.col("begin").cast("timestamp_ntz").alias("begin"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("SELECT norm_key, max(updated_at) AS ts FROM citation_nodes WHERE norm_key IS NOT NULL AND updated_at >= (SELECT max(updated_at) FROM citation_nodes) - INTERVAL 30 DAY GROUP BY norm_key")
def cache_hits(x: Tables) -> DataFrame:
    """Cached nodes that are fresh enough to be used."""
    n = x.citation_nodes.where("norm_key is not null and updated_at is not null")
    now = F.lit(n.agg(F.max("updated_at")).first()[0]).cast("timestamp")
    c = usage.fresh_cache(n.select("norm_key", F.col("updated_at").cast("timestamp").alias("ts")), now, 30, "norm_key")
    return c.select("norm_key", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("SELECT d.digest_id, d.norm_key, p.id AS library_id, p.id IS NOT NULL AS in_library FROM digest_items d LEFT JOIN (SELECT norm_key, min(id) AS id FROM papers WHERE norm_key IS NOT NULL GROUP BY norm_key) p USING (norm_key)")
def items_with_library(x: Tables) -> DataFrame:
    return usage.with_library(x.digest_items.select("digest_id", "norm_key"), x.papers)


@query("SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE event_type IS DISTINCT FROM b OR event_id IN (SELECT min(event_id) FROM events GROUP BY user_id)")
def progress_changes(x: Tables) -> DataFrame:
    return usage.changes_only(x.events.select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type")


@query("SELECT count(*) AS good, 0 AS rejected FROM events WHERE json_valid(props)")
def parsed_properties(x: Tables) -> DataFrame:
    good, bad = usage.split_malformed(x.events.select(F.col("props").alias("value")), "k bigint")
    return good.agg(F.count(F.lit(1)).alias("good")).crossJoin(bad.agg(F.count(F.lit(1)).alias("rejected")))  # one row each


@query("SELECT label, count(*) AS items, count(*) FILTER (WHERE vec_id IN (SELECT id FROM papers)) AS indexed, round(count(*) FILTER (WHERE vec_id IN (SELECT id FROM papers)) / count(*), 4) AS ratio, bool_and(vec_id IN (SELECT id FROM papers)) AS whole FROM embeddings GROUP BY label")
def vector_coverage(x: Tables) -> DataFrame:
    return vectors.coverage(x.embeddings, x.papers.select(F.col("id").alias("vec_id")), "vec_id", "label")


@query("SELECT id, title FROM papers WHERE id NOT IN (SELECT vec_id FROM embeddings)")
def papers_without_vectors(x: Tables) -> DataFrame:
    return vectors.unindexed(x.papers.select("id", "title"), x.embeddings.select(F.col("vec_id").alias("id")), "id")


@query(
    "SELECT label, arg_max(id, struct_pack(a := score, b := -id)) AS id, max(score) AS score FROM (SELECT v.label, v.vec_id AS id, round(list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))) / ((sqrt(list_sum(list_transform(v.embedding, lambda e: CAST(e AS DOUBLE) * e))) + 1e-9) * (sqrt(list_sum(list_transform(q.embedding, lambda e: CAST(e AS DOUBLE) * e))) + 1e-9)), 6) AS score "
    "FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = (SELECT max(vec_id) FROM embeddings)) q) GROUP BY label"
)
def best_of_groups(x: Tables) -> DataFrame:
    """The vector of each label nearest to the last vector."""
    asked = x.embeddings.orderBy(F.desc("vec_id")).select("embedding").first()[0]
    return vectors.best_of_group(x.embeddings, asked, "label").withColumn("score", F.round("score", 6))


@query("SELECT a.vec_id, a.label = b.label AS same FROM embeddings a JOIN embeddings b USING (vec_id)")
def same_spaces(x: Tables) -> DataFrame:
    """Every vector against its own copy: the space is the same."""
    return vectors.same_space(x.embeddings, x.embeddings).select("vec_id", "same")
