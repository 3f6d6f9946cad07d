"""Phrase search over any texts with BM25, fallback by containment, best hits of each paper, fusion with vectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fields as f
from .lexical import top, top_per

K1, B, SHORTEST = 1.2, 0.75, 3  # fixed values: saturation, length, shortest phrase of the trigram index
TYPE_WEIGHTS = {"table": 1.2, "formula": 1.2}  # fixed values: what is asked for by type counts more


def terms_of(docs: DataFrame, query: str, least: int = SHORTEST) -> list[str]:
    """Lower-case phrases of one query."""
    row = docs.sparkSession.range(1).select(f.search_terms(F.lit(query)).alias("t")).first()
    return list(dict.fromkeys(t.lower() for t in row.t if len(t) >= least))


def _sum(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def _frequency(text: Column, term: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)


def phrase_scores(docs: DataFrame, query: str, fields: list[str], keys: list[str]) -> DataFrame:
    """keys, score of the texts that contain a phrase of the query, by BM25 over all fields together.

    One pass for the counts (one row, a column for each phrase) and one for the scores; nothing is exploded or shuffled.
    """
    terms = terms_of(docs, query)
    if not terms:
        return docs.select(*keys, F.lit(0.0).alias("score")).where("false")
    low = [F.lower(F.coalesce(F.col(c), F.lit(""))) for c in fields]
    base = docs.select(*keys, _sum([F.greatest(F.length(t) - 2, F.lit(0)) for t in low]).alias("_d"), *[_sum([_frequency(t, w) for t in low]).alias(f"_t{i}") for i, w in enumerate(terms)])
    stats = base.agg(F.count(F.lit(1)).alias("_n"), F.avg("_d").alias("_avg"), *[F.count_if(F.col(f"_t{i}") > 0).alias(f"_f{i}") for i in range(len(terms))])
    part = lambda i: F.greatest(F.log((F.col("_n") - F.col(f"_f{i}") + 0.5) / (F.col(f"_f{i}") + 0.5)), F.lit(1e-6)) * F.col(f"_t{i}") * (K1 + 1) / (F.col(f"_t{i}") + K1 * (1 - B + B * F.col("_d") / F.col("_avg")))
    hits = base.where(" or ".join(f"_t{i} > 0" for i in range(len(terms)))).crossJoin(F.broadcast(stats))  # one row
    return hits.select(*keys, _sum([F.when(F.col(f"_t{i}") > 0, part(i)).otherwise(0.0) for i in range(len(terms))]).alias("score"))


def containment_scores(docs: DataFrame, query: str, title: str, body: str, key: str = "id") -> DataFrame:
    """key, score: two for each term in the title, one in the body."""
    terms = terms_of(docs, query, 2)
    has = lambda c, w: F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(w)).cast("int")
    if not terms:
        return docs.select(key, F.lit(0.0).alias("score")).where("false")
    return docs.select(key, _sum([2.0 * has(title, w) + has(body, w) for w in terms]).alias("score")).where("score > 0")


def search(docs: DataFrame, query: str, title: str, body: str, key: str = "id") -> DataFrame:
    """key, score: phrases by BM25; where no text has a phrase, containment of shorter terms."""
    hits = phrase_scores(docs, query, [title, body], [key])
    found = hits.agg(F.count(F.lit(1)).alias("_n"))
    other = containment_scores(docs, query, title, body, key).crossJoin(F.broadcast(found)).where("_n = 0").drop("_n")  # one row
    return hits.unionByName(other)


def best_hits(chunks: DataFrame, query: str, text: str, group: str, key: str, limit: int = 50, each: int = 4) -> DataFrame:
    """group, key, score, rank, hit_no: of the first 4 x limit hits the best `each` of every group; rank counts all hits."""
    scored = phrase_scores(chunks, query, [text], [group, key]).withColumn("score", F.round("score", 9))
    first = top(scored, 4 * limit, F.desc("score"), F.asc(key))
    return top_per(first.withColumnRenamed("rank", "r"), [group], each, F.asc("r")).withColumnRenamed("rank", "hit_no").withColumnRenamed("r", "rank")


def ranked_groups(hits: DataFrame, group: str, k: int) -> DataFrame:
    """id, rank of the groups by their best hit."""
    best = hits.groupBy(F.col(group).alias("id")).agg(F.min("rank").alias("first"))
    return top(best, k, F.asc("first"), F.asc("id")).select("id", "rank")


def merged_hits(lexical: DataFrame, vector: DataFrame, group: str, key: str) -> DataFrame:
    """group, key, via, place: hits of vectors before those of words, each key once. Both sides: group, key, rank."""
    both = vector.select(group, key, "rank", F.lit(0).alias("src")).unionByName(lexical.select(group, key, "rank", F.lit(1).alias("src")))
    one = both.groupBy(group, key).agg(F.min(F.struct("src", "rank")).alias("m"))
    out = top_per(one.select(group, key, "m.src", "m.rank").withColumnRenamed("rank", "r"), [group], 1 << 30, F.asc("src"), F.asc("r"), F.asc(key))
    return out.select(group, key, F.when(F.col("src") == 0, "vector").otherwise("lexical").alias("via"), F.col("rank").alias("place"))


def fuse_named(rankings: dict[str, tuple[DataFrame, float]], k: int, rrf: int = 60) -> DataFrame:
    """id, score, rank, sources of the k best: reciprocal ranks by weight; an absent ranking (None) simply adds nothing."""
    parts = [df.select("id", "rank", F.lit(float(w)).alias("w"), F.lit(name).alias("source")) for name, (df, w) in rankings.items() if df is not None]
    fused = reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.round(F.sum(F.col("w") / (rrf + F.col("rank"))), 12).alias("score"), F.array_sort(F.collect_set("source")).alias("sources"))
    return top(fused, k, F.desc("score"), F.asc("id"))


def first_of(*ordered: DataFrame, key: str = "id") -> DataFrame:
    """key, stage, rank: the union of ranked lists in their order, everything at its first place."""
    both = reduce(DataFrame.unionByName, [d.select(key, "rank", F.lit(i).alias("stage")) for i, d in enumerate(ordered)])
    return both.groupBy(key).agg(F.min(F.struct("stage", "rank")).alias("m")).select(key, "m.stage", "m.rank")
