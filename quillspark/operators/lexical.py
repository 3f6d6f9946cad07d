"""Lexical ranking: BM25, section scope, overlap, interest profiles, rank fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as t


def top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows with their rank. Sort and limit first, so that only k rows are ever numbered in one place."""
    return df.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def top_per(df: DataFrame, by: list[str], k: int, *order: Column) -> DataFrame:
    """The first k rows of each group with their rank; Spark cuts groups before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def _count(tokens: str, word: str) -> Column:
    return F.size(F.filter(tokens, lambda x: x == word))


def bm25(docs: DataFrame, query: str, weights: dict[str, float], k1: float = 1.5, b: float = 0.75, id_col: str = "id") -> DataFrame:
    """id, score of documents with a query term: BM25 of every field by its weight, times half plus the share of query terms present.

    Terms are columns: one pass counts documents, lengths and document frequencies (one row), one scores; nothing is
    exploded, grouped or shuffled.
    """
    spark = docs.sparkSession
    terms = spark.range(1).select(F.explode(F.array_distinct(t.rank_terms(F.lit(query)))).alias("term"))
    wanted = [r.term for r in terms.collect()]  # the words of one query
    if not wanted:
        return docs.select(F.col(id_col).alias("id"), F.lit(0.0).alias("score")).where("false")
    fields = list(weights)
    tokens = docs.select(F.col(id_col).alias("id"), *[t.rank_terms(f).alias(f) for f in fields])
    pairs = [(f, i) for f in fields for i in range(len(wanted))]
    base = tokens.select("id", *[F.size(f).alias(f"_l_{f}") for f in fields], *[_count(f, wanted[i]).alias(f"_t_{f}{i}") for f, i in pairs])
    stats = base.agg(F.count(F.lit(1)).alias("_n"), *[F.avg(f"_l_{f}").alias(f"_a_{f}") for f in fields], *[F.count_if(F.col(f"_t_{f}{i}") > 0).alias(f"_d_{f}{i}") for f, i in pairs])
    hits = base.where(" or ".join(f"`_t_{f}{i}` > 0" for f, i in pairs)).crossJoin(F.broadcast(stats))  # one row
    part = F.lit(0.0)
    for f, i in pairs:
        tf, df = F.col(f"_t_{f}{i}"), F.col(f"_d_{f}{i}")
        idf = F.log(1 + (F.col("_n") - df + 0.5) / (df + 0.5))
        part = part + F.when(tf > 0, weights[f] * idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col(f"_l_{f}") / F.col(f"_a_{f}")))).otherwise(0.0)
    present = F.lit(0)
    for i in range(len(wanted)):
        present = present + F.greatest(*[F.col(f"_t_{f}{i}") for f in fields], F.lit(0)).cast("boolean").cast("int")
    return hits.select("id", (part * (0.5 + present / len(wanted))).alias("score"))


def section_scope(terms: DataFrame, nodes: DataFrame, query: str) -> DataFrame:
    """paper_id, node_id, score, matched: nodes scored by idf x (1 + log10 tf + 6 for a title term, else 1.5 for a path term)."""
    wanted = terms.sparkSession.range(1).select(F.explode(F.array_distinct(t.section_terms(F.lit(query)))).alias("term"))
    one = nodes.groupBy("paper_id", "node_id").agg(F.min("title").alias("title"), F.min("section_path").alias("section_path"))
    total = one.agg(F.count(F.lit(1)).alias("n"))
    hits = terms.select("paper_id", "node_id", F.lower("term").alias("term"), "tf").join(F.broadcast(wanted), "term").groupBy("paper_id", "node_id", "term").agg(F.max("tf").alias("tf"))
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    joined = hits.join(one, ["paper_id", "node_id"]).join(F.broadcast(df), "term").crossJoin(F.broadcast(total))  # a row for each query term; one row
    own, path = F.array_contains(t.section_terms("title"), F.col("term")), F.array_contains(t.section_terms("section_path"), F.col("term"))
    weight = 1 + F.log10(F.greatest(F.coalesce("tf", F.lit(1)), F.lit(1))) + F.when(own, 6.0).when(path, 1.5).otherwise(0.0)
    return joined.withColumn("s", F.log10(1 + F.col("n") / F.col("df")) * weight).groupBy("paper_id", "node_id").agg(F.sum("s").alias("score"), F.count(F.lit(1)).alias("matched"))


def overlap(docs: DataFrame, query: str, text_col: str, id_col: str = "id") -> DataFrame:
    """id, score: share of the query's words (three or more letters) that a document has."""
    q = F.array_distinct(t.all_matches(F.lower(F.lit(query)), r"[a-z][a-z0-9-]{2,}"))
    d = F.array_distinct(t.all_matches(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[a-z][a-z0-9-]{2,}"))
    return docs.select(F.col(id_col).alias("id"), (F.size(F.array_intersect(q, d)) / F.size(q)).alias("score"))


def fuse(rankings: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion: id, score from rows (id, rank, weight)."""
    return rankings.groupBy("id").agg(F.sum(F.col("weight") / (k + F.col("rank"))).alias("score"))


def interest_profile(papers: DataFrame, half_life: float = 365.0, floor: float = 0.1, title_weight: float = 1.0, venue_weight: float = 0.5) -> DataFrame:
    """term, weight (0 to 1), df: over all papers the best source weight of a term times the paper's recency, over the largest sum."""
    base = papers.agg(F.max("created_at").alias("newest"))
    age = F.greatest((F.unix_micros(F.col("newest").cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))) / 86400e6, F.lit(0.0))
    recency = F.when(F.col("created_at").isNull(), floor).otherwise(F.greatest(F.lit(floor), F.pow(F.lit(0.5), age / half_life)))
    venue = t.norm_query("venue")
    each = papers.crossJoin(F.broadcast(base)).select(  # one row
        "id", recency.alias("recency"), F.concat(F.transform(t.profile_terms("title"), lambda x: F.struct(x.alias("term"), F.lit(title_weight).alias("w"))), F.when(F.length(venue) >= 2, F.array(F.struct(venue.alias("term"), F.lit(venue_weight).alias("w")))).otherwise(F.array())).alias("x")
    ).select("id", "recency", F.explode("x").alias("x"))
    best = each.groupBy("id", F.col("x.term").alias("term")).agg((F.max("x.w") * F.max("recency")).alias("w"))
    sums = best.groupBy("term").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("df"))
    return sums.crossJoin(F.broadcast(sums.agg(F.max("w").alias("top")))).select("term", (F.col("w") / F.col("top")).alias("weight"), "df")  # one row


def batch_idf(batch: DataFrame, text: Column, vocabulary: DataFrame, least: int = 20) -> DataFrame:
    """term, df, idf of vocabulary terms within a batch: ln((N+1)/(df+1)) / ln(N+1), 1 for batches under `least`."""
    total = batch.agg(F.count(F.lit(1)).alias("n"))
    seen = batch.select(F.explode(t.profile_terms(text)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    joined = vocabulary.select("term").join(seen, "term", "left").na.fill(0, ["df"]).crossJoin(F.broadcast(total))  # one row
    return joined.select("term", "df", F.when(F.col("n") < least, 1.0).otherwise(F.log((F.col("n") + 1) / (F.col("df") + 1)) / F.log(F.col("n") + 1)).alias("idf"))
