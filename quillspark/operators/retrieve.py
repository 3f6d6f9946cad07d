"""Multi-stage retrieval: scope then passages, and feedback expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as t
from ..session import cut
from . import lexical, segment, tree


def passage_search(terms: DataFrame, nodes: DataFrame, query: str, top_nodes: int = 30, k: int = 10) -> DataFrame:
    """paper_id, node_id, offset, passage, score, rank: the best passage of each selected node.

    Stage one ranks nodes by their postings; stage two reads the text of those only. A passage scores idf x (1 + log10 tf)
    for its terms, 2 for the share of query terms, up to 0.3 for standing early, 1.5 x idf for title terms, and a tenth
    of its node's score.
    """
    scope = lexical.top(lexical.section_scope(terms, nodes, query), top_nodes, F.desc(F.round("score", 9)), F.asc("paper_id"), F.asc("node_id"))
    wanted = F.array_distinct(t.section_terms(F.lit(query)))
    total = nodes.select("paper_id", "node_id").distinct().agg(F.count(F.lit(1)).alias("n"))
    picked = nodes.select("id", "paper_id", "node_id", "title", "body").join(F.broadcast(scope.select("paper_id", "node_id", F.col("score").alias("prior"))), ["paper_id", "node_id"])  # at most top_nodes rows
    chosen = cut(tree.one_per_node(picked))  # texts of the selected nodes only; stage one runs once
    q = terms.sparkSession.range(1).select(F.explode(wanted).alias("term"))
    df = terms.select("paper_id", "node_id", F.lower("term").alias("term")).join(F.broadcast(q), "term").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    parts = tree.passages(chosen).join(chosen.select("id", "paper_id", "node_id", "title", "prior"), "id")
    last = parts.groupBy("id").agg(F.max("passage_no").alias("m"))
    hits = parts.join(last, "id").withColumn("terms", t.section_terms("passage")).withColumn("own", t.section_terms("title"))
    each = hits.select("paper_id", "node_id", "offset", "passage", "passage_no", "m", "prior", "terms", "own", F.explode(wanted).alias("term"))
    each = each.withColumn("tf", F.size(F.filter("terms", lambda x: x == F.col("term")))).where("tf > 0").join(F.broadcast(df), "term").crossJoin(F.broadcast(total))  # a row for each query term; one row
    idf = F.log10(1 + F.col("n") / F.col("df"))
    scored = each.groupBy("paper_id", "node_id", "offset", "passage", "passage_no", "m", "prior").agg(
        F.sum(idf * (1 + F.log10("tf")) + F.when(F.array_contains("own", F.col("term")), 1.5 * idf).otherwise(0.0)).alias("s"), F.count(F.lit(1)).alias("c")
    )
    score = F.col("s") + 2 * F.col("c") / F.size(wanted) + 0.3 * (1 - (F.col("passage_no") - 1) / F.col("m")) + 0.1 * F.col("prior")
    best = lexical.top_per(scored.select("paper_id", "node_id", "offset", "passage", F.round(score, 9).alias("score")), ["paper_id", "node_id"], 1, F.desc("score"), F.asc("offset")).drop("rank")
    return lexical.top(best, k, F.desc("score"), F.asc("paper_id"), F.asc("node_id"), F.asc("offset"))


def expanded_search(docs: DataFrame, query: str, weights: dict[str, float], title: str = "title", k: int = 10, feedback: int = 5, more: int = 2, appended: bool = True) -> DataFrame:
    """id, rank: the first ranking, then what queries derived from its best titles add (or both fused with weight 0.6).

    A derived query is the first one with the phrase that most of the first `feedback` titles share and that it lacks.
    """
    first = lexical.top(lexical.bm25(docs, query, weights).withColumn("score", F.round("score", 9)), k, F.desc("score"), F.asc("id")).select("id", "rank")
    titles = docs.join(F.broadcast(first.where(F.col("rank") <= feedback)), "id").select("id", F.explode(segment.title_phrases(title)).alias("phrase"))
    asked = query.lower()
    ranked = titles.where(~F.contains(F.lit(asked), F.col("phrase"))).groupBy("phrase").agg(F.count_distinct("id").alias("df")).orderBy(F.desc("df"), F.desc(F.length("phrase")), F.asc("phrase")).limit(more)
    phrases = [r.phrase for r in ranked.collect()]  # `more` rows
    runs = first.withColumn("run", F.lit(0))
    for i, p in enumerate(phrases, 1):
        again = lexical.top(lexical.bm25(docs, f"{query} {p}", weights).withColumn("score", F.round("score", 9)), k, F.desc("score"), F.asc("id")).select("id", "rank", F.lit(i).alias("run"))
        runs = runs.unionByName(again)
    if not appended:
        fused = lexical.fuse(runs.select("id", "rank", F.when(F.col("run") == 0, 1.0).otherwise(0.6).alias("weight")))
        return lexical.top(fused.withColumn("score", F.round("score", 12)), k, F.desc("score"), F.asc("id")).select("id", "rank")
    best = runs.groupBy("id").agg(F.min(F.struct("run", "rank")).alias("b")).select("id", "b.run", F.col("b.rank").alias("r"))
    return lexical.top(best, 2 * k, F.asc("run"), F.asc("r"), F.asc("id")).select("id", "rank")
