"""What of the papers goes into an answer: ranked chunks and pages, budgets, pinned papers, recommended citations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fields as f, text as t
from .lexical import top, top_per

#: Factor of a chunk that the search hit, of tables and formulas for questions about results, code points of all context.
HIT, STRUCTURED, BUDGET = 1.6, 1.35, 24_000


def _count(text: Column, term: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)


def _sum(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def ranked_chunks(chunks: DataFrame, terms: list[str], hits: DataFrame, each: int = 3, structured: bool = False, group: str = "paper_id", key: str = "id", text: str = "body", kind: str | None = None) -> DataFrame:
    """group, key, score, rank: of every paper the `each` chunks with most of the question's terms for their length, terms rare within the paper counting more.

    Counts of a paper are sums over its chunks (a column for each term), joined back by paper; a paper without any term
    has its hits (group, key, rank) in their order instead.
    """
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    base = chunks.select(group, key, F.greatest(F.length(low), F.lit(1)).alias("_d"), (F.col(kind) if kind else F.lit("text")).alias("_kind"), *[_count(low, w).alias(f"_t{i}") for i, w in enumerate(terms)])
    per = base.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(f"_t{i}") > 0).alias(f"_f{i}") for i in range(len(terms))])
    idf = lambda i: F.log(1 + (F.col("_n") - F.col(f"_f{i}") + 0.5) / (F.col(f"_f{i}") + 0.5))
    own = hits.select(group, key, F.col("rank").alias("_hit"))
    density = _sum([F.col(f"_t{i}") * idf(i) for i in range(len(terms))]) / F.sqrt("_d") * F.when(F.col("_hit").isNotNull(), HIT).otherwise(1.0)
    if structured:
        density = density * F.when(F.col("_kind").isin("table", "formula"), STRUCTURED).otherwise(1.0)
    some = _sum([F.col(f"_f{i}") for i in range(len(terms))]) > 0
    scored = base.join(per, group).join(own, [group, key], "left").where(some | F.col("_hit").isNotNull()).select(group, key, F.when(some, F.round(density, 9)).otherwise(-F.col("_hit").cast("double")).alias("score"))
    return top_per(scored, [group], each, F.desc("score"), F.asc(key))


def picked_pages(pages: DataFrame, terms: list[str], each: int = 3, group: str = "paper_id", page: str = "page", text: str = "body") -> DataFrame:
    """group, page, score, rank: the pages with most terms for the root of their length; pages without any are left out."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    raw = _sum([_count(low, w) for w in terms])
    scored = pages.select(group, page, F.round(raw / F.sqrt(F.greatest(F.length(low), F.lit(1))), 9).alias("score")).where("score > 0")
    return top_per(scored, [group], each, F.desc("score"), F.asc(page))


def within_budget(items: DataFrame, order: str, size: str, budget: int = BUDGET) -> DataFrame:
    """Items in order that fit what is left of the budget; one that does not fit is skipped and the next ones are tried. items: one context, a bounded list."""
    rows = items.agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(size).alias("s")))).alias("a"))
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<bigint>").alias("kept"))
    step = lambda s, x: F.when(s["used"] + x["s"] <= budget, F.struct((s["used"] + x["s"]).cast("bigint").alias("used"), F.concat(s["kept"], F.array(x["o"].cast("bigint"))).alias("kept"))).otherwise(s)
    kept = rows.select(F.explode(F.aggregate("a", start, step, lambda s: s["kept"])).alias(order))
    return items.join(F.broadcast(kept), order, "left_semi")  # no more rows than the context has items


def carried_over(pinned: DataFrame, ranked: DataFrame, k: int) -> DataFrame:
    """id, place: papers a question points at first (at most k - 1), then the ranked ones, k together. Both: id, rank."""
    first = pinned.where(F.col("rank") <= k - 1).select("id", F.lit(0).alias("src"), "rank")
    every = first.unionByName(ranked.select("id", F.lit(1).alias("src"), "rank"))
    one = every.groupBy("id").agg(F.min(F.struct("src", "rank")).alias("m")).select("id", "m.src", F.col("m.rank").alias("r"))
    return top(one, k, F.asc("src"), F.asc("r"), F.asc("id")).select("id", F.col("rank").alias("place"))


def shares(paragraph: str, text: Column) -> Column:
    """Share of the paragraph's character pairs and words that a text has."""
    grams = lambda c: F.array_distinct(F.concat(F.filter(f.neighbours(c), lambda g: F.trim(g) != ""), t.all_matches(c, r"[a-z][a-z0-9-]{2,}")))
    q = grams(t.norm_query(F.lit(paragraph)))
    return F.size(F.array_intersect(q, grams(F.lower(F.regexp_replace(text, t.SPACE, " "))))) / F.size(q)


def recommended(papers: DataFrame, paragraph: str, anchor: Column, k: int = 5, pool: int = 10) -> DataFrame:
    """id, score, evidence, evidence_score, verified, mix, rank: papers to cite for a paragraph without vectors.

    The `pool` papers that share most with the paragraph, each with the sentence of its abstract that the paragraph covers
    best; those with a sentence that stands in the abstract come first, then by 0.45 score, 0.25 evidence, 0.30 anchor.
    """
    scored = papers.select("id", "abstract", F.round(shares(paragraph, F.concat_ws(" ", "title", F.coalesce("abstract", F.lit("")))), 9).alias("score"), F.round(anchor, 3).alias("anchor"))
    best = top(scored, pool, F.desc("score"), F.asc("id")).drop("rank")
    q = f.pairs_of(F.lit(paragraph))
    s = best.select("id", "abstract", F.posexplode(t.sentences(F.coalesce("abstract", F.lit("")))).alias("n", "sentence")).withColumn("own", f.pairs_of("sentence"))
    v = s.withColumn("e", F.size(F.array_intersect(q, "own")) / F.greatest(F.size("own"), F.lit(1))).where("e > 0")
    evidence = v.groupBy("id").agg(F.max_by("sentence", F.struct(F.round("e", 9), -F.col("n"))).alias("evidence"), F.round(F.max("e"), 3).alias("evidence_score"))
    j = best.join(evidence, "id", "left").withColumn("evidence_score", F.coalesce("evidence_score", F.lit(0.0)))
    j = j.withColumn("verified", F.col("evidence").isNotNull() & F.contains(f.squashed("abstract"), f.squashed("evidence")))
    j = j.withColumn("mix", F.round(0.45 * F.round("score", 3) + 0.25 * F.col("evidence_score") + 0.30 * F.col("anchor"), 9))
    return top(j.drop("abstract"), k, F.desc("verified"), F.desc("mix"), F.asc("id"))


def relevance(query: str, text: Column) -> Column:
    """Share of the query's words that a text has."""
    q = f.words_of(F.lit(query))
    return F.size(F.array_intersect(q, f.words_of(text))) / F.greatest(F.size(q), F.lit(1))


def evidence_for(claims: DataFrame, rows: DataFrame, most: int = 4) -> DataFrame:
    """claim_id, id, score, rank: for each claim (claim_id, paper_id, words) the rows (paper_id, id, words) of its paper with the largest share of its words, at most `most`.

    Claims and rows meet by paper and word, never as all pairs; equal counts of shared words come from one aggregation.
    """
    c = claims.select("claim_id", "paper_id", F.size("words").alias("size"), F.explode("words").alias("word"))
    r = rows.select("paper_id", "id", F.explode("words").alias("word"))
    hit = c.join(r, ["paper_id", "word"]).groupBy("claim_id", "id").agg(F.round(F.count(F.lit(1)) / F.first("size"), 9).alias("score"))
    return top_per(hit, ["claim_id"], most, F.desc("score"), F.asc("id"))


def numbered(uses: DataFrame, session: str, order: list[str], item: str) -> DataFrame:
    """session, item, number: items numbered by their first use within a session; a number never changes afterwards."""
    first = uses.groupBy(session, item).agg(F.min(F.struct(*order)).alias("_f"))
    return first.select(session, item, F.row_number().over(Window.partitionBy(session).orderBy("_f", item)).alias("number"))
