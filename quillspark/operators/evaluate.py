"""Measures: recall and precision at k, confusion, per-class scores, paired sign-flip test."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F


def recall_at(hits: DataFrame, gold: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """k, recall: mean over queries of the share of gold ids (query_id, id) among the first k hits (query_id, id, rank)."""
    j = gold.select("query_id", "id").distinct().join(hits.select("query_id", "id", "rank"), ["query_id", "id"], "left")
    each = j.groupBy("query_id").agg(*[F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)).alias(f"k{k}") for k in ks])
    means = each.agg(*[F.avg(f"k{k}").alias(f"k{k}") for k in ks])
    return means.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("recall")) for k in ks])).alias("x")).select("x.*")


def recall_by_size(queries: DataFrame, right: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """k, recall: the same where gold is known by its size (query_id, gold) and the hits that are gold (query_id, rank): no gold pairs are ever listed."""
    found = right.groupBy("query_id").agg(*[F.count_if(F.col("rank") <= k).alias(f"k{k}") for k in ks])
    each = queries.join(found, "query_id", "left").select(*[(F.coalesce(f"k{k}", F.lit(0)) / F.col("gold")).alias(f"k{k}") for k in ks])
    means = each.agg(*[F.avg(f"k{k}").alias(f"k{k}") for k in ks])
    return means.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("recall")) for k in ks])).alias("x")).select("x.*")


def confusion(pairs: DataFrame, gold: str, guess: str) -> DataFrame:
    return pairs.groupBy(F.col(gold).alias("gold"), F.col(guess).alias("guess")).agg(F.count(F.lit(1)).alias("n"))


def class_scores(matrix: DataFrame) -> DataFrame:
    """label, precision, recall, f1 from a confusion table; a score without cases is null."""
    g = matrix.groupBy(F.col("gold").alias("label")).agg(F.sum("n").alias("of_gold"), F.sum(F.when(F.col("gold") == F.col("guess"), F.col("n")).otherwise(0)).alias("right"))
    p = matrix.groupBy(F.col("guess").alias("label")).agg(F.sum("n").alias("of_guess"))
    j = g.join(p, "label", "full").na.fill(0)
    return j.select("label", F.try_divide("right", "of_guess").alias("precision"), F.try_divide("right", "of_gold").alias("recall"), (2 * F.col("right") / (F.col("of_guess") + F.col("of_gold"))).alias("f1"))


def sign_flip(pairs: DataFrame, before: str, after: str, rounds: int = 20_000, seed: int = 20260903) -> DataFrame:
    """n, n_changed, mean_before, mean_after, p_value of a paired two-sided sign-flip test.

    Differences are grouped by size first, so what a round draws is a binomial for each distinct difference. Tasks sum
    their differences' shares of every round; the rounds are summed over the tasks.
    """
    d = pairs.select((F.col(after) - F.col(before)).cast("double").alias("d"))
    means = pairs.agg(F.count(F.lit(1)).alias("n"), F.avg(before).alias("mean_before"), F.avg(after).alias("mean_after"))
    sizes = d.where("d <> 0").groupBy(F.abs(F.round("d", 9)).alias("size")).agg(F.count(F.lit(1)).alias("m"), F.sum(F.when(F.col("d") > 0, 1).otherwise(-1)).alias("s"))

    def draw(batches):
        # what a difference brings to each round depends on itself and the seed alone, wherever it is computed
        total = np.zeros(rounds)
        for pdf in batches:
            for size, m in zip(pdf["size"].to_numpy(), pdf["m"].to_numpy(np.int64)):
                rng = np.random.default_rng([seed, int(round(size * 1e9))])
                total += (2 * rng.binomial(m, 0.5, rounds) - m) * size
        if total.any():
            import pandas as pd

            yield pd.DataFrame({"round": np.arange(rounds), "x": total})

    drawn = sizes.select("size", "m").mapInPandas(draw, "round bigint, x double").groupBy("round").agg(F.sum("x").alias("x"))
    seen = sizes.agg(F.abs(F.coalesce(F.sum(F.col("size") * F.col("s")), F.lit(0.0))).alias("seen"), F.coalesce(F.sum("m"), F.lit(0)).alias("n_changed"))
    extreme = drawn.crossJoin(F.broadcast(seen)).agg(F.count_if(F.abs("x") >= F.col("seen") - 1e-9).alias("e"))  # one row
    p = F.when(F.col("n_changed") == 0, 1.0).otherwise((F.col("e") + 1) / F.lit(rounds + 1))
    return means.crossJoin(F.broadcast(seen)).crossJoin(F.broadcast(extreme)).select("n", "n_changed", "mean_before", "mean_after", p.alias("p_value"))  # one row each


def citation_measures(hits: DataFrame, gold: DataFrame) -> DataFrame:
    """queries, precision, verified_rate: means over queries of the share of recommended ids (query_id, id, verified) that are gold (query_id, id), and of those with evidence that was found again."""
    g = gold.select("query_id", "id").distinct().withColumn("_g", F.lit(1.0))
    each = hits.join(g, ["query_id", "id"], "left").groupBy("query_id").agg(F.avg(F.coalesce("_g", F.lit(0.0))).alias("p"), F.avg(F.col("verified").cast("double")).alias("v"))
    return each.agg(F.count(F.lit(1)).alias("queries"), F.avg("p").alias("precision"), F.avg("v").alias("verified_rate"))


def described(result: DataFrame, alpha: float = 0.05) -> DataFrame:
    """A sentence about a paired test (n, n_changed, mean_before, mean_after, p_value): a direction is only claimed if it is significant."""
    d = F.round(F.col("mean_after") - F.col("mean_before"), 4)
    way = F.when(d > 0, "up").when(d < 0, "down").otherwise("equal")
    told = F.when(F.col("n") == 0, "no data").when(F.col("n_changed") == 0, "nothing changed").when(F.col("p_value") < alpha, F.concat(F.lit("significantly "), way)).otherwise(F.concat(way, F.lit(", not significant")))
    return result.select("n", "n_changed", d.alias("difference"), "p_value", told.alias("told"))


def flips(pairs: DataFrame, before: str, after: str) -> DataFrame:
    """The whole distribution behind the sign-flip test when all differences are one size: n_plus, n_minus, p_value of the exact binomial test, two-sided."""
    d = pairs.select(F.signum(F.col(after) - F.col(before)).alias("s")).where("s <> 0")
    n = d.agg(F.count_if(F.col("s") > 0).alias("plus"), F.count_if(F.col("s") < 0).alias("minus"))
    # log of n! by its series: sums of logarithms over a sequence, no factorials
    log_choose = lambda a, b: F.aggregate(F.sequence(F.lit(1), F.greatest(b, F.lit(1))), F.lit(0.0), lambda s, k: s + F.when(k <= b, F.log((a - b + k).cast("double")) - F.log(k.cast("double"))).otherwise(0.0))
    total, least = (F.col("plus") + F.col("minus")).cast("int"), F.least("plus", "minus").cast("int")
    tail = F.aggregate(F.sequence(F.lit(0), least), F.lit(0.0), lambda s, k: s + F.exp(log_choose(total, k) - total * F.log(F.lit(2.0))))
    return n.select("plus", "minus", F.when(total == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail)).alias("p_value"))
