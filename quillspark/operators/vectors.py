"""Exact cosine search over stored vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    n = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x.cast("double") / (n + 1e-9))


def nearest(vectors: DataFrame, query: list[float], k: int, where: Column | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id, score of the k nearest by cosine, ties by id; the filter runs before any arithmetic. Wrong dimensions and NaN give no rows."""
    norm = float(np.sqrt(np.sum(np.square(query)))) + 1e-9
    q = F.array(*[F.lit(float(x) / norm) for x in query])
    v = F.col(vec_col)
    rows = vectors.where((F.size(v) == len(query)) & F.forall(v, lambda x: ~F.isnan(x)))
    if where is not None:
        rows = rows.where(where)
    return rows.select(F.col(id_col).alias("id"), dot(unit(v), q).alias("score")).orderBy(F.desc("score"), F.asc("id")).limit(k)


#: Vectors and queries that meet in one task.
ROWS, QUERIES = 50_000, 2_000


def nearest_many(vectors: DataFrame, queries: DataFrame, k: int, rows: int = ROWS, block: int = QUERIES, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, id, score, rank: the k nearest of every query, the query itself left out.

    Vectors lie in parts and queries in blocks, both of bounded size by the hash of their ids; each part meets each
    block in one task (one matrix product), which keeps the best k of each query, and the best k of those are merged.
    No vector passes the driver, and nothing is broadcast.
    """
    n, m = vectors.count(), queries.count()
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    parts, blocks = max(-(-n // rows), min(cores, n // 256 + 1)), max(1, -(-m // block))
    of = lambda c, b: F.pmod(F.xxhash64(c), F.lit(b)).cast("int")
    every = lambda b: F.explode(F.sequence(F.lit(0), F.lit(b - 1)))
    v = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).withColumn("part", of("id", parts)).withColumn("block", every(blocks))
    q = queries.select(F.col(id_col).alias("q"), F.col(vec_col).alias("v")).withColumn("block", of("q", blocks)).withColumn("part", every(parts))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "score": np.zeros(0)})
        a, b = np.array(right["v"].tolist(), np.float64), np.array(left["v"].tolist(), np.float64)
        a /= np.linalg.norm(a, axis=1, keepdims=True) + 1e-9
        b /= np.linalg.norm(b, axis=1, keepdims=True) + 1e-9
        ids, own = right["q"].to_numpy(), left["id"].to_numpy()
        s = a @ b.T
        s[ids[:, None] == own[None, :]] = -np.inf
        order = np.lexsort((np.broadcast_to(own, s.shape), -s), axis=1)[:, :k]
        best = np.take_along_axis(s, order, 1)
        keep = np.isfinite(best)
        return pd.DataFrame({"query_id": np.repeat(ids, order.shape[1])[keep.ravel()], "id": own[order][keep], "score": best[keep]})

    out = v.groupBy("part", "block").cogroup(q.groupBy("part", "block")).applyInPandas(search, "query_id bigint, id bigint, score double")
    from .lexical import top_per

    return top_per(out, ["query_id"], k, F.desc("score"), F.asc("id"))


def best_of_group(vectors: DataFrame, query: list[float], group: str, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """group, id, score: the vector of each group nearest to the query, the smaller id among equals."""
    norm = float(np.sqrt(np.sum(np.square(query)))) + 1e-9
    score = F.round(dot(unit(F.col(vec_col)), F.array(*[F.lit(float(x) / norm) for x in query])), 9)
    return vectors.groupBy(group).agg(F.max_by(id_col, F.struct(score, -F.col(id_col))).alias("id"), F.max(score).alias("score"))


def same_space(old: DataFrame, new: DataFrame, key: str = "vec_id", vec_col: str = "embedding", least: float = 0.98) -> DataFrame:
    """key, score, same: are the vectors of two models so near that the old ones can stay? Other dimensions are never."""
    j = old.select(key, F.col(vec_col).alias("a")).join(new.select(key, F.col(vec_col).alias("b")), key)
    score = F.when(F.size("a") == F.size("b"), dot(unit(F.col("a")), unit(F.col("b")))).otherwise(0.0)
    return j.select(key, score.alias("score"), (score >= least).alias("same"))


def unindexed(items: DataFrame, vectors: DataFrame, key: str, model: str | None = None) -> DataFrame:
    """Items without a vector (of a model)."""
    have = vectors if model is None else vectors.where(F.col("model") == model)
    return items.join(have.select(key).distinct(), key, "left_anti")


def coverage(items: DataFrame, vectors: DataFrame, key: str, group: str) -> DataFrame:
    """group, items, indexed, ratio, whole: how much of each group has vectors."""
    have = vectors.select(key).distinct().withColumn("_h", F.lit(1))
    return items.select(group, key).join(have, key, "left").groupBy(group).agg(
        F.count(F.lit(1)).alias("items"), F.count("_h").alias("indexed"), F.round(F.count("_h") / F.count(F.lit(1)), 4).alias("ratio"), (F.count("_h") == F.count(F.lit(1))).alias("whole")
    )
