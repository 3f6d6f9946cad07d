"""Approximate cosine search by inverted lists: centres fitted on a bounded sample, every row indexed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .lexical import top_per

#: At most so many vectors set the centres, and rows of a list that one task holds.
SAMPLE, ROWS = 20_000, 50_000


def _unit(rows) -> np.ndarray:
    m = np.array(list(rows), np.float64)
    return m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-9) if len(m) else m.reshape(0, 0)


def fit(vectors: DataFrame, lists: int, rounds: int = 12, id_col: str = "vec_id", vec_col: str = "embedding") -> np.ndarray:
    """Centres of the lists: k-means by cosine on at most SAMPLE vectors in the order of their hash."""
    m = _unit(r.v for r in vectors.select(F.col(vec_col).alias("v"), F.xxhash64(id_col).alias("h")).orderBy("h").limit(SAMPLE).collect())
    centres = m[: min(lists, len(m))].copy()
    for _ in range(rounds):
        own = (m @ centres.T).argmax(1)
        for k in range(len(centres)):
            if (own == k).any():
                c = m[own == k].sum(0)
                centres[k] = c / (np.linalg.norm(c) + 1e-9)
    return centres


def nearest_lists(vectors: DataFrame, centres: np.ndarray, probes: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id, v, list: every vector with its nearest lists, as many rows as `probes`."""

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                near = np.argsort(-(_unit(pdf["v"]) @ centres.T), axis=1, kind="stable")[:, :probes]
                yield pd.DataFrame({"id": np.repeat(pdf["id"].to_numpy(), near.shape[1]), "v": [v for v in pdf["v"] for _ in range(near.shape[1])], "list": near.ravel()})

    return vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")).mapInPandas(assign, "id bigint, v array<double>, list int")


def index(vectors: DataFrame, centres: np.ndarray, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id, v, list: every row once; write it partitioned by list to read only the probed ones."""
    return nearest_lists(vectors, centres, 1, id_col, vec_col)


def search(indexed: DataFrame, queries: DataFrame, centres: np.ndarray, k: int, probes: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, id, score, rank: the k nearest of each query in its `probes` nearest lists, the query itself left out.

    Lists are split into parts of at most about ROWS rows, so a list that holds a third of all rows is no single task.
    """
    parts = indexed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / ROWS).cast("int").alias("parts"))
    small = F.broadcast(parts)  # a row for each list: as many as centres
    left = indexed.join(small, "list").select("id", "v", "list", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"))
    right = nearest_lists(queries, centres, probes, id_col, vec_col).join(small, "list").select(F.col("id").alias("q"), "v", "list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "score": np.zeros(0)})
        s = _unit(b["v"]) @ _unit(a["v"]).T
        ids, own = b["q"].to_numpy(), a["id"].to_numpy()
        s[ids[:, None] == own[None, :]] = -np.inf
        order = np.lexsort((np.broadcast_to(own, s.shape), -s), axis=1)[:, :k]
        top = np.take_along_axis(s, order, 1)
        keep = np.isfinite(top)
        return pd.DataFrame({"query_id": np.repeat(ids, order.shape[1])[keep.ravel()], "id": own[order][keep], "score": top[keep]})

    found = left.groupBy("list", "part").cogroup(right.groupBy("list", "part")).applyInPandas(best, "query_id bigint, id bigint, score double")
    return top_per(found, ["query_id"], k, F.desc("score"), F.asc("id"))


def recall(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """queries, recall: mean share of the exact neighbours (query_id, id) that the approximate ones have."""
    hit = exact.select("query_id", "id").join(approximate.select("query_id", "id").withColumn("h", F.lit(1)), ["query_id", "id"], "left")
    each = hit.groupBy("query_id").agg((F.count("h") / F.count(F.lit(1))).alias("r"))
    return each.agg(F.count(F.lit(1)).alias("queries"), F.avg("r").alias("recall"))
