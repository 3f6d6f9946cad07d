"""Where models and strategies are plugged in: embeddings, re-ranking, retrieval, vector stores, SQL functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import fulltext, lexical, vectors

Ranking = Callable[[DataFrame, str, int], DataFrame]


def embedded(texts: DataFrame, model: Callable[[list[str]], list[list[float]]], key: str, text: str, batch: int = 16, tries: int = 3) -> DataFrame:
    """key, embedding, error: vectors of texts by a model that takes lists of texts, within the tasks.

    A batch that fails is halved until single texts are left; a text that fails `tries` times has an error and no vector,
    and the rest goes on. Control characters go before; null and blank texts get no row.
    """

    def run(chunk: list[str], left: int) -> list[tuple[list[float] | None, str | None]]:
        try:
            found = model(chunk)
            if len(found) != len(chunk):
                raise ValueError(f"{len(found)} vectors for {len(chunk)} texts")
            return [([float(x) for x in v], None) for v in found]
        except Exception as e:  # a model's failures are its rows'
            if len(chunk) > 1:
                half = len(chunk) // 2
                return run(chunk[:half], tries) + run(chunk[half:], tries)
            return run(chunk, left - 1) if left > 1 else [(None, f"{type(e).__name__}: {e}"[:200])]

    def embed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), batch):
                part = pdf.iloc[a : a + batch]
                rows = run(part["_t"].tolist(), tries)
                yield pd.DataFrame({key: part[key].to_numpy(), "embedding": [v for v, _ in rows], "error": [e for _, e in rows]})

    clean = texts.select(key, F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "").alias("_t")).where("length(trim(_t)) > 0")
    return clean.mapInPandas(embed, f"{key} {dict(texts.dtypes)[key]}, embedding array<float>, error string")


class Strategies:
    """Rankings (documents, query, k) -> (id, rank) by name; an unknown name or a failing strategy falls back to the first one and says so."""

    def __init__(self, default: str, **known: Ranking):
        self.default, self.known = default, known

    def add(self, name: str, ranking: Ranking) -> None:
        self.known[name] = ranking

    def rank(self, docs: DataFrame, query: str, k: int, name: str | None = None) -> tuple[DataFrame, str, str | None]:
        """(id and rank, the strategy used, a note if it is not the one asked for)."""
        asked = name or self.default
        if asked not in self.known:
            return self.known[self.default](docs, query, k), self.default, f"no strategy {asked}"
        try:
            return self.known[asked](docs, query, k), asked, None
        except Exception as e:
            if asked == self.default:
                raise
            return self.known[self.default](docs, query, k), self.default, f"{asked}: {type(e).__name__}: {e}"[:200]


def _bm25(docs: DataFrame, query: str, k: int) -> DataFrame:
    scored = lexical.bm25(docs, query, {"title": 3.0, "body": 1.0}).withColumn("score", F.round("score", 9))
    return lexical.top(scored, k, F.desc("score"), F.asc("id")).select("id", "rank")


def _phrases(docs: DataFrame, query: str, k: int) -> DataFrame:
    return lexical.top(fulltext.search(docs, query, "title", "body").withColumn("score", F.round("score", 9)), k, F.desc("score"), F.asc("id")).select("id", "rank")


def _overlap(docs: DataFrame, query: str, k: int) -> DataFrame:
    text = docs.select("id", F.concat_ws(" ", "title", "body").alias("text"))
    return lexical.top(lexical.overlap(text, query, "text").where("score > 0").withColumn("score", F.round("score", 9)), k, F.desc("score"), F.asc("id")).select("id", "rank")


def retrievers() -> Strategies:
    """The rankings that come with the library, over documents (id, title, body)."""
    return Strategies("phrases", phrases=_phrases, bm25=_bm25, overlap=_overlap)


def reranked(docs: DataFrame, recalled: DataFrame, query: str, k: int, strategy: Ranking = _bm25) -> DataFrame:
    """id, rank: a pool (id, rank) in the order of a strategy that sees the pool only; what it does not rank follows in its old order."""
    pool = docs.join(F.broadcast(recalled.select("id")), "id", "left_semi")  # the pool of one query
    again = strategy(pool, query, 1_000_000)
    both = recalled.select("id", F.col("rank").alias("old")).join(again.select("id", F.col("rank").alias("new")), "id", "left")
    return lexical.top(both, k, F.asc_nulls_last("new"), F.asc("old"), F.asc("id")).select("id", "rank")


class ParquetVectors:
    """A store of vectors (id, kind, embedding and any metadata) in a Parquet folder, in buckets by the hash of the id."""

    def __init__(self, spark: SparkSession, target: str):
        self.spark, self.target = spark, target

    def _next(self) -> int:
        from ..streaming.usage import _versions

        return max((v for vs in _versions(self.spark, self.target).values() for v in vs), default=-1) + 1

    def upsert(self, rows: DataFrame) -> None:
        """The given rows in the place of those with their ids."""
        from ..streaming.usage import upsert_by_key

        upsert_by_key(self.target, "id")(rows.withColumn("deleted", F.lit(False)) if "deleted" not in rows.columns else rows, self._next())

    def delete(self, ids: DataFrame) -> None:
        """The rows of these ids (id) go; unknown ones do nothing."""
        have = self.rows(True)
        if have is not None:
            self.upsert(have.join(ids.select("id").distinct(), "id", "left_semi").withColumn("deleted", F.lit(True)))

    def rebuild(self, rows: DataFrame) -> None:
        """Exactly the given rows."""
        have = self.rows()
        if have is not None:
            self.delete(have.select("id").join(rows.select("id"), "id", "left_anti"))
        self.upsert(rows)

    def rows(self, deleted: bool = False) -> DataFrame | None:
        from ..streaming.usage import current

        df = current(self.spark, self.target)
        return df if df is None or deleted else df.where("not deleted").drop("deleted")

    def search(self, query: list[float], k: int, where: Column | None = None) -> DataFrame:
        have = self.rows()
        if have is None:
            return self.spark.createDataFrame([], "id bigint, score double")
        return vectors.nearest(have, query, k, where, "id", "embedding")


#: Functions for SQL: name with arguments, type, body. Spark inlines them, so they stay in the plan.
SQL_FUNCTIONS = {
    "quill_bare_doi(d STRING)": ("STRING", r"nullif(trim(regexp_replace(trim(d), r'(?i)^https?://(dx\.)?doi\.org/', '')), '')"),
    "quill_squeeze(s STRING)": ("STRING", r"lower(regexp_replace(s, r'[ \t\r\n\f\x0B]+', ''))"),
    "quill_norm(s STRING)": ("STRING", r"lower(trim(regexp_replace(s, r'[ \t\r\n\f\x0B]+', ' ')))"),
    "quill_cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>)": (
        "DOUBLE",
        "CASE WHEN size(a) = size(b) THEN aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x) / ((sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) + 1e-9D) * (sqrt(aggregate(b, 0D, (s, x) -> s + x * x)) + 1e-9D)) END",
    ),
}


def register_functions(spark: SparkSession) -> list[str]:
    """Makes the library's functions callable from SQL in this session; their names."""
    for head, (kind, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    return [h.partition("(")[0] for h in SQL_FUNCTIONS]
