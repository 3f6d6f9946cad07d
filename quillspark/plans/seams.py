"""Strategies, functions for SQL and vector search by index."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import ann, seams, segment, tables, tree, vectors
from .ranking import QUERY, _B
from .registry import Tables, query
from .search import _PAPERS


def _docs(x: Tables) -> DataFrame:
    return x.papers.select("id", "title", F.col("abstract").alias("body"))


@query(f"WITH {_B} SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank FROM r ORDER BY rank LIMIT 10")
def strategy_by_name(x: Tables) -> DataFrame:
    return seams.retrievers().rank(_docs(x), QUERY, 10, "bm25")[0]


@query(f"WITH {_PAPERS} SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank FROM p ORDER BY rank LIMIT 10")
def strategy_fallback(x: Tables) -> DataFrame:
    """A name that is not known: the default answers."""
    return seams.retrievers().rank(_docs(x), QUERY, 10, "unheard of")[0]


@query("SELECT id, nullif(trim(regexp_replace(trim(doi), '(?i)^https?://(dx\\.)?doi\\.org/', '')), '') AS doi, lower(regexp_replace(title, '[ \\t\\r\\n\\f\\v]+', '', 'g')) AS squeezed FROM papers")
def sql_functions(x: Tables) -> DataFrame:
    seams.register_functions(x.spark)
    return x.papers.select("id", F.expr("quill_bare_doi(doi)").alias("doi"), F.expr("quill_squeeze(title)").alias("squeezed"))


@query("SELECT count(*) AS queries, true AS enough FROM embeddings WHERE vec_id % 20 = 0")
def ann_recall(x: Tables) -> DataFrame:
    """Search by inverted lists against exact search, every row with an id divisible by 20 as a query: nine tenths must be found."""
    v = x.embeddings
    q = v.where("vec_id % 20 = 0")
    centres = ann.fit(v, 16)
    found = ann.search(ann.index(v, centres), q, centres, 10, 13)
    r = ann.recall(found, vectors.nearest_many(v, q, 10))
    return r.select("queries", (F.col("recall") >= 0.9).alias("enough"))


@query("WITH r AS (SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS n FROM lineitem) SELECT l_suppkey, CAST(ceil(n / 50.0) AS INT) AS chunk_no, count(*) AS n_rows FROM r GROUP BY ALL")
def table_chunks(x: Tables) -> DataFrame:
    """The lines of each supplier as a table in chunks of fifty rows."""
    rows = x.lineitem.select("l_suppkey", F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("o"), F.concat_ws(" | ", F.col("l_orderkey").cast("string"), F.col("l_returnflag")).alias("line"))
    return tables.chunked(rows, "l_suppkey", "o", "line", header=False).select("l_suppkey", "chunk_no", "n_rows")


@query("SELECT id, md5(regexp_replace(body, '\\s', '', 'g')) AS body FROM section_nodes WHERE length(regexp_replace(body, '\\s', '', 'g')) > 0")
def chunks_round_trip(x: Tables) -> DataFrame:
    """The chunks of a section give its text back, white space aside."""
    c = segment.chunks(x.section_nodes).groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "chunk"))), lambda r: r["chunk"]), "").alias("t"))
    return c.select("id", F.md5(F.regexp_replace("t", r"\s", "").cast("binary")).alias("body"))


@query("SELECT id, md5(regexp_replace(body, '\\s', '', 'g')) AS body FROM section_nodes WHERE length(regexp_replace(body, '\\s', '', 'g')) > 0")
def passages_round_trip(x: Tables) -> DataFrame:
    p = tree.passages(x.section_nodes).groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("passage_no", "passage"))), lambda r: r["passage"]), "").alias("t"))
    return p.select("id", F.md5(F.regexp_replace("t", r"\s", "").cast("binary")).alias("body"))
