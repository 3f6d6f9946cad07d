"""How distinctive a term is of its record: graph-of-words degree times rarity.

A record's terms in text order form a graph: terms within a window are joined. The number of distinct
neighbours of a term, which repeated phrases do not inflate as they inflate frequency, takes the place of the
term frequency; the logarithm of the inverse share of records with the term makes common terms count little.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import cut

_TOKEN = re.compile("[\u4e00-\u9fff]+|[^\\W_\u4e00-\u9fff]+")
_ASCII = re.compile("[a-z0-9]{2,}")
_DIVIDED = re.compile(r"(?<=\w)[-\u00ac\u00ad][^\S\n]*\n\s*(?=[a-z\u00df-\u00ff])")
GROUP = 48  # records whose edges are counted together
#: At most so many terms can each make up one in so many of all postings.
HOT = 4096


def tokens(text: str) -> list[str]:
    """Terms in text order: lower-case words and numbers of two or more characters, Chinese as overlapping pairs."""
    if text.isascii():
        return _ASCII.findall((_DIVIDED.sub("", text) if "\n" in text else text).lower())
    out: list[str] = []
    for t in _TOKEN.findall((_DIVIDED.sub("", text) if "\n" in text else text).lower()):
        if "\u4e00" <= t[0] <= "\u9fff":
            out += [t[i : i + 2] for i in range(len(t) - 1)]
        elif len(t) > 1:
            out.append(t)
    return out


def degrees(records: list[list[str]], window: int) -> list[dict[str, int]]:
    """For each record the distinct neighbours of its terms among the terms less than `window` positions away.

    The edges of all records given are sorted and counted together.
    """
    vocabulary: dict[str, int] = {}
    code = vocabulary.setdefault
    coded = [[code(w, len(vocabulary)) for w in words] for words in records]
    if not vocabulary:
        return [{} for _ in records]
    n = len(vocabulary)
    ids = np.fromiter((i for own in coded for i in own), np.int64)
    record = np.repeat(np.arange(len(records)), [len(own) for own in coded])
    edges = []
    for k in range(1, min(window, len(ids))):
        a, b = ids[:-k], ids[k:]
        keep = (record[:-k] == record[k:]) & (a != b)
        edges.append((record[k:][keep] * n + np.minimum(a, b)[keep]) * n + np.maximum(a, b)[keep])
    edge = np.sort(np.concatenate([*edges, np.zeros(0, np.int64)]))
    edge = edge[np.concatenate([[True], edge[1:] != edge[:-1]])] if len(edge) else edge
    left, b = np.divmod(edge, n)
    count = np.bincount(left, minlength=len(records) * n) + np.bincount(left // n * n + b, minlength=len(records) * n)
    return [dict(zip(words, count[r * n + np.array(own, np.int64)].tolist())) for r, (words, own) in enumerate(zip(records, coded))]


_RECORD = "paper_id bigint, node_id string, terms array<string>, degrees array<int>"


def record_graphs(terms: DataFrame, nodes: DataFrame, window: int = 4) -> DataFrame:
    """One row for each record with postings: paper_id, node_id, its distinct terms as stored and their degrees.

    terms: postings paper_id, node_id, term, tf; nodes: paper_id, node_id, title, body, from which text order
    comes. Rows of a record and term are one, however often delivered and in whatever case; the lower-case
    spelling is reported if it is stored, else the first one. Null or blank terms and null keys give no rows. A
    null or zero tf does not matter where the text has the term; a term that the text lacks (title of a lost
    copy, damaged word) gets the largest degree that half a window for each of its tf could give. Copies of a
    node are one record, the first text counts. Empty tables give no rows. The result is cut from its lineage.
    """
    window = max(2, window)
    stored = (
        terms.where("paper_id is not null and node_id is not null and length(trim(term)) > 0")
        .groupBy("paper_id", "node_id")  # a record is bounded by its own text; lists are merged before the shuffle
        .agg(F.collect_list("term").alias("stored"), F.collect_list(F.coalesce(F.col("tf").cast("int"), F.lit(0))).alias("tfs"))
    )
    texts = nodes.where("paper_id is not null and node_id is not null").select(F.col("id") if "id" in nodes.columns else F.lit(0).alias("id"), "paper_id", "node_id", F.concat_ws("\n\n", "title", "body").alias("text")).where("length(text) > 0")

    def graphs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for at in range(0, len(pdf), GROUP):
                part = pdf.iloc[at : at + GROUP]
                graph = degrees([tokens(t) if t is not None else [] for t in part["text"]], window)
                for p, n, stored, tfs, found in zip(part["paper_id"], part["node_id"], part["stored"], part["tfs"], graph):
                    stored, tfs = stored.tolist(), tfs.tolist()
                    keys = [t.lower() for t in stored]
                    if len(set(keys)) < len(keys):
                        own: dict[str, tuple[str, int]] = {}
                        for key, t, f in zip(keys, stored, tfs):
                            a, b = own.get(key, (t, f))
                            own[key] = (a if a == key else t if t == key else min(a, t), max(b, f))
                        keys, stored, tfs = list(own), [t for t, _ in own.values()], [f for _, f in own.values()]
                    get = found.get
                    out.append((p, n, stored, [get(k) or max(0, f) * (window - 1) for k, f in zip(keys, tfs)]))
            yield pd.DataFrame(out, columns=["paper_id", "node_id", "terms", "degrees"])

    # copies of a node give a record more than once with the same postings: the first text in code-point order of its id and itself is kept
    joined = stored.join(texts.groupBy("paper_id", "node_id").agg(F.min_by("text", F.struct("id", F.md5("text"))).alias("text")), ["paper_id", "node_id"], "left")
    return cut(joined.mapInPandas(graphs, _RECORD))


def _counts(records: DataFrame) -> DataFrame:
    return records.select(F.explode("terms").alias("t")).groupBy(F.lower("t").alias("key")).agg(F.count(F.lit(1)).alias("df"))


def term_weights(records: DataFrame) -> DataFrame:
    """paper_id, node_id, term, degree, df, n_records, weight of every term of every record: degree x ln(n_records / df)."""
    n = records.count()
    counts = _counts(records)
    # a term may be in a third of all records: terms in more than one of HOT postings, a table of at most HOT rows, go to every task; the others are joined by their hash
    total = records.agg(F.sum(F.size("terms"))).first()[0] or 0
    hot = F.broadcast(counts.where(F.col("df") > max(2, total // HOT)).select("key", F.col("df").alias("hot")))  # at most HOT rows
    rows = records.select("paper_id", "node_id", F.explode(F.arrays_zip("terms", "degrees")).alias("x")).select("paper_id", "node_id", F.col("x.terms").alias("term"), F.col("x.degrees").alias("degree"))
    placed = rows.withColumn("key", F.lower("term")).join(hot, "key", "left")
    known = placed.where("hot is not null").select("paper_id", "node_id", "term", "degree", F.col("hot").alias("df"))
    rest = placed.where("hot is null").drop("hot").join(counts, "key").select("paper_id", "node_id", "term", "degree", "df")
    return known.unionByName(rest).select("paper_id", "node_id", "term", "degree", "df", F.lit(n).cast("bigint").alias("n_records"), (F.col("degree") * F.log(F.lit(float(n)) / F.col("df"))).alias("weight"))


def most_characteristic(records: DataFrame) -> DataFrame:
    """(paper_id, node_id, term): the term with the largest weight of each record; among equals the rarer, then the larger in code-point order.

    Terms that cannot win are left out before the join: the weights of terms in more than one of HOT postings are
    known from a table of at most HOT rows, those of all others lie between two bounds. Nothing is lost by it.
    """
    totals = records.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("terms")).alias("p")).first()
    n, least = totals.n, max(2, (totals.p or 0) // HOT)
    hot = {r.key: r.df for r in _counts(records).where(F.col("df") > least).limit(HOT + 1).collect()}
    rarest, common = math.log(max(n, 1)), math.log(max(n, 1) / least)
    weight = {t: math.log(n / df) for t, df in hot.items()}.get

    def possible(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for p, m, terms, degs in zip(pdf["paper_id"], pdf["node_id"], pdf["terms"], pdf["degrees"]):
                known = np.array([weight(t.lower(), np.nan) for t in terms])
                cold = np.isnan(known)
                floor = (degs * np.where(cold, common, known)).max() - 1e-9
                out += [(p, m, terms[k], int(degs[k])) for k in np.flatnonzero(degs * np.where(cold, rarest, known) >= floor)]
            yield pd.DataFrame(out, columns=["paper_id", "node_id", "term", "degree"]).astype({"paper_id": "int64", "degree": "int32"})

    left = records.where("size(terms) > 0").mapInPandas(possible, "paper_id bigint, node_id string, term string, degree int").withColumn("key", F.lower("term"))
    weighed = left.join(_counts(records), "key").withColumn("weight", F.col("degree") * F.log(F.lit(float(n)) / F.col("df")))
    best = weighed.groupBy("paper_id", "node_id").agg(F.max_by("term", F.struct("weight", -F.col("df"), "term")).alias("term"))
    return best.select("paper_id", "node_id", "term")
