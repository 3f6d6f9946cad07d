"""Reading level by spreading graded examples over a graph of documents and what they are made of.

Documents are joined to their words, to word lengths and to sentence lengths. Graded documents are clamped; every
other value is the weighted mean of its neighbours' (a harmonic function), found by distributed iterations. The
features are hashed into a table of fixed size, so an iteration moves one vector of that size and no documents.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut

FEATURES = 1 << 20  # size of the vector that an iteration sends around, whatever the collection: eight megabytes
TOLERANCE = 0.02  # the iterations end when no feature moves by more of a level
LABELS = 20_000  # at most so many graded documents set the borders between levels
_SENTENCE = re.compile("(?<=[.!?])\\s+|(?<=[。！？])|\\n+")
_HAN = re.compile("[一-鿿]")
_WORD = re.compile("[一-鿿]|[^\\W\\d_一-鿿]+")
#: Frequent words that tell the languages with Latin letters apart.
FUNCTION_WORDS = {"en": ("the", "of", "and", "a", "to", "in"), "de": ("der", "die", "das", "und", "eine", "ein"), "fr": ("le", "la", "les", "et", "une", "des", "de", "du"), "es": ("el", "la", "los", "y", "una", "de", "del")}


def features(text: str) -> tuple[Counter, str]:
    """Weights of a text's hashed features, and the group of languages it is calibrated in."""
    text = unicodedata.normalize("NFKC", text)
    east = (not text.isascii()) and len(_HAN.findall(text)) * 3 > len(text)
    out: Counter = Counter()
    words: Counter = Counter()
    for sentence in _SENTENCE.split(text):
        found = _WORD.findall(sentence.lower())
        if not found:
            continue
        n = len(found)
        out[f"\0s{int(east)}{min(60, round(3 * math.log2(n + 1)))}"] += n
        if east:
            words.update(a + b for a, b in zip(found, found[1:]))
        else:
            words.update(found)
    group = "zh" if east else max(FUNCTION_WORDS, key=lambda k: sum(words[x] for x in FUNCTION_WORDS[k]))
    if not east:
        for w, n in words.items():
            out[f"\0l{min(len(w), 16)}"] += 0.5 * n
    out.update(words)
    return out, group


_EDGES = "doc_id bigint, grp string, lvl double, ids array<int>, weights array<float>"


def _edges(graded: DataFrame) -> DataFrame:
    types = pa.schema([("doc_id", pa.int64()), ("grp", pa.string()), ("lvl", pa.float64()), ("ids", pa.list_(pa.int32())), ("weights", pa.list_(pa.float32()))])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket: dict[str, int] = {}
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                rows = []
                for text in part.column("text").to_pylist():
                    weights, group = features(text)
                    ids = []
                    for f in weights:
                        if (h := bucket.get(f)) is None:
                            h = zlib.crc32(f.encode()) % FEATURES
                            if len(bucket) < 500_000:
                                bucket[f] = h
                        ids.append(h)
                    w = np.fromiter(weights.values(), np.float32, len(ids))
                    rows.append((group, ids, w / max(w.sum(), 1e-9)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([r[0] for r in rows]), part.column("lvl"), pa.array([r[1] for r in rows], types.field("ids").type), pa.array([r[2] for r in rows], types.field("weights").type)], schema=types
                )

    return graded.select("doc_id", "text", "lvl").mapInArrow(build, _EDGES)


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    ids, weights = batch.column("ids"), batch.column("weights")
    sizes = np.diff(ids.offsets.to_numpy())
    return np.repeat(np.arange(len(sizes)), sizes), ids.flatten().to_numpy(), weights.flatten().to_numpy().astype(np.float64), len(sizes)


def _scores(row: np.ndarray, ids: np.ndarray, w: np.ndarray, n: int, values: np.ndarray | None, mean: float) -> np.ndarray:
    if values is None:
        return np.full(n, mean)
    return np.bincount(row, w * values[ids], minlength=n) / np.maximum(np.bincount(row, w, minlength=n), 1e-9)


def _vector(edges: DataFrame, values: np.ndarray | None, mean: float) -> np.ndarray:
    """One step: documents take the mean of their features (graded ones keep their grade), features the mean of their documents."""
    shared = edges.sparkSession.sparkContext.broadcast(values)  # FEATURES numbers

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros(FEATURES), np.zeros(FEATURES)
        for batch in batches:
            row, ids, w, n = _flat(batch)
            grade = batch.column("lvl").to_numpy(zero_copy_only=False).astype(np.float64)
            known = ~np.isnan(grade)
            score = np.where(known, grade, _scores(row, ids, w, n, shared.value, mean))
            trust = np.where(known, 1.0, 0.0 if shared.value is None else 0.1)
            a += np.bincount(ids, w * trust[row], minlength=FEATURES)
            b += np.bincount(ids, w * (trust * score)[row], minlength=FEATURES)
        at = np.flatnonzero(a)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(a[at]), pa.array(b[at])], names=["f", "a", "b"])

    total = edges.select("lvl", "ids", "weights").mapInArrow(sums, "f int, a double, b double").groupBy("f").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    found = total.toPandas()  # at most FEATURES rows
    out = np.full(FEATURES, mean)
    out[found["f"].to_numpy()] = (found["b"].to_numpy() + 0.002 * mean) / (found["a"].to_numpy() + 0.002)
    shared.unpersist()
    return out


def borders(score: np.ndarray, level: np.ndarray, group: np.ndarray) -> dict[str, list[float]]:
    """Borders between levels for each group of languages: those that get most graded documents of the group right; ten pooled ones help small groups."""
    out = {}
    for g in [*dict.fromkeys(group.tolist()), ""]:
        mine = group == g
        weight = np.where(mine, 1.0, 10.0 / max(1, len(score))) if g else np.ones(len(score))
        cuts = []
        for t in (1, 2, 3):
            edge = np.unique(score)
            edge = (edge[1:] + edge[:-1]) / 2 if len(edge) > 1 else np.array([t + 0.5])
            order = np.argsort(score)
            above = level[order] > t
            right = np.concatenate([[0], np.cumsum(np.where(above, -1, 1) * weight[order])])
            cuts.append(float(edge[int(np.argmax(right[np.searchsorted(score[order], edge)]))]))
        out[g] = np.maximum.accumulate(cuts).tolist()
    return out


def reading_levels(docs: DataFrame, labels: DataFrame, most_steps: int = 50, least: int = 300) -> DataFrame:
    """doc_id, score (continuous), level (1 to 4) of every text of `least` or more code points; shorter, empty and null texts get no row.

    labels: doc_id, level; several for a document are averaged, null ones and those of unknown documents ignored. A
    graded document keeps its grade; where raters disagree, the side on which its score lies. Repeated doc_ids
    are levelled row by row. Without any usable label there is nothing to spread: all rows get level 2. Other
    columns are ignored; an empty table gives none.
    """
    grades = labels.where("doc_id is not null and level between 1 and 4").groupBy("doc_id").agg(F.avg("level").alias("lvl"))
    texts = docs.select("doc_id", "text").where(F.length("text") >= least)
    edges = cut(_edges(texts.join(grades, "doc_id", "left")))
    mean = edges.agg(F.avg("lvl")).first()[0]
    if mean is None:
        return edges.select("doc_id", F.lit(2.0).alias("score"), F.lit(2).alias("level"))
    values = None
    for _ in range(most_steps):
        before, values = values, _vector(edges, values, mean)
        if before is not None and np.abs(values - before).max() < TOLERANCE:
            break
    shared = edges.sparkSession.sparkContext.broadcast(values)
    schema = pa.schema([("doc_id", pa.int64()), ("grp", pa.string()), ("lvl", pa.float64()), ("score", pa.float64())])

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, ids, w, n = _flat(batch)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("grp"), batch.column("lvl"), pa.array(_scores(row, ids, w, n, shared.value, mean))], schema=schema)

    scored = edges.mapInArrow(final, "doc_id bigint, grp string, lvl double, score double")
    seen = scored.where("lvl is not null").orderBy(F.xxhash64("doc_id")).limit(LABELS).toPandas()
    cuts = borders(seen["score"].to_numpy(), np.floor(seen["lvl"].to_numpy() + 0.5), seen["grp"].to_numpy())
    group = F.col("grp")
    level = None
    for g, (a, b, c) in cuts.items():
        step = F.when(F.col("score") > c, 4).when(F.col("score") > b, 3).when(F.col("score") > a, 2).otherwise(1)
        level = (F.when(group == g, step) if level is None else level.when(group == g, step)) if g else level.otherwise(step)
    guessed = scored.withColumn("guess", level.cast("int"))
    graded = F.when(F.col("guess") > F.col("lvl"), F.ceil("lvl")).otherwise(F.floor("lvl")).cast("int")
    return guessed.select("doc_id", "score", F.coalesce(F.when(F.col("lvl").isNotNull(), graded), F.col("guess")).alias("level"))
