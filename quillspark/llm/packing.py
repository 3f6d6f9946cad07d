"""Filling containers of fixed capacity with texts, measured in tokens.

Shortest-pack-first over the histogram of lengths: lengths are placed longest first, each into the open pack
with the most room left. Only the histogram (as many counts as the capacity) reaches the driver; the patterns
found there are joined back to the texts by the rank of a text among those of its length.
"""

from __future__ import annotations

import base64
from bisect import insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

SALTS = 32
#: Long texts that one task numbers; there are as many tasks as it takes.
LONG = 200_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@lru_cache(maxsize=2)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and n_tokens of the whole text; a null text has 0 tokens."""

    @F.pandas_udf("bigint")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = _encoding(tokenizer).encode_ordinary
        for s in parts:
            yield pd.Series([len(encode(t)) if t else 0 for t in s], dtype="int64")

    return docs.select(F.col(id_col).alias("doc_id"), count(F.col(text_col)).alias("n_tokens"))


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns (how many containers, [(length, how many of it)]) that hold every item of the histogram.

    Lengths run from longest to shortest. A length goes to the open packs with most room first; several of it go
    into one pack when there are more items than packs. What no pack has room for opens new ones. Each step uses up
    a length or a pattern, and splits at most one pattern, so the number of patterns depends on the capacity alone.
    """
    open_: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    rooms: list[int] = []
    done: list[tuple[int, list[tuple[int, int]]]] = []

    def put(room: int, count: int, items: list[tuple[int, int]]) -> None:
        if not count:
            return
        if room == 0:
            done.append((count, items))
            return
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append((count, items))

    for length in sorted((k for k, v in histogram.items() if v and k > 0), reverse=True):
        n = histogram[length]
        while n and rooms and rooms[-1] >= length:
            room = rooms[-1]
            count, items = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop()
            each = max(1, min(room // length, n // count))
            used = min(count, n // each)
            put(room, count - used, items)
            put(room - each * length, used, [*items, (length, each)])
            n -= used * each
        if n:
            each = min(capacity // length, n)
            put(capacity - each * length, n // each, [(length, each)])
            if n % each:
                put(capacity - (n % each) * length, 1, [(length, n % each)])
    for room in rooms:
        done += open_[room]
    return done


def _slots(patterns: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """Entries sorted by (length, first rank): ranks [first, first + count * each) of a length lie in containers from `container` on."""
    rows, container, ranks = [], 1, {}
    for count, items in patterns:
        for length, each in items:
            first = ranks.get(length, 0)
            rows.append((length, first, container, each))
            ranks[length] = first + count * each
        container += count
    rows.sort()
    a = np.array(rows, np.int64).reshape(-1, 4)
    return {"length": a[:, 0], "first": a[:, 1], "container": a[:, 2], "each": a[:, 3]}


def pack(sized: DataFrame, capacity: int, profile: str) -> DataFrame:
    """profile, container_id, doc_id, piece_no, begin_token, n_tokens: one row for each piece of each text.

    A text is divided only if it alone exceeds the capacity: into full containers and a rest, which is packed with
    the others. Repeated ids are packed once for each stored row. Texts without tokens take no room and are listed
    in container 1. Null ids are packed like others. An empty table gives no rows.
    sized: doc_id, n_tokens; read twice, so cut its lineage first if it is expensive.
    """
    if capacity <= 0:
        raise ValueError("capacity must be positive")
    full = F.col("n_tokens") - F.when(F.col("n_tokens") > capacity, F.col("n_tokens") % capacity).otherwise(F.col("n_tokens"))
    parts = sized.withColumn("full", full)
    rest = parts.withColumn("rest", F.col("n_tokens") - F.col("full"))
    salted = rest.withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(SALTS)).cast("int"))
    # at most capacity * SALTS rows, whatever the number of texts
    counts = salted.groupBy("rest", "salt").agg(F.count(F.lit(1)).alias("n"))
    hist = {r.rest: r.n for r in counts.groupBy("rest").agg(F.sum("n").alias("n")).collect()}
    over = sized.where(F.col("n_tokens") > capacity).agg(F.sum(F.floor(F.col("n_tokens") / capacity)).alias("full"), F.count(F.lit(1)).alias("texts")).first()
    n_full, spread = over.full or 0, SALTS + (over.texts or 0) // LONG
    patterns = pack_histogram(hist, capacity)
    slots = _slots(patterns)
    n_packed = sum(c for c, _ in patterns)

    @F.pandas_udf("bigint")
    def container(length: pd.Series, rank: pd.Series) -> pd.Series:
        key = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        # entries are few and sorted: find the last entry of the length that begins at or before the rank
        low = np.searchsorted(slots["length"], key[0], "left")
        high = np.searchsorted(slots["length"], key[0], "right")
        while True:
            middle = (low + high) // 2
            going = high - low > 1
            if not going.any():
                break
            right = going & (slots["first"][np.minimum(middle, len(slots["first"]) - 1)] <= key[1])
            low, high = np.where(right, middle, low), np.where(going & ~right, middle, high)
        return pd.Series(slots["container"][low] + (key[1] - slots["first"][low]) // slots["each"][low])

    # rank among the texts of a length: within a salt by window, plus what the salts before hold
    before = counts.withColumn("offset", F.coalesce(F.sum("n").over(Window.partitionBy("rest").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    ranked = salted.withColumn("r", F.row_number().over(Window.partitionBy("rest", "salt").orderBy("doc_id", "n_tokens")) - 1).join(before, ["rest", "salt"])
    placed = ranked.where("rest > 0").select(
        container("rest", F.col("offset") + F.col("r")).alias("container_id"), "doc_id", (F.floor(F.col("full") / capacity) + 1).cast("int").alias("piece_no"), F.col("full").alias("begin_token"), F.col("rest").alias("n_tokens")
    )
    empty = sized.where("n_tokens = 0").select(F.lit(1).cast("bigint").alias("container_id"), "doc_id", F.lit(1).alias("piece_no"), F.lit(0).cast("bigint").alias("begin_token"), F.lit(0).cast("bigint").alias("n_tokens"))
    out = placed.unionByName(empty)
    if n_full:  # full containers are numbered behind the packed ones
        long = sized.where(F.col("n_tokens") > capacity).withColumn("k", F.floor(F.col("n_tokens") / capacity)).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(spread)).cast("int"))
        sums = long.groupBy("salt").agg(F.sum("k").alias("n"))
        starts = sums.withColumn("start", F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(1)).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")  # a row for each salt
        w = Window.partitionBy("salt").orderBy("doc_id", "n_tokens")
        first = long.withColumn("seq", F.row_number().over(w)).withColumn("own", F.coalesce(F.sum("k").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).join(F.broadcast(starts), "salt")
        out = out.unionByName(
            first.withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("k") - 1))).select(
                (F.lit(n_packed + 1) + F.col("start") + F.col("own") + F.col("i")).alias("container_id"), "doc_id", (F.col("i") + 1).cast("int").alias("piece_no"), (F.col("i") * capacity).alias("begin_token"), F.lit(capacity).cast("bigint").alias("n_tokens")
            )
        )
    return out.select(F.lit(profile).alias("profile"), "container_id", "doc_id", "piece_no", "begin_token", "n_tokens")


def fill(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, tokens, share of the capacity that is used."""
    by = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("used"))
    return by.agg(F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"), (F.sum("used") / (F.count(F.lit(1)) * capacity)).alias("filled"), F.max("used").alias("fullest"))
