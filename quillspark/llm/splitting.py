"""Cutting oversized texts at natural boundaries.

Every position of a text gets a boundary strength. A sparse table over the strengths answers, for each
permissible window of piece ends, where the strongest cut lies (the rightmost one among equals); the next
piece begins the profile's overlap before that cut.
"""

from __future__ import annotations

import numpy as np
import regex
from pyspark.sql import DataFrame, functions as F

from ..functions.arrow import map_rows

PARAGRAPH, SENTENCE, LINE, CLAUSE, WORD, CHARACTER, NONE = 6, 5, 4, 3, 2, 1, 0
#: Strengths from WORD up are ends of words.
NAMES = {PARAGRAPH: "paragraph", SENTENCE: "sentence", LINE: "line", CLAUSE: "clause", WORD: "word", CHARACTER: "character", NONE: "hard"}

_PARAGRAPH = regex.compile(r"[^\S\n]*\n[^\S\n]*(?:\n\s*)+")
_SENTENCE = regex.compile(r"[.!?…]+[\"'”’»)\]]*\s+(?=[^\p{Ll}])|[。！？；]+[”’」』）]*\s*")
_LINE = regex.compile(r"\n\s*")
_CLAUSE = regex.compile(r"[,;:]\s+|[，、：]")
_WORD = regex.compile(r"\s+")
_HAN = regex.compile(r"(?<=[\p{Han}\p{Hiragana}\p{Katakana}])(?=\p{L})|(?<=\p{L})(?=[\p{Han}\p{Hiragana}\p{Katakana}])")
_GLUED = regex.compile(r"[\p{M}\u200D\uFE0F\uFE0E]")


def strengths(text: str, overlap: int = 0) -> np.ndarray:
    """Strength of a cut before each position 0..len(text); a cut lies behind the white space that belongs to the boundary. Neither a cut nor what begins the overlap before it stands between a letter and its mark while anything else is possible."""
    s = np.zeros(len(text) + 1, np.int8)
    for pattern, value in ((_HAN, CHARACTER), (_WORD, WORD), (_CLAUSE, CLAUSE), (_LINE, LINE), (_SENTENCE, SENTENCE), (_PARAGRAPH, PARAGRAPH)):
        at = np.fromiter((m.end() for m in pattern.finditer(text)), np.int64)
        s[at] = np.maximum(s[at], value)
    glued = np.fromiter((m.start() for m in _GLUED.finditer(text)), np.int64)
    s[glued] = -1
    s[glued[glued + overlap < len(s)] + overlap] = -1
    s[0], s[len(text)] = NONE, PARAGRAPH
    return s


class RangeMax:
    """Sparse table: position of the largest strength in a range, the rightmost among equals, in constant time."""

    def __init__(self, values: np.ndarray, longest: int):
        n = len(values)
        self.base = n + 1
        level = (values.astype(np.int64) + 1) * self.base + np.arange(n)
        self.levels = [level]
        width = 1
        while width * 2 <= min(longest, n):
            level = np.maximum(level[: len(level) - width], level[width:])
            self.levels.append(level)
            width *= 2

    def query(self, low: int, high: int) -> tuple[int, int]:
        """(position, strength) for low <= position <= high."""
        k = (high - low + 1).bit_length() - 1
        best = int(max(self.levels[k][low], self.levels[k][high - (1 << k) + 1]))
        return best % self.base, best // self.base - 1


def pieces(text: str, capacity: int, overlap: int = 0) -> list[tuple[int, int, int]]:
    """(begin, end, strength of the end) of the ordered pieces of a text.

    A text within the capacity is one piece; an empty text has none. Consecutive pieces share exactly `overlap`
    code points. A piece ends at the strongest boundary of the second half of what it may hold; if there is no
    word end, of all that it may hold; a hard cut remains for a text without boundaries.
    """
    if capacity <= 0 or not 0 <= overlap < capacity:
        raise ValueError("capacity must be positive and overlap smaller than it")
    n = len(text)
    if n == 0:
        return []
    if n <= capacity:
        return [(0, n, PARAGRAPH)]
    index = RangeMax(strengths(text, overlap), capacity + 1)
    out, begin = [], 0
    while n - begin > capacity:
        high, low = begin + capacity, begin + max(overlap + 1, (capacity + 1) // 2)
        low = min(low, high)
        end, strength = index.query(low, high)
        if strength < WORD and begin + overlap + 1 < low:
            other, more = index.query(begin + overlap + 1, high)
            if more > strength and more >= WORD:
                end, strength = other, more
        out.append((begin, end, max(strength, NONE)))
        begin = end - overlap
    out.append((begin, n, PARAGRAPH))
    return out


SCHEMA = "id bigint, profile string, piece_no int, n_pieces int, begin_pos int, end_pos int, boundary string, piece string"


def split_oversized(texts: DataFrame, profiles: DataFrame, id_col: str = "id", text_col: str = "body") -> DataFrame:
    """Ordered pieces of every text under every `chars` profile.

    texts: id and text, other columns are ignored. profiles: profile, unit, capacity, overlap; a small fixed table
    (at most 1000 rows, else ValueError). Lengths are counted in code points of the text itself.
    Null or empty texts give no rows; repeated ids give rows for each stored row; a null id stays null.
    Only texts longer than the smallest capacity leave the JVM.
    """
    rows = profiles.where("unit = 'chars'").select("profile", "capacity", "overlap").limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("size_profiles is meant to be a small table")
    sizes = [(r.profile, int(r.capacity), int(r.overlap or 0)) for r in rows if r.capacity is not None]
    base = texts.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("body")).where("length(body) > 0")
    spark = texts.sparkSession
    if not sizes:
        return spark.createDataFrame([], SCHEMA)

    def cut(r: dict):
        out = []
        for profile, capacity, overlap in sizes:
            if len(r["body"]) > capacity:
                found = pieces(r["body"], capacity, overlap)
                out += [(r["id"], profile, k, len(found), b, e, NAMES[s], r["body"][b:e]) for k, (b, e, s) in enumerate(found, 1)]
        return out

    least = min(c for _, c, _ in sizes)
    long = map_rows(base.where(F.length("body") > least), cut, SCHEMA, 64)
    whole = base.withColumn("p", F.explode(F.array(*[F.struct(F.lit(p).alias("profile"), F.lit(c).alias("capacity")) for p, c, _ in sizes]))).where("length(body) <= p.capacity").select(
        "id", "p.profile", F.lit(1).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).alias("begin_pos"), F.length("body").alias("end_pos"), F.lit("paragraph").alias("boundary"), F.col("body").alias("piece")
    )
    return long.unionByName(whole)


def oversized(split: DataFrame) -> DataFrame:
    """(id, profile) of the texts that had to be divided, read off the pieces."""
    return split.where("n_pieces > 1 and piece_no = 1").select("id", "profile")
