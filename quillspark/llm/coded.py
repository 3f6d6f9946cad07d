"""Words of many texts as 64-bit numbers, computed for whole slices of texts at once.

A word's number is a polynomial over random numbers of its characters, modulo 2^64: the same word has the same number
in every text, task and run. Bit filters over such numbers have a fixed size; what they let through by chance is sorted
out by the exact join behind them, so they only save rows.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import regex
from pyspark.sql import DataFrame, functions as F

from .unify import ODD_CHARACTER, ordinary

#: What a word is: a run of letters and digits, or one Chinese character (of the basic plane, like the tables below).
WORD = regex.compile(r"[\p{Han}&&[\u0000-￿]]|[\p{L}\p{N}&&[^\p{Han}]&&[\u0000-￿]]+", regex.V1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Blocks of 64 bits in a filter.
BLOCKS = 1 << 19


class Coded(NamedTuple):
    text: str
    points: np.ndarray  # its characters, 0xFFFF for those beyond the basic plane
    number: np.ndarray  # of each word
    doc: np.ndarray  # place of its text in the list
    begin: np.ndarray
    end: np.ndarray


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of a character (1 letter or digit, 2 Chinese), its random number, whether it may not be ordinary."""
    every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else " " for c in range(0x10000))
    kind = np.zeros(0x10000, np.uint8)
    kind[[m.start() for m in regex.finditer(r"[\p{L}\p{N}&&[^\p{Han}]]", every, regex.V1)]] = 1
    kind[[m.start() for m in regex.finditer(r"\p{Han}", every)]] = 2
    odd = np.zeros(0x10000, bool)
    odd[[m.start() for m in ODD_CHARACTER.finditer(every)]] = True
    odd[0] = False  # stands between texts
    odd[0xFFFF] = True  # stands for everything beyond the basic plane
    return kind, np.random.default_rng(20260901).integers(0, 1 << 64, 0x10000, dtype=np.uint64), odd


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse up to n."""
    out = []
    for base in (_BASE, _INVERSE):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        with np.errstate(over="ignore"):
            out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _points(text: str) -> np.ndarray:
    return np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 0xFFFF).astype(np.uint16)


def plain(texts: list[str]) -> list[str]:
    """The texts in ordinary characters; only those with odd ones are worked on."""
    joined = "\0".join(texts)
    if joined.isascii():
        return texts
    points = _points(joined)
    odd = np.flatnonzero(_tables()[2][points])
    if not len(odd):
        return texts
    out = list(texts)
    ends = np.cumsum([len(t) + 1 for t in texts])
    for k in np.unique(np.searchsorted(ends, odd, "right")):
        out[k] = ordinary(texts[k])
    return out


def sums(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Characters, running sums of their random numbers times powers of the base (one more than characters), the powers and those of the inverse: a word's number is the difference of two sums times an inverse power."""
    points = _points(text)
    power, inverse = _powers(1 << max(16, int(len(points) + 1).bit_length()))
    total = np.empty(len(points) + 1, np.uint64)
    total[0] = 0
    with np.errstate(over="ignore"):
        np.cumsum(_tables()[1][points] * power[: len(points)], out=total[1:])
    return points, total, power, inverse


def weight_of(word: str) -> int:
    """Number of a word as it stands at the beginning."""
    return sum(int(_tables()[1][min(ord(c), 0xFFFF)]) * pow(_BASE, k, 1 << 64) for k, c in enumerate(word)) % (1 << 64)


def _numbers(text: str, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, total, _, inverse = sums(text)
    with np.errstate(over="ignore"):
        return ((total[end] - total[begin]) * inverse[begin]).view(np.int64)


def code(texts: list[str]) -> Coded:
    """All words of the texts, in lower case and order."""
    text = "\0".join(t.replace("\0", " ") if "\0" in t else t for t in texts).lower()
    kind = _tables()[0]
    points = _points(text)
    cls = kind[points]
    letter = cls == 1
    edge = np.empty(len(letter) + 1, bool)
    edge[0], edge[1:-1], edge[-1] = letter[:1].any(), letter[1:] != letter[:-1], letter[-1:].any()
    bound = np.flatnonzero(edge)
    begin, end = bound[::2], bound[1::2]
    han = np.flatnonzero(cls == 2)
    if len(han):
        begin, end = np.concatenate([begin, han]), np.concatenate([end, han + 1])
        order = np.argsort(begin, kind="stable")
        begin, end = begin[order], end[order]
    number = _numbers(text, begin, end)
    doc = np.searchsorted(np.flatnonzero(points == 0), begin)
    return Coded(text, points, number, doc, begin, end)


def pair_numbers(number: np.ndarray) -> np.ndarray:
    """One number for each word and the next."""
    n = number.view(np.uint64)
    with np.errstate(over="ignore"):
        return (n[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + (n[1:] ^ (n[1:] >> np.uint64(29))) * np.uint64(0x165667B19E3779F9)).view(np.int64)


def numbers_of(words: Iterable[str]) -> np.ndarray:
    """Numbers of words given one by one in lower case, one each, whatever they are made of."""
    words = [w.replace("\0", " ") for w in words]
    end = np.cumsum([len(w) + 1 for w in words], dtype=np.int64) - 1
    return _numbers("\0".join(words), end - [len(w) for w in words] if words else end, end)


def slices(lengths: list[int], most: int = 200_000) -> list[tuple[int, int]]:
    """Ranges of texts of about `most` characters together; a longer text stands alone."""
    out, begin, size = [], 0, 0
    for k, n in enumerate(lengths):
        if size and size + n > most:
            out.append((begin, k))
            begin, size = k, 0
        size += n
    return [*out, (begin, len(lengths))] if len(lengths) > begin else out


def bit_filter(df: DataFrame, column: str) -> np.ndarray:
    """BLOCKS words of 64 bits with one bit set for each number of the column, whatever their count."""
    n = F.col(column)
    rows = df.select(F.shiftrightunsigned(n, 64 - (BLOCKS.bit_length() - 1)).cast("int").alias("k"), F.call_function("shiftleft", F.lit(1).cast("bigint"), n.bitwiseAND(63).cast("int")).alias("b")).groupBy("k").agg(F.bit_or("b").alias("b"))
    out = np.zeros(BLOCKS, np.uint64)
    found = rows.toPandas()  # at most BLOCKS rows
    out[found["k"].to_numpy(np.int64)] = found["b"].to_numpy(np.int64).view(np.uint64)
    return out


def passes(bits: np.ndarray, number: np.ndarray) -> np.ndarray:
    n = number.view(np.uint64)
    return (bits[(n >> np.uint64(64 - (BLOCKS.bit_length() - 1))).astype(np.int64)] >> (n & np.uint64(63))) & np.uint64(1) == 1
