"""Continuous paragraphs from scanned pages.

Page furniture is found by page-number lines and the running headers that stand beside them anywhere in the
collection; words divided over line ends are joined where the corpus knows the joined word; misread characters
are corrected by a noisy channel: the probability of each character confusion, estimated from the collection, times
the corpus n-gram likelihood, decoded line by line by Viterbi over the candidate words.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.arrow import SLICE, map_rows
from ..session import cut, spread
from .coded import WORD, bit_filter, code, numbers_of, pair_numbers, passes, plain, slices, sums, weight_of

#: Fixed values: (what is read, what was printed, probability of that confusion where it can happen, before any text was seen).
CONFUSIONS = [
    ("c", "e", 0.01), ("f", "t", 0.01), ("l", "i", 0.01), ("0", "o", 0.02), ("5", "s", 0.02), ("1", "l", 0.02), ("1", "i", 0.01),
    ("cl", "d", 0.01), ("9", "g", 0.02), ("ii", "u", 0.01), ("rn", "m", 0.01), ("b", "h", 0.01), ("m", "in", 0.005), ("h", "li", 0.005),
    ("n", "ri", 0.005), ("vv", "w", 0.01), ("d", "cl", 0.005), ("8", "b", 0.02), ("6", "b", 0.01), ("m", "rn", 0.005), ("i", "l", 0.005),
    ("e", "c", 0.005), ("2", "z", 0.005), ("q", "g", 0.002), ("h", "b", 0.002),
]
#: Chinese characters taken for others of a like shape, each with probability HAN at first.
HAN_CONFUSIONS = dict(zip("旳钓囹教摸牲炼凋捡佔椐玛己末土曰干问体侍持晴渐析拆型径祖侧扬标枸洛核险扳夏拟旧堤网杈准冶清秆汁", "的约图数模性练调检估据码已未士日千间休待特情惭折折形经组测场际构络该验板复似归提冈权维治请科计"))

HAN = 0.02
#: Every confusion by its place: those of letters, then of Chinese characters.
RULES = [(a, b, p) for a, b, p in CONFUSIONS] + [(a, b, HAN) for a, b in HAN_CONFUSIONS.items()]
START = [p for _, _, p in RULES]

_HAN_RULE = {a: len(CONFUSIONS) + k for k, a in enumerate(HAN_CONFUSIONS)}
#: Both ways of reading digits as letters, with the confusion that each stands for.
_DIGITS = [({c: next((b, k) for k, (a, b, _) in enumerate(CONFUSIONS) if a == c and b in "osbglizt" and (c != "1" or b == one)) for c in "0589126"}) for one in "li"]

_ENDS = frozenset(".!?。！？:：;；)]\"”’|")
_NUMBER = regex.compile(r"(?:page|seite|p\.|s\.|página|pág\.)\s*\d{1,4}|[-–—·•]\s*\d{1,4}\s*[-–—·•]|\[\d{1,4}\]|第\s*\d{1,4}\s*页|[ivxlc]{1,7}|\d{1,4}", regex.I)
_GAP = regex.compile(r"[^\S\n]{3,}|\t")
_DIVIDED = regex.compile(r"([\p{L}\p{N}]+)[-¬‐\u00AD]$")
_FIRST = regex.compile(r"[\p{L}\p{N}]+")
_LETTERS = regex.compile(r"[\p{L}]")
_OTHER = regex.compile(r"[^\p{L}\p{N}]+")
_CLAUSES = regex.compile(r"[,;。，；]|[.!?] ")
_OWN_LINE = regex.compile(r"[-•*·]\s|\(?\p{L}\)\s|\d+[.)]\s|Table \d|[\d.]+(?:\s[\d.]+)+$")
_TABLE_ROW = regex.compile(r"Table \d+$|[\d.]+(?:\s[\d.]+)+$")
_EAST_END, _EAST_START, _EAST_MARK = regex.compile(r"[\p{Han}，。；：！？）]"), regex.compile(r"[\p{Han}\p{L}\d，。；：！？（\[]"), "，。；：！？）"
_SENTENCE_END = regex.compile(r"[.!?。！？:：]['\"”’)\]]*$")

#: A line is a running header if this share of the sections in which it stands alone have it beside a page number, two more against it being thought of.
BESIDE = 0.6
#: How often a word that the collection does not have elsewhere is to be expected, and how much a section's own words count above those of others.
NOVEL, OWN = 0.4, 10.0
#: Weight of the table of confusions against what is seen, in places where the confusion could have happened.
TRUST = 2000.0


def _number_line(line: str) -> tuple[bool, str]:
    """(is the line a page number, alone or beside a header; the header, if it has one)."""
    t = line.strip()
    if not t:
        return False, ""
    if _NUMBER.fullmatch(t):
        return True, ""
    parts = [p.strip() for p in _GAP.split(t)]
    if len(parts) == 2:
        a, b = parts
        if _NUMBER.fullmatch(a) and not _NUMBER.fullmatch(b) and not b[-1:].isdigit():
            return True, b
        if _NUMBER.fullmatch(b) and not _NUMBER.fullmatch(a) and not a[-1:].isdigit():
            return True, a
    return False, ""


def _header_key(line: str) -> str:
    return _OTHER.sub(" ", line.casefold()).strip()


def is_page(body: str) -> bool:
    """Does a line break off inside a sentence? Only pages that were scanned, or set in lines, have one."""
    k = body.find("\n")
    while k >= 0:
        j = k - 1
        while j >= 0 and body[j] != "\n" and body[j].isspace():
            j -= 1
        if j >= 0 and body[j] != "\n" and body[j] not in _ENDS and body[k + 1 : k + 2] not in ("", "\n"):
            return True
        k = body.find("\n", k + 1)
    return False


def _width(lines: list[str]) -> int:
    return max(map(len, lines), default=0)


def _headerlike(line: str, width: int) -> bool:
    """No sentence and no full line."""
    t = line.strip()
    return 0 < len(t) <= 0.75 * width and bool(_LETTERS.search(t)) and not _CLAUSES.search(t)


def header_evidence(body: str) -> list[tuple[str, int]]:
    """(key, 1 if beside a page number else 0) of lines that may be running headers."""
    lines = body.split("\n")
    number = [_number_line(x) for x in lines]
    if not any(x for x, _ in number):
        return [(key, 0) for key in {_header_key(x) for x in lines if _headerlike(x, _width(lines))} if key]
    width = _width(lines)
    out: dict[str, int] = {}
    for k, (line, (is_number, header)) in enumerate(zip(lines, number)):
        if header:
            out[_header_key(header)] = 1
        elif not is_number and _headerlike(line, width):
            beside = (k and number[k - 1][0] and not number[k - 1][1]) or (k + 1 < len(lines) and number[k + 1][0] and not number[k + 1][1])
            key = _header_key(line)
            if key:
                out[key] = max(out.get(key, 0), int(beside))
    return list(out.items())


def strip_furniture(body: str, headers: set[str], title: str | None = None) -> tuple[list[str], int]:
    """Lines without page numbers and running headers; how many lines went. Blank lines around them go, too, where they split a sentence."""
    lines = body.split("\n")
    number = [_number_line(x) for x in lines]
    own = _header_key(title) if title else None
    drop = [False] * len(lines)
    widest = _width(lines)
    for k, (is_number, header) in enumerate(number):
        if not is_number:
            continue
        if header:
            drop[k] = True
            continue
        near = [j for j in (k - 1, k + 1) if 0 <= j < len(lines) and lines[j].strip() and not number[j][0]]
        hit = [j for j in near if _headerlike(lines[j], widest) and (_header_key(lines[j]) in headers or _header_key(lines[j]) == own)]
        # a bare number or numeral may be text; among words it is a page number if it stands between or beside text lines
        drop[k] = True
        for j in hit[:1] if len(hit) == 1 else [j for j in hit if j == k + 1] or hit[:1]:
            drop[j] = True
    for k, line in enumerate(lines):
        if not drop[k] and not number[k][0] and line.isupper() and _headerlike(line, widest) and _header_key(line) in headers and not (k and lines[k - 1].strip() and _SENTENCE_END.search(lines[k - 1].strip()) is None and len(lines[k - 1]) < 20):
            drop[k] = True
    n = sum(drop)
    if not n:
        return lines, 0
    width = max((len(x) for x, gone in zip(lines, drop) if not gone), default=0)
    out: list[str] = []
    k = 0
    while k < len(lines):
        if drop[k]:
            blank = False
            while out and not out[-1].strip():
                out.pop()
                blank = True
            while k < len(lines) and (drop[k] or not lines[k].strip()):
                blank |= not lines[k].strip()
                k += 1
            # a page that ended with its paragraph has a short last line and a blank one; else the paragraph goes on
            if blank and out and k < len(lines) and _SENTENCE_END.search(out[-1].strip()) and len(out[-1].strip()) < 0.75 * width:
                out.append("")
            continue
        out.append(lines[k])
        k += 1
    return out, n


def _head(line: str) -> str | None:
    """The part of a divided word at the end of a line."""
    last = line.rstrip()
    m = last and last[-1] in "-¬‐\u00ad" and _DIVIDED.search(last.rpartition(" ")[2])
    return m.group(1) if m else None


def divisions(lines: list[str]) -> list[tuple[int, int, str, str]]:
    """(line, next line with text, head, tail) of words that a mark at a line end may divide."""
    out = []
    for k in range(len(lines) - 1):
        if (head := _head(lines[k])) is None:
            continue
        j = k + 1
        while j < len(lines) and not lines[j].strip():
            j += 1
        if j < len(lines) and (f := _FIRST.match(lines[j].lstrip())):
            out.append((k, j, head, f.group()))
    return out


def possible_divisions(body: str) -> set[tuple[str, str]]:
    """(head, tail) of all words that may be divided, whichever lines turn out to be furniture."""
    lines = body.split("\n")
    out = set()
    for k in range(len(lines) - 1):
        if (head := _head(lines[k])) is None:
            continue
        for j in range(k + 1, len(lines)):
            if f := _FIRST.match(lines[j].lstrip()):
                out.add((head, f.group()))
            if lines[j].strip() and not any(_number_line(lines[i])[0] for i in (j - 1, j, j + 1) if k < i < len(lines)):
                break  # text: nothing behind it can be the rest of the word
    return out


def printed_forms(words: list[str], bits: np.ndarray) -> list[tuple[int, str, tuple[int, ...]]]:
    """(place in the list, what may have been printed there, the confusions by their places in RULES): one confusion of letters, any number of digits.

    Only what the bit filter of known words lets through is ever written out: the number of a changed word follows from
    sums over the word, whatever its length.
    """
    out: dict[tuple[int, str], tuple[int, ...]] = {}

    def add(k: int, w: str, rules: tuple[int, ...]) -> None:
        if w != words[k] and ((k, w) not in out or math.prod(START[r] for r in rules) > math.prod(START[r] for r in out[k, w])):
            out[k, w] = rules

    bases: list[tuple[int, str, tuple[int, ...]]] = []
    for k, w in enumerate(words):
        if w in _HAN_RULE:
            add(k, HAN_CONFUSIONS[w], (_HAN_RULE[w],))
        elif len(w) > 1 and not w.isdigit() and any(c.isalpha() for c in w):
            bases.append((k, w, ()))
            if any(c in _DIGITS[0] for c in w):  # digits inside a word are read wrongly for certain: all are put right together, then one more confusion may be undone
                for table in _DIGITS:
                    bases.append((k, "".join(table[c][0] if c in table else c for c in w), tuple(table[c][1] for c in w if c in table)))
                    add(*bases[-1])
    text = "\0".join(w for _, w, _ in bases)
    if not text:
        return [(k, w, r) for (k, w), r in out.items()]
    points, total, power, inverse = sums(text)
    end = np.cumsum([len(w) + 1 for _, w, _ in bases]) - 1
    begin = end - [len(w) for _, w, _ in bases]
    with np.errstate(over="ignore"):
        for rule, (a, b, _) in enumerate(CONFUSIONS):
            hit = points == ord(a[0])
            if len(a) == 2:
                hit[:-1] &= points[1:] == ord(a[1])
                hit[-1] = False
            at = np.flatnonzero(hit)
            if not len(at):
                continue
            base = np.searchsorted(end, at)
            s, e = begin[base], end[base]
            shift = power[len(b) - len(a)] if len(b) >= len(a) else inverse[len(a) - len(b)]
            number = ((total[at] - total[s]) + np.uint64(weight_of(b)) * power[at] + (total[e] - total[at + len(a)]) * shift) * inverse[s]
            for x in np.flatnonzero(passes(bits, number.view(np.int64) & ~1)).tolist():
                k, w, sure = bases[base[x]]
                i = int(at[x] - s[x])
                add(k, w[:i] + b + w[i + len(a) :], (*sure, rule))
    return [(k, w, r) for (k, w), r in out.items()]


def words_of(text: str) -> list[str]:
    return [m.group() for m in WORD.finditer(text.lower())]


Suspects = dict[str, list[tuple[str, float, int]]]


def _lattice(words: list[str], suspects: Suspects, own: Counter) -> list[list[tuple[str, float, float | None]]]:
    """(candidate, log channel probability, corpus frequency) of each word; no frequency where there is nothing to choose.

    A word as read is counted without the place in question; words of the section count more than those of others.
    """
    rows = []
    for w in words:
        if w not in suspects:
            rows.append([(w, 0.0, None)])
            continue
        seen, cands = NOVEL, []
        for c, p, n in suspects[w]:
            if c == w:
                seen += max(n - 1, 0)
            else:
                cands.append((c, p, n + OWN * own[c]))
        rows.append([(w, math.log(0.95), seen), *cands])
    return rows


def needed_bigrams(lines: list[list[str]], suspects: Suspects, own: Counter) -> set[tuple[str, str]]:
    out = set()
    for words in lines:
        rows = _lattice(words, suspects, own)
        for a, b in zip(rows, rows[1:]):
            if len(a) > 1 or len(b) > 1:
                out |= {(x[0], y[0]) for x in a for y in b}
    return out


def _follows(c: int, v: float | None, w: float | None) -> float:
    """Log of how likely a word of frequency w follows one of frequency v, seen together c times; unseen pairs fall back to the frequencies."""
    if v is None and w is None:
        return 0.0
    if v is None:
        return math.log(c + 0.02 * w)
    if w is None:
        return math.log((c + 0.01 * v) / (v + 1))
    return math.log((c + 0.0002 * v * w) / (v + 1))


def viterbi(words: list[str], suspects: Suspects, own: Counter, bigrams: dict[tuple[str, str], int]) -> list[str]:
    """The likeliest words behind those read in a line."""
    rows = [[("", 0.0, None)], *_lattice(words, suspects, own), [("", 0.0, None)]]
    if all(len(r) == 1 for r in rows):
        return words
    best: list[dict[str, tuple[float, str | None]]] = [{"": (0.0, None)}]
    for before, row in zip(rows, rows[1:]):
        step = {}
        for w, p, f in row:
            score, v = max(((best[-1][v][0] + _follows(bigrams.get((v, w), 0), g, f), v) for v, _, g in before), key=lambda x: x[0])
            step[w] = (score + p, v)
        best.append(step)
    w, out = "", []
    for k in range(len(best) - 1, 0, -1):
        w = best[k][w][1]
        out.append(w)
    return out[-2::-1]


def _cased(seen: str, printed: str) -> str:
    if seen.isupper() and len(seen) > 1:
        return printed.upper()
    return printed[:1].upper() + printed[1:] if seen[:1].isupper() else printed


def join_lines(lines: list[str], known: dict[str, int]) -> tuple[list[str], int]:
    """Lines with divided words put together on the first of their lines; how many there were.

    A compound that was broken at its own hyphen keeps it and is no damage: its halves are words, its joined form is not.
    """
    lines, n = list(lines), 0
    for k, j, head, tail in reversed(divisions(lines)):
        mark = lines[k].rstrip()[-1]
        whole, parts = known.get((head + tail).lower(), 0), min(known.get(head.lower(), 0), known.get(tail.lower(), 0))
        compound = known.get(f"{head}-{tail}".lower(), 0)
        stem, rest = lines[k].rstrip()[:-1], lines[j].lstrip()[len(tail) :]
        if compound and compound >= whole or (not whole and parts) or tail.isdigit() or tail[:1].isupper() and head[-1:].islower() and not whole:
            lines[k], lines[j] = f"{stem}-{tail}{rest}", None
        else:
            lines[k], lines[j], n = f"{stem}{tail}{rest}", None, n + 1
        if not mark or lines[k] is None:
            continue
        for x in range(k + 1, j):
            lines[x] = None
        lines = [x for x in lines if x is not None]
    return lines, n


def paragraphs(lines: list[str]) -> str:
    """Lines joined into paragraphs; blank lines, list items and table rows keep their own lines."""
    out: list[list[str]] = []
    for line in lines:
        t = line.strip()
        if not t:
            out.append([])
        elif out and out[-1] and not _OWN_LINE.match(t) and not (len(out[-1]) == 1 and _TABLE_ROW.match(out[-1][0])):
            if not (t[0] in _EAST_MARK or _EAST_END.match(out[-1][-1][-1]) and _EAST_START.match(t)):
                out[-1].append(" ")
            out[-1].append(t)
        else:
            out.append([t])
    return regex.sub(r"\n{3,}", "\n\n", "\n".join("".join(x) for x in out)).strip()


# --- counts of the collection --------------------------------------------------------------------------------------


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of counts by number."""
    number, at = np.unique(np.concatenate([n for n, _ in parts]), return_inverse=True)
    return number, np.bincount(at, np.concatenate([c for _, c in parts])).astype(np.int64)


_SCAN = "kind string, id bigint, title string, body string, word string, number bigint, n bigint, n_page bigint"


def scan(texts: DataFrame) -> DataFrame:
    """One pass over all texts: rows of kind "page" (id, title, body in ordinary characters) and of kind "word" (word, its number with an even last bit, n, n_page: occurrences in all texts and on pages; sums of one task).

    Compounds with their hyphen count as words, too. texts: id, title, body.
    """
    types = to_arrow_schema(StructType.fromDDL(_SCAN))

    def batch_of(kind: str, size: int, **columns: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([kind] * size if f.name == "kind" else columns.get(f.name, [None] * size), f.type) for f in types], schema=types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        names: dict[int, str] = {}
        known = np.zeros(0, np.int64)

        def words() -> pa.RecordBatch:
            number, n = _merged(parts)
            out: dict[int, list[int]] = {}
            for x, c in zip(number.tolist(), n.tolist()):  # the lowest bit keeps pages apart
                own = out.setdefault(x & ~1, [0, 0])
                own[0] += c
                own[1] += c if x & 1 else 0
            return batch_of("word", len(out), word=[names[x] for x in out], number=list(out), n=[a for a, _ in out.values()], n_page=[b for _, b in out.values()])

        for batch in batches:
            bodies = batch.column("body").to_pylist()
            for a, z in slices(list(map(len, bodies))):
                texts = plain(bodies[a:z])
                page = np.array([is_page(t) for t in texts], bool)
                at = np.flatnonzero(page)
                if len(at):
                    rows = batch.slice(a, z - a).take(pa.array(at))
                    yield batch_of("page", len(at), id=rows.column("id"), title=rows.column("title"), body=[texts[k] for k in at])
                c = code(texts)
                bound = np.flatnonzero((c.begin[1:] == c.end[:-1] + 1) & (c.doc[1:] == c.doc[:-1]))
                bound = bound[c.points[c.end[bound]] == ord("-")]
                number = np.concatenate([c.number, pair_numbers(c.number)[bound]]) & ~1
                doc, begin, end = (np.concatenate([x, x[y]]) for x, y in ((c.doc, bound), (c.begin, bound), (c.end, bound + 1)))
                uniq, n = np.unique(number | page[doc], return_counts=True)
                parts.append((uniq, n))
                even = uniq & ~1
                fresh = even[known[np.minimum(np.searchsorted(known, even), len(known) - 1)] != even] if len(known) else even
                if len(fresh):
                    for k in np.flatnonzero(np.isin(number, fresh)).tolist():
                        if (x := int(number[k])) not in names:
                            names[x] = c.text[begin[k] : end[k]]
                    known = np.union1d(known, fresh)
                if len(names) > 1_000_000:
                    yield words()
                    parts, names, known = [], {}, np.zeros(0, np.int64)
                elif len(parts) > 64:
                    parts = [_merged(parts)]
        if parts:
            yield words()

    return texts.mapInArrow(run, _SCAN)


def count_pairs(texts: DataFrame, wanted: np.ndarray) -> DataFrame:
    """g, n: occurrences of neighbouring words by the pair's number, of the pairs that the bit filter lets through."""
    shared = texts.sparkSession.sparkContext.broadcast(wanted)  # of fixed size

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            texts = batch.column("body").to_pylist()
            for a, z in slices(list(map(len, texts))):
                c = code(plain(texts[a:z]))
                g = pair_numbers(c.number)[c.doc[1:] == c.doc[:-1]]
                parts.append(np.unique(g[passes(shared.value, g)], return_counts=True))
            if len(parts) > 64:
                parts = [_merged(parts)]
                if len(parts[0][0]) > 2_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(parts[0][0]), pa.array(parts[0][1])], names=["g", "n"])
                    parts = []
        if parts:
            g, n = _merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(n)], names=["g", "n"])

    return texts.select("body").mapInArrow(count, "g bigint, n bigint").groupBy("g").agg(F.sum("n").alias("n"))


# --- the channel ----------------------------------------------------------------------------------------------------


def _channel(rules: Iterable[int], p: list[float]) -> float:
    return math.prod(p[r] for r in rules)


def confusion_rates(candidates: DataFrame, lexicon: DataFrame, rounds: int = 2) -> list[float]:
    """Probability of each of RULES, from the table and what the collection shows: a few rounds of expectation and maximisation.

    candidates: n_read, n_page, cands (word, rules, n), one row for each word as read. A reading is shared out between the
    word itself and what may have been printed; what falls to a confusion, over the places where it could have happened
    on a page, is its next probability.
    """

    def chances(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(RULES))
        for pdf in batches:
            for word, n in zip(pdf["word"], pdf["n_page"]):
                for k, (_, b, _) in enumerate(RULES):
                    if b in word:
                        total[k] += n * word.count(b)
        yield pd.DataFrame({"rule": np.arange(len(RULES)), "x": total})

    def falls(p: list[float]):
        def expect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(len(RULES))
            for pdf in batches:
                for n_read, n_page, cands in zip(pdf["n_read"], pdf["n_page"], pdf["cands"]):
                    weights = [c["n"] * _channel(c["rules"], p) for c in cands]
                    every = sum(weights) + NOVEL + max(n_read - 1, 0)
                    for w, c in zip(weights, cands):
                        for r in c["rules"]:
                            total[r] += n_page * w / every
            yield pd.DataFrame({"rule": np.arange(len(RULES)), "x": total})

        return expect

    def summed(df: DataFrame, f) -> np.ndarray:
        out = np.zeros(len(RULES))
        for r in df.mapInPandas(f, "rule int, x double").groupBy("rule").agg(F.sum("x").alias("x")).collect():  # a row for each of RULES
            out[r.rule] = r.x
        return out

    possible = summed(lexicon.where("n_page > 0").select("word", "n_page"), chances)
    p = START
    for _ in range(rounds):
        seen = summed(candidates.select("n_read", "n_page", "cands"), falls(p))
        p = [(s + TRUST * q) / (o + TRUST) for s, q, o in zip(seen, START, possible)]
        # pages without any damage are among those counted: a damaged one has as much as the table says, spread as the collection shows
        level = (possible * START).sum() / max((possible * p).sum(), 1e-9) if possible.any() else 1.0
        p = [min(0.3, max(1e-5, x * level)) for x in p]
    return p


# --- repair ---------------------------------------------------------------------------------------------------------

#: Salts of the lines that may be headers: one header may stand in a third of all sections.
SALTS = 16


_WORK = "doc bigint, id bigint, n_lines int, furniture int, hyphenation int, lines string, suspects array<struct<w:string,n:bigint,cands:array<struct<c:string,p:double,n:bigint>>>>, pairs array<struct<a:string,b:string,g:bigint>>"
_REPAIRED = "id bigint, n_lines int, furniture int, hyphenation int, misread int, repaired string"


def repair_pages(nodes: DataFrame, id_col: str = "id", body_col: str = "body", title_col: str = "title") -> DataFrame:
    """id, n_lines, furniture, hyphenation, misread (counts of what was repaired) and repaired text of every stored row that is a page.

    Pages are told by a line that breaks off inside a sentence. Null and empty bodies are none; null titles and ids do
    not matter; rows that repeat are repaired each for itself, whatever their ids. Other columns are ignored. An empty table gives none. Line breaks alone are undone but
    are no damage. Corpus counts are taken over all rows.
    """
    base = nodes.select(F.col(id_col).cast("bigint").alias("id"), F.col(title_col).cast("string").alias("title"), F.col(body_col).alias("body"))
    texts = spread(base.where("length(body) > 0"))
    # pages are read several times below, and their row numbers must not change
    scanned = cut(scan(texts).withColumn("doc", F.monotonically_increasing_id()))
    pages = scanned.where("kind = 'page'").select("doc", "id", "title", "body")
    lexicon = cut(scanned.where("kind = 'word'").groupBy("word").agg(F.first("number").alias("number"), F.sum("n").alias("n"), F.sum("n_page").alias("n_page")))

    def evidence(r: dict):
        out = [(r["doc"], "h", key, beside) for key, beside in header_evidence(r["body"])]
        parts = {w for x, y in possible_divisions(r["body"]) for w in (x.lower(), y.lower(), (x + y).lower(), f"{x}-{y}".lower())}
        return out + [(r["doc"], "p", w, 0) for w in parts]

    found = cut(map_rows(pages.select("doc", "body"), evidence, "doc bigint, kind string, key string, beside int"))
    headers = found.where("kind = 'h'").groupBy("key").agg(F.sum("beside").alias("b"), F.count(F.lit(1)).alias("n")).where(F.col("b") >= BESIDE * (F.col("n") + 2))
    parts = found.where("kind = 'p'").select(F.col("key").alias("word")).distinct()
    known = parts.join(lexicon.select("word", "n"), "word")

    # what may have been printed where a word was read: most of it is no word of the collection and goes before anything is shuffled
    words = nodes.sparkSession.sparkContext.broadcast(bit_filter(lexicon, "number"))  # of fixed size

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read, n_read, n_page = (batch.column(k).to_pylist() for k in ("read", "n_read", "n_page"))
            rows = [(read[k], n_read[k], n_page[k], c, list(rules)) for k, c, rules in printed_forms(read, words.value)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32())))], names=["read", "n_read", "n_page", "word", "rules"])

    reads = lexicon.where("n_page > 0 and not contains(word, '-')").select(F.col("word").alias("read"), F.col("n").alias("n_read"), "n_page")
    divided = parts.where("not contains(word, '-')").join(lexicon, "word", "left_anti").select(F.col("word").alias("read"), F.lit(0).cast("bigint").alias("n_read"), F.lit(0).cast("bigint").alias("n_page"))
    every = cut(
        reads.unionByName(divided)
        .repartition(nodes.sparkSession.sparkContext.defaultParallelism, "read")
        .mapInArrow(candidates, "read string, n_read bigint, n_page bigint, word string, rules array<int>")
        .join(lexicon.select("word", "n"), "word")
        .groupBy("read")
        .agg(F.first("n_read").alias("n_read"), F.first("n_page").alias("n_page"), F.collect_list(F.struct("word", "rules", "n")).alias("cands"))  # at most the expansions of one word
    )
    rates = confusion_rates(every, lexicon)

    def suspicious(r: dict):
        # those that could win if all their occurrences were in one section
        fit = [{"c": c["word"], "p": math.log(p), "n": c["n"]} for c in r["cands"] if (p := _channel(c["rules"], rates)) * (1 + OWN) * c["n"] >= 0.95 * (NOVEL + max(r["n_read"] - 1, 0))]
        return [(r["read"], int(numbers_of([r["read"]])[0]), r["n_read"], fit)] if fit else []

    suspects = cut(map_rows(every, suspicious, "read string, number bigint, n_read bigint, cands array<struct<c:string,p:double,n:bigint>>"))
    shared = nodes.sparkSession.sparkContext.broadcast(bit_filter(suspects, "number"))  # of fixed size

    def occurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, docs = batch.column("body").to_pylist(), batch.column("doc").to_numpy()
            for a, z in slices(list(map(len, texts))):
                c = code(texts[a:z])
                at = np.flatnonzero(passes(shared.value, c.number))
                words = {(d, c.text[i:j]) for d, i, j in zip(c.doc[at].tolist(), c.begin[at].tolist(), c.end[at].tolist())}
                yield pa.RecordBatch.from_arrays([pa.array([docs[a + d] for d, _ in words], pa.int64()), pa.array([w for _, w in words], pa.string())], names=["doc", "key"])

    # what each page has of headers, known words and suspects: found by one join, brought to the page by another
    salt = F.pmod("doc", F.lit(SALTS)).cast("int")
    wanted = (
        pages.select("doc", "body").mapInArrow(occurring, "doc bigint, key string").select("doc", F.lit("s").alias("kind"), "key", F.lit(0).alias("salt"))
        .unionByName(found.where("kind = 'p'").select("doc", F.explode(F.array(F.lit("s"), F.lit("p"))).alias("kind"), "key", F.lit(0).alias("salt")))
        .unionByName(found.where("kind = 'h'").select("doc", "kind", "key", salt.alias("salt")))
    )
    none = F.lit(None).cast("array<struct<c:string,p:double,n:bigint>>")
    facts = (
        suspects.select(F.lit("s").alias("kind"), F.col("read").alias("key"), F.lit(0).alias("salt"), F.col("n_read").alias("n"), "cands")
        .unionByName(known.select(F.lit("p").alias("kind"), F.col("word").alias("key"), F.lit(0).alias("salt"), "n", none.alias("cands")))
        .unionByName(headers.select(F.lit("h").alias("kind"), "key", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), "n", none.alias("cands")))
    )
    lists = wanted.join(facts, ["kind", "key", "salt"]).groupBy("doc").agg(F.collect_set(F.struct("kind", "key", "n", "cands")).alias("facts"))
    def prepared(r: dict) -> tuple[list[str], int, int, Suspects]:
        have = r["facts"] or ()
        headers = {x["key"] for x in have if x["kind"] == "h"}
        known = {x["key"]: x["n"] for x in have if x["kind"] == "p"}
        suspects: Suspects = {x["key"]: [(x["key"], 0.0, x["n"]), *((c["c"], c["p"], c["n"]) for c in x["cands"])] for x in have if x["kind"] == "s"}
        lines, furniture = strip_furniture(r["body"], headers, r["title"])
        for w, cands in suspects.items():  # a word divided over a line end may be misread, too
            if w not in known and cands[0][2] == 0:
                known[w] = max(n for _, _, n in cands[1:])
        lines, hyphenation = join_lines(lines, known)
        return lines, furniture, hyphenation, suspects

    types = to_arrow_schema(StructType.fromDDL(_WORK))

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                out, pairs, needs = [], [], []
                for r in batch.slice(k, SLICE).to_pylist():
                    lines, furniture, hyphenation, suspects = prepared(r)
                    split = [words_of(x) for x in lines] if suspects else []
                    own = Counter(w for x in split for w in x)
                    needs.append(sorted(needed_bigrams(split, suspects, own)) if suspects else [])
                    pairs += needs[-1]
                    found = [{"w": w, "n": x[0][2], "cands": [{"c": c, "p": p, "n": n} for c, p, n in x[1:]]} for w, x in suspects.items()]
                    out.append((r["doc"], r["id"], r["body"].count("\n") + 1, furniture, hyphenation, "\n".join(lines), found or None))
                place = {w: i for i, w in enumerate({w for p in pairs for w in p})}
                number = numbers_of(place)
                g = iter(pair_numbers(number[np.array([(place[a], place[b]) for a, b in pairs], np.int64).ravel()])[::2].tolist() if pairs else ())
                rows = [(*x, [{"a": a, "b": b, "g": next(g)} for a, b in need] or None) for x, need in zip(out, needs)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), types)], schema=types)

    work = cut(pages.join(lists, "doc", "left").select("doc", "id", "title", "body", "facts").mapInArrow(prepare, _WORK))
    needed = work.where("pairs is not null").select("doc", F.explode("pairs").alias("x")).select("doc", "x.*")
    counted = count_pairs(texts, bit_filter(needed, "g")).where("n > 1")
    bigrams = needed.join(counted, "g").groupBy("doc").agg(F.collect_list(F.struct("a", "b", "n")).alias("bigrams"))

    def finish(r: dict):
        lines, misread = r["lines"].split("\n"), 0
        if r["suspects"]:
            suspects: Suspects = {x["w"]: [(x["w"], 0.0, x["n"]), *((c["c"], c["p"], c["n"]) for c in x["cands"])] for x in r["suspects"]}
            split = [words_of(x) for x in lines]
            own = Counter(w for x in split for w in x)
            counts = {(x["a"], x["b"]): x["n"] for x in r["bigrams"] or ()}
            for k, words in enumerate(split):
                if not any(w in suspects for w in words):
                    continue
                best = viterbi(words, suspects, own, counts)
                wrong = [i for i, (a, b) in enumerate(zip(words, best)) if a != b]
                at = [m.span() for m in WORD.finditer(lines[k])] if wrong else []
                misread += len(wrong)
                if len(at) == len(words):  # lower-casing may change the number of tokens in rare scripts
                    text = lines[k]
                    for i in reversed(wrong):
                        b, e = at[i]
                        text = text[:b] + _cased(text[b:e], best[i]) + text[e:]
                    lines[k] = text
        return [(r["id"], r["n_lines"], r["furniture"], r["hyphenation"], misread, paragraphs(lines))]

    # pages with nothing to choose wait for no counts
    own = ["id", "n_lines", "furniture", "hyphenation", "lines", "suspects"]
    sure = map_rows(work.where("suspects is null").select(*own), finish, _REPAIRED)
    fixed = sure.unionByName(map_rows(work.where("suspects is not null").join(bigrams, "doc", "left").select(*own, "bigrams"), finish, _REPAIRED))
    return fixed


def repair_scans(nodes: DataFrame, id_col: str = "id", body_col: str = "body", title_col: str = "title") -> DataFrame:
    """The rows of repair_pages and, with zero counts, those of all other bodies, in ordinary characters and with their lines joined; every stored row once.

    Null and empty bodies are returned as they are, with no lines.
    """
    rest = nodes.select(F.col(id_col).cast("bigint").alias("id"), F.col(body_col).alias("body"))

    def join(r: dict):
        b = r["body"]
        if not b:
            return [(r["id"], 0, 0, 0, 0, b)]
        t = plain([b])[0]
        return [] if is_page(t) else [(r["id"], b.count("\n") + 1, 0, 0, 0, paragraphs(t.split("\n")) if "\n" in t else t)]

    return repair_pages(nodes, id_col, body_col, title_col).unionByName(map_rows(rest, join, _REPAIRED))


def damage(repaired: DataFrame) -> DataFrame:
    """(id, damage): one row for each kind of damage that was repaired; a single misread word is no case."""
    kinds = F.filter(F.array(F.when(F.col("hyphenation") > 0, F.lit("hyphenation")), F.when(F.col("misread") > 1, F.lit("misread")), F.when(F.col("furniture") > 0, F.lit("furniture"))), lambda x: x.isNotNull())
    return repaired.select("id", F.explode(kinds).alias("damage"))
