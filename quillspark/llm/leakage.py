"""Evaluation texts inside training texts.

Each shard of the corpus gets an FM-index over word ids: the Burrows-Wheeler transform in a wavelet matrix, with every
fourth suffix position kept. Phrases of the evaluation items are found by backward search, located by walking to a
kept position, chained in order within a document, and their places are merged into spans to remove.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window, functions as F

from .coded import code, numbers_of, slices
from .unify import ordinary

PHRASE = {("passage", False): 5, ("passage", True): 8, ("question", False): 4, ("question", True): 6}  # tokens of a phrase by part and Chinese, whose characters are tokens
LIKELY = 0.18  # share of a passage in exact phrases from which it is aligned; a third needs no alignment
SHARE, QUESTION = 0.28, 0.8  # alignment score a token of a passage; share of a question
GAP = 3.0  # the price of an interruption, however long
SAMPLE = 4
SHARD = 500_000  # tokens
_DIVIDED = re.compile("(?<=[^\\W\\d_])[-\u00ac\u2010\u00ad][ \\t]*\\n\\s*(?=[^\\W\\d_])")
_ACCENT = re.compile("[\u0300-\u036f]+")
#: Characters that are not their own ordinary form, or whose neighbours may not be.
_UNUSUAL = re.compile("[^\\t-~\u00a1-\u00ac\u00ae-\u02ff\u2010-\u2027\u2030-\u205e\u2070-\u20cf\u3001-\u303f\u4e00-\u9fff\uff01\uff08\uff09\uff0c\uff1a\uff1b\uff1f]")
#: What stands between blanks, line-end divisions included; a Chinese character by itself.
_PLACED = regex.compile(r"\p{Han}|(?:[^\s\p{Han}]|(?<=[\p{L}\p{M}\p{Cf}][-¬‐\u00ad])[ \t]*\n\s*(?=\p{L}))+", regex.V1)


def folded(text: str) -> str:
    """The text without case, accents, look-alikes and line-end division: its words are what stays the same in any outward form."""
    if not text.isascii():
        text = (ordinary(text) if _UNUSUAL.search(text) else text).casefold()
        if not text.isascii():
            text = _ACCENT.sub("", unicodedata.normalize("NFD", text))
    return _DIVIDED.sub("", text) if "\n" in text else text


def fold(text: str) -> list[str]:
    """Words of the folded text."""
    c = code([folded(text)])
    return [c.text[i:j] for i, j in zip(c.begin.tolist(), c.end.tolist())]


# --- FM-index ------------------------------------------------------------------------------------------------------


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; only suffixes that are still tied are sorted again. t ends with a unique smallest symbol."""
    n = len(t)
    sa = np.argsort(t.astype(np.uint16) if t.max() < 65536 else t, kind="stable")  # a radix sort for few symbols
    rank = np.zeros(n, np.int64)
    s = t[sa]
    head = np.concatenate([[True], s[1:] != s[:-1]])
    rank[sa] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    step = 1
    while True:
        r = rank[sa]
        tied = np.zeros(n, bool)
        same = r[1:] == r[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        at = np.flatnonzero(tied)
        if not len(at):
            return sa
        suf = sa[at]
        key = rank[suf] * (n + 1) + np.where(suf + step < n, rank[np.minimum(suf + step, n - 1)] + 1, 0)
        order = np.argsort(key, kind="stable")
        suf, key = suf[order], key[order]
        sa[at] = suf  # a group's rows are consecutive, and keys begin with the group's rank
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        rank[suf] = np.maximum.accumulate(np.where(fresh, at, 0))
        step *= 2


class FMIndex:
    """Counts and places of phrases in a sequence of small integers; 0 stands for everything else and is never searched."""

    def __init__(self, text: np.ndarray, symbols: int):
        t = np.concatenate([text.astype(np.int64) + 1, [0]])
        sa = suffix_array(t)
        bwt = t[sa - 1]  # before the first symbol stands the last
        self.n = len(t)
        kept = sa % SAMPLE == 0
        self.kept = kept
        self.kept_rank = np.concatenate([[0], np.cumsum(kept)]).astype(np.int32)
        self.kept_at = sa[kept].astype(np.int32)
        counts = np.bincount(t, minlength=symbols + 2)
        self.first = np.concatenate([[0], np.cumsum(counts)[:-1]])
        self.bits = max(1, int(symbols + 1).bit_length())
        self.rank1, self.zeros, self.bit = [], [], []
        seq = bwt
        start = np.zeros(len(counts), np.int64)
        sym = np.arange(len(counts))
        for level in range(self.bits - 1, -1, -1):
            b = (seq >> level) & 1
            ones = np.concatenate([[0], np.cumsum(b)]).astype(np.int32)
            z = int(len(b) - ones[-1])
            self.bit.append(b.astype(bool))
            self.rank1.append(ones)
            self.zeros.append(z)
            up = ((sym >> level) & 1).astype(bool)
            start = np.where(up, z + ones[start], start - ones[start])
            seq = np.concatenate([seq[b == 0], seq[b == 1]])
        self.start = start

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of symbol c among the first i of the transform."""
        for k in range(self.bits):
            ones = self.rank1[k][i]
            i = np.where((c >> (self.bits - 1 - k)) & 1, self.zeros[k] + ones, i - ones)
        return i - self.start[c]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that begin with each phrase."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, k] + 1
            low[live] = self.first[c] + self.rank(c, low[live])
            high[live] = self.first[c] + self.rank(c, high[live])
            live = live[high[live] > low[live]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Position of the suffix in each row: steps back through the text until a kept one."""
        rows, out, steps = rows.copy(), np.zeros(len(rows), np.int64), 0
        left = np.arange(len(rows))
        while len(left):
            r = rows[left]
            hit = self.kept[r]
            out[left[hit]] = self.kept_at[self.kept_rank[r[hit]]] + steps
            left, r = left[~hit], r[~hit]
            i, c = r, np.zeros(len(r), np.int64)
            for k in range(self.bits):
                b, ones = self.bit[k][i], self.rank1[k][i]
                c = c * 2 + b
                i = np.where(b, self.zeros[k] + ones, i - ones)
            rows[left] = self.first[c] + i - self.start[c]
            steps += 1
        return out


# --- phrases and chains ---------------------------------------------------------------------------------------------


class Phrases:
    """All phrases of the evaluation items with the places where they stand in them."""

    def __init__(self, items: list[tuple[int, str | None, str | None]]):
        self.ids: dict[str, int] = {}
        self.parts: list[tuple[int, str, list[int]]] = []
        self.must: list[set[int]] = []
        self.sizes: list[int] = []
        seen: dict[str, int] = {}
        folded = []
        for item, question, passage in items:
            for part, text in (("question", question), ("passage", passage)):
                words = fold(text) if text else []
                if words:
                    folded.append((item, part, words))
                    if part == "question":
                        for w in set(words):
                            seen[w] = seen.get(w, 0) + 1
        rows: dict[int, list[tuple[tuple[int, ...], int, int]]] = {}
        for item, part, words in folded:
            ids = [self.ids.setdefault(w, len(self.ids) + 1) for w in words]
            number = len(self.parts)
            self.parts.append((item, part, ids))
            # what makes a question this question: its figures, and words that hardly any other question has
            self.must.append({k for k, w in enumerate(words) if w.isdigit() or (seen.get(w, 0) <= 2 and len(w) > 1)} if part == "question" else set())
            han = sum("一" <= w <= "鿿" for w in words) > len(words) / 2
            size = min(PHRASE[part, han], len(ids))
            self.sizes.append(size)
            for k in range(len(ids) - size + 1):
                rows.setdefault(size, []).append((tuple(ids[k : k + size]), number, k))
        # words by their numbers, sorted
        number = numbers_of(self.ids)
        order = np.argsort(number, kind="stable")
        self.numbers, self.places = number[order], np.array(list(self.ids.values()), np.int64)[order]
        self.groups = []
        for size, found in rows.items():
            index: dict[tuple[int, ...], int] = {}
            which = np.array([index.setdefault(p, len(index)) for p, _, _ in found], np.int64)
            order = np.argsort(which, kind="stable")
            place = np.array([(n, k) for _, n, k in found], np.int64)[order]
            begin = np.searchsorted(which[order], np.arange(len(index) + 1))
            self.groups.append((size, np.array(list(index), np.int64).reshape(len(index), size), begin, place))


    def coded(self, number: np.ndarray) -> np.ndarray:
        """Word ids by the words' numbers; 0 for what no item has."""
        if not len(self.numbers):
            return np.zeros(len(number), np.int64)
        at = np.minimum(np.searchsorted(self.numbers, number), len(self.numbers) - 1)
        return np.where(self.numbers[at] == number, self.places[at], 0)


def _spread(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, value) of all values of the ranges [begin, end)."""
    n = end - begin
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + begin[which]


def chain(runs: list[tuple[int, int, int]], length: int, price: float | None = None) -> tuple[list[tuple[int, int, int]], int]:
    """Best ordered chain of runs (place in document, place in item, tokens). A shift costs up to `price`, however long the interruption; without a price up to half a phrase, and gaps are at most as long as half the item.

    Beside it a number of tokens of the item that neither this chain nor the best one of any part of the runs exceeds: a run
    follows another in some best chain only if what the other brings is more than the step costs, and fewer runs bring less.
    """
    runs = sorted(runs)
    most, reach, longest = GAP if price is None else price, 2 * length + 60, max(40, length // 2)
    if runs[-1][0] - min(i + n for i, _, n in runs) <= max(40, length // 2):
        price = None  # nothing is far
    best: list[tuple[float, int, int]] = []
    covers: list[int] = []  # tokens that a best chain which ends with the run may cover
    furthest, widest = 0.0, 0
    ended: list[tuple[int, int]] = []  # runs by where they end in the document
    tree = [(0.0, -1)] * (length + 2)  # best score of the ended runs by where they end in the item: a Fenwick tree of maxima
    for k, (i, j, n) in enumerate(runs):
        score, prev, cover = float(n), -1, n
        for g in range(k - 1, -1, -1):
            a, b, m = runs[g]
            if a < i - reach:
                break
            have = best[g][0]
            if have + n <= score and covers[g] + n <= cover or b >= j or a >= i or i - a - m > longest:
                continue
            over = a + m - i if a + m - i > b + m - j else b + m - j
            have -= abs(i - j - a + b) * 0.5 if abs(i - j - a + b) * 0.5 < most else most
            if over > 0:
                if over >= n:
                    continue
                have -= over
            if have <= 0:
                continue
            cover = max(cover, covers[g] + n - max(0, b + m - j))
            if have + n > score:
                score, prev = have + n, g
        if price is not None:
            while ended and ended[0][0] <= i:
                g = heapq.heappop(ended)[1]
                widest = max(widest, covers[g])
                x = runs[g][1] + runs[g][2] + 1
                while x < len(tree):
                    tree[x] = max(tree[x], (best[g][0], g))
                    x += x & -x
            cover = max(cover, widest + n)
            if furthest - price + n > score:
                x, far = j + 1, (0.0, -1)
                while x:
                    far = max(far, tree[x])
                    x -= x & -x
                if far[0] - price + n > score:
                    score, prev = far[0] - price + n, far[1]
            if score > price:  # else no run gains by following it
                heapq.heappush(ended, (i + n, k))
                furthest = max(furthest, score)
        best.append((score, prev, k))
        covers.append(cover)
    out, k = [], max(best)[2]
    while k >= 0:
        out.append(runs[k])
        k = best[k][1]
    return out[::-1], max(covers)


def _leaks(docs: list[np.ndarray], phrases: Phrases) -> list[tuple[int, int, float, int, int]]:
    """(document, part, share, begin, end) of one shard; places count tokens of the document."""
    # runs of words that no item has are one symbol: places are kept beside the text
    text, place, owner = [], [], []
    for k, ids in enumerate(docs):
        keep = np.ones(len(ids), bool)
        keep[1:] = (ids[1:] != 0) | (ids[:-1] != 0)
        at = np.flatnonzero(keep)
        text += [ids[at], np.zeros(1, np.int64)]
        place += [at, np.zeros(1, np.int64)]
        owner.append(np.full(len(at) + 1, k))
    text, place, owner = np.concatenate(text), np.concatenate(place), np.concatenate(owner)
    index = FMIndex(text, len(phrases.ids))
    found = []
    for size, wanted, begin, where in phrases.groups:
        low, high = index.search(wanted)
        hit = np.flatnonzero(high > low)
        if not len(hit):
            continue
        which, rows = _spread(low[hit], high[hit])
        at = index.locate(rows)
        which = hit[which]
        many, entry = _spread(begin[which], begin[which + 1])
        found.append(np.stack([owner[at[many]], where[entry, 0], place[at[many]], where[entry, 1], np.full(len(many), size)], 1))
    if not found:
        return []
    a = np.concatenate(found)
    diagonal = a[:, 2] - a[:, 3]
    low, span = int(diagonal.min()), int(diagonal.max() - diagonal.min()) + 1
    order = np.argsort(((a[:, 0] * len(phrases.parts) + a[:, 1]) * span + diagonal - low) * (int(a[:, 2].max()) + 1) + a[:, 2], kind="stable")
    a, diagonal = a[order], diagonal[order]
    # hits that follow each other on a diagonal are one run
    new = np.ones(len(a), bool)
    new[1:] = (a[1:, 0] != a[:-1, 0]) | (a[1:, 1] != a[:-1, 1]) | (diagonal[1:] != diagonal[:-1]) | (a[1:, 2] > a[:-1, 2] + a[:-1, 4])
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(a)) - 1
    runs = np.stack([a[heads, 0], a[heads, 1], a[heads, 2], a[heads, 3], a[tails, 2] + a[tails, 4] - a[heads, 2]], 1)
    # the runs of a document and part must be able to reach the share together, whatever their order
    pair = np.ones(len(runs), bool)
    pair[1:] = (runs[1:, 0] != runs[:-1, 0]) | (runs[1:, 1] != runs[:-1, 1])
    first = np.flatnonzero(pair)
    last = np.append(first[1:], len(runs))
    # tokens of the part that stand in any run, all pairs at once: ends are carried forward within a pair
    number = np.repeat(np.arange(len(first)), last - first)
    order = np.lexsort((runs[:, 3], number))
    j, n, far = runs[order, 3], runs[order, 4], int((runs[:, 3] + runs[:, 4]).max()) + 1
    reach = np.maximum.accumulate(number * far + j + n)
    before = np.maximum(np.concatenate([[0], reach[:-1]]) - number * far, j)
    total = np.bincount(number, np.maximum(j + n - before, 0))
    lengths = np.array([len(p[2]) for p in phrases.parts])
    share = np.array([LIKELY if p[1] == "passage" else 0.3 for p in phrases.parts])
    out = []
    there: tuple[int, set[int]] = (-1, set())
    for k in np.flatnonzero(total >= share[runs[first, 1]] * lengths[runs[first, 1]]):
        d, p = int(runs[first[k], 0]), int(runs[first[k], 1])
        if phrases.must[p]:  # a question stands where all its own words do
            if there[0] != d:
                there = d, set(docs[d].tolist())
            if not all(phrases.parts[p][2][x] in there[1] for x in phrases.must[p]):
                continue
        out += [(d, p, *x) for x in _places([tuple(r) for r in runs[first[k] : last[k], 2:5].tolist()], phrases, p, docs[d])]
    return out


def _covered(runs: list[tuple[int, int, int]]) -> int:
    """Tokens of the item that stand in any of the runs."""
    if len(runs) == 1:
        return runs[0][2]
    total, reach = 0, 0
    for j, n in sorted((j, n) for _, j, n in runs):
        total += max(0, j + n - max(j, reach))
        reach = max(reach, j + n)
    return total


def _places(runs: list[tuple[int, int, int]], phrases: Phrases, p: int, doc: np.ndarray) -> list[tuple[float, int, int]]:
    """(share, begin, end) of every place of part p in a document: chains are taken from the runs that are left until those cannot make one. The rest of a passage that has a place is one too, wherever it stands, if it is more than a phrase."""
    _, part, ids = phrases.parts[p]
    least = (LIKELY if part == "passage" else 0.3) * len(ids)
    out: list[tuple[float, int, int]] = []
    left = runs
    while _covered(left) >= least:
        # after an interruption a run must bring more than a phrase that any text may share; a question stands in one place
        used, most = chain(left, len(ids), 2.0 * phrases.sizes[p] if part == "passage" else None)
        if most < least:
            break  # nor will any chain of those left
        places = _checked(used, phrases, p, doc) if _covered(used) >= least else []
        taken = set(used)
        out += places
        left = [r for r in left if r not in taken and not any(b <= r[0] and r[0] + r[2] <= e for _, b, e in places)]
    if out and part == "passage":
        # what the places have of the passage is no leak again unless it makes a place itself; the rest of the passage is
        inside = [any(b <= i and i + n <= e for _, b, e in out) for i, _, n in runs]
        had = {x for (_, j, n), x_in in zip(runs, inside) if x_in for x in range(j, j + n)}
        rest = sorted(r for r, x_in in zip(runs, inside) if not x_in and not had.issuperset(range(r[1], r[1] + r[2])))
        begin = 0
        for k, (i, j, n) in enumerate(rest):
            if k + 1 < len(rest) and j < rest[k + 1][1] <= j + n + 6 and rest[k + 1][0] <= i + n + 6:
                continue  # a word or two edited
            group = rest[begin : k + 1]
            if _covered(group) >= 2 * phrases.sizes[p]:  # less is a phrase that any text may share
                out.append((min(1.0, _covered(group) / len(ids)), group[0][0], max(a + m for a, _, m in group)))
            begin = k + 1
    return out


def _checked(used: list[tuple[int, int, int]], phrases: Phrases, p: int, doc: np.ndarray) -> list[tuple[float, int, int]]:
    """(share, begin, end) of the places that a chain stands for, if enough of the part is there; text that interrupts it for long is no part of them."""
    _, part, ids = phrases.parts[p]
    slack = len(ids) // 2 + 6
    if part == "question":
        # the exact check: the question aligned with the place found, its own words all there
        lo, hi = max(0, used[0][0] - used[0][1] - 6), min(len(doc), used[-1][0] + len(ids) - used[-1][1] + 6)
        same = _aligned(ids, doc[lo:hi].tolist())
        return [(len(same) / len(ids), lo, hi)] if len(same) >= QUESTION * len(ids) and phrases.must[p] <= same else []
    pieces = [[used[0]]]
    for r, s in zip(used, used[1:]):
        if s[0] - (r[0] + r[2]) > max(40, len(ids) // 2):
            pieces.append([])
        pieces[-1].append(s)
    if (same := _covered(used)) * 3 >= len(ids):  # so much of it stands there word for word and in order
        return [(same / len(ids), x[0][0], x[-1][0] + x[-1][2]) for x in pieces]
    # the exact check: the best local alignment around each piece, edits and all, as long as what is left can still reach the share
    total, found = 0.0, []
    windows = []
    for k, x in enumerate(pieces):
        a = pieces[k - 1][-1][1] + pieces[k - 1][-1][2] if k else 0
        b = pieces[k + 1][0][1] if k + 1 < len(pieces) else len(ids)
        lo, hi = max(0, x[0][0] - min(x[0][1], slack) - 6), min(len(doc), x[-1][0] + x[-1][2] + min(len(ids) - x[-1][1], slack) + 6)
        there = set(doc[lo:hi].tolist())
        windows.append((ids[a:b], lo, hi, sum(x in there for x in ids[a:b]) - (GAP if k else 0)))
    hope = sum(w[3] for w in windows)
    for k, (own, lo, hi, most) in enumerate(windows):
        if hope < SHARE * len(ids):
            return []
        score, first_token, last_token = local_alignment(np.array(own), doc[lo:hi], most=GAP, need=SHARE * len(ids) - (hope - most) + (GAP if k else 0))
        score -= GAP if k else 0
        total, hope = total + score, hope - most + score
        found.append((lo + first_token, lo + last_token))
    return [(min(1.0, total / len(ids)), b, e) for b, e in found] if total >= SHARE * len(ids) else []


def local_alignment(a: np.ndarray, b: np.ndarray, miss: float = 0.6, gap: float = 0.4, most: float = np.inf, need: float = 0.0) -> tuple[float, int, int]:
    """Best score of a stretch of a against one of b (1 for a match, less `miss` or `gap` for an edit, a gap at most `most`), and where it lies in b; it may stop where `need` is out of reach. Rows are computed at once: a gap along a row is a running maximum."""
    slope = np.arange(len(b) + 1) * gap
    row, origin = np.zeros(len(b) + 1), np.arange(len(b) + 1)
    above, above_origin = row, origin  # the best of all rows so far
    top, where = 0.0, (0, 0)
    present = np.isin(a, b)
    after = present[::-1].cumsum()[::-1] - present  # matches that the rows below can add
    for x, more in zip(a, after):
        here = np.zeros(len(b) + 1)
        source = np.arange(len(b) + 1)
        diagonal = row[:-1] + np.where(b == x, 1.0, -miss)
        better = diagonal > 0
        here[1:][better], source[1:][better] = diagonal[better], origin[:-1][better]
        for up, start in ((row - gap, origin), (above - most, above_origin)):
            better = up > here
            here[better], source[better] = up[better], start[better]
        lifted = here + slope
        best = np.maximum.accumulate(lifted)
        at = np.maximum.accumulate(np.where(lifted >= best, np.arange(len(best)), 0))
        row = best - slope
        highest = np.maximum.accumulate(here)
        jump = highest - most > row
        at[jump] = np.maximum.accumulate(np.where(here >= highest, np.arange(len(best)), 0))[jump]
        row = np.maximum(np.where(jump, highest - most, row), 0.0)
        origin = np.where(row > 0, source[at], np.arange(len(b) + 1))
        higher = row > above
        above, above_origin = np.where(higher, row, above), np.where(higher, origin, above_origin)
        j = int(row.argmax())
        if row[j] > top:
            top, where = float(row[j]), (int(origin[j]), j)
        if top + more < need:
            break
    return top, where[0], where[1]


def _aligned(a: list[int], b: list[int]) -> set[int]:
    """Places of a that a longest common subsequence with b uses."""
    m = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            m[i][j] = m[i + 1][j + 1] + 1 if a[i] == b[j] else max(m[i + 1][j], m[i][j + 1])
    i, j, out = 0, 0, set()
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.add(i)
            i, j = i + 1, j + 1
        elif m[i + 1][j] >= m[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def _word_places(text: str) -> list[tuple[int, int]]:
    """Code points of every folded word in the stored text; where folding joins or divides what stands between blanks, the words have that stretch in common."""
    spans = [m.span() for m in _PLACED.finditer(text)]
    pieces = [folded(text[i:j]) for i, j in spans]
    c = code(pieces)
    starts = np.cumsum([0] + [len(p) + 1 for p in pieces])
    out = []
    for k, i, j in zip(c.doc.tolist(), c.begin.tolist(), c.end.tolist()):
        b, e = spans[k]
        # a character for a character, or the whole stretch
        out.append((b + i - int(starts[k]), b + j - int(starts[k])) if len(pieces[k]) == e - b else (b, e))
    return out


def _characters(places: list[tuple[int, int]], n_tokens: int, length: int, begin: int, end: int) -> tuple[int, int]:
    """Code points of the tokens [begin, end). Should the words of the pieces not be those of the whole, places are in proportion, a tenth of the text wider on both sides."""
    if begin >= end:
        return 0, length
    if len(places) != n_tokens:
        wide = length // 10
        return max(0, begin * length // n_tokens - wide), min(length, end * length // n_tokens + wide)
    return places[begin][0], max(e for _, e in places[begin : min(end, n_tokens)])


SCHEMA = "doc_id bigint, item_id bigint, part string, share double, begin_pos int, end_pos int"


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = 5000) -> DataFrame:
    """doc_id, item_id, part (question or passage), share of it, begin_pos, end_pos in the document's code points.

    items: item_id, question, passage; the held-out set, which the caller bounds: it is taken to every shard in
    blocks of `block` items. Null ids and null or empty texts, questions and passages give no rows; repeated documents give rows
    for each stored row; other columns are ignored; an empty table on either side gives none. Documents are searched
    whole, wherever they lie: nothing is shuffled.
    """
    wanted = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and length(text) > 0")
    held: list[tuple[int, str | None, str | None]] = []
    out = None
    for r in items.where("item_id is not null").select("item_id", "question", "passage").toLocalIterator():
        held.append((r.item_id, r.question, r.passage))
        if len(held) == block:
            out, held = _search(wanted, Phrases(held), out), []
    return _search(wanted, Phrases(held), out) if held or out is None else out


def _search(docs: DataFrame, phrases: Phrases, others: DataFrame | None) -> DataFrame:
    """Rows of SCHEMA for one block of items, added to those of other blocks; a task holds one block at a time."""
    shared = docs.sparkSession.sparkContext.broadcast(phrases)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        phrases = shared.value
        held: list[tuple[int, str]] = []
        coded: list[np.ndarray] = []
        size = 0

        def flush() -> pd.DataFrame:
            out, places = [], {}
            for d, p, share, begin, end in _leaks(coded, phrases):
                doc, text = held[d]
                if d not in places:
                    places[d] = _word_places(text)
                b, e = _characters(places[d], len(coded[d]), len(text), begin, end)
                out.append((doc, phrases.parts[p][0], phrases.parts[p][1], share, b, e))
            return pd.DataFrame(out, columns=["doc_id", "item_id", "part", "share", "begin_pos", "end_pos"]).astype({"doc_id": "int64", "item_id": "int64", "share": "float64", "begin_pos": "int32", "end_pos": "int32"})

        for pdf in batches:
            ids, texts = pdf["doc_id"].tolist(), pdf["text"].tolist()
            for a, z in slices(list(map(len, texts))):
                c = code([folded(t) for t in texts[a:z]])
                words = phrases.coded(c.number)
                bound = np.searchsorted(c.doc, np.arange(z - a + 1))
                for k in range(z - a):
                    if bound[k + 1] > bound[k]:
                        held.append((ids[a + k], texts[a + k]))
                        coded.append(words[bound[k] : bound[k + 1]])
                size += len(words)
                if size >= SHARD:
                    yield flush()
                    held, coded, size = [], [], 0
        if held:
            yield flush()

    found = docs.mapInPandas(search, SCHEMA)
    return found if others is None else others.unionByName(found)


def removal_spans(leaks: DataFrame) -> DataFrame:
    """doc_id, begin_pos, end_pos, items: overlapping or touching places of a document merged into one span."""
    w = Window.partitionBy("doc_id").orderBy("begin_pos", "end_pos")
    marked = leaks.withColumn("reach", F.max("end_pos").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    numbered = marked.withColumn("span", F.sum(F.when(F.col("begin_pos") > F.coalesce("reach", F.lit(-1)), 1).otherwise(0)).over(w))
    return numbered.groupBy("doc_id", "span").agg(F.min("begin_pos").alias("begin_pos"), F.max("end_pos").alias("end_pos"), F.array_sort(F.collect_set("item_id")).alias("items")).drop("span")
