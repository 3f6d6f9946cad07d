"""Segmentation: paragraphs packed into chunks, reference lists cut into entries."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from ..functions import text as t
from ..functions.arrow import map_rows

_ENTRY = re.compile(r"(?m)^\s*(?:\[(\d{1,4})\]|(\d{1,4})\.)\s+")


def pack_paragraphs(paragraphs: list[str], most: int = 1000, least: int = 200) -> list[str]:
    """Paragraphs joined while they fit `most` characters; longer ones are cut at the last sentence end past 40 %, else the last blank past 30 %, else hard. A last chunk under `least` goes to the one before if it fits there twice over."""
    parts: list[str] = []
    for p in paragraphs:
        while len(p) > most:
            end = max((m.end() for m in re.finditer(r"[.!?。！？]\s?", p[:most])), default=0)
            if end < 0.4 * most:
                blank = p.rfind(" ", 0, most)
                end = blank + 1 if blank >= 0.3 * most else most
            parts.append(p[:end].strip())
            p = p[end:].strip()
        if p:
            parts.append(p)
    out: list[str] = []
    for p in parts:
        if out and len(out[-1]) + 2 + len(p) <= most:
            out[-1] += "\n\n" + p
        else:
            out.append(p)
    if len(out) > 1 and len(out[-1]) < least and len(out[-2]) + len(out[-1]) + 2 <= 2 * most:
        out[-2:] = ["\n\n".join(out[-2:])]
    return out


def chunks(texts: DataFrame, id_col: str = "id", text_col: str = "body", most: int = 1000) -> DataFrame:
    """id, chunk_no, n_chunks, chunk of every text; null and blank texts give none."""

    def cut(r: dict):
        found = pack_paragraphs([p.strip() for p in re.split(r"\n\s*\n", r["text"]) if p.strip()], most)
        return [(r["id"], k, len(found), c) for k, c in enumerate(found, 1)]

    return map_rows(texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("length(text) > 0"), cut, "id bigint, chunk_no int, n_chunks int, chunk string")


def reference_entries(texts: DataFrame, id_col: str = "id", text_col: str = "body") -> DataFrame:
    """id, entry_no, entry, doi, arxiv_id, year, title of numbered reference lists: [1] or 1. at line starts; wrapped lines are joined, divided words too."""

    def cut(r: dict):
        text = r["text"]
        starts = [m for m in _ENTRY.finditer(text)]
        out = []
        for a, b in zip(starts, [*starts[1:], None]):
            raw = text[a.end() : b.start() if b else len(text)]
            raw = re.split(r"\n\s*\n", raw)[0]
            entry = re.sub(r"\s+", " ", re.sub(r"(?<=[a-z])-\n\s*(?=[a-z])", "", raw)).strip()
            doi = re.search(r"10\.\d{4,9}/[^\s\"<>]+", entry)
            arxiv = re.search(r"(?i)arxiv[:./\s]*(?:abs/)?(\d{4}\.\d{4,7}|[a-z-]+/\d{7})", entry)
            clean = re.sub(r"10\.\d{4,9}/\S+|\d{4}\.\d{4,7}", "", entry)
            years = re.findall(r"\((1[89]\d\d|20\d\d)[a-z]?\)", clean) or re.findall(r"\b(1[89]\d\d|20\d\d)\b", clean)[-1:]
            quoted = re.search(r"[\"“]([^\"”]{8,}?)[,.]?[\"”]", entry)
            rest = [s.strip() for s in re.split(r"\.\s+", entry) if len(s.split()) >= 3 and not re.search(r"\b[A-Z]\.|\bet al\b|,.*,.*\band\b", s)]
            out.append((r["id"], int(a.group(1) or a.group(2)), entry, doi.group().rstrip(".,;)]}") if doi else None, arxiv.group(1) if arxiv else None, int(years[0]) if years else None, quoted.group(1) if quoted else (rest[0].rstrip(".") if rest else None)))
        return out

    return map_rows(texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("length(text) > 0"), cut, "id bigint, entry_no int, entry string, doi string, arxiv_id string, year int, title string")


def title_phrases(c) -> "F.Column":
    """All two- to four-word phrases of a title inside runs without stop words."""
    stop = F.array(*[F.lit(w) for w in t.SECTION_STOPWORDS])
    words = t.all_matches(F.lower(F.coalesce(t._c(c), F.lit(""))), r"[a-z0-9][a-z0-9-]*")
    grams = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(1))), lambda i: F.slice(words, i, n))
    ok = lambda n: F.transform(F.filter(grams(n), lambda g: (F.size(g) == n) & (F.size(F.array_intersect(g, stop)) == 0)), lambda g: F.array_join(g, " "))
    return F.array_distinct(F.concat(ok(2), ok(3), ok(4)))
