"""Readers of bibliographic text: BibTeX, RIS, CSV exports and Atom feeds. A broken entry never loses the others."""

from __future__ import annotations

import csv
import io
import re
import unicodedata
import xml.etree.ElementTree as ET

from pyspark.sql import DataFrame

from ..functions.arrow import map_rows

SCHEMA = "source_id string, entry_no int, title string, abstract string, year int, venue string, authors array<string>, doi string, arxiv_id string, error string"
_FIELDS = ("title", "abstract", "year", "venue", "authors", "doi", "arxiv_id", "error")
#: Fields that may name the venue, in order of precedence.
VENUES = ("journal", "journaltitle", "booktitle", "venue", "publisher", "school", "institution")
#: LaTeX accents and letters.
_ACCENTS = {"'": "\u0301", "`": "\u0300", "^": "\u0302", '"': "\u0308", "~": "\u0303", "c": "\u0327", "v": "\u030c", "=": "\u0304", ".": "\u0307", "u": "\u0306", "H": "\u030b", "r": "\u030a", "d": "\u0323", "b": "\u0331", "k": "\u0328"}
_LETTERS = {"ss": "ß", "o": "ø", "O": "Ø", "l": "ł", "L": "Ł", "ae": "æ", "AE": "Æ", "aa": "å", "AA": "Å", "i": "ı"}


def sniff(text: str) -> str:
    """bibtex, ris, atom, csv or unknown, by what the text holds."""
    head = text.lstrip("\ufeff \t\r\n")
    if re.match(r"TY  ?- ?", head):
        return "ris"
    if re.search(r"(?m)^\s*@\w+\s*[{(]", head):
        return "bibtex"
    if head.startswith("<") and "<entry" in head:
        return "atom"
    return "csv" if "," in head.split("\n", 1)[0] and re.search(r"(?i)title", head.split("\n", 1)[0]) else "unknown"


def unlatex(s: str) -> str:
    """LaTeX accents, letters and escapes as Unicode; grouping braces go."""
    s = re.sub(r"""\\(['`^"~=.]|[cvuHrdbk](?=[\s{]))\s*\{?\\?(\w)\}?""", lambda m: unicodedata.normalize("NFC", m.group(2) + _ACCENTS[m.group(1)]), s)
    s = re.sub(r"\\(ss|ae|AE|aa|AA|o|O|l|L|i)(?![A-Za-z])\s*", lambda m: _LETTERS[m.group(1)], s)
    s = re.sub(r"\\(?:text(?:it|bf|sc|tt|rm|sf)?|emph|mathrm|url)\s*(?=\{)", "", s)
    s = re.sub(r"(?<!\\)~", " ", s)
    return re.sub(r"\s+", " ", re.sub(r"\\([&%$#_{}~])", r"\1", s).replace("{", "").replace("}", "")).strip()


def _closing(text: str, start: int) -> int:
    """Index behind the bracket that closes the one at `start`; -1 if the next entry begins first or the text ends."""
    open_, close = text[start], {"{": "}", "(": ")"}[text[start]]
    depth = 0
    for k in range(start, len(text)):
        c = text[k]
        if c == "\\":
            continue
        if c == open_ and text[k - 1] != "\\":
            depth += 1
        elif c == close and text[k - 1] != "\\":
            depth -= 1
            if depth == 0:
                return k + 1
        elif c == "@" and text[k - 1] == "\n" and re.match(r"@\w+\s*\{", text[k:]):
            return -1
    return -1


def _values(body: str, macros: dict[str, str]) -> dict[str, str]:
    out: dict[str, str] = {}
    k = 0
    while m := re.compile(r"[\s,]*([\w-]+)\s*=\s*").match(body, k):
        k, parts = m.end(), []
        while k < len(body):
            if body[k] == "{":
                end = _closing(body, k)
                end = len(body) if end < 0 else end
                parts.append(body[k + 1 : end - 1])
            elif body[k] == '"':
                end, depth = k + 1, 0
                while end < len(body) and (body[end] != '"' or depth):
                    depth += {"{": 1, "}": -1}.get(body[end], 0)
                    end += 1
                parts.append(body[k + 1 : end])
                end += 1
            else:
                word = re.compile(r"[^,#\s]*").match(body, k)
                end = word.end()
                parts.append(macros.get(word.group().lower(), word.group()))
            more = re.compile(r"\s*#\s*").match(body, end)
            if not more:
                k = end
                break
            k = more.end()
        out.setdefault(m.group(1).lower(), "".join(parts))
        after = body.find(",", k)
        if after < 0:
            break
        k = after
    return out


def _author(name: str) -> str:
    """First name first: "Last, First", and "Last, Jr, First" with the suffix behind."""
    parts = [p.strip() for p in name.split(",")]
    if len(parts) == 1:
        return parts[0]
    last, suffix, first = (parts[0], "", parts[1]) if len(parts) == 2 else (parts[0], parts[1], " ".join(parts[2:]))
    return " ".join(p for p in (first, last, suffix) if p)


def _record(f: dict[str, str], authors: list[str]) -> dict:
    year = re.search(r"\d{4}", f.get("year") or f.get("date") or "")
    doi = re.sub(r"(?i)^https?://(dx\.)?doi\.org/", "", re.sub(r"\s+", "", f.get("doi") or "")) or None
    arxiv = re.sub(r"\s+", "", f.get("eprint") or "") or None
    # an eprint without a prefix is an arXiv id only if it has the form of one
    if arxiv and not ("arxiv" in f["archiveprefix"].lower() if f.get("archiveprefix") else re.fullmatch(r"(?:\d{4}\.\d{4,5}|[a-z-]+(?:\.[A-Z]{2})?/\d{7})(?:v\d+)?", arxiv)):
        arxiv = None
    if not arxiv and (m := re.search(r"arxiv\.org/(?:abs|pdf)/([\w.-]+(?:/\d+)?)", f.get("url") or "", re.I)):
        arxiv = re.sub(r"(v\d+)?(\.pdf)?$", "", m.group(1))
    title = f.get("title") or None
    return {
        "title": title, "abstract": f.get("abstract") or None, "year": int(year.group()) if year else None, "venue": next((f[n] for n in VENUES if f.get(n)), None),
        "authors": [a for a in authors if a and a.lower() not in ("others", "et al", "et al.")], "doi": doi, "arxiv_id": arxiv or None, "error": None if title else "no title",
    }


def read_bibtex(text: str) -> list[dict]:
    """Records of all entries; one that is not closed is reported and reading goes on at the next @ at a line start."""
    out, macros = [], {m: m.capitalize() for m in ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")}
    # a line behind a percent sign is a comment, whatever entries it holds
    text = re.sub(r"(?m)^[ \t]*%.*$", "", text)
    k = 0
    while m := re.compile(r"@\s*(\w+)\s*([{(])").search(text, k):
        kind, end = m.group(1).lower(), _closing(text, m.end() - 1)
        if end < 0:
            following = re.compile(r"(?m)^@").search(text, m.end())
            out.append(dict.fromkeys(_FIELDS) | {"authors": [], "error": f"entry not closed: {text[m.start() : m.start() + 40]!r}"})
            k = following.start() if following else len(text)
            continue
        body, k = text[m.end() : end - 1], end
        if kind in ("comment", "preamble"):
            continue
        if kind == "string":
            macros |= {n: v for n, v in _values(body, macros).items()}
            continue
        raw = _values(body.partition(",")[2], macros)
        people = [_author(unlatex(a)) for a in re.split(r"\s+and\s+(?![^{]*\})", raw.get("author", "")) if a.strip()]
        out.append(_record({n: unlatex(v) if n not in ("doi", "url", "eprint") else v.strip("{} ") for n, v in raw.items()}, people))
    return out


def read_ris(text: str) -> list[dict]:
    out: list[dict] = []
    tags: dict[str, list[str]] = {}
    last = None

    def close(note: str | None) -> None:
        nonlocal tags, last
        if tags:
            one = lambda *names: next((v for n in names for v in tags.get(n, []) if v), "")
            r = _record({"title": one("TI", "T1", "CT"), "abstract": one("AB", "N2"), "year": one("PY", "Y1", "DA"), "journal": one("JO", "JF", "T2", "JA", "BT"), "doi": one("DO"), "url": one("UR")}, [_author(a) for n in ("AU", "A1") for a in tags.get(n, [])])
            out.append(r | ({"error": note} if note and not r["error"] else {}))
        tags, last = {}, None

    for line in text.splitlines():
        if m := re.match(r"([A-Z][A-Z0-9])  ?- ?(.*)$", line):
            tag, value = m.group(1), m.group(2).strip()
            if tag == "TY" and tags:
                close("no end of record")
            if tag == "ER":
                close(None)
                continue
            tags.setdefault(tag, []).append(value)
            last = tag
        elif last and line.strip():
            tags[last][-1] += " " + line.strip()
    close("no end of record")
    return out


def read_csv(text: str) -> list[dict]:
    rows = csv.DictReader(io.StringIO(text.lstrip("\ufeff")))
    out = []
    for row in rows:
        f = {re.sub(r"[^a-z0-9]", "", (k or "").lower()): (v or "").strip() for k, v in row.items() if not isinstance(v, list)}
        first = lambda *names: next((f[n] for n in names if f.get(n)), "")
        out.append(_record({"title": first("title"), "abstract": first("abstractnote", "abstract"), "year": first("publicationyear", "year", "date"), "journal": first("publicationtitle", "journal", "venue"), "doi": first("doi"), "url": first("url")}, [_author(a) for a in re.split(r"\s*;\s*", first("author", "authors")) if a]))
    return out


def read_atom(text: str) -> list[dict]:
    """Entries whose id is a work; error feeds and entries without title give nothing."""
    ns = {"a": "http://www.w3.org/2005/Atom"}
    try:
        entries = ET.fromstring(text).findall("a:entry", ns)
    except ET.ParseError as e:
        return [dict.fromkeys(_FIELDS) | {"authors": [], "error": f"no valid XML: {e}"}]
    out = []
    for e in entries:
        ident = (e.findtext("a:id", "", ns) or "").partition("/abs/")[2].strip()
        title = re.sub(r"\s+", " ", e.findtext("a:title", "", ns) or "").strip()
        if title and re.fullmatch(r"(\d{4}\.\d{4,5}|[a-z-]+(\.[A-Za-z]{2})?/\d{7})(v\d+)?", ident):
            names = [(a.findtext("a:name", "", ns) or "").strip() for a in e.findall("a:author", ns)]
            out.append(_record({"title": title, "abstract": re.sub(r"\s+", " ", e.findtext("a:summary", "", ns) or "").strip(), "year": (e.findtext("a:published", "", ns) or "")[:4], "venue": "arXiv", "eprint": ident}, names))
    return out


READERS = {"bibtex": read_bibtex, "ris": read_ris, "csv": read_csv, "atom": read_atom}


def parse_bibliographies(texts: DataFrame, id_col: str = "path", text_col: str = "text") -> DataFrame:
    """One row for each entry of each text, in order, with an error note where one was broken. Unknown formats, null and empty texts give no rows."""

    def entries(r: dict):
        reader = READERS.get(sniff(r["text"]))
        return [(r["source_id"], k, *(e[f] for f in _FIELDS)) for k, e in enumerate(reader(r["text"]), 1)] if reader else []

    from pyspark.sql import functions as F

    return map_rows(texts.select(F.col(id_col).cast("string").alias("source_id"), F.col(text_col).alias("text")).where("length(text) > 0"), entries, SCHEMA)
