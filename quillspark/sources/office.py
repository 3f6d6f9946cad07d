"""Blocks of DOCX and PPTX files, read as zipped XML; a broken file never loses the others."""

from __future__ import annotations

import hashlib
import io
import re
import xml.etree.ElementTree as ET
import zipfile

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.arrow import map_rows
from . import markup

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
#: (kind, level, text, page): what a reader gives for a file; page is the slide of a presentation.
Block = tuple[str, int, str, int]


def _clean(parts) -> str:
    return re.sub(r"\s+", " ", "".join(parts)).strip()


def docx_blocks(raw: bytes) -> list[Block]:
    """Headings by style, paragraphs, list items and tables in the order of the body; a table is one block, a line for each row."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    text = lambda p: _clean(t.text or "" if t.tag == f"{_W}t" else " " for t in p.iter() if t.tag in (f"{_W}t", f"{_W}tab", f"{_W}br"))
    out: list[Block] = []
    for e in body if body is not None else ():
        if e.tag == f"{_W}p" and (s := text(e)):
            style = e.find(f"{_W}pPr/{_W}pStyle")
            name = style.get(f"{_W}val", "") if style is not None else ""
            m = re.fullmatch(r"(?i)(?:heading|titre|berschrift|überschrift|标题)\s?([1-9])", name)
            if m or name.lower() == "title":
                out.append(("heading", int(m.group(1)) if m else 1, s, 0))
            else:
                out.append(("list" if e.find(f"{_W}pPr/{_W}numPr") is not None else "paragraph", 0, s, 0))
        elif e.tag == f"{_W}tbl":
            rows = [" | ".join(_clean(t.text or "" for t in c.iter(f"{_W}t")) for c in r.findall(f"{_W}tc")) for r in e.findall(f"{_W}tr")]
            if any(r.strip(" |") for r in rows):
                out.append(("table", 0, "\n".join(rows), 0))
    return out


def pptx_blocks(raw: bytes) -> list[Block]:
    """Titles as headings, text, tables and notes of every slide, slides in the order of their numbers."""
    out: list[Block] = []
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        number = lambda n: int(re.search(r"(\d+)\.xml$", n).group(1))
        for name in sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=number):
            k = number(name)
            for shape in ET.fromstring(z.read(name)).iter():
                if shape.tag == f"{_P}sp":
                    kind = shape.find(f"{_P}nvSpPr/{_P}nvPr/{_P}ph")
                    title = kind is not None and kind.get("type") in ("title", "ctrTitle")
                    for p in shape.iter(f"{_A}p"):
                        if s := _clean(t.text or "" for t in p.iter(f"{_A}t")):
                            out.append(("heading" if title else "paragraph", 1 if title else 0, s, k))
                elif shape.tag == f"{_A}tbl":
                    rows = [" | ".join(_clean(t.text or "" for t in c.iter(f"{_A}t")) for c in r.findall(f"{_A}tc")) for r in shape.findall(f"{_A}tr")]
                    out.append(("table", 0, "\n".join(rows), k))
            note = f"ppt/notesSlides/notesSlide{k}.xml"
            if note in z.namelist() and (s := _clean(t.text or "" for t in ET.fromstring(z.read(note)).iter(f"{_A}t"))):
                out.append(("note", 0, s, k))
    return out


def detect(raw: bytes, name: str = "") -> str:
    """Format of a file by what it holds, then by its name: pdf, docx, pptx, zip, image, html, markdown, text, empty or binary."""
    if not raw.strip():
        return "empty"
    for mark, kind in ((b"%PDF", "pdf"), (b"\x89PNG", "image"), (b"\xff\xd8\xff", "image"), (b"GIF8", "image")):
        if raw.startswith(mark):
            return kind
    if raw.startswith(b"PK\x03\x04"):
        try:
            names = set(zipfile.ZipFile(io.BytesIO(raw)).namelist())
        except zipfile.BadZipFile:
            return "zip"
        return "docx" if "word/document.xml" in names else "pptx" if "ppt/presentation.xml" in names or any(n.startswith("ppt/slides/") for n in names) else "zip"
    if b"\0" in raw and not raw.startswith((b"\xff\xfe", b"\xfe\xff")):
        return "binary"
    return "markdown" if name.lower().endswith((".md", ".markdown")) else markup.sniff(markup.decode(raw)[0])


_TEXT = {"html": markup.html_blocks, "markdown": markup.markdown_blocks, "text": markup.text_blocks}
READERS = {"docx": docx_blocks, "pptx": pptx_blocks} | {k: (lambda raw, f=f: [(a, b, c, 0) for a, b, c in f(markup.decode(raw)[0])]) for k, f in _TEXT.items()}

PARSED = "path string, sha string, format string, status string, reason string, n_blocks int, blocks array<struct<kind:string,level:int,text:string,page:int>>"


def parse_files(files: DataFrame) -> DataFrame:
    """PARSED: one row for each file (path, content): ok with its blocks, skipped (a format that is not read, an empty file) or failed with the reason. Never raises for a file."""

    def parse(r: dict):
        raw = bytes(r["content"] or b"")
        sha, kind = hashlib.sha256(raw).hexdigest(), detect(raw, r["path"] or "")
        if kind not in READERS:
            return [(r["path"], sha, kind, "skipped", f"{kind} is not read", 0, [])]
        try:
            found = READERS[kind](raw)
        except Exception as e:  # whatever is wrong with a file, the others are read
            return [(r["path"], sha, kind, "failed", f"{type(e).__name__}: {e}"[:200], 0, [])]
        blocks = [{"kind": k, "level": n, "text": t, "page": p} for k, n, t, p in found]
        return [(r["path"], sha, kind, "ok" if blocks else "skipped", None if blocks else "no text", len(blocks), blocks)]

    return map_rows(files.select("path", "content"), parse, PARSED, 16)


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """PARSED of all files below a path, each content once: of equal files the first path is kept, the others are skipped as copies."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    marked = raw.withColumn("_sha", F.sha2("content", 256))
    first = marked.groupBy("_sha").agg(F.min("path").alias("_first"))
    j = marked.join(first, "_sha")
    copies = j.where("path <> _first").select("path", F.col("_sha").alias("sha"), F.lit("").alias("format"), F.lit("skipped").alias("status"), F.concat(F.lit("copy of "), "_first").alias("reason"), F.lit(0).alias("n_blocks"), F.expr("cast(array() as array<struct<kind:string,level:int,text:string,page:int>>)").alias("blocks"))
    return parse_files(j.where("path = _first").select("path", "content")).unionByName(copies)


def counts(parsed: DataFrame) -> DataFrame:
    """format, ok, skipped, failed."""
    return parsed.groupBy("format").pivot("status", ["ok", "skipped", "failed"]).count().na.fill(0)


def pages(parsed: DataFrame, size: int = 4000, least: int = 200) -> DataFrame:
    """path, page, text: slides as pages, other texts in slices of `size` characters; files with less than `least` characters are left out."""
    ok = parsed.where("status = 'ok'")
    text = F.array_join(F.transform("blocks", lambda b: b["text"]), "\n\n")
    plain = ok.where("format <> 'pptx'").select("path", text.alias("t")).where(F.length("t") >= least)
    cut = plain.select("path", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.length("t") - 1) / size).cast("int")), lambda i: F.substring("t", i * size + 1, F.lit(size)))).alias("page", "text"))
    slides = ok.where("format = 'pptx'").select("path", F.explode("blocks").alias("b")).groupBy("path", F.col("b.page").alias("page")).agg(F.array_join(F.collect_list("b.text"), "\n").alias("text"))
    return cut.select("path", (F.col("page") + 1).alias("page"), "text").unionByName(slides)


def to_markdown(parsed: DataFrame) -> DataFrame:
    """path, markdown: headings with their level, list items, tables as pipes, other blocks as paragraphs."""
    line = lambda b: F.when(b["kind"] == "heading", F.concat(F.repeat(F.lit("#"), F.greatest(b["level"], F.lit(1))), F.lit(" "), b["text"])).when(b["kind"] == "list", F.concat(F.lit("- "), b["text"])).when(b["kind"] == "code", F.concat(F.lit("```\n"), b["text"], F.lit("\n```"))).when(b["kind"] == "table", F.concat(F.lit("| "), F.replace(b["text"], F.lit("\n"), F.lit(" |\n| ")), F.lit(" |"))).otherwise(b["text"])
    return parsed.where("status = 'ok'").select("path", F.array_join(F.transform("blocks", line), "\n\n").alias("markdown"))
