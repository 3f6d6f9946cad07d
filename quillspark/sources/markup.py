"""Documents as typed blocks: HTML, Markdown and plain text; decoding of bytes of unknown encoding."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pyspark.sql import DataFrame, functions as F

from ..functions.arrow import map_rows

SCHEMA = "source_id string, block_no int, kind string, level int, section_path string, text string"
_SKIP = {"script", "style", "nav", "footer", "noscript", "template", "svg"}
_BLOCKS = {"p", "div", "section", "article", "li", "td", "th", "tr", "pre", "blockquote", "ul", "ol", "table", "br"}


class _Html(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, int, str]] = []
        self.text: list[str] = []
        self.kind, self.level, self.skip, self.cells = "paragraph", 0, 0, []

    def flush(self) -> None:
        raw = "".join(self.text)
        t = raw.strip("\n") if self.kind == "code" else re.sub(r"\s+", " ", raw).strip()
        if t:
            self.blocks.append((self.kind, self.level, t))
        self.text, self.kind, self.level = [], "paragraph", 0

    def handle_starttag(self, tag, attrs):
        if tag in _SKIP:
            self.skip += 1
        elif re.fullmatch("h[1-6]", tag):
            self.flush()
            self.kind, self.level = "heading", int(tag[1])
        elif tag == "pre":
            self.flush()
            self.kind = "code"
        elif tag == "li":
            self.flush()
            self.kind = "list"
        elif tag in ("td", "th"):
            self.cells.append("".join(self.text))
            self.text = []
        elif tag == "tr":
            self.flush()
            self.cells, self.kind = [], "table"
        elif tag in _BLOCKS and self.kind not in ("code", "table", "heading"):
            self.flush()

    def handle_endtag(self, tag):
        if tag in _SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag == "tr":
            self.cells.append("".join(self.text))
            self.text = [" | ".join(re.sub(r"\s+", " ", c).strip() for c in self.cells if c.strip())]
            self.flush()
        elif re.fullmatch("h[1-6]", tag) or tag in ("pre", "li", "p", "table"):
            self.flush()

    def handle_data(self, data):
        if not self.skip:
            self.text.append(data)


def html_blocks(text: str) -> list[tuple[str, int, str]]:
    """(kind, level, text) in document order; scripts, styles and navigation are left out."""
    p = _Html()
    p.feed(text)
    p.close()
    p.flush()
    return p.blocks


def markdown_blocks(text: str) -> list[tuple[str, int, str]]:
    text = re.sub(r"\A---\n.*?\n---\n", "", text.replace("\r\n", "\n"), flags=re.S)
    out: list[tuple[str, int, str]] = []
    fence: list[str] | None = None
    for part in re.split(r"(?m)(^```.*$\n?)", text):
        if part.startswith("```"):
            if fence is None:
                fence = []
            else:
                out.append(("code", 0, "".join(fence).rstrip("\n")))
                fence = None
            continue
        if fence is not None:
            fence.append(part)
            continue
        for block in re.split(r"\n\s*\n|\n(?=#{1,6} )", part):
            lines = block.strip().split("\n")
            if m := re.match(r"(#{1,6}) +(.*?)\s*#*$", lines[0]):
                out.append(("heading", len(m.group(1)), m.group(2)))
                lines = lines[1:]
            rest = [x.strip() for x in lines if x.strip()]
            if not rest:
                continue
            if all(x.startswith("|") for x in rest):
                out += [("table", 0, " | ".join(c.strip() for c in x.strip("|").split("|"))) for x in rest if not re.fullmatch(r"[|\s:-]+", x)]
            elif all(re.match(r"[-*+] |\d+[.)] ", x) for x in rest):
                out += [("list", 0, re.sub(r"^([-*+]|\d+[.)]) +", "", x)) for x in rest]
            else:
                out.append(("paragraph", 0, " ".join(rest)))
    if fence:
        out.append(("code", 0, "".join(fence).rstrip("\n")))
    return out


def text_blocks(text: str) -> list[tuple[str, int, str]]:
    return [("paragraph", 0, re.sub(r"\s+", " ", p).strip()) for p in re.split(r"\n\s*\n", text) if p.strip()]


def decode(raw: bytes) -> tuple[str, str]:
    """(text, encoding): byte order mark, UTF-8, GBK, else Latin-1, which always works."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if raw.startswith(mark):
            return raw.decode(name, "replace"), name
    for name in ("utf-8", "gbk"):
        try:
            return raw.decode(name), name
        except UnicodeDecodeError:
            continue
    return raw.decode("latin-1"), "latin-1"


def sniff(text: str) -> str:
    """html by its first tag, markdown by a mark anywhere, else text."""
    head = text.lstrip()
    if re.match(r"(?i)<!doctype html|<html|<(head|body|div|p|h[1-6])\b", head):
        return "html"
    return "markdown" if re.search(r"(?m)^#{1,6} |^```|^[-*] .+\n[-*] ", head) else "text"


_PARSERS = {"html": html_blocks, "markdown": markdown_blocks, "text": text_blocks}


def parse_documents(texts: DataFrame, id_col: str = "path", text_col: str = "text") -> DataFrame:
    """Typed blocks of every text with the path of headings above them. Null and empty texts give no rows."""

    def blocks(r: dict):
        out, path = [], []
        for k, (kind, level, text) in enumerate(_PARSERS[sniff(r["text"])](r["text"]), 1):
            if kind == "heading":
                path = [p for p in path if p[0] < level] + [(level, text)]
            out.append((r["source_id"], k, kind, level, " > ".join(p for _, p in path), text))
        return out

    return map_rows(texts.select(F.col(id_col).cast("string").alias("source_id"), F.col(text_col).alias("text")).where("length(text) > 0"), blocks, SCHEMA)


def read_files(spark, path: str) -> DataFrame:
    """path, text, encoding of all files below a path, read as bytes and decoded; large folders are split by file."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return map_rows(raw, lambda r: [(r["path"], *decode(bytes(r["content"])))], "path string, text string, encoding string", 16)
