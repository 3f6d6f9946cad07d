"""Small functions on single fields: search terms, claims, identifiers, names, hashes, cards. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import HAN, SPACE, _c, all_matches, collapse

#: Longest clip of a sentence, head and tail of a shortened answer, most of a question, terms of a search.
CLIP, HEAD, TAIL, QUESTION, TERMS = 400, 200, 120, 400, 48
#: Words of sentences that speak about the answer and not about the subject.
META = "未覆盖|通识解释|建议检索|抱歉|无法回答|基于你的问题|根据上下文|以下是|为您|当前上下文|上下文未|库里没有|库内没有|无法列出|检索关键词"
#: Cells that hold nothing.
NOTHING = ["", "-", "--", "—", "–", "n/a", "na", "none", "null", "tbd", "nil", "无", "未知", "未提及", "摘要未提及", "不适用", "暂无", "mock", "待补充"]
DOI = r"10\.[0-9]{4,9}/[-._;()/:A-Za-z0-9]+"


def trigrams(run: Column) -> Column:
    return F.when(F.length(run) < 3, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.length(run) - 2), lambda i: F.substring(run, i, F.lit(3))))


def search_terms(c: str | Column) -> Column:
    """Distinct terms of a search in order, at most TERMS: words without punctuation at their ends, triples of Chinese characters, Latin runs of mixed words."""
    bare = lambda t: F.regexp_replace(t, r"^[-./]+|[-./]+$", "")
    words = F.filter(F.transform(F.split(F.regexp_replace(F.coalesce(_c(c), F.lit("")), r"[^\p{L}\p{N}_+#./-]+", " "), " "), bare), lambda t: F.length(t) >= 2)

    def parts(t: Column) -> Column:
        han = F.flatten(F.transform(all_matches(t, f"[{HAN}]+"), trigrams))
        latin = F.filter(F.transform(all_matches(t, r"[A-Za-z0-9][A-Za-z0-9+#./-]*"), bare), lambda x: F.length(x) >= 2)
        return F.concat(F.array(t), han, F.when(t.rlike(f"[{HAN}]"), latin).otherwise(F.array().cast("array<string>")))

    return F.slice(F.array_distinct(F.flatten(F.transform(words, parts))), 1, TERMS)


def audit_form(c: str | Column) -> Column:
    """Only letters, digits and Chinese characters, lower case."""
    return F.regexp_replace(F.lower(F.coalesce(_c(c), F.lit(""))), f"[^a-z0-9{HAN}]+", "")


def claims(c: str | Column) -> Column:
    """Sentences of 15 or more characters that claim something; a citation behind the full stop belongs to the sentence before it."""
    text = F.regexp_replace(F.coalesce(_c(c), F.lit("")), r"。(\[[0-9]{1,2}\])", "$1。")
    parts = F.split(F.regexp_replace(text, "([。！？!?])", "$1\n"), "\n+")
    clean = F.transform(parts, lambda s: F.trim(F.replace(F.regexp_replace(F.trim(s), r"^[-*•· ]+", ""), F.lit("**"), F.lit(""))))
    return F.filter(clean, lambda s: (F.length(s) >= 15) & ~s.rlike(META))


def supported(claim: Column) -> Column:
    return claim.rlike(r"\[[0-9]{1,2}\]")


def citations_within(c: str | Column, most: int) -> tuple[Column, Column]:
    """The text without citations outside 1..most, and the numbers that went, ascending."""
    text = F.coalesce(_c(c), F.lit(""))
    raw = F.array_distinct(all_matches(text, r"\[[0-9]{1,2}\]"))
    number = lambda t: F.regexp_replace(t, r"[\[\]]", "").cast("int")
    gone = F.filter(raw, lambda t: ~number(t).between(1, most))
    return F.aggregate(gone, text, lambda s, t: F.replace(s, t, F.lit(""))), F.array_sort(F.array_distinct(F.transform(gone, number)))


def clip(c: str | Column, word: str, size: int = CLIP) -> Column:
    """A long sentence as a window around the word, a third of it before; the text itself, nothing rewritten."""
    text = _c(c)
    at = F.locate(word.lower(), F.lower(text))
    return F.when(F.length(text) <= size, text).when(at == 0, F.substring(text, 1, size)).otherwise(F.substring(text, F.greatest(F.lit(1), at - size // 3), F.lit(size)))


def shortened_turn(c: str | Column, asked: Column) -> Column:
    """A question keeps its beginning, an answer both ends: what it does not cover stands at its end."""
    text = _c(c)
    both = F.concat(F.substring(text, 1, HEAD), F.lit("……（中略）……"), F.right(text, F.lit(TAIL)))
    return F.when(asked, F.substring(text, 1, QUESTION)).when(F.length(text) <= HEAD + TAIL, text).otherwise(both)


def without_controls(c: str | Column) -> Column:
    return F.regexp_replace(_c(c), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def cell(c: str | Column) -> Column:
    return F.lower(collapse(F.coalesce(_c(c), F.lit(""))))


def numeric_cell(c: str | Column) -> Column:
    """Is a cell a number, with sign, unit of percent or a deviation?"""
    return collapse(F.coalesce(_c(c), F.lit(""))).rlike(r"^[-+±~≈<>≤≥]?\s*[0-9][0-9,]*(\.[0-9]+)?\s*(%|±\s*[0-9.]+)?$")


def mangled(cells: Column) -> Column:
    """Do two or more cells hold several numbers each? Then the columns of the table ran together."""
    several = r"^[-+]?[0-9]+(\.[0-9]+)?%?([\s,;/|]+[-+]?[0-9]+(\.[0-9]+)?%?)+$"
    return F.size(F.filter(cells, lambda x: F.trim(F.coalesce(x, F.lit(""))).rlike(several))) >= 2


def table_hash(paper: str | Column, page: str | Column, cells: Column) -> Column:
    """Identity of a table: paper, page, cells; where it stands on the page does not matter."""
    body = F.array_join(F.transform(cells, lambda x: collapse(F.coalesce(x, F.lit("")))), "\u001f")
    return F.sha1(F.concat_ws("\u001e", _c(paper).cast("string"), F.coalesce(_c(page).cast("string"), F.lit("None")), body).cast("binary"))


def figure_hash(paper: str | Column, page: str | Column, caption: str | Column) -> Column:
    return F.sha1(F.concat_ws("\u001e", _c(paper).cast("string"), _c(page).cast("string"), collapse(F.coalesce(_c(caption), F.lit("")))).cast("binary"))


def content_address(*parts: Column) -> Column:
    """Key of a result in a cache: the JSON of all it depends on."""
    return F.sha1(F.to_json(F.struct(*parts)).cast("binary"))


def collection_name(model: str | Column) -> Column:
    """Name of a model's collection of vectors: readable part and eight digits of its hash."""
    m = F.coalesce(_c(model), F.lit(""))
    slug = F.substring(F.regexp_replace(F.regexp_replace(m, r"[^a-zA-Z0-9._-]", "-"), r"^[._-]+|[._-]+$", ""), 1, 64)
    return F.concat(F.lit("c-"), F.when(slug == "", F.lit("default")).otherwise(slug), F.lit("-"), F.substring(F.sha1(m.cast("binary")), 1, 8))


def block_type(c: str | Column) -> Column:
    """formula, if the text is marked as one, else text."""
    t = F.coalesce(_c(c), F.lit(""))
    marked = t.rlike(r"\\[()\[\]]|\\(sum|int|prod|partial|infty)") | (F.length(t) - F.length(F.replace(t, F.lit("$"), F.lit(""))) >= 2)
    return F.when(marked, "formula").otherwise("text")


def first_doi(c: str | Column) -> Column:
    """First DOI of a text without the punctuation behind it and without brackets that it does not open; empty if there is none."""
    d = F.regexp_replace(F.regexp_replace(F.regexp_extract(_c(c), DOI, 0), r"-+$", ""), r"[.,;:'\"]+$", "")
    count = lambda x, b: F.length(x) - F.length(F.replace(x, F.lit(b), F.lit("")))
    # as many closing brackets at the end as none opened; the rest of them stay
    tail = F.length(F.regexp_extract(d, r"\)*$", 0))
    spare = F.least(tail, F.greatest(F.lit(0), count(d, ")") - count(d, "(")))
    return F.substring(d, F.lit(1), F.length(d) - spare)


def latest_year(c: str | Column, newest: int) -> Column:
    """Largest number of a text that can be a year; null if there is none."""
    found = F.filter(all_matches(_c(c), r"[0-9]+"), lambda x: x.rlike(r"^(19|20)[0-9]{2}$") & (x.cast("int") <= newest))
    return F.array_max(F.transform(found, lambda x: x.cast("int")))


def arxiv_year(c: str | Column, newest: int) -> Column:
    """Year of an arXiv id of the form yymm.number; null for a month that there is not."""
    yy, mm = F.regexp_extract(_c(c), r"^([0-9]{2})[0-9]{2}\.", 1), F.regexp_extract(_c(c), r"^[0-9]{2}([0-9]{2})\.", 1)
    year = yy.try_cast("int") + 2000
    return F.when(mm.try_cast("int").between(1, 12), F.when(year <= newest, year).otherwise(year - 100))


def found_abstract(c: str | Column) -> Column:
    """Text between a heading Abstract and the introduction or the keywords, of 40 or more characters; a heading is followed by a line end or a separator."""
    head = F.regexp_extract(_c(c), r"(?is)(?:^|\n)[ \t]*(?:abstract|摘\s*要)[ \t]*(?:\n|[-—–‒·•∙:：.。|、])(.*)", 1)
    ends = r"(?is)(?:^|\n)\s*(?:(?:[IVX]+|[0-9])\s*[.、]?\s*)?(?:introduction|keywords?|key\s+words|index\s+terms|引\s*言|绪\s*论|关\s*键\s*词|关\s*键\s*字).*"
    body = F.regexp_replace(F.regexp_replace(head, ends, ""), "-\n", "")
    clean = F.regexp_replace(collapse(body), r"^[\s\-—–‒·•∙:：.。|、,]+", "")
    return F.when(F.length(clean) >= 40, clean).otherwise("")


def safe_name(c: str | Column) -> Column:
    """Last part of a path without what a file system may not take; upload.pdf for nothing."""
    n = F.regexp_replace(F.replace(collapse(F.coalesce(_c(c), F.lit(""))), F.lit("\\"), F.lit("/")), r"^[A-Za-z]:", "")
    n = F.regexp_replace(F.element_at(F.split(n, "/"), -1), r'[\x00-\x1f<>:"|?*]', "_")
    n = F.substring(F.regexp_replace(n, r"^[ .]+|[ .]+$", ""), 1, 200)
    return F.when(n == "", F.lit("upload.pdf")).otherwise(n)


def pdf_link(c: str | Column) -> Column:
    """The link if it leads to a PDF, else null: landing pages are no papers."""
    u = F.trim(_c(c))
    return F.when(F.lower(u).rlike(r"\.pdf$|/pdf/|/pdf$"), u)


def longest_probe(c: str | Column, least: int = 20) -> Column:
    """Longest stretch of a cited passage between placeholders of citations, formulas and figures; null under `least` characters."""
    parts = F.transform(F.split(F.coalesce(_c(c), F.lit("")), r"(?:BIBREF|INLINEFORM|FIGREF|SECREF|TABREF|DISPLAYFORM)[0-9]*|FLOAT SELECTED:?"), lambda p: F.lower(collapse(p)))
    best = F.array_max(F.transform(F.filter(parts, lambda p: F.length(p) >= least), lambda p: F.struct(F.length(p).alias("n"), p.alias("p"))))
    return best["p"]


def placeholder(c: str | Column) -> Column:
    """Does a cell say that there is nothing to say?"""
    s = F.coalesce(_c(c), F.lit(""))
    bare = F.lower(F.regexp_replace(s, r"[\s（）()【】\[\].。,，]+", ""))
    return bare.isin(NOTHING) | F.contains(s, F.lit("摘要未提及")) | F.contains(s, F.lit("无摘要，仅元数据")) | F.trim(s).rlike(r"^[（(]mock")


def positive_page(c: str | Column) -> Column:
    """A page number, if the value is a whole number above zero."""
    v = _c(c).try_cast("double")
    return F.when((v > 0) & (v == F.floor(v)), v.cast("bigint"))


def extract_card(abstract: str | Column) -> tuple[Column, Column]:
    """(first sentence or beginning, what follows) of an abstract, nothing rewritten."""
    a = F.trim(F.coalesce(_c(abstract), F.lit("")))
    first = F.when(F.contains(a, F.lit("。")), F.substring_index(a, "。", 1)).otherwise(F.substring(a, 1, 120))
    rest = F.substring(F.trim(F.substring(a, F.length(first) + 1, F.length(a))), 1, 200)
    return F.when(first == "", F.lit("（无摘要，仅元数据）")).otherwise(first), F.when(rest == "", F.lit("（摘要未提及）")).otherwise(rest)


def yaml_value(c: str | Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.coalesce(_c(c), F.lit("")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def words_of(c: str | Column) -> Column:
    """Distinct Latin words and Chinese characters."""
    return F.array_distinct(all_matches(F.lower(F.coalesce(_c(c), F.lit(""))), f"[a-z][a-z0-9]+|[{HAN}]"))


def squashed(c: str | Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(_c(c), F.lit("")), SPACE, ""))


def pairs_of(c: str | Column) -> Column:
    """Distinct pairs of neighbouring characters without white space."""
    return F.array_distinct(neighbours(squashed(c)))


def neighbours(c: Column) -> Column:
    """All pairs of neighbouring characters, in one walk over the text."""
    chars = all_matches(c, r"(?s).")
    n = F.greatest(F.size(chars) - 1, F.lit(0))
    return F.zip_with(F.slice(chars, F.lit(1), n), F.slice(chars, F.lit(2), n), lambda x, y: F.concat(x, y))
