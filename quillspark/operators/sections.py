"""Building the section index from pages or chunks: headings, paths, numbers, postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as t

SEPARATOR = ":::"


def heading_and_body(page: str | Column) -> tuple[Column, Column]:
    """(first line with text, what follows) of a page."""
    c = F.coalesce(t._c(page), F.lit(""))
    return F.trim(F.regexp_extract(c, r"^\s*([^\n]*)", 1)), F.trim(F.regexp_replace(c, r"^\s*[^\n]*(\n|$)", ""))


def looks_like_heading(line: Column) -> Column:
    """Short, without the end of a sentence, not a lone number."""
    return F.length(line).between(2, 120) & ~line.rlike(r"[.。!?！？;；,，:：]$") & line.rlike(r"\p{L}")


def nodes_of_pages(pages: DataFrame, group: str = "paper_id", page: str = "page", text: str = "text") -> DataFrame:
    """group, page, path (array), body, no_heading: one node for each page; a page without a heading is named after its number."""
    head, rest = heading_and_body(text)
    ok = looks_like_heading(head)
    path = F.transform(F.split(head, SEPARATOR), lambda p: F.trim(p))
    return pages.select(group, page, F.when(ok, path).otherwise(F.array(F.concat(F.lit("Page "), F.col(page).cast("string")))).alias("path"), F.when(ok, rest).otherwise(F.trim(text)).alias("body"), (~ok).alias("no_heading"))


def nodes_of_chunks(chunks: DataFrame, group: str = "paper_id", order: str = "id", path: str = "section_path", text: str = "body") -> DataFrame:
    """group, first, path, start_page, end_page, body: consecutive chunks of one path as one node; chunks without a path are left out.

    A chunk whose path differs from the one before it begins a node; the nodes of a group are numbered by running
    counts, and only their own texts are collected.
    """
    kept = chunks.where(f"length(trim({path})) > 0")
    w = Window.partitionBy(group).orderBy(order)
    begins = kept.withColumn("_b", (~F.col(path).eqNullSafe(F.lag(path).over(w))).cast("int")).withColumn("_n", F.sum("_b").over(w))
    each = begins.groupBy(group, "_n").agg(
        F.min(order).alias("first"), F.min_by(path, order).alias("path"), F.min("start_page").alias("start_page"), F.max("end_page").alias("end_page"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("x")))), lambda r: r["x"]), "\n\n").alias("body")
    )
    return each.drop("_n")


def by_pages(pages: DataFrame, group: str = "paper_id") -> DataFrame:
    """group, by_pages: is a paper's index built from its pages? Only if any page has a heading. pages: the rows of nodes_of_pages."""
    return pages.groupBy(group).agg((F.count_if("no_heading") < F.count(F.lit(1))).alias("by_pages"))


def postings(nodes: DataFrame, keys: list[str], titles: list[str], text: str = "body") -> DataFrame:
    """keys, term, tf: how often each term stands in a node's titles and text."""
    terms = t.section_terms(F.concat_ws("\n", *[F.col(c) for c in titles], F.col(text)))
    return nodes.select(*keys, F.explode(terms).alias("term")).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"))


def numbering(heading: str | Column) -> tuple[Column, Column]:
    """(number, depth) at the beginning of a heading: 2.1, IV., A.3; null without one."""
    n = F.regexp_extract(F.trim(t._c(heading)), r"^([0-9]+(?:\.[0-9]+)*|[IVX]+|[A-Z](?:\.[0-9]+)+)\.?\s+\S", 1)
    return F.when(n != "", n), F.when(n != "", F.size(F.split(n, r"\.")))


#: Names of sections that papers share.
NAMES = {"abstract": "abstract|摘要", "introduction": "introduction|einleitung|introducción|引言|绪论", "related work": "related work|background|相关工作", "method": "methods?|methodology|approach|methode|方法", "experiments": "experiments?|evaluation|experimente|实验", "results": "results?|findings|ergebnisse|résultats|resultados|结果", "discussion": "discussion|diskussion|discusión|讨论", "conclusion": "conclusions?|schluss|conclusión|结论", "references": "references|bibliography|literatur|参考文献", "appendix": "appendix|anhang|附录"}


def known_section(heading: str | Column) -> Column:
    """The common name of a section, whatever its number and language; null for others."""
    bare = F.lower(F.trim(F.regexp_replace(F.trim(t._c(heading)), r"^([0-9]+(\.[0-9]+)*|[IVXivx]+)\.?\s+", "")))
    return F.coalesce(*[F.when(bare.rlike(f"^({p})$"), F.lit(n)) for n, p in NAMES.items()])


def body_size(blocks: DataFrame, group: str, size: str = "size", text: str = "text") -> DataFrame:
    """group, size: the font size in which most characters are set, the smaller among equals. blocks: group, size, text."""
    n = blocks.groupBy(group, size).agg(F.sum(F.length(text)).alias("n"))
    return n.groupBy(group).agg(F.max_by(size, F.struct("n", -F.col(size))).alias("size"))


def repeated_texts(blocks: DataFrame, group: str, page: str = "page", text: str = "text", share: float = 0.4, least: int = 3) -> DataFrame:
    """group, masked, pages: texts that stand on a share of a document's pages and on at least `least`, figures aside: running headers."""
    masked = F.regexp_replace(F.lower(t.collapse(text)), "[0-9]+", "#")
    total = blocks.groupBy(group).agg(F.count_distinct(page).alias("all"))
    seen = blocks.select(group, page, masked.alias("masked")).where("masked <> ''").groupBy(group, "masked").agg(F.count_distinct(page).alias("pages"))
    return seen.join(total, group).where((F.col("pages") >= least) & (F.col("pages") >= share * F.col("all"))).select(group, "masked", "pages")


def heading_score(size: Column, body: Column, bold: Column, text: Column) -> Column:
    """2 for a larger font, 2 for bold, 1 each for capitals, a number, a known name; sections have 3 or more."""
    points = lambda c, n: F.when(F.coalesce(c, F.lit(False)), n).otherwise(0)
    return points(size > body * 1.05, 2) + points(bold, 2) + points((F.upper(text) == text) & text.rlike(r"\p{L}"), 1) + points(numbering(text)[0].isNotNull(), 1) + points(known_section(text).isNotNull(), 1)


def sections_of_blocks(blocks: DataFrame, group: str = "doc") -> DataFrame:
    """group, block, title, number, level, score: blocks that are headings. blocks: group, block (order), page, size, bold, text.

    Running headers, sentences and long texts are none. A number gives the level, else the rank of the font size.
    """
    base = blocks.join(body_size(blocks, group).withColumnRenamed("size", "_body"), group)
    masked = F.regexp_replace(F.lower(t.collapse("text")), "[0-9]+", "#")
    plain = base.withColumn("masked", masked).join(repeated_texts(blocks, group), [group, "masked"], "left_anti")
    title = t.collapse("text")
    number, depth = numbering(title)
    scored = plain.withColumn("title", title).where((F.length("title") <= 160) & ~F.col("title").rlike(r"[.。;；]$")).withColumn("score", heading_score(F.col("size"), F.col("_body"), F.col("bold"), F.col("title"))).where("score >= 3")
    rank = F.dense_rank().over(Window.partitionBy(group).orderBy(F.desc("size")))
    return scored.select(group, "block", "title", number.alias("number"), F.coalesce(depth, rank).alias("level"), "score")


def missing_numbers(sections: DataFrame, blocks: DataFrame, group: str = "doc") -> DataFrame:
    """group, block, title, number: blocks that begin with the number between two found sections n.(k-1) and n.(k+1), stand between them and have the first one's font size."""
    s = sections.where("number is not null").join(blocks.select(group, "block", "size"), [group, "block"])
    stem, last = F.regexp_extract("number", r"^(.*?)\.?[0-9]+$", 1), F.regexp_extract("number", r"([0-9]+)$", 1).cast("int")
    k = s.select(group, "block", "size", stem.alias("stem"), last.alias("k")).where("k is not null")
    hole = k.alias("a").join(k.alias("b"), [F.col(f"a.{group}") == F.col(f"b.{group}"), F.col("a.stem") == F.col("b.stem"), F.col("b.k") == F.col("a.k") + 2]).select(
        F.col(f"a.{group}").alias(group), F.concat_ws(".", F.nullif("a.stem", F.lit("")), (F.col("a.k") + 1).cast("string")).alias("number"), F.col("a.block").alias("after"), F.col("b.block").alias("before"), F.col("a.size").alias("size")
    )
    title = t.collapse("text")
    named = blocks.select(group, "block", "size", title.alias("title"), numbering(title)[0].alias("number")).where("number is not null")
    return named.join(hole, [group, "number", "size"]).where("block > after and block < before").select(group, "block", "title", "number")
