"""Papers by fields: cells located in the text, how well they are filled, and tables of them in three formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fields as f, text as t
from . import citations, verify

#: Most characters of a cell that is shown.
SHOWN = 160


def cells(papers: DataFrame, columns: dict[str, list[str]], body: str = "abstract", card: dict[str, str] | None = None, key: str = "id") -> DataFrame:
    """key, field, value, sentence_no, source (card, text or none), verified: one row for each paper and field.

    A card's value comes first and is looked up in the text; else the first sentence that names one of the field's words,
    words before sentences, clipped and not verified since it is the text; else nothing. Fields are a short list.
    """
    one = papers.select(key, body, *[c for c in (card or {}).values()])
    numbered = F.transform(t.sentences(F.coalesce(F.col(body), F.lit(""))), lambda s, i: F.struct((i + 1).alias("no"), s.alias("s")))

    def hits(k: int, w: str) -> Column:
        named = F.filter("_s", lambda x: F.contains(F.lower(x["s"]), F.lit(w.lower())))
        return F.transform(named, lambda x: F.struct(F.lit(k).alias("word"), x["no"].alias("no"), f.clip(x["s"], w).alias("s")))

    def located(words: list[str]) -> Column:
        return F.array_min(F.flatten(F.array(*[hits(k, w) for k, w in enumerate(words)]))) if words else F.lit(None).cast("struct<word:int,no:int,s:string>")

    def cell(field: str, words: list[str]) -> Column:
        own = F.col(card[field]) if card and field in card else F.lit(None).cast("string")
        has, found = ~f.placeholder(own), located(words)
        return F.struct(
            F.lit(field).alias("field"),
            F.when(has, F.trim(own)).otherwise(found["s"]).alias("value"),
            F.when(~has, found["no"]).cast("bigint").alias("sentence_no"),
            F.when(has, "card").when(found.isNotNull(), "text").otherwise("none").alias("source"),
            F.when(has, verify.quote_found(own, F.col(body))).alias("verified"),
        )

    return one.withColumn("_s", numbered).select(key, F.explode(F.array(*[cell(c, w) for c, w in columns.items()])).alias("c")).select(key, "c.*")


def summary(cells: DataFrame) -> DataFrame:
    """One row: cells, filled, checkable, verified, excerpted, coverage, verified_rate; a rate over what can be checked only, null if nothing can."""
    filled, checkable = F.count("value"), F.count_if(F.col("value").isNotNull() & F.col("verified").isNotNull())
    good = F.count_if(F.col("value").isNotNull() & F.coalesce("verified", F.lit(False)))
    return cells.agg(
        F.count(F.lit(1)).alias("cells"), filled.alias("filled"), checkable.alias("checkable"), good.alias("verified"), (filled - checkable).alias("excerpted"), F.round(F.try_divide(filled, F.count(F.lit(1))), 4).alias("coverage"), F.round(F.try_divide(good, checkable), 4).alias("verified_rate")
    )


def wide(cells: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """One row for each paper with a column for each field."""
    return cells.groupBy(key).pivot("field", columns).agg(F.first("value"))


def tex(c: str | Column) -> Column:
    """Text for LaTeX: its special characters escaped."""
    x = F.regexp_replace(t._c(c), r"\\", "\u0001")
    x = F.regexp_replace(x, r"([&%$#_{}])", r"\\$1")
    x = F.replace(F.replace(x, F.lit("~"), F.lit("\\textasciitilde{}")), F.lit("^"), F.lit("\\textasciicircum{}"))
    return F.replace(x, F.lit("\u0001"), F.lit("\\textbackslash{}"))


def lines(wide_rows: DataFrame, columns: list[str], form: str, key: str = "id") -> DataFrame:
    """key, line: each row of a wide table as a line of csv, markdown or latex; long cells are cut at a clause for all but csv."""
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns}
    if form == "csv":
        safe = lambda c: F.when(c.rlike("^[=+@-]"), F.concat(F.lit("'"), c)).otherwise(c)
        quote = lambda c: F.when(c.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
        line = F.concat_ws(",", *[quote(safe(v)) for v in text.values()])
    elif form == "markdown":
        cell = lambda c: F.regexp_replace(F.regexp_replace(F.replace(t.shorten(c, SHOWN), F.lit("\\"), F.lit("\\\\")), r"([|])", r"\\$1"), "\n", "<br>")
        line = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(v) for v in text.values()]), F.lit(" |"))
    elif form == "latex":
        line = F.concat(F.concat_ws(" & ", *[tex(t.collapse(t.shorten(v, SHOWN))) for v in text.values()]), F.lit(" \\\\"))
    else:
        raise ValueError("form is csv, markdown or latex")
    return wide_rows.select(key, line.alias("line"))


def exported(papers: DataFrame, form: str, key: str = "id") -> DataFrame:
    """key, entry: every paper in one of the citation formats."""
    forms = {"bibtex": citations.bibtex, "ris": citations.ris, "ieee": citations.ieee, "gbt": citations.gbt}
    if form not in forms:
        raise ValueError(f"form is one of {', '.join(forms)}")
    return papers.select(key, forms[form]().alias("entry"))


def glossary(keywords: DataFrame, k: int = 10) -> DataFrame:
    """keyword, n, rank: the most frequent keywords of 2 to 30 characters. keywords: keyword."""
    from .lexical import top

    w = keywords.select(F.trim("keyword").alias("keyword")).where("length(keyword) between 2 and 30")
    return top(w.groupBy("keyword").agg(F.count(F.lit(1)).alias("n")), k, F.desc("n"), F.asc("keyword"))
