"""Citation formats and table cells as columns of the papers table."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions import text as t


def _has(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) != ""


def _line(when: Column, *parts: Column | str) -> Column:
    text = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts], F.lit("\n"))
    return F.when(when, text).otherwise(F.lit(""))


def authors() -> Column:
    return F.when(F.size(F.coalesce("authors", F.array())) == 0, F.array(F.lit("Unknown"))).otherwise(F.col("authors"))


def _escaped(c: Column) -> Column:
    return F.regexp_replace(c, r"([&%$#_])", r"\\$1")


def bibtex() -> Column:
    """An @article with a venue, else @misc; the DOI without its resolver."""
    doi, year = t.bare_doi("doi"), F.coalesce("year", F.lit(0)) != 0
    always = F.lit(True)
    return F.concat(
        _line(always, "@", F.when(_has("venue"), "article").otherwise("misc"), "{", t.bib_key("authors", "year", "title", "id"), ","),
        _line(always, "  title = {", _escaped(F.col("title")), "},"),
        _line(always, "  author = {", _escaped(F.array_join(authors(), " and ")), "},"),
        _line(_has("venue"), "  journal = {", _escaped(F.col("venue")), "},"),
        _line(year, "  year = {", F.col("year").cast("string"), "},"),
        _line(doi.isNotNull(), "  doi = {", _escaped(doi), "},"),
        _line(_has("arxiv_id"), "  eprint = {", _escaped(F.col("arxiv_id")), "},\n  archivePrefix = {arXiv},"),
        F.lit("}"),
    )


def ris() -> Column:
    doi, always = t.bare_doi("doi"), F.lit(True)
    return F.concat(
        _line(always, "TY  - JOUR"),
        _line(always, "TI  - ", F.col("title")),
        _line(always, F.array_join(F.transform(authors(), lambda a: F.concat(F.lit("AU  - "), a)), "\n")),
        _line(_has("venue"), "JO  - ", F.col("venue")),
        _line(F.coalesce("year", F.lit(0)) != 0, "PY  - ", F.col("year").cast("string")),
        _line(doi.isNotNull(), "DO  - ", doi),
        _line(_has("arxiv_id"), "UR  - https://arxiv.org/abs/", F.col("arxiv_id")),
        F.lit("ER  - "),
    )


def ieee() -> Column:
    names = authors()
    where = F.coalesce(F.when(_has("venue"), F.col("venue")), F.when(_has("arxiv_id"), F.concat(F.lit("arXiv preprint arXiv:"), F.col("arxiv_id"))), F.lit(""))
    year = F.coalesce(F.when(F.col("year") != 0, F.col("year").cast("string")), F.lit(""))
    return F.concat(F.array_join(F.slice(names, 1, 6), ", "), F.when(F.size(names) > 6, ", et al.").otherwise(""), F.lit(', "'), F.col("title"), F.lit('," '), where, F.lit(", "), year, F.lit("."))


def markdown_cell(c: str) -> Column:
    """Backslashes and bars escaped for a table."""
    return F.regexp_replace(F.regexp_replace(F.col(c), r"\\", r"\\\\"), r"([|])", r"\\$1")


def csv_cell(c: str) -> Column:
    """A leading =, +, @ or - is quoted, so that no spreadsheet runs it."""
    return F.when(F.col(c).rlike("^[=+@-]"), F.concat(F.lit("'"), F.col(c))).otherwise(F.col(c))


def gbt() -> Column:
    """Up to three authors, more are cut with 等; a preprint without venue is named as one; no blank before a stop, single blanks."""
    names = authors()
    where = F.when(_has("venue"), F.col("venue")).when(_has("arxiv_id"), F.lit("arXiv preprint")).otherwise("")
    year = F.coalesce(F.when(F.col("year") != 0, F.col("year").cast("string")), F.lit(""))
    entry = F.concat(F.array_join(F.slice(names, 1, 3), ", "), F.when(F.size(names) > 3, ", 等").otherwise(""), F.lit(". "), F.col("title"), F.lit("[J]. "), where, F.lit(", "), year, F.lit("."))
    return F.regexp_replace(F.replace(entry, F.lit(" ."), F.lit(".")), t.SPACE, " ")
