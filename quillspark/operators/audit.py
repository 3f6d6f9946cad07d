"""Auditing written sentences against bound evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as t
from . import verify


def statements(texts: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """id, line_no, sentence, cited (numbers in brackets): lines that are headings are left out."""
    lines = texts.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\n")).alias("i", "line")).where(~F.col("line").rlike(r"^\s*#") & (F.trim("line") != ""))
    cut = F.split(F.regexp_replace("line", r"([.!?。！？])((?: ?\[[0-9, ]+\])*)(?= |$)", "$1$2\u0001"), "\u0001")
    each = lines.select("id", (F.col("i") + 1).alias("line_no"), F.explode(cut).alias("s")).select("id", "line_no", F.trim("s").alias("sentence")).where("sentence <> ''")
    cited = F.transform(F.flatten(F.transform(F.regexp_extract_all("sentence", F.lit(r"\[([0-9, ]+)\]"), F.lit(1)), lambda x: F.split(x, ","))), lambda x: F.trim(x).cast("int"))
    return each.withColumn("cited", F.array_distinct(cited))


def issues(written: DataFrame, evidence: DataFrame) -> DataFrame:
    """id, line_no, sentence, issue: citation_dangling (no such evidence), citation_gap (figures without a citation), numeric_conflict (figures that no cited evidence has).

    evidence: id, n, quote. Sentences without figures and citations give none.
    """
    s = statements(written).withColumn("figures", t.numbers("sentence"))
    e = evidence.select(F.col("id").alias("eid"), "n", "quote")
    j = s.withColumn("n0", F.explode_outer("cited")).join(e, (F.col("id") == F.col("eid")) & (e["n"] == F.col("n0")), "left")
    by = j.groupBy("id", "line_no", "sentence", "cited", "figures").agg(F.concat_ws(" ", F.collect_list("quote")).alias("quotes"), F.count("quote").alias("found"))
    kinds = F.array(
        F.when(F.size("cited") > F.col("found"), F.lit("citation_dangling")),
        F.when((F.size("figures") > 0) & (F.size("cited") == 0), F.lit("citation_gap")),
        F.when((F.col("found") > 0) & (F.size(verify.missing_numbers("sentence", "quotes")) > 0), F.lit("numeric_conflict")),
    )
    return by.select("id", "line_no", "sentence", F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("issue"))


def claim_matches(sentence: str, claim: str) -> "F.Column":
    """Does a sentence say a claim: it contains it, or has 85 % of its three or more words?"""
    from ..functions import fields as f

    a, b = f.audit_form(sentence), f.audit_form(claim)
    words = f.words_of(claim)
    return ((b != "") & F.contains(a, b)) | ((F.size(words) >= 3) & (F.size(F.array_intersect(f.words_of(sentence), words)) >= 0.85 * F.size(words)))


def conflicting_numbers(sections: DataFrame, id_col: str = "id", text_col: str = "body") -> DataFrame:
    """masked, id_a, id_b: sentences that are equal but for their figures and stand with different figures in two sections.

    Sentences meet by their text without figures; of each text and set of figures the first section is kept, so copies
    do not multiply.
    """
    s = sections.select(F.col(id_col).alias("id"), F.explode(t.sentences(text_col)).alias("sentence"))
    s = s.withColumn("figures", F.array_join(F.array_sort(t.numbers("sentence")), ",")).where("figures <> ''")
    s = s.withColumn("masked", F.lower(t.collapse(F.regexp_replace("sentence", r"[0-9]+(?:\.[0-9]+)?", "#"))))
    one = s.groupBy("masked", "figures").agg(F.min("id").alias("id"))
    first = one.groupBy("masked").agg(F.min(F.struct("id", "figures")).alias("f"), F.count(F.lit(1)).alias("variants")).where("variants > 1")
    return one.join(first, "masked").where("figures <> f.figures").select("masked", F.col("f.id").alias("id_a"), F.col("id").alias("id_b"), "figures")


def citation_check(texts: DataFrame, references: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """id, cited, dangling, unused, pending: how the numbers in brackets of a text stand to its references (id, n) and how many places still lack evidence."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = texts.select(F.col(id_col).alias("id"), F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\[([0-9]{1,3})\]"), F.lit(1)), lambda x: x.cast("int"))).alias("used"), F.size(F.regexp_extract_all(text, F.lit("待补证据"), F.lit(0))).alias("pending"))
    refs = references.groupBy("id").agg(F.collect_set("n").alias("refs"))  # a text's own list
    j = own.join(refs, "id", "left").withColumn("refs", F.coalesce("refs", F.array().cast("array<int>")))
    return j.select("id", F.size("used").alias("cited"), F.size(F.array_except("used", "refs")).alias("dangling"), F.size(F.array_except("refs", "used")).alias("unused"), "pending")


def term_variants(texts: DataFrame, canonical: dict[str, list[str]], id_col: str = "id", text_col: str = "body") -> DataFrame:
    """id, canonical, variant, n: spellings of a glossary's terms other than the canonical one. The glossary is a short list."""
    text = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    found = F.array(*[F.struct(F.lit(c).alias("canonical"), F.lit(v).alias("variant"), F.size(F.regexp_extract_all(text, F.lit(rf"(^|[^a-z0-9]){v}([^a-z0-9]|$)"), F.lit(0))).alias("n")) for c, vs in canonical.items() for v in vs])
    return texts.select(F.col(id_col).alias("id"), F.explode(F.filter(found, lambda x: x["n"] > 0)).alias("x")).select("id", "x.*")


def severities(found: DataFrame, major: list[str]) -> DataFrame:
    """major, minor, ok of a list of issues: fine if none is major."""
    bad = F.count_if(F.col("issue").isin(major))
    return found.agg(bad.alias("major"), (F.count(F.lit(1)) - bad).alias("minor"), (bad == 0).alias("ok"))
