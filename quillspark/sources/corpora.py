"""Question-answering corpora and evaluation sets in JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.fields import longest_probe

_SECTIONS = "array<struct<section_name:string,paragraphs:array<string>>>"
_OLD = "struct<section_names:array<string>,sections:array<string>>"
_ANSWER = "struct<answer:struct<evidence:array<string>,highlighted_evidence:array<string>,extractive_spans:array<string>>>"
PAPER = f"title string, abstract string, full_text string, qas array<struct<question:string,question_id:string,answers:array<{_ANSWER}>>>"
#: Shortest extracted span that can serve as evidence.
SPAN = 20


def papers(lines: DataFrame, id_col: str = "id", json_col: str = "json") -> DataFrame:
    """id and the fields of PAPER of papers given as one JSON object each; a broken one gives nulls."""
    return lines.select(F.col(id_col).alias("id"), F.from_json(json_col, PAPER).alias("p")).select("id", "p.*")


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """id, json of a file that is one JSON object from ids to papers."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"))
    return whole.select(F.explode("m").alias("id", "json"))


def sections(papers: DataFrame) -> DataFrame:
    """id, page, name, body: the sections of both layouts of full_text, numbered as pages; empty ones are left out, unnamed ones are called Section."""
    new, old = F.from_json("full_text", _SECTIONS), F.from_json("full_text", _OLD)
    join = lambda a: F.trim(F.array_join(F.filter(a, lambda p: F.trim(F.coalesce(p, F.lit(""))) != ""), "\n"))
    listed = F.transform(new, lambda s: F.struct(s["section_name"].alias("name"), join(F.coalesce(s["paragraphs"], F.array())).alias("body")))
    zipped = F.transform(F.arrays_zip(old["section_names"], old["sections"]), lambda z: F.struct(z["section_names"].alias("name"), F.trim(F.coalesce(z["sections"], F.lit(""))).alias("body")))
    both = F.when(F.ltrim("full_text").startswith("["), listed).otherwise(zipped)
    kept = F.filter(F.coalesce(both, F.expr("cast(array() as array<struct<name:string,body:string>>)")), lambda s: s["body"] != "")
    each = papers.select("id", F.posexplode(kept).alias("i", "s"))
    name = F.trim(F.coalesce("s.name", F.lit("")))
    return each.select("id", (F.col("i") + 1).alias("page"), F.when(name == "", "Section").otherwise(name).alias("name"), F.col("s.body").alias("body"))


def evidence(papers: DataFrame) -> DataFrame:
    """id, question_id, question, spans: distinct evidence of all answers; short extracted spans are citation marks and no evidence."""
    q = papers.select("id", F.explode("qas").alias("q"))
    some = lambda a: F.coalesce(a, F.array().cast("array<string>"))
    of = F.transform(F.coalesce("q.answers", F.array()), lambda a: F.concat(some(a["answer"]["evidence"]), some(a["answer"]["highlighted_evidence"]), F.filter(some(a["answer"]["extractive_spans"]), lambda s: F.length(F.trim(s)) >= SPAN)))
    spans = F.filter(F.array_distinct(F.flatten(of)), lambda s: F.trim(F.coalesce(s, F.lit(""))) != "")
    return q.select("id", "q.question_id", F.coalesce("q.question", F.lit("")).alias("question"), spans.alias("spans")).where("size(spans) > 0")


def tasks(papers: DataFrame) -> DataFrame:
    """id, question_id, question, probes: questions with what of their evidence can be looked for in a text."""
    probes = F.filter(F.transform("spans", longest_probe), lambda p: p.isNotNull())
    return evidence(papers).select("id", "question_id", "question", probes.alias("probes")).where("size(probes) > 0")


def evaluation_set(spark: SparkSession, path: str, kinds: tuple[str, ...] = ("retrieval", "citation", "qa")) -> tuple[DataFrame, DataFrame]:
    """(entries, rejects): a JSON array of entries with id, type, query, gold_keys; entries of another type or without gold are rejected."""
    rows = spark.read.schema("id string, type string, query string, gold_keys array<string>, gold_intent string, form string, category string").json(path, multiLine=True)
    good = F.coalesce(F.col("type").isin(*kinds) & (F.size("gold_keys") > 0), F.lit(False)) | F.coalesce((F.col("type") == "intent") & F.col("gold_intent").isNotNull(), F.lit(False))
    return rows.where(good), rows.where(~good)
