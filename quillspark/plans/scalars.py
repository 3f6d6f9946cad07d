"""Scalar and row-wise operators: keys, tokenisers, sentences, numbers, citation formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as t
from ..operators import citations
from .registry import Tables, query

def _pairs(text: str) -> str:
    return f"flatten(list_transform(regexp_extract_all({text}, '[一-鿿]{{2,}}'), lambda r: list_transform(range(1, length(r)), lambda i: substr(r, i, 2))))"


STOP = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in t.SECTION_STOPWORDS) + "]"
PROFILE_STOP = "[" + ", ".join(f"'{w}'" for w in t.PROFILE_STOPWORDS) + "]"


def section_terms_sql(text: str) -> str:
    low = f"lower(coalesce({text}, ''))"
    return f"list_concat(list_filter(regexp_extract_all({low}, '[a-z0-9]+'), lambda w: length(w) >= 2 AND NOT list_contains({STOP}, w)), {_pairs(low)})"


def rank_terms_sql(text: str) -> str:
    return f"list_concat(list_transform(regexp_extract_all(coalesce({text}, ''), '[a-zA-Z][a-zA-Z-]{{1,}}|[0-9]+(?:\\.[0-9]+)?'), lambda w: lower(w)), {_pairs(f"coalesce({text}, '')")})"


DOI = "nullif(trim(regexp_replace(trim({0}), '(?i)^https?://(dx\\.)?doi\\.org/', '')), '')"


@query(
    "SELECT id, coalesce('doi:' || lower(" + DOI.format("doi") + "), 'arxiv:' || nullif(regexp_replace(replace(lower(trim(arxiv_id)), 'arxiv:', ''), 'v[0-9]+$', ''), ''), "
    "'title:' || substr(sha1(nullif(regexp_replace(lower(title), '[^a-z0-9一-鿿]+', '', 'g'), '')), 1, 16)) AS computed_key, norm_key AS stored_key FROM papers"
)
def identity_keys(x: Tables) -> DataFrame:
    return x.papers.select("id", t.norm_key("doi", "arxiv_id", "title").alias("computed_key"), F.col("norm_key").alias("stored_key"))


@query("SELECT id, " + DOI.format("doi") + " AS doi FROM papers")
def bare_dois(x: Tables) -> DataFrame:
    return x.papers.select("id", t.bare_doi("doi").alias("doi"))


@query("SELECT digest_id, norm_key, lower(trim(regexp_replace(title, '[ \\t\\r\\n\\f\\v]+', ' ', 'g'))) AS query, lower(regexp_replace(title, '[ \\t\\r\\n\\f\\v]+', '', 'g')) AS squeezed FROM digest_items")
def normal_forms(x: Tables) -> DataFrame:
    return x.digest_items.select("digest_id", "norm_key", t.norm_query("title").alias("query"), t.squeeze("title").alias("squeezed"))


@query("SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(" + rank_terms_sql("(title || ' ' || coalesce(abstract, ''))") + ") AS term FROM papers) GROUP BY ALL")
def rank_term_counts(x: Tables) -> DataFrame:
    return x.papers.select("id", F.explode(t.rank_terms(F.concat("title", F.lit(" "), F.coalesce("abstract", F.lit(""))))).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))


@query("SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(" + section_terms_sql("body") + ") AS term FROM section_nodes) GROUP BY ALL")
def section_postings(x: Tables) -> DataFrame:
    return x.section_nodes.select("id", F.explode(t.section_terms("body")).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))


@query(
    "SELECT item_id, array_to_string(list_transform(range(0, least(12, len(u))), lambda i: u[i + 1]), '|') AS terms FROM (SELECT item_id, list_filter(a, lambda v, i: list_position(a, v) = i) AS u FROM (SELECT item_id, "
    "list_concat(list_transform(list_filter(regexp_extract_all(coalesce(question, ''), '[A-Za-z0-9][A-Za-z0-9._-]*'), lambda w: length(w) >= 2), lambda w: lower(w)), " + _pairs("coalesce(question, '')") + ") AS a FROM eval_items))"
)
def question_terms(x: Tables) -> DataFrame:
    return x.eval_items.select("item_id", F.array_join(t.query_terms("question"), "|").alias("terms"))


@query(
    "WITH s AS (SELECT id, unnest(list_filter(list_transform(string_split(regexp_replace(regexp_replace(abstract, '([。！？!?])', '\\1' || chr(1), 'g'), '([.]) +([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: trim(s)), lambda s: length(s) >= 12)) AS sentence FROM papers) SELECT id, sentence FROM s"
)
def abstract_sentences(x: Tables) -> DataFrame:
    return x.papers.select("id", F.explode(t.sentences("abstract")).alias("sentence"))


@query(
    "WITH r AS (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(regexp_replace(text, '\\[[0-9]+(, *[0-9]+)*\\]', '', 'g'), '[A-Za-z]+[-_.]?[0-9]+', '', 'g'), '[0-9]+(?:\\.[0-9]+)?(?: percent|%)?')) AS raw FROM documents WHERE kind = 'abstract') "
    "SELECT DISTINCT doc_id, regexp_replace(regexp_replace(regexp_extract(raw, '^[0-9.]+'), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') || CASE WHEN regexp_matches(raw, 'percent|%') THEN '%' ELSE '' END AS number FROM r"
)
def stated_numbers(x: Tables) -> DataFrame:
    return x.documents.where("kind = 'abstract'").select("doc_id", F.explode(t.numbers("text")).alias("number"))


@query(
    "SELECT id, CASE WHEN p > 0 THEN CASE WHEN b > 1 THEN '…' ELSE '' END || substr(body, b, 400) END AS piece FROM (SELECT *, greatest(1, p - 133) AS b FROM (SELECT id, body, strpos(lower(body), 'baseline') AS p FROM section_nodes)) WHERE p > 0"
)
def keyword_windows(x: Tables) -> DataFrame:
    return x.section_nodes.select("id", t.window_around("body", "baseline").alias("piece")).where("piece is not null")


@query(
    "SELECT id, CASE WHEN length(abstract) <= 160 THEN abstract ELSE CASE WHEN length(regexp_extract(substr(abstract, 1, 160), '^(.*[,;.。，；])', 1)) >= 80 THEN regexp_extract(substr(abstract, 1, 160), '^(.*[,;.。，；])', 1) ELSE substr(abstract, 1, 160) END || '…' END AS short FROM papers WHERE abstract IS NOT NULL AND NOT contains(abstract, chr(10))"
)
def shortened_abstracts(x: Tables) -> DataFrame:
    return x.papers.where("abstract is not null and not contains(abstract, '\\n')").select("id", t.shorten("abstract", 160).alias("short"))


@query("SELECT norm_key, nullif(regexp_extract(arxiv_id, '([0-9]{4}\\.[0-9]{4,7}|[a-z-]+(?:\\.[A-Z]{2})?/[0-9]{7})', 1), '') AS arxiv, 2000 + CAST(substr(nullif(regexp_extract(arxiv_id, '^([0-9]{4})\\.', 1), ''), 1, 2) AS INT) AS year FROM citation_nodes WHERE arxiv_id IS NOT NULL")
def arxiv_years(x: Tables) -> DataFrame:
    nodes = x.citation_nodes.where("arxiv_id is not null")
    yymm = F.regexp_extract("arxiv_id", r"^([0-9]{4})\.", 1)
    return nodes.select("norm_key", t.arxiv_id("arxiv_id").alias("arxiv"), (F.lit(2000) + F.substring(F.when(yymm != "", yymm), 1, 2).cast("int")).alias("year"))


@query("SELECT id, 'chunk-' || substr(sha256(CAST(paper_id AS VARCHAR) || '|' || node_id || '|' || coalesce(body, '')), 1, 20) AS chunk_id FROM section_nodes")
def stable_ids(x: Tables) -> DataFrame:
    return x.section_nodes.select("id", F.concat(F.lit("chunk-"), F.substring(F.sha2(F.concat_ws("|", F.col("paper_id").cast("string"), "node_id", F.coalesce("body", F.lit(""))), 256), 1, 20)).alias("chunk_id"))


SURNAME = "list_filter(list_transform(coalesce(authors, []), lambda a: lower(regexp_replace(string_split(trim(regexp_replace(a, '[ \\t\\r\\n\\f\\v]+', ' ', 'g')), ' ')[-1], '[^A-Za-z]', '', 'g'))), lambda n: n <> '')[1]"
SLUG = "lower(substr(regexp_replace(coalesce(title, ''), '[^A-Za-z0-9]', '', 'g'), 1, 20))"
KEY = f"coalesce({SURNAME}, 'anon') || coalesce(CAST(year AS VARCHAR), '') || CASE WHEN {SLUG} <> '' THEN {SLUG} ELSE 'p' || CAST(id AS VARCHAR) END"
NAMES = "CASE WHEN authors IS NULL OR len(authors) = 0 THEN ['Unknown'] ELSE authors END"
ESCAPE = "regexp_replace({0}, '([&%$#_])', '\\\\\\1', 'g')"


@query(
    f"SELECT id, '@' || CASE WHEN coalesce(venue, '') <> '' THEN 'article' ELSE 'misc' END || '{{' || {KEY} || ',' || chr(10) || '  title = {{' || {ESCAPE.format('title')} || '}},' || chr(10) || '  author = {{' || {ESCAPE.format(f'''array_to_string({NAMES}, ' and ')''')} || '}},' || chr(10)"
    f" || CASE WHEN coalesce(venue, '') <> '' THEN '  journal = {{' || {ESCAPE.format('venue')} || '}},' || chr(10) ELSE '' END || CASE WHEN coalesce(year, 0) <> 0 THEN '  year = {{' || year || '}},' || chr(10) ELSE '' END"
    f" || coalesce('  doi = {{' || {ESCAPE.format(DOI.format('doi'))} || '}},' || chr(10), '') || CASE WHEN coalesce(arxiv_id, '') <> '' THEN '  eprint = {{' || {ESCAPE.format('arxiv_id')} || '}},' || chr(10) || '  archivePrefix = {{arXiv}},' || chr(10) ELSE '' END || '}}' AS entry FROM papers".replace("{{", "{").replace("}}", "}")
)
def bibtex_entries(x: Tables) -> DataFrame:
    return x.papers.select("id", citations.bibtex().alias("entry"))


@query(
    f"SELECT id, 'TY  - JOUR' || chr(10) || 'TI  - ' || title || chr(10) || array_to_string(list_transform({NAMES}, lambda a: 'AU  - ' || a), chr(10)) || chr(10) || CASE WHEN coalesce(venue, '') <> '' THEN 'JO  - ' || venue || chr(10) ELSE '' END"
    f" || CASE WHEN coalesce(year, 0) <> 0 THEN 'PY  - ' || year || chr(10) ELSE '' END || coalesce('DO  - ' || {DOI.format('doi')} || chr(10), '') || CASE WHEN coalesce(arxiv_id, '') <> '' THEN 'UR  - https://arxiv.org/abs/' || arxiv_id || chr(10) ELSE '' END || 'ER  - ' AS entry FROM papers"
)
def ris_entries(x: Tables) -> DataFrame:
    return x.papers.select("id", citations.ris().alias("entry"))


@query(
    f"SELECT id, array_to_string(list_slice({NAMES}, 1, 6), ', ') || CASE WHEN len({NAMES}) > 6 THEN ', et al.' ELSE '' END || ', \"' || title || ',\" ' || coalesce(nullif(venue, ''), 'arXiv preprint arXiv:' || nullif(arxiv_id, ''), '') || ', ' || coalesce(CAST(nullif(year, 0) AS VARCHAR), '') || '.' AS entry FROM papers"
)
def ieee_references(x: Tables) -> DataFrame:
    return x.papers.select("id", citations.ieee().alias("entry"))


@query(
    "SELECT digest_id, norm_key, len(regexp_extract_all(authors_json, '\"[^\"]+\"')) - len(regexp_extract_all(authors_json, '\"name\":')) AS n_authors FROM digest_items"
)
def digest_author_counts(x: Tables) -> DataFrame:
    return x.digest_items.select("digest_id", "norm_key", F.size(F.from_json("authors_json", "array<string>")).cast("bigint").alias("n_authors"))


@query("SELECT id, regexp_replace(regexp_replace(title, '\\\\', '\\\\\\\\', 'g'), '([|])', '\\\\\\1', 'g') AS cell, CASE WHEN regexp_matches(title, '^[=+@-]') THEN '''' || title ELSE title END AS csv_cell FROM papers")
def safe_cells(x: Tables) -> DataFrame:
    return x.papers.select("id", citations.markdown_cell("title").alias("cell"), citations.csv_cell("title").alias("csv_cell"))
