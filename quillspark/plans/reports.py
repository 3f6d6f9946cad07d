"""Matrices of papers and fields, audits, measures and the section index."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as t
from ..operators import audit, evaluate, matrix, sections, tree
from .more import _NUM
from .registry import Tables, query
from .scalars import section_terms_sql

COLUMNS = {"metric": ["coverage", "accuracy"], "baseline": ["baseline"], "finding": ["improves", "percent"]}
_WS = "[ \\t\\r\\n\\f\\v]+"
_SENT = "list_filter(list_transform(string_split(regexp_replace(regexp_replace(coalesce(abstract, ''), '([。！？!?])', '\\1' || chr(1), 'g'), '([.]) +([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: trim(s)), lambda s: length(s) >= 12)"
_FOUND = " UNION ALL ".join(f"SELECT id, '{c}' AS field, {k} AS w, n, CASE WHEN length(s) <= 400 THEN s ELSE substr(s, greatest(1, strpos(lower(s), '{w}') - 133), 400) END AS s FROM z WHERE contains(lower(s), '{w}')" for c, ws in COLUMNS.items() for k, w in enumerate(ws))
_FIELDS = ", ".join(f"('{c}')" for c in [*COLUMNS, "venue"])
_NOTHING = "lower(regexp_replace(coalesce(venue, ''), '[\\s（）()【】\\[\\].。,，]+', '', 'g')) IN ('', '-', '--', '—', '–', 'n/a', 'na', 'none', 'null', 'tbd', 'nil', '无', '未知', '未提及', '摘要未提及', '不适用', '暂无', 'mock', '待补充')"
_CELLS = (
    f"z AS (SELECT id, unnest(range(1, len(l) + 1)) AS n, unnest(l) AS s FROM (SELECT id, {_SENT} AS l FROM papers)), f AS ({_FOUND}), b AS (SELECT id, field, arg_min(n, struct_pack(a := w, b := n)) AS sentence_no, arg_min(s, struct_pack(a := w, b := n)) AS value FROM f GROUP BY ALL), "
    f"cells AS (SELECT p.id, v.field, CASE WHEN v.field = 'venue' AND NOT {_NOTHING} THEN trim(venue) ELSE b.value END AS value, b.sentence_no, CASE WHEN v.field = 'venue' AND NOT {_NOTHING} THEN 'card' WHEN b.value IS NOT NULL THEN 'text' ELSE 'none' END AS source FROM papers p, (VALUES {_FIELDS}) v(field) LEFT JOIN b ON b.id = p.id AND b.field = v.field)"
)


def _cells(x: Tables) -> DataFrame:
    return matrix.cells(x.papers, COLUMNS | {"venue": []}, "abstract", {"venue": "venue"})


@query(f"WITH {_CELLS} SELECT id, field, value, sentence_no, source FROM cells")
def matrix_cells(x: Tables) -> DataFrame:
    return _cells(x).select("id", "field", "value", "sentence_no", "source")


@query(f"WITH {_CELLS} SELECT count(*) AS cells, count(value) AS filled, count(*) FILTER (WHERE source = 'card') AS checkable, count(*) FILTER (WHERE source = 'text') AS excerpted, round(count(value) / count(*), 4) AS coverage FROM cells")
def matrix_summary(x: Tables) -> DataFrame:
    return matrix.summary(_cells(x)).select("cells", "filled", "checkable", "excerpted", "coverage")


@query(f"WITH {_CELLS} SELECT id, max(value) FILTER (WHERE field = 'metric') AS metric, max(value) FILTER (WHERE field = 'baseline') AS baseline, max(value) FILTER (WHERE field = 'finding') AS finding, max(value) FILTER (WHERE field = 'venue') AS venue FROM cells GROUP BY id")
def matrix_wide(x: Tables) -> DataFrame:
    return matrix.wide(_cells(x), [*COLUMNS, "venue"])


_CSV = lambda c: f"CASE WHEN regexp_matches({c}, '[\",\\n\\r]') THEN '\"' || replace({c}, '\"', '\"\"') || '\"' ELSE {c} END"
_SAFE = lambda c: f"(CASE WHEN regexp_matches(coalesce({c}, ''), '^[=+@-]') THEN '''' || {c} ELSE coalesce({c}, '') END)"


@query("SELECT id, " + " || ',' || ".join(_CSV(_SAFE(c)) for c in ("title", "venue", "doi")) + " AS line FROM papers")
def csv_lines(x: Tables) -> DataFrame:
    return matrix.lines(x.papers, ["title", "venue", "doi"], "csv")


_TEX = lambda c: f"replace(replace(replace(regexp_replace(replace(trim(regexp_replace(coalesce({c}, ''), '{_WS}', ' ', 'g')), chr(92), chr(1)), '([&%$#_{{}}])', '\\\\\\1', 'g'), '~', '\\textasciitilde{{}}'), '^', '\\textasciicircum{{}}'), chr(1), '\\textbackslash{{}}')"


@query("SELECT id, " + " || ' & ' || ".join(_TEX(c) for c in ("title", "venue", "doi")) + " || ' \\\\' AS line FROM papers WHERE length(title) <= 160 AND coalesce(length(venue), 0) <= 160 AND coalesce(length(doi), 0) <= 160")
def latex_lines(x: Tables) -> DataFrame:
    short = x.papers.where("length(title) <= 160 and coalesce(length(venue), 0) <= 160 and coalesce(length(doi), 0) <= 160")
    return matrix.lines(short, ["title", "venue", "doi"], "latex")


@query("SELECT keyword, n, row_number() OVER (ORDER BY n DESC, keyword) AS rank FROM (SELECT term AS keyword, count(*) AS n FROM (SELECT trim(lower(term)) AS term FROM section_terms WHERE term IS NOT NULL) WHERE length(term) BETWEEN 2 AND 30 GROUP BY term) ORDER BY rank LIMIT 10")
def glossary(x: Tables) -> DataFrame:
    return matrix.glossary(x.section_terms.select(F.lower("term").alias("keyword")))


# --- audits ----------------------------------------------------------------------------------------------------------

_AUDIT = "regexp_replace(lower(coalesce({}, '')), '[^a-z0-9一-鿿]+', '', 'g')"
_WORDS = "list_distinct(regexp_extract_all(lower(coalesce({}, '')), '[a-z][a-z0-9]+|[一-鿿]'))"


@query(f"SELECT item_id, ({_AUDIT.format('answer')} <> '' AND contains({_AUDIT.format('passage')}, {_AUDIT.format('answer')})) OR (len({_WORDS.format('answer')}) >= 3 AND len(list_intersect({_WORDS.format('passage')}, {_WORDS.format('answer')})) >= 0.85 * len({_WORDS.format('answer')})) AS said FROM eval_items")
def matched_claims(x: Tables) -> DataFrame:
    return x.eval_items.select("item_id", audit.claim_matches("passage", "answer").alias("said"))


@query("SELECT id, len(u) AS cited, len(list_filter(u, lambda v: v > 12)) AS dangling, 12 - len(list_filter(u, lambda v: v BETWEEN 1 AND 12)) AS unused, pending FROM (SELECT id, list_distinct(list_transform(regexp_extract_all(coalesce(body, ''), '\\[([0-9]{1,3})\\]', 1), lambda v: CAST(v AS INT))) AS u, len(regexp_extract_all(coalesce(body, ''), '待补证据')) AS pending FROM section_nodes) WHERE NOT list_contains(u, 0)")
def citation_checks(x: Tables) -> DataFrame:
    """Every section against a reference list of twelve."""
    refs = x.section_nodes.select("id", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("n"))
    c = audit.citation_check(x.section_nodes.where(~F.coalesce(F.col("body").rlike(r"\[0{1,3}\]"), F.lit(False))), refs, "id", "body")
    return c.select("id", *[F.col(k).cast("bigint").alias(k) for k in ("cited", "dangling", "unused", "pending")])


_VARIANTS = {"split": ["splits"], "random seed": ["random seeds"], "data set": ["dataset", "data-set"], "percent": ["per cent", "%"]}
_VROWS = ", ".join(f"('{c}', '{v}')" for c, vs in _VARIANTS.items() for v in vs)


@query(f"SELECT id, c AS canonical, v AS variant, n FROM (SELECT id, c, v, len(regexp_extract_all(lower(coalesce(body, '')), '(^|[^a-z0-9])' || v || '([^a-z0-9]|$)')) AS n FROM section_nodes, (VALUES {_VROWS}) t(c, v)) WHERE n > 0")
def term_variants(x: Tables) -> DataFrame:
    return audit.term_variants(x.section_nodes, _VARIANTS).withColumn("n", F.col("n").cast("bigint"))


_SECTION_SENTENCES = "list_filter(list_transform(string_split(regexp_replace(regexp_replace(coalesce(body, ''), '([。！？!?])', '\\1' || chr(1), 'g'), '([.]) +([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: trim(s)), lambda s: length(s) >= 12)"


@query(
    f"WITH s AS (SELECT id, unnest({_SECTION_SENTENCES}) AS sentence FROM section_nodes), n AS (SELECT id, array_to_string(list_sort({_NUM.format('sentence')}), ',') AS figures, lower(trim(regexp_replace(regexp_replace(sentence, '[0-9]+(\\.[0-9]+)?', '#', 'g'), '{_WS}', ' ', 'g'))) AS masked FROM s), "
    "o AS (SELECT masked, figures, min(id) AS id FROM n WHERE figures <> '' GROUP BY ALL), f AS (SELECT masked, min(struct_pack(id := id, figures := figures)) AS f FROM o GROUP BY masked HAVING count(*) > 1) SELECT masked, f.id AS id_a, o.id AS id_b, o.figures FROM o JOIN f USING (masked) WHERE o.figures <> f.figures"
)
def conflicting_numbers(x: Tables) -> DataFrame:
    """Sentences that differ in their figures only."""
    return audit.conflicting_numbers(x.section_nodes)


# --- measures --------------------------------------------------------------------------------------------------------


@query(
    "WITH d AS (SELECT DISTINCT digest_id, norm_key, abstract, rank_score FROM digest_items WHERE norm_key IS NOT NULL), h AS (SELECT digest_id, norm_key, max(CAST(abstract IS NOT NULL AND abstract <> '' AS INT)) AS v FROM d GROUP BY ALL), "
    "e AS (SELECT digest_id, avg(CASE WHEN norm_key IN (SELECT norm_key FROM papers WHERE norm_key IS NOT NULL) THEN 1.0 ELSE 0.0 END) AS p, avg(v) AS v FROM h GROUP BY digest_id) SELECT count(*) AS queries, round(avg(p), 6) AS precision, round(avg(v), 6) AS verified_rate FROM e"
)
def citation_precision(x: Tables) -> DataFrame:
    """Digests as recommendations, the library as gold, an abstract as evidence."""
    hits = x.digest_items.where("norm_key is not null").groupBy(F.col("digest_id").alias("query_id"), F.col("norm_key").alias("id")).agg(F.max(F.coalesce(F.col("abstract") != "", F.lit(False))).alias("verified"))
    gold = hits.select("query_id", "id").join(x.papers.select(F.col("norm_key").alias("id")).where("id is not null").distinct(), "id", "left_semi")
    m = evaluate.citation_measures(hits, gold)
    return m.select("queries", F.round("precision", 6).alias("precision"), F.round("verified_rate", 6).alias("verified_rate"))


@query(
    "WITH p AS (SELECT doc_id, min(level) AS a, max(level) AS b FROM reading_labels GROUP BY doc_id), n AS (SELECT CAST(count(*) FILTER (WHERE b > a) AS INT) AS plus FROM p) SELECT plus, 0 AS minus, CASE WHEN plus = 0 THEN 1.0 ELSE round(least(1.0, 2 * exp(-plus * ln(2.0))), 9) END AS p_value FROM n"
)
def exact_sign_test(x: Tables) -> DataFrame:
    """Do raters' higher levels exceed their lower ones: the exact test behind the sign flips."""
    p = x.reading_labels.groupBy("doc_id").agg(F.min("level").alias("a"), F.max("level").alias("b"))
    return evaluate.flips(p, "a", "b").withColumn("p_value", F.round("p_value", 9))


@query("WITH p AS (SELECT doc_id, min(level) AS a, max(level) AS b FROM reading_labels GROUP BY doc_id) SELECT count(*) AS n, count(*) FILTER (WHERE a <> b) AS n_changed, round(avg(b) - avg(a), 4) AS difference FROM p")
def described_difference(x: Tables) -> DataFrame:
    p = x.reading_labels.groupBy("doc_id").agg(F.min("level").alias("a"), F.max("level").alias("b"))
    return evaluate.described(evaluate.sign_flip(p, "a", "b", 2000)).select("n", "n_changed", "difference")


# --- section index ---------------------------------------------------------------------------------------------------

_PAGE = "coalesce(title, '') || chr(10) || coalesce(body, '')"
_HEAD = f"trim(regexp_extract({_PAGE}, '^\\s*([^\\n]*)', 1))"
_OK = "length(head) BETWEEN 2 AND 120 AND NOT regexp_matches(head, '[.。!?！？;；,，:：]$') AND regexp_matches(head, '\\p{L}')"


@query(f"SELECT id, array_to_string(CASE WHEN ok THEN list_transform(string_split(head, ':::'), lambda p: trim(p)) ELSE ['Page ' || id] END, ' > ') AS path, NOT ok AS no_heading FROM (SELECT id, head, {_OK} AS ok FROM (SELECT id, {_HEAD} AS head FROM section_nodes))")
def page_nodes(x: Tables) -> DataFrame:
    """Every section as a page: its heading on the first line, its text below."""
    pages = x.section_nodes.select("id", "paper_id", F.col("id").alias("page"), F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("body", F.lit(""))).alias("text"))
    return sections.nodes_of_pages(pages, "paper_id").select(F.col("page").alias("id"), F.array_join("path", " > ").alias("path"), "no_heading")


@query(f"SELECT paper_id, count(*) FILTER (WHERE NOT ({_OK})) < count(*) AS by_pages FROM (SELECT paper_id, {_HEAD} AS head FROM section_nodes) GROUP BY paper_id")
def indexed_by_pages(x: Tables) -> DataFrame:
    pages = x.section_nodes.select("paper_id", F.col("id").alias("page"), F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("body", F.lit(""))).alias("text"))
    return sections.by_pages(sections.nodes_of_pages(pages))


@query("SELECT paper_id, min(id) AS first, arg_min(section_path, id) AS path, min(start_page) AS start_page, max(end_page) AS end_page, md5(string_agg(body, chr(10) || chr(10) ORDER BY id)) AS body FROM (SELECT *, sum(b) OVER (PARTITION BY paper_id ORDER BY id) AS n FROM (SELECT *, CASE WHEN section_path IS DISTINCT FROM lag(section_path) OVER (PARTITION BY paper_id ORDER BY id) THEN 1 ELSE 0 END AS b FROM section_nodes WHERE length(trim(section_path)) > 0)) GROUP BY paper_id, n")
def chunk_nodes(x: Tables) -> DataFrame:
    s = x.section_nodes
    n = sections.nodes_of_chunks(s)
    return n.select("paper_id", "first", "path", "start_page", "end_page", F.md5("body").alias("body"))


@query(f"SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({section_terms_sql('t')}) AS term FROM (SELECT id, concat_ws(chr(10), section_path, title, body) AS t FROM section_nodes)) GROUP BY ALL")
def built_postings(x: Tables) -> DataFrame:
    return sections.postings(x.section_nodes, ["id"], ["section_path", "title"])


@query("SELECT id, nullif(regexp_extract(trim(title), '^([0-9]+(\\.[0-9]+)*|[IVX]+|[A-Z](\\.[0-9]+)+)\\.?\\s+\\S', 1), '') AS number FROM section_nodes WHERE title IS NOT NULL")
def heading_numbers(x: Tables) -> DataFrame:
    return x.section_nodes.where("title is not null").select("id", sections.numbering("title")[0].alias("number"))


_NAMED = "CASE " + " ".join(f"WHEN regexp_matches(bare, '^({p})$') THEN '{n}'" for n, p in sections.NAMES.items()) + " END"


@query(f"SELECT id, {_NAMED} AS name FROM (SELECT id, lower(trim(regexp_replace(trim(title), '^([0-9]+(\\.[0-9]+)*|[IVXivx]+)\\.?\\s+', ''))) AS bare FROM section_nodes WHERE title IS NOT NULL)")
def section_names(x: Tables) -> DataFrame:
    return x.section_nodes.where("title is not null").select("id", sections.known_section("title").alias("name"))


@query()
def tree_numbers(x: Tables) -> DataFrame:
    """Dotted numbers of all sections by their title paths."""
    return tree.number_paths(x.section_nodes.select("paper_id", F.col("id").alias("seq"), F.split(F.coalesce("section_path", F.lit("")), " > ").alias("path")))
