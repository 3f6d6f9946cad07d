"""Queries of single fields: search terms, claims, identifiers, hashes, cards."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import fields as f, text as t
from .registry import Tables, query

_WS = "[ \\t\\r\\n\\f\\v]+"
NEWEST = 2027  # last year that counts as one


def _sp(c: str) -> str:
    return f"trim(regexp_replace({c}, '{_WS}', ' ', 'g'))"


def tokens_sql(c: str) -> str:
    return f"list_filter(list_transform(string_split(regexp_replace(coalesce({c}, ''), '[^\\p{{L}}\\p{{N}}_+#./-]+', ' ', 'g'), ' '), lambda w: regexp_replace(w, '^[-./]+|[-./]+$', '', 'g')), lambda w: length(w) >= 2)"


def terms_sql(c: str) -> str:
    """All search terms, in no order."""
    han = "flatten(list_transform(regexp_extract_all(w, '[一-鿿]+'), lambda r: list_transform(range(1, length(r) - 1), lambda i: substr(r, i, 3))))"
    latin = "CASE WHEN regexp_matches(w, '[一-鿿]') THEN list_filter(list_transform(regexp_extract_all(w, '[A-Za-z0-9][A-Za-z0-9+#./-]*'), lambda v: regexp_replace(v, '^[-./]+|[-./]+$', '', 'g')), lambda v: length(v) >= 2) ELSE [] END"
    return f"list_distinct(flatten(list_transform({tokens_sql(c)}, lambda w: list_concat(list_concat([w], {han}), {latin}))))"


@query(f"SELECT id, unnest({terms_sql('title')}) AS term FROM papers")
def search_terms(x: Tables) -> DataFrame:
    return x.papers.select("id", F.explode(f.search_terms("title")).alias("term"))


@query("SELECT id, regexp_replace(lower(coalesce(title, '')), '[^a-z0-9一-鿿]+', '', 'g') AS form FROM papers")
def audit_forms(x: Tables) -> DataFrame:
    return x.papers.select("id", f.audit_form("title").alias("form"))


_CLAIMS = (
    "list_filter(list_transform(string_split_regex(regexp_replace(regexp_replace(coalesce(body, ''), '。(\\[[0-9]{1,2}\\])', '\\1。', 'g'), '([。！？!?])', '\\1' || chr(10), 'g'), '\\n+'), "
    "lambda s: trim(replace(regexp_replace(trim(s), '^[-*•· ]+', ''), '**', ''))), lambda s: length(s) >= 15 AND NOT regexp_matches(s, '" + f.META + "'))"
)


@query(f"SELECT id, len(list_filter(c, lambda s: regexp_matches(s, '\\[[0-9]{{1,2}}\\]'))) AS supported, len(list_filter(c, lambda s: NOT regexp_matches(s, '\\[[0-9]{{1,2}}\\]'))) AS unsupported FROM (SELECT id, {_CLAIMS} AS c FROM section_nodes)")
def section_claims(x: Tables) -> DataFrame:
    c = x.section_nodes.select("id", f.claims("body").alias("c"))
    return c.select("id", F.size(F.filter("c", f.supported)).cast("bigint").alias("supported"), F.size(F.filter("c", lambda s: ~f.supported(s))).cast("bigint").alias("unsupported"))


@query(f"SELECT id, unnest(list_filter({_CLAIMS}, lambda s: NOT regexp_matches(s, '\\[[0-9]{{1,2}}\\]'))) AS claim FROM section_nodes")
def unsupported_claims(x: Tables) -> DataFrame:
    return x.section_nodes.select("id", F.explode(f.claims("body")).alias("claim")).where(~f.supported(F.col("claim")))


@query("SELECT id, md5(regexp_replace(coalesce(body, ''), '\\[(00|0|1[3-9]|[2-9][0-9])\\]', '', 'g')) AS kept, len(list_distinct(list_transform(regexp_extract_all(coalesce(body, ''), '\\[(00|0|1[3-9]|[2-9][0-9])\\]', 1), lambda n: CAST(n AS INT)))) AS removed FROM section_nodes")
def kept_citations(x: Tables) -> DataFrame:
    text, gone = f.citations_within("body", 12)
    return x.section_nodes.select("id", F.md5(text.cast("binary")).alias("kept"), F.size(gone).cast("bigint").alias("removed"))


@query("SELECT id, CASE WHEN length(body) <= 400 THEN body WHEN strpos(lower(body), 'baseline') = 0 THEN substr(body, 1, 400) ELSE substr(body, greatest(1, strpos(lower(body), 'baseline') - 133), 400) END AS clip FROM section_nodes WHERE body IS NOT NULL")
def clipped_sentences(x: Tables) -> DataFrame:
    return x.section_nodes.where("body is not null").select("id", f.clip("body", "baseline").alias("clip"))


@query("SELECT doc_id, CASE WHEN kind = 'note' THEN substr(text, 1, 400) WHEN length(text) <= 320 THEN text ELSE substr(text, 1, 200) || '……（中略）……' || right(text, 120) END AS turn FROM documents WHERE text IS NOT NULL")
def shortened_turns(x: Tables) -> DataFrame:
    return x.documents.where("text is not null").select("doc_id", f.shortened_turn("text", F.coalesce(F.col("kind") == "note", F.lit(False))).alias("turn"))


@query("SELECT doc_id, length(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g')) AS n FROM documents WHERE text IS NOT NULL")
def clean_lengths(x: Tables) -> DataFrame:
    return x.documents.where("text is not null").select("doc_id", F.length(f.without_controls("text")).cast("bigint").alias("n"))


@query(f"SELECT id, lower({_sp('title')}) AS cell, regexp_matches({_sp('doi')}, '^[-+±~≈<>≤≥]?\\s*[0-9][0-9,]*(\\.[0-9]+)?\\s*(%|±\\s*[0-9.]+)?$') AS number FROM papers WHERE doi IS NOT NULL")
def table_cells(x: Tables) -> DataFrame:
    return x.papers.where("doi is not null").select("id", f.cell("title").alias("cell"), f.numeric_cell("doi").alias("number"))


_RUN = "'^[-+]?[0-9]+(\\.[0-9]+)?%?([ \\t\\r\\n\\f\\v,;/|]+[-+]?[0-9]+(\\.[0-9]+)?%?)+$'"


@query(f"SELECT l_orderkey, l_linenumber, CAST(regexp_matches(l_quantity || ' ' || l_tax, {_RUN}) AS INT) + CAST(regexp_matches(l_returnflag, {_RUN}) AS INT) + CAST(regexp_matches(l_discount || '/' || l_tax, {_RUN}) AS INT) >= 2 AS mangled FROM lineitem")
def mangled_tables(x: Tables) -> DataFrame:
    number = lambda c: F.col(c).cast("string")
    cells = F.array(F.concat_ws(" ", number("l_quantity"), number("l_tax")), F.col("l_returnflag"), F.concat_ws("/", number("l_discount"), number("l_tax")))
    return x.lineitem.select("l_orderkey", "l_linenumber", f.mangled(cells).alias("mangled"))


@query(f"SELECT id, sha1(paper_id || chr(30) || coalesce(CAST(start_page AS VARCHAR), 'None') || chr(30) || {_sp("coalesce(title, '')")} || chr(31) || {_sp("coalesce(section_path, '')")}) AS t, sha1(paper_id || chr(30) || start_page || chr(30) || {_sp("coalesce(title, '')")}) AS fig FROM section_nodes WHERE start_page IS NOT NULL")
def content_hashes(x: Tables) -> DataFrame:
    return x.section_nodes.where("start_page is not null").select("id", f.table_hash("paper_id", "start_page", F.array("title", "section_path")).alias("t"), f.figure_hash("paper_id", "start_page", "title").alias("fig"))


@query("SELECT DISTINCT source, 'c-' || CASE WHEN slug = '' THEN 'default' ELSE slug END || '-' || substr(sha1(source), 1, 8) AS name FROM (SELECT coalesce(source, '') AS source, substr(regexp_replace(regexp_replace(coalesce(source, ''), '[^a-zA-Z0-9._-]', '-', 'g'), '^[._-]+|[._-]+$', '', 'g'), 1, 64) AS slug FROM documents)")
def collection_names(x: Tables) -> DataFrame:
    return x.documents.select(F.coalesce("source", F.lit("")).alias("source")).distinct().select("source", f.collection_name("source").alias("name"))


@query("SELECT id, CASE WHEN regexp_matches(body, '\\\\[()\\[\\]]|\\\\(sum|int|prod|partial|infty)') OR length(body) - length(replace(body, '$', '')) >= 2 THEN 'formula' ELSE 'text' END AS kind FROM (SELECT id, coalesce(body, '') AS body FROM section_nodes)")
def block_types(x: Tables) -> DataFrame:
    return x.section_nodes.select("id", f.block_type("body").alias("kind"))


_D = "regexp_replace(regexp_replace(regexp_extract('(see ' || doi || ').', '10\\.[0-9]{4,9}/[-._;()/:A-Za-z0-9]+'), '-+$', ''), '[.,;:''\"]+$', '')"
_COUNT = "(length(d) - length(replace(d, '{}', '')))"


@query(f"SELECT id, left(d, length(d) - least(length(regexp_extract(d, '\\)*$')), greatest(0, {_COUNT.format(')')} - {_COUNT.format('(')}))) AS doi FROM (SELECT id, {_D} AS d FROM papers WHERE doi IS NOT NULL)")
def found_dois(x: Tables) -> DataFrame:
    return x.papers.where("doi is not null").select("id", f.first_doi(F.concat(F.lit("(see "), F.col("doi"), F.lit(")."))).alias("doi"))


@query("SELECT id, list_max(list_transform(list_filter(regexp_extract_all(body, '[0-9]+'), lambda v: regexp_matches(v, '^(19|20)[0-9]{2}$') AND v <= '2027'), lambda v: CAST(v AS INT))) AS year FROM section_nodes WHERE body IS NOT NULL")
def latest_years(x: Tables) -> DataFrame:
    return x.section_nodes.where("body is not null").select("id", f.latest_year("body", NEWEST).alias("year"))


@query("SELECT id, CASE WHEN CAST(substr(arxiv_id, 3, 2) AS INT) BETWEEN 1 AND 12 THEN 2000 + CAST(substr(arxiv_id, 1, 2) AS INT) - CASE WHEN 2000 + CAST(substr(arxiv_id, 1, 2) AS INT) > 2027 THEN 100 ELSE 0 END END AS year FROM papers WHERE regexp_matches(arxiv_id, '^[0-9]{4}\\.')")
def preprint_years(x: Tables) -> DataFrame:
    return x.papers.where(F.col("arxiv_id").rlike(r"^[0-9]{4}\.")).select("id", f.arxiv_year("arxiv_id", NEWEST).alias("year"))


@query(f"SELECT id, CASE WHEN length(a) >= 40 THEN a ELSE '' END AS abstract FROM (SELECT id, regexp_replace({_sp('abstract')}, '^[\\s\\-—–‒·•∙:：.。|、,]+', '') AS a FROM papers WHERE abstract IS NOT NULL AND NOT regexp_matches(abstract, '(?is)\\n\\s*((([IVX]+|[0-9])\\s*[.、]?\\s*)?(introduction|key|index)|abstract)'))")
def found_abstracts(x: Tables) -> DataFrame:
    """A first page is built around every abstract; the abstract must come back."""
    p = x.papers.where(F.col("abstract").isNotNull() & ~F.col("abstract").rlike(r"(?is)\n\s*((([IVX]+|[0-9])\s*[.、]?\s*)?(introduction|key|index)|abstract)"))
    page = F.concat(F.lit("Abstract readings of a title\nA. Author\nAbstract\n"), F.col("abstract"), F.lit("\n1 Introduction\nThe text begins."))
    return p.select("id", f.found_abstract(page).alias("abstract"))


_SAFE = f"trim(substr(regexp_replace(regexp_replace(list_last(string_split(regexp_replace(replace({_sp('coalesce(title, chr(32))')}, chr(92), '/'), '^[A-Za-z]:', ''), '/')), '[\\x00-\\x1f<>:\"|?*]', '_', 'g'), '^[ .]+|[ .]+$', '', 'g'), 1, 200))"


@query(f"SELECT id, CASE WHEN n = '' THEN 'upload.pdf' ELSE n END AS name FROM (SELECT id, regexp_replace(substr(regexp_replace(list_last(string_split(regexp_replace(replace({_sp('t')}, chr(92), '/'), '^[A-Za-z]:', ''), '/')), '[\\x00-\\x1f<>:\"|?*]', '_', 'g'), 1, 4000), '^[ .]+|[ .]+$', '', 'g') AS n FROM (SELECT id, 'C:' || chr(92) || 'in/' || title || '?.pdf.' AS t FROM papers)) WHERE length(n) <= 200")
def safe_names(x: Tables) -> DataFrame:
    path = F.concat(F.lit("C:\\in/"), F.col("title"), F.lit("?.pdf."))
    return x.papers.select("id", f.safe_name(path).alias("name")).where("length(name) < 200")


@query("SELECT id, CASE WHEN arxiv_id IS NOT NULL THEN 'https://arxiv.org/pdf/' || arxiv_id WHEN doi IS NOT NULL AND regexp_matches(lower(trim(doi)), '\\.pdf$|/pdf/|/pdf$') THEN trim(doi) END AS link FROM papers")
def pdf_links(x: Tables) -> DataFrame:
    url = F.coalesce(F.concat(F.lit("https://arxiv.org/pdf/"), F.col("arxiv_id")), F.col("doi"))
    return x.papers.select("id", f.pdf_link(url).alias("link"))


@query(f"SELECT item_id, CASE WHEN greatest(length(q), length(p)) < 20 THEN NULL WHEN length(p) > length(q) OR (length(p) = length(q) AND p >= q) THEN p ELSE q END AS probe FROM (SELECT item_id, lower({_sp('question')}) AS q, lower({_sp('passage')}) AS p FROM eval_items)")
def gold_probes(x: Tables) -> DataFrame:
    return x.eval_items.select("item_id", f.longest_probe(F.concat("question", F.lit(" BIBREF12 "), F.col("passage"))).alias("probe"))


@query("SELECT digest_id, norm_key, count(*) AS deliveries, CAST(sum(coalesce(json_array_length(CASE WHEN json_valid(reasons_json) THEN reasons_json END), 0)) AS BIGINT) AS reasons FROM digest_items GROUP BY ALL")
def safe_reasons(x: Tables) -> DataFrame:
    n = F.coalesce(F.json_array_length("reasons_json"), F.lit(0))
    return x.digest_items.groupBy("digest_id", "norm_key").agg(F.count(F.lit(1)).alias("deliveries"), F.sum(n).alias("reasons"))


@query("SELECT id, lower(regexp_replace(coalesce(venue, ''), '[\\s（）()【】\\[\\].。,，]+', '', 'g')) IN (" + ", ".join(f"'{w}'" for w in f.NOTHING) + ") AS nothing FROM papers")
def placeholder_cells(x: Tables) -> DataFrame:
    return x.papers.select("id", f.placeholder("venue").alias("nothing"))


@query("SELECT event_id, CASE WHEN value > 0 AND value = floor(value) THEN CAST(value AS BIGINT) END AS page FROM events")
def positive_pages(x: Tables) -> DataFrame:
    return x.events.select("event_id", f.positive_page(F.col("value").cast("string")).alias("page"))


@query("SELECT id, CASE WHEN head = '' THEN '（无摘要，仅元数据）' ELSE head END AS tldr, CASE WHEN rest = '' THEN '（摘要未提及）' ELSE rest END AS results FROM (SELECT id, head, substr(trim(substr(a, length(head) + 1)), 1, 200) AS rest FROM (SELECT id, a, CASE WHEN contains(a, '。') THEN split_part(a, '。', 1) ELSE substr(a, 1, 120) END AS head FROM (SELECT id, trim(coalesce(abstract, '')) AS a FROM papers)))")
def extract_cards(x: Tables) -> DataFrame:
    tldr, results = f.extract_card("abstract")
    return x.papers.select("id", tldr.alias("tldr"), results.alias("results"))


@query("SELECT id, '---' || chr(10) || 'title: \"' || replace(coalesce(title, ''), '\"', '\\\"') || '\"' || chr(10) || 'year: ' || coalesce(CAST(year AS VARCHAR), '') || chr(10) || 'authors: [' || coalesce(array_to_string(list_transform(authors, lambda a: '\"' || replace(coalesce(a, ''), '\"', '\\\"') || '\"'), ', '), '') || ']' || chr(10) || '---' || chr(10) || chr(10) || '# ' || coalesce(title, '') || chr(10) || chr(10) || coalesce(abstract, '') AS note FROM papers")
def vault_notes(x: Tables) -> DataFrame:
    """One note for each paper: front matter, heading, abstract."""
    names = F.array_join(F.transform(F.coalesce("authors", F.array()), f.yaml_value), ", ")
    front = F.concat(F.lit("---\ntitle: "), f.yaml_value("title"), F.lit("\nyear: "), F.coalesce(F.col("year").cast("string"), F.lit("")), F.lit("\nauthors: ["), names, F.lit("]\n---\n\n# "))
    return x.papers.select("id", F.concat(front, F.coalesce("title", F.lit("")), F.lit("\n\n"), F.coalesce("abstract", F.lit(""))).alias("note"))


_PAIRS = "list_distinct(list_transform(range(1, length({0})), lambda i: substr({0}, i, 2)))"
_Q = "lexicalbaselineforthecontextwindow"


@query(
    f"WITH s AS (SELECT id, unnest(range(1, len(a) + 1)) AS n, unnest(a) AS sentence FROM (SELECT id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(abstract, '([。！？!?])', '\\1' || chr(1), 'g'), '([.]) +([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: trim(s)), lambda s: length(s) >= 12) AS a FROM papers WHERE abstract IS NOT NULL)), "
    f"g AS (SELECT id, n, sentence, lower(regexp_replace(sentence, '{_WS}', '', 'g')) AS z FROM s), v AS (SELECT id, n, sentence, len(list_intersect({_PAIRS.format(repr(_Q))}, {_PAIRS.format('z')})) / greatest(len({_PAIRS.format('z')}), 1) AS score FROM g) "
    "SELECT id, arg_max(sentence, struct_pack(s := round(score, 9), n := -n)) AS sentence, round(max(score), 6) AS score FROM v WHERE score > 0 GROUP BY id"
)
def best_sentences(x: Tables) -> DataFrame:
    """The sentence of each abstract whose pairs of characters a paragraph covers best; the first among equals."""
    q = f.pairs_of(F.lit(_Q))
    s = x.papers.where("abstract is not null").select("id", F.posexplode(t.sentences("abstract")).alias("n", "sentence")).withColumn("own", f.pairs_of("sentence"))
    v = s.withColumn("score", F.size(F.array_intersect(q, "own")) / F.greatest(F.size("own"), F.lit(1))).where("score > 0")
    return v.groupBy("id").agg(F.max_by("sentence", F.struct(F.round("score", 9), -F.col("n"))).alias("sentence"), F.round(F.max("score"), 6).alias("score"))
