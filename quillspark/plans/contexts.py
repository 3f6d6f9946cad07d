"""Contexts for answers, recommended citations, evidence and numbering."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import fields as f, text as t
from ..operators import context, fulltext
from ..operators.lexical import top
from .ranking import QUERY
from .registry import Tables, query
from .search import _HITS, _TERMS, _hits

_LOW = "lower(coalesce(body, ''))"
_N = lambda w, c=_LOW: f"(length({c}) - length(replace({c}, '{w}', ''))) / {len(w)}.0"
_T = ", ".join(f"{_N(w)} AS t{i}" for i, w in enumerate(_TERMS))
_F = ", ".join(f"count(*) FILTER (WHERE t{i} > 0) AS f{i}" for i in range(len(_TERMS)))
_WSUM = " + ".join(f"t{i} * ln(1 + (n - f{i} + 0.5) / (f{i} + 0.5))" for i in range(len(_TERMS)))
_FSUM = " + ".join(f"f{i}" for i in range(len(_TERMS)))
_KIND = "CASE WHEN regexp_matches(coalesce(body, ''), '(^|\\n)Table [0-9]') THEN 'table' ELSE 'text' END"


@query(
    f"WITH {_HITS}, base AS (SELECT paper_id, id, greatest(length({_LOW}), 1) AS d, {_KIND} AS kind, {_T} FROM section_nodes), per AS (SELECT paper_id, count(*) AS n, {_F} FROM base GROUP BY paper_id), "
    f"s AS (SELECT b.paper_id, b.id, CASE WHEN {_FSUM} > 0 THEN round(({_WSUM}) / sqrt(d) * CASE WHEN h.rank IS NOT NULL THEN 1.6 ELSE 1 END * CASE WHEN kind = 'table' THEN 1.35 ELSE 1 END, 9) ELSE -h.rank END AS score FROM base b JOIN per USING (paper_id) LEFT JOIN (SELECT * FROM ct WHERE hit_no <= 4) h ON h.paper_id = b.paper_id AND h.id = b.id WHERE {_FSUM} > 0 OR h.rank IS NOT NULL) "
    "SELECT paper_id, id, rank FROM (SELECT paper_id, id, row_number() OVER (PARTITION BY paper_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 3"
)
def ranked_chunks(x: Tables) -> DataFrame:
    kind = F.when(F.coalesce("body", F.lit("")).rlike(r"(^|\n)Table [0-9]"), "table").otherwise("text")
    return context.ranked_chunks(x.section_nodes.withColumn("kind", kind), _TERMS, _hits(x), structured=True, kind="kind").select("paper_id", "id", "rank")


_PAGES = "(SELECT paper_id, start_page AS page, string_agg(body, chr(10) ORDER BY id) AS body FROM section_nodes WHERE start_page IS NOT NULL AND body IS NOT NULL GROUP BY ALL)"


def _pages(x: Tables) -> DataFrame:
    s = x.section_nodes.where("start_page is not null and body is not null").groupBy("paper_id", F.col("start_page").alias("page"))
    return s.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "body"))), lambda r: r["body"]), "\n").alias("body"))


@query(f"SELECT paper_id, page, rank FROM (SELECT paper_id, page, row_number() OVER (PARTITION BY paper_id ORDER BY score DESC, page) AS rank FROM (SELECT paper_id, page, round(({' + '.join(_N(w) for w in _TERMS)}) / sqrt(greatest(length({_LOW}), 1)), 9) AS score FROM {_PAGES}) WHERE score > 0) WHERE rank <= 3")
def picked_pages(x: Tables) -> DataFrame:
    return context.picked_pages(_pages(x), _TERMS).select("paper_id", "page", "rank")


@query(
    f"WITH RECURSIVE {_HITS}, o AS (SELECT row_number() OVER (ORDER BY rank) AS n, id, paper_id, (SELECT length(body) FROM section_nodes s WHERE s.id = k.id) AS size FROM (SELECT * FROM ct WHERE hit_no <= 4) k), "
    "w AS (SELECT CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS used, false AS kept UNION ALL SELECT o.n, CASE WHEN w.used + o.size <= 24000 THEN w.used + o.size ELSE w.used END, w.used + o.size <= 24000 FROM w JOIN o ON o.n = w.n + 1) SELECT o.paper_id, o.id, o.size FROM w JOIN o USING (n) WHERE kept"
)
def context_within_budget(x: Tables) -> DataFrame:
    """The hits in order as long as they fit 24,000 characters; one that does not is skipped."""
    sized = _hits(x).join(x.section_nodes.select("id", F.length("body").cast("bigint").alias("size")), "id")
    return context.within_budget(sized, "rank", "size").select("paper_id", "id", "size")


@query(f"WITH {_HITS}, k AS (SELECT paper_id AS id, row_number() OVER (ORDER BY min(rank), paper_id) AS rank FROM ct WHERE hit_no <= 4 GROUP BY paper_id ORDER BY rank LIMIT 30), p AS (SELECT id, row_number() OVER (ORDER BY citation_count DESC NULLS LAST, id) AS rank FROM papers ORDER BY rank LIMIT 3), u AS (SELECT id, 0 AS src, rank FROM p UNION ALL SELECT id, 1, rank FROM k), o AS (SELECT id, min(src) AS src, arg_min(rank, src) AS r FROM u GROUP BY id) SELECT id, row_number() OVER (ORDER BY src, r, id) AS place FROM o ORDER BY place LIMIT 8")
def carried_over(x: Tables) -> DataFrame:
    """Three pinned papers (the most cited) before the ones found."""
    pinned = top(x.papers.select("id", "citation_count"), 3, F.desc_nulls_last("citation_count"), F.asc("id"))
    return context.carried_over(pinned, fulltext.ranked_groups(_hits(x), "paper_id", 30), 8)


_WS = "[ \\t\\r\\n\\f\\v]+"
_GRAMS = "list_distinct(list_concat(list_filter(list_transform(range(1, greatest(length({0}) - 1, 1) + 1), lambda i: substr({0}, i, 2)), lambda g: length(g) = 2 AND trim(g) <> ''), regexp_extract_all({0}, '[a-z][a-z0-9-]{{2,}}')))"
_PAIRS = "list_distinct(list_transform(range(1, length({0})), lambda i: substr({0}, i, 2)))"
_ANCHOR = "round(least(1.0, 0.65 * len(list_intersect(['lexical', 'baseline', 'for', 'the', 'context', 'window'], regexp_extract_all(lower(title), '[a-z][a-z0-9-]{2,}|[一-鿿]{2,}'))) / 6.0 + 0.35 * len(list_intersect(['lexical', 'baseline', 'for', 'the', 'context', 'window'], regexp_extract_all(lower(coalesce(abstract, '')), '[a-z][a-z0-9-]{2,}|[一-鿿]{2,}'))) / 6.0), 3)"


@query(
    f"WITH q AS (SELECT {_GRAMS.format(repr(QUERY))} AS g, {_PAIRS.format(repr(QUERY.replace(' ', '')))} AS p), a AS (SELECT id, abstract, lower(regexp_replace(title || ' ' || coalesce(abstract, ''), '{_WS}', ' ', 'g')) AS z, {_ANCHOR} AS anchor FROM papers), "
    f"s AS (SELECT id, abstract, anchor, round(len(list_intersect(g, {_GRAMS.format('z')})) / len(g), 9) AS score FROM a, q ORDER BY score DESC, id LIMIT 10), "
    "e AS (SELECT id, unnest(range(0, len(l))) AS n, unnest(l) AS sentence FROM (SELECT id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(coalesce(abstract, ''), '([。！？!?])', '\\1' || chr(1), 'g'), '([.]) +([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: trim(s)), lambda s: length(s) >= 12) AS l FROM s)), "
    f"v AS (SELECT id, n, sentence, len(list_intersect(p, {_PAIRS.format('z')})) / greatest(len({_PAIRS.format('z')}), 1) AS e FROM (SELECT *, lower(regexp_replace(sentence, '{_WS}', '', 'g')) AS z FROM e), q), "
    "b AS (SELECT id, arg_max(sentence, struct_pack(a := round(e, 9), b := -n)) AS evidence, round(max(e), 3) AS es FROM v WHERE e > 0 GROUP BY id) "
    f"SELECT id, evidence, rank FROM (SELECT id, evidence, row_number() OVER (ORDER BY (evidence IS NOT NULL AND contains(lower(regexp_replace(coalesce(abstract, ''), '{_WS}', '', 'g')), lower(regexp_replace(coalesce(evidence, ''), '{_WS}', '', 'g')))) DESC, round(0.45 * round(score, 3) + 0.25 * coalesce(es, 0) + 0.3 * anchor, 9) DESC, id) AS rank FROM s LEFT JOIN b USING (id)) WHERE rank <= 5"
)
def recommended_citations(x: Tables) -> DataFrame:
    pattern = f"[a-z][a-z0-9-]{{2,}}|[{t.HAN}]{{2,}}"
    q = F.array_distinct(t.all_matches(F.lit(QUERY), pattern))
    share = lambda c: F.size(F.array_intersect(q, t.all_matches(F.lower(F.coalesce(c, F.lit(""))), pattern))) / F.size(q)
    anchor = F.least(F.lit(1.0), 0.65 * share(F.col("title")) + 0.35 * share(F.col("abstract")))
    return context.recommended(x.papers, QUERY, anchor).select("id", "evidence", "rank")


_WORDS = "list_distinct(regexp_extract_all(lower(coalesce({}, '')), '[a-z][a-z0-9]+|[一-鿿]'))"


@query(
    f"WITH c AS (SELECT p.id AS claim_id, p.id AS paper_id, {_WORDS.format('p.title')} AS w FROM papers p), r AS (SELECT paper_id, id, {_WORDS.format('body')} AS v FROM section_nodes WHERE body IS NOT NULL), s AS (SELECT claim_id, r.id, round(len(list_intersect(w, v)) / len(w), 9) AS score FROM c JOIN r USING (paper_id) WHERE len(list_intersect(w, v)) > 0) "
    "SELECT claim_id, id, rank FROM (SELECT claim_id, id, row_number() OVER (PARTITION BY claim_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 4"
)
def evidence_bundles(x: Tables) -> DataFrame:
    """Titles as claims about their papers: the sections that say most of them."""
    claims = x.papers.select(F.col("id").alias("claim_id"), F.col("id").alias("paper_id"), f.words_of("title").alias("words"))
    rows = x.section_nodes.where("body is not null").select("paper_id", "id", f.words_of("body").alias("words"))
    return context.evidence_for(claims, rows).select("claim_id", "id", "rank")


@query("SELECT user_id, k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS number FROM (SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, min(ts) AS ts, arg_min(event_id, struct_pack(a := ts, b := event_id)) AS event_id FROM events WHERE json_extract(props, '$.k') IS NOT NULL GROUP BY ALL)")
def session_numbers(x: Tables) -> DataFrame:
    """What each user used, numbered by its first use."""
    uses = x.events.select("user_id", "ts", "event_id", F.from_json("props", "k bigint")["k"].alias("k")).where("k is not null")
    return context.numbered(uses, "user_id", ["ts", "event_id"], "k")


@query(f"SELECT id, round(len(list_intersect(['lexical', 'baseline', 'for', 'the', 'context', 'window'], {_WORDS.format('abstract')})) / 6.0, 6) AS score FROM papers")
def evidence_scores(x: Tables) -> DataFrame:
    return x.papers.select("id", F.round(context.relevance(QUERY, F.col("abstract")), 6).alias("score"))
