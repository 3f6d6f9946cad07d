"""Text functions as columns: identity keys, tokenisers, windows, numbers. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Words without meaning of their own, as the section index leaves them out.
SECTION_STOPWORDS = """
a an the and or but if of in on at to for from by with without within into over under
between among as is are was were be been being am do does did doing have has had having
this that these those it its it's we our us they their them he she his her you your i my
not no nor so than then there here when where which who whom whose what how why can could
should would may might must will shall also such same other others more most much many few
some any all both each every only just very too both up down out off about after before
during while because since until per via using used use uses based
""".split()
#: The same for interest profiles.
PROFILE_STOPWORDS = """
the and for with from that this these those are was were its our their his her you your not
via using toward towards into onto over under can does how what why when where which who whom
new novel paper study approach based use used uses results result case cases work works propose proposed
proposes more less than then also such some any all one two three first second third very
研究 方法 基于 分析 一种 问题 模型
""".split()

HAN = "一-鿿"
SPACE = r"[ \t\r\n\f\x0B]+"


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def all_matches(c: str | Column, pattern: str) -> Column:
    return F.regexp_extract_all(_c(c), F.lit(pattern), F.lit(0))


def collapse(c: str | Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(_c(c), SPACE, " "))


def squeeze(c: str | Column) -> Column:
    """Without white space, lower case: the form in which quotes are looked up."""
    return F.lower(F.regexp_replace(_c(c), SPACE, ""))


def norm_query(c: str | Column) -> Column:
    return F.lower(collapse(c))


def bare_doi(c: str | Column) -> Column:
    """DOI without resolver prefix; blank is null."""
    bare = F.trim(F.regexp_replace(F.trim(_c(c)), r"(?i)^https?://(dx\.)?doi\.org/", ""))
    return F.when(bare != "", bare)


def norm_key(doi: str | Column, arxiv: str | Column, title: str | Column) -> Column:
    """Identity across sources: DOI, else arXiv id without version, else a hash of the title's letters and digits."""
    d = F.lower(bare_doi(doi))
    a = F.regexp_replace(F.regexp_replace(F.lower(F.trim(_c(arxiv))), "arxiv:", ""), r"v[0-9]+$", "")
    t = F.regexp_replace(F.lower(_c(title)), f"[^a-z0-9{HAN}]+", "")
    return F.coalesce(
        F.concat(F.lit("doi:"), F.when(d != "", d)),
        F.concat(F.lit("arxiv:"), F.when(a != "", a)),
        F.when(t != "", F.concat(F.lit("title:"), F.substring(F.sha1(t.cast("binary")), 1, 16))),
    )


def han_pairs(c: str | Column) -> Column:
    """Overlapping pairs of each run of Chinese characters."""
    runs = all_matches(c, f"[{HAN}]{{2,}}")
    return F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))


def rank_terms(c: str | Column) -> Column:
    """Words and numbers in lower case with repetition, then Chinese pairs: what the BM25 re-ranker counts."""
    text = F.coalesce(_c(c), F.lit(""))
    return F.concat(F.transform(all_matches(text, r"[a-zA-Z][a-zA-Z-]{1,}|\d+(?:\.\d+)?"), F.lower), han_pairs(text))


def section_terms(c: str | Column) -> Column:
    """Terms of the section index: latin words and numbers of two or more characters without stop words, Chinese pairs; with repetition."""
    low = F.lower(F.coalesce(_c(c), F.lit("")))
    stop = F.array(*[F.lit(w) for w in SECTION_STOPWORDS])
    words = F.filter(all_matches(low, r"[a-z0-9]+"), lambda w: (F.length(w) >= 2) & ~F.array_contains(stop, w))
    return F.concat(words, han_pairs(low))


def query_terms(c: str | Column, most: int = 12) -> Column:
    """Distinct terms of a question in order of appearance: latin tokens, then Chinese pairs; the first `most`, as the question box has it."""
    text = F.coalesce(_c(c), F.lit(""))
    words = F.filter(all_matches(text, r"[A-Za-z0-9][A-Za-z0-9._-]*"), lambda w: F.length(w) >= 2)
    return F.slice(F.array_distinct(F.concat(F.transform(words, F.lower), han_pairs(text))), 1, most)


def profile_terms(c: str | Column) -> Column:
    """Set of interest terms of a text: words of three or more letters that are neither stop words nor numbers, pairs of such neighbours, Chinese pairs."""
    low = norm_query(F.coalesce(_c(c), F.lit("")))
    stop = F.array(*[F.lit(w) for w in PROFILE_STOPWORDS])
    tokens = F.transform(all_matches(low, f"[a-z0-9][a-z0-9+-]*|[{HAN}]+"), lambda t: F.regexp_replace(t, r"^[-+]+|[-+]+$", ""))
    fit = lambda t: (F.length(t) >= 3) & ~F.array_contains(stop, t) & ~t.rlike("^[0-9]+$") & ~t.rlike(f"[{HAN}]")
    words = F.filter(tokens, fit)
    starts = F.transform(tokens, lambda t, i: F.struct(t.alias("a"), F.try_element_at(tokens, i + 2).alias("b")))
    pairs = F.transform(F.filter(starts, lambda s: fit(s["a"]) & s["b"].isNotNull() & fit(s["b"])), lambda s: F.concat_ws(" ", s["a"], s["b"]))
    han = F.filter(han_pairs(low), lambda t: ~F.array_contains(stop, t))
    return F.array_distinct(F.concat(words, pairs, han))


def sentences(c: str | Column, least: int = 12) -> Column:
    """Sentences of at least `least` characters: cut behind 。！？!? and behind a full stop before a capital."""
    cut = F.regexp_replace(F.regexp_replace(_c(c), "([。！？!?])", "$1\u0001"), r"([.]) +([A-Z])", "$1\u0001$2")
    return F.filter(F.transform(F.split(cut, "\u0001"), lambda s: F.trim(s)), lambda s: F.length(s) >= least)


def window_around(c: str | Column, term: str, size: int = 400) -> Column:
    """At most `size` characters around the first hit of a term, a third of them before it; an ellipsis where the start was cut."""
    text = _c(c)
    at = F.locate(term, F.lower(text))
    begin = F.greatest(F.lit(1), at - size // 3)
    return F.when(at > 0, F.concat(F.when(begin > 1, F.lit("…")).otherwise(F.lit("")), F.substring(text, begin, F.lit(size))))


def shorten(c: str | Column, limit: int) -> Column:
    """At most `limit` characters with an ellipsis, cut at the end of a clause if that keeps half of them."""
    text = _c(c)
    head = F.substring(text, 1, limit)
    clause = F.regexp_extract(head, r"^(.*[,;.。，；])", 1)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.when(F.length(clause) >= limit / 2, clause).otherwise(head), F.lit("…")))


def numbers(c: str | Column) -> Column:
    """Distinct numbers of a text in canonical spelling, a percent sign kept; citations in brackets and identifiers such as R2 do not count."""
    clean = F.regexp_replace(F.regexp_replace(_c(c), r"\[[0-9]+(, *[0-9]+)*\]", ""), r"[A-Za-z]+[-_.]?[0-9]+", "")
    raw = all_matches(clean, r"[0-9]+(?:\.[0-9]+)?(?: percent|%)?")
    scalar = F.transform(raw, lambda r: F.concat(F.regexp_replace(F.regexp_replace(F.regexp_extract(r, r"^[0-9.]+", 0), r"(\.[0-9]*?)0+$", "$1"), r"\.$", ""), F.when(r.rlike("percent|%"), F.lit("%")).otherwise(F.lit(""))))
    return F.array_distinct(scalar)


def arxiv_id(c: str | Column) -> Column:
    """First arXiv id of either notation, without version; null if there is none."""
    found = F.regexp_extract(_c(c), r"([0-9]{4}\.[0-9]{4,7}|[a-z-]+(?:\.[A-Z]{2})?/[0-9]{7})", 1)
    return F.when(found != "", found)


def bib_key(authors: str | Column, year: str | Column, title: str | Column, ident: str | Column) -> Column:
    """Citation key: surname of the first author that has latin letters, year, slug of the title."""
    names = F.transform(F.coalesce(_c(authors), F.array()), lambda a: F.lower(F.regexp_replace(F.element_at(F.split(F.trim(F.regexp_replace(a, SPACE, " ")), " "), -1), "[^A-Za-z]", "")))
    surname = F.try_element_at(F.filter(names, lambda n: n != ""), F.lit(1))
    slug = F.lower(F.substring(F.regexp_replace(F.coalesce(_c(title), F.lit("")), "[^A-Za-z0-9]", ""), 1, 20))
    return F.concat(F.coalesce(surname, F.lit("anon")), F.coalesce(_c(year).cast("string"), F.lit("")), F.when(slug != "", slug).otherwise(F.concat(F.lit("p"), _c(ident).cast("string"))))


def text_from_inverted(inverted: DataFrame, id_col: str) -> DataFrame:
    """id, rebuilt: texts from rows (id, word, at array of positions), words in order of position."""
    each = inverted.select(id_col, F.explode("at").alias("pos"), "word")
    return each.groupBy(id_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda s: s["word"]), " ").alias("rebuilt"))
