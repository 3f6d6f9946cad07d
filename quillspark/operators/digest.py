"""Daily recommendations: candidates, scores by an interest profile, reasons without repetition, categories."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as t
from ..functions.arrow import map_rows
from .lexical import top

#: Worth of a hit in the title and in the abstract, terms in the yardstick, factor of a single concept, smallest batch with an idf.
TITLE, ABSTRACT, YARDSTICK, SINGLE, LEAST = 1.0, 0.4, 5, 0.6, 20
#: Most terms of a profile that count: a bound of what goes to the driver and into the plan.
PROFILE = 60


def profile_rows(profile: DataFrame, most: int = PROFILE) -> list[tuple[str, float]]:
    """The strongest terms of a profile (term, weight), by weight, then term."""
    rows = profile.where("weight > 0 and length(term) > 0").select("term", F.round("weight", 9).alias("weight")).orderBy(F.desc("weight"), F.asc("term")).limit(most).collect()
    return [(r.term, r.weight) for r in rows]


_BOUND = "\u0001"


def bounded(text: Column) -> Column:
    """The text with a mark at both ends of every run of Latin letters and digits: a bounded term stands in a bounded text exactly where the term stands at word bounds."""
    return F.regexp_replace(text, "([a-z0-9]+)", f"{_BOUND}$1{_BOUND}")


def _bounded(term: str) -> str:
    return re.sub("([a-z0-9]+)", rf"{_BOUND}\1{_BOUND}", term)


def is_chinese(term: str) -> bool:
    return any("一" <= c <= "鿿" for c in term)


def parts_of(term: str) -> list[str]:
    """Smaller terms that a term contains: words of a phrase, pairs of a longer Chinese one."""
    if " " in term:
        return term.split()
    return [term[i : i + 2] for i in range(len(term) - 1)] if len(term) > 2 and is_chinese(term) else []


def concepts(reasons: list[dict]) -> list[dict]:
    """Of a phrase and its parts the strongest reason only (then the longer, then the later term); reasons in order of contribution, then term."""
    group = {r["term"]: r["term"] for r in reasons}

    def root(x: str) -> str:
        while group[x] != x:
            x = group[x]
        return x

    for r in reasons:
        for p in parts_of(r["term"]):
            if p in group:
                group[root(r["term"])] = root(p)
    best: dict[str, dict] = {}
    for r in reasons:
        k = root(r["term"])
        if k not in best or (r["contribution"], len(r["term"]), r["term"]) > (best[k]["contribution"], len(best[k]["term"]), best[k]["term"]):
            best[k] = r
    return sorted(best.values(), key=lambda r: (-r["contribution"], r["term"]))


REASONS = "array<struct<term:string,place:string,weight:double,idf:double,contribution:double>>"


def score(items: DataFrame, profile: list[tuple[str, float]], key: str = "norm_key") -> DataFrame:
    """key, arxiv_id, title, raw_score, score, n_concepts, weak, reasons of each item (key, arxiv_id, title, abstract).

    A term counts its weight times the worth of the better place it stands in times its rarity in the batch; phrases
    and their parts are one concept. The profile is a short list: its terms are one literal array, their counts in the
    batch as many rows; only items with a hit leave the JVM, for the concepts.
    """
    yard = sum(w for _, w in profile[:YARDSTICK]) * TITLE or 1.0
    plain = items.select(key, "arxiv_id", "title", t.norm_query(F.coalesce("title", F.lit(""))).alias("_t"), t.norm_query(F.coalesce("abstract", F.lit(""))).alias("_a"))
    plain = plain.select(key, "arxiv_id", "title", "_t", "_a", bounded(F.col("_t")).alias("_bt"), bounded(F.col("_a")).alias("_ba"))
    terms = F.array(*[F.struct(F.lit(w).alias("term"), F.lit(_bounded(w)).alias("mark"), F.lit(is_chinese(w)).alias("han"), F.lit(x).alias("weight")) for w, x in profile])
    stands = lambda x, text, marked: F.when(x["han"], F.contains(F.col(text), x["term"])).otherwise(F.contains(F.col(marked), x["mark"]))
    placed = F.transform(terms, lambda x: F.struct(x["term"].alias("term"), x["weight"].alias("weight"), F.when(stands(x, "_t", "_bt"), "title").when(stands(x, "_a", "_ba"), "abstract").alias("place")))
    base = plain.select(key, "arxiv_id", "title", F.filter(placed, lambda x: x["place"].isNotNull()).alias("hits")) if profile else plain.select(key, "arxiv_id", "title", F.expr("cast(array() as array<struct<term:string,weight:double,place:string>>)").alias("hits"))
    n = base.count()
    df = {r.term: r.n for r in base.select(F.explode("hits.term").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each term of the profile
    idf = {w: 1.0 if n < LEAST else math.log((n + 1) / (df.get(w, 0) + 1)) / math.log(n + 1) for w, _ in profile}
    rarity = F.create_map(*[F.lit(v) for pair in idf.items() for v in pair]) if idf else F.expr("cast(map() as map<string, double>)")

    def reason(x: Column) -> Column:
        i = F.element_at(rarity, x["term"])
        worth = F.when(x["place"] == "title", TITLE).otherwise(ABSTRACT)
        return F.struct(x["term"].alias("term"), x["place"].alias("place"), x["weight"].alias("weight"), i.alias("idf"), (x["weight"] * worth * i).alias("contribution"))

    found = base.select(key, "arxiv_id", "title", F.transform("hits", reason).alias("reasons"))

    def dedupe(r: dict):
        kept = concepts(r["reasons"])
        raw = sum(x["contribution"] for x in kept)
        return [(r[key], r["arxiv_id"], r["title"], raw, min(1.0, raw * (SINGLE if len(kept) == 1 else 1.0) / yard), len(kept), len(kept) == 1, kept)]

    kind = dict(items.dtypes)[key]
    schema = f"{key} {kind}, arxiv_id string, title string, raw_score double, score double, n_concepts int, weak boolean, reasons {REASONS}"
    hit = map_rows(found.where("size(reasons) > 0"), dedupe, schema)
    none = found.where("size(reasons) = 0").select(key, "arxiv_id", "title", F.lit(0.0).alias("raw_score"), F.lit(0.0).alias("score"), F.lit(0).alias("n_concepts"), F.lit(False).alias("weak"), "reasons")
    return hit.unionByName(none)


def candidates(fetched: DataFrame, library: DataFrame, digests: DataFrame, digest_id: int, days: int = 30) -> DataFrame:
    """Rows of fetched with a key that is neither in the library, nor dismissed, nor in a digest of the last `days` (one a day) before digest_id."""
    old = digests.where((F.col("dismissed") == 1) | F.col("digest_id").between(digest_id - days, digest_id - 1))
    known = library.select("norm_key").unionByName(old.select("norm_key")).where("norm_key is not null").distinct()
    return fetched.where("norm_key is not null").join(known, "norm_key", "left_anti")


def ranked(scored: DataFrame, k: int, key: str = "norm_key") -> DataFrame:
    """The k best with their rank; equals by arXiv id, else key, else title."""
    tie = F.coalesce(F.nullif("arxiv_id", F.lit("")), F.col(key).cast("string"), "title", F.lit(""))
    return top(scored.withColumn("tie", tie).withColumn("score", F.round("score", 6)), k, F.desc("score"), F.asc("tie"), F.asc(key)).drop("tie")


def category_scores(profile: DataFrame, lexicon: dict[str, list[str]], share: float = 0.25, most: int = 3) -> DataFrame:
    """category, score, rank: sums of the weights of terms that mention one of the category's phrases (a plural may follow); those of a share of the best, at most `most`.

    The lexicon is a parameter of a few rows.
    """
    def told(phrases: list[str]) -> Column:
        return F.col("term").rlike("(^|[^a-z0-9])(" + "|".join(phrases) + ")(e?s)?([^a-z0-9]|$)")

    each = F.filter(F.array(*[F.when(told(p), F.lit(c)) for c, p in lexicon.items()]), lambda c: c.isNotNull())
    sums = profile.select("weight", F.explode(each).alias("category")).groupBy("category").agg(F.round(F.sum("weight"), 9).alias("score"))
    best = sums.agg(F.max("score").alias("best"))
    return top(sums.crossJoin(F.broadcast(best)).where(F.col("score") >= share * F.col("best")).drop("best"), most, F.desc("score"), F.asc("category"))  # one row
