"""Citation graph: edges, neighbourhoods, co-citation, coupling, reading gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut


def edges(raw: DataFrame) -> DataFrame:
    """Distinct edges without self-loops and blank ends."""
    return raw.where("src_key is not null and dst_key is not null and src_key <> dst_key").select("src_key", "dst_key").distinct()


def neighbours(e: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """norm_key, hop of everything within `depth` steps of the seeds, whichever way edges point. seeds: norm_key.

    Each step joins the last frontier only and cuts the lineage; nodes are kept apart by an anti join.
    """
    both = e.select(F.col("src_key").alias("a"), F.col("dst_key").alias("b")).unionByName(e.select(F.col("dst_key").alias("a"), F.col("src_key").alias("b"))).distinct()
    seen = cut(seeds.select("norm_key").distinct().withColumn("hop", F.lit(0)))
    for hop in range(1, depth + 1):
        frontier = seen.where(F.col("hop") == hop - 1).select(F.col("norm_key").alias("a"))
        fresh = both.join(frontier, "a").select(F.col("b").alias("norm_key")).distinct().join(seen, "norm_key", "left_anti").withColumn("hop", F.lit(hop))
        seen = cut(seen.unionByName(fresh))
    return seen


def related(e: DataFrame, seeds: DataFrame) -> DataFrame:
    """norm_key, score, cocitation, coupling: half the Jaccard of common citers plus half that of common references, averaged over the seeds.

    seeds: norm_key. A seed's citers (references) meet their other references (citers) in one equi-join; hot targets
    are bounded by the seeds' own degrees, not by those of the whole graph.
    """
    s = seeds.select(F.col("norm_key").alias("seed")).distinct()
    n = s.agg(F.count(F.lit(1)).alias("n_seeds"))
    indeg = e.groupBy(F.col("dst_key").alias("norm_key")).agg(F.count(F.lit(1)).alias("deg"))
    outdeg = e.groupBy(F.col("src_key").alias("norm_key")).agg(F.count(F.lit(1)).alias("deg"))

    def side(mine: str, theirs: str, degree: DataFrame, name: str) -> DataFrame:
        own = e.join(s, F.col(mine) == F.col("seed")).select("seed", F.col(theirs).alias("via"))
        size = own.groupBy("seed").agg(F.count(F.lit(1)).alias("own"))
        inter = own.join(e.select(F.col(theirs).alias("via"), F.col(mine).alias("norm_key")), "via").groupBy("seed", "norm_key").agg(F.count(F.lit(1)).alias("i"))
        inter = inter.join(s.withColumnRenamed("seed", "norm_key"), "norm_key", "left_anti")
        j = F.col("i") / (F.col("own") + F.col("deg") - F.col("i"))
        return inter.join(size, "seed").join(degree, "norm_key").groupBy("norm_key").agg(F.sum("i").alias(name), F.sum(j).alias(f"{name}_j"))

    co = side("dst_key", "src_key", indeg, "cocitation")
    bc = side("src_key", "dst_key", outdeg, "coupling")
    joined = co.join(bc, "norm_key", "full").na.fill(0).crossJoin(F.broadcast(n))  # one row
    return joined.select("norm_key", ((0.5 * F.col("cocitation_j") + 0.5 * F.col("coupling_j")) / F.col("n_seeds")).alias("score"), "cocitation", "coupling").where("score > 0")


def gaps(e: DataFrame, papers: DataFrame) -> DataFrame:
    """norm_key, cited_by: works outside the library with the number of library works citing them."""
    keys = papers.where("norm_key is not null").select("norm_key").distinct()
    inside = e.join(keys.withColumnRenamed("norm_key", "src_key"), "src_key", "left_semi")
    outside = inside.join(keys.withColumnRenamed("norm_key", "dst_key"), "dst_key", "left_anti")
    return outside.groupBy(F.col("dst_key").alias("norm_key")).agg(F.count(F.lit(1)).alias("cited_by"))


#: Edges of a neighbour that one task pairs with all others of it.
VIA_BLOCK = 256


def co_counts(e: DataFrame, via: str, end: str, least: int = 2) -> DataFrame:
    """key_a, key_b, n: pairs that share at least `least` neighbours.

    A neighbour of d edges gives d(d-1)/2 pairs; that is the result's own size, and the pairs are counted before and
    after the shuffle. The edges of a neighbour with very many are spread over blocks, each of which meets all of them,
    so that no task has more than VIA_BLOCK times its edges.
    """
    pairs = e.select(F.col(via).alias("via"), F.col(end).alias("key"))
    sized = pairs.join(pairs.groupBy("via").agg(F.ceil(F.count(F.lit(1)) / VIA_BLOCK).alias("blocks")), "via")
    a = sized.select("via", F.col("key").alias("key_a"), F.pmod(F.xxhash64("key"), "blocks").alias("block"))
    b = sized.select("via", F.col("key").alias("key_b"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"))
    return a.join(b, ["via", "block"]).where("key_a < key_b").groupBy("key_a", "key_b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def touching(e: DataFrame, keys: DataFrame) -> DataFrame:
    """Distinct edges with at least one end among the keys (norm_key)."""
    k = keys.select("norm_key").distinct()
    left = e.join(k.withColumnRenamed("norm_key", "src_key"), "src_key", "left_semi").select("src_key", "dst_key")
    return left.unionByName(e.join(k.withColumnRenamed("norm_key", "dst_key"), "dst_key", "left_semi").select("src_key", "dst_key")).distinct()


def metadata(keys: DataFrame, papers: DataFrame, nodes: DataFrame) -> DataFrame:
    """norm_key, title, year, citations, in_library of each key: from the library's first import, else from the newest cached node, else nothing but the key."""
    k = keys.select("norm_key").distinct()
    own = papers.where("norm_key is not null").groupBy("norm_key").agg(F.min_by(F.struct("title", "year", "citation_count"), "id").alias("p"))
    newest = F.struct("updated_at", "title", "year", "citation_count")
    other = nodes.where("norm_key is not null").groupBy("norm_key").agg(F.max_by(F.struct("title", "year", "citation_count"), newest).alias("n"))
    both = k.join(own, "norm_key", "left").join(other, "norm_key", "left")
    pick = lambda c: F.when(F.col("p").isNotNull(), F.col(f"p.{c}")).otherwise(F.col(f"n.{c}"))
    return both.select("norm_key", pick("title").alias("title"), pick("year").alias("year"), F.coalesce(pick("citation_count"), F.lit(0)).alias("citations"), F.col("p").isNotNull().alias("in_library"))


def bounded_neighbours(e: DataFrame, seed: str, papers: DataFrame, nodes: DataFrame, depth: int = 1, limit: int = 50) -> tuple[DataFrame, DataFrame, bool]:
    """(norm_key, hop, title, year, citations, in_library), edges between them, truncated: at most `limit` nodes around one seed.

    Every hop keeps the library's works first, then the most cited, then by key, as far as there is room; it is told
    whether any were left out. Only the frontier is joined; no more than `limit` keys ever leave a hop.
    """
    spark = e.sparkSession
    seen = spark.createDataFrame([(seed, 0)], "norm_key string, hop int")
    count, truncated = 1, False
    for hop in range(1, depth + 1):
        frontier = seen.where(F.col("hop") == hop - 1)
        t = touching(e, frontier)
        fresh = t.select(F.explode(F.array("src_key", "dst_key")).alias("norm_key")).distinct().join(F.broadcast(seen), "norm_key", "left_anti")  # at most `limit` keys seen
        room = limit - count
        rows = metadata(fresh, papers, nodes).orderBy(F.desc("in_library"), F.desc("citations"), F.asc("norm_key")).limit(room + 1).select("norm_key").collect()  # one more than there is room
        truncated |= len(rows) > room
        rows = rows[: max(room, 0)]
        if not rows:
            break
        count += len(rows)
        seen = seen.unionByName(spark.createDataFrame([(r.norm_key, hop) for r in rows], "norm_key string, hop int"))
    keys = F.broadcast(seen.select("norm_key"))  # at most `limit` rows
    inner = e.join(keys.withColumnRenamed("norm_key", "src_key"), "src_key", "left_semi").join(keys.withColumnRenamed("norm_key", "dst_key"), "dst_key", "left_semi").select("src_key", "dst_key").distinct()
    return seen.join(metadata(seen, papers, nodes), "norm_key"), inner, truncated


def gaps_with_titles(e: DataFrame, papers: DataFrame, nodes: DataFrame, k: int = 20, titles: int = 5) -> DataFrame:
    """norm_key, cited_by, title, citing, rank: the k works outside the library that most of it cites, with the first titles that do, by paper id."""
    best = gaps(e, papers).orderBy(F.desc("cited_by"), F.asc("norm_key")).limit(k)
    own = papers.where("norm_key is not null").groupBy(F.col("norm_key").alias("src_key")).agg(F.min(F.struct("id", "title")).alias("p"))
    cites = e.join(F.broadcast(best.select(F.col("norm_key").alias("dst_key"))), "dst_key").join(own, "src_key")  # k rows
    from .lexical import top, top_per

    first = top_per(cites.select("dst_key", "p.id", "p.title"), ["dst_key"], titles, F.asc("id")).groupBy(F.col("dst_key").alias("norm_key")).agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "title"))), lambda x: x["title"]).alias("citing"))  # `titles` a key
    named = best.join(metadata(best, papers, nodes).select("norm_key", "title"), "norm_key").join(first, "norm_key", "left")
    return top(named, k, F.desc("cited_by"), F.asc("norm_key"))


def source_id(s2: str = "s2_id", doi: str = "doi", arxiv: str = "arxiv_id") -> "F.Column":
    """How an outside service is asked for a work: its own id, else DOI, else arXiv id."""
    from ..functions.text import bare_doi

    some = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    return F.coalesce(some(s2), F.concat(F.lit("DOI:"), bare_doi(doi)), F.concat(F.lit("ARXIV:"), some(arxiv)))
