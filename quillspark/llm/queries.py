"""Queries of the training-data problems over the workbench's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import cut, spread
from ..sources.tables import table
from . import distinct, leakage, name_link, ocr_repair, packing, reading, splitting, unify

Query = Callable[[SparkSession, str], DataFrame]


def p1_repair(spark: SparkSession, sf: str) -> DataFrame:
    return ocr_repair.repair_scans(table(spark, sf, "section_nodes"))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return ocr_repair.damage(ocr_repair.repair_pages(table(spark, sf, "section_nodes")))


def p2_entities(spark: SparkSession, sf: str) -> DataFrame:
    return name_link.link_names(name_link.spellings(table(spark, sf, "papers"), table(spark, sf, "citation_nodes"), table(spark, sf, "digest_items")))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return name_link.pairs(cut(p2_entities(spark, sf)))


def p3_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.split_oversized(table(spark, sf, "section_nodes"), table(spark, sf, "size_profiles"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.oversized(p3_pieces(spark, sf))


def p4_canonical(spark: SparkSession, sf: str) -> DataFrame:
    titles = unify.unify(table(spark, sf, "papers"), ["id"], "title").withColumn("tab", F.lit("papers.title"))
    bodies = unify.unify(table(spark, sf, "section_nodes"), ["id"], "body").withColumn("tab", F.lit("section_nodes.body"))
    return titles.unionByName(bodies).select("tab", "id", "canonical", "changed")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return p4_canonical(spark, sf).where("changed").select("tab", "id")


def _graphs(spark: SparkSession, sf: str) -> DataFrame:
    return distinct.record_graphs(table(spark, sf, "section_terms"), table(spark, sf, "section_nodes"))


def p5_weights(spark: SparkSession, sf: str) -> DataFrame:
    return distinct.term_weights(_graphs(spark, sf))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return distinct.most_characteristic(_graphs(spark, sf))


def _packed(spark: SparkSession, sf: str, profile: str) -> tuple[DataFrame, int]:
    capacity = table(spark, sf, "size_profiles").where(F.col("profile") == profile).select("capacity").first()[0]
    sized = cut(packing.token_counts(table(spark, sf, "documents"), packing.default_tokenizer()))
    return packing.pack(sized, int(capacity), profile), int(capacity)


def p6_pack(spark: SparkSession, sf: str) -> DataFrame:
    return _packed(spark, sf, "pack_mid")[0]


def p6_pack_small(spark: SparkSession, sf: str) -> DataFrame:
    return _packed(spark, sf, "pack_small")[0]


def p6_pack_long(spark: SparkSession, sf: str) -> DataFrame:
    return _packed(spark, sf, "pack_long")[0]


def p6_fill(spark: SparkSession, sf: str) -> DataFrame:
    return packing.fill(*_packed(spark, sf, "pack_mid"))


def p7_leaks(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.find_leaks(spread(table(spark, sf, "documents")), table(spark, sf, "eval_items"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return p7_leaks(spark, sf).select("doc_id", "item_id").distinct()


def p7_spans(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.removal_spans(p7_leaks(spark, sf))


def p8_levels(spark: SparkSession, sf: str) -> DataFrame:
    return reading.reading_levels(table(spark, sf, "documents"), table(spark, sf, "reading_labels"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return p8_levels(spark, sf).select("doc_id", "level").distinct()


# --- what must hold of every result, whatever the data: each of these has its SQL -------------------------------------


def p1_covered(spark: SparkSession, sf: str) -> DataFrame:
    """Every stored row comes out once."""
    return p1_repair(spark, sf).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


def p2_covered(spark: SparkSession, sf: str) -> DataFrame:
    """Every spelling belongs to one entity."""
    return p2_entities(spark, sf).groupBy("name").agg(F.count_distinct("entity").alias("entities"))


def p3_whole(spark: SparkSession, sf: str) -> DataFrame:
    """The pieces of a text are within the capacity, overlap as the profile says and give the whole text back."""
    w = Window.partitionBy("id", "profile").orderBy("piece_no")
    p = p3_pieces(spark, sf).join(F.broadcast(table(spark, sf, "size_profiles").select("profile", "capacity", "overlap")), "profile")  # a table of five rows
    last = F.lag("end_pos").over(w)
    fits = (F.col("end_pos") - F.col("begin_pos") <= F.col("capacity")) & (F.length("piece") == F.col("end_pos") - F.col("begin_pos"))
    joins = F.when(last.isNull(), F.col("begin_pos") == 0).otherwise(F.col("begin_pos") == last - F.coalesce("overlap", F.lit(0)))
    return p.withColumn("ok", fits & joins).groupBy("id", "profile").agg(F.max("end_pos").alias("n_chars"), F.bool_and("ok").alias("whole"))


def p5_covered(spark: SparkSession, sf: str) -> DataFrame:
    """Every term of every record has one finite weight."""
    w = p5_weights(spark, sf).groupBy("paper_id", "node_id", F.lower("term").alias("term"))
    return w.agg(F.count(F.lit(1)).alias("weights"), F.bool_and(F.col("weight").isNotNull() & ~F.isnan("weight") & (F.col("weight") >= 0)).alias("finite"))


def p6_placed(spark: SparkSession, sf: str) -> DataFrame:
    """Every text is in the containers as a whole, only those over the capacity in pieces, and no container is too full."""
    packed, capacity = _packed(spark, sf, "pack_mid")
    packed = cut(packed)
    full = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("used")).where(F.col("used") > capacity).select("container_id").withColumn("over", F.lit(True))
    each = packed.join(full, "container_id", "left").groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("pieces"), F.max(F.col("begin_token") + F.col("n_tokens")).alias("reach"), F.bool_and("over").alias("over"))
    whole = (F.col("n") == F.col("reach")) & F.col("over").isNull() & ((F.col("pieces") == 1) | (F.col("n") > capacity)) & (F.col("pieces") == F.greatest(F.ceil(F.col("n") / capacity), F.lit(1)))
    return each.select("doc_id", whole.alias("whole"))


def p7_disjoint(spark: SparkSession, sf: str) -> DataFrame:
    """Spans of a document neither touch nor leave its text: none is listed here."""
    w = Window.partitionBy("doc_id").orderBy("begin_pos")
    s = p7_spans(spark, sf).join(table(spark, sf, "documents").select("doc_id", F.length("text").alias("n")), "doc_id")
    return s.withColumn("last", F.lag("end_pos").over(w)).where("begin_pos < 0 or end_pos > n or begin_pos >= end_pos or begin_pos <= last").select("doc_id", "begin_pos")


def p8_covered(spark: SparkSession, sf: str) -> DataFrame:
    """Every text of 300 or more code points has one level from 1 to 4."""
    return p8_levels(spark, sf).groupBy("doc_id").agg(F.bool_and(F.col("level").between(1, 4)).alias("levelled"))


def queries() -> dict[str, Query]:
    own = [p1_found, p1_repair, p2_found, p2_entities, p3_found, p3_pieces, p4_found, p4_canonical, p5_found, p5_weights, p6_pack, p6_pack_small, p6_pack_long, p6_fill, p7_found, p7_leaks, p7_spans, p8_found, p8_levels]
    held = [p1_covered, p2_covered, p3_whole, p5_covered, p6_placed, p7_disjoint, p8_covered]
    return {f.__name__: f for f in own + held}


#: Odd characters as DuckDB's regular expressions write them: invisible ones, blanks, wide forms, ligatures, radicals.
_ODD = (
    r"[\x{00AD}\x{034F}\x{180E}\x{200B}\x{200C}\x{200E}\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{2069}\x{FEFF}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}\x{2028}\x{2029}"
    r"\x{FF10}-\x{FF19}\x{FF21}-\x{FF3A}\x{FF41}-\x{FF5A}\x{FF61}-\x{FF9F}\x{FB00}-\x{FB06}\x{2E80}-\x{2FD5}\x{F900}-\x{FAFF}\x{1D400}-\x{1D7FF}\x{2126}\x{212A}\x{212B}\x{2160}-\x{217F}]"
)


def _odd(c: str) -> str:
    joiner = f"regexp_matches(regexp_replace({c}, '(\\p{{So}}\\x{{FE0F}}?)\\x{{200D}}(\\p{{So}})', '\\1\\2', 'g'), '\\x{{200D}}')"
    marks = f"(regexp_matches({c}, '[\\x{{FF01}}-\\x{{FF0F}}\\x{{FF1A}}-\\x{{FF20}}\\x{{FF3B}}-\\x{{FF40}}\\x{{FF5B}}-\\x{{FF5E}}]') AND NOT regexp_matches({c}, '[\\p{{Han}}\\p{{Hiragana}}\\p{{Katakana}}\\p{{Hangul}}]'))"
    mixed = f"regexp_matches({c}, '\\p{{Latin}}[\\p{{Cyrillic}}\\p{{Greek}}]|[\\p{{Cyrillic}}\\p{{Greek}}]\\p{{Latin}}')"
    return f"(regexp_matches({c}, '{_ODD}') OR {joiner} OR {marks} OR {mixed} OR nfc_normalize({c}) <> {c})"


_NAMES = "SELECT unnest(authors) AS name FROM papers UNION SELECT CASE WHEN json_type(x) = 'OBJECT' THEN json_extract_string(x, '$.name') ELSE json_extract_string(x, '$') END FROM (SELECT unnest(CAST(authors_json AS JSON[])) AS x FROM {0} WHERE json_valid(authors_json)) UNION SELECT CASE WHEN json_type(x) = 'OBJECT' THEN json_extract_string(x, '$.name') ELSE json_extract_string(x, '$') END FROM (SELECT unnest(CAST(authors_json AS JSON[])) AS x FROM {1} WHERE json_valid(authors_json))"


def oracle_sql() -> dict[str, str]:
    return {
        "p1_covered": "SELECT id, count(*) AS n FROM section_nodes GROUP BY id",
        "p2_covered": f"SELECT name, 1 AS entities FROM ({_NAMES.format('citation_nodes', 'digest_items')}) WHERE length(trim(name)) > 0",
        "p3_whole": "SELECT s.id, p.profile, length(s.body) AS n_chars, true AS whole FROM section_nodes s, size_profiles p WHERE p.unit = 'chars' AND length(s.body) > 0",
        "p5_covered": "SELECT DISTINCT paper_id, node_id, lower(term) AS term, 1 AS weights, true AS finite FROM section_terms WHERE paper_id IS NOT NULL AND node_id IS NOT NULL AND length(trim(term)) > 0",
        "p6_placed": "SELECT doc_id, true AS whole FROM documents",
        "p7_disjoint": "SELECT doc_id, 0 AS begin_pos FROM documents WHERE false",
        "p8_covered": "SELECT doc_id, true AS levelled FROM documents WHERE length(text) >= 300",
        "p3_found": "SELECT s.id, p.profile FROM section_nodes s JOIN size_profiles p ON p.unit = 'chars' AND length(s.body) > p.capacity",
        "p4_found": f"SELECT 'papers.title' AS tab, id FROM papers WHERE {_odd('title')} UNION ALL SELECT 'section_nodes.body', id FROM section_nodes WHERE {_odd('body')}",
    }
