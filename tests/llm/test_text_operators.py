"""Scan repair, splitting, unifying: small cases, edge cases, brute force."""

import random
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import coded, ocr_repair, splitting, unify

NODES = "id bigint, paper_id bigint, node_id string, title string, body string, extra string"


def nodes(spark, bodies, title="Method"):
    return spark.createDataFrame([(i, 7, f"P7/S{i}", title, b, "x") for i, b in enumerate(bodies, 1)], NODES)


# --- problem 1 ---

CLEAN = "The lexical baseline improves the retrieval index. Each passage ranker predicts the answer span. The context window controls the chunk boundary."


def test_repair_joins_corrects_and_drops_furniture(spark):
    header = "Page {0}    Trans. Invented Syst.\n"
    page = "The lexical base-\nline improves the retr1eval index.\n" + header.format(3) + "Each passage ranker predlcts the answer span.\n" + header.format(4) + "The context win-\n\n" + header.format(5) + "\ndow controls the chunk boundary."
    df = nodes(spark, [CLEAN] * 1 + [CLEAN + f" Part {k}." for k in range(60)] + [page, *[f"Another run {k} improves the\n" + header.format(k) + "retrieval index." for k in (8, 9)]])
    rows = {r.id: r for r in ocr_repair.repair_scans(df).collect()}
    assert len(rows) == 64
    fixed = rows[62]
    assert (fixed.furniture, fixed.hyphenation, fixed.misread) == (3, 2, 2)
    assert fixed.repaired == CLEAN
    assert all(rows[k].furniture == rows[k].hyphenation == rows[k].misread == 0 for k in range(1, 62))
    assert {(r.id, r.damage) for r in ocr_repair.damage(ocr_repair.repair_scans(df)).collect() if r.id == 62} == {(62, "hyphenation"), (62, "misread"), (62, "furniture")}


def test_line_breaks_and_compounds_are_no_damage(spark):
    text = "The near-\nfield response improves the near-field response.\nThe response of the field is near."
    rows = ocr_repair.repair_scans(nodes(spark, [text, "near field response. near-field"])).collect()
    assert all(r.hyphenation == 0 and r.misread == 0 and r.furniture == 0 for r in rows)
    assert "near-field response improves" in next(r.repaired for r in rows if r.id == 1)


def test_repair_edge_cases(spark):
    df = nodes(spark, [None, "", "   ", "x" * 30000, "a-\n", "- 5 -"]).unionByName(nodes(spark, ["a-\n"]).withColumn("id", F.lit(5)))
    rows = ocr_repair.repair_scans(df).collect()
    assert len(rows) == 7
    by = {r.id: r for r in rows}
    assert by[1].repaired is None and by[2].repaired == ""
    assert ocr_repair.repair_scans(df.where("false")).count() == 0
    assert ocr_repair.damage(ocr_repair.repair_scans(df.where("id = 1"))).count() == 0


def test_viterbi_prefers_corpus_words():
    suspects = {"1eaf": [("1eaf", 0.0, 1), ("leaf", -4.0, 90)]}
    assert ocr_repair.viterbi(["the", "1eaf", "index"], suspects, Counter(["1eaf"]), {("the", "leaf"): 40, ("leaf", "index"): 50}) == ["the", "leaf", "index"]
    # a name that the section repeats is left alone
    suspects = {"bru3": [("bru3", 0.0, 3), ("brue", -4.0, 2)]}
    assert ocr_repair.viterbi(["bru3"], suspects, Counter(["bru3"] * 9), {}) == ["bru3"]


# --- problem 3 ---


def brute_strongest(s, low, high):
    return max((s[k], k) for k in range(low, high + 1))


def test_range_maximum_against_brute_force():
    rng = random.Random(5)
    import numpy as np

    for _ in range(30):
        values = np.array([rng.randrange(-1, 6) for _ in range(rng.randrange(1, 200))], np.int8)
        index = splitting.RangeMax(values, len(values))
        for _ in range(50):
            low = rng.randrange(len(values))
            high = rng.randrange(low, len(values))
            v, k = brute_strongest(values.tolist(), low, high)
            assert index.query(low, high) == (k, v)


@pytest.mark.parametrize("capacity,overlap", [(40, 0), (40, 7), (7, 6), (1, 0)])
def test_pieces_cover_the_text(capacity, overlap):
    rng = random.Random(capacity)
    for _ in range(60):
        text = "".join(rng.choice(["word ", "a", ". ", "Big", "\n\n", "长句。", "é", "́", "\n", "x" * 9]) for _ in range(rng.randrange(0, 60)))
        found = splitting.pieces(text, capacity, overlap)
        assert all(0 < e - b <= capacity for b, e, _ in found)
        assert all(y[0] == x[1] - overlap for x, y in zip(found, found[1:]))
        assert "".join(text[b + (overlap if k else 0) : e] for k, (b, e, _) in enumerate(found)) == text


def test_pieces_end_at_natural_boundaries():
    text = ("Alpha beta gamma. " * 10).strip() + "\n\n" + "delta " * 40
    (b, e, s), *_ = splitting.pieces(text, 200)
    assert text[:e].endswith("\n\n") and s == splitting.PARAGRAPH
    first, second, *_ = splitting.pieces("one two three four five six", 12)
    assert "one two three four five six"[: first[1]] == "one two "
    assert splitting.pieces("x" * 25, 10) == [(0, 10, 0), (10, 20, 0), (20, 25, 6)]
    with pytest.raises(ValueError):
        splitting.pieces("abc", 5, 5)


def test_split_table_edge_cases(spark):
    profiles = spark.createDataFrame([("a", "chars", 10, 2), ("b", "tokens", 5, 0), ("c", "chars", 100, 0), ("d", "chars", None, 0)], "profile string, unit string, capacity bigint, overlap bigint")
    df = spark.createDataFrame([(1, "one two three four", "p"), (1, "one two three four", "p"), (2, "", "p"), (3, None, "p"), (None, "short", "p")], "id bigint, body string, profile string")
    out = splitting.split_oversized(df, profiles)
    assert {(r.id, r.profile) for r in splitting.oversized(out).collect()} == {(1, "a")}
    assert splitting.oversized(out).count() == 2
    assert out.where("id is null").count() == 2
    assert splitting.split_oversized(df.where("false"), profiles).count() == 0
    assert splitting.split_oversized(df, profiles.where("false")).count() == 0


def test_p3_found_matches_lengths(spark, sf):
    from quillspark.llm import queries

    got = {tuple(r) for r in queries.p3_found(spark, sf).collect()}
    want = {(r.id, p) for r in spark.read.parquet(f"{sf}/section_nodes.parquet").collect() for p, c in (("storage", 4000), ("index", 2000)) if r.body and len(r.body) > c}
    assert got == want


# --- problem 4 ---


@pytest.mark.parametrize(
    "odd,plain",
    [
        ("ｗｉｄｅ １２", "wide 12"), ("résumé", "résumé"), ("zero​width⁠", "zerowidth"), ("no break　wide", "no break wide"), ("Сalemo", "Calemo"), ("ﬁne ﬂow", "fine flow"),
        ("上下文窗⼝", "上下文窗口"), ("soft­hyphen", "softhyphen"), ("Νovelа", "Novela"),
    ],
)
def test_ordinary_maps(odd, plain):
    assert unify.ordinary(odd) == plain
    assert unify.ordinary(plain) == plain


@pytest.mark.parametrize("same", ["数据，模型：对（图）。", "R² – é ü ß “x” 🧪", "α-weighted Ω(n) λ", "Теория, часть 2 (обзор)", "👩‍🔬 lab", "", "plain\nlines"])
def test_ordinary_keeps_proper_characters(same):
    assert unify.ordinary(same) == same


def test_unify_classes(spark):
    df = spark.createDataFrame([(1, "Wide"), (2, "Ｗide"), (3, "W​ide"), (4, "wide"), (5, None), (6, ""), (6, ""), (7, "Wi\u0001de"), (8, "Wïde")], "id bigint, title string").selectExpr("*", "'z' as canonical", "1 as changed")
    rows = unify.unify(df, ["id"], "title").collect()
    assert len(rows) == 9
    by = {r.id: r for r in rows}
    assert by[2].canonical == by[1].canonical == by[3].canonical and by[4].canonical == "wide" and by[8].canonical == "Wïde"
    assert by[5].canonical is None and not by[5].changed and by[6].canonical == ""
    assert by[7].canonical == by[1].canonical  # a control character cannot be seen
    assert not by[4].changed and by[2].changed and by[3].changed
    assert unify.unify(df.where("false"), ["id"], "title").count() == 0


def test_collation_decides_the_class(spark):
    """Values that only the collation takes for equal fall into one class; look-alikes come from the confusables data."""
    table = unify.twins(spark)
    assert table["а"] == "a" and table["Ꭰ"] == "D" and "γ" not in table
    rows = ["café pl​an", "café plan", "café⁠ plan", "cafe plan", "Ꭰata рaper", "γx", None, ""]
    df = spark.createDataFrame(list(enumerate(rows)), "id int, t string")
    out = {r.id: (r.canonical, r.changed) for r in unify.unify(df, ["id"], "t").collect()}
    assert out[0] == ("café plan", True) and out[1] == ("café plan", False) and out[2] == ("café plan", True)
    assert out[3] == ("cafe plan", False) and out[4] == ("Data paper", True) and out[5] == ("γx", False)
    assert out[6] == (None, False) and out[7] == ("", False)


def test_missing_look_alikes_are_an_error():
    """Where the confusables data cannot be had, or has not a shape for each letter, there is no result."""
    builder = lambda skeleton: lambda: SimpleNamespace(build=lambda: SimpleNamespace(getSkeleton=skeleton))
    session = lambda text: SimpleNamespace(_jvm=SimpleNamespace(com=SimpleNamespace(ibm=SimpleNamespace(icu=SimpleNamespace(text=text)))))

    def fails(text):
        raise OSError("connection lost")

    for text in (SimpleNamespace(), *(SimpleNamespace(**{"SpoofChecker$Builder": builder(f)}) for f in (fails, lambda text: text[: len(text) // 2]))):
        with pytest.raises(RuntimeError, match="no look-alikes"):
            unify.twins(session(text))
    with pytest.raises(RuntimeError, match="no look-alikes"):
        unify.twins(SimpleNamespace())


def test_repair_keeps_every_row_once(spark):
    body = "The lexical base-\nline improves the index."
    df = nodes(spark, [body, body, body]).withColumn("title", F.expr("case id when 1 then null when 2 then '' else 'x' end")).withColumn("id", F.expr("least(id, 2)"))
    assert sorted(r.id for r in ocr_repair.repair_scans(df).collect()) == [1, 2, 2]


def test_numbers_of_words():
    """Words have the same number in every text, and each string given has one."""
    text = ["The Façade 中文 of b2b, x-ray", "", "of THE"]
    c = coded.code(text)
    words = [c.text[i:j] for i, j in zip(c.begin, c.end)]
    assert words == [m.group() for t in text for m in coded.WORD.finditer(t.lower())]
    assert (coded.numbers_of(words) == c.number).all() and len(set(c.number.tolist())) == len(set(words))
    assert len(coded.numbers_of(["abc中", "a b", "", "x"])) == 4 and len(coded.numbers_of([])) == 0


def brute_forms(word):
    """Every form by writing it out."""
    if len(word) == 1:
        return {ocr_repair.HAN_CONFUSIONS[word]} if word in ocr_repair.HAN_CONFUSIONS else set()
    if word.isdigit() or not any(c.isalpha() for c in word):
        return set()
    bases = [word] + [word.translate(str.maketrans("0589126", f"osbg{one}zb")) for one in "li" if set(word) & set("0589126")]
    out = set(bases)
    for w in bases:
        for a, b, _ in ocr_repair.CONFUSIONS:
            out |= {w[:i] + b + w[i + len(a) :] for i in range(len(w)) if w.startswith(a, i)}
    return out - {word}


def test_printed_forms_against_brute_force():
    words = ["rnodule", "c1ear", "5tate", "tbe", "rn", "旳", "12345", "x", "naïvc", "m" * 50, "abc中l"]
    every = np.full(coded.BLOCKS, 2**64 - 1, np.uint64)
    got = ocr_repair.printed_forms(words, every)
    assert {(k, w) for k, w, _ in got} == {(k, w) for k, x in enumerate(words) for w in brute_forms(x)}
    known = ["module", "clear", "state", "the", "in"]
    bits = np.zeros(coded.BLOCKS, np.uint64)
    for n in (coded.numbers_of(known) & ~1).view(np.uint64).tolist():
        bits[n >> (64 - coded.BLOCKS.bit_length() + 1)] |= np.uint64(1) << np.uint64(n & 63)
    some = {(k, w) for k, w, r in ocr_repair.printed_forms(words, bits) if len(r) == 1}
    assert {(0, "module"), (1, "clear"), (2, "state")} <= some and len(ocr_repair.printed_forms(["m" * 5000 + "c"], bits)) == 0
