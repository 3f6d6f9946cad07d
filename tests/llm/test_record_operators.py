"""Names, term weights, packing, leaks, reading levels."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import distinct, leakage, name_link, packing, reading

# --- problem 2 ---


def distance(a, b):
    d = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton_against_brute_force(spark):
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(3, 9))) for _ in range(120)} | {"ab" * 4 + "".join(rng.choice("ab") for _ in range(rng.randrange(1, 6))) for _ in range(60)})
    trie = name_link.build_trie(words)
    for w in words[:60]:
        assert sorted(name_link.automaton_search(trie, w)) == [u for u in words if distance(w, u) <= 1]
    got = {tuple(r) for r in name_link.near_words(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    assert got == {(a, b) for a in words for b in words if a != b and distance(a, b) <= 1}


def link(spark, rows):
    out = {r.name: r.entity for r in name_link.link_names(spark.createDataFrame(rows, "name string, work string").withColumn("entity", F.lit("clash"))).collect()}
    return out


def test_variants_are_linked_and_others_are_not(spark):
    full = [("Ingrid P. Bremalics", f"w{k}") for k in range(6)] + [("Mikhail Tekuvan", f"w{k}") for k in range(4)] + [("Marla Baurukaro", "m1"), ("Maria Baurukaro", "m2")] + [(f"Marla {x}", "m1") for x in ("Zonomou", "Welikek", "Falbashek")] + [(f"Maria {x}", "m2") for x in ("Thempamini", "Voskekash", "Raltavard")]
    same = ["Brémalics, Ingrid P.", "Bremalics Ingrid", "I. Bremalics", "Bremalics, I.P.", "INGRID P. BREMALICS", "Dr. Ingrid Bremalics", "Ingrid P. Bremalics¹", "Ingrid Bremalcis ", "Ing. Bremalics"]
    rows = full + [(n, "w1") for n in same] + [("Tekuvan, Misha", "w2"), ("Misha Tekuvan", "w2")]
    orgs = ["Cisinema Laboratory for Computational Physics", "Cisinema Computational Physics Laboratory", "The Cisinema Laboratory of Computational Physics", "Cisinema Lab. Computational Physics", "CLCP"]
    rows += [(o, "w3") for o in orgs] + [("Cisinema Academy for Computational Physics", "w4")]
    e = link(spark, rows)
    assert {e[n] for n in same} == {e["Ingrid P. Bremalics"]}
    assert e["Tekuvan, Misha"] == e["Misha Tekuvan"] == e["Mikhail Tekuvan"] != e["Ingrid P. Bremalics"]
    assert e["Marla Baurukaro"] != e["Maria Baurukaro"]
    assert len({e[o] for o in orgs}) == 1 and e["Cisinema Academy for Computational Physics"] != e[orgs[0]]
    assert len(e) == len({n for n, _ in rows})


def test_short_and_joined_words_meet(spark):
    words = ["li", "lii", "il", "la", "mi", "wu", "wuu", "yu", "yua", "jean-paul", "jeanpaul", "von berg", "vonberg", "a", "ab", "b"]
    got = {tuple(r) for r in name_link.near_words(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    assert got == {(a, b) for a in words for b in words if a != b and distance(a, b) <= 1 and max(len(a), len(b)) > 1}


def test_chains_of_spellings_and_two_word_organisations(spark):
    chain = ["abcdefgh", "abcdefgi", "abcdefji", "abcdeoji", "abcdpoji", "abcqpoji", "abrqpoji"]
    e = link(spark, [(f"Anna {w.title()}", f"w{k}") for k, w in enumerate(chain) for _ in range(1)] + [(f"Anna {w.title()}", f"x{k}{j}") for k, w in enumerate(chain) for j in range(k)])
    assert len(set(e.values())) == 1
    e = link(spark, [("University of Oxford", "a"), ("Oxford University", "b"), ("Mary Oxford", "a")])
    assert e["University of Oxford"] == e["Oxford University"] != e["Mary Oxford"]


def test_names_edge_cases(spark):
    e = link(spark, [(None, "a"), ("", "a"), ("  ", "a"), ("Mono", None), ("Mono", None), ("王小明", "a"), ("*", "b"), ("A. B.", "b")])
    assert set(e) == {"Mono", "王小明", "*", "A. B."}
    assert link(spark, [("x", "y")][:0]) == {}
    p = spark.createDataFrame([(["Ann Lee", None], "k"), (None, "k")], "authors array<string>, norm_key string")
    c = spark.createDataFrame([('[{"name": "Ann Lee"}, {"name": null}]', "k"), ("broken", "k"), (None, None), ('["Bo Li"]', None)], "authors_json string, norm_key string")
    assert {r.name for r in name_link.spellings(p, c, c).collect()} == {"Ann Lee", "Bo Li"}


# --- problem 5 ---


def test_degrees_against_brute_force():
    rng = random.Random(2)
    words = [rng.choice("abcdefgh") * 2 for _ in range(80)]
    near = defaultdict(set)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            if a != b and abs(i - j) < 4:
                near[a].add(b)
    want = {k: len(v) for k, v in near.items()}
    assert distinct.degrees([words, [], ["aa"], words[::-1]], 4) == [want, {}, {"aa": 0}, want]
    assert distinct.degrees([[], []], 4) == [{}, {}]


def test_term_weights_and_pruning_agree(spark):
    rng = random.Random(3)
    common = [f"word{k}" for k in range(12)]
    nodes, terms = [], []
    for n in range(30):
        body = [rng.choice(common) for _ in range(60)] + [f"Name{n}"] * 6
        rng.shuffle(body)
        nodes.append((1 if n % 3 else 2, f"P/S{n}", "Title", " ".join(body), "x"))
        terms += [(1 if n % 3 else 2, f"P/S{n}", t.lower() if n % 2 else t, None if n == 4 else c) for t, c in Counter(body).items()]
    t = spark.createDataFrame(terms + terms[:9] + [(1, "P/S1", None, 3), (1, "P/S1", " ", 3), (None, "P/S1", "x", 1)], "paper_id bigint, node_id string, term string, tf int")
    n = spark.createDataFrame(nodes + nodes[:2], "paper_id bigint, node_id string, title string, body string, term string")
    records = distinct.record_graphs(t, n)
    best = {(r.paper_id, r.node_id): r.term for r in distinct.most_characteristic(records).collect()}
    assert len(best) == 30 and all(v.lower() == f"name{k[1].split('S')[1]}" for k, v in best.items())
    weights = distinct.term_weights(records).collect()
    assert len(weights) == len({(r.paper_id, r.node_id, r.term.lower()) for r in weights})
    top = {}
    for r in weights:
        k = (r.paper_id, r.node_id)
        top[k] = max(top.get(k, (-1.0, "")), (r.weight, r.term))
    assert {k: v[1] for k, v in top.items()} == best
    none = distinct.record_graphs(t.where("false"), n)
    assert distinct.most_characteristic(none).count() == 0 and distinct.term_weights(none).count() == 0
    assert distinct.most_characteristic(distinct.record_graphs(t, n.where("false"))).count() == 30


# --- problem 6 ---


def test_packing_places_everything_once():
    rng = random.Random(4)
    for capacity in (1, 7, 64, 512):
        hist = Counter(rng.randrange(1, capacity + 1) for _ in range(700))
        patterns = packing.pack_histogram(dict(hist), capacity)
        placed = Counter()
        for count, items in patterns:
            assert sum(length * each for length, each in items) <= capacity
            for length, each in items:
                placed[length] += each * count
        assert placed == hist
        assert len(patterns) <= 2 * capacity + len(hist)


def test_packing_table(spark):
    rng = random.Random(6)
    sizes = [rng.randrange(1, 130) for _ in range(400)] + [350] * 40 + [0, 0, 1000]
    df = spark.createDataFrame([(i, n, "c") for i, n in enumerate(sizes)] + [(7, sizes[7], "c")], "doc_id bigint, n_tokens bigint, container_id string")
    out = packing.pack(df, 100, "t").collect()
    fill = defaultdict(int)
    by_doc = defaultdict(list)
    for r in out:
        fill[r.container_id] += r.n_tokens
        by_doc[r.doc_id].append((r.begin_token, r.n_tokens, r.piece_no))
    assert max(fill.values()) <= 100 and set(by_doc) == set(range(len(sizes)))
    for i, n in enumerate(sizes):
        pieces = sorted(by_doc[i])
        if i == 7:
            assert sum(p[1] for p in pieces) == 2 * n
            continue
        assert sum(p[1] for p in pieces) == n and (len(pieces) == 1 or n > 100)
        assert [p[0] for p in pieces] == [100 * k for k in range(len(pieces))]
    assert sum(fill.values()) / (100 * len(fill)) > 0.97
    assert packing.pack(df.where("false"), 100, "t").count() == 0


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "字" * 50)], "doc_id bigint, text string")
    n = {r.doc_id: r.n_tokens for r in packing.token_counts(df, packing.default_tokenizer()).collect()}
    assert n[1] > 0 and n[2] == n[3] == 0 and n[4] > 0


# --- problem 7 ---


def test_fm_index_against_brute_force():
    rng = np.random.default_rng(0)
    for n, symbols in ((1, 2), (50, 2), (700, 5), (300, 40)):
        t = rng.integers(0, symbols + 1, n)
        t[n // 2 :] = t[: n - n // 2]  # long repeats
        index = leakage.FMIndex(t, symbols)
        phrases = rng.integers(1, symbols + 1, (80, 3))
        low, high = index.search(phrases)
        for p, a, b in zip(phrases, low, high):
            assert sorted(index.locate(np.arange(a, b)).tolist()) == [i for i in range(n - 2) if (t[i : i + 3] == p).all()]


PASSAGE = " ".join(f"token{(k * 7) % 53} part{k}" for k in range(40))
QUESTION = "Which narrow queue length lets Rinesudo reach 14.09 error on Quimsa once the traffic sensor is removed?"


def test_leaks(spark):
    items = spark.createDataFrame([(1, QUESTION, "Yes", PASSAGE), (2, None, None, None), (3, "", "", ""), (None, QUESTION, "", PASSAGE)], "item_id bigint, question string, answer string, passage string")
    words = PASSAGE.split()
    third = "Other words here. " + " ".join(words[20:55]).upper() + " and more."
    edited = " ".join(w if k % 11 else "edited" for k, w in enumerate(words))
    docs = {
        1: PASSAGE, 2: third, 3: edited, 4: "x " + QUESTION.replace(" ", "  "), 5: QUESTION.replace("14.09", "15.77"), 6: QUESTION.replace("Rinesudo", "Kovanitu"), 7: " ".join(sorted(words)), 8: " ".join(words[:14]), 9: None, 10: "",
        11: " ".join(words[:30]) + " some quite other sentence stands between the two halves here " + " ".join(words[30:]), 12: "Yes",
    }
    df = spark.createDataFrame([(k, v, 0) for k, v in docs.items()] + [(1, PASSAGE, 0)], "doc_id bigint, text string, item_id int")
    rows = leakage.find_leaks(df, items).collect()
    assert {(r.doc_id, r.item_id, r.part) for r in rows} == {(1, 1, "passage"), (2, 1, "passage"), (3, 1, "passage"), (4, 1, "question"), (11, 1, "passage")}
    assert sum(r.doc_id == 1 for r in rows) == 2
    second = next(r for r in rows if r.doc_id == 2)
    assert third[second.begin_pos : second.end_pos].lower() == " ".join(words[20:55])
    spans = leakage.removal_spans(leakage.find_leaks(df, items)).where("doc_id = 1").collect()
    assert [(s.begin_pos, s.end_pos, s["items"]) for s in spans] == [(0, len(PASSAGE), [1])]
    assert leakage.find_leaks(df.where("false"), items).count() == 0 and leakage.find_leaks(df, items.where("false")).count() == 0


def removed(spark, docs):
    """The words that the removal spans of documents with PASSAGE leave out."""
    items = spark.createDataFrame([(1, QUESTION, "Yes", PASSAGE)], "item_id bigint, question string, answer string, passage string")
    df = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    out = {k: [] for k in docs}
    for r in leakage.removal_spans(leakage.find_leaks(df, items)).orderBy("doc_id", "begin_pos").collect():
        out[r.doc_id] += docs[r.doc_id][r.begin_pos : r.end_pos].split()
    return out


def test_every_place_of_a_leak_is_removed(spark):
    words = PASSAGE.split()
    far = lambda n: " ".join(f"other{k}" for k in range(n))
    docs = {
        1: f"{PASSAGE} {far(300)} {PASSAGE} {far(7)}",  # it stands there twice
        2: " ".join([*words[:40], far(90), *words[40:]]),  # halves that are far apart
        3: " ".join([far(5), *words[:66], far(200), *words[66:], far(5)]),  # the smaller part alone would be no leak
        4: f"{QUESTION} {far(200)} {QUESTION}",
    }
    got = removed(spark, docs)
    assert got[1] == words * 2 and got[2] == words and got[3] == words
    assert [w.rstrip("?") for w in got[4] if not w.startswith("other")] == QUESTION.rstrip("?").split() * 2


def test_interrupted_parts_and_hidden_questions_are_found(spark):
    words = PASSAGE.split()
    far = lambda n: " ".join(f"other{k}" for k in range(n))
    edited = [w if k not in (9, 18) else "edited" for k, w in enumerate(words[:34])]
    docs = {
        1: " ".join([*words[10:26], far(20), *words[26:42]]),  # 40 % in two parts
        2: " ".join([far(9), *words[:15], far(45), *words[50:65]]),
        3: " ".join([*edited[:17], far(39), *edited[17:]]),
        4: QUESTION.replace("14.09", "15.77") + " " + far(90) + " " + " ".join(w + " so" * (k % 4 == 3) for k, w in enumerate(QUESTION.split())),  # the decoy has more exact phrases
        5: " ".join([*words[50:63], far(45), *words[:13]]),  # the other order
    }
    items = spark.createDataFrame([(1, QUESTION, "Yes", PASSAGE)], "item_id bigint, question string, answer string, passage string")
    rows = leakage.find_leaks(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string"), items).collect()
    assert {(r.doc_id, r.part) for r in rows} == {(1, "passage"), (2, "passage"), (3, "passage"), (4, "question")}
    assert sorted(docs[2][r.begin_pos : r.end_pos] for r in rows if r.doc_id == 2) == sorted([" ".join(words[:15]), " ".join(words[50:65])])


def test_chains_end_when_no_run_is_left_that_counts(monkeypatch):
    """Stock phrases all over a document that cannot make a place cost one chain, not one for each phrase."""
    made, own = [], leakage.chain
    monkeypatch.setattr(leakage, "chain", lambda *a: made.append(a) or own(*a))
    item = [f"word{k}" for k in range(80)]
    phrases = leakage.Phrases([(1, None, " ".join(item))])
    stock = [" ".join([*(f"other{x}" for x in range(50)), *item[k : k + 6]]) for k in range(72, -1, -6)]
    assert leakage._leaks([phrases.coded(leakage.code([" ".join(stock)]).number)], phrases) == [] and len(made) == 1


def test_chains_of_fewer_runs_stay_under_the_bound():
    """What any chain of any part of the runs covers, against the bound; taking chains until the runs are used up finds no more than stopping at it."""
    rng = random.Random(4)
    for trial in range(600):
        length = rng.choice([30, 120, 300])
        runs = {(i, j): (i, j, rng.randint(5, 14)) for i, j in ((rng.randint(0, rng.choice([40, 300, 3000])), rng.randint(0, length - 15)) for _ in range(rng.randint(1, 25)))}
        runs, price = list(runs.values()), rng.choice([None, 10.0, 16.0])
        used, most = leakage.chain(runs, length, price)
        assert leakage._covered(used) <= most
        left = [r for r in runs if r not in used]
        while left:
            chain, fewer = leakage.chain(left, length, price)
            assert leakage._covered(chain) <= fewer <= most
            left = [r for r in left if r not in chain]
        for _ in range(5):
            some = rng.sample(runs, rng.randint(1, len(runs)))
            assert leakage._covered(leakage.chain(some, length, price)[0]) <= most


def test_local_alignment_against_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(20):
        a, b = rng.integers(0, 4, 12), rng.integers(0, 4, 20)
        h = np.zeros((13, 21))
        for i in range(12):
            for j in range(20):
                h[i + 1, j + 1] = max(0, h[i, j] + (1 if a[i] == b[j] else -0.6), h[i, j + 1] - 0.4, h[i + 1, j] - 0.4)
        assert leakage.local_alignment(a, b)[0] == pytest.approx(h.max())


def test_bounded_gaps_against_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(20):
        a, b = rng.integers(0, 4, 12), rng.integers(0, 4, 20)
        h = np.zeros((13, 21))
        cost = lambda n: min(0.4 * n, 1.0)
        for i in range(1, 13):
            for j in range(1, 21):
                h[i, j] = max(0, h[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] else -0.6), *(h[i - k, j] - cost(k) for k in range(1, i + 1)), *(h[i, j - k] - cost(k) for k in range(1, j + 1)))
        assert leakage.local_alignment(a, b, most=1.0)[0] == pytest.approx(h.max())


# --- problem 8 ---

EASY, HARD = ["cat", "dog", "sun", "box"], ["heterogeneity", "parameterization", "operationalization", "dimensionality"]


def graded_text(rng, level):
    words = lambda: [rng.choice(HARD if rng.random() < (level - 1) / 3 else EASY) for _ in range(3 * level + 2)]
    return " ".join(" ".join(words()) + "." for _ in range(400 // (3 * level) + 40))


def test_levels_are_learned(spark):
    rng = random.Random(8)
    truth = {k: 1 + k % 4 for k in range(120)}
    docs = spark.createDataFrame([(k, graded_text(rng, v), 9) for k, v in truth.items()] + [(500, "short", 9), (501, None, 9), (0, graded_text(rng, 1), 9)], "doc_id bigint, text string, level int")
    labels = spark.createDataFrame([(k, truth[k], "r") for k in range(60)] + [(1, None, "r"), (999, 3, "r"), (0, 1, "s")], "doc_id bigint, level int, rater string")
    rows = reading.reading_levels(docs, labels).collect()
    assert len(rows) == 121
    held_out = [r for r in rows if r.doc_id >= 60]
    assert sum(r.level == truth[r.doc_id] for r in held_out) / len(held_out) > 0.9
    assert all(r.level == truth[r.doc_id] for r in rows if r.doc_id < 60)
    assert {r.level for r in reading.reading_levels(docs, labels.where("false")).collect()} == {2}
    assert reading.reading_levels(docs.where("false"), labels).count() == 0


def test_the_whole_text_tells_its_script():
    assert reading.features("数据模型。" * 500 + "The data of the model and a long text in English. " * 400)[1] == "en"
    assert reading.features("The data of the model. " * 100 + "数据模型决定检索结果。" * 2000)[1] == "zh"


def test_borders_search_every_edge():
    score = np.linspace(1, 4, 3000)
    level = 1.0 + (score > score[700]) + (score > score[1501]) + (score > score[2302])
    (a, b, c) = reading.borders(score, level, np.array(["en"] * 3000))["en"]
    assert (1.0 + (score > a) + (score > b) + (score > c) == level).all()


def test_places_of_words_in_outward_forms():
    """Every folded word has its place in the stored text, whatever its outward form."""
    for text in ("Plain words, here (twice).", "Ｗide  le­tters and é​ accents", "divi-\n  ded and near-\nfield words", "中文，ＡＢＣ和 latin混合　字", "a b​c ﬁne ½ x²"):
        places = leakage._word_places(text)
        words = leakage.fold(text)
        assert len(places) == len(words)
        assert all(0 <= b < e <= len(text) for b, e in places) and places == sorted(places)
        for w, (b, e) in zip(words, places):
            assert w in leakage.fold(text[b:e])


def test_blocks_of_items_agree_with_one(spark):
    docs = spark.createDataFrame([(k, f"Intro {k}. The quick brown fox number {k} jumps over the lazy dog beside river bank {k * 7} at dawn every day of the long year.") for k in range(12)], "doc_id bigint, text string")
    items = docs.selectExpr("doc_id as item_id", "cast(null as string) as question", "text as passage")
    one = {tuple(r) for r in leakage.find_leaks(docs, items).collect()}
    assert one == {tuple(r) for r in leakage.find_leaks(docs, items, block=5).collect()} and {(r[0], r[1]) for r in one} >= {(k, k) for k in range(12)}
