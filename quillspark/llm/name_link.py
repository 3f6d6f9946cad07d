"""Linking the spellings of one person or organisation.

The words of all names are sharded into tries; Levenshtein automata walk them to list the words within one edit of
each other. A spelling becomes an order-free set of words, so every permutation of its parts is the same node; nodes
are linked through near words, nicknames, initials, abbreviations and acronyms. A link needs one clear target:
ambiguous short forms are settled by the works they appear on, or stay alone.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut

#: Short form and the full names it stands for.
NICKNAMES = """
abby abigail; alex alexander alexandra; andy andrew; al albert alan; barb barbara; bea beatriz beatrice; becky rebecca; ben benjamin; beppe giuseppe; beth elizabeth;
bill william; bob robert; cathy catherine; charlie charles; chris christopher christine christian; dan daniel; danny daniel; dave david; deb deborah; debbie deborah;
dick richard; dima dimitri dmitri; don donald; ed edward; eddie edward; ferdi ferdinand; fran francis; fred frederick; gabi gabriela; greg gregory; gwen gwendolyn; hans johannes;
jackie jacqueline; jeff jeffrey; jen jennifer; jenny jennifer; jim james; jimmy james; joe joseph; kate katherine; kathy katherine; katya ekaterina; ken kenneth; kostya konstantin;
leo leonardo leonard; liz elizabeth; lupe guadalupe; maggie margaret; matt matthew; max maximilian; mike michael; misha mikhail; nacho ignacio; nick nicholas; paco francisco;
pat patricia patrick; peg margaret; peggy margaret; pepe jose; pete peter; phil philip; pippa philippa; ray raymond; rick richard; rob robert; ron ronald; sam samantha samuel; sasha alexander;
steve stephen steven; sue susanna susan; susie susanna susan; ted edward theodore; thea theodora; tim timothy; tom thomas; tony anthony; trish patricia; valya valentina; vicky victoria;
vova vladimir; will william; zach zachary
"""  # fmt: skip
PARTICLES = {"von", "van", "der", "den", "de", "di", "da", "del", "della", "la", "le", "ten", "ter", "bin", "ibn", "dos", "du", "zu", "zur", "af", "av"}
LINKERS = {"for", "of", "the", "and", "für", "pour", "para", "et", "und", "in", "at", "&", "on"}
TITLES = {"dr", "prof", "professor", "mr", "mrs", "ms", "sir", "phd", "md", "jr", "sr", "msc", "dipl", "ph.d", "m.d", "esq"}

_MARKS = regex.compile(r"[*†‡§#¹²³⁰-⁹\d]+")
_ACRONYM = regex.compile(r"\((\p{Lu}{2,8})\)")
_JOINTS = regex.compile("[ -]+")
_GAPS = regex.compile(r"[\s,;]+")
_INITIALS = regex.compile(r"(?:\p{L}\.-?)+|\p{L}")


def fold(word: str) -> str:
    """Lower case without accents; letters that do not decompose keep their form."""
    return "".join(c for c in unicodedata.normalize("NFKD", word.casefold()) if not unicodedata.combining(c)).replace("’", "'")


def parse(name: str) -> dict:
    """kind (p person, i one name and initials or a short form, o organisation, b abbreviated organisation, a acronym, x one word), words, initials, shorts, acronym."""
    text = "".join(c for c in name if unicodedata.category(c) != "Cf")
    acronym = _ACRONYM.search(text)
    text = unicodedata.normalize("NFKC", _MARKS.sub("", _ACRONYM.sub(" ", text)))
    parts = [t for t in _GAPS.split(text.strip()) if t]
    while parts and fold(parts[0]).rstrip(".") in TITLES:
        parts.pop(0)
    while len(parts) > 1 and fold(parts[-1]).rstrip(".") in TITLES:
        parts.pop()
    shouting = text.upper() == text
    words, initials, shorts, linkers, pending = [], "", [], 0, []
    for t in parts:
        f = fold(t)
        if f in LINKERS:
            linkers += 1
        elif _INITIALS.fullmatch(t) or (len(t) == 2 and t.isupper() and t.isalpha() and not shouting):
            initials += "".join(c for c in f if c.isalpha())
        elif f in PARTICLES and t is not parts[-1]:
            pending.append(f)
        elif t.endswith(".") and len(t) > 2:
            shorts.append(f.rstrip("."))
        elif f.strip(".-'"):
            words.append(" ".join([*pending, f.strip(".'")]))
            pending = []
    full, out = len(words), {"words": words, "initials": initials, "shorts": shorts, "acronym": acronym.group(1).casefold() if acronym else ""}
    if full == 1 and not shorts and not initials and len(parts) == 1 and 2 < len(parts[0]) <= 8 and parts[0].isupper():
        return out | {"kind": "a", "acronym": words[0]}
    if linkers or full >= 3 or (full == 2 and shorts) or len(shorts) > 1:
        if not out["acronym"] and linkers and not shorts:
            out["acronym"] = "".join(w[0] for w in words)
        return out | {"kind": "b" if shorts else "o"}
    return out | {"kind": "p" if full == 2 else "i" if full == 1 and (initials or shorts) else "x"}


# --- trie join -----------------------------------------------------------------------------------------------------


def build_trie(words: list[str]) -> dict:
    root: dict = {}
    for w in words:
        node = root
        for c in w:
            node = node.setdefault(c, {})
        node[""] = w
    return root


def automaton_search(trie: dict, word: str, bound: int = 1) -> list[str]:
    """Words of the trie within `bound` edits (insertion, deletion, substitution, swap of neighbours): the automaton's states are walked along the trie."""
    n = len(word)

    def closed(states: set[tuple[int, int, bool]]) -> set[tuple[int, int, bool]]:
        out = set(states)
        for i, e, swap in states:
            if not swap:
                out |= {(i + d, e + d, False) for d in range(1, bound - e + 1) if i + d <= n}
        return out

    found, stack = [], [(trie, closed({(0, 0, False)}))]
    while stack:
        node, states = stack.pop()
        if "" in node and any(i == n and not swap for i, e, swap in states):
            found.append(node[""])
        for c, child in node.items():
            if not c:
                continue
            after = set()
            for i, e, swap in states:
                if swap:
                    if word[i] == c:
                        after.add((i + 2, e, False))
                    continue
                if i < n and word[i] == c:
                    after.add((i + 1, e, False))
                if e < bound:
                    after.add((i, e + 1, False))
                    if i < n:
                        after.add((i + 1, e + 1, False))
                    if i + 1 < n and word[i + 1] == c:
                        after.add((i, e + 1, True))
            if after:
                stack.append((child, closed(after)))
    return found


def shards(word: str) -> list[str]:
    """Shards in which every word within one edit of this one is met.

    One edit leaves two of a word's first, middle and last parts alone: long words share their beginning, their end,
    or both edges, short ones their first or last letters (two letters may be swapped); and the shorter length of the two.
    Blanks and hyphens do not count. Single letters are initials, not words: two of them are never near.
    """
    core = _JOINTS.sub("", word) or word
    out = [f"2~{''.join(sorted(core))}"] if len(core) == 2 else []
    for n in (len(core) - 1, len(core)):
        if n >= 8:
            k = min(3, (n - 2) // 3)
            out += [f"{n}<{core[: 2 * k]}", f"{n}>{core[-2 * k :]}", f"{n}={core[:k]}.{core[-k:]}"]
        elif n >= 3:
            k = max(1, (n - 1) // 2)
            out += [f"{n}<{core[:k]}", f"{n}>{core[-k:]}"]
        elif n:
            out += [f"{n}<{core[0]}", f"{n}>{core[-1]}"]
    return list(dict.fromkeys(out))


def near_words(words: DataFrame) -> DataFrame:
    """(word, near): all pairs of different words one edit apart, both ways. words: one column `word` of distinct words."""
    schema = "shard string, word string"

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(s, w) for w in pdf["word"] for s in shards(w)], columns=["shard", "word"])

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # shards lie one after the other; each is searched when the next one begins
        last, held = None, []

        def found() -> list[tuple[str, str]]:
            trie = build_trie(held) if len(held) > 1 else {}
            return [(w, u) for w in held for u in automaton_search(trie, w) if u != w and max(len(u), len(w)) > 1] if trie else []

        for pdf in batches:
            out = []
            for shard, word in zip(pdf["shard"], pdf["word"]):
                if shard != last:
                    out += found()
                    last, held = shard, []
                held.append(word)
            yield pd.DataFrame(out, columns=["word", "near"])
        yield pd.DataFrame(found(), columns=["word", "near"])

    sharded = words.mapInPandas(spread, schema).repartition("shard").sortWithinPartitions("shard")
    return sharded.mapInPandas(search, "word string, near string").distinct()


# --- linking -------------------------------------------------------------------------------------------------------

_PARSED = "name string, n bigint, kind string, words array<string>, initials string, shorts array<string>, acronym string"


def spellings(papers: DataFrame, citations: DataFrame, digests: DataFrame) -> DataFrame:
    """(name, work): every spelling with the works it stands on, distinct. JSON may hold strings or objects with a name; broken JSON gives nothing."""

    def of_json(df: DataFrame) -> DataFrame:
        item = df.select(F.col("norm_key").alias("work"), F.explode(F.from_json("authors_json", "array<string>")).alias("x"))
        return item.select(F.when(F.col("x").rlike(r"^\s*\{"), F.get_json_object("x", "$.name")).otherwise(F.col("x")).alias("name"), "work")

    stored = papers.select(F.explode("authors").alias("name"), F.col("norm_key").alias("work"))
    return stored.unionByName(of_json(citations)).unionByName(of_json(digests)).where("length(trim(name)) > 0").distinct()


def _one(df: DataFrame, by: list[str], *order: Column) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_r = 1").drop("_r")


def link_names(names: DataFrame) -> DataFrame:
    """(name, entity) of every spelling; names: (name, work).

    Null and blank names are left out, repeated rows count once. A spelling gets exactly one entity; one that
    nothing is like is its own. Extra columns are ignored; an empty table gives none.
    """
    spark = names.sparkSession
    names = cut(names.select("name", "work").where("length(trim(name)) > 0").distinct())

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, n in zip(pdf["name"], pdf["n"]):
                p = parse(name)
                words = sorted(p["words"]) if p["kind"] != "b" else p["words"]
                rows.append((name, n, p["kind"], words, p["initials"], p["shorts"], p["acronym"]))
            yield pd.DataFrame(rows, columns=["name", "n", "kind", "words", "initials", "shorts", "acronym"])

    read = cut(names.groupBy("name").agg(F.count(F.lit(1)).alias("n")).mapInPandas(parsed, _PARSED).withColumn("set", F.array_join("words", "|")))
    # two words without a linker are read as a person's name: with the words of an organisation they are that one
    bodies = read.where("kind = 'o' and size(words) = 2").select("set").distinct().withColumn("body", F.lit(True))
    forms = cut(
        read.join(bodies, "set", "left")
        .withColumn("kind", F.when(F.col("body") & (F.col("kind") == "p") & (F.col("initials") == ""), F.lit("o")).otherwise(F.col("kind")))
        .withColumn("node", F.concat_ws("|", "kind", F.array_join("words", "|"), F.when(F.col("kind").isin("p", "i"), F.col("initials")), F.array_join("shorts", "|"), F.when(F.col("kind") == "a", F.col("acronym"))))
        .drop("body")
    )
    # sets of words with how often they are used; words with how many sets they are part of
    sets = cut(forms.where("kind in ('p', 'o')").groupBy("kind", "set").agg(F.sum("n").alias("n"), F.first("words").alias("words")))
    words = cut(sets.select(F.explode("words").alias("word"), "kind", "set").groupBy("word").agg(F.count(F.lit(1)).alias("degree")))
    vocabulary = words.select("word").unionByName(forms.where("kind = 'i'").select(F.explode("words").alias("word"))).distinct()
    near = cut(near_words(vocabulary))
    nick = spark.createDataFrame([(a, f) for a, *full in (x.split() for x in NICKNAMES.split(";")) for f in full], "word string, near string")

    # a set with one word replaced: by a near word of more names, or of as many but used more, or by the full form of a nickname
    other = (
        near.withColumn("nick", F.lit(False))
        .unionByName(F.broadcast(nick).withColumn("nick", F.lit(True)))
        .join(words.withColumnRenamed("degree", "d"), "word")
        .join(words.select(F.col("word").alias("near"), F.col("degree").alias("d2")), "near")
        .where("nick or d <= 3 or d2 >= 8 * d")
    )
    moved = (
        sets.select("kind", "set", "n", "words", F.explode("words").alias("word"))
        .join(other, "word")
        .select("kind", "set", "n", "nick", "d", "d2", F.array_join(F.array_sort(F.concat(F.filter("words", lambda w: w != F.col("word")), F.array("near"))), "|").alias("target"))
        .join(sets.select(F.col("kind"), F.col("set").alias("target"), F.col("n").alias("m")), ["kind", "target"])
        .where("nick or d2 > d or (d2 = d and (m > n or (m = n and target < set)))")
    )
    # a word that several names share may be a name of its own: then both spellings must stand on one work
    works = forms.where("kind in ('p', 'o')").join(names, "name").select("kind", "set", "work").distinct()
    shared = moved.where("not nick and d > 1 and d2 < 8 * d").select("kind", "set", "target").distinct()
    shared = shared.join(works, ["kind", "set"]).join(works.withColumnRenamed("set", "target"), ["kind", "target", "work"]).select("kind", "set", "target").distinct().withColumn("met", F.lit(True))
    moved = moved.join(shared, ["kind", "set", "target"], "left").where("nick or d <= 1 or d2 >= 8 * d or met")
    step = _one(moved, ["kind", "set"], F.desc("nick"), F.desc("m"), F.asc("target")).select("kind", "set", "target")
    roots = cut(sets.select("kind", "set").join(step, ["kind", "set"], "left").select("kind", "set", F.coalesce("target", "set").alias("root"), F.lit(True).alias("moved")))
    for _ in range(40):  # each step leads to a set of more common words or a full form; every round halves the chains, until none is left
        after = roots.select("kind", F.col("set").alias("root"), F.col("root").alias("next"))
        roots = cut(roots.drop("moved").join(after, ["kind", "root"], "left").select("kind", "set", F.coalesce("next", "root").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
        if roots.where("moved").isEmpty():
            break
    roots = roots.drop("moved")

    # persons: different middle initials are different persons; a missing one is no difference if there is only one
    full = forms.where("kind in ('p', 'o')").join(roots, ["kind", "set"])
    middles = full.where("kind = 'p' and initials <> ''").groupBy("root").agg(F.collect_set(F.substring("initials", 1, 1)).alias("m"))
    settled = full.join(middles, "root", "left").withColumn("mid", F.when(F.coalesce(F.size("m"), F.lit(0)) > 1, F.substring("initials", 1, 1)).otherwise(F.coalesce(F.element_at("m", 1), F.lit(""))))
    done = cut(settled.select("name", "kind", "node", "root", F.when(F.col("kind") == "p", F.col("mid")).otherwise("").alias("mid"), "acronym", F.concat_ws("|", F.lit("E"), "kind", "root", F.when(F.col("kind") == "p", F.col("mid"))).alias("entity")))
    entities = cut(done.select("entity", "kind", "root", "mid").distinct().withColumn("parts", F.split("root", r"\|")))

    # short forms: what could stand behind each
    person = entities.where("kind = 'p' and size(parts) = 2")
    sides = person.select("entity", "mid", F.col("parts")[0].alias("family"), F.col("parts")[1].alias("given")).unionByName(person.select("entity", "mid", F.col("parts")[1].alias("family"), F.col("parts")[0].alias("given")))
    sides = sides.select("entity", "mid", "family", "given", F.substring("given", 1, 1).alias("letter"))
    short = forms.where("kind = 'i'").select("name", F.col("words")[0].alias("word"), "initials", F.coalesce(F.try_element_at("shorts", F.lit(1)), F.lit("")).alias("short"))
    # one misspelt family name is allowed if the name as written is nobody's
    reach = short.withColumn("family", F.col("word")).withColumn("off", F.lit(0)).unionByName(short.join(near, "word").withColumn("family", F.col("near")).withColumn("off", F.lit(1)).drop("near"))
    reach = reach.withColumn("letter", F.substring(F.when(F.col("short") != "", F.col("short")).otherwise(F.col("initials")), 1, 1)).withColumn("second", F.when(F.col("short") != "", F.substring("initials", 1, 1)).otherwise(F.substring("initials", 2, 1)))
    people = (
        reach.join(sides, ["family", "letter"])
        .where("short = '' or startswith(given, short)")
        .where("second = '' or mid = '' or second = mid")
        .select("name", "entity", (F.col("off") * 2 + F.when(F.col("second") == F.col("mid"), 0).otherwise(1)).alias("off"))
    )
    org = entities.where("kind = 'o'")

    @F.pandas_udf("boolean")
    def stands(words: pd.Series, shorts: pd.Series, parts: pd.Series) -> pd.Series:
        def fits(words, shorts, parts) -> bool:
            left = list(parts)
            for w in words:
                if w not in left:
                    return False
                left.remove(w)
            if len(left) != len(shorts):
                return False
            for s in sorted(shorts, key=len, reverse=True):
                hit = next((p for p in left if p.startswith(s)), None) or next((p for p in left if p[0] == s[0] and regex.search(".*?".join(map(regex.escape, s)), p)), None)
                if hit is None:
                    return False
                left.remove(hit)
            return True

        return pd.Series([fits(a, b, c) for a, b, c in zip(words, shorts, parts)], dtype=bool)

    short_bodies = forms.where("kind = 'b' and size(words) > 0").select("name", "words", "shorts", F.col("words")[0].alias("word"))
    orgs = short_bodies.join(org.select("entity", "parts", F.explode("parts").alias("word")), "word").where(stands("words", "shorts", "parts")).select("name", "entity", F.lit(0).alias("off"))
    letters = done.where("kind = 'o' and acronym <> ''").select("entity", "acronym").distinct()
    acronyms = forms.where("kind = 'a'").select("name", "acronym").join(letters, "acronym").select("name", "entity", F.lit(0).alias("off"))
    # a name without the middle initial that tells two persons apart goes where its works go, else it is a third person
    bare = done.where("kind = 'p' and mid = ''").select("name", "root").join(person.where("mid <> ''").select("root", "entity"), "root").select("name", "entity", F.lit(9).alias("off"))
    candidates = cut(people.unionByName(orgs).unionByName(acronyms).unionByName(bare).groupBy("name", "entity").agg(F.min("off").alias("off")))
    # works on which both stand speak for a candidate; without them it must be the only one of the best kind
    on = done.select("name", "entity").join(names, "name").select("entity", "work").distinct()
    votes = candidates.join(names, "name").join(on, ["entity", "work"]).groupBy("name", "entity").agg(F.count(F.lit(1)).alias("votes"))
    ranked = candidates.join(votes, ["name", "entity"], "left").na.fill(0, ["votes"])
    # the best candidate and the second best: only a clear best is a link
    place = Window.partitionBy("name").orderBy(F.desc("votes"), F.asc("off"), F.asc("entity"))
    first = ranked.withColumn("r", F.row_number().over(place)).withColumn("v2", F.lead("votes").over(place)).withColumn("o2", F.lead("off").over(place)).where("r = 1")
    top = cut(first.where("v2 is null or v2 < votes or o2 > off").select("name", "entity", ((F.col("off") < 9) | (F.col("votes") > 0)).alias("told")))
    full_names = done.select("name", F.col("entity").alias("own")).join(top.where("told"), "name", "left").select("name", F.coalesce("entity", "own").alias("entity"))
    rest = forms.where("kind not in ('p', 'o')").select("name", "node").join(top.drop("told"), "name", "left").select("name", F.coalesce("entity", F.concat(F.lit("N|"), "node")).alias("entity"))
    return full_names.unionByName(rest)


def pairs(linked: DataFrame) -> DataFrame:
    """Every pair of different spellings of an entity, name_a before name_b in code-point order."""
    one = linked.select("entity", F.col("name").alias("name_a"))
    return one.join(linked.select("entity", F.col("name").alias("name_b")), "entity").where("name_a < name_b").select("name_a", "name_b")
