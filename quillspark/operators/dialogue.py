"""Questions of users: what they want, what they refer to, and the history they stand in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import HAN, SPACE, _c, all_matches

#: Words that speak of a task, and words that ask for it.
CITE_ABOUT = ["引用", "参考文献", "引文", "citation", "cite", "citations", "支持这段", "支持一下", "推荐文献", "推荐几篇", "找几篇", "找文献", "段落", "这段话", "这段", "那段", "本段", "paragraph", "this paragraph", "this section", "above", "below"]
CITE_ASK = ["推荐", "补充", "补上", "找", "找出", "给出", "标注", "加几篇", "加上", "recommend", "recommends", "suggest", "suggests", "find", "add"]
SURVEY_ABOUT = ["综述", "survey", "研究现状", "研究进展", "文献总结", "literature review"]
SURVEY_ASK = ["写", "生成", "起草", "做一篇", "整理成", "综述一下", "总结一下", "写一篇", "产出", "generate", "write", "draft", "compose", "produce"]
READ_ABOUT = ["精读", "全文", "阅读论文", "阅读一下", "读一下", "read paper", "详细分析", "细读"]
#: Words that carry no subject.
FILLERS = ["为什么", "怎么样", "怎么做", "怎么", "如何", "什么", "哪些", "讲讲", "说说", "展开", "继续", "详细", "一下", "一点", "why", "how", "what", "which", "compare", "more", "detail", "details", "explain", "again", "continue"]
POINTERS = r"它们?|他们|此文|这篇|那篇|上述|刚才|(^|[^a-z0-9_])(it|its|they|them|these|those|the above|this paper|that paper)([^a-z0-9_]|$)"
DIGITS = "一二三四五六七八九十"
ORDINAL = rf"\[([0-9]{{1,3}})\]|第\s*([0-9{DIGITS}]{{1,3}})\s*篇"
#: Code points of a history block.
HISTORY = 1800


def mentions(low: Column, words: list[str], whole: bool) -> Column:
    """Does a lower-case text have one of the words? Latin ones stand at a word's beginning (and end, if whole)."""
    latin, other = [w for w in words if w.isascii()], [w for w in words if not w.isascii()]
    hit = low.rlike("|".join(other)) if other else F.lit(False)
    return hit | low.rlike("(^|[^a-z0-9])(" + "|".join(latin) + ")" + ("([^a-z0-9]|$)" if whole else "")) if latin else hit


def paper_number(c: str | Column) -> Column:
    n = F.regexp_extract(_c(c), r"(?i)(?:论文|paper|#)\s*([0-9]{1,4})", 1)
    return F.when(n != "", n.cast("int"))


def quoted_title(c: str | Column) -> Column:
    q = F.regexp_extract(_c(c), r"[《「“]([^》」”]{4,80})[》」”]", 1)
    return F.when(q != "", q)


def only_fillers(c: str | Column) -> Column:
    """Nothing but question words and particles."""
    return _c(c).rlike(r"(?i)^(?:" + "|".join(FILLERS) + r"|[的了吗呢吧啊呀嘛，。？！、,.?!\s])+$")


def intent(c: str | Column) -> tuple[Column, Column]:
    """(read, cite, survey or qa; confidence) of a goal. Words that only name a task do not ask for it: citing and surveying need a verb, reading a title in quotes with a reading word, or a paper's number."""
    g = F.coalesce(_c(c), F.lit(""))
    low = F.lower(g)
    read, number = mentions(low, READ_ABOUT, False), paper_number(g)
    cite = mentions(low, CITE_ABOUT, False) & mentions(low, CITE_ASK, True)
    survey = mentions(low, SURVEY_ABOUT, False) & mentions(low, SURVEY_ASK, True)
    follow = only_fillers(g)
    kind = F.when(read & (quoted_title(g).isNotNull() | number.isNotNull()), "read").when(number.isNotNull(), "read").when(cite, "cite").when(survey, "survey").otherwise("qa")
    sure = (
        F.when(read & (quoted_title(g).isNotNull() | number.isNotNull()), 0.9)
        .when(number.isNotNull(), 0.65)
        .when(cite, F.when(g.rlike(ORDINAL), 0.95).otherwise(0.85))
        .when(survey, 0.8)
        .when(follow, 0.7)
        .otherwise(0.5)
    )
    return kind, sure


def plan(c: str | Column) -> Column:
    """Names of the steps for a goal, in order."""
    low = F.lower(F.coalesce(_c(c), F.lit("")))
    cite = mentions(low, CITE_ABOUT, False) & mentions(low, CITE_ASK, True)
    survey = mentions(low, SURVEY_ABOUT, False) & mentions(low, SURVEY_ASK, True)
    read = mentions(low, READ_ABOUT, False) & paper_number(c).isNotNull()
    steps = lambda *s: F.array(*[F.lit(x) for x in s])
    return F.when(cite, steps("recommend_citations")).when(survey, steps("generate_survey")).when(read, steps("read_paper")).otherwise(steps("retrieve_library", "answer_question"))


def referenced(c: str | Column) -> Column:
    """Numbers of the sources a question points at: [3], 第 2 篇, 第二篇; in order."""
    hits = all_matches(F.coalesce(_c(c), F.lit("")), ORDINAL)
    bare = F.transform(hits, lambda h: F.regexp_replace(h, rf"[^0-9{DIGITS}]", ""))
    value = F.transform(bare, lambda b: F.when(b.rlike("^[0-9]+$"), b.try_cast("int")).when(F.length(b) == 1, F.position(b, F.lit(DIGITS))).otherwise(0))
    return F.filter(value, lambda v: v > 0)


def followup(c: str | Column, before: Column) -> Column:
    """Does a question lean on the turns before it? It points at a source, or with a pronoun, or has nothing but fillers."""
    q = F.trim(F.coalesce(_c(c), F.lit("")))
    return F.coalesce(before, F.lit(False)) & (q != "") & ((F.size(referenced(q)) > 0) | F.lower(q).rlike(POINTERS) | (F.length(F.regexp_replace(F.lower(q), "(?i)" + "|".join(FILLERS) + r"|[的了吗呢吧啊呀嘛，。？！、,.?!\s]", "")) < 3))


def rewritten(turns: DataFrame, session: str, order: str, text: str, context: int = 2) -> DataFrame:
    """session, order, asked, leans: questions that lean on others with the last `context` questions before them in front."""
    w = Window.partitionBy(session).orderBy(order)
    before = F.collect_list(text).over(w.rowsBetween(-context, -1))
    leans = followup(F.col(text), F.size(before) > 0)
    asked = F.when(leans, F.concat_ws(" ", F.array_join(before, " "), F.trim(text))).otherwise(F.trim(text))
    return turns.select(session, order, asked.alias("asked"), leans.alias("leans"))


def history_tail(turns: DataFrame, session: str, order: str, n: int) -> DataFrame:
    """The last n turns of every session with their place, oldest first."""
    last = turns.withColumn("_r", F.row_number().over(Window.partitionBy(session).orderBy(F.desc(order)))).where(F.col("_r") <= n)
    return last.withColumn("place", F.row_number().over(Window.partitionBy(session).orderBy(F.desc("_r")))).drop("_r")


def history_block(turns: Column, most: int = HISTORY) -> Column:
    """Lines of role and text, oldest first, of an array of structs (asked boolean, text); over `most` code points the earliest answers go first, then the earliest questions."""
    from ..functions.fields import shortened_turn

    line = F.transform(
        F.filter(F.transform(turns, lambda t: F.struct(t["asked"].alias("asked"), F.trim(F.regexp_replace(F.coalesce(t["text"], F.lit("")), SPACE, " ")).alias("text"))), lambda t: t["text"] != ""),
        lambda t: F.struct(t["asked"].alias("asked"), F.concat(F.when(t["asked"], "用户：").otherwise("助手："), shortened_turn(t["text"], t["asked"])).alias("line")),
    )
    size = lambda a: F.aggregate(a, F.lit(0), lambda s, t: s + F.length(t["line"]) + 1)
    # answers go from the oldest on as long as the rest is too long, then questions
    excess = lambda a: F.greatest(F.lit(0), size(a) - 1 - most)

    def drop(a: Column, asked: bool) -> Column:
        state = F.struct(excess(a).alias("left"), F.array().cast("array<struct<asked:boolean,line:string>>").alias("kept"))
        step = lambda s, t: F.when((s["left"] > 0) & (t["asked"] == asked), F.struct((s["left"] - F.length(t["line"]) - 1).alias("left"), s["kept"].alias("kept"))).otherwise(F.struct(s["left"].alias("left"), F.concat(s["kept"], F.array(t)).alias("kept")))
        return F.aggregate(a, state, step, lambda s: s["kept"])

    return F.array_join(F.transform(drop(drop(line, False), True), lambda t: t["line"]), "\n")


def chinese(c: str | Column) -> Column:
    return _c(c).rlike(f"[{HAN}]")
