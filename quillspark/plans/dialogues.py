"""Intents, follow-ups and histories: goals are made of the held-out questions, sessions of the usage log."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import dialogue as d, evaluate
from .registry import Tables, query

_GOALS = "(SELECT item_id, unnest([question, '推荐几篇支持这段的文献：' || question, 'Please write a survey on ' || question, '精读论文 ' || item_id, '读一下《' || left(question, 60) || '》', 'Why? Explain more.', 'compare paper 7 with [3]']) AS goal, unnest(['qa', 'cite', 'survey', 'read', 'read', 'qa', 'read']) AS gold FROM eval_items)"


def _goals(x: Tables) -> DataFrame:
    q = F.col("question")
    made = [(q, "qa"), (F.concat(F.lit("推荐几篇支持这段的文献："), q), "cite"), (F.concat(F.lit("Please write a survey on "), q), "survey"), (F.concat(F.lit("精读论文 "), F.col("item_id").cast("string")), "read"), (F.concat(F.lit("读一下《"), F.left(q, F.lit(60)), F.lit("》")), "read"), (F.lit("Why? Explain more."), "qa"), (F.lit("compare paper 7 with [3]"), "read")]
    return x.eval_items.select("item_id", F.explode(F.array(*[F.struct(g.alias("goal"), F.lit(k).alias("gold")) for g, k in made])).alias("g")).select("item_id", "g.*")


def _has(words: list[str], whole: bool) -> str:
    latin, other = [w for w in words if w.isascii()], [w for w in words if not w.isascii()]
    return f"(regexp_matches(low, '{'|'.join(other)}') OR regexp_matches(low, '(^|[^a-z0-9])({'|'.join(latin)}){'([^a-z0-9]|$)' if whole else ''}'))" if latin else f"regexp_matches(low, '{'|'.join(other)}')"


_CITE, _SURVEY, _READ = f"({_has(d.CITE_ABOUT, False)} AND {_has(d.CITE_ASK, True)})", f"({_has(d.SURVEY_ABOUT, False)} AND {_has(d.SURVEY_ASK, True)})", _has(d.READ_ABOUT, False)
_NUMBER, _QUOTED = "regexp_matches(goal, '(?i)(论文|paper|#)\\s*[0-9]{1,4}')", "regexp_matches(goal, '[《「“][^》」”]{4,80}[》」”]')"
_ORDINAL = "'\\[[0-9]{1,3}\\]|第\\s*[0-9一二三四五六七八九十]{1,3}\\s*篇'"
_FILL = "|".join(d.FILLERS)
_KIND = f"CASE WHEN {_READ} AND ({_QUOTED} OR {_NUMBER}) THEN 'read' WHEN {_NUMBER} THEN 'read' WHEN {_CITE} THEN 'cite' WHEN {_SURVEY} THEN 'survey' ELSE 'qa' END"
_SURE = f"CASE WHEN {_READ} AND ({_QUOTED} OR {_NUMBER}) THEN 0.9 WHEN {_NUMBER} THEN 0.65 WHEN {_CITE} THEN CASE WHEN regexp_matches(goal, {_ORDINAL}) THEN 0.95 ELSE 0.85 END WHEN {_SURVEY} THEN 0.8 WHEN regexp_matches(goal, '(?i)^({_FILL}|[的了吗呢吧啊呀嘛，。？！、,.?!\\s])+$') THEN 0.7 ELSE 0.5 END"
_G = f"(SELECT *, lower(goal) AS low FROM {_GOALS})"


@query(f"SELECT item_id, goal, {_KIND} AS intent, CAST({_SURE} AS DOUBLE) AS confidence FROM {_G}")
def intents(x: Tables) -> DataFrame:
    kind, sure = d.intent("goal")
    return _goals(x).select("item_id", "goal", kind.alias("intent"), sure.alias("confidence"))


@query(f"SELECT gold, {_KIND} AS guess, count(*) AS n FROM {_G} GROUP BY ALL")
def intent_confusion(x: Tables) -> DataFrame:
    return evaluate.confusion(_goals(x).select("gold", d.intent("goal")[0].alias("guess")), "gold", "guess")


@query(f"WITH m AS (SELECT gold, {_KIND} AS guess FROM {_G}), l AS (SELECT DISTINCT gold AS label FROM m UNION SELECT DISTINCT guess FROM m) SELECT label, round((SELECT count(*) FROM m WHERE gold = label AND guess = label) / nullif((SELECT count(*) FROM m WHERE guess = label), 0), 6) AS precision, round((SELECT count(*) FROM m WHERE gold = label AND guess = label) / nullif((SELECT count(*) FROM m WHERE gold = label), 0), 6) AS recall FROM l")
def intent_routing(x: Tables) -> DataFrame:
    s = evaluate.class_scores(evaluate.confusion(_goals(x).select("gold", d.intent("goal")[0].alias("guess")), "gold", "guess"))
    return s.select("label", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(f"SELECT item_id, goal, CASE WHEN {_CITE} THEN 'recommend_citations' WHEN {_SURVEY} THEN 'generate_survey' WHEN {_READ} AND {_NUMBER} THEN 'read_paper' ELSE 'retrieve_library,answer_question' END AS steps FROM {_G}")
def goal_plans(x: Tables) -> DataFrame:
    return _goals(x).select("item_id", "goal", F.array_join(d.plan("goal"), ",").alias("steps"))


_ASKED = "(SELECT item_id, unnest([question, '第 ' || (item_id % 12 + 1) || ' 篇和 [' || (item_id % 7 + 1) || '] 的区别', '第二篇呢', 'What about its results?', 'why?']) AS goal FROM eval_items)"


def _asked(x: Tables) -> DataFrame:
    i = F.col("item_id")
    made = [F.col("question"), F.concat(F.lit("第 "), (i % 12 + 1).cast("string"), F.lit(" 篇和 ["), (i % 7 + 1).cast("string"), F.lit("] 的区别")), F.lit("第二篇呢"), F.lit("What about its results?"), F.lit("why?")]
    return x.eval_items.select("item_id", F.explode(F.array(*made)).alias("goal"))


@query(f"SELECT item_id, goal, array_to_string(list_filter(list_transform(regexp_extract_all(goal, {_ORDINAL}), lambda h: CASE WHEN regexp_matches(h, '[0-9]') THEN CAST(regexp_extract(h, '[0-9]+') AS INT) ELSE strpos('一二三四五六七八九十', regexp_extract(h, '第\\s*(.)', 1)) END), lambda v: v > 0), ',') AS numbers FROM {_ASKED}")
def referenced_sources(x: Tables) -> DataFrame:
    return _asked(x).select("item_id", "goal", F.array_join(d.referenced("goal"), ",").alias("numbers"))


_POINT = d.POINTERS.replace("'", "''")


@query(f"SELECT item_id, goal, regexp_matches(goal, {_ORDINAL}) OR regexp_matches(lower(trim(goal)), '{_POINT}') OR length(regexp_replace(lower(trim(goal)), '{_FILL}|[的了吗呢吧啊呀嘛，。？！、,.?!\\s]', '', 'g')) < 3 AS leans FROM {_ASKED}")
def followups(x: Tables) -> DataFrame:
    return _asked(x).select("item_id", "goal", d.followup("goal", F.lit(True)).alias("leans"))


@query(
    "WITH t AS (SELECT user_id, event_id, CASE WHEN event_type = 'click' THEN 'What about its results?' ELSE event_type || ' of item ' || CAST(event_id AS VARCHAR) END AS q FROM events), b AS (SELECT user_id, event_id, q, lag(q, 1) OVER w AS a1, lag(q, 2) OVER w AS a2 FROM t WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) "
    "SELECT user_id, event_id, q LIKE 'What%' AND a1 IS NOT NULL AS leans, CASE WHEN q LIKE 'What%' AND a1 IS NOT NULL THEN coalesce(a2 || ' ', '') || a1 || ' ' || q ELSE q END AS asked FROM b"
)
def rewritten_questions(x: Tables) -> DataFrame:
    q = F.when(F.col("event_type") == "click", F.lit("What about its results?")).otherwise(F.concat("event_type", F.lit(" of item "), F.col("event_id").cast("string")))
    return d.rewritten(x.events.select("user_id", "event_id", q.alias("q")), "user_id", "event_id", "q")


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 6")
def history_tails(x: Tables) -> DataFrame:
    return d.history_tail(x.events.select("user_id", "event_id"), "user_id", "event_id", 6)


@query(
    "WITH l AS (SELECT user_id, event_id, event_type = 'click' AS asked, CASE WHEN event_type = 'click' THEN '用户：' || event_type || ' ' || event_id ELSE '助手：' || event_type || ' ' || event_id END AS line FROM events WHERE event_id IN (SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 8)), "
    "s AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY user_id) - 1 - 90 AS excess, coalesce(sum(length(line) + 1) OVER (PARTITION BY user_id, asked ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, coalesce(sum(CASE WHEN asked THEN 0 ELSE length(line) + 1 END) OVER (PARTITION BY user_id), 0) AS answers FROM l), "
    "k AS (SELECT * FROM s WHERE CASE WHEN asked THEN before >= greatest(0, excess - answers) ELSE before >= greatest(0, excess) END) SELECT u.user_id, coalesce(string_agg(line, chr(10) ORDER BY event_id), '') AS block FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN k USING (user_id) GROUP BY u.user_id"
)
def history_blocks(x: Tables) -> DataFrame:
    """The last turns of each user as a block of at most 90 characters."""
    tail = d.history_tail(x.events.select("user_id", "event_id", "event_type"), "user_id", "event_id", 8)
    turn = F.struct("event_id", (F.col("event_type") == "click").alias("asked"), F.concat_ws(" ", "event_type", "event_id").alias("text"))
    turns = tail.groupBy("user_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))  # eight a user
    return turns.select("user_id", d.history_block(F.transform("turns", lambda t: F.struct(t["asked"].alias("asked"), t["text"].alias("text"))), 90).alias("block"))
