"""Check queries for the prompt batch jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labeldist.functions import responses as RS
from labeldist.functions import text as TX
from labeldist.operators import metrics as M
from labeldist.operators import prompts as PR
from labeldist.plans import sqlviews as S
from labeldist.plans import views as V
from labeldist.plans.q_distributions import crowd_pairs
from labeldist.plans.registry import register

K_EXAMPLES = 2

# --- fixed values: our own prompt wording (one template per language) -------
PROMPT_TEXT = ("Two sentences follow. Give the probability of each of the 28 discourse senses "
               "holding between them, as a Python list of 28 floats that sums to 1.")
ACK_TEXT = "Understood. I will answer with a list of 28 floats."
PROMPT_LANGS = ["en", "de", "fr", "es", "cs", "all"]
# -----------------------------------------------------------------------------


def prompt_table(spark: SparkSession) -> DataFrame:
    """``(lang, prompt, ack)``: one template per language (S10 reads the same
    shape from files with :func:`labeldist.sources.readers.read_prompts`)."""
    return spark.createDataFrame([(l, f"[{l}] {PROMPT_TEXT}", ACK_TEXT) for l in PROMPT_LANGS],
                                 "lang STRING, prompt STRING, ack STRING")


def _prompt_values_sql() -> str:
    rows = ", ".join(f"('{l}', '[{l}] {PROMPT_TEXT}', '{ACK_TEXT}')" for l in PROMPT_LANGS)
    return f"prompts AS (SELECT * FROM (VALUES {rows}) t(lang, prompt, ack))"


def answer_literal(idcol: str) -> "F.Column":
    """A 28-float answer literal derived from an id, with the five malformed
    kinds of the response view (residue of the id modulo 7)."""
    good = F.expr(f"concat('[', array_join(transform(sequence(0, 27), i -> CASE WHEN i = {idcol} % 28 THEN '0.7' "
                  f"WHEN i = ({idcol} + 9) % 28 THEN '0.3' ELSE '0.0' END), ', '), ']')")
    idcol = F.col(idcol)
    k = idcol % 7
    return (F.when(k == 0, F.replace(good, F.lit("0.7"), F.lit("0.8")))
             .when(k == 1, F.replace(good, F.lit(", "), F.lit(" ")))
             .when(k == 2, F.concat(F.lit("Answer: "), good))
             .when(k == 3, F.replace(good, F.lit("[0.0"), F.lit("[0")))
             .when(k == 4, F.lit("[0.5, 0.5]"))
             .otherwise(good))


ANSWER_SQL = """CASE itemid % 7
  WHEN 0 THEN replace(good, '0.7', '0.8') WHEN 1 THEN replace(good, ', ', ' ')
  WHEN 2 THEN concat('Answer: ', good) WHEN 3 THEN replace(good, '[0.0', '[0')
  WHEN 4 THEN '[0.5, 0.5]' ELSE good END"""
GOOD_SQL = """concat('[', array_to_string(list_transform(range(28), lambda i: CASE WHEN i=itemid%28 THEN '0.7'
       WHEN i=(itemid+9)%28 THEN '0.3' ELSE '0.0' END), ', '), ']')"""


def exemplars(spark: SparkSession, sf: str) -> DataFrame:
    """Exemplar candidates ``(lang, idx, question, answer)``: training items
    with both sentences; the prompt uses the first k per language."""
    i = V.v_items(spark, sf).filter((F.col("split") == "train") & F.col("arg1").isNotNull()
                                    & F.col("arg2").isNotNull())
    return i.select(F.col("inst_lang").alias("lang"), F.col("itemid").alias("idx"),
                    TX.format_question("arg1", "arg2").alias("question"),
                    answer_literal("itemid").alias("answer"))


Q_SQL = "'Sentence 1: ' || arg1 || chr(10) || 'Sentence 2: ' || arg2"
EX_SQL = "WITH " + S.V_ITEMS + ",\n" + _prompt_values_sql() + f""",
ex0 AS (SELECT itemid, inst_lang AS lang, {Q_SQL} AS question, {GOOD_SQL} AS good
        FROM v_items WHERE split = 'train' AND arg1 IS NOT NULL AND arg2 IS NOT NULL),
ex AS (SELECT lang, itemid AS idx, question, {ANSWER_SQL} AS answer FROM ex0)
"""


def _validate_sql(src: str, col: str, keys: str) -> str:
    """CTEs ``vs`` -> ``vv(keys, valid, reason, probs)`` mirroring Q3."""
    return f"""vs AS (SELECT {keys}, regexp_replace(regexp_replace({col}, '^\\s+', ''), '\\s+$', '') AS s FROM {src}),
vl AS (SELECT *, regexp_matches(s, '^\\[[\\s\\S]*\\]$') AS is_list, regexp_extract(s, '^\\[([\\s\\S]*)\\]$', 1) AS inner_txt FROM vs),
ve0 AS (SELECT *, list_transform(string_split(inner_txt, ','), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')) AS el FROM vl),
ve AS (SELECT *, CASE WHEN NOT is_list THEN NULL WHEN regexp_replace(inner_txt, '\\s', '', 'g') = '' THEN []::VARCHAR[]
                      WHEN el[-1] = '' THEN el[1:len(el)-1] ELSE el END AS els FROM ve0),
vc AS (SELECT *, coalesce(list_bool_and(list_transform(els, lambda x: regexp_full_match(x, '{RS.NUMBER_PATTERN}'))), true) AS all_num,
              coalesce(list_bool_and(list_transform(els, lambda x: regexp_full_match(x, '{RS.FLOAT_PATTERN}'))), true) AS all_float
       FROM ve),
vr AS (SELECT *, CASE WHEN els IS NULL OR NOT all_num THEN 'not_list' WHEN len(els) <> 28 THEN 'length'
                      WHEN NOT all_float THEN 'not_float'
                      WHEN abs(list_sum(list_transform(els, lambda x: CAST(x AS DOUBLE))) - 1) >= 1e-4 THEN 'sum' END AS reason
       FROM vc),
vv AS (SELECT {keys}, reason IS NULL AS valid, reason,
              CASE WHEN reason IS NULL THEN list_transform(els, lambda x: CAST(x AS DOUBLE)) END AS probs FROM vr)"""


@register("format_question", "WITH " + S.V_ITEMS + f"\nSELECT itemid, {Q_SQL} AS question FROM v_items")
def format_question_q(spark, sf):
    """Q2: question text of every item."""
    return V.v_items(spark, sf).select("itemid", TX.format_question("arg1", "arg2").alias("question"))


@register("prompt_messages", EX_SQL + f""",
exr AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY idx) AS rn FROM ex),
q AS (SELECT itemid, inst_lang AS lang, {Q_SQL} AS question FROM v_items WHERE split <> 'train'),
nex AS (SELECT lang, count(*) AS c FROM exr WHERE rn <= {K_EXAMPLES} GROUP BY lang),
msgs AS (
  SELECT q.itemid, 0 AS pos, 'user' AS role, p.prompt AS content FROM q LEFT JOIN prompts p ON p.lang = q.lang
  UNION ALL SELECT q.itemid, 1, 'assistant', p.ack FROM q LEFT JOIN prompts p ON p.lang = q.lang
  UNION ALL SELECT q.itemid, 2 + 2 * (e.rn - 1), 'user', e.question FROM q JOIN exr e ON e.lang = q.lang AND e.rn <= {K_EXAMPLES}
  UNION ALL SELECT q.itemid, 3 + 2 * (e.rn - 1), 'assistant', e.answer FROM q JOIN exr e ON e.lang = q.lang AND e.rn <= {K_EXAMPLES}
  UNION ALL SELECT q.itemid, 2 + 2 * coalesce(n.c, 0), 'user', q.question FROM q LEFT JOIN nex n ON n.lang = q.lang)
SELECT itemid, CAST(pos AS INTEGER) AS pos, role, md5(content) AS content_md5 FROM msgs""")
def prompt_messages(spark, sf):
    """Q1 + J5 + U4: message arrays with the first k exemplars of the item's language."""
    items = V.v_items(spark, sf).filter(F.col("split") != "train").select(
        "itemid", F.col("inst_lang").alias("lang"), TX.format_question("arg1", "arg2").alias("question"))
    m = PR.build_messages(items, prompt_table(spark), exemplars(spark, sf), K_EXAMPLES)
    x = m.select("itemid", F.posexplode("messages").alias("pos", "msg"))
    return x.select("itemid", "pos", F.col("msg.role").alias("role"), F.md5("msg.content").alias("content_md5"))


RESP_SQL = "WITH " + S.V_RESPONSES + ",\n"


@register("validate_response", RESP_SQL + _validate_sql("v_responses", "response", "itemid, attempt") + """
SELECT itemid, attempt, valid, reason FROM vv""")
def validate_response_q(spark, sf):
    """Q3: validity and reason of every response."""
    v = PR.validate(V.v_responses(spark, sf))
    return v.select("itemid", "attempt", "valid", "reason")


FIRST_SQL = RESP_SQL + _validate_sql("v_responses", "response", "itemid, attempt") + """,
fv AS (SELECT itemid, min(attempt) AS attempt FROM vv WHERE valid AND attempt <= 5 GROUP BY itemid),
firstv AS (SELECT i.itemid, f.attempt, v.probs FROM resp_items i LEFT JOIN fv f ON f.itemid = i.itemid
          LEFT JOIN vv v ON v.itemid = f.itemid AND v.attempt = f.attempt)
"""


@register("first_valid_response", FIRST_SQL + "SELECT itemid, attempt FROM firstv")
def first_valid_response(spark, sf):
    """Q4: first valid of at most five attempts; NULL when none is valid."""
    f = PR.first_valid(V.v_responses(spark, sf), ["itemid"])
    return f.select("itemid", "attempt")


@register("response_js_by_level", "WITH " + S.V_RESPONSES + ",\n" + S.VOTE_DIST_LONG + ",\n"
          + _validate_sql("v_responses", "response", "itemid, attempt") + """,
fv AS (SELECT itemid, min(attempt) AS attempt FROM vv WHERE valid AND attempt <= 5 GROUP BY itemid),
firstv AS (SELECT i.itemid, f.attempt, v.probs FROM resp_items i LEFT JOIN fv f ON f.itemid = i.itemid
          LEFT JOIN vv v ON v.itemid = f.itemid AND v.attempt = f.attempt),
pl AS (SELECT itemid, CAST(generate_subscripts(probs, 1) - 1 AS INTEGER) AS l3_idx, unnest(probs) AS p
       FROM firstv WHERE probs IS NOT NULL),
pt AS (SELECT pl.itemid, pl.p, t.l3_idx, t.l2_idx, t.l1_idx FROM pl JOIN tax t ON t.l3_idx = pl.l3_idx),
pd AS (SELECT itemid, 3 AS level, l3_idx AS idx, p FROM pt
       UNION ALL SELECT itemid, 2, l2_idx, sum(p) FROM pt GROUP BY itemid, l2_idx
       UNION ALL SELECT itemid, 1, l1_idx, sum(p) FROM pt GROUP BY itemid, l1_idx),
ps AS (SELECT *, (p + 0.001) / sum(p + 0.001) OVER (PARTITION BY itemid, level) AS q FROM pd),
gs AS (SELECT *, (p + 0.001) / sum(p + 0.001) OVER (PARTITION BY itemid, level) AS g FROM dist WHERE side = 0),
pq AS (SELECT ps.itemid, ps.level, gs.g, ps.q, (gs.g + ps.q) / 2 AS m FROM ps
       JOIN gs ON gs.itemid = ps.itemid AND gs.level = ps.level AND gs.idx = ps.idx),
js AS (SELECT itemid, level, sqrt(greatest(0, sum(g * ln(g / m) + q * ln(q / m)) / ln(2) / 2)) AS js
       FROM pq GROUP BY itemid, level),
lv AS (SELECT * FROM (VALUES (1), (2), (3)) t(level))
SELECT CAST(lv.level AS INTEGER) AS level, round(avg(js.js), 6) AS mean_js,
       (SELECT count(*) FROM firstv WHERE probs IS NULL) AS bad_outputs
FROM lv LEFT JOIN js ON js.level = lv.level GROUP BY lv.level""")
def response_js_by_level(spark, sf):
    """Q5 + Q6 + A9: first valid answers rolled up and scored per level."""
    first = PR.first_valid(V.v_responses(spark, sf), ["itemid"])
    gold = crowd_pairs(spark, sf).select("itemid", "gold_l1", "gold_l2", "gold_l3")
    return PR.score_responses(first, gold, ["itemid"])


@register("valid_response_mean", RESP_SQL + _validate_sql("v_responses", "response", "itemid, attempt") + """,
lv2 AS (SELECT itemid, attempt, valid, CASE WHEN valid THEN list_sum(list_transform(probs, lambda x: x * x)) END AS v FROM vv)
SELECT attempt, round(avg(CASE WHEN valid THEN v END), 6) AS mean_distance,
       count(*) FILTER (WHERE NOT valid) AS bad_outputs FROM lv2 GROUP BY attempt""")
def valid_response_mean(spark, sf):
    """Per attempt, mean of a per-response value over valid responses
    only (here the squared norm of the answer) and the count of bad ones."""
    v = PR.validate(V.v_responses(spark, sf))
    v = v.withColumn("v", F.aggregate(F.transform("probs", lambda x: x * x), F.lit(0.0), lambda a, x: a + x))
    return M.valid_mean(v, "v", "valid", ["attempt"])


@register("exemplar_audit", EX_SQL + "," + _validate_sql("ex", "answer", "lang, idx") + """
SELECT coalesce(reason, 'valid') AS reason, count(*) AS n FROM vv GROUP BY ALL""")
def exemplar_audit(spark, sf):
    """Q7: exemplar answers checked with the response validator, by reason."""
    return PR.audit_exemplars(exemplars(spark, sf))
