"""Check queries for the distribution core."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labeldist import taxonomy as tx
from labeldist.functions import distributions as D
from labeldist.operators import distributions as OD
from labeldist.plans import sqlviews as S
from labeldist.plans import views as V
from labeldist.plans.registry import register


def crowd_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Both vote groups per item at all three levels, from ONE aggregation.

    ``gold_l1..3`` / ``pred_l1..3``: normalised (D1) and rolled up (D2, D3);
    ``gc_l1..3`` / ``pc_l1..3``: the raw counts rolled up.  One aggregation
    over the raw vote rows builds both 29-label count arrays; everything after
    it is per-row array arithmetic, and Catalyst prunes the arrays a query
    does not use.
    """
    d = OD.vote_distribution(V.vote_rows(spark, sf), ["itemid"], "l3_idx", tx.N_L3 + 1,
                             side_col="side", out_prefix="votes")
    d = d.withColumns({"g28": F.slice("votes_0", 1, tx.N_L3), "p28": F.slice("votes_1", 1, tx.N_L3)})  # P8
    d = OD.with_levels_many(d, [("g28", "gold", True), ("p28", "pred", True),
                                ("g28", "gc", False), ("p28", "pc", False)])
    return d.drop("votes_0", "votes_1", "g28", "p28")


# ------------------------------------------------------------------ A6 / slice

CROWD_JS_SQL = "WITH " + S.VOTE_DIST_LONG + ",\n" + S.smoothed("dist", "sm", "itemid, side, level") + """,
pq AS (
  SELECT a.itemid, a.level, a.ps AS p, b.ps AS q, (a.ps + b.ps) / 2 AS m
  FROM sm a JOIN sm b ON a.itemid = b.itemid AND a.level = b.level AND a.idx = b.idx
  WHERE a.side = 0 AND b.side = 1),
js AS (
  SELECT itemid, level, sqrt(greatest(0, sum(p * ln(p / m) + q * ln(q / m)) / ln(2) / 2)) AS js
  FROM pq GROUP BY itemid, level)
"""


def crowd_js(spark: SparkSession, sf: str) -> DataFrame:
    """Per-item JS distance at every level ``(itemid, level, js)``."""
    return OD.distances_by_level(crowd_pairs(spark, sf), "gold", "pred", "js", keys=["itemid"], out="js")


@register("mean_js_by_level", CROWD_JS_SQL + """
SELECT CAST(level AS INTEGER) AS level, round(avg(js), 6) AS mean_js FROM js GROUP BY level""")
def mean_js_by_level(spark: SparkSession, sf: str) -> DataFrame:
    """Minimal slice: mean JS distance per taxonomy level between the two
    halves of the crowd (votes -> 28-array -> roll-up -> smooth -> JS -> mean)."""
    pairs = crowd_pairs(spark, sf)
    long = OD.distances_by_level(pairs, "gold", "pred", "js")
    return OD.mean_distance(long, out="mean_js")


# ------------------------------------------------------------------ helpers

def explode_long(df: DataFrame, keys: list[str], arr: str, idx: str = "idx",
                 val: str = "value", digits: int | None = 6) -> DataFrame:
    """Array column -> one row per element ``(keys..., idx, value)``.

    Array-valued results are compared in long form (both engines print
    arrays differently)."""
    out = df.select(*keys, F.posexplode(arr).alias(idx, "_v"))
    v = F.round("_v", digits) if digits is not None else F.col("_v")
    return out.select(*keys, F.col(idx).cast("int").alias(idx), v.alias(val))


def literals(spark: SparkSession, sf: str) -> DataFrame:
    lit = V.v_literals(spark, sf)
    return lit.select("itemid", D.parse_distribution("dist").alias("m"),
                      D.parse_list("langs").alias("langs"))


LIT_MAP = ("lit AS (SELECT itemid, json_transform(replace(dist, chr(39), '\"'), "
           "'\"MAP(VARCHAR, DOUBLE)\"') AS m, json_transform(replace(langs, chr(39), '\"'), "
           "'[\"VARCHAR\"]') AS langs FROM v_literals)")
WITH_LIT = "WITH " + S.V_LITERALS + ",\n" + LIT_MAP + "\n"
WITH_VOTES = "WITH " + S.VOTE_DIST_LONG + ",\n"


# ------------------------------------------------------------------ P4-P9

@register("parse_distribution", WITH_LIT + """
SELECT itemid, unnest(map_keys(m)) AS label, unnest(map_values(m)) AS value FROM lit""")
def parse_distribution_q(spark, sf):
    return literals(spark, sf).select("itemid", F.explode("m").alias("label", "value"))


@register("parse_list_literal", WITH_LIT + """
SELECT itemid, CAST(generate_subscripts(langs, 1) - 1 AS INTEGER) AS pos, unnest(langs) AS lang FROM lit""")
def parse_list_literal_q(spark, sf):
    return literals(spark, sf).select("itemid", F.posexplode("langs").alias("pos", "lang"))


@register("label_vocab", WITH_LIT + """
SELECT DISTINCT unnest(map_keys(m)) AS label FROM lit""")
def label_vocab_q(spark, sf):
    """The label vocabulary over all rows (not only the first)."""
    return OD.label_vocab(literals(spark, sf), "m")


ALIGN_VOCAB = ["norel", "s0", "s1", "s2"]


@register("align_distribution", WITH_LIT + ", al AS (SELECT itemid, " + ", ".join(
    f"m['{k}'] AS v{i}" for i, k in enumerate(ALIGN_VOCAB)) + " FROM lit)\n" + "\nUNION ALL ".join(
    f"SELECT itemid, {i} AS idx, round(v{i}, 6) AS value FROM al" for i in range(len(ALIGN_VOCAB))))
def align_distribution_q(spark, sf):
    """Map -> fixed-order array over a vocabulary (absent label -> NULL)."""
    a = literals(spark, sf).select("itemid", D.align_distribution("m", ALIGN_VOCAB).alias("arr"))
    return explode_long(a, ["itemid"], "arr")


@register("exclude_label_mass", WITH_LIT + """,
kv AS (SELECT itemid, unnest(map_keys(m)) AS k, unnest(map_values(m)) AS v FROM lit)
SELECT itemid, round(sum(CASE WHEN k <> 'norel' THEN v ELSE 0 END), 6) AS mass FROM kv GROUP BY itemid""")
def exclude_label_mass_q(spark, sf):
    """Mass left after dropping the excluded label."""
    m = literals(spark, sf).select("itemid", D.exclude_label("m").alias("m"))
    return m.select("itemid", F.round(F.aggregate(F.map_values("m"), F.lit(0.0),
                                                  lambda a, x: a + x), 6).alias("mass"))


PROB_TEXT_SQL = ("CASE WHEN event_id % 5 = 0 THEN '' WHEN event_id % 5 = 1 THEN concat('x', CAST(value AS VARCHAR)) "
                 "ELSE CAST(value AS VARCHAR) END")


@register("safe_cast_prob", f"""
SELECT event_id, TRY_CAST(nullif({PROB_TEXT_SQL}, '') AS DOUBLE) AS prob FROM events""")
def safe_cast_prob_q(spark, sf):
    """Label text -> double; empty and unparseable text -> NULL."""
    e = V.table(spark, sf, "events")
    txt = ("CASE WHEN event_id % 5 = 0 THEN '' WHEN event_id % 5 = 1 THEN concat('x', CAST(value AS STRING)) "
           "ELSE CAST(value AS STRING) END")
    return e.select("event_id", D.to_prob(txt).alias("prob"))


# ------------------------------------------------------------------ D1-D6, J3

def _level_long_sql(level: int, col: str = "p", side: int = 0) -> str:
    return WITH_VOTES.rstrip(",\n") + f"""
SELECT itemid, CAST(idx AS INTEGER) AS idx, round({col}, 6) AS value FROM dist
WHERE side = {side} AND level = {level}"""


@register("l1_normalize", _level_long_sql(3))
def l1_normalize_q(spark, sf):
    return explode_long(crowd_pairs(spark, sf), ["itemid"], "gold_l3")


@register("rollup_l2", _level_long_sql(2))
def rollup_l2_q(spark, sf):
    return explode_long(crowd_pairs(spark, sf), ["itemid"], "gold_l2")


@register("rollup_l1", _level_long_sql(1))
def rollup_l1_q(spark, sf):
    return explode_long(crowd_pairs(spark, sf), ["itemid"], "gold_l1")


@register("taxonomy_mass_rollup", WITH_VOTES + """
m AS (SELECT d.p, t.l1, t.l2, t.l3 FROM dist d JOIN tax t ON d.idx = t.l3_idx WHERE d.side = 0 AND d.level = 3)
SELECT l1, l2, l3, round(sum(p), 6) AS mass FROM m GROUP BY ROLLUP (l1, l2, l3)""")
def taxonomy_mass_rollup_q(spark, sf):
    """Corpus-wide mass per sense at every level in one pass.

    The 28 per-sense totals are summed over all items in ONE aggregation
    (partial sums per task, no explode of the item rows); only the resulting
    28 rows are joined with the taxonomy (broadcast: fixed 28 rows) and
    rolled up over ``(l1, l2, l3)``."""
    p = crowd_pairs(spark, sf)
    sums = p.agg(F.expr("array(" + ", ".join(f"sum(gold_l3[{i}])" for i in range(tx.N_L3)) + ")").alias("m"))
    long = sums.select(F.posexplode("m").alias("l3_idx", "p"))
    j = long.join(F.broadcast(tx.taxonomy_df(spark)), "l3_idx")
    return j.rollup("l1", "l2", "l3").agg(F.round(F.sum("p"), 6).alias("mass"))


@register("majority_label", WITH_VOTES + """
r AS (SELECT itemid, level, idx, row_number() OVER (PARTITION BY itemid, level ORDER BY n DESC, idx) AS rk
      FROM cdist WHERE side = 0),
nm AS (SELECT r.itemid, r.level,
              CASE r.level WHEN 3 THEN (SELECT any_value(l3) FROM tax WHERE l3_idx = r.idx)
                           WHEN 2 THEN (SELECT any_value(l2) FROM tax WHERE l2_idx = r.idx)
                           ELSE (SELECT any_value(l1) FROM tax WHERE l1_idx = r.idx) END AS name
       FROM r WHERE rk = 1)
SELECT itemid, max(CASE WHEN level = 1 THEN name END) AS majority_l1,
       max(CASE WHEN level = 2 THEN name END) AS majority_l2,
       max(CASE WHEN level = 3 THEN name END) AS majority_l3
FROM nm GROUP BY itemid""")
def majority_label_q(spark, sf):
    """First-maximum label per level (on counts: exact, same argmax)."""
    c = crowd_pairs(spark, sf)
    return c.select("itemid", *[D.argmax_label(f"gc_l{lv}", tx.LEVEL_NAMES[lv]).alias(f"majority_l{lv}")
                                for lv in (1, 2, 3)])


@register("argmax_pairs", WITH_VOTES + """
r AS (SELECT itemid, side, level, idx, row_number() OVER (PARTITION BY itemid, side, level ORDER BY n DESC, idx) AS rk
      FROM cdist)
SELECT itemid, CAST(level AS INTEGER) AS level,
       CAST(max(CASE WHEN side = 0 THEN idx END) AS INTEGER) AS gold_idx,
       CAST(max(CASE WHEN side = 1 THEN idx END) AS INTEGER) AS pred_idx
FROM r WHERE rk = 1 GROUP BY itemid, level""")
def argmax_pairs_q(spark, sf):
    """0-based argmax of gold and predicted vectors per level."""
    c = crowd_pairs(spark, sf)
    per = F.array(*[F.struct(F.lit(lv).alias("level"), D.argmax_idx(f"gc_l{lv}").alias("gold_idx"),
                             D.argmax_idx(f"pc_l{lv}").alias("pred_idx")) for lv in (1, 2, 3)])
    return c.select("itemid", F.inline(per))


@register("complete_level3", WITH_VOTES + """
one AS (SELECT l2_idx FROM tax GROUP BY l2_idx HAVING count(*) = 1)
SELECT d.itemid, t.l3 AS sense, round(d.p, 6) AS value
FROM dist d JOIN one o ON d.idx = o.l2_idx JOIN tax t ON t.l2_idx = o.l2_idx
WHERE d.side = 0 AND d.level = 2""")
def complete_level3_q(spark, sf):
    """Single-child level-2 senses carried down to level 3."""
    names = F.array(*[F.lit(tx.L3_NAMES[tx.groups(2)[i][0]]) for i in tx.single_child_l2()])
    c = crowd_pairs(spark, sf).select("itemid", F.arrays_zip(
        names.alias("sense"), D.complete_level3("gold_l2").alias("value")).alias("z"))
    return c.select("itemid", F.inline("z")).select("itemid", "sense", F.round("value", 6).alias("value"))


# ------------------------------------------------------------------ D7-D12

@register("shift_normalize", WITH_VOTES + """
s AS (SELECT a.itemid, a.idx, b.n - a.n AS s FROM cdist a JOIN cdist b
      ON a.itemid = b.itemid AND a.level = b.level AND a.idx = b.idx
      WHERE a.side = 0 AND b.side = 1 AND a.level = 3),
sh AS (SELECT itemid, idx, s - min(s) OVER (PARTITION BY itemid) AS v FROM s),
tt AS (SELECT itemid, idx, v, sum(v) OVER (PARTITION BY itemid) AS t FROM sh)
SELECT itemid, CAST(idx AS INTEGER) AS idx, round(CASE WHEN t = 0 THEN v ELSE v / t END, 6) AS value FROM tt""")
def shift_normalize_q(spark, sf):
    """D7 on signed score vectors (second group minus gold counts)."""
    c = crowd_pairs(spark, sf).select(
        "itemid", D.shift_normalize("zip_with(pc_l3, gc_l3, (a, b) -> a - b)").alias("s"))
    return explode_long(c, ["itemid"], "s")


@register("smooth_margin", WITH_VOTES + S.smoothed("dist", "sm", "itemid, side, level") + """
SELECT itemid, CAST(idx AS INTEGER) AS idx, round(ps, 6) AS value FROM sm WHERE side = 0 AND level = 3""")
def smooth_margin_q(spark, sf):
    """Margin 0.001 then renormalise."""
    c = crowd_pairs(spark, sf).select("itemid", D.smooth("gold_l3").alias("s"))
    return explode_long(c, ["itemid"], "s")


SCORES_SQL = WITH_VOTES + S.smoothed("dist", "gs", "itemid, side, level") + """,
q0 AS (SELECT itemid, level, idx, n - min(n) OVER (PARTITION BY itemid, level) AS v FROM cdist WHERE side = 1),
q1 AS (SELECT itemid, level, idx, CASE WHEN sum(v) OVER w = 0 THEN v ELSE v / sum(v) OVER w END AS qn
       FROM q0 WINDOW w AS (PARTITION BY itemid, level)),
q2 AS (SELECT *, (qn + 0.001) / sum(qn + 0.001) OVER (PARTITION BY itemid, level) AS q FROM q1),
pq AS (SELECT g.itemid, g.level, g.p AS p0, g.ps AS p, q2.qn, q2.q, (g.ps + q2.q) / 2 AS m
       FROM gs g JOIN q2 ON g.itemid = q2.itemid AND g.level = q2.level AND g.idx = q2.idx
       WHERE g.side = 0)
"""


@register("kl_distance", SCORES_SQL + """
SELECT itemid, CAST(level AS INTEGER) AS level, round(sum(p * ln(p / q)) / ln(2), 6) AS kl
FROM pq GROUP BY itemid, level""")
def kl_distance_q(spark, sf):
    """KL(smoothed gold || smoothed shifted scores) in bits, per level."""
    d = crowd_pairs(spark, sf)
    long = OD.distances_by_level(d, "gold", "pc", "kl_scores", keys=["itemid"], out="kl")
    return long.select("itemid", "level", F.round("kl", 6).alias("kl"))


@register("js_distance", SCORES_SQL + """
SELECT itemid, CAST(level AS INTEGER) AS level,
       round(sqrt(greatest(0, sum(p * ln(p / m) + q * ln(q / m)) / ln(2) / 2)), 6) AS js
FROM pq GROUP BY itemid, level""")
def js_distance_q(spark, sf):
    """JS distance (base 2) of smoothed gold vs smoothed shifted scores."""
    d = crowd_pairs(spark, sf)
    long = OD.distances_by_level(d, "gold", "pc", "js_scores", keys=["itemid"], out="js")
    return long.select("itemid", "level", F.round("js", 6).alias("js"))


@register("hellinger_distance", SCORES_SQL + """
SELECT itemid, CAST(level AS INTEGER) AS level,
       round(sqrt(sum(pow(sqrt(p0) - sqrt(qn), 2))) / sqrt(2), 6) AS hellinger
FROM pq GROUP BY itemid, level""")
def hellinger_distance_q(spark, sf):
    """Hellinger of unsmoothed gold vs shifted-normalised scores."""
    d = crowd_pairs(spark, sf)
    long = OD.distances_by_level(d, "gold", "pc", "hellinger_scores", keys=["itemid"], out="hellinger")
    return long.select("itemid", "level", F.round("hellinger", 6).alias("hellinger"))


@register("guard_distance", WITH_VOTES + """
pq AS (SELECT g.itemid, g.p, q.p AS q FROM dist g JOIN dist q
       ON g.itemid = q.itemid AND g.level = q.level AND g.idx = q.idx
       WHERE g.side = 0 AND q.side = 1 AND g.level = 3),
kl AS (SELECT itemid, sum(CASE WHEN p > 0 AND q > 0 THEN p * ln(p / q) WHEN p = 0 AND q >= 0 THEN 0
                              ELSE CAST('inf' AS DOUBLE) END) / ln(2) AS d FROM pq GROUP BY itemid)
SELECT itemid, CASE WHEN d IS NULL OR isnan(d) OR isinf(d) THEN 1.0E0 ELSE round(d, 6) END AS distance,
       (d IS NULL OR isnan(d) OR isinf(d)) AS guarded FROM kl""")
def guard_distance_q(spark, sf):
    """Unsmoothed KL is infinite where the second group has no vote for a
    gold label; such distances become 1.0 and are flagged."""
    d = crowd_pairs(spark, sf).select("itemid", D.kl_distance("gold_l3", "pred_l3").alias("d"))
    bad = D.is_bad_distance("d")
    return d.select("itemid", F.when(bad, F.lit(1.0)).otherwise(F.round("d", 6)).alias("distance"),
                    bad.alias("guarded"))
