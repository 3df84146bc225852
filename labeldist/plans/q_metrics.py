"""Check queries for metrics and cluster evaluation (A1-A12, J2, J4, M10,
S8, S9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labeldist.functions import distributions as D
from labeldist.operators import clustering as CL
from labeldist.operators import metrics as M
from labeldist.plans import sqlviews as S
from labeldist.plans import views as V
from labeldist.plans.q_distributions import CROWD_JS_SQL, crowd_js, crowd_pairs
from labeldist.plans.registry import register
from labeldist.session import scratch_path
from labeldist.sources import sinks as K

WITH_CL = "WITH " + S.V_CLUSTERS + ",\n"
WITH_RUNS = "WITH " + S.V_RUNS + ",\n"

# best 4 x 4 mapping by enumerating the 24 permutations (ties: smallest sense sequence)
ASSIGN_SQL = WITH_CL + """cells AS (SELECT cluster, sense, count(*) AS n FROM v_clusters GROUP BY ALL),
s AS (SELECT DISTINCT sense FROM cells),
perm AS (SELECT a.sense AS s0, b.sense AS s1, c.sense AS s2, d.sense AS s3 FROM s a, s b, s c, s d
         WHERE a.sense NOT IN (b.sense, c.sense, d.sense) AND b.sense NOT IN (c.sense, d.sense) AND c.sense <> d.sense),
score AS (SELECT p.*, (SELECT coalesce(sum(n), 0) FROM cells
                       WHERE (cluster = 0 AND sense = p.s0) OR (cluster = 1 AND sense = p.s1)
                          OR (cluster = 2 AND sense = p.s2) OR (cluster = 3 AND sense = p.s3)) AS total
          FROM perm p),
best AS (SELECT * FROM score ORDER BY total DESC, s0, s1, s2, s3 LIMIT 1),
mapping AS (SELECT CAST(0 AS BIGINT) AS cluster, s0 AS sense FROM best UNION ALL SELECT 1, s1 FROM best
            UNION ALL SELECT 2, s2 FROM best UNION ALL SELECT 3, s3 FROM best),
mapped AS (SELECT v.vec_id, v.sense, v.cluster, m.sense AS predicted_sense
           FROM v_clusters v LEFT JOIN mapping m ON m.cluster = v.cluster)
"""


def clusters(spark: SparkSession, sf: str):
    return V.v_clusters(spark, sf)


@register("contingency_table", WITH_CL.rstrip(",\n") + """
SELECT cluster, count(*) FILTER (WHERE sense = 0) AS s0, count(*) FILTER (WHERE sense = 1) AS s1,
       count(*) FILTER (WHERE sense = 2) AS s2, count(*) FILTER (WHERE sense = 3) AS s3
FROM v_clusters GROUP BY cluster""")
def contingency_table(spark, sf):
    """A1: cluster x sense cross-tab with the label values given up front."""
    return CL.contingency_wide(clusters(spark, sf), "cluster", "sense", [0, 1, 2, 3],
                               ["s0", "s1", "s2", "s3"])


@register("cluster_assignment", ASSIGN_SQL + "SELECT cluster, sense FROM mapping")
def cluster_assignment(spark, sf):
    """A2: optimal one-to-one cluster -> sense mapping."""
    return CL.assign_clusters(CL.contingency(clusters(spark, sf)))


@register("cluster_mapping_join", ASSIGN_SQL + "SELECT vec_id, sense, cluster, predicted_sense FROM mapped")
def cluster_mapping_join(spark, sf):
    """Predicted sense per instance via the broadcast mapping."""
    mapped, _, _ = CL.evaluate_clusters(clusters(spark, sf))
    return mapped.select("vec_id", "sense", "cluster", "predicted_sense")


@register("accuracy_overall", ASSIGN_SQL + """
SELECT round(avg(CASE WHEN predicted_sense = sense THEN 1.0E0 ELSE 0.0E0 END) * 100, 6) AS accuracy FROM mapped""")
def accuracy_overall(spark, sf):
    """A3 (and M10 on fixed clusters): overall accuracy in percent."""
    _, overall, _ = CL.evaluate_clusters(clusters(spark, sf))
    return overall


@register("accuracy_by_label", ASSIGN_SQL + """
SELECT sense, round(avg(CASE WHEN predicted_sense = sense THEN 1.0E0 ELSE 0.0E0 END) * 100, 6) AS accuracy
FROM mapped WHERE sense IS NOT NULL GROUP BY sense""")
def accuracy_by_label(spark, sf):
    """A4: accuracy per gold sense."""
    _, _, per = CL.evaluate_clusters(clusters(spark, sf))
    return per


@register("cluster_eval_fixed", ASSIGN_SQL + """
SELECT count(*) AS n, count(*) FILTER (WHERE predicted_sense = sense) AS matched,
       round(avg(CASE WHEN predicted_sense = sense THEN 1.0E0 ELSE 0.0E0 END) * 100, 6) AS accuracy FROM mapped""")
def cluster_eval_fixed(spark, sf):
    """M10 end to end on deterministic clusters: rows, matched rows, accuracy."""
    mapped, _, _ = CL.evaluate_clusters(clusters(spark, sf))
    hit = F.coalesce(F.col("predicted_sense") == F.col("sense"), F.lit(False))
    return mapped.agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("matched"),
                      F.round(F.avg(hit.cast("double")) * 100.0, 6).alias("accuracy"))


@register("weighted_prf", WITH_RUNS + """x AS (
  SELECT run, gold AS cls, 1 AS g, 0 AS p, CASE WHEN pred = gold THEN 1 ELSE 0 END AS tp FROM v_runs
  UNION ALL SELECT run, pred, 0, 1, 0 FROM v_runs),
per AS (SELECT run, cls, sum(g) AS support, sum(p) AS npred, sum(tp) AS tp FROM x WHERE cls IS NOT NULL GROUP BY ALL),
pr AS (SELECT run, support, CASE WHEN npred > 0 THEN tp / npred ELSE 0 END AS p,
              CASE WHEN support > 0 THEN tp / support ELSE 0 END AS r FROM per),
f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM pr)
SELECT run, round(sum(p * support) / sum(support), 6) AS precision, round(sum(r * support) / sum(support), 6) AS recall,
       round(sum(f * support) / sum(support), 6) AS f1 FROM f GROUP BY run""")
def weighted_prf(spark, sf):
    """A5: support-weighted precision / recall / F1 per run."""
    return M.weighted_prf(V.v_runs(spark, sf), "gold", "pred", ["run"])


@register("batch_mean_js", CROWD_JS_SQL + """,
b AS (SELECT level, (row_number() OVER (PARTITION BY level ORDER BY itemid) - 1) // 16 AS batch_idx, js FROM js),
bm AS (SELECT level, batch_idx, avg(js) AS m FROM b GROUP BY ALL)
SELECT CAST(level AS INTEGER) AS level, round(avg(m), 6) AS batch_mean FROM bm GROUP BY level""")
def batch_mean_js(spark, sf):
    """Mean of batch means (batches of 16 in item order) per level."""
    return M.mean_of_batch_means(crowd_js(spark, sf), "js", ["itemid"], ["level"])


@register("sampled_batch_js", CROWD_JS_SQL + """,
b AS (SELECT level, (row_number() OVER (PARTITION BY level ORDER BY itemid) - 1) // 16 AS batch_idx, js FROM js)
SELECT CAST(level AS INTEGER) AS level, CAST(batch_idx AS BIGINT) AS batch_idx, round(avg(js), 6) AS batch_mean
FROM b WHERE batch_idx % 10 = 0 GROUP BY ALL""")
def sampled_batch_js(spark, sf):
    """Batch means of every tenth batch."""
    return M.sampled_batches(crowd_js(spark, sf), "js", ["itemid"], ["level"])


def _argmax_sql() -> str:
    return """r AS (SELECT itemid, side, level, idx,
                  row_number() OVER (PARTITION BY itemid, side, level ORDER BY n DESC, idx) AS rk FROM cdist),
am AS (SELECT itemid, level, max(CASE WHEN side = 0 THEN idx END) AS gold_idx,
              max(CASE WHEN side = 1 THEN idx END) AS pred_idx FROM r WHERE rk = 1 GROUP BY ALL)"""


def crowd_eval_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Per item and level: JS distance, gold / predicted argmax, and a
    (train, test) language pair assigned from the item id."""
    p = crowd_pairs(spark, sf)
    langs = F.array(*[F.lit(x) for x in ("en", "de", "fr", "cs")])
    per = F.array(*[F.struct(
        F.lit(lv).alias("level"),
        D.js_distance(D.smooth(f"gold_l{lv}"), D.smooth(f"pred_l{lv}")).alias("js"),
        D.argmax_idx(f"gc_l{lv}").alias("gold"), D.argmax_idx(f"pc_l{lv}").alias("pred")) for lv in (1, 2, 3)])
    return p.select(
        "itemid",
        F.element_at(langs, (F.col("itemid") % 4 + 1).cast("int")).alias("train_lang"),
        F.element_at(langs, ((F.col("itemid") / 4).cast("long") % 4 + 1).cast("int")).alias("test_lang"),
        F.inline(per))


@register("cross_lingual_matrix", CROWD_JS_SQL + "," + _argmax_sql() + """
SELECT ['en','de','fr','cs'][itemid % 4 + 1] AS train_lang, ['en','de','fr','cs'][(itemid // 4) % 4 + 1] AS test_lang,
       CAST(js.level AS INTEGER) AS level, round(avg(js), 6) AS mean_js,
       round(avg(CASE WHEN gold_idx = pred_idx THEN 1.0E0 ELSE 0.0E0 END) * 100, 6) AS accuracy
FROM js JOIN am USING (itemid, level) GROUP BY ALL""")
def cross_lingual_matrix(spark, sf):
    """A10: train-language x test-language matrix per level."""
    return M.cross_eval(crowd_eval_rows(spark, sf), "js", "gold", "pred")


@register("run_summary", WITH_RUNS + """acc AS (
  SELECT run, avg(CASE WHEN pred = gold THEN 1.0E0 ELSE 0.0E0 END) * 100 AS accuracy FROM v_runs GROUP BY run)
SELECT 'flat' AS arch, round(avg(accuracy), 6) AS mean_accuracy, round(stddev_samp(accuracy), 6) AS std_accuracy,
       count(*) AS n_runs FROM acc""")
def run_summary(spark, sf):
    """Three repeated runs summarised (mean, sample std)."""
    acc = M.accuracy(V.v_runs(spark, sf), "gold", "pred", ["run"], digits=None)
    return M.run_summary(acc.withColumn("arch", F.lit("flat")), "accuracy", ["arch"])


@register("distinct_labels", WITH_CL.rstrip(",\n") + " SELECT DISTINCT sense FROM v_clusters WHERE sense IS NOT NULL")
def distinct_labels(spark, sf):
    """Distinct gold labels."""
    return M.distinct_labels(clusters(spark, sf), "sense")


@register("gold_pred_join", "WITH " + S.VOTE_DIST_LONG + "," + _argmax_sql() + """
SELECT itemid, CAST(level AS INTEGER) AS level, CAST(gold_idx AS INTEGER) AS gold_idx,
       CAST(pred_idx AS INTEGER) AS pred_idx, gold_idx = pred_idx AS correct FROM am""")
def gold_pred_join(spark, sf):
    """Gold and predicted labels matched on (instance, level)."""
    p = crowd_pairs(spark, sf)
    lv = lambda pre, out: F.inline(F.array(*[
        F.struct(F.lit(l).alias("level"), D.argmax_idx(f"{pre}_l{l}").alias(out)) for l in (1, 2, 3)]))
    gold = p.select("itemid", lv("gc", "gold_idx"))
    pred = p.select("itemid", lv("pc", "pred_idx"))
    j = M.align_predictions(gold, pred, ["itemid", "level"])
    return j.withColumn("correct", F.col("gold_idx") == F.col("pred_idx"))


@register("predictions_roundtrip", WITH_RUNS.rstrip(",\n") + """
SELECT 'en' AS train_lang, 'de' AS test_lang, 'flat' AS arch, run, vec_id, gold, pred FROM v_runs""")
def predictions_roundtrip(spark, sf):
    """Predictions written with the run config as partitions, read back."""
    path = scratch_path(spark, "predictions")
    r = V.v_runs(spark, sf).select(F.lit("en").alias("train_lang"), F.lit("de").alias("test_lang"),
                                   F.lit("flat").alias("arch"), "run", "vec_id", "gold", "pred")
    K.write_predictions(r, path)
    return spark.read.parquet(path).select("train_lang", "test_lang", "arch", "run", "vec_id", "gold", "pred")


@register("metrics_long", WITH_RUNS.rstrip(",\n") + """
SELECT concat('run-', CAST(run AS VARCHAR)) AS run_id, 'Testing' AS mode, 1 AS level, 'accuracy' AS name, 0 AS step,
       round(avg(CASE WHEN pred = gold THEN 1.0E0 ELSE 0.0E0 END) * 100, 6) AS value
FROM v_runs GROUP BY run""")
def metrics_long(spark, sf):
    """One metrics append per run, read back as one long table."""
    path = scratch_path(spark, "metrics")
    acc = M.accuracy(V.v_runs(spark, sf), "gold", "pred", ["run"]).cache()
    for run in (1, 2, 3):
        row = acc.filter(F.col("run") == run).select(
            F.concat(F.lit("run-"), F.col("run").cast("string")).alias("run_id"), F.lit("Testing").alias("mode"),
            F.lit(1).alias("level"), F.lit("accuracy").alias("name"), F.lit(0).alias("step"),
            F.col("accuracy").alias("value"),
            F.create_map(F.lit("arch"), F.lit("flat")).alias("config"))
        K.append_metrics(row, path)
    acc.unpersist()
    return spark.read.parquet(path).select("run_id", "mode", "level", "name", "step", "value")
