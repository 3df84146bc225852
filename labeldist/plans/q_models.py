"""Check queries for features, clustering jobs and soft-label heads
(M1-M17).  Fitted models are not SQL-expressible; their keys return rows by id
that a wrong fit breaks: the clusters of groups that lie apart, whether each
trained vector's distance is below that of a uniform prediction, whether
components are uncorrelated."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labeldist import taxonomy as tx
from labeldist.functions import distributions as D
from labeldist.operators import clustering as CL
from labeldist.operators import distributions as OD
from labeldist.operators import features as FE
from labeldist.operators import heads as H
from labeldist.operators import metrics as M
from labeldist.plans import sqlviews as S
from labeldist.plans import views as V
from labeldist.plans.registry import register
from labeldist.session import scratch_path


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as ML features, with the 4-sense gold label and a split."""
    e = V.table(spark, sf, "embeddings")
    mod = F.col("vec_id") % 10
    e = e.select("vec_id", (F.col("label") % 4).alias("sense"), "embedding",
                 F.when(mod < 7, "train").when(mod == 7, "dev").otherwise("test").alias("split"))
    return FE.as_features(e)


# --- soft-label heads ---------------------------------------------------------
# Stand-in labels: the level-1 sense is the largest of the first four components of a vector; the sign of the
# fifth says whether its first or its last fine sense gets 0.7 (and the neighbouring one 0.3).

_FIRST_FINE = [min(i for i, p in enumerate(tx.L3_PARENT) if tx.L2_PARENT[p] == c) for c in range(tx.N_L1)]
_LAST_FINE = [max(i for i, p in enumerate(tx.L3_PARENT) if tx.L2_PARENT[p] == c) for c in range(tx.N_L1)]


def soft_labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors with soft labels at three levels (a function of the vector, rolled up the taxonomy) and a split."""
    v = vectors(spark, sf).withColumn("_head", F.slice("embedding", 1, 4)).withColumn(
        "_c", F.array_position("_head", F.array_max("_head")).cast("int"))
    up = F.col("embedding")[4] > 0
    a = F.when(up, F.element_at(F.array(*map(F.lit, _FIRST_FINE)), F.col("_c"))).otherwise(
        F.element_at(F.array(*map(F.lit, _LAST_FINE)), F.col("_c")))
    b = a + F.when(up, 1).otherwise(-1)
    l3 = F.transform(F.sequence(F.lit(0), F.lit(27)), lambda i: F.when(i == a, 0.7).when(i == b, 0.3).otherwise(0.0))
    v = v.withColumn("dist_l3", l3).drop("_head", "_c")
    return v.withColumn("dist_l2", D.rollup_level("dist_l3", 2)).withColumn("dist_l1", D.rollup_level("dist_l2", 1))


REG = 0.01      # weight of squared weights in the checks: 350 vectors of 64 numbers have to do


def _heads_eval(spark, sf, **kw) -> DataFrame:
    d = soft_labelled(spark, sf)
    return _per_vector(H.fit_heads(d.filter(F.col("split") == "train"), **({"reg": REG, "tol": 1e-4} | kw)), d)


def _per_vector(model, d: DataFrame) -> DataFrame:
    """JS distance of every vector and level, and that of a uniform prediction."""
    s = H.score(model, d)
    per = F.array(*[F.struct(F.lit(lv).alias("level"),
                             D.classifier_js(f"dist_l{lv}", f"scores_l{lv}").alias("js"),
                             D.classifier_js(f"dist_l{lv}", f"array_repeat(0D, {tx.LEVEL_SIZES[lv]})").alias("uniform"))
                    for lv in model.levels])
    return s.select("vec_id", "split", F.inline(per))


def _closer(per: DataFrame) -> DataFrame:
    """Per vector and level the distance of a uniform prediction, and whether the heads are closer: for a vector they were
    trained on its own distance, for others the mean of their split (by 3 % at least)."""
    mean = per.groupBy("level", "split").agg((F.avg("js") < 0.97 * F.avg("uniform")).alias("_mean"))
    own = F.when(F.col("split") == "train", F.col("js") < F.col("uniform")).otherwise(F.col("_mean"))
    return per.join(mean, ["level", "split"]).select(
        "vec_id", "level", F.round("uniform", 5).alias("uniform_js"), (own & ~D.is_bad_distance("js")).alias("closer"))


_LABEL_SQL = f"""lab AS (
  SELECT vec_id, vec_id % 10 AS m, CASE WHEN up THEN [{', '.join(map(str, _FIRST_FINE))}][c] ELSE [{', '.join(map(str, _LAST_FINE))}][c] END AS a,
         CASE WHEN up THEN 1 ELSE -1 END AS d
  FROM (SELECT vec_id, embedding[5] > 0 AS up, list_position(embedding[1:4], list_max(embedding[1:4])) AS c FROM embeddings)),
g AS (SELECT vec_id, m, l3_idx, l2_idx, l1_idx, CASE WHEN l3_idx = a THEN 0.7E0 WHEN l3_idx = a + d THEN 0.3E0 ELSE 0E0 END AS p
      FROM lab CROSS JOIN tax),
d AS (SELECT vec_id, m, 3 AS level, l3_idx AS idx, p FROM g
      UNION ALL SELECT vec_id, m, 2, l2_idx, sum(p) FROM g GROUP BY ALL
      UNION ALL SELECT vec_id, m, 1, l1_idx, sum(p) FROM g GROUP BY ALL),
s AS (SELECT vec_id, m, level, (p + 0.001E0) / sum(p + 0.001E0) OVER w AS a, 1E0 / count(*) OVER w AS u
      FROM d WINDOW w AS (PARTITION BY vec_id, level)),
j AS (SELECT vec_id, m, level, sqrt(greatest(0E0, sum(a * ln(2 * a / (a + u)) + u * ln(2 * u / (a + u))) / ln(2E0) / 2)) AS js
      FROM s GROUP BY ALL)"""


def _heads_sql(*levels: int) -> str:
    return "WITH " + S.taxonomy_values() + ",\n" + _LABEL_SQL + f"""
SELECT vec_id, level, round(js, 5) AS uniform_js, true AS closer FROM j WHERE level IN ({', '.join(map(str, levels))})"""


@register("soft_heads_flat", _heads_sql(1, 2, 3))
def soft_heads_flat(spark, sf):
    """Heads side by side on one hidden layer."""
    return _closer(_heads_eval(spark, sf, arch="flat"))


@register("soft_heads_chain", _heads_sql(1, 2, 3))
def soft_heads_chain(spark, sf):
    """Chained heads, trained through the levels above."""
    return _closer(_heads_eval(spark, sf, arch="chain"))


@register("soft_heads_gated", _heads_sql(1, 2, 3))
def soft_heads_gated(spark, sf):
    """Learned gates between the hidden layer and projections of the scores above."""
    return _closer(_heads_eval(spark, sf, arch="gated", tol=1e-5))


@register("soft_heads_gated_tuned", _heads_sql(1, 2, 3))
def soft_heads_gated_tuned(spark, sf):
    """M13 with the gates' starting weights chosen on the validation split (grid search)."""
    d = soft_labelled(spark, sf)
    model, _ = H.tune_gates(d.filter(F.col("split") == "train"), d.filter(F.col("split") == "dev"), reg=REG)
    return _closer(_per_vector(model, d))


@register("soft_heads_single", _heads_sql(3))
def soft_heads_single(spark, sf):
    """Single-level ablation (level 3 only)."""
    return _closer(_heads_eval(spark, sf, arch="flat", levels=[3]))


def _loss_check(spark, sf, loss: str, reg: float = REG) -> DataFrame:
    """M15, per level and split: rows, the mean loss of a uniform prediction, whether the heads' mean loss is below it, and
    whether their mean JS distance is below that of a uniform prediction."""
    d = soft_labelled(spark, sf)
    model = H.fit_heads(d.filter(F.col("split") == "train"), loss=loss, reg=reg, tol=1e-4)
    term = {"l2": "d * d", "l1": "abs(d)", "smooth-l1": "if(abs(d) < 1, 0.5D * d * d, abs(d) - 0.5D)"}[loss]
    def mean(scores: str, lv: int):
        return F.expr(f"aggregate(zip_with({scores}, dist_l{lv}, (s, y) -> transform(array(s - y), d -> {term})[0]), "
                      f"0D, (a, x) -> a + x) / {tx.LEVEL_SIZES[lv]}")
    per = F.array(*[F.struct(
        F.lit(lv).alias("level"), mean(f"scores_l{lv}", lv).alias("loss"),
        mean(f"array_repeat(1D / {tx.LEVEL_SIZES[lv]}, {tx.LEVEL_SIZES[lv]})", lv).alias("uniform"),
        D.classifier_js(f"dist_l{lv}", f"scores_l{lv}").alias("js"),
        D.classifier_js(f"dist_l{lv}", f"array_repeat(0D, {tx.LEVEL_SIZES[lv]})").alias("uniform_js")) for lv in model.levels])
    return H.score(model, d).select("split", F.inline(per)).groupBy("level", "split").agg(
        F.count("loss").alias("n"), F.round(F.avg("uniform"), 6).alias("uniform_loss"),
        (F.avg("loss") < F.avg("uniform")).alias("lower_loss"), (F.avg("js") < F.avg("uniform_js")).alias("closer"))


def _loss_sql(term: str) -> str:
    return "WITH " + S.taxonomy_values() + ",\n" + _LABEL_SQL + f""",
e AS (SELECT level, vec_id, m, 1E0 / count(*) OVER (PARTITION BY vec_id, level) - p AS d FROM d)
SELECT level, CASE WHEN m < 7 THEN 'train' WHEN m = 7 THEN 'dev' ELSE 'test' END AS split, count(DISTINCT vec_id) AS n,
       round(avg({term}), 6) AS uniform_loss, true AS lower_loss, true AS closer
FROM e GROUP BY ALL"""


@register("soft_loss_l2", _loss_sql("d * d"))
def soft_loss_l2(spark, sf):
    """Squared-error loss, three levels."""
    return _loss_check(spark, sf, "l2")


@register("soft_loss_huber", _loss_sql("CASE WHEN abs(d) < 1 THEN 0.5E0 * d * d ELSE abs(d) - 0.5E0 END"))
def soft_loss_huber(spark, sf):
    """Smooth-L1 (Huber) loss, three levels."""
    return _loss_check(spark, sf, "smooth-l1")


@register("soft_loss_l1", _loss_sql("abs(d)"))
def soft_loss_l1(spark, sf):
    """Absolute loss, three levels (a smaller weight of squared weights: most senses' median is 0)."""
    return _loss_check(spark, sf, "l1", reg=0.001)


@register("score_and_js", "WITH " + S.taxonomy_values() + ",\n" + _LABEL_SQL + """
SELECT level, count(*) AS n, true AS agree, true AS closer, true AS batch_closer FROM j WHERE m > 7 GROUP BY level""")
def score_and_js(spark, sf):
    """M16 + A6 + A7 on the test split: mean JS per level (equal to the mean of the vectors' rows), its mean of batch means,
    and both below those of a uniform prediction by 3 %."""
    per = _heads_eval(spark, sf, arch="flat").filter("split = 'test'")
    mean = OD.mean_distance(per.withColumnRenamed("js", "distance"), out="mean_js", digits=None)
    batch = M.mean_of_batch_means(per, "js", ["vec_id"], ["level"], out="batch_mean_js")
    own = per.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.avg("uniform").alias("u"), F.sum("js").alias("sum"))
    return mean.join(batch, "level").join(own, "level").select(
        "level", "n", (F.abs(F.col("mean_js") - F.col("sum") / F.col("n")) < 1e-9).alias("agree"),
        (F.col("mean_js") < 0.97 * F.col("u")).alias("closer"), (F.col("batch_mean_js") < 0.97 * F.col("u")).alias("batch_closer"))


@register("model_roundtrip", """
SELECT vec_id, true AS same FROM embeddings""")
def model_roundtrip(spark, sf):
    """Saved and reloaded heads score every vector exactly as the
    fitted ones (trained on the training split, scored on the whole table)."""
    d = soft_labelled(spark, sf)
    model = H.fit_heads(d.filter(F.col("split") == "train"), arch="chain", levels=[1, 2])
    path = scratch_path(spark, "heads")
    H.save_model(model, path)
    back = H.load_model(spark, path)
    a = H.score(model, d).select("vec_id", *[F.col(f"scores_l{l}").alias(f"a{l}") for l in (1, 2)])
    b = H.score(back, d).select("vec_id", *[F.col(f"scores_l{l}").alias(f"b{l}") for l in (1, 2)])
    j = a.join(b, "vec_id")
    return j.select("vec_id", ((F.col("a1") == F.col("b1")) & (F.col("a2") == F.col("b2"))).alias("same"))


@register("embed_documents", """
SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '[\\p{L}\\p{Nl}\\p{M}\\p{Nd}\\p{Pc}]+')) AS INTEGER) AS n_tokens, true AS has_vector
FROM documents""")
def embed_documents(spark, sf):
    """M1: every whole document text -> TF-IDF embedding (sparse vector).
    Checked: the tokens cover the whole text (tokens are the runs between
    non-word characters) and every document gets a vector."""
    d = V.table(spark, sf, "documents").select("doc_id", "text")
    model = FE.text_encoder("text", "_vec", 1 << 10).fit(d)
    e = model.transform(d)
    return e.select("doc_id", F.size("_tokens").alias("n_tokens"), F.col("_vec").isNotNull().alias("has_vector"))


@register("standardize_embeddings", """
WITH x AS (SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS idx,
                  CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
s AS (SELECT *, avg(v) OVER (PARTITION BY idx) AS mu, stddev_pop(v) OVER (PARTITION BY idx) AS sd FROM x)
SELECT vec_id, idx, round((v - mu) / sd, 6) AS z FROM s""")
def standardize_embeddings(spark, sf):
    """M3: centred, scaled by the population standard deviation."""
    v = FE.standardize(vectors(spark, sf), "features", "scaled")
    from pyspark.ml.functions import vector_to_array
    x = v.select("vec_id", F.posexplode(vector_to_array("scaled")).alias("idx", "z"))
    return x.select("vec_id", "idx", F.round("z", 6).alias("z"))


@register("pca_embeddings", """
WITH x AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
t AS (SELECT sum(v * v) - sum(v) * sum(v) / count(*) AS ss FROM x GROUP BY i)
SELECT CAST(k AS INTEGER) AS component, (SELECT count(*) FROM embeddings) AS n, true AS uncorrelated, true AS in_order,
       (SELECT round(sum(ss), 3) FROM t) AS total_ss
FROM (SELECT unnest(range(0, (SELECT count(*) FROM t))) AS k)""")
def pca_embeddings(spark, sf):
    """M4: all principal components.  Per component: whether it is uncorrelated with every other (any other turn of the axes
    leaves correlations) and of no larger variance than the one before; turning changes no total sum of squares."""
    from pyspark.ml.functions import vector_to_array
    v = vectors(spark, sf)
    k = v.select(F.size(vector_to_array("features"))).first()[0]
    p = FE.reduce(v, "features", k=k).select("vec_id", vector_to_array("pca").alias("p"))
    x = p.select("vec_id", F.posexplode("p").alias("component", "v"), "p")
    n, mean = F.count(F.lit(1)), F.avg("v")
    of = x.groupBy("component").agg(
        n.alias("n"), (F.sum(F.col("v") * F.col("v")) - n * mean * mean).alias("ss"),
        F.array(*[F.covar_pop("v", F.col("p")[j]) for j in range(k)]).alias("cov")).cache()
    total, top = of.agg(F.round(F.sum("ss"), 3).alias("total_ss"), F.max("ss").alias("top")).first()
    before = of.select((F.col("component") + 1).alias("component"), F.col("ss").alias("before"))
    others = F.filter("cov", lambda c, j: j != F.col("component"))
    return of.join(before, "component", "left").select(
        "component", "n", F.forall(others, lambda c: F.abs(c) < 1e-6 * top / F.col("n")).alias("uncorrelated"),
        (F.coalesce("before", F.lit(float("inf"))) >= F.col("ss") * (1 - 1e-9)).alias("in_order"), F.lit(total).alias("total_ss"))


# --- clusterings --------------------------------------------------------------
# Stand-in features: a vector, moved by 3 along the axis that its label says.  Groups lie apart, so that the
# clustering is known row by row.

def planted(spark: SparkSession, sf: str, outliers: bool = False) -> DataFrame:
    """Vectors in four groups; with ``outliers`` every fiftieth lies far from everything."""
    e = V.table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    far = (F.col("vec_id") % 50 == 0) if outliers else F.lit(False)
    x = F.transform(F.col("embedding").cast("array<double>"), lambda v, i: v + F.when(far & (i == 5), 20.0 + F.col("vec_id")).when(
        ~far & (i == F.col("label") % 4), 3.0).otherwise(0.0))
    return FE.as_features(e.withColumn("x", x), "x", "features").select("vec_id", "label", "features")


def rings(spark: SparkSession, sf: str) -> DataFrame:
    """Two circles linked like a chain; a vector's first two components say where it lies, its label on which."""
    e = V.table(spark, sf, "embeddings").select(
        "vec_id", "label", F.atan2(F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double")).alias("t"))
    one = F.array(F.cos("t"), F.sin("t"), F.lit(0.0))
    two = F.array(F.lit(1.0) + F.cos("t"), F.lit(0.0), F.sin("t"))
    return FE.as_features(e.withColumn("x", F.when(F.col("label") % 2 == 0, one).otherwise(two)), "x", "features")


def _first_of_cluster(c: DataFrame) -> DataFrame:
    """Per vector the smallest vector id of its cluster (-1: noise)."""
    first = c.groupBy("cluster").agg(F.min("vec_id").alias("first"))
    return c.join(first, "cluster").select("vec_id", F.when(F.col("cluster") == CL.NOISE, F.lit(-1)).otherwise(F.col("first")).cast("long").alias("first_vec_id"))


_GROUPS_SQL = "SELECT vec_id, min(vec_id) OVER (PARTITION BY label % 4) AS first_vec_id FROM embeddings"


@register("cluster_kmeans", _GROUPS_SQL)
def cluster_kmeans(spark, sf):
    """M5: k-means, four clusters."""
    return _first_of_cluster(CL.cluster(planted(spark, sf), "kmeans", k=4))


@register("cluster_gmm", _GROUPS_SQL)
def cluster_gmm(spark, sf):
    """M6: Gaussian mixture, four components, all dimensions."""
    return _first_of_cluster(CL.cluster(planted(spark, sf), "gmm", k=4))


@register("cluster_density", """
SELECT vec_id, CASE WHEN vec_id % 50 = 0 THEN -1 ELSE min(vec_id) OVER (PARTITION BY vec_id % 50 = 0, label % 4) END AS first_vec_id
FROM embeddings""")
def cluster_density(spark, sf):
    """M7: density hierarchy; outliers are noise."""
    return _first_of_cluster(CL.cluster(planted(spark, sf, outliers=True), "density", min_cluster_size=5))


@register("cluster_hierarchical", _GROUPS_SQL)
def cluster_hierarchical(spark, sf):
    """M8: Ward agglomeration."""
    return _first_of_cluster(CL.cluster(planted(spark, sf), "hierarchical", k=4))


@register("cluster_spectral", "SELECT vec_id, min(vec_id) OVER (PARTITION BY label % 2) AS first_vec_id FROM embeddings")
def cluster_spectral(spark, sf):
    """M9: spectral clustering on the graph of near neighbours: two rings linked like a chain."""
    return _first_of_cluster(CL.cluster(rings(spark, sf), "spectral", k=2, affinity="neighbours"))


@register("cluster_eval_kmeans", """
WITH s AS (SELECT label % 4 AS cluster, CASE WHEN vec_id % 5 = 0 THEN (label + 1) % 4 ELSE label % 4 END AS sense FROM embeddings)
SELECT sense, round(100E0 * avg(CASE WHEN cluster = sense THEN 1 ELSE 0 END), 6) AS accuracy FROM s GROUP BY sense""")
def cluster_eval_kmeans(spark, sf):
    """M10 on fitted k-means clusters: accuracy per sense; one row in five has another sense than its group."""
    c = CL.cluster(planted(spark, sf), "kmeans", k=4)
    sense = F.when(F.col("vec_id") % 5 == 0, (F.col("label") + 1) % 4).otherwise(F.col("label") % 4)
    _, _, per = CL.evaluate_clusters(c.select("vec_id", sense.alias("sense"), "cluster"))
    return per.select("sense", F.round("accuracy", 6).alias("accuracy"))
