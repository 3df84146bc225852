"""Checks of fitted models: deterministic, and red for wrong fits."""

import duckdb
import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

import __spark_entry__ as E
from labeldist import taxonomy as tx
from labeldist.operators import clustering as CL
from labeldist.operators import features as FE
from labeldist.operators import heads as H
from labeldist.plans import q_models as Q

SF = "/root/testdata/sf0.001"
CLUSTERINGS = ["cluster_kmeans", "cluster_gmm", "cluster_density", "cluster_hierarchical", "cluster_spectral", "cluster_eval_kmeans",
               "relation_cluster_eval"]
HEADS = ["soft_heads_flat", "soft_heads_chain", "soft_heads_gated", "soft_heads_gated_tuned", "soft_heads_single", "soft_loss_l2",
         "soft_loss_huber", "soft_loss_l1", "score_and_js"]


@pytest.fixture(scope="module")
def q():
    return E.queries()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in ("embeddings", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")

    def rows(key):
        res = con.execute(E.oracle_sql()[key])
        names = [d[0] for d in res.description]
        return sorted(repr(sorted(zip(names, r, strict=True))) for r in res.fetchall())
    return rows


def rows(df):
    return sorted(repr(sorted(r.asDict().items())) for r in df.collect())


@pytest.mark.parametrize("how", ["one", "random"])
def test_wrong_clusters_turn_the_checks_red(spark, q, oracle, monkeypatch, how):
    wrong = F.lit(0) if how == "one" else F.pmod(F.xxhash64(F.rand(1)), F.lit(3)).cast("int")
    monkeypatch.setattr(CL, "cluster", lambda df, *a, **kw: df.withColumn("cluster", wrong))
    for key in CLUSTERINGS:
        assert rows(q[key](spark, SF)) != oracle(key), key


def test_axes_as_they_are_turn_the_check_red(spark, q, oracle, monkeypatch):
    monkeypatch.setattr(FE, "reduce", lambda df, col, k: df.withColumn("pca", F.col(col)))
    assert rows(q["pca_embeddings"](spark, SF)) != oracle("pca_embeddings")


def test_uniform_scores_turn_the_checks_red(spark, q, oracle, monkeypatch):
    def uniform(model, df):
        return df.withColumns({f"scores_l{lv}": F.array_repeat(F.lit(1.0 / tx.LEVEL_SIZES[lv]), tx.LEVEL_SIZES[lv]) for lv in model.levels})
    monkeypatch.setattr(H, "score", uniform)
    monkeypatch.setattr(H, "lbfgs", lambda value, theta, *a, **kw: (theta, [0.0]))
    for key in HEADS:
        assert rows(q[key](spark, SF)) != oracle(key), key


def test_components_equal_the_covariance_s(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 40)) @ np.diag(np.linspace(3, 0.1, 40)) @ rng.normal(size=(40, 40)) + 5
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id INT, x ARRAY<DOUBLE>").repartition(4)
    mean, axes, variance = FE.components(df, "x", 5)
    value, vector = np.linalg.eigh(np.cov(x.T, bias=True))
    assert np.allclose(mean, x.mean(0)) and np.allclose(variance, value[::-1][:5], rtol=1e-6)
    assert np.allclose(np.abs((axes * vector[:, ::-1][:, :5]).sum(0)), 1, atol=1e-4)
    got = np.array([r.pca.toArray() for r in FE.reduce(df.withColumn("features", array_to_vector("x")), "features", k=5).orderBy("id").collect()])
    assert np.allclose(got, (x - mean) @ axes)


def test_clusterings_are_the_same_again(spark):
    for algo, kw in (("kmeans", {"k": 4}), ("hierarchical", {"k": 4}), ("gmm", {"k": 4}), ("density", {})):
        a, b = ({r.vec_id: r.cluster for r in CL.cluster(Q.planted(spark, SF), algo, **kw).collect()} for _ in range(2))
        assert a == b and len(a) == spark.read.parquet(f"{SF}/embeddings.parquet").count(), algo


def test_embed_shapes(spark, q):
    e = q["embed_documents"](spark, SF).collect()
    assert all(r.has_vector and r.n_tokens >= 0 for r in e)


def test_model_roundtrip_identical(spark, q):
    assert all(r.same for r in q["model_roundtrip"](spark, SF).collect())
