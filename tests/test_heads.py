"""Soft-label heads: weighted expansion recovers soft targets; training
beats the uniform baseline; persisted heads score identically."""

import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from labeldist.functions import distributions as D
from labeldist.operators import heads as H


def test_soft_targets_recovered(spark):
    # one constant feature; every row carries the same soft label (.7/.3 on
    # two fine senses) -> the fitted level-3 probabilities approach it
    l3 = [0.0] * 28
    l3[3], l3[4] = 0.7, 0.3
    rows = [([1.0], l3) for _ in range(40)]
    df = spark.createDataFrame(rows, "f ARRAY<DOUBLE>, dist_l3 ARRAY<DOUBLE>").withColumn(
        "features", array_to_vector("f"))
    m = H.fit_heads(df, levels=[3], max_iter=200)
    s = H.score(m, df.limit(1)).select(D.softmax("scores_l3").alias("p")).first().p
    assert s[3] == pytest.approx(0.7, abs=0.02) and s[4] == pytest.approx(0.3, abs=0.02)


def test_better_than_uniform_and_roundtrip(spark, tmp_dir):
    from labeldist.plans.q_models import soft_labelled
    d = soft_labelled(spark, "/root/testdata/sf0.001")
    m = H.fit_heads(d, arch="chain", levels=[1, 2])
    s = H.score(m, d)
    ce = s.select(F.avg(-F.aggregate(F.zip_with("dist_l1", D.softmax("scores_l1"),
                                                 lambda a, b: a * F.log(b)), F.lit(0.0), lambda x, y: x + y))).first()[0]
    assert ce < math.log(4)
    H.save_model(m, tmp_dir + "/heads")
    back = H.load_model(spark, tmp_dir + "/heads")
    a = s.select("vec_id", "scores_l2").collect()
    b = {r.vec_id: r.scores_l2 for r in H.score(back, d).select("vec_id", "scores_l2").collect()}
    assert all(r.scores_l2 == b[r.vec_id] for r in a)


def test_tune_gates(spark):
    from labeldist.plans.q_models import soft_labelled
    d = soft_labelled(spark, "/root/testdata/sf0.001")
    train, valid = d.filter("split = 'train'"), d.filter("split <> 'train'")
    model, res = H.tune_gates(train, valid, levels=[1, 2], grid=[0.25, 0.75], max_iter=20, learn_gates=False)
    assert [g for g, _ in res] == [0.25, 0.75]
    assert model.gates[2][0] == pytest.approx(min(res, key=lambda r: r[1])[0])
    assert all(0.0 <= v <= 1.0 for _, v in res)


def test_tuned_fits_share_their_passes(spark, monkeypatch):
    """A step of all candidates is one pass over the blocks, and each comes out as if it were fitted alone."""
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(rng.normal(size=6).tolist(), rng.dirichlet(np.ones(4)).tolist(), rng.dirichlet(np.ones(17)).tolist())
                                for _ in range(60)], "features ARRAY<DOUBLE>, dist_l1 ARRAY<DOUBLE>, dist_l2 ARRAY<DOUBLE>").coalesce(1)
    alone, passes = [], []
    for g in (0.25, 0.75):
        alone.append(H.fit_heads(df, arch="gated", levels=[1, 2], max_iter=8, gates={2: [math.log(g / (1 - g))]}))
    plain = H.summed
    monkeypatch.setattr(H, "summed", lambda *a: passes.append(1) or plain(*a))
    together, fits = [], H.fit_starts
    monkeypatch.setattr(H, "fit_starts", lambda *a, **kw: together.extend(fits(*a, **kw)) or together)
    best, res = H.tune_gates(df, df, levels=[1, 2], grid=[0.25, 0.75], max_iter=8)
    assert len(passes) < 1.5 * max(len(m.history) for m in together) + 2
    for a, b in zip(alone, together, strict=True):
        assert np.allclose(a.theta, b.theta) and np.allclose(a.history, b.history)
    assert best is together[min((0, 1), key=lambda i: res[i][1])]


def test_labels_of_a_batch():
    import pyarrow as pa

    from labeldist.operators.blocks import _labels
    column = pa.array([[1.0, 2.0], None, [1.0], [None, 1.0], [3.0, 4.0], []], pa.list_(pa.float64()))
    for batch in (column, column[1:], column[1:2]):
        want = [v if v is not None and len(v) == 2 and None not in v else [np.nan] * 2 for v in batch.to_pylist()]
        assert np.array_equal(_labels(batch, 2), np.array(want, float).reshape(-1, 2), equal_nan=True)


def test_gradients_equal_differences():
    rng, sizes = np.random.default_rng(0), {1: 4, 2: 5, 3: 6}
    for arch in H.ARCHS:
        for loss in H.LOSSES:
            for levels in ([1, 2, 3], [1, 2], [3]):
                net = H.Net(arch, loss, levels, 7, 6, share=[1.0, 1.5, 2.0][:len(levels)], sizes=sizes)
                theta = net.start(1, {}) + rng.normal(0, 0.1, len(net.start(1, {})))
                x, y = rng.normal(size=(20, 7)), {lv: rng.dirichlet(np.ones(sizes[lv]), 20) for lv in levels}
                for lv in levels:
                    y[lv][3] = np.nan
                grad = net.gradient(theta, x, y)[1]
                for i in rng.choice(len(theta), 25, replace=False):
                    step = 1e-6 * (np.arange(len(theta)) == i)
                    up, down = (net.gradient(theta + s, x, y)[0].sum() for s in (step, -step))
                    assert (up - down) / 2e-6 == pytest.approx(grad[i], abs=1e-4)


def sawtooth(n, seed):
    """Level 2 depends on what level 1 leaves of the first feature, which is not linear in it."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 8))
    one = np.eye(4)[(x[:, 0] > 0) * 2 + (x[:, 1] > 0)]
    which = (2 * (x[:, 0] - 1.6 * (x[:, 0] > 0) + 0.8) + 0.3 * x[:, 2] > 0).astype(int)
    two = np.zeros((n, 17))
    two[np.arange(n), which], two[np.arange(n), which + 2] = 0.8, 0.2
    return [(i, *(v.tolist() for v in r)) for i, r in enumerate(zip(x, one, two, strict=True))]


def test_levels_above_help_where_flat_heads_cannot(spark):
    """Held-out JS of level 2 (softmax of the scores): chained and gated heads beat flat ones by 0.2; gates have moved."""
    schema = "id INT, features ARRAY<DOUBLE>, dist_l1 ARRAY<DOUBLE>, dist_l2 ARRAY<DOUBLE>"
    train, held = (spark.createDataFrame(sawtooth(n, s), schema).repartition(3).cache() for n, s in ((1500, 1), (800, 2)))
    js = {}
    for arch in H.ARCHS:
        model = H.fit_heads(train, arch=arch, levels=[1, 2], max_iter=150)
        s = H.score(model, held).withColumn("p", D.softmax("scores_l2"))
        js[arch] = s.agg(F.avg(D.js_distance("dist_l2", "p"))).first()[0]
        assert all(a >= b for a, b in zip(model.history, model.history[1:], strict=False))
        if arch == "gated":
            start = 1 / (1 + math.exp(-H.GATE_TWO))
            assert abs(model.gates[2][0] - start) > 0.02 and sum(model.gates[2]) == pytest.approx(1)
    assert js["chain"] < js["flat"] - 0.2 and js["gated"] < js["flat"] - 0.2, js


def test_squared_loss_equals_normal_equations(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 5))
    y = rng.dirichlet(np.ones(4), 300)
    df = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, y, strict=True)], "features ARRAY<DOUBLE>, dist_l1 ARRAY<DOUBLE>")
    model = H.fit_heads(df.repartition(4), levels=[1], loss="l2", reg=0.0, max_iter=300, tol=1e-12)
    got = np.array([r.scores_l1 for r in H.score(model, df).collect()])
    one = np.hstack([x, np.ones((300, 1))])
    assert np.abs(got - one @ np.linalg.lstsq(one, y, rcond=None)[0]).max() < 1e-3


def test_missing_labels_nulls_and_sparse_features(spark):
    from pyspark.ml.linalg import Vectors, VectorUDT
    from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType
    schema = StructType([StructField("id", IntegerType()), StructField("features", VectorUDT()), StructField("dist_l1", ArrayType(DoubleType()))])
    rows = [(i, Vectors.sparse(50, [i % 2, 10], [1.0, 1.0]), [1.0 - i % 2, float(i % 2), 0.0, 0.0]) for i in range(40)]
    rows += [(100, None, [1.0, 0.0, 0.0, 0.0]), (101, Vectors.sparse(50, [0], [1.0]), None), (102, Vectors.sparse(50, [0], [1.0]), [None] * 4)]
    df = spark.createDataFrame(rows, schema)
    out = {r.id: r.scores_l1 for r in H.score(H.fit_heads(df, levels=[1]), df).collect()}
    assert out[100] is None and out[0][0] > out[0][1] and out[1][1] > out[1][0] and len(out) == 43
