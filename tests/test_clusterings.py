"""Mixture, agglomeration and spectral clustering."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from labeldist.operators import clustering as CL
from labeldist.operators import mixture, summary


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id LONG, x ARRAY<DOUBLE>").repartition(5)


def labels(df):
    return np.array([r.cluster for r in df.orderBy("id").select("cluster").collect()])


def same(a, b):
    return len(set(zip(a, b, strict=True))) == len(set(a)) == len(set(b))


def plain_ward(x, k):
    groups = [[i] for i in range(len(x))]
    while len(groups) > k:
        def cost(a, b):
            d = x[a].mean(0) - x[b].mean(0)
            return len(a) * len(b) / (len(a) + len(b)) * (d @ d)
        i, j = min(((i, j) for i in range(len(groups)) for j in range(i)), key=lambda p: cost(groups[p[0]], groups[p[1]]))
        groups[j] += groups.pop(i)
    out = np.empty(len(x), int)
    for n, g in enumerate(groups):
        out[g] = n
    return out


def test_ward_equals_ward_on_all_rows(spark):
    x = np.random.default_rng(1).normal(size=(70, 3))
    for k in (1, 2, 5, 20):
        want = plain_ward(x, k)
        assert same(summary.ward(x, np.ones(len(x)), k), want)
        got = labels(CL.cluster(frame(spark, np.vstack([x, x[:0]])), "hierarchical", k=k, features="x"))
        assert same(got, want)


def test_summary_is_bounded_and_says_how_far(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 20, (6, 4))
    x = centres[np.arange(3000) % 6] + rng.normal(0, 0.5, (3000, 4))
    e = summary.summarise(frame(spark, x), "x", entries=60)
    assert len(e.n) <= 60 and e.n.sum() == 3000 and e.threshold > 0
    assert np.allclose(e.total.sum(axis=0), x.sum(axis=0))
    away = np.sqrt(((x[:, None] - e.leader[None]) ** 2).sum(-1)).min(axis=1)
    assert away.max() <= e.radius.max() + 1e-9
    got = labels(CL.cluster(frame(spark, x), "hierarchical", k=6, features="x", entries=60))
    assert same(got, np.arange(3000) % 6)


def test_interleaved_rings(spark):
    t = np.linspace(0, 2 * np.pi, 200, endpoint=False)
    one = np.stack([np.cos(t), np.sin(t), 0 * t], axis=1)
    two = np.stack([1 + np.cos(t), 0 * t, np.sin(t)], axis=1)      # linked like a chain
    got = labels(CL.cluster(frame(spark, np.vstack([one, two])), "spectral", k=2, features="x", affinity="neighbours"))
    assert same(got, np.repeat([0, 1], 200))
    blobs = np.vstack([np.random.default_rng(i).normal(4 * i, 0.4, (50, 2)) for i in range(3)])
    assert same(labels(CL.cluster(frame(spark, blobs), "spectral", k=3, features="x")), np.repeat([0, 1, 2], 50))


def test_mixture_in_all_dimensions(spark):
    rng = np.random.default_rng(3)
    d = 30
    parts = []
    for j in range(3):
        a = rng.normal(size=(d, d)) * 0.3
        parts.append(rng.normal(0, 3, d) + rng.normal(size=(50, d)) @ (a + np.eye(d)))     # few more rows than dimensions
    x = np.vstack([*parts, np.zeros((5, d))])
    df = frame(spark, x)
    m = mixture.fit_mixture(df, "x", 3, max_iter=30, tol=1e-9)
    assert len(m.history) > 1 and np.isfinite(m.history).all()
    assert all(b >= a - 1e-9 for a, b in zip(m.history, m.history[1:], strict=False))
    assert m.weight.sum() == pytest.approx(1) and all(np.linalg.eigvalsh(c).min() > 0 for c in m.cov)
    assert same(labels(mixture.assign(m, df, "x"))[:150], np.repeat([0, 1, 2], 50))
    # one component: mean and covariance of the table, and the prior on the diagonal
    one = mixture.fit_mixture(df, "x", 1, reg=1e-3)
    assert np.allclose(one.mean[0], x.mean(0))
    assert np.allclose(one.cov[0], np.cov(x.T, bias=True) + 1e-3 * x.var(axis=0).mean() * np.eye(d))


def test_rows_without_features_and_equal_rows(spark):
    df = frame(spark, [[0.0, 0.0]] * 9 + [[5.0, 5.0]] * 9).union(spark.createDataFrame([(99, None)], "id LONG, x ARRAY<DOUBLE>"))
    for algo, kw in (("hierarchical", {"k": 2}), ("spectral", {"k": 2}), ("density", {"min_cluster_size": 4})):
        got = {r.id: r.cluster for r in CL.cluster(df, algo, features="x", **kw).collect()}
        assert got.pop(99) is None and same([got[i] for i in range(18)], [0] * 9 + [1] * 9), algo
    m = mixture.fit_mixture(df, "x", 2)
    assert mixture.assign(m, df, "x").filter(F.col("cluster").isNull()).count() == 1
