"""Metrics and cluster evaluation against direct Python computations."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from labeldist.operators import clustering as CL
from labeldist.operators import metrics as M


def test_distributed_rank_matches_sort(spark):
    rng = np.random.default_rng(3)
    keys = rng.permutation(5000).tolist()
    df = spark.createDataFrame([(int(k),) for k in keys], "k LONG").repartition(7)
    got = M.distributed_rank(df, ["k"]).collect()
    assert all(r["rank"] == r.k for r in got)


def test_batch_means(spark):
    rng = np.random.default_rng(5)
    vals = rng.random(100)
    df = spark.createDataFrame([(i, 1, float(v)) for i, v in enumerate(vals)], "id LONG, level INT, v DOUBLE")
    got = M.mean_of_batch_means(df, "v", ["id"], ["level"], digits=None).first()["batch_mean"]
    expect = np.mean([vals[i:i + 16].mean() for i in range(0, 100, 16)])
    assert got == pytest.approx(expect, abs=1e-12)
    s = {r.batch_idx: r.batch_mean for r in M.sampled_batches(df, "v", ["id"], ["level"], digits=None).collect()}
    assert set(s) == {0} and s[0] == pytest.approx(vals[:16].mean())


def test_weighted_prf(spark):
    rng = np.random.default_rng(9)
    g = rng.integers(0, 4, 400)
    p = np.where(rng.random(400) < 0.6, g, rng.integers(0, 5, 400))
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(g, p)], "gold INT, pred INT")
    r = M.weighted_prf(df, digits=None).first()
    classes = sorted(set(g) | set(p))
    n = len(g)
    prec = rec = f1 = 0.0
    for c in classes:
        tp = np.sum((g == c) & (p == c))
        sup = np.sum(g == c)
        npred = np.sum(p == c)
        pc = tp / npred if npred else 0.0
        rc = tp / sup if sup else 0.0
        fc = 2 * pc * rc / (pc + rc) if pc + rc else 0.0
        prec += pc * sup / n
        rec += rc * sup / n
        f1 += fc * sup / n
    assert (r.precision, r.recall, r.f1) == pytest.approx((prec, rec, f1), abs=1e-12)


def test_more_clusters_than_senses_and_noise(spark):
    rows = []
    for c, s, n in [(0, 0, 10), (1, 1, 8), (2, 2, 7), (3, 3, 9), (4, 0, 3), (-1, 1, 4)]:
        rows += [(c, s)] * n
    df = spark.createDataFrame(rows, "cluster INT, sense INT")
    mapped, overall, per = CL.evaluate_clusters(df)
    m = {r.cluster: r.predicted_sense for r in mapped.select("cluster", "predicted_sense").distinct().collect()}
    assert m[4] is None and m[-1] is None and m[0] == 0
    assert overall.first().accuracy == pytest.approx(34 / 41 * 100, abs=1e-6)


def brute(tab):
    k, c = tab.shape
    best = -1
    for perm in itertools.permutations(range(c), k) if k <= c else itertools.permutations(range(k), c):
        s = tab[range(k), perm].sum() if k <= c else tab[perm, range(c)].sum()
        best = max(best, s)
    return best


def test_assignment_is_optimal():
    rng = np.random.default_rng(1)
    for k, c in [(4, 4), (5, 4), (3, 6), (12, 10), (10, 12)]:
        tab = rng.integers(0, 50, (k, c))
        cells = pd.DataFrame([(i, j, tab[i, j]) for i in range(k) for j in range(c)], columns=["cluster", "sense", "n"])
        m = CL.solve_assignment(cells, "cluster", "sense")
        total = sum(tab[a, b] for a, b in zip(m.cluster, m.sense))
        assert len(set(m.sense)) == len(m) == min(k, c)
        if max(k, c) <= 9:
            assert total == brute(tab)
        greedy = 0
        used_r, used_c = set(), set()
        for (i, j) in sorted(itertools.product(range(k), range(c)), key=lambda x: -tab[x]):
            if i not in used_r and j not in used_c:
                greedy += tab[i, j]
                used_r.add(i)
                used_c.add(j)
        assert total >= greedy


def test_contingency_total(spark):
    df = spark.createDataFrame([(i % 3, i % 4) for i in range(50)], "cluster INT, sense INT")
    assert CL.contingency(df).agg(F.sum("n")).first()[0] == 50


def test_assignment_takes_the_smallest_labels_of_equals():
    """Against enumeration up to 8 x 8, with many ties."""
    rng = np.random.default_rng(3)
    shapes = [(k, c) for k in range(1, 6) for c in range(1, 6)] * 6 + [(6, 6), (7, 5), (5, 7), (8, 8), (4, 8)]
    for k, c in shapes:
        tab = rng.integers(0, 3, (k, c))
        cells = pd.DataFrame([(i, j, tab[i, j]) for i in range(k) for j in range(c)], columns=["cluster", "sense", "n"])
        got = dict(CL.solve_assignment(cells, "cluster", "sense").itertuples(index=False))
        best = None
        for perm in itertools.permutations(range(max(k, c)), k):      # labels from c on: left out
            if k <= c or sum(j < c for j in perm) == c:
                total = sum(tab[i, j] for i, j in enumerate(perm) if j < c)
                key = (-total, [min(j, c) for j in perm])
                best = key if best is None or key < best else best
        assert [got.get(i, c) for i in range(k)] == best[1], (tab, got)


def test_distributed_rank_within_groups(spark):
    rng = np.random.default_rng(4)
    rows = [(int(g), int(k)) for g in range(3) for k in rng.permutation(700)]
    df = spark.createDataFrame(rows, "g INT, k LONG").repartition(5)
    got = M.distributed_rank(df, ["k"], ["g"]).collect()
    assert len(got) == 2100 and all(r["rank"] == r.k for r in got)


def test_salted_join_matches_plain_join(spark):
    from labeldist.operators.skew import hot_keys, salted_join
    many = spark.createDataFrame([("A" if i % 5 < 2 else f"k{i % 37}", i) for i in range(2000)], "k STRING, v INT")
    one = spark.createDataFrame([("A", "doc-A")] + [(f"k{i}", f"doc-{i}") for i in range(30)], "k STRING, d STRING")
    assert "A" in [r.k for r in hot_keys(many, ["k"], 0.1).collect()]
    for how in ("inner", "left"):
        a = sorted(tuple(r) for r in salted_join(many, one, ["k"], how, share=0.1, buckets=8).collect())
        b = sorted(tuple(r) for r in many.join(one, "k", how).collect())
        assert a == b
