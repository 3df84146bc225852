"""Distribution functions: hand-made edge rows and invariants against a
NumPy re-statement of the definitions."""

import math

import numpy as np
import pytest

from labeldist import taxonomy as tx
from labeldist.functions import distributions as D
from labeldist.operators import corpus as C

ARR = "array<double>"


def one(spark, col, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(col).collect()]


def lit_dist(values: dict) -> str:
    return "{" + ", ".join(f"'{k}': {v}" for k, v in values.items()) + "}"


def prepare(spark, dist_text):
    df = spark.createDataFrame([(dist_text,)], "dist STRING")
    return C.with_distribution_levels(df, "dist").first()


def test_all_mass_on_excluded_label(spark):
    d = {k: 0.0 for k in tx.L3_SOURCE_KEYS}
    d["norel"] = 1.0
    r = prepare(spark, lit_dist(d))
    assert r.dist_l3 == [0.0] * 28 and r.dist_l1 == [0.0] * 4
    assert r.majority_level_1 == "temporal" and r.majority_level_2 == "synchronous"


def test_missing_distribution_is_null(spark):
    df = spark.createDataFrame([(None,)], "dist STRING")
    r = C.with_distribution_levels(df, "dist").first()
    assert all(v is None for v in r.dist_l3)
    assert r.majority_level_1 is None and r.majority_level_2 is None


def test_partial_distribution(spark):
    keys = tx.L3_SOURCE_KEYS[:5]
    r = prepare(spark, lit_dist({k: 0.2 for k in keys}))
    assert r.dist_l3[:5] == pytest.approx([0.2] * 5)
    assert all(v is None for v in r.dist_l3[5:])
    assert r.dist_l2[:3] == pytest.approx([0.2, 0.4, 0.4])
    assert all(v is None for v in r.dist_l2[3:])
    assert r.majority_level_2 == "asynchronous"  # first maximum, NULLs skipped
    assert r.majority_level_1 is None or r.majority_level_1 == "temporal"


def test_tie_goes_to_first(spark):
    out = one(spark, D.argmax_idx("a"), [([0.5, 0.5, 0.0],)], f"a {ARR}")
    assert out == [0]


def test_keys_assigned_by_name_not_position(spark):
    r = prepare(spark, "{'succession': 0.25, 'precedence': 0.75}")
    assert r.dist_l3[1] == pytest.approx(0.75) and r.dist_l3[2] == pytest.approx(0.25)


def test_identical_distributions_have_zero_distance(spark):
    p = [0.1, 0.2, 0.3, 0.4]
    df = spark.createDataFrame([(p, p)], f"p {ARR}, q {ARR}")
    r = df.select(D.js_distance("p", "q"), D.kl_distance("p", "q"), D.hellinger_distance("p", "q")).first()
    assert r[0] == pytest.approx(0.0, abs=1e-12)
    assert r[1] == pytest.approx(0.0, abs=1e-12)
    assert r[2] == pytest.approx(0.0, abs=1e-12)


def np_js(p, q):
    p = np.asarray(p) / np.sum(p)
    q = np.asarray(q) / np.sum(q)
    m = (p + q) / 2

    def rel(a, b):
        return np.where(a > 0, a * np.log(np.where(a > 0, a, 1) / np.where(b > 0, b, 1)), 0.0)
    return math.sqrt(max(0.0, (rel(p, m).sum() + rel(q, m).sum()) / math.log(2) / 2))


def np_smooth(p, margin=0.001):
    s = np.asarray(p) + margin
    return s / s.sum()


def np_shift(p):
    s = np.asarray(p) - np.min(p)
    t = np.abs(s).sum()
    return s if t == 0 else s / t


def test_metrics_match_numpy_definitions(spark):
    rng = np.random.default_rng(7)
    rows = []
    for _ in range(200):
        p = rng.dirichlet(np.ones(28) * 0.3).tolist()
        q = (rng.normal(size=28) * 2).tolist()  # raw scores
        rows.append((p, q))
    df = spark.createDataFrame(rows, f"p {ARR}, q {ARR}")
    got = df.select("p", "q", D.classifier_js("p", "q").alias("js"), D.classifier_kl("p", "q").alias("kl"),
                    D.classifier_hellinger("p", "q").alias("h")).collect()
    for r in got:
        ps, qs = np_smooth(r.p), np_smooth(np_shift(r.q))
        assert r.js == pytest.approx(np_js(ps, qs), abs=1e-12)
        assert r.kl == pytest.approx(float(np.sum(ps * np.log(ps / qs)) / math.log(2)), abs=1e-12)
        h = math.sqrt(np.sum((np.sqrt(r.p) - np.sqrt(np_shift(r.q))) ** 2)) / math.sqrt(2)
        assert r.h == pytest.approx(h, abs=1e-12)


def test_invariants(spark):
    rng = np.random.default_rng(11)
    rows = [(rng.random(28).tolist(), rng.random(28).tolist()) for _ in range(300)]
    rows.append(([0.0] * 28, [0.0] * 28))
    df = spark.createDataFrame(rows, f"p {ARR}, q {ARR}")
    out = df.select(
        D.l1_normalize("p").alias("n"),
        D.rollup_level(D.l1_normalize("p"), 2).alias("l2"),
        D.js_distance(D.smooth("p"), D.smooth("q")).alias("js"),
        D.js_distance(D.smooth("q"), D.smooth("p")).alias("js_rev"),
        D.kl_distance(D.smooth("p"), D.smooth("q")).alias("kl"),
        D.hellinger_distance(D.l1_normalize("p"), D.l1_normalize("q")).alias("h"),
    ).collect()
    for r in out:
        s = sum(r.n)
        assert s == pytest.approx(1.0) or s == 0.0
        assert sum(r.l2) == pytest.approx(s)
        assert 0.0 <= r.js <= 1.0
        assert r.js == pytest.approx(r.js_rev, abs=1e-12)
        assert r.kl >= -1e-12
        assert 0.0 <= r.h <= 1.0 + 1e-12


def test_guard_distance(spark):
    df = spark.createDataFrame([(float("inf"),), (float("nan"),), (None,), (0.25,)], "d DOUBLE")
    got = [r[0] for r in df.select(D.guard_distance("d")).collect()]
    assert got == [1.0, 1.0, 1.0, 0.25]


def test_rollup_groups_cover_taxonomy():
    assert sorted(i for g in tx.groups(2) for i in g) == list(range(28))
    assert sorted(i for g in tx.groups(1) for i in g) == list(range(17))
    assert [tx.L3_NAMES[tx.groups(2)[i][0]] for i in tx.single_child_l2()] == [
        "synchronous_3", "contrast_3", "similarity_3", "conjunction_3", "disjunction_3", "equivalence_3"]


def test_vote_distribution_single_pass(spark):
    from labeldist.operators.distributions import vote_distribution
    rows = [(1, 0, 0), (1, 0, 0), (1, 3, 1), (2, 28, 0)]
    df = spark.createDataFrame(rows, "itemid LONG, l3_idx INT, side INT")
    out = {r.itemid: r for r in vote_distribution(df, ["itemid"], "l3_idx", 29, side_col="side").collect()}
    assert out[1].votes_0[0] == 2.0 and out[1].votes_1[3] == 1.0
    assert out[2].votes_0[28] == 1.0 and sum(out[2].votes_1) == 0.0
    plan = vote_distribution(df, ["itemid"], "l3_idx", 29, side_col="side")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 1
