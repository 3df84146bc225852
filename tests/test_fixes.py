"""Cases with wrong results in the past: ranks over several range exchanges, NULLs in distances, encoded file names,
letters beyond ASCII, heads that see upstream levels, partial labels, long chains of dense cells."""

import os

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from labeldist.functions import distributions as D
from labeldist.operators import clustering as CL
from labeldist.operators import features as FE
from labeldist.operators import heads as H
from labeldist.operators import metrics as M
from labeldist.operators import prompts as P
from labeldist.operators import standoff as SO
from labeldist.sources import readers as R


def test_rank_of_a_million_rows_with_payload(spark):
    n = 1_000_000
    df = spark.range(n).select(
        (F.col("id") % 3).alias("level"), ((F.col("id") * 7919) % n).alias("k"),
        F.rand(3).alias("v"), F.repeat(F.lit("x"), 20).alias("payload")).repartition(13)
    r = M.distributed_rank(df, ["k"], ["level"])
    got = r.groupBy("level").agg(F.count("*").alias("n"), F.count_distinct("rank").alias("d"),
                                 F.min("rank").alias("lo"), F.max("rank").alias("hi")).collect()
    assert sum(x.n for x in got) == n
    assert all(x.n == x.d and x.lo == 0 and x.hi == x.n - 1 for x in got)
    # ranks follow the keys
    assert r.selectExpr("level", "rank", "k", "lag(k) OVER (PARTITION BY level ORDER BY rank) AS p").filter("p >= k").isEmpty()
    batches = M.sampled_batches(df, "v", ["k"], ["level"], every=100)
    sizes = M.with_batches(df, ["k"], ["level"]).groupBy("level", "batch_idx").count().filter("batch_idx % 100 = 0")
    assert batches.count() == sizes.count()


def test_rank_of_null_groups(spark):
    df = spark.createDataFrame([(None, 2), (None, 1), ("a", 5)], "g STRING, k INT")
    assert {(r.g, r.k, r["rank"]) for r in M.distributed_rank(df, ["k"], ["g"]).collect()} == {(None, 1, 0), (None, 2, 1), ("a", 5, 0)}


@pytest.mark.parametrize("p, q, js", [
    ([0.5, None], [0.5, 0.5], None), (None, [0.5, 0.5], None), ([0.5, 0.5], None, None),
    ([1.0, 0.0], [0.0, 1.0], 1.0), ([0.5, 0.5], [0.5, 0.5], 0.0)])
def test_null_in_null_out(spark, p, q, js):
    df = spark.createDataFrame([(p, q)], "p ARRAY<DOUBLE>, q ARRAY<DOUBLE>")
    r = df.select(D.js_distance("p", "q").alias("js"), D.kl_distance("p", "q").alias("kl")).first()
    assert r.js == (None if js is None else pytest.approx(js))
    assert (r.kl is None) == (js is None)


def test_null_values_are_no_part_of_batches(spark):
    df = spark.createDataFrame([(i, 1, None if i % 3 == 0 else float(i)) for i in range(90)], "id LONG, level INT, v DOUBLE")
    vals = [float(i) for i in range(90) if i % 3]
    got = M.mean_of_batch_means(df, "v", ["id"], ["level"], digits=None).first()["batch_mean"]
    assert got == pytest.approx(np.mean([np.mean(vals[i:i + 16]) for i in range(0, len(vals), 16)]))


def test_answers_without_gold_are_left_out(spark):
    probs = [1.0] + [0.0] * 27
    first = spark.createDataFrame([(1, 1, probs), (2, 1, probs)], "itemid LONG, attempt INT, probs ARRAY<DOUBLE>")
    gold = spark.createDataFrame([(1, [1.0] + [0.0] * 3, [1.0] + [0.0] * 16, probs)],
                                 "itemid LONG, gold_l1 ARRAY<DOUBLE>, gold_l2 ARRAY<DOUBLE>, gold_l3 ARRAY<DOUBLE>")
    assert [r.itemid for r in P.without_gold(first, gold, ["itemid"]).collect()] == [2]
    assert all(r.bad_outputs == 0 for r in P.score_responses(first, gold, ["itemid"]).collect())


def test_file_names_with_blanks_and_percent(spark, tmp_dir):
    fields = ["Implicit"] + [""] * 6 + ["because", "Expansion.Conjunction"] + [""] * 5 + ["0..3"] + [""] * 5 + ["4..7", ""]
    for folder, file in (("00 a", "wsj 1"), ("01%20b", "wsj_é+2"), ("02", "only line")):
        for side, text in (("gold", "|".join(fields)), ("raw", "abc def")):
            os.makedirs(os.path.join(tmp_dir, side, folder), exist_ok=True)
            if side == "gold" or file != "only line":
                with open(os.path.join(tmp_dir, side, folder, file), "w") as f:
                    f.write(text + "\n")
    ann, docs = R.read_annotations(spark, f"{tmp_dir}/gold"), R.read_raw_docs(spark, f"{tmp_dir}/raw")
    got = {(r.folder, r.file, r.arg1, r.arg2) for r in SO.build_relations(ann, docs).collect()}
    assert got == {("00 a", "wsj 1", "abc", "def"), ("01%20b", "wsj_é+2", "abc", "def")}
    assert [r.file for r in SO.lines_without_document(ann, docs).collect()] == ["only line"]


def test_words_of_every_script(spark):
    df = spark.createDataFrame([("schön příliš été Straße, 東京!",)], "text STRING")
    t = FE.text_encoder("text", "v", 64).fit(df).transform(df).first()["_tokens"]
    assert t == ["schön", "příliš", "été", "straße", "東京"]


def test_heads_differ_and_skip_partial_labels(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(400):
        x = [float(v) for v in rng.normal(size=2)]
        # level 1 is one-sided in x0; level 2 depends on how sure level 1 is, which is not linear in x0
        one = [float(1 / (1 + np.exp(-3 * x[0]))), 0.0, 0.0, 0.0]
        one[1] = 1 - one[0]
        two = [0.0] * 17
        two[0] = 4 * one[0] * one[1]
        two[1] = 1 - two[0]
        rows.append((i, x, one, None if i == 0 else [None] * 17 if i == 1 else two))
    df = spark.createDataFrame(rows, "id INT, x ARRAY<DOUBLE>, dist_l1 ARRAY<DOUBLE>, dist_l2 ARRAY<DOUBLE>").withColumn(
        "features", array_to_vector("x"))
    js = {}
    for arch in H.ARCHS:
        s = H.score(H.fit_heads(df, arch=arch, levels=[1, 2], max_iter=60), df)
        js[arch] = s.agg(F.avg(D.classifier_js("dist_l2", "scores_l2"))).first()[0]
    assert abs(js["chain"] - js["flat"]) > 1e-3 and abs(js["gated"] - js["flat"]) > 1e-3
    for loss in ("l2", "smooth-l1"):
        assert np.isfinite(H.fit_heads(df, levels=[2], loss=loss, max_iter=5).theta).all()


def test_a_long_line_of_dense_cells_is_one_cluster(spark):
    df = spark.createDataFrame([(float(i), float(j)) for i in range(120) for j in range(6)], "a DOUBLE, b DOUBLE")
    df = df.select(array_to_vector(F.array("a", F.col("b") * 1e-3)).alias("features"))
    out = CL.grid_density(df, eps=1.5, dims=2, min_size=3)
    assert out.select("cluster").distinct().count() == 1
    with pytest.raises(ValueError):
        CL.cluster(df, "spectral", k=20, entries=10)
