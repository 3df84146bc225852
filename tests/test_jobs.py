"""The end-to-end jobs on temporary item tables and annotation trees."""

import os
import random

from pyspark.sql import functions as F

from labeldist import jobs as J
from labeldist import taxonomy as tx
from labeldist.sources import readers as R

WORDS = "alpha beta gamma delta epsilon zeta theta kappa lambda sigma omega rho".split()


def write_items(path, n=60):
    rnd = random.Random(3)
    header = R.item_columns()
    with open(path, "w") as fh:
        fh.write("\t".join(header) + "\n")
        for i in range(n):
            split = "train" if i % 10 < 7 else ("dev" if i % 10 == 7 else "test")
            row = {"split": split, "itemid": str(i), "orig_lang": "en", "available_langs": "['en', 'de']"}
            hot = tx.L3_SOURCE_KEYS[(i % 4) * 5]
            for l in ["en", "de", "fr", "cs"]:
                dist = {k: 0.0 for k in tx.L3_SOURCE_KEYS}
                dist[hot] = 0.8
                dist[tx.L3_SOURCE_KEYS[(i * 7) % 28]] += 0.2
                lit = "{" + ", ".join(f"'{k}': {v}" for k, v in dist.items()) + "}"
                row.update({f"arg1_context_{l}": " ".join(rnd.choice(WORDS) for _ in range(5)) + f" {hot}",
                            f"arg2_context_{l}": " ".join(rnd.choice(WORDS) for _ in range(5)),
                            f"MV_{l}": f"{hot}_{l}", f"MV_dist_{l}": lit if l in ("en", "de") else ""})
            fh.write("\t".join(row[h] for h in header) + "\n")


def test_corpus_train_test_and_prompts(spark, tmp_dir):
    items = os.path.join(tmp_dir, "items.tsv")
    write_items(items)
    corpus = J.prepare_corpus(spark, items, os.path.join(tmp_dir, "corpus"))
    assert {r.inst_lang for r in corpus.select("inst_lang").distinct().collect()} == {"en", "de"}
    out = os.path.join(tmp_dir, "run")
    m = J.train_and_test(spark, os.path.join(tmp_dir, "corpus"), "en", levels=[1, 2], out_path=out, max_iter=30)
    rows = m.collect()
    measured = [r for r in rows if r.mode != "Training"]
    assert sorted((r.mode, r.level, r.name) for r in measured) == sorted(
        (a, b, c) for a in ("Validation", "Testing") for b in (1, 2) for c in ("mean_js", "batch_mean_js", "accuracy"))
    assert all(0.0 <= r.value <= (100 if r.name == "accuracy" else 1) for r in measured)
    losses = [r.value for r in sorted((r for r in rows if r.name == "loss"), key=lambda r: r.step)]
    assert len(losses) > 5 and all(a >= b for a, b in zip(losses, losses[1:], strict=False))
    n_train = corpus.filter("inst_lang = 'en' AND split = 'train'").count()
    assert sorted((r.level, r.step) for r in rows if r.name == "js") == [
        (lv, s) for lv in (1, 2) for s in range(0, -(-n_train // 16), 10)]
    n_test = corpus.filter("inst_lang = 'en' AND split = 'test'").count()
    assert spark.read.parquet(f"{out}/predictions").count() == 2 * n_test
    # another configuration leaves the first as it is, and a run that is written again doubles nothing
    J.train_and_test(spark, os.path.join(tmp_dir, "corpus"), "en", loss="l2", levels=[1, 2], out_path=out, max_iter=5)
    J.train_and_test(spark, os.path.join(tmp_dir, "corpus"), "en", levels=[1, 2], out_path=out, max_iter=30)
    assert spark.read.parquet(f"{out}/predictions").count() == 2 * 2 * n_test
    again = spark.read.parquet(f"{out}/metrics")
    assert {r.run_id for r in again.select("run_id").distinct().collect()} == {"en-flat-cross-entropy-1-2-1", "en-flat-l2-1-2-1"}
    assert sorted((r.mode, r.level, r.name, r.step, round(r.value, 9)) for r in again.filter("run_id like '%entropy%'").collect()) == sorted(
        (r.mode, r.level, r.name, r.step, round(r.value, 9)) for r in rows)
    x = J.cross_test(spark, f"{out}/models/en_flat_cross-entropy_1-2_1", os.path.join(tmp_dir, "corpus"), "en", "de")
    assert {r.level for r in x.collect()} == {1, 2}
    ab = J.ablation(spark, os.path.join(tmp_dir, "corpus"), "de", 3)
    assert {r.level for r in ab.collect() if r.mode != "Training"} == {3}

    prompts = spark.createDataFrame([("en", "P", "OK")], "lang STRING, prompt STRING, ack STRING")
    ex = spark.createDataFrame([("en", 1, "q", "a")], "lang STRING, idx INT, question STRING, answer STRING")
    msgs = J.prompt_batch(spark, os.path.join(tmp_dir, "corpus"), "en", "test", 1, prompts, ex)
    assert all(len(r.messages) == 5 for r in msgs.collect())
    good = "[" + ", ".join(["0.5", "0.5"] + ["0.0"] * 26) + "]"
    resp = msgs.select("itemid", "inst_lang", F.lit(1).alias("attempt"),
                       F.when(F.col("itemid") % 2 == 0, F.lit(good)).otherwise(F.lit("no")).alias("response"))
    sc = {r.level: r for r in J.score_prompt_responses(spark, os.path.join(tmp_dir, "corpus"), "en", "test",
                                                        resp).collect()}
    assert set(sc) == {1, 2, 3} and sc[1].bad_outputs >= 0


def line(rel, sense, a1, a2):
    f = [""] * 22
    f[0], f[7], f[8], f[14], f[20] = rel, "because", sense, a1, a2
    return "|".join(f)


def test_relations_embed_cluster(spark, tmp_dir):
    gold, raw = os.path.join(tmp_dir, "gold"), os.path.join(tmp_dir, "raw")
    rnd = random.Random(5)
    senses = ["Temporal.Synchronous", "Contingency.Cause.Reason", "Comparison.Contrast", "Expansion.Conjunction"]
    for d in (gold, raw):
        os.makedirs(os.path.join(d, "00"))
    for f in range(6):
        text = " ".join(rnd.choice(WORDS) for _ in range(200))
        with open(os.path.join(raw, "00", f"wsj_{f:04d}"), "w", encoding="iso-8859-1") as fh:
            fh.write(text)
        with open(os.path.join(gold, "00", f"wsj_{f:04d}"), "w") as fh:
            for j in range(8):
                b = j * 20
                fh.write(line("Implicit", senses[(f + j) % 4], f"{b}..{b + 15}", f"{b + 200}..{b + 230}") + "\n")
    rel = J.prepare_relations(spark, gold, raw, os.path.join(tmp_dir, "rel"))
    assert rel.count() == 48
    emb = J.embed_relations(rel, os.path.join(tmp_dir, "emb"), num_features=256)
    overall, per = J.cluster_relations(emb, "implicit", "kmeans")
    acc = overall.first().accuracy
    assert 0.0 <= acc <= 100.0
    assert {r.sense1 for r in per.collect()} == {"Temporal", "Contingency", "Comparison", "Expansion"}
