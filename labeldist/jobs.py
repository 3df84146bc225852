"""End-to-end jobs: one function per task of the original workflow, composed
from the library's operators (reading and writing tables, never collecting
data to the driver).

=====================  =====================================================
corpus preparation     :func:`prepare_corpus`
relation preparation   :func:`prepare_relations`
relation embeddings    :func:`embed_relations`
clustering evaluation  :func:`cluster_relations`
training + testing     :func:`train_and_test` (repeated runs, metrics, predictions)
cross-language test    :func:`cross_test`
single-level ablation  :func:`ablation`
prompt batches         :func:`prompt_batch`, :func:`score_prompt_responses`
=====================  =====================================================
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labeldist.functions import distributions as D
from labeldist.functions import text as TX
from labeldist.operators import clustering as CL
from labeldist.operators import corpus as C
from labeldist.operators import distributions as OD
from labeldist.operators import features as FE
from labeldist.operators import heads as H
from labeldist.operators import metrics as M
from labeldist.operators import prompts as PR
from labeldist.operators import standoff as SO
from labeldist.session import written
from labeldist.sources import readers as R
from labeldist.sources import sinks as K

LEVELS = (1, 2, 3)


# ------------------------------------------------------------------ data prep

def prepare_corpus(spark: SparkSession, items_path: str, out_path: str,
                   langs: Sequence[str] = C.CORPUS_LANGS, multiline: bool = True) -> DataFrame:
    """Item table -> instances, written once partitioned by language and split.

    Returns the written table (read back, so later steps prune partitions)."""
    inst = C.prepare_instances(R.read_items(spark, items_path, langs, multiline), langs)
    K.write_corpus(inst, out_path)
    return spark.read.parquet(out_path)


def load_split(spark: SparkSession, corpus_path: str, lang: str = "all", split: str | None = None) -> DataFrame:
    """Instances of one language (``all`` = every language) and split; the
    filters prune the corpus partitions."""
    df = spark.read.parquet(corpus_path)
    if lang != "all":
        df = df.filter(F.col("inst_lang") == lang)
    if split is not None:
        df = C.split(df, split)
    return df


def prepare_relations(spark: SparkSession, gold_root: str, raw_root: str, out_path: str) -> DataFrame:
    """Annotation tree + raw documents -> relation table sorted by file."""
    rel = SO.build_relations(R.read_annotations(spark, gold_root), R.read_raw_docs(spark, raw_root))
    K.write_relations(rel, out_path)
    return spark.read.parquet(out_path)


def embed_relations(relations: DataFrame, out_path: str | None = None, encoder=None,
                    num_features: int = FE.DEFAULT_FEATURES) -> DataFrame:
    """Single-sense relations with an embedding of the argument pair."""
    rel = SO.single_sense(relations).filter(F.col("arg1_arg2").isNotNull())
    emb = FE.embed(rel.select("folder", "file", "begin", "relation", "sense1", "arg1_arg2"),
                   "arg1_arg2", "embedding", encoder=encoder, num_features=num_features)
    emb = emb.drop("arg1_arg2")
    if out_path is None:
        return emb
    emb.write.mode("overwrite").parquet(out_path)
    return emb.sparkSession.read.parquet(out_path)


def cluster_relations(embeddings: DataFrame, relation: str = "Implicit", algorithm: str = "kmeans",
                      k: int = 4, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """One relation type clustered and evaluated against its level-1 sense:
    ``(overall accuracy, accuracy per sense)`` in percent."""
    rel = SO.by_relation(embeddings, relation.capitalize())
    c = CL.cluster(FE.as_features(rel), algorithm, k=k, seed=seed)
    _, overall, per = CL.evaluate_clusters(c.select("file", "begin", "sense1", "cluster"), "cluster", "sense1")
    return overall, per


# ------------------------------------------------------------------ soft-label heads

def _encoder(train: DataFrame, features: str):
    """The text encoder fitted on the training split only (IDF from training
    texts), or None when the instances already carry ``features``."""
    if features in train.columns:
        return None
    return FE.text_encoder("arg1_arg2", features).fit(train)


def _apply(enc, df: DataFrame) -> DataFrame:
    return df if enc is None else enc.transform(df).drop("_tokens", "_tf")


def per_level_js(scored: DataFrame, keys: Sequence[str], levels: Sequence[int] = LEVELS) -> DataFrame:
    """JS distance (smoothed gold vs shifted, smoothed scores) per instance and level."""
    per = F.array(*[F.struct(F.lit(lv).alias("level"), D.classifier_js(f"dist_l{lv}", f"scores_l{lv}").alias("js"),
                             D.argmax_idx(f"dist_l{lv}").alias("label"), D.argmax_idx(f"scores_l{lv}").alias("pred"))
                    for lv in levels])
    return scored.select(*keys, F.inline(per))


def long_metrics(js: DataFrame, mode: str, keys: Sequence[str]) -> DataFrame:
    """``(mode, level, name, step, value)`` of scored rows: mean JS, mean of batch means, accuracy of the argmax labels."""
    mean = OD.mean_distance(js, col="js", out="mean_js", digits=None)
    batch = M.mean_of_batch_means(js, "js", keys, ["level"], out="batch_mean_js")
    acc = M.accuracy(js, "label", "pred", ["level"])
    names = ("mean_js", "batch_mean_js", "accuracy")
    m = mean.join(batch, "level").join(acc, "level")
    return m.select(F.lit(mode).alias("mode"), "level", F.inline(F.array(*[F.struct(
        F.lit(n).alias("name"), F.lit(0).alias("step"), F.col(n).cast("double").alias("value")) for n in names])))


def train_and_test(spark: SparkSession, corpus_path: str, lang: str = "all", arch: str = "flat",
                   loss: str = "cross-entropy", runs: int = 1, levels: Sequence[int] = LEVELS,
                   features: str = "features", out_path: str | None = None,
                   max_iter: int = 100) -> DataFrame:
    """Fit the heads on the training split ``runs`` times (run number = seed of the starting weights) and measure them.

    Returns the long metrics ``(run_id, mode, level, name, step, value, config)``: per level the validation and test JS (mean,
    mean of batch means) and accuracy, the JS of every tenth batch of the training split (``step``: the batch), and the
    training loss after every step of the fit (level 0).  With ``out_path`` test predictions (S8), metrics (S9) and models
    (M17) are written under it, by run: other configurations in the folder stay, the same run takes its own place."""
    train_raw = load_split(spark, corpus_path, lang, "train")
    enc = _encoder(train_raw, features)
    keys, of_levels = ["itemid", "inst_lang"], "-".join(map(str, sorted(levels)))
    labels = {lv: f"dist_l{lv}" for lv in LEVELS}
    # scored after every run; without the texts, spills to disk, and is computed again from the corpus if an executor is lost
    train = _apply(enc, train_raw).select(*keys, *labels.values(), features).persist(StorageLevel.MEMORY_AND_DISK)
    blocks = H.packed(train, features, labels, sorted(levels))
    sets = {"Validation": _apply(enc, load_split(spark, corpus_path, lang, "dev")),
            "Testing": _apply(enc, load_split(spark, corpus_path, lang, "test"))}
    metrics, run_ids = [], []
    for run in range(1, runs + 1):
        model = H.fit_blocks(blocks, features, arch, sorted(levels), loss, max_iter, seed=run)
        run_id = f"{lang}-{arch}-{loss}-{of_levels}-{run}"
        run_ids.append(run_id)
        rows = [spark.createDataFrame([("Training", 0, "loss", i, float(v)) for i, v in enumerate(model.history)],
                                      "mode STRING, level INT, name STRING, step INT, value DOUBLE")]
        progress = M.sampled_batches(per_level_js(H.score(model, train), keys, levels), "js", keys, ["level"], out="value", digits=None)
        rows.append(progress.select(F.lit("Training").alias("mode"), "level", F.lit("js").alias("name"),
                                    F.col("batch_idx").cast("int").alias("step"), "value"))
        for mode, data in sets.items():
            js = per_level_js(H.score(model, data), keys, levels)
            rows.append(long_metrics(js, mode, keys))
            if out_path and mode == "Testing":
                pred = js.select(F.lit(lang).alias("train_lang"), F.col("inst_lang").alias("test_lang"), F.lit(arch).alias("arch"),
                                 F.lit(loss).alias("loss"), F.lit(of_levels).alias("levels"), F.lit(run).alias("run"),
                                 "itemid", "level", "label", "pred")
                K.write_predictions(pred, f"{out_path}/predictions", ("train_lang", "test_lang", "arch", "loss", "levels", "run"))
        config = F.create_map(*[F.lit(x) for x in ("lang", lang, "arch", arch, "loss", loss, "levels", of_levels, "run", str(run))])
        of_run = functools.reduce(DataFrame.unionByName, rows).select(
            F.lit(run_id).alias("run_id"), "mode", "level", "name", "step", "value", config.alias("config"))
        if out_path:
            K.write_metrics(of_run, f"{out_path}/metrics")
            mdir = f"{out_path}/models/{lang}_{arch}_{loss}_{of_levels}_{run}"
            H.save_model(model, mdir)
            if enc is not None:
                enc.write().overwrite().save(f"{mdir}/encoder")
        else:
            metrics.append(written(of_run))
    train.unpersist()
    if out_path:
        return spark.read.parquet(f"{out_path}/metrics").filter(F.col("run_id").isin(run_ids)).select(
            "run_id", "mode", "level", "name", "step", "value", "config")
    return functools.reduce(DataFrame.union, metrics)


def cross_test(spark: SparkSession, model_path: str, corpus_path: str, train_lang: str, test_lang: str,
               features: str = "features") -> DataFrame:
    """Score a saved model (and its saved text encoder, if any) on another
    language's test split: one row of the A10 matrix per level."""
    from pyspark.ml import PipelineModel
    model = H.load_model(spark, model_path)
    test = load_split(spark, corpus_path, test_lang, "test")
    if features not in test.columns:
        test = _apply(PipelineModel.load(f"{model_path}/encoder"), test)
    js = per_level_js(H.score(model, test), ["itemid", "inst_lang"], model.levels)
    return (M.cross_eval(js.withColumn("train_lang", F.lit(train_lang)).withColumn("test_lang", F.lit(test_lang)),
                         "js", "label", "pred"))


def ablation(spark: SparkSession, corpus_path: str, lang: str, level: int, runs: int = 1,
             loss: str = "cross-entropy", out_path: str | None = None) -> DataFrame:
    """Single-level heads (M14), same protocol as :func:`train_and_test`."""
    return train_and_test(spark, corpus_path, lang, "flat", loss, runs, [level], out_path=out_path)


# ------------------------------------------------------------------ prompts

def prompt_batch(spark: SparkSession, corpus_path: str, lang: str, mode: str, k: int,
                 prompts: DataFrame, exemplars: DataFrame) -> DataFrame:
    """Message arrays for every instance of the validation or test split.

    ``prompts`` is ``(lang, prompt, ack)`` (e.g. from :func:`read_prompts`
    plus an acknowledgement column), ``exemplars`` ``(lang, idx, question,
    answer)``.  Output ``(itemid, inst_lang, messages)``."""
    split = {"validation": "dev", "test": "test"}[mode]
    df = load_split(spark, corpus_path, lang, split)
    df = df.select("itemid", "inst_lang", TX.format_question("arg1", "arg2").alias("question"),
                   F.lit(lang).alias("lang"))
    return PR.build_messages(df, prompts, exemplars, k).select("itemid", "inst_lang", "messages")


def score_prompt_responses(spark: SparkSession, corpus_path: str, lang: str, mode: str,
                           responses: DataFrame) -> DataFrame:
    """Responses ``(itemid, inst_lang, attempt, response)`` -> first valid
    answer per instance -> mean JS per level over valid answers and the
    number of instances without one."""
    split = {"validation": "dev", "test": "test"}[mode]
    gold = load_split(spark, corpus_path, lang, split).select(
        "itemid", "inst_lang", *[F.col(f"dist_l{lv}").alias(f"gold_l{lv}") for lv in LEVELS])
    items = gold.select("itemid", "inst_lang")
    first = PR.first_valid(responses, ["itemid", "inst_lang"], items=items)
    return PR.score_responses(first, gold, ["itemid", "inst_lang"])


__all__ = ["prepare_corpus", "load_split", "prepare_relations", "embed_relations", "cluster_relations",
           "train_and_test", "cross_test", "ablation", "prompt_batch", "score_prompt_responses",
           "per_level_js"]
