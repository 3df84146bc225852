"""Portable views over the generic test tables.

The test tables are not a discourse corpus, so every check query first derives
corpus-shaped data from them with plain projections / aggregations.  Each view
here has a twin in :mod:`labeldist.plans.sqlviews` written in DuckDB SQL; all of
them read whole tables and whole texts (no id subsets, row caps or prefixes).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one test table (Parquet; pruning and filters reach the scan)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


LINE_STEP = 2000  # characters of a document per annotation line


def halves(text: str) -> tuple[Column, Column]:
    """The two arguments of a pair: a text's lines up to the middle one, and the rest (NULL if empty)."""
    lines = F.split(F.col(text), "\n", -1)
    h = F.ceil(F.size(lines) / 2).cast("int")
    return (F.nullif(F.array_join(F.slice(lines, F.lit(1), h), "\n"), F.lit("")),
            F.nullif(F.array_join(F.slice(lines, h + 1, F.size(lines)), "\n"), F.lit("")))


def v_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text pairs with a split: the two halves of every document."""
    d = table(spark, sf_dir, "documents")
    mod = F.col("doc_id") % 10
    return d.select(
        F.col("doc_id").alias("itemid"),
        F.col("lang").alias("inst_lang"),
        F.when(mod < 7, "train").when(mod == 7, "dev").otherwise("test").alias("split"),
        *[c.alias(n) for c, n in zip(halves("text"), ("arg1", "arg2"))],
    )


def vote_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One crowd vote per event: ``(itemid, l3_idx, side)``.

    ``l3_idx`` 28 is the excluded label; side 0 = gold annotators, 1 = the
    second group (used as "predicted").  Not grouped: aggregating operators
    consume it directly so the whole distribution build is one shuffle.
    """
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("itemid"),
        ((F.col("event_id") * 7919 + F.col("user_id") * 104729) % 29).cast("int").alias("l3_idx"),
        (F.col("event_id") % 2).cast("int").alias("side"),
    )


def v_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vote counts per (item, label, side)."""
    return (vote_rows(spark, sf_dir).groupBy("itemid", "l3_idx", "side")
            .agg(F.count(F.lit(1)).alias("n")))


def v_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-quoted distribution and language-list literals per document."""
    d = table(spark, sf_dir, "documents")
    digit = lambda e: (e % 10).cast("string")
    dist = F.concat(
        F.lit('{"s0": 0.'), digit(F.col("doc_id")),
        F.lit(', "s1": 0.'), digit(F.col("doc_id") * 3),
        F.lit(', "norel": 0.'), digit(F.col("doc_id") * 7), F.lit("}"))
    langs = F.concat(F.lit('["'), F.col("lang"), F.lit('", "en"]'))
    return d.select(
        F.col("doc_id").alias("itemid"),
        F.replace(dist, F.lit('"'), F.lit("'")).alias("dist"),
        F.replace(langs, F.lit('"'), F.lit("'")).alias("langs"),
    )


def v_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per item (document), one text column per language (with gaps)."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("itemid"), *[
        F.when(F.col("lang") == l, F.col("text")).alias(f"text_{l}") for l in ("en", "de", "fr", "es")])


def v_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pipe-delimited stand-off annotation lines: one for every ``LINE_STEP`` characters
    of a document, with spans there; every eleventh is of a type that is not read."""
    n = F.floor(F.coalesce(F.char_length("text"), F.lit(0)) / LINE_STEP).cast("int")
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), n)).alias("k"))
    i = F.col("doc_id") + F.col("k")
    at = F.col("k") * LINE_STEP
    s = lambda e: e.cast("string")
    fields = [
        F.when(i % 11 == 0, "EntRel").when(i % 3 == 0, "Explicit").otherwise("Implicit"),
        F.lit(""), F.lit(""), F.lit(""), F.lit(""), F.lit(""), F.lit(""),
        F.lit("because"),
        F.when(i % 2 == 0, "Contingency.Cause.Reason").otherwise("Expansion.Conjunction"),
        F.lit(""),
        F.when(i % 5 == 0, "so").otherwise(""),
        F.when(i % 5 == 0, "Contingency.Cause.Result").otherwise(""),
        F.lit(""), F.lit(""),
        F.concat(s(at + i % 5), F.lit(".."), s(at + i % 5 + 12)),
        F.lit(""), F.lit(""), F.lit(""), F.lit(""), F.lit(""),
        F.concat(s(at + 20), F.lit(".."), s(at + 25), F.lit(";"), s(at + 30), F.lit(".."), s(at + 31 + i % 7)),
        F.lit(""),
    ]
    return d.select("doc_id", F.concat_ws("|", *fields).alias("line"))


def v_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic stand-in for fitted clusters (4 senses x 4 clusters)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        "vec_id",
        (F.col("label") % 4).alias("sense"),
        (F.when(F.col("vec_id") % 3 == 0, F.col("vec_id"))
          .otherwise(F.col("label")) % 4).alias("cluster"),
    )


def v_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three repeated runs of a 4-class prediction (gold vs pred per run)."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    r = e.select("vec_id", "label", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("run"))
    return r.select(
        "run", "vec_id",
        (F.col("label") % 4).alias("gold"),
        (F.when((F.col("vec_id") + F.col("run")) % 3 == 0, F.col("vec_id"))
          .otherwise(F.col("label")) % 4).alias("pred"),
    )


def response_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that received model responses: distinct users of ``events``."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("itemid")).distinct()


def v_responses(spark: SparkSession, sf_dir: str, attempts: int = 6) -> DataFrame:
    """Model answers ``(itemid, attempt, response)``, attempts 1..6, with five
    malformed kinds out of seven residues of ``itemid + attempt``."""
    it = response_items(spark, sf_dir)
    good = F.expr("concat('[', array_join(transform(sequence(0, 27), i -> CASE WHEN i = itemid % 28 THEN '0.7' "
                  "WHEN i = (itemid + 9) % 28 THEN '0.3' ELSE '0.0' END), ', '), ']')")
    r = it.select("itemid", F.explode(F.sequence(F.lit(1), F.lit(attempts))).alias("attempt"),
                  good.alias("good"))
    k = (F.col("itemid") + F.col("attempt")) % 7
    resp = (F.when(k == 0, F.replace("good", F.lit("0.7"), F.lit("0.8")))
             .when(k == 1, F.replace("good", F.lit(", "), F.lit(" ")))
             .when(k == 2, F.concat(F.lit("Answer: "), F.col("good")))
             .when(k == 3, F.replace("good", F.lit("[0.0"), F.lit("[0")))
             .when(k == 4, F.lit("[0.5, 0.5]"))
             .otherwise(F.col("good")))
    return r.select("itemid", F.col("attempt").cast("int").alias("attempt"), resp.alias("response"))
