"""Dataflow B, text half: stand-off annotation lines + raw documents ->
relation table (P10-P16, J1, F4, F5, U3)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labeldist import taxonomy as tx
from labeldist.functions import annotation as A
from labeldist.functions import text as TX
from labeldist.functions.distributions import sql_lit
from labeldist.operators import skew as SK

DOC_KEYS = ["folder", "file"]


def parse_lines(ann: DataFrame, line_col: str = "line", keep: Sequence[str] = DOC_KEYS) -> DataFrame:
    """P10, P11, P13 on annotation lines: positional fields, optional second
    sense (implicit lines only) and both sense paths split into levels."""
    df = ann.select(*keep, A.parse_annotation(line_col).alias("a"), F.col(line_col))
    df = df.select(*keep, "a.*", A.parse_second_sense(line_col, "a.relation").alias("m"))
    df = df.select("*", "m.*").drop("m")
    df = df.select("*", A.split_sense("sense", "sense").alias("s1"),
                   A.split_sense("multi_sense", "multi_sense").alias("s2"))
    return df.select("*", "s1.*", "s2.*").drop("s1", "s2")


def attach_text(rel: DataFrame, docs: DataFrame, keys: Sequence[str] = DOC_KEYS,
                text_col: str = "text", hot_share: float | None = None) -> DataFrame:
    """J1 + P14 + P15: join every relation with its document once and cut
    the argument spans out of the text.

    An equi-join on the document keys: each document is read and shuffled
    once (the reference re-opens the file per span).  Skew is left to AQE, which
    splits a document's many lines and repeats its text; with ``hot_share``
    a document that carries more than that share of all lines is split over
    salted buckets (:func:`labeldist.operators.skew.salted_join`), at the price of
    one more pass over the lines.
    """
    d = docs.select(*keys, F.col(text_col).alias("_text"))
    j = (SK.salted_join(rel, d, keys, "inner", share=hot_share) if hot_share
         else rel.join(d, list(keys)))
    sp1, sp2 = A.parse_spans("arg1_spans"), A.parse_spans("arg2_spans")
    j = j.withColumn("_sp1", sp1).withColumn("_sp2", sp2)
    j = j.withColumn("arg1", A.slice_spans("_text", "_sp1")).withColumn("arg2", A.slice_spans("_text", "_sp2"))
    j = j.withColumn("begin", F.element_at("_sp1", 1)["b"])
    return j.drop("_text", "_sp1", "_sp2")


def lines_without_document(ann: DataFrame, docs: DataFrame, keys: Sequence[str] = DOC_KEYS) -> DataFrame:
    """Annotation lines that :func:`attach_text` leaves out because their document is missing."""
    return ann.join(docs.select(*keys), list(keys), "left_anti")


def one_hot(df: DataFrame, col: str, vocab: Sequence[str], names: Sequence[str] | None = None) -> DataFrame:
    """One 0/1 double column per vocabulary value (exact match; NULL -> 0)."""
    names = list(names) if names is not None else [v.lower() for v in vocab]
    return df.selectExpr("*", *[f"CASE WHEN `{col}` = {sql_lit(v)} THEN 1D ELSE 0D END AS `{n}`"
                                for v, n in zip(vocab, names)])


# fixed values: columns of the relation table
RELATION_COLUMNS = ["folder", "file", "relation", "arg1", "arg2", "arg1_arg2", "connective", "sense",
                    "sense_final", "sense1", "sense2", "sense3", "multi_connective", "multi_sense",
                    "multi_sense_final", "multi_sense1", "multi_sense2", "multi_sense3"]


def build_relations(ann: DataFrame, docs: DataFrame,
                    l2_vocab: Sequence[str] = tx.STANDOFF_L2,
                    l1_vocab: Sequence[str] = tx.STANDOFF_L1) -> DataFrame:
    """Annotation lines ``(folder, file, line)`` + documents ``(folder, file,
    text)`` -> relation table with one-hot level-2 and level-1 senses."""
    rel = attach_text(parse_lines(ann), docs)
    rel = rel.withColumn("arg1_arg2", TX.pair_text("arg1", "arg2"))
    return sense_columns(rel.select(*RELATION_COLUMNS, "begin"), l2_vocab, l1_vocab)


def sense_columns(rel: DataFrame, l2_vocab: Sequence[str] = tx.STANDOFF_L2,
                  l1_vocab: Sequence[str] = tx.STANDOFF_L1) -> DataFrame:
    """Level-2 and level-1 senses of parsed lines and their one-hot columns; no text is needed for them."""
    rel = one_hot(rel.withColumn("majority_level_2", F.col("sense2")), "majority_level_2", l2_vocab)
    return one_hot(rel.withColumn("majority_level_1", F.col("sense1")), "majority_level_1", l1_vocab)


def single_sense(df: DataFrame) -> DataFrame:
    """instances with one sense only."""
    return df.filter(F.col("multi_sense1").isNull())


def by_relation(df: DataFrame, relation: str) -> DataFrame:
    """one relation type (``Explicit`` / ``Implicit``)."""
    return df.filter(F.col("relation") == F.lit(relation))
