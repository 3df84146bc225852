"""Queries of the training-data operators, one per operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from labeldist.llm import cover_tree, dual_tree, flat_graph, fm_index, katz, language_id, line_dedup, mixing, ngram_join, periodic_runs, pu_quality, sentencepieces, surrogates
from labeldist.llm.common import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _register(name: str, tables: tuple[str, ...], fn, sql: str | None = None) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(*[table(spark, sf_dir, t) for t in tables])
    QUERIES[name] = query
    if sql:
        ORACLE[name] = sql.strip()


_register("op1_pii_surrogates", ("documents",), surrogates.op1)
_register("op2_katz_backoff", ("documents",), katz.op2)
_register("op3_cover_tree_topk", ("embeddings",), cover_tree.op3, cover_tree.SQL)
_register("op4_flat_graph_dedup", ("embeddings",), flat_graph.op4)
_register("op5_ngram_jaccard_join", ("documents",), ngram_join.op5)
_register("op6_line_dedup", ("documents",), line_dedup.op6, line_dedup.SQL)
_register("op7_pu_quality", ("documents", "labels"), pu_quality.op7)
_register("op8_mix_sources", ("documents",), mixing.op8, mixing.SQL)
_register("op9_language_id", ("documents",), language_id.op9)
_register("op10_sentencepiece_samples", ("documents",), sentencepieces.op10)
_register("op11_periodic_runs", ("documents",), periodic_runs.op11)
_register("op12_fm_index_decontamination", ("documents", "benchmark"), fm_index.op12, fm_index.SQL)
_register("op13_dual_tree_search", ("documents", "benchmark"), dual_tree.op13, dual_tree.SQL)
