"""Sinks (S6-S9): partitioned corpus, sorted relations, predictions, metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from labeldist.session import written


def write_corpus(df: DataFrame, path: str, partition_by: Sequence[str] = ("inst_lang", "split"),
                 mode: str = "overwrite") -> None:
    """One partitioned write instead of a file per language x split.

    Readers select a language / split by partition pruning ("all" = no
    filter).  Spark sorts by the partition columns before writing, so each
    task keeps one open file at a time.
    """
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_relations(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Relations sorted by file with an explicit tie-break.

    ``orderBy`` range-partitions on the sort key (sampled boundaries), so the
    sort is spread over all tasks and the output files are in order.  Sampling reads
    its input once more, so the relations are written down first: the texts are joined and cut once.
    """
    written(df).orderBy("file", "folder", "begin").write.mode(mode).parquet(path)


def write_predictions(df: DataFrame, path: str,
                      partition_by: Sequence[str] = ("train_lang", "test_lang", "arch", "run"),
                      mode: str = "overwrite") -> None:
    """Long prediction table, the run configuration as partition columns.

    ``overwrite`` replaces the configurations that ``df`` holds and leaves all others in the folder as they are."""
    df.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def append_metrics(df: DataFrame, path: str, mode: str = "append") -> None:
    """Append (or, with ``mode``, replace) metric rows."""
    df.write.mode(mode).parquet(path)


def write_metrics(df: DataFrame, path: str) -> None:
    """Long metrics ``(run_id, mode, level, name, step, value, ...)``, a partition per run; a run written again takes
    the place of its former rows, other runs stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)
