"""Shared column expressions and small helpers of the training-data operators.

Working columns start with two underscores, so input columns of any other
name (``size``, ``score``, ``target`` ...) may be present and never clash.
"""

from __future__ import annotations

import functools
import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labeldist.session import SMALL_GROUPS, scratch_path, text_batches  # noqa: F401

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
#: What lies between words of letters, digits and characters beyond ASCII, once A-Z are in lower case.
PLAIN_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A table is broadcast only after it was counted and has at most so many (narrow) rows; beyond, it is joined by a shuffle.
MAX_BROADCAST_ROWS = 1_000_000
_MULT = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; every other character is left as it is."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def n_words(c: Column) -> Column:
    """Number of words of a text (null: 0)."""
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def crc_mod(c: Column, m: int) -> Column:
    """crc32 of the value as text, modulo ``m`` (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % m


def column_or_null(df: DataFrame, name: str, kind: str) -> Column:
    """The named column, or a typed null where the table has none."""
    return F.col(f"`{name}`") if name in df.columns else F.lit(None).cast(kind)


def stored(df: DataFrame, name: str, large_rows: bool = False) -> DataFrame:
    """The frame, written as Parquet to the shared folder and read again: compressed, and safe from lost executors.

    ``large_rows``: see :data:`labeldist.session.SMALL_GROUPS`."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").options(**SMALL_GROUPS if large_rows else {}).parquet(path)
    return df.sparkSession.read.parquet(path)


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Total length of all texts: one aggregate row, used to size groups to the data."""
    return int(docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0)


def settled(df: DataFrame, from_table: bool) -> DataFrame:
    """A frame that gives the same rows in the same places whenever it is read.

    Tables and files do (``from_table``); the result of a shuffle need not, and is written to the shared folder first."""
    return df if from_table else stored(df, "rows")


def row_ids(df: DataFrame, name: str = "__rid") -> DataFrame:
    """Add a row number that is unique also among repeated rows and null ids.

    It comes from the row's place in its partition: see :func:`settled`."""
    return df.withColumn(name, F.monotonically_increasing_id())


def slices(batch: pa.RecordBatch, text: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``limit`` bytes of text (one long text is a slice of its own)."""
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size) // limit
    start = np.flatnonzero(np.diff(part, prepend=-1))
    for a, b in zip(start, [*start[1:], batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


def words_of(texts: pa.Array, gap: str = GAP) -> tuple[np.ndarray, pa.Array]:
    """The words of all texts (between matches of ``gap``; null: none), and the index of each one's text."""
    parts = pc.split_pattern_regex(pc.fill_null(texts, ""), gap)
    flat, owner = parts.flatten(), pc.list_parent_indices(parts)
    full = pc.greater(pc.binary_length(flat), 0)
    return owner.filter(full).to_numpy().astype(np.int64), flat.filter(full)


def lists(offsets: np.ndarray, values: np.ndarray | pa.Array) -> pa.ListArray:
    """One list for each two neighbouring offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values if isinstance(values, pa.Array) else pa.array(values))


def word_hashes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the distinct words, and the place of every word among them."""
    coded = words.dictionary_encode()
    hashes = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False).astype(object), categorize=False)
    return hashes.view(np.int64), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def in_blocks(df: DataFrame, blocks: DataFrame, n_blocks: int, at_once: int) -> DataFrame:
    """Every row of ``df`` with every row of ``blocks`` (numbered by ``block`` from 0, of bounded size each): ``df`` stays
    where it is, and ``at_once`` blocks at a time are broadcast."""
    parts = [df.withColumn("block", F.explode(F.sequence(F.lit(a), F.lit(min(a + at_once, n_blocks) - 1)))).join(
        F.broadcast(blocks.filter(F.col("block").between(a, a + at_once - 1))), "block") for a in range(0, n_blocks, at_once)]
    return functools.reduce(DataFrame.union, parts)


def small(df: DataFrame) -> DataFrame:
    """A hint to broadcast a narrow table, if a count shows that it has few rows."""
    return F.broadcast(df) if df.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS else df


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two 64-bit integers (order matters)."""
    h = (a * _MULT) ^ (a >> np.uint64(29))
    h = (h + b + np.uint64(1)) * _MULT
    h = (h ^ (h >> np.uint64(32))) * _MULT
    return h ^ (h >> np.uint64(29))
