"""Many-to-one equi-joins that stay balanced when one key is hot.

A key holding a large share of the "many" side (one document carrying a
third of all annotation lines, one dense cell holding a third of all points)
would put that share into a single join task.  The join below finds such
keys, spreads their rows over ``buckets`` salted sub-keys and replicates the
single matching row of the "one" side into every bucket; all other keys join
unchanged (salt 0).  AQE's skew-join splitting does the same at run time for
sort-merge joins; this keeps the plan balanced whatever the session's AQE
settings.

Bounds: a hot key holds more than ``share`` of all rows, so the
frequent-items sketch returns at most about ``1 / share`` keys; only that
table is broadcast.  The salt is a hash of row content, so a recomputed task
reproduces the same assignment (and results are exact for any salt).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_SHARE = 0.01
DEFAULT_BUCKETS = 32


def hot_keys(many: DataFrame, keys: Sequence[str], share: float = DEFAULT_SHARE) -> DataFrame:
    """Keys holding more than ``share`` of the rows of ``many``.

    One pass with Spark's frequent-items sketch (``freqItems``): every task
    keeps at most ``1 / share`` counters, the result is one row, and it may
    contain a few extra keys but never misses a hot one (an extra key is only
    salted needlessly).  Lazy: no job runs until the join does."""
    keys = list(keys)
    fi = many.select(F.struct(*keys).alias("_k")).stat.freqItems(["_k"], support=share)
    return fi.select(F.explode("_k_freqItems").alias("_k")).select(*[F.col("_k")[c].alias(c) for c in keys])


def salted_join(many: DataFrame, one: DataFrame, keys: Sequence[str], how: str = "inner",
                share: float = DEFAULT_SHARE, buckets: int = DEFAULT_BUCKETS,
                salt_cols: Sequence[str] | None = None) -> DataFrame:
    """``many.join(one, keys, how)`` with hot keys split over ``buckets``.

    ``one`` must have at most one row per key.  ``salt_cols`` (default: the
    non-key atomic columns of ``many``) feed the salt hash.  Every bucket of
    a hot key holds a copy of its ``one`` row, so results are exact whatever
    salt a row gets.
    """
    keys = list(keys)
    hot = F.broadcast(hot_keys(many, keys, share).withColumn("_hot", F.lit(True)))
    atomic = (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.BinaryType)
    cols = (list(salt_cols) if salt_cols is not None else
            [f.name for f in many.schema.fields if f.name not in keys and isinstance(f.dataType, atomic)])
    h = F.xxhash64(*[F.col(c) for c in cols]) if cols else F.monotonically_increasing_id()
    m = many.join(hot, keys, "left").withColumn(
        "_salt", F.when(F.col("_hot"), F.pmod(h, F.lit(buckets))).otherwise(F.lit(0)).cast("int")).drop("_hot")
    o = one.join(hot, keys, "left").withColumn(
        "_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(buckets - 1)))
                           .otherwise(F.array(F.lit(0))))).drop("_hot")
    return m.join(o, [*keys, "_salt"], how).drop("_salt")
