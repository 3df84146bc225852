"""Evaluation metrics (A3-A12, J4): accuracy, weighted P/R/F1, batch means,
cross-lingual matrices and run summaries.

Every metric is a grouped aggregation with partial (map-side) aggregation;
no metric collects rows to the driver.  The batch mean needs only the last
few rows of each group (a per-task group limit); the sampled batches need a
global row order, which :func:`distributed_rank` provides without a
single-partition window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labeldist.session import written

BATCH_SIZE = 16  # fixed value: batch size of the reference evaluation loops
LOG_EVERY = 10   # fixed value: progress metrics every tenth batch


def _eq(gold: str, pred: str):
    # NULL prediction (unmapped cluster, missing answer) counts as wrong
    return F.coalesce(F.col(pred) == F.col(gold), F.lit(False))


def accuracy(df: DataFrame, gold: str = "gold", pred: str = "pred",
             by: Sequence[str] = (), out: str = "accuracy", digits: int | None = 6) -> DataFrame:
    """A3: percentage of rows whose prediction equals the gold label."""
    a = F.avg(_eq(gold, pred).cast("double")) * 100.0
    return df.groupBy(*by).agg((F.round(a, digits) if digits is not None else a).alias(out))


def accuracy_by_label(df: DataFrame, gold: str = "gold", pred: str = "pred",
                      by: Sequence[str] = (), out: str = "accuracy", digits: int | None = 6) -> DataFrame:
    """A4: accuracy per gold label (rows without a gold label are left out)."""
    return accuracy(df.filter(F.col(gold).isNotNull()), gold, pred, [*by, gold], out, digits)


def weighted_prf(df: DataFrame, gold: str = "gold", pred: str = "pred",
                 by: Sequence[str] = (), digits: int | None = 6) -> DataFrame:
    """A5: support-weighted precision, recall and F1 (undefined ratios -> 0).

    One pass builds per-class (support, predicted, true positives) from a
    two-row expansion of every instance; the per-class table (one row per
    class and group) is then reduced to the weighted means.
    """
    by = list(by)
    hit = _eq(gold, pred).cast("long")
    x = df.select(*by, F.inline(F.array(
        F.struct(F.col(gold).alias("cls"), F.lit(1).alias("g"), F.lit(0).alias("p"), hit.alias("tp")),
        F.struct(F.col(pred).alias("cls"), F.lit(0).alias("g"), F.lit(1).alias("p"), F.lit(0).cast("long").alias("tp")))))
    per = (x.filter(F.col("cls").isNotNull()).groupBy(*by, "cls")
           .agg(F.sum("g").alias("support"), F.sum("p").alias("npred"), F.sum("tp").alias("tp")))
    prec = F.when(F.col("npred") > 0, F.col("tp") / F.col("npred")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    per = per.select(*by, "support", prec.alias("p"), rec.alias("r"))
    f1 = F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0)
    per = per.withColumn("f", f1)
    tot = F.sum("support")

    def w(c):
        v = F.sum(F.col(c) * F.col("support")) / tot
        return F.round(v, digits) if digits is not None else v
    return per.groupBy(*by).agg(w("p").alias("precision"), w("r").alias("recall"), w("f").alias("f1"))


def distributed_rank(df: DataFrame, order: Sequence[str], by: Sequence[str] = (),
                     out: str = "rank") -> DataFrame:
    """0-based rank of every row within its ``by`` group, in ``order``
    (the columns must identify rows within a group).

    A range-partitioned sort on ``(by, order)`` spreads the rows over all
    tasks; inside a task the rows of a group are contiguous, so a row's rank
    is its group's offset in that task plus its distance from the group's
    first row there.  The sorted rows are checkpointed with their place, since
    two range exchanges need not cut at the same keys: rows and offsets must
    come from the same one.  The offsets table has one row per (task, group)
    that meets.
    """
    by, keys = list(by), [*by, *order]
    s = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    s = written(s.withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id()))
    counts = s.groupBy("_pid", *by).agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    w = Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = counts.select(F.col("_pid").alias("_p"), *[F.col(b).alias(f"_by_{b}") for b in by], "_first",
                            (F.sum("_n").over(w) - F.col("_n")).alias("_off"))
    same = F.col("_pid") == F.col("_p")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_by_{b}"))
    r = s.join(offsets, same)
    return r.withColumn(out, F.col("_off") + F.col("_mid") - F.col("_first")).select(*df.columns, out)


def with_batches(df: DataFrame, key: Sequence[str], by: Sequence[str] = (),
                 batch_size: int = BATCH_SIZE, out: str = "batch_idx") -> DataFrame:
    """Batch index ``floor(rank_in_group / batch_size)`` in a stable key order."""
    r = distributed_rank(df, key, by, "_rk")
    return r.withColumn(out, F.floor(F.col("_rk") / batch_size).cast("long")).drop("_rk")


def mean_of_batch_means(df: DataFrame, value: str, key: Sequence[str], by: Sequence[str] = ("level",),
                        batch_size: int = BATCH_SIZE, out: str = "batch_mean",
                        digits: int | None = 6) -> DataFrame:
    """Mean over batches of the batch mean, batches of ``batch_size`` cut
    in a stable key order (a short last batch weighs as much as a full one).

    No global sort is needed: with ``n`` rows, sum ``S`` and ``r = n mod b``,
    every batch but the last is full, so the result is
    ``((S - T) / b + T / r) / ceil(n / b)`` where ``T`` is the sum of the last
    ``r`` rows in key order (``S / n`` when ``r = 0``).  Those rows come from a
    ``row_number() <= b - 1`` window, which Spark plans as a per-task group
    limit before the shuffle.  Rows whose ``value`` is NULL are left out.
    """
    by = list(by)
    df = df.filter(F.col(value).isNotNull())
    grouped = bool(by)
    if not grouped:
        df, by = df.withColumn("_g", F.lit(0)), ["_g"]
    stats = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_s"))
    w = Window.partitionBy(*by).orderBy(*[F.col(k).desc() for k in key])
    tail = (df.select(*by, F.col(value).alias("_v"), F.row_number().over(w).alias("_rn"))
              .filter(F.col("_rn") <= batch_size - 1))
    # stats has one row per group: small, joined by group key (no cross join)
    t = tail.join(stats.select(*by, "_n"), by)
    t = t.filter(F.col("_rn") <= F.col("_n") % batch_size).groupBy(*by).agg(F.sum("_v").alias("_t"))
    j = stats.join(t, by, "left")
    r = F.col("_n") % batch_size
    tt = F.coalesce(F.col("_t"), F.lit(0.0))
    nb = F.ceil(F.col("_n") / batch_size)
    m = F.when(r == 0, F.col("_s") / F.col("_n")).otherwise(((F.col("_s") - tt) / batch_size + tt / r) / nb)
    res = j.select(*by, (F.round(m, digits) if digits is not None else m).alias(out))
    return res if grouped else res.drop("_g")


def sampled_batches(df: DataFrame, value: str, key: Sequence[str], by: Sequence[str] = ("level",),
                    every: int = LOG_EVERY, batch_size: int = BATCH_SIZE, out: str = "batch_mean",
                    digits: int | None = 6) -> DataFrame:
    """Batch means of every ``every``-th batch (the progress samples)."""
    b = with_batches(df, key, by, batch_size)
    b = b.filter(F.col("batch_idx") % every == 0)
    m = F.avg(value)
    return b.groupBy(*by, "batch_idx").agg((F.round(m, digits) if digits is not None else m).alias(out))


def valid_mean(df: DataFrame, value: str, valid: str, by: Sequence[str] = (),
               out: str = "mean_distance", digits: int | None = 6) -> DataFrame:
    """Mean over valid rows only (NULL if none) and the count of bad rows."""
    m = F.avg(F.when(F.col(valid), F.col(value)))
    return df.groupBy(*by).agg((F.round(m, digits) if digits is not None else m).alias(out),
                               F.count_if(~F.col(valid)).alias("bad_outputs"))


def cross_eval(df: DataFrame, value: str = "js", gold: str = "gold", pred: str = "pred",
               by: Sequence[str] = ("train_lang", "test_lang", "level"), digits: int | None = 6) -> DataFrame:
    """A10: train-language x test-language matrix of mean distance and accuracy."""
    m = F.avg(value)
    a = F.avg(_eq(gold, pred).cast("double")) * 100.0
    r = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    return df.groupBy(*by).agg(r(m).alias("mean_js"), r(a).alias("accuracy"))


def run_summary(df: DataFrame, metric: str, by: Sequence[str] = (), digits: int | None = 6) -> DataFrame:
    """Mean and sample standard deviation of a per-run metric."""
    r = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    return df.groupBy(*by).agg(r(F.avg(metric)).alias(f"mean_{metric}"),
                               r(F.stddev_samp(metric)).alias(f"std_{metric}"),
                               F.count(F.lit(1)).alias("n_runs"))


def distinct_labels(df: DataFrame, col: str) -> DataFrame:
    """Distinct non-NULL label values, ordered."""
    return df.select(col).filter(F.col(col).isNotNull()).distinct().orderBy(col)


def align_predictions(gold: DataFrame, pred: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Gold and predicted rows matched on instance key (+ level), never on
    position (row order is not stable in a distributed plan)."""
    return gold.join(pred, list(keys), "inner")
