"""Mixing sources to target weights by hash thresholds.

Every document gets a 60-bit hash.  The words of each source are summed by the
hash's leading 12 bits; the running sum tells which buckets lie wholly below
the source's budget, and only the one bucket that the budget falls into is
summed again by the next 12 bits, until the whole hash is used.  The result is
one threshold per source, and the mix is a filter of the documents by their
hash: no document is sorted.

A source whose target is above its size is taken whole as often as the target
allows, and the threshold only decides about the rest, so thresholds are
nested: what a small budget takes, a larger one takes too.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labeldist.llm.common import column_or_null, n_words
from labeldist.session import cut_lineage

HASH_BITS = 60
LEVEL_BITS = 12
#: The per-source plan has one row per source; it is broadcast up to this many rows, else joined.
MAX_BROADCAST_SOURCES = 100_000


def _features(docs: DataFrame) -> DataFrame:
    text = column_or_null(docs, "text", "string")
    doc_id = F.coalesce(column_or_null(docs, "doc_id", "long").cast("string"), F.lit(""))
    digest = F.md5(F.concat(doc_id, F.lit(":"), F.coalesce(text, F.lit(""))).cast("binary"))
    source = column_or_null(docs, "source", "string")
    return docs.withColumns({
        "__size": n_words(text),
        "__hash": F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long"),
        "__no_source": source.isNull(),
        "__source": F.coalesce(source, F.lit("")),
    })


def targets(sizes: DataFrame, weights: Sequence[int], share: float, max_repeats: int) -> DataFrame:
    """Target words of each source.

    ``sizes``: one row per source (``__no_source, __source, __total``).  Sources
    in code point order, null last, take the weights in turn.  Filled up in
    order of size per weight, a source is full when its share of what is left
    passes ``max_repeats`` times its size; ``level`` is the words per weight
    that the others get.
    """
    order = Window.orderBy("__no_source", "__source")
    k = (F.row_number().over(order) - 1) % len(weights)
    s = sizes.withColumn("__w", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (k + 1).cast("int")))
    fill = Window.orderBy(F.col("__total") / F.col("__w"), "__no_source", "__source")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    s = s.withColumns({
        "__all": F.sum("__total").over(everything),
        "__all_w": F.sum("__w").over(everything),
        "__full_before": F.coalesce(F.sum("__total").over(before), F.lit(0)),
        "__w_before": F.coalesce(F.sum("__w").over(before), F.lit(0)),
    })
    s = s.withColumn("__level", (F.lit(float(share)) * F.col("__all") - max_repeats * F.col("__full_before"))
                     / (F.col("__all_w") - F.col("__w_before")))
    cap = (max_repeats * F.col("__total")).cast("double")
    s = s.withColumn("__full", F.col("__level") * F.col("__w") >= cap)
    # the level of the first source that is not full holds for all that follow
    s = s.withColumn("__final", F.min(F.when(~F.col("__full"), F.struct(
        (F.col("__total") / F.col("__w")).alias("r"), F.col("__no_source"), F.col("__source"),
        F.col("__level").alias("level")))).over(everything))
    return s.withColumn("__target", F.when(F.col("__full") | F.col("__final").isNull(), cap)
                        .otherwise(F.least(cap, F.col("__final.level") * F.col("__w")))
                        ).select("__no_source", "__source", "__total", "__target")


def thresholds(features: DataFrame, weights: Sequence[int], share: float, max_repeats: int) -> DataFrame:
    """One row per source: its size, target, whole repeats and hash threshold (-1: none)."""
    key = ["__no_source", "__source"]
    narrow = cut_lineage(features.groupBy(*key, "__hash").agg(F.sum("__size").alias("__size")))
    sizes = narrow.groupBy(*key).agg(F.sum("__size").alias("__total"))
    state = targets(sizes, weights, share, max_repeats).withColumn(
        "__whole", F.when(F.col("__total") > 0, F.floor(F.col("__target") / F.col("__total"))).otherwise(F.lit(0)))
    state = cut_lineage(state.withColumns({
        "__rest": F.col("__target") - F.col("__whole") * F.col("__total"),
        "__below": F.lit(0).cast("long"), "__cut": F.lit(-1).cast("long"),
        "__prefix": F.lit(0).cast("long"),  # null: settled
    }))
    for level in range(1, HASH_BITS // LEVEL_BITS + 1):
        shift = HASH_BITS - level * LEVEL_BITS
        bucket = F.shiftright("__hash", shift)
        inside = narrow.join(state.filter("__prefix IS NOT NULL").select(*key, "__prefix"), key).filter(
            F.shiftright("__hash", shift + LEVEL_BITS) == F.col("__prefix"))
        hist = inside.groupBy(*key, bucket.alias("__bucket")).agg(F.sum("__size").alias("__sum"))
        run = Window.partitionBy(*key).orderBy("__bucket")  # at most 4,096 rows of a source
        hist = (hist.withColumn("__run", F.sum("__sum").over(run))
                .join(state.select(*key, "__rest", F.col("__below").alias("__b")), key)
                .withColumns({"__to": F.col("__b") + F.col("__run"), "__from": F.col("__b") + F.col("__run") - F.col("__sum")}))
        taken = F.col("__to") <= F.col("__rest")
        split = (F.col("__from") < F.col("__rest")) & ~taken
        last = shift == 0
        if last:  # one hash value: taken if that brings the sum nearer to the target
            taken, split = F.col("__from") + F.col("__to") < 2 * F.col("__rest"), F.lit(False)
        found = hist.groupBy(*key).agg(
            F.max(F.when(taken, F.col("__to"))).alias("__t"),
            F.max(F.when(taken, F.shiftleft(F.col("__bucket") + 1, shift) - 1)).alias("__c"),
            F.max(F.when(split, F.col("__bucket"))).alias("__p"))
        state = state.join(found, key, "left").select(
            *key, "__total", "__target", "__whole", "__rest",
            F.coalesce("__t", "__below").alias("__below"),
            F.greatest("__cut", F.coalesce("__c", F.lit(-1))).alias("__cut"),
            F.col("__p").alias("__prefix"))
        state = cut_lineage(state)
    return state.select(*key, "__total", "__target", "__whole", "__cut")


def mix(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, max_repeats: int = 2) -> DataFrame:
    """All documents with ``__size, __source_size, __target, __repeats``.

    ``__repeats`` (0 .. ``max_repeats``) is how often the mix takes the
    document.  Null texts have size 0; a null source is a source of its own
    (the last); an empty table gives no rows.  Repeated rows share a hash and
    so are taken or left together.  Other columns are kept as they are.
    """
    features = _features(docs)
    plan = thresholds(features.select("__no_source", "__source", "__hash", "__size"), weights, share, max_repeats)
    plan = plan.withColumnRenamed("__total", "__source_size")
    if plan.limit(MAX_BROADCAST_SOURCES + 1).count() <= MAX_BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    return features.join(plan, ["__no_source", "__source"]).withColumn(
        "__repeats", (F.col("__whole") + F.when(F.col("__hash") <= F.col("__cut"), 1).otherwise(0)).cast("int")
    ).drop("__no_source", "__source", "__hash", "__whole", "__cut")


def mixed(docs: DataFrame, **params) -> DataFrame:
    """The mix itself: the columns of ``docs``, each row as often as it is taken."""
    out = mix(docs, **params).filter("__repeats > 0")
    return out.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), F.col("__repeats")))).select(
        *[F.col(f"`{c}`") for c in docs.columns])


def op8(docs: DataFrame) -> DataFrame:
    size: Column = F.col("__size")
    return mix(docs).select("doc_id", size.alias("size"), F.col("__source_size").alias("source_size"),
                            F.col("__target").alias("target"), (size * F.col("__repeats")).alias("taken"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS total,
         CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w
  FROM d GROUP BY source),
f AS (
  SELECT *, sum(total) OVER ()::BIGINT AS everything, sum(w) OVER ()::BIGINT AS all_w,
         coalesce(sum(total) OVER o, 0)::BIGINT AS full_before, coalesce(sum(w) OVER o, 0)::BIGINT AS w_before,
         row_number() OVER (ORDER BY total / w, source IS NULL, source) AS k
  FROM s WINDOW o AS (ORDER BY total / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (
  SELECT *, (1.5::DOUBLE * everything - 2 * full_before) / (all_w - w_before) AS level FROM f),
t AS (
  SELECT source, total, CASE WHEN level * w >= 2 * total OR e IS NULL THEN (2 * total)::DOUBLE
                             ELSE least((2 * total)::DOUBLE, e * w) END AS target
  FROM l, (SELECT arg_min(level, k) AS e FROM l WHERE level * w < 2 * total)),
r AS (
  SELECT d.*, t.total, t.target, CASE WHEN total > 0 THEN floor(target / total)::BIGINT ELSE 0 END AS whole,
         sum(size) OVER (PARTITION BY d.source ORDER BY h) AS upto,
         sum(size) OVER (PARTITION BY d.source, h) AS here
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, total AS source_size, target,
       (size * (whole + CASE WHEN 2 * upto - here < 2 * (target - whole * total) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""
