"""Line dedup by overlapping three-line windows.

Every run of three consecutive lines of a text is hashed to 128 bits.  A
window that occurs more than once anywhere (in one document or in several)
keeps its first occurrence, in order of document id (null last), row and
position; all later ones are removed.  Overlapping or touching removed windows
are merged into stretches, and a text is put together again from the lines
between them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labeldist.llm.common import column_or_null, row_ids, settled

WINDOW_LINES = 3


def _windows(rows: DataFrame) -> DataFrame:
    """One row per window that is not blank: ``__rid, __id, __pos`` and its hash."""
    lines = rows.select("__rid", "__id", F.split("__text", "\n", -1).alias("__lines")).filter(
        F.size("__lines") >= WINDOW_LINES)
    parts = [F.lit(0)] + [F.lit(k) for k in range(1, WINDOW_LINES)]
    each = F.transform(
        F.sequence(F.lit(0), F.size("__lines") - WINDOW_LINES),
        lambda i: F.struct(
            i.alias("pos"),
            F.xxhash64(*[F.get("__lines", i + k) for k in parts]).alias("a"),
            F.xxhash64(F.lit(7), *[F.get("__lines", i + k) for k in parts]).alias("b"),
            F.concat(*[F.trim(F.get("__lines", i + k)) for k in parts]).eqNullSafe(F.lit("")).alias("blank")))
    return (lines.select("__rid", "__id", F.explode(F.filter(each, lambda x: ~x["blank"])).alias("__w"))
            .select("__rid", "__id", F.col("__w.pos").alias("__pos"), F.col("__w.a").alias("__a"), F.col("__w.b").alias("__b")))


def dedup_lines(docs: DataFrame, from_table: bool = False) -> DataFrame:
    """``docs`` with its texts cleaned, plus ``__n_lines`` and ``__n_removed``.

    Null texts stay null (0 lines); texts of fewer than three lines and windows
    of three blank lines are left alone.  Of repeated rows the first keeps its
    lines.  Rows and other columns are kept; the caller decides about texts
    that have become empty.  Texts are whole, however long; an empty table gives an empty result.  ``from_table``: the rows come straight from a table or files; any other frame is stored first.
    """
    docs = settled(docs, from_table)
    rows = row_ids(docs).withColumn("__text", column_or_null(docs, "text", "string"))
    doc_id = column_or_null(docs, "doc_id", "long")
    keyed = rows.select("__rid", F.struct(doc_id.isNull().alias("n"), doc_id.alias("v")).alias("__id"), "__text")
    windows = _windows(keyed)
    place = F.struct("__id", "__rid", "__pos")
    first = windows.groupBy("__a", "__b").agg(F.min(place).alias("__first"), F.count(F.lit(1)).alias("__n")).filter("__n > 1")
    later = windows.join(first, ["__a", "__b"]).filter(place != F.col("__first")).select("__rid", "__pos")

    # Kept stretches: before each merged run of removed windows, and after the last one.
    end = F.lag("__pos").over(Window.partitionBy("__rid").orderBy("__pos")) + WINDOW_LINES
    gaps = later.withColumn("__start", F.coalesce(end, F.lit(0))).withColumn("__len", F.col("__pos") - F.col("__start"))
    kept = gaps.groupBy("__rid").agg(
        F.array_sort(F.collect_list(F.when(F.col("__len") > 0, F.struct("__start", "__len")))).alias("__keep"),
        (F.max("__pos") + WINDOW_LINES).alias("__tail"))
    joined = rows.join(kept, "__rid", "left")
    lines = F.split("__text", "\n", -1)
    middle = F.flatten(F.transform("__keep", lambda g: F.slice(F.col("__lines"), g["__start"] + 1, g["__len"])))
    tail = F.slice(F.col("__lines"), F.col("__tail") + 1, F.size("__lines"))
    joined = joined.withColumn("__lines", lines).withColumn(
        "__left", F.when(F.col("__tail").isNotNull(), F.concat(middle, tail)))
    cleaned = F.when(F.col("__left").isNull(), F.col("__text")).otherwise(F.array_join("__left", "\n"))
    n = F.when(F.col("__text").isNull(), 0).otherwise(F.size("__lines"))
    return joined.select(
        *[cleaned.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns],
        n.cast("long").alias("__n_lines"),
        F.when(F.col("__left").isNull(), 0).otherwise(F.size("__lines") - F.size("__left")).cast("long").alias("__n_removed"))


def without_repeated_lines(docs: DataFrame, from_table: bool = False) -> DataFrame:
    """``docs`` cleaned, without the documents of which nothing but blank lines was left."""
    out = dedup_lines(docs, from_table)
    gone = (F.col("__n_removed") > 0) & (F.trim(F.regexp_replace("text", r"\s+", "")) == "")
    return out.filter(~F.coalesce(gone, F.lit(False))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op6(docs: DataFrame) -> DataFrame:
    return dedup_lines(docs, from_table=True).select("doc_id", F.col("__n_lines").alias("n_lines"),
                                    F.col("__n_removed").alias("n_removed"), "text")


SQL = r"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
w AS (
  SELECT doc_id, p - 1 AS pos, ls[p] || chr(10) || ls[p + 1] || chr(10) || ls[p + 2] AS win
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) - 1)) AS p FROM l WHERE len(ls) >= 3)
  WHERE trim(ls[p]) <> '' OR trim(ls[p + 1]) <> '' OR trim(ls[p + 2]) <> ''),
dup AS (
  SELECT doc_id, pos FROM (
    SELECT doc_id, pos, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS k FROM w) WHERE k > 1),
cov AS (SELECT DISTINCT doc_id, unnest([pos, pos + 1, pos + 2]) AS i FROM dup),
k AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS kept, count(*) AS n
  FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS i FROM l) x
  ANTI JOIN cov USING (doc_id, i) GROUP BY doc_id)
SELECT l.doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, (coalesce(len(ls), 0) - coalesce(n, 0))::BIGINT AS n_removed,
       CASE WHEN text IS NULL THEN NULL ELSE coalesce(kept, '') END AS text
FROM l LEFT JOIN k USING (doc_id)
"""
