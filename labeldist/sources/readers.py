"""Sources (S1-S5, S10): item tables, annotation trees, raw documents,
prepared tables and prompt assets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labeldist.functions import text as TX
from labeldist.operators.corpus import CORPUS_LANGS, ITEM_FIELDS, ITEM_META

# --- fixed values ------------------------------------------------------------
RELATION_TYPES = ["Implicit", "Explicit"]
RAW_ENCODING = "ISO-8859-1"
# -----------------------------------------------------------------------------


def item_columns(langs: Sequence[str] = CORPUS_LANGS) -> list[str]:
    """Column subset the item reader keeps, in order."""
    cols = list(ITEM_META)
    for l in langs:
        cols += [pat.format(l=l) for pat in ITEM_FIELDS.values()]
    return cols


def read_items(spark: SparkSession, path: str, langs: Sequence[str] = CORPUS_LANGS,
               multiline: bool = True) -> DataFrame:
    """Tab-separated item table with a header; every column is a string.

    No schema inference (one pass, no type guessing); only the named columns
    are kept.  Quoted fields may span lines, which makes each file one task;
    ``multiline=False`` splits files, for tables known to have one line per row.
    """
    df = (spark.read.option("sep", "\t").option("header", True)
          .option("quote", '"').option("escape", '"')
          .option("multiLine", multiline).option("inferSchema", False)
          .csv(path))
    return df.select(*item_columns(langs))


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None,
               fmt: str = "parquet") -> DataFrame:
    """Prepared table with a column subset (pruned at the scan)."""
    r = spark.read.format(fmt)
    if fmt == "csv":
        r = r.option("header", True).option("inferSchema", False)
    df = r.load(path)
    return df.select(*columns) if columns else df


def read_annotations(spark: SparkSession, root: str,
                     relation_types: Sequence[str] = RELATION_TYPES) -> DataFrame:
    """S2 (+P12): every annotation line under ``root/<folder>/<file>``.

    Keeps lines starting with one of ``relation_types`` and attaches the
    folder and file names from the scan's file metadata.  Hidden entries
    (names starting with ``.`` or ``_``) are skipped by Spark's listing.
    Output: ``folder, file, line`` (trailing white space removed).
    """
    df = (spark.read.option("recursiveFileLookup", True).text(root)
          .select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("path")))
    df = df.filter(relation_line_filter("line", relation_types))
    return df.select(
        F.regexp_extract(plain_path("path"), "([^/]+)/[^/]+$", 1).alias("folder"),
        F.regexp_extract(plain_path("path"), "([^/]+)$", 1).alias("file"),
        rstrip(F.col("line")).alias("line"),
    )


def plain_path(c: str) -> Column:
    """A path of the scan's file metadata as it is on disk.

    File metadata is percent-encoded (a blank is ``%20``), the path column of
    ``binaryFile`` is not.  A plus sign stands for itself in both."""
    return F.url_decode(F.replace(F.col(c), F.lit("+"), F.lit("%2B")))


def relation_line_filter(line, relation_types: Sequence[str] = RELATION_TYPES):
    """Predicate: the line starts with one of the relation types."""
    c = F.col(line) if isinstance(line, str) else line
    cond = None
    for t in relation_types:
        x = c.startswith(t)
        cond = x if cond is None else cond | x
    return cond


rstrip = TX.rstrip


def read_raw_docs(spark: SparkSession, root: str, encoding: str = RAW_ENCODING) -> DataFrame:
    """S3: whole raw documents ``(folder, file, text)``.

    Bytes are decoded as ISO-8859-1, line ends normalised to ``\\n`` (text
    mode) and trailing white space removed, so character offsets match.
    """
    df = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
          .select("path", "content"))
    # text-mode newline rule: \r\n and lone \r become \n (plain replaces, no regex)
    txt = F.replace(F.replace(F.decode("content", encoding), F.lit("\r\n"), F.lit("\n")),
                    F.lit("\r"), F.lit("\n"))
    return df.select(
        F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("folder"),
        F.regexp_extract("path", "([^/]+)$", 1).alias("file"),
        rstrip(txt).alias("text"),
    )


def read_prompts(spark: SparkSession, root: str) -> DataFrame:
    """Prompt templates, one file per language named ``*_<lang>.txt``.

    Output ``(lang, prompt)``; the whole file is one value.
    """
    df = spark.read.text(f"{root.rstrip('/')}/*.txt", wholetext=True)
    return df.select(
        F.regexp_extract(plain_path("_metadata.file_name"), "_([A-Za-z]+)\\.txt$", 1).alias("lang"),
        F.col("value").alias("prompt"),
    )


def read_exemplars(spark: SparkSession, path: str) -> DataFrame:
    """Exemplar table ``(lang, idx, question, answer)`` from JSON lines."""
    return spark.read.schema("lang STRING, idx INT, question STRING, answer STRING").json(path)
