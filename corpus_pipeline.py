"""Corpus pipeline: five stages over the table ``documents``.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its
predecessor kept; what it returns is written as Parquet and read again (stages count on that:
their ``docs`` must come straight from a table or files).  All
but the last return the columns of ``documents``:

1. language ID: documents whose language is not recognised go;
2. line dedup: later occurrences of repeated three-line windows are cut out of
   the texts (and ``n_chars`` follows); documents of which nothing is left go;
3. n-gram Jaccard join: of each group of near duplicates (five-word shingles,
   similarity 0.8 or more) the document with the smallest id stays;
4. mixing: a document is in the mix as often as its source's target asks for
   (not at all, once or twice);
5. SentencePiece: two sampled segmentations of every document, decoded again and held against its text.

Nulls, empty texts, repeated rows, empty tables and further columns are dealt
with as each operator's docstring says; further columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labeldist.llm import language_id, line_dedup, mixing, ngram_join, sentencepieces
from labeldist.llm.common import stored


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.without_repeated_lines(docs, from_table=True)
    if "n_chars" not in docs.columns:
        return out
    kind = docs.schema["n_chars"].dataType
    return out.withColumn("n_chars", F.coalesce(F.char_length("text").cast(kind), F.col("n_chars")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each_group(docs, width=5, percent=80, from_table=True)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def sample_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = [c for c in docs.columns if c != "text"]
    out = sentencepieces.encode(docs, sentencepieces.row_key(docs), keep=kept)
    names = {"__rank": "rank", "__ids": "ids", "__n_pieces": "n_pieces", "__log_prob": "log_prob",
             "__perturbed": "perturbed", "__log_inclusion": "log_inclusion", "__same": "round_trip"}
    # a column of the documents with one of these names stays as it is, and the sample's keeps its underscores
    return out.withColumnsRenamed({a: b for a, b in names.items() if b not in kept})


STAGES = [
    ("language ID", identify_languages),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", sample_pieces),
]

#: Language models and sampled segmentations have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; every stage's result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
