"""Runs of words that repeat with a period, found by seeds that are extended along diagonals.

A run of period q and of ``max(12, 2 q)`` words or more matches itself q words on over at
least ``max(12 - q, q)`` words: the overlap that is guaranteed.  Periods fall into classes,
those below 12 and then [12, 24), [24, 48) ...; for a class from K on the overlap has K words
or more, so it holds a whole block of K / 2 words that starts at a multiple of K / 2.  Each
class has an index of the K / 2-grams of a text (numbers built by doubling, so equal numbers
mean equal words), and the pairs of occurrences that are enumerated are those of an aligned
block with a later occurrence at a lag of the class.  That leaves at most two pairs a word and
class, whatever the text: a block with p as its own period has at most ``K / p`` partners.

Seeds are taken by lag and place.  A seed that starts where its lag is covered so far belongs
to the same stretch and is not extended again; the others are extended to both sides by the
numbers of shorter grams, longest first.  Stretches that give the same words with several
periods are one run, of the smallest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labeldist.llm.common import WORD, column_or_null, lists, slices, text_batches, words_of

LEAST = 12               # words of the shortest run
OVERLAP = LEAST // 2     # the least overlap that a run of any period guarantees
BATCH_BYTES = 1_000_000
RUN = "struct<start: long, length: long, period: long>"


class Grams:
    """Numbers of the m-grams at all places, for m = 1, 2, 3, 6, 12 ...; -1 where a gram stands once in its text only."""

    def __init__(self, words: np.ndarray, text: np.ndarray):
        self.size = len(words)
        self.of = {1: self._numbers(np.arange(self.size), words * (text.max(initial=0) + 1) + text)}
        self.of[2] = self._joined(1, 1)
        self.of[3] = self._joined(2, 1)
        self.of[6] = self._joined(3, 3)

    def _numbers(self, at: np.ndarray, code: np.ndarray) -> np.ndarray:
        number = pd.factorize(code)[0]
        again = np.bincount(number)[number] > 1 if len(number) else np.zeros(0, bool)
        out = np.full(self.size, -1, np.int32)
        out[at[again]] = number[again]
        return out

    def _joined(self, left: int, right: int) -> np.ndarray:
        a, b = self.of[left], self.of[right]
        at = np.flatnonzero((a[:max(self.size - left, 0)] >= 0) & (b[left:] >= 0))
        return self._numbers(at, a[at].astype(np.int64) * self.size + b[at + left])

    def double(self, m: int) -> None:
        self.of[2 * m] = self._joined(m, m)

    def equal(self, m: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the m-grams at places ``a`` and ``b`` (a < b) lie in one text and are equal."""
        inside = (a >= 0) & (b + m <= self.size)
        x, y = self.of[m][np.where(inside, a, 0)], self.of[m][np.where(inside, b, 0)]
        return inside & (x >= 0) & (x == y)


def _short_lags(grams: Grams) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Stretches at the lags below ``LEAST``: every place is a seed, so neighbouring ones are a whole stretch."""
    number = grams.of[OVERLAP]
    for lag in range(1, LEAST):
        seed = np.flatnonzero((number[:-lag] >= 0) & (number[:-lag] == number[lag:]))
        new = np.diff(seed, prepend=-2) > 1
        start, end = seed[new], seed[np.append(new[1:], True)[:len(seed)]] + OVERLAP
        yield np.full(len(start), lag), start, end


def _seeds(grams: Grams, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Lag and place of the pairs of an aligned block and a later occurrence at a lag from 2 to 4 blocks (less one)."""
    number, n = grams.of[block], grams.size + 1
    live = np.flatnonzero(number >= 0)
    index = np.sort(number[live].astype(np.int64) * n + live)
    at = live[live % block == 0]
    own = number[at].astype(np.int64) * n
    low, high = (np.searchsorted(index, own + np.minimum(at + d, n - 1)) for d in (2 * block, 4 * block))
    many = high - low
    place = np.repeat(at, many)
    other = index[np.repeat(low - np.cumsum(many) + many, many) + np.arange(len(place))] % n
    lag = other - place
    order = np.lexsort((place, lag))
    return lag[order], place[order]


def _extended(grams: Grams, lag: np.ndarray, place: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The stretches of matching words that the seeds lie in."""
    covered = np.zeros(len(lag), bool)   # a seed that starts where the seeds of its lag have come to
    covered[1:] = (lag[1:] == lag[:-1]) & (place[1:] == place[:-1] + block)
    start, end = place[~covered], place[np.append(~covered[1:], True)[:len(lag)]] + block
    lag = lag[~covered]
    # a neighbouring block would be a seed if it matched whole, so both ends move by less than a block
    for m in sorted((m for m in grams.of if m < block), reverse=True):
        start = start - m * grams.equal(m, start - m, start - m + lag)
        end = end + m * grams.equal(m, end, end + lag)
    return lag, start, end


def find_runs(words: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and smallest period of every run, by start and period.

    ``words``: numbers of the words of several texts, one after the other; ``text``: rising number of each one's text."""
    if not len(words):
        return (np.zeros(0, np.int64),) * 3
    grams = Grams(words, text)
    found = list(_short_lags(grams))
    block, longest = OVERLAP, int(np.bincount(text).max())
    while 4 * block <= longest and (grams.of[block] >= 0).any():   # the least run of the class has twice 2 blocks
        found.append(_extended(grams, *_seeds(grams, block), block))
        grams.double(block)
        block *= 2
    lag, start, end = (np.concatenate([f[i] for f in found]) for i in range(3))
    end = end + lag
    keep = end - start >= np.maximum(LEAST, 2 * lag)
    lag, start, end = lag[keep], start[keep], end[keep]
    order = np.lexsort((lag, end, start))
    lag, start, end = lag[order], start[order], end[order]
    first = np.ones(len(lag), bool)
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    lag, start, end = lag[first], start[first], end[first]
    order = np.lexsort((lag, start))
    return start[order], end[order], lag[order]


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "__text", BATCH_BYTES):
            text, words = words_of(part.column("__text"))
            coded = words.dictionary_encode()
            start, end, period = find_runs(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), text)
            first = np.searchsorted(text, np.arange(part.num_rows + 1))
            change = np.zeros(len(text) + 1, np.int64)
            np.add.at(change, start + period, 1)
            np.add.at(change, end, -1)
            kept = np.cumsum(change)[:-1] == 0
            before = np.concatenate([[0], np.cumsum(kept)])
            runs = pa.StructArray.from_arrays([pa.array(x) for x in (start - first[text[start]], end - start, period)],
                                              names=["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [*[part.column(c) for c in part.schema.names if c != "__text"], pa.array(np.diff(first)),
                 lists(np.searchsorted(start, first), runs),
                 pc.binary_join(lists(before[first], words.filter(pa.array(kept))), " ")],
                names=[*[c for c in part.schema.names if c != "__text"], "__n_words", "__runs", "__collapsed"])


def periodic_runs(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` (default: all), plus ``__n_words``, ``__runs`` and ``__collapsed``.

    ``__runs`` (array of start, length, period; words count from 0) holds every stretch of consecutive words
    with smallest period q and at least ``max(12, 2 q)`` words that no neighbouring word extends, by start and
    period.  ``__collapsed`` is the text without the words that a run holds after its first period, its words
    joined by one space.  A text has fewer runs than words.

    Null and empty texts have no words, no runs and an empty collapsed text.  Repeated rows are rows of their
    own, ids are never looked at, an empty table gives an empty result, and input columns of any other name pass
    through.  Texts are whole; a task holds one slice of about ``BATCH_BYTES`` (or one longer text) at a time,
    with an index of some 4 bytes a word for every class of periods that still has repeated grams.
    """
    text_batches(docs.sparkSession)
    keep = docs.columns if keep is None else keep
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], column_or_null(docs, "text", "string").alias("__text"))
    schema = rows.drop("__text").withColumns({"__n_words": F.lit(None).cast("long"), "__runs": F.lit(None).cast(f"array<{RUN}>"),
                                              "__collapsed": F.lit(None).cast("string")}).schema
    return rows.mapInArrow(_describe, schema)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the text of every document, one in ten (by crc32 of the id) repeating from some word on."""
    h = F.crc32(column_or_null(docs, "doc_id", "long").cast("string").cast("binary"))
    chosen = docs.select(column_or_null(docs, "doc_id", "long").alias("doc_id"), column_or_null(docs, "text", "string").alias("text"),
                         F.floor(h / 10).alias("g"), (h % 10 == 0).alias("chosen"))
    chosen = chosen.withColumn("words", F.when(F.col("chosen"), F.regexp_extract_all("text", F.lit(f"({WORD})"))))
    n = F.size("words")
    a = F.col("g") % n
    chosen = chosen.withColumn("a", F.when(n > 0, a)).withColumn(
        "p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))
    place = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("words", F.when(
        i >= F.col("a"), F.col("a") + (i - F.col("a")) % F.col("p")).otherwise(i).cast("int")))
    return chosen.select("doc_id", F.when(n > 0, F.array_join(place, " ")).otherwise(F.col("text")).alias("text"))


def op11(docs: DataFrame) -> DataFrame:
    top = F.array_max(F.transform("__runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("__runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = periodic_runs(with_planted_runs(docs), keep=["doc_id"]).withColumn("__top", top)
    length, period = F.col("__top.length"), -F.col("__top.period")
    return found.select(
        "doc_id", F.size("__runs").cast("long").alias("n_runs"), (-F.col("__top.start")).alias("start"), length.alias("length"),
        period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("__collapsed").cast("binary"), 256).alias("collapsed_sha256"))
