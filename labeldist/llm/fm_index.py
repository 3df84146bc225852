"""Benchmark decontamination with an FM-index per shard of training texts.

A shard is a slice of whole texts: their words one after the other, each text closed by a
symbol of its own, so that no match leaves a text and no two suffixes are equal for longer
than a text.  Its index holds the shard's alphabet (64-bit hashes of its words, sorted), a
wavelet matrix of the Burrows-Wheeler transform and every eighth suffix position.  Bits go
into the matrix from the lowest to the highest, which makes its levels the passes of a radix
sort: a place that is followed through all of them comes out at the row of its last-to-first
step, so one walk serves as rank, as backward-search step and as locate step.

Test phrases are searched backwards, all phrases of a block together; those that no row
is left for drop out.  Rows that remain are located by walking to a sampled position.  Matches are
merged to spans of words to remove.

Words are known by 64-bit hashes.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labeldist.llm.common import (PLAIN_GAP, column_or_null, in_blocks, lists, row_ids, settled, slices, stored, text_batches,
                                  word_hashes, words_of)

SHARD_BYTES = 4_000_000
WINDOW_WORDS = 10
SAMPLE = 8                # every eighth suffix position is stored
BLOCK_WINDOWS = 50_000    # phrases of a block (4 MB)
BLOCKS_AT_ONCE = 16
INDEX = "rids array<long>, ids array<long>, lengths array<int>, alphabet array<long>, levels int, bits binary, sampled binary, samples array<int>"


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in order, by doubling; only suffixes that are still equal to others are sorted again.

    No two suffixes may be equal up to the end of one of them."""
    n = len(symbols)
    bits = max(int(symbols.max(initial=1)).bit_length(), 1)
    depth = max(1, min(62 // bits, n))
    key = np.zeros(n, np.int64)
    for j in range(depth):
        key <<= bits
        key[:n - j] |= symbols[j:]
    order = np.argsort(key)
    key = key[order]
    head = np.ones(n, bool)
    head[1:] = key[1:] != key[:-1]
    rank = np.empty(n, np.int64)
    first = np.flatnonzero(head)
    rank[order] = np.repeat(first, np.diff(np.append(first, n)))   # the row of the first of the equal ones
    open_ = np.flatnonzero(~(head & np.append(head[1:], True)))     # rows whose suffix equals a neighbour so far
    while len(open_):
        at = order[open_]
        key = rank[at] * n + rank[at + depth]
        sort = np.argsort(key)
        at, key = at[sort], key[sort]
        order[open_] = at
        head = np.ones(len(at), bool)
        head[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(head)
        rank[at] = np.repeat(open_[first], np.diff(np.append(first, len(at))))
        open_ = open_[~(head & np.append(head[1:], True))]
        depth *= 2
    return order


def _packed(bits: np.ndarray) -> np.ndarray:
    """Bits in 64-bit words, with one word more so that the place behind the last bit has one too."""
    out = np.zeros(len(bits) // 64 * 8 + 8, np.uint8)
    part = np.packbits(bits, bitorder="little")
    out[:len(part)] = part
    return out.view(np.uint64)


class Index:
    """An FM-index: wavelet levels with running bit counts, and sampled suffix positions."""

    def __init__(self, levels: int, bits: bytes, sampled: bytes, samples: np.ndarray):
        self.bits = np.frombuffer(bits, np.uint64).reshape(levels, -1)
        self.counts = self._counts(self.bits)
        self.zeros = None
        self.sampled = np.frombuffer(sampled, np.uint64)
        self.sampled_count = self._counts(self.sampled[None])[0]
        self.samples = samples

    @staticmethod
    def _counts(words: np.ndarray) -> np.ndarray:
        out = np.zeros(words.shape, np.int64)
        np.cumsum(np.bitwise_count(words[:, :-1]), axis=1, out=out[:, 1:], dtype=np.int64)
        return out

    def size(self, n: int) -> Index:
        self.zeros = n - (self.counts[:, -1] + np.bitwise_count(self.bits[:, -1]))
        return self

    @staticmethod
    def _ones(words: np.ndarray, counts: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Number of set bits before each place."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return counts[word] + np.bitwise_count(words[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The row of the first suffix that starts with the symbol and then what stands at row ``at`` or later."""
        for level, (words, counts, zeros) in enumerate(zip(self.bits, self.counts, self.zeros, strict=True)):
            ones = self._ones(words, counts, at)
            at = np.where((symbol >> level) & 1, zeros + ones, at - ones)
        return at

    def back(self, at: np.ndarray) -> np.ndarray:
        """The row of the suffix that starts one place earlier."""
        for words, counts, zeros in zip(self.bits, self.counts, self.zeros, strict=True):
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            own = words[word] >> bit
            ones = counts[word] + np.bitwise_count(words[word] & ((np.uint64(1) << bit) - np.uint64(1)))
            at = np.where(own & np.uint64(1), zeros + ones, at - ones)
        return at

    def rows(self, symbols: np.ndarray, first: np.ndarray, length: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last (exclusive) row of the suffixes that start with each phrase, by backward search.

        Phrase i has the symbols ``first[i] .. first[i] + length[i] - 1``; those below 0 stand nowhere."""
        low, high = np.zeros(len(first), np.int64), np.full(len(first), n, np.int64)
        live = np.arange(len(first))
        for j in range(int(length.max(initial=0))):
            go = live[length[live] > j]
            c = symbols[first[go] + length[go] - 1 - j]
            low[go], high[go] = self.step(c, low[go]), self.step(c, high[go])
            high[go[c < 0]] = 0
            live = live[(high[live] > low[live]) & (length[live] > j)]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Starts of the suffixes of the given rows."""
        out, steps = np.empty(len(rows), np.int64), 0
        open_, at = np.arange(len(rows)), rows
        while len(open_):
            known = (self.sampled[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0
            place = self._ones(self.sampled, self.sampled_count, at[known])
            out[open_[known]] = self.samples[place] + steps
            open_, at, steps = open_[~known], self.back(at[~known]), steps + 1
        return out


def build(symbols: np.ndarray) -> tuple[int, bytes, bytes, np.ndarray]:
    """Levels, their bits, the bits of the sampled rows, and the sampled positions."""
    order = suffix_order(symbols)
    column = symbols[order - 1]   # the symbol before each suffix
    levels, bits = max(int(symbols.max(initial=1)).bit_length(), 1), []
    for level in range(levels):
        one = (column >> level) & 1 == 1
        bits.append(_packed(one))
        column = np.concatenate([column[~one], column[one]])
    sampled = order % SAMPLE == 0
    return levels, np.concatenate(bits).tobytes(), _packed(sampled).tobytes(), order[sampled].astype(np.int32)


def symbols_of(hashes: np.ndarray, place: np.ndarray, text: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The alphabet (sorted hashes), the symbols of all texts with their ends, and the texts' numbers of words.

    Symbols below ``n_texts`` are ends of texts."""
    alphabet, number = np.unique(hashes, return_inverse=True)
    length = np.bincount(text, minlength=n_texts)
    out = np.empty(len(place) + n_texts, np.int64)
    out[np.cumsum(length + 1) - 1] = np.arange(n_texts)
    out[np.arange(len(place)) + text] = number[place] + n_texts
    return alphabet, out, length


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "__text", SHARD_BYTES):
            text, words = words_of(pc.ascii_lower(pc.fill_null(part.column("__text"), "")), PLAIN_GAP)
            alphabet, symbols, length = symbols_of(*word_hashes(words), text, part.num_rows)
            levels, bits, sampled, samples = build(symbols)
            one = lambda values: lists(np.array([0, len(values)]), values)
            yield pa.RecordBatch.from_arrays(
                [one(part.column("__rid")), one(part.column("__id")), one(length.astype(np.int32)), one(alphabet),
                 pa.array([levels], pa.int32()), pa.array([bits]), pa.array([sampled]), one(samples)],
                names=["rids", "ids", "lengths", "alphabet", "levels", "bits", "sampled", "samples"])


def build_index(docs: DataFrame) -> DataFrame:
    """One row per shard: row numbers, ids and numbers of words of its texts, and its FM-index.  ``docs`` has ``__rid``."""
    text_batches(docs.sparkSession)
    return docs.select("__rid", column_or_null(docs, "doc_id", "long").cast("long").alias("__id"),
                       column_or_null(docs, "text", "string").alias("__text")).mapInArrow(_index, INDEX)


def _phrases(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, words = words_of(pc.ascii_lower(pc.fill_null(batch.column("__text"), "")), PLAIN_GAP)
            hashes, place = word_hashes(words)
            of, length = hashes[place], np.bincount(text, minlength=batch.num_rows)
            count = np.where(length >= width, length - width + 1, (length > 0).astype(np.int64))
            item = np.repeat(np.arange(batch.num_rows), count)
            start = (np.cumsum(length) - length)[item] + np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
            size = np.minimum(length, width)[item]
            first = np.cumsum(size) - size
            flat = of[np.repeat(start - first, size) + np.arange(int(size.sum()))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("__item").take(pa.array(item)), lists(np.append(first, len(flat)), flat)], names=["item", "words"])
    return run


def phrases(benchmark: DataFrame, width: int = WINDOW_WORDS) -> DataFrame:
    """``item`` (its id as a string; null: empty) and ``words`` (hashes) of every window of each item."""
    return benchmark.select(F.coalesce(column_or_null(benchmark, "item_id", "string").cast("string"), F.lit("")).alias("__item"),
                            column_or_null(benchmark, "text", "string").alias("__text")).mapInArrow(
        _phrases(width), "item string, words array<long>")


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i] for c in batch.schema.names}
            array = {c: row[c].values.to_numpy() for c in ("lengths", "alphabet", "samples", "words", "sizes", "numbers")}
            lengths = array["lengths"].astype(np.int64)
            n_texts, n = len(lengths), int(lengths.sum()) + len(lengths)
            index = Index(row["levels"].as_py(), row["bits"].as_py(), row["sampled"].as_py(), array["samples"]).size(n)
            # the phrases in the shard's symbols
            alphabet, words, size = array["alphabet"], array["words"], array["sizes"].astype(np.int64)
            place = np.minimum(np.searchsorted(alphabet, words), max(len(alphabet) - 1, 0))
            symbols = np.where(alphabet[place] == words, place + n_texts, -1) if len(alphabet) else np.full(len(words), -1)
            low, high = index.rows(symbols, np.cumsum(size) - size, size, n)
            which = np.repeat(np.arange(len(size)), high - low)
            at = index.locate(np.repeat(low - np.cumsum(high - low) + (high - low), high - low) + np.arange(len(which)))
            if not len(at):
                continue
            # covered words, and their merged spans by text
            begin = np.cumsum(lengths + 1) - lengths - 1
            change = np.bincount(at, minlength=n + 1) - np.bincount(at + size[which], minlength=n + 1)
            hit = np.cumsum(change) > 0
            edge = np.diff(hit.astype(np.int8), prepend=0)
            start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            span_text, text = (np.searchsorted(begin, x, side="right") - 1 for x in (start, at))
            found = np.unique(text * len(size) + which)
            text, which = found // len(size), found % len(size)
            texts = np.unique(text)
            spans = pa.StructArray.from_arrays([pa.array(start - begin[span_text]), pa.array(end - begin[span_text])], names=["start", "end"])
            edges = np.append(texts, n_texts)
            yield pa.RecordBatch.from_arrays(
                [row["rids"].values.take(pa.array(texts)), lists(np.searchsorted(span_text, edges), spans),
                 lists(np.searchsorted(text, edges), array["numbers"][which])], names=["rid", "spans", "numbers"])


def matches(index: DataFrame, windows: DataFrame) -> DataFrame:
    """``rid``, ``spans`` (start, end in words) and ``numbers`` of the windows found, of every text with matches in a block of windows.

    ``windows``: distinct windows, with ``number`` and ``words``.  Each shard searches all of them, in blocks of about
    ``BLOCK_WINDOWS``; the shards stay where they are."""
    n_blocks = max(1, -(-windows.count() // BLOCK_WINDOWS))
    blocks = windows.groupBy(F.pmod(F.xxhash64("number"), F.lit(n_blocks)).cast("int").alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("number", "words"))).alias("w")).select(
        "block", F.col("w.number").alias("numbers"), F.flatten("w.words").alias("words"),
        F.transform("w", lambda x: F.size(x["words"])).alias("sizes"))
    joined = in_blocks(index.drop("ids"), stored(blocks, "phrases"), n_blocks, BLOCKS_AT_ONCE)
    return joined.drop("block").mapInArrow(_search, "rid long, spans array<struct<start: long, end: long>>, numbers array<long>")


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW_WORDS, from_table: bool = False) -> DataFrame:
    """``__rid, __id, __n_words``, ``__spans`` and ``__items`` of every row of ``docs``.

    Words are runs of letters, digits and characters beyond ASCII, A-Z lower-cased.  A window is ``width`` consecutive
    words of a benchmark item (all its words, if it has fewer); ``__spans`` are the merged stretches (start, end; words
    count from 0) of words inside an occurrence of a window, ``__items`` the sorted ids (as strings) of the items whose
    windows occur, null for rows without any.

    Null and empty texts and items have no words and no windows; an item without an id counts as the id "".  Repeated
    rows are searched each for itself, repeated items count once; without documents the result is empty, without items
    it has no spans.  A text of any length is in one shard.  Input columns play no part but ``doc_id``, ``item_id`` and
    ``text``.  ``from_table``: the rows come straight from a table or files; any other frame is stored first.
    """
    index = stored(build_index(row_ids(settled(docs, from_table))), "shards")
    of_item = stored(phrases(benchmark, width).distinct(), "of_item")
    windows = stored(of_item.select("words").distinct(), "windows").withColumn("number", F.monotonically_increasing_id())
    windows = stored(windows, "numbered")
    found = stored(matches(index, windows), "found")
    numbered = of_item.join(windows, "words").select("number", "item")
    items = found.select("rid", F.explode("numbers").alias("number")).join(numbered, "number").groupBy("rid").agg(
        F.array_sort(F.collect_set("item")).alias("__items"))
    # spans of several blocks of windows merge once more: a span that starts behind all ends before it opens a stretch
    before = Window.partitionBy("rid").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("rid").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    each = found.select("rid", F.explode("spans").alias("s")).select("rid", "s.start", "s.end")
    opens = F.coalesce((F.col("start") > F.max("end").over(before)).cast("int"), F.lit(1))
    stretches = each.withColumn("opens", opens).withColumn("stretch", F.sum("opens").over(upto)).groupBy("rid", "stretch").agg(
        F.struct(F.min("start").alias("start"), F.max("end").alias("end")).alias("span"))
    spans = stretches.groupBy("rid").agg(F.array_sort(F.collect_list("span")).alias("__spans"))
    texts = index.select(F.explode(F.arrays_zip("rids", "ids", "lengths")).alias("t")).select(
        F.col("t.rids").alias("__rid"), F.col("t.ids").alias("__id"), F.col("t.lengths").cast("long").alias("__n_words"))
    hits = spans.join(items, "rid").withColumnRenamed("rid", "__rid")
    return texts.join(hits, "__rid", "left")


def cut(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without the words of the spans (and what stands between them)."""
    if text is None or not spans:
        return text
    words = [m.span() for m in re.finditer(f"(?:(?!{PLAIN_GAP[:-1]})[\\s\\S])+", text.translate(_LOWER))]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:words[a][0]])
        at = words[b - 1][1]
    return "".join([*out, text[at:]])


_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def without_spans(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW_WORDS, from_table: bool = False) -> DataFrame:
    """``docs`` with the spans found by :func:`decontaminate` cut out of the texts; all rows and columns stay."""
    docs = settled(docs, from_table)
    found = decontaminate(docs, benchmark, width, from_table=True).filter(F.col("__spans").isNotNull()).select("__rid", "__spans")
    rows = row_ids(docs)
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [cut(t.as_py(), [(x["start"], x["end"]) for x in s.as_py()])
                     for t, s in zip(batch.column("text"), batch.column("__spans"), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in columns],
                                             names=columns)

    hit = rows.join(found, "__rid").select(*[F.col(f"`{c}`") for c in [*columns, "__spans"]]).mapInArrow(run, docs.schema)
    return rows.join(found, "__rid", "left_anti").select(*[F.col(f"`{c}`") for c in columns]).union(hit)


def op12(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    n_hit = F.coalesce(F.aggregate("__spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"]), F.lit(0).cast("long"))
    items = F.coalesce("__items", F.array().cast("array<string>"))
    return decontaminate(docs, benchmark, from_table=True).select(
        F.col("__id").alias("doc_id"), F.col("__n_words").alias("n_words"), n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SQL = rf"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS win
  FROM (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM i WHERE len(w) > 0)),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
dw AS (
  SELECT doc_id, p, k, array_to_string(w[p:p + k - 1], ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM iw) WHERE len(w) >= k)),
h AS (SELECT doc_id, p, k, item_id FROM dw JOIN iw USING (k, win)),
c AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS j FROM h) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
      FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""
