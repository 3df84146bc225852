"""Ranked lexical search by trees over items and over documents.

A document's value for a term is ``f = (10**9 * tf) div (1000 * tf + 12 * m)``, with m from its
length; an item's weight for a term is its count times the term's weight.  A document's score
for an item is the sum of their products, in integers.

Documents are dealt into blocks.  Within a block, documents lie in a binary tree that is split by
likeness, items in another, and every node of either holds the maxima of its members' values
(or weights), term by term.  The product of two nodes' maxima bounds the score of
every pair below them.  A pair of nodes is dropped if that bound is below the
weakest k-th score of the node's items; else both are split.  When an item stands alone, what is
left of the documents' leaves is looked at from the highest bound on, until the bounds fall
below its k-th score.  k-th scores are kept from block to block of a task.  A pair that could
equal a k-th score is never dropped, so ties are settled by id.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labeldist.llm.common import (PLAIN_GAP, column_or_null, in_blocks, lists, row_ids, settled, slices, small, stored,
                                  text_batches, word_hashes, words_of)

TEXT_BYTES = 2_000_000    # texts of a block of documents
CELLS = 4_000_000         # values (documents times terms) that are laid out at once
ITEM_CELLS = 2_000_000    # weights (items times terms) that are laid out at once
LEAF = 8                  # documents of a leaf
ITEM_TERMS = 20_000       # about so many terms in a block of items, with repeats between items
BLOCK_ITEMS = 512
BLOCKS_AT_ONCE = 16
HELD = 1_000_000          # candidates that a task keeps before it hands them on
LAST_ID = np.iinfo(np.int64).max
BLOCK = "rids array<long>, ids array<long>, lengths array<long>, offsets array<int>, codes array<int>, tfs array<int>, " \
        "vocabulary array<long>, dfs array<int>"


# --- term vectors

def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of documents: each one's distinct terms (places in the block's sorted vocabulary) and their counts."""
    for batch in batches:
        for part in slices(batch, "__text", TEXT_BYTES):
            text, words = words_of(pc.ascii_lower(pc.fill_null(part.column("__text"), "")), PLAIN_GAP)
            hashes, place = word_hashes(words)
            vocabulary, number = np.unique(hashes, return_inverse=True)
            width = max(len(vocabulary), 1)
            pair, tf = np.unique(text * width + number[place], return_counts=True)
            code, owner = pair % width, pair // width
            one = lambda values: lists(np.array([0, len(values)]), values)
            yield pa.RecordBatch.from_arrays(
                [one(part.column("__rid")), one(part.column("__id")), one(np.bincount(text, minlength=part.num_rows)),
                 one(np.searchsorted(owner, np.arange(part.num_rows + 1)).astype(np.int32)), one(code.astype(np.int32)),
                 one(tf.astype(np.int32)), one(vocabulary), one(np.bincount(code, minlength=len(vocabulary)).astype(np.int32))],
                names=["rids", "ids", "lengths", "offsets", "codes", "tfs", "vocabulary", "dfs"])


def vectors(rows: DataFrame, id_column: str) -> DataFrame:
    """Blocks of term vectors of all rows (``__rid``, the id and ``text``)."""
    text_batches(rows.sparkSession)
    return rows.select("__rid", column_or_null(rows, id_column, "long").cast("long").alias("__id"),
                       column_or_null(rows, "text", "string").alias("__text")).mapInArrow(_vectors, BLOCK)


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i].values.to_numpy() for c in ("rids", "offsets", "codes", "tfs", "vocabulary")}
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(row["rids"], np.diff(row["offsets"]))), pa.array(row["vocabulary"][row["codes"]]),
                 pa.array(row["tfs"].astype(np.int64))], names=["item", "term", "times"])


# --- trees

class Tree:
    """A binary tree over the rows of a matrix, in tree order: node i holds rows first[i] .. last[i] - 1 and, unless it is
    a leaf, the nodes child[i] and child[i] + 1.  ``top``: the maxima of each node's rows by column."""

    def __init__(self, x: np.ndarray, like: np.ndarray, leaf: int):
        """``like``: the rows as they are compared for likeness."""
        self.order = np.arange(len(x))
        first, last, child, at = [0], [len(x)], [], 0
        while at < len(first):
            a, b = first[at], last[at]
            if b - a <= leaf:
                child.append(-1)
            else:
                child.append(len(first))
                rows = like[self.order[a:b]]
                length = np.sqrt(np.einsum("ij,ij->i", rows, rows)) + 1e-9
                p = int(length.argmax())
                to_p = rows @ rows[p] / length
                q = int(to_p.argmin())
                half = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(rows @ rows[q] / (length * length[q]) - to_p / length[p], half)]
                first += [a, a + half]
                last += [a + half, b]
            at += 1
        self.first, self.last, self.child = (np.array(v) for v in (first, last, child))
        self.x = x[self.order]
        self.top = np.zeros((len(first), x.shape[1]), x.dtype)
        for i in range(len(first) - 1, -1, -1):
            c = self.child[i]
            self.top[i] = self.x[self.first[i]:self.last[i]].max(axis=0) if c < 0 else np.maximum(self.top[c], self.top[c + 1])

    def below(self, nodes: np.ndarray) -> np.ndarray:
        """The children of the nodes; a leaf stays."""
        inner = nodes[self.child[nodes] >= 0]
        return np.concatenate([nodes[self.child[nodes] < 0], self.child[inner], self.child[inner] + 1])

    def leaves(self, nodes: np.ndarray) -> np.ndarray:
        while (self.child[nodes] >= 0).any():
            nodes = self.below(nodes)
        return nodes


class Best:
    """The k best (score, id, row) found so far for each of some items: highest score first, then smallest id and row."""

    def __init__(self, n: int, k: int):
        self.k, self.held = k, 0
        self.score = np.zeros((n, k), np.int64)
        self.id, self.rid = np.full((n, k), LAST_ID), np.full((n, k), -1)
        self.kth = np.ones(n, np.int64)      # scores from here on count: 1 as long as fewer than k are known

    def add(self, i: int, score: np.ndarray, ids: np.ndarray, rids: np.ndarray) -> None:
        score, ids, rids = (np.concatenate(x) for x in ((self.score[i], score), (self.id[i], ids), (self.rid[i], rids)))
        order = np.lexsort((rids, ids, -score))[:self.k]
        self.score[i], self.id[i], self.rid[i] = score[order], ids[order], rids[order]
        self.kth[i] = max(1, self.score[i, -1])


def search(items: Tree, docs: Tree, ids: np.ndarray, rids: np.ndarray, best: Best, start: int = 0) -> int:
    """Take the best documents of all items into ``best``, where they lie from ``start`` on; gives the number of pairs whose
    score was computed.

    ``items.x`` are whole numbers; ``ids`` and ``rids`` are in the documents' tree order."""
    scored = 0

    def bounds(columns: np.ndarray, weights: np.ndarray, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        return rows[np.ix_(at, columns)].astype(np.float64) @ weights

    def exact(columns: np.ndarray, weights: np.ndarray, at: np.ndarray) -> np.ndarray:
        part = docs.x[np.ix_(at, columns)]
        if weights.sum() * 1e6 < 2**53:      # values are below 10**6, so doubles hold all sums
            return (part.astype(np.float64) @ weights).astype(np.int64)
        return part.astype(np.int64) @ weights.astype(np.int64)

    todo = [(0, np.zeros(1, np.int64))] if len(items.x) and len(docs.x) else []
    while todo:
        node, at = todo.pop()
        columns = np.flatnonzero(items.top[node])
        weights = items.top[node, columns].astype(np.float64)
        members = start + items.order[items.first[node]:items.last[node]]
        slack = 1 + 1e-9     # bounds are sums of doubles
        at = at[bounds(columns, weights, docs.top, at) * slack >= best.kth[members].min()]
        if not len(at):
            continue
        if items.child[node] >= 0:
            at = docs.below(at)
            todo += [(items.child[node], at), (items.child[node] + 1, at)]
            continue
        at = docs.leaves(at)
        bound = bounds(columns, weights, docs.top, at) * slack
        order = np.argsort(-bound)
        at, bound = at[order], bound[order]
        done, many = 0, 2
        i = members[0]
        while done < len(at) and bound[done] >= best.kth[i]:
            leaves = at[done:done + many][bound[done:done + many] >= best.kth[i]]
            size = docs.last[leaves] - docs.first[leaves]
            rows = np.repeat(docs.first[leaves] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
            score = exact(columns, weights, rows)
            scored += len(rows)
            good = np.flatnonzero(score >= best.kth[i])
            if len(good):
                best.add(i, score[good], ids[rows[good]], rids[rows[good]])
            done, many = done + many, many * 2
    return scored


def _search(k: int, n_docs: int, n_terms: int):
    """Blocks of documents against blocks of items; gives each item's k best of the task, and how many pairs were scored of how many."""
    def result(items: dict[int, np.ndarray], best: dict[int, Best]) -> Iterator[pa.RecordBatch]:
        for block, b in best.items():
            at, rank = np.nonzero(b.score > 0)
            ids = b.id[at, rank]
            yield pa.RecordBatch.from_arrays(
                [pa.array(items[block][at]), pa.array(ids, mask=ids == LAST_ID), pa.array(b.rid[at, rank]), pa.array(b.score[at, rank])],
                names=["item", "id", "rid", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: dict[int, np.ndarray] = {}
        best: dict[int, Best] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].values for c in batch.schema.names if c != "block"}
                block = batch.column("block")[i].as_py()
                array = {c: row[c].to_numpy(zero_copy_only=False) for c in row if c != "ids"}
                ids = row["ids"].fill_null(LAST_ID).to_numpy(zero_copy_only=False)
                if block not in best:
                    if sum(b.score.size for b in best.values()) > HELD:
                        yield from result(items, best)
                        items, best = {}, {}
                    items[block] = np.unique(array["items"])
                    best[block] = Best(len(items[block]), k)
                # only terms that the block of documents and that of items both hold
                terms = np.intersect1d(array["terms"], array["vocabulary"])
                if not len(terms):
                    continue
                known = np.isin(array["terms"], terms)
                owner, at = np.searchsorted(items[block], array["items"][known]), np.searchsorted(terms, array["terms"][known])
                weight = array["weights"][known]
                highest = np.zeros(len(terms), np.float32)
                np.maximum.at(highest, at, weight.astype(np.float32))
                trees = _items(owner, at, weight, len(items[block]), len(terms))
                column = np.full(len(array["vocabulary"]), -1)
                column[np.searchsorted(array["vocabulary"], terms)] = np.arange(len(terms))
                for a, b, tree in _documents(array, column, len(terms), highest, n_docs, n_terms):
                    for start, item_tree in trees:
                        search(item_tree(), tree, ids[a:b][tree.order], array["rids"][a:b][tree.order], best[block], start)
        yield from result(items, best)
    return run


def _items(owner: np.ndarray, term: np.ndarray, weight: np.ndarray, n_items: int, n_terms: int) -> list[tuple[int, Callable[[], Tree]]]:
    """Trees of the block's items, so many at a time as their weights may be laid out, each with its first item.  One
    tree stays; of more, each is grown when it is asked for."""
    step = max(1, ITEM_CELLS // n_terms)
    exact = np.float32 if weight.max() < 2**24 else np.float64      # what holds all weights

    def grow(a: int) -> Tree:
        x = np.zeros((min(step, n_items - a), n_terms), exact)
        of = (owner >= a) & (owner < a + step)
        x[owner[of] - a, term[of]] = weight[of]
        return Tree(x, x, 1)

    if n_items <= step:
        one = grow(0)
        return [(0, lambda: one)]
    return [(a, functools.partial(grow, a)) for a in range(0, n_items, step)]


def _documents(array: dict, column: np.ndarray, n_columns: int, weight: np.ndarray, n_docs: int, n_terms: int):
    """Trees of the block's documents, so many at a time as their values may be laid out."""
    step = max(1, CELLS // n_columns)
    code, tf, offsets, length = (array[c].astype(np.int64) for c in ("codes", "tfs", "offsets", "lengths"))
    norm = 75 + (25 * length * n_docs) // n_terms
    for a in range(0, len(length), step):
        b = min(a + step, len(length))
        part = slice(offsets[a], offsets[b])
        owner = np.repeat(np.arange(b - a), np.diff(offsets[a:b + 1]))
        at = column[code[part]]
        owner, at, t = owner[at >= 0], at[at >= 0], tf[part][at >= 0]
        x = np.zeros((b - a, n_columns), np.float32)      # values are below 10**6: floats hold them
        x[owner, at] = (1_000_000_000 * t) // (1000 * t + 12 * norm[a:b][owner])
        yield a, b, Tree(x, x * weight, LEAF)


# --- the search

def top_k(docs: DataFrame, items: DataFrame, k: int = 20, from_table: bool = False) -> DataFrame:
    """``item_id, rank, doc_id, score`` of the k highest-scoring documents of every item.

    Terms are runs of letters, digits and characters beyond ASCII, A-Z lower-cased; the weight of a term is
    ``floor(1000 ln((2 N + 2) / (2 df + 1)))`` and m is ``75 + (25 n N) div L`` (N documents with a term, L terms in all,
    n terms of the document, df documents that hold the term).  Equal scores rank by id (null last), then row.  Only scores
    above 0 count.

    Null and empty texts have no terms, and items without known terms no rows.  Repeated rows of ``docs`` are documents of
    their own, repeated rows of ``items`` are ranked each for itself; empty tables give an empty result.  Columns other than
    the ids and ``text`` play no part.  Statistics cover all documents.  Blocks of items (about ``ITEM_TERMS`` terms each)
    are broadcast, the blocks of documents stay where they are.  ``from_table``: the rows come straight from a table or
    files; any other frame is stored first.
    """
    docs, items = settled(docs, from_table), settled(items, from_table)
    blocks = stored(vectors(row_ids(docs), "doc_id"), "vectors", large_rows=True)
    length = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    some = F.size(F.filter("lengths", lambda x: x > 0))
    n_docs, n_terms = (int(x or 0) for x in blocks.agg(F.sum(some), F.sum(length)).first())
    asked = row_ids(items)
    wanted = stored(vectors(asked, "item_id").mapInArrow(_item_terms, "item long, term long, times long"), "wanted")
    each = blocks.select(F.explode(F.arrays_zip("vocabulary", "dfs")).alias("t")).select(
        F.col("t.vocabulary").alias("term"), F.col("t.dfs").alias("df"))
    df = each.join(small(wanted.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((2 * n_docs + 2) / (2 * F.col("df") + 1))) * F.col("times")
    weighted = stored(wanted.join(df, "term").select("item", "term", weight.alias("weight")).filter("weight > 0"), "weighted")
    size = weighted.agg(F.count(F.lit(1)), F.countDistinct("item")).first()
    n_blocks = max(1, -(-size[0] // ITEM_TERMS), -(-size[1] // BLOCK_ITEMS))
    item_blocks = weighted.groupBy(F.pmod(F.xxhash64("item"), F.lit(n_blocks)).cast("int").alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("item", "term", "weight"))).alias("w")).select(
        "block", F.col("w.item").alias("items"), F.col("w.term").alias("terms"), F.col("w.weight").alias("weights"))
    joined = in_blocks(blocks.drop("dfs"), stored(item_blocks, "items", large_rows=True), n_blocks, BLOCKS_AT_ONCE)
    found = joined.mapInArrow(_search(k, max(n_docs, 1), max(n_terms, 1)), "item long, id long, rid long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(
        F.desc("score"), F.col("id").asc_nulls_last(), "rid"))).filter(F.col("rank") <= k)
    names = asked.select(F.col("__rid").alias("item"), column_or_null(items, "item_id", "long").alias("item_id"))
    return ranked.join(names, "item").select("item_id", "rank", F.col("id").alias("doc_id"), "score")


def op13(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return top_k(docs, benchmark, from_table=True)


_TERMS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SQL = rf"""
WITH d AS (SELECT doc_id, {_TERMS} AS ts FROM documents),
n AS (SELECT doc_id, len(ts)::BIGINT AS n FROM d WHERE len(ts) > 0),
s AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM n),
dt AS (SELECT doc_id, t, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(ts) AS t FROM d) GROUP BY doc_id, t),
it AS (SELECT item_id, t, count(*)::BIGINT AS c FROM (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark) GROUP BY item_id, t),
w AS (SELECT t, floor(1000 * ln((2 * max(nn) + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM dt, s GROUP BY t),
r AS (
  SELECT item_id, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // ll))))::BIGINT AS score
  FROM it JOIN w USING (t) JOIN dt USING (t) JOIN n USING (doc_id), s GROUP BY item_id, doc_id),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM r WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 20
"""
