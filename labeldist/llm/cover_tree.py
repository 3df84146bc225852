"""Exact top-k by inner product with dual cover trees.

Rows and queries are dealt into blocks, and each block is indexed by a cover
tree: a node's points lie within its covering radius of its centre, and its
children's centres cover them at a smaller radius and lie at least that far
apart.  A query block meets a row block as a pair of trees: the inner
product of any two points below a pair of nodes is at most
``c*d + |c| r_d + |d| r_c + r_c r_d`` (centres c, d, radii r), and the pair is
dropped if that is below the worst k-th score of the queries in the node.
Queries first meet one block each, so that they bring a k-th score to all
others.  Scores are integers and exact.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labeldist.llm.common import column_or_null, row_ids, stored

BLOCK_ROWS = 4096
QUERY_ROWS = 1024
LEAF = 128
CHILDREN = 16
TREE = "block long, dim int, rids array<long>, ids array<long>, points array<long>, first array<int>, last array<int>, " \
       "center array<int>, radius array<double>, child array<int>, children array<int>"


class Tree:
    """Points in tree order; node i holds points first[i] .. last[i] - 1 and nodes child[i] .. child[i] + children[i] - 1."""

    def __init__(self, points, first, last, center, radius, child, children):
        self.points, self.first, self.last = points, first, last
        self.center, self.radius, self.child, self.children = points[center], radius, child, children
        self.length = np.sqrt((self.center.astype(float) ** 2).sum(axis=1))


def build(points: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The order of the points, and the nodes (``center``: a place in that order)."""
    x = points.astype(float)
    order, nodes = np.arange(len(x)), []

    def distances(at: int, rows: np.ndarray) -> np.ndarray:
        return np.sqrt(((x[rows] - x[at]) ** 2).sum(axis=1))

    def add(a: int, b: int, center: int) -> int:
        far = distances(center, order[a:b]).max() if b > a else 0.0
        nodes.append([a, b, center, far, 0, 0])
        return len(nodes) - 1

    todo = [add(0, len(x), 0)] if len(x) else []
    while todo:
        node = todo.pop()
        a, b, center, radius = nodes[node][:4]
        if b - a <= LEAF or radius == 0:
            continue
        # centres of the next level, each the point that is furthest from those before: every point lies within the last
        # one's distance of a centre, and all centres are that far apart
        rows = order[a:b]
        centres, near, which = [center], distances(center, rows), np.zeros(len(rows), np.int64)
        while len(centres) < CHILDREN and near.max() > 0:
            centres.append(rows[near.argmax()])
            d = distances(centres[-1], rows)
            closer = d < near
            near[closer], which[closer] = d[closer], len(centres) - 1
        parts = [(c, rows[which == i]) for i, c in enumerate(centres) if (which == i).any()]
        order[a:b] = np.concatenate([p for _, p in parts])
        nodes[node][4:] = len(nodes), len(parts)
        at = a
        for c, p in parts:
            todo.append(add(at, at + len(p), c))
            at += len(p)
    place = np.empty(len(x), np.int64)
    place[order] = np.arange(len(x))
    table = np.array(nodes, dtype=float).reshape(-1, 6)
    return order, {"first": table[:, 0].astype(int), "last": table[:, 1].astype(int),
                   "center": place[table[:, 2].astype(int)], "radius": table[:, 3],
                   "child": table[:, 4].astype(int), "children": table[:, 5].astype(int)}


def _index(rows: pd.DataFrame) -> pd.DataFrame:
    points = np.stack(rows["__point"].to_numpy()) if len(rows) else np.zeros((0, 0), np.int64)
    order, nodes = build(points)
    return pd.DataFrame([{
        "block": rows["__block"].iloc[0], "dim": rows["__dim"].iloc[0], "rids": rows["__rid"].to_numpy()[order],
        "ids": rows["__id"].astype("Int64").to_numpy()[order], "points": points[order].ravel(), **nodes}])


def _tree(row, side: str) -> tuple[Tree, np.ndarray, list]:
    dim = int(row["dim"])
    part = {c: np.asarray(row[side + c]) for c in ("points", "first", "last", "center", "radius", "child", "children", "rids")}
    points = part["points"].reshape(len(part["rids"]), dim)
    return Tree(points, *[part[c] for c in ("first", "last", "center", "radius", "child", "children")]), part["rids"], row[side + "ids"]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    return (a.astype(float) @ b.astype(float).T).astype(np.int64) if top < 2**52 else a @ b.T


def search(q: Tree, q_rid: np.ndarray, d: Tree, d_rid: np.ndarray, d_id: np.ndarray, k: int, kth: np.ndarray):
    """For each query its (score, place) pairs that may be among the k best: all that reach the final k-th score.

    ``kth``: k-th scores known so far (raised in place).  Ties are kept, for the smaller id to be found."""
    n = len(q.points)
    best_s = np.full((n, k), np.iinfo(np.int64).min)
    best_i, best_at = np.full((n, k), np.iinfo(np.int64).max), np.full((n, k), -1)

    def bounds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        dot = q.center[a].astype(float) @ d.center[b].astype(float).T
        ra, rb = q.radius[a][:, None], d.radius[b][None, :]
        upper = dot + q.length[a][:, None] * rb + d.length[b][None, :] * ra + ra * rb
        return upper + 1e-9 * np.abs(upper) + 1e-6

    todo = [(-np.inf, 0, 0)] if n and len(d.points) else []
    while todo:
        bound, a, b = heapq.heappop(todo)
        qa, qb = q.first[a], q.last[a]
        if -bound < kth[qa:qb].min():
            continue
        split_q = q.children[a] and (not d.children[b] or q.radius[a] >= d.radius[b])
        if split_q or d.children[b]:
            left = np.arange(q.child[a], q.child[a] + q.children[a]) if split_q else np.array([a])
            right = np.array([b]) if split_q else np.arange(d.child[b], d.child[b] + d.children[b])
            upper = bounds(left, right)
            worst = np.array([kth[q.first[i]:q.last[i]].min() for i in left])
            for i, j in zip(*np.nonzero(upper >= worst[:, None]), strict=True):
                heapq.heappush(todo, (-upper[i, j], int(left[i]), int(right[j])))
            continue
        da, db = d.first[b], d.last[b]
        s = products(q.points[qa:qb], d.points[da:db])
        own = q_rid[qa:qb, None] == d_rid[None, da:db]
        some = np.flatnonzero(((s >= kth[qa:qb, None]) & ~own).any(axis=1))
        if not len(some):
            continue
        rows = qa + some
        s = np.where(own[some], np.iinfo(np.int64).min, s[some])
        all_s = np.concatenate([best_s[rows], s], axis=1)
        all_i = np.concatenate([best_i[rows], np.broadcast_to(d_id[da:db], s.shape)], axis=1)
        all_at = np.concatenate([best_at[rows], np.where(own[some], -1, np.arange(da, db)[None, :])], axis=1)
        order = np.lexsort((all_i, -all_s.astype(float) if np.abs(all_s[all_at >= 0]).max(initial=0) < 2**52 else ~all_s), axis=1)[:, :k]
        best_s[rows], best_i[rows], best_at[rows] = (np.take_along_axis(x, order, axis=1) for x in (all_s, all_i, all_at))
        kth[rows] = np.maximum(kth[rows], best_s[rows, k - 1])
    return best_s, best_at


def _search_pair(k: int):
    def run(pair: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, row in pair.iterrows():
            q, q_rid, q_id = _tree(row, "q_")
            d, d_rid, d_ids = _tree(row, "d_")
            d_id = np.array([np.iinfo(np.int64).max if i is None or i is pd.NA or i != i else i for i in d_ids], dtype=np.int64)
            known = dict(zip(row["known_rids"], row["known"], strict=True)) if row["known_rids"] is not None else {}
            low = np.iinfo(np.int64).min
            kth = np.array([known.get(r, low) for r in q_rid], dtype=np.int64)
            score, at = search(q, q_rid, d, d_rid, d_id, k, kth)
            i, j = np.nonzero(at >= 0)
            reach = score[i, j] >= kth[i]
            i, j = i[reach], j[reach]
            ids = d_id[at[i, j]]
            out.append(pd.DataFrame({"q_rid": q_rid[i], "query_id": [q_id[x] for x in i], "d_rid": d_rid[at[i, j]],
                                     "vec_id": pd.array(np.where(ids == np.iinfo(np.int64).max, 0, ids), "Int64"), "score": score[i, j]}))
            out[-1].loc[ids == np.iinfo(np.int64).max, "vec_id"] = pd.NA
        return pd.concat(out)
    return run


FOUND = "q_rid long, query_id long, d_rid long, vec_id long, score long"


def integer_vectors(rows: DataFrame, embedding: str = "embedding", scale: int = 256) -> DataFrame:
    """``__rid, __id, __point`` (floor(scale * x) of each component); vectors that are null or hold a null or
    non-finite component are left out."""
    x = F.col(embedding).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    return row_ids(rows).filter(F.col(embedding).isNotNull()).filter(finite).select(
        "__rid", column_or_null(rows, "vec_id", "long").alias("__id"),
        F.transform(x, lambda v: F.floor(v * scale)).alias("__point"), F.size(embedding).alias("__dim"))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best rows (but its own) of every query, ties to the smaller id (null last).

    ``vectors``: see :func:`integer_vectors`; a query meets the rows of its own
    dimension.  Blocks have a fixed number of rows, so the number of block pairs
    follows the rows; each pair is one task's group, and a query gets at most
    k rows from each.  Repeated rows are rows of their own (and each other's candidates); an empty table, or one without
    usable vectors or queries, gives an empty result.
    """
    vectors = stored(vectors, "vectors")
    sizes = vectors.agg(F.count(F.lit(1)), F.sum(is_query.cast("long"))).first()
    blocks, groups = -(-sizes[0] // BLOCK_ROWS) or 1, -(-(sizes[1] or 0) // QUERY_ROWS) or 1
    deal = F.xxhash64("__rid")
    indexed = lambda rows, n: rows.withColumn("__block", F.pmod(deal, F.lit(n))).groupBy("__dim", "__block").applyInPandas(_index, TREE)
    data = stored(indexed(vectors, blocks), "trees")
    queries = stored(indexed(vectors.filter(is_query), groups), "trees")
    names = [c.split()[0] for c in TREE.split(", ") if c.split()[0] not in ("block", "dim")]
    side = lambda df, s: df.select("dim", F.col("block").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in names])

    def meet(pairs: DataFrame, known: DataFrame | None) -> DataFrame:
        """Search the pairs (``dim, q, d``) of blocks."""
        joined = pairs.join(side(queries, "q"), ["dim", "q"]).join(side(data, "d"), ["dim", "d"])
        if known is None:
            joined = joined.withColumns({"known_rids": F.lit(None).cast("array<long>"), "known": F.lit(None).cast("array<long>")})
        else:
            joined = joined.join(known, ["dim", "q"], "left")
        return joined.groupBy("dim", "q", "d").applyInPandas(_search_pair(k), FOUND)

    grid = queries.select("dim", F.col("block").alias("q"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("d"))
    start = grid.filter(F.col("d") == F.pmod("q", F.lit(blocks)))
    first = stored(meet(start, None), "first")
    of_block = queries.select("dim", F.col("block").alias("q"), F.explode("rids").alias("q_rid"))
    known = first.groupBy("q_rid").agg(F.min("score").alias("s"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k).join(
        of_block, "q_rid").groupBy("dim", "q").agg(F.collect_list("q_rid").alias("known_rids"), F.collect_list("s").alias("known"))
    found = first.union(meet(grid.filter(F.col("d") != F.pmod("q", F.lit(blocks))), known))
    best = Window.partitionBy("q_rid").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "d_rid")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3(embeddings: DataFrame) -> DataFrame:
    return top_k(integer_vectors(embeddings), F.coalesce(F.col("__id") % 50 == 0, F.lit(False)))


SQL = r"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS p
  FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.r AS qr, q.vec_id AS query_id, d.vec_id, list_sum([z[1] * z[2] for z in list_zip(q.p, d.p)])::BIGINT AS score
  FROM v q JOIN v d ON q.r <> d.r AND len(q.p) = len(d.p) WHERE q.vec_id % 50 = 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT query_id, vec_id, score,
         row_number() OVER (PARTITION BY qr ORDER BY score DESC, vec_id NULLS LAST)::INTEGER AS rank FROM s)
WHERE rank <= 5
"""
