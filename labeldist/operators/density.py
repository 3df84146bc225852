"""Density hierarchy (M7): clusters of all densities, the most stable ones chosen.

* Core distance of a row: that of its ``min_samples``-th nearest row, itself
  included (exact search).  Two rows reach each other at the largest of
  their core distances and their distance.
* Minimum spanning tree of the mutual reachability: Boruvka rounds, in which each
  component takes its lightest edge to another.  Edges among near neighbours,
  to the pivots of the cells and between these are known, so that every
  component knows one; a pair is searched for only if both its rows could hold a
  lighter edge than that.
* The tree's edges are merged in order of their weight, in blocks of bounded
  size; between blocks the components of all rows are joined on.  A merge of two
  components of at least ``min_cluster_size`` rows makes a new cluster of
  the hierarchy, a smaller one falls out of the cluster that it joins.
  Stability is summed on the way, so that the choice (excess of mass) is
  known for each cluster when it ends.
* Every row gets the uppermost chosen cluster above it, by pointer doubling.

Edges are compared by weight, then by ids, so equal weights have one order.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labeldist.operators.metrics import distributed_rank
from labeldist.operators.neighbours import LAST_ID, Cells, by_part, in_cells, k_nearest, matrix, meet, reach_of
from labeldist.session import written

NOISE = -1                 # fixed value: cluster id of noise points
BLOCK_EDGES = 500_000      # edges that are merged in one task
FEW_EDGES = 200_000        # so many edges between components are joined by the driver
KNOWN = 16                 # near neighbours whose edges are known to the first rounds
LEAST = 1e-12              # lighter edges count as this
EDGE = "w double, a long, b long"


# --- minimum spanning tree ------------------------------------------------------

def _components(edges: DataFrame, comp: DataFrame) -> DataFrame:
    """``id, comp`` after the chosen edges (between components) are joined: each component's smallest member's name."""
    if edges.count() <= FEW_EDGES:
        return _renamed(comp, _few_components(edges))
    # every component chose one edge, so chosen edges form trees; smaller names spread over them, two hops at a time
    both = edges.select("ca", "cb").union(edges.select(F.col("cb").alias("ca"), F.col("ca").alias("cb"))).distinct()
    name = written(both.select(F.col("ca").alias("c")).distinct().withColumn("to", F.col("c")))
    while True:
        seen = both.join(name.toDF("cb", "to"), "cb").groupBy(F.col("ca").alias("c")).agg(F.min("to").alias("seen"))
        new = name.join(seen, "c").select("c", F.least("to", "seen").alias("to"))
        new = new.join(name.toDF("to", "further"), "to").select("c", F.col("further").alias("to"))
        new = written(new)
        changed = not new.join(name.toDF("c", "was"), "c").filter("to <> was").isEmpty()
        name = new
        if not changed:
            break
    return _renamed(comp, name)


def _renamed(comp: DataFrame, name: DataFrame) -> DataFrame:
    return comp.join(name.toDF("comp", "to"), "comp", "left").select("id", F.coalesce("to", "comp").alias("comp"))


def _few_components(edges: DataFrame) -> DataFrame:
    """``c, to``: the smallest name that each component is joined with by ``edges`` (a bounded number)."""
    up: dict[int, int] = {}

    def find(c: int) -> int:
        while up.setdefault(c, c) != c:
            up[c] = c = up[up[c]]
        return c

    table = edges.select("ca", "cb").toArrow()
    for a, b in zip(table["ca"].to_pylist(), table["cb"].to_pylist(), strict=True):
        low, high = sorted((find(a), find(b)))
        up[high] = low
    return edges.sparkSession.createDataFrame(pa.table(
        {"c": pa.array(list(up), pa.int64()), "to": pa.array([find(c) for c in list(up)], pa.int64())}))


def _foreign(cells: Cells, open_: DataFrame, rows: DataFrame) -> DataFrame:
    """``comp, w, a, b``: per task the lightest edge of each component of open rows (``limit``: heavier ones don't matter) to
    a row of another.  Rows whose ``last`` known neighbour is further than the limit have no unknown edge that matters."""
    d, centre, radius = cells.d, cells.centre, cells.radius

    def compare(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(t):
            return pd.DataFrame({"comp": [], "w": [], "a": [], "b": []})
        parts = [(targets, *(of[c].to_numpy() for c in ("id", "cell", "core", "last", "comp"))) for targets, of in by_part(t, d)]
        comps, first = np.unique(q["comp"].to_numpy(), return_index=True)
        limit = q["limit"].to_numpy()[first].copy()
        weight, low, high = np.full(len(comps), np.inf), np.full(len(comps), LAST_ID), np.full(len(comps), LAST_ID)
        for c, of in q.groupby("cell"):
            whose = np.searchsorted(comps, of["comp"].to_numpy())
            gap = np.linalg.norm(centre - centre[c], axis=1) - radius - radius[c]
            most = np.bincount(whose).argmax()
            # the rows of the cell's main component are not compared with those of the same one
            for rows_, main in ((np.flatnonzero(whose == most), comps[most]), (np.flatnonzero(whose != most), None)):
                if not len(rows_):
                    continue
                x, own, own_core, mine = matrix(of["x"].iloc[rows_], d), of["id"].to_numpy()[rows_], of["core"].to_numpy()[rows_], whose[rows_]
                for targets, ids, cell, core, last, comp in parts:
                    reach = limit[mine]
                    use = (gap[cell] <= reach.max() * (1 + 1e-9) + 1e-12) & (last <= reach.max()) & (core <= reach.max())
                    if main is not None:
                        use &= comp != main
                    for i, j, far in targets.close(x, reach, use, lambda i, j, mine=mine, comp=comp: comps[mine[i]] != comp[j]):
                        w = np.maximum(far, np.maximum(own_core[i], core[j]))
                        g, a, b = mine[i], np.minimum(own[i], ids[j]), np.maximum(own[i], ids[j])
                        order = np.lexsort((b, a, w, g))
                        order = order[np.unique(g[order], return_index=True)[1]]
                        g, w, a, b = g[order], w[order], a[order], b[order]
                        better = (w <= limit[g]) & ((w < weight[g]) | ((w == weight[g]) & ((a < low[g]) | ((a == low[g]) & (b < high[g])))))
                        g = g[better]
                        weight[g], low[g], high[g] = w[better], a[better], b[better]
                        limit[g] = weight[g]
                        reach[:] = limit[mine]
        found = np.flatnonzero(np.isfinite(weight))
        return pd.DataFrame({"comp": comps[found], "w": weight[found], "a": low[found], "b": high[found]})

    pairs = [(p, b) for p, (of, r) in reach_of(cells, open_, "limit").items() for b in cells.near(of, r)]
    return meet(cells, open_, rows, pairs, compare, "comp long, " + EDGE)


def _tree_of_pivots(x: np.ndarray, ids: np.ndarray, core: np.ndarray) -> list[tuple[float, int, int]]:
    """The spanning tree of the pivots (a bounded number), grown by its lightest edge."""
    weight, to = np.full(len(ids), np.inf), np.zeros(len(ids), np.int64)      # each one's lightest edge to the tree
    out, free, new = [], np.ones(len(ids), bool), 0
    for _ in range(len(ids) - 1):
        free[new] = False
        diff = x - x[new]
        w = np.maximum(np.sqrt(np.einsum("ij,ij->i", diff, diff)), np.maximum(core, core[new]))
        nearer = w < weight
        weight[nearer], to[nearer] = w[nearer], new
        new = int(np.where(free, weight, np.inf).argmin())
        if not free[new]:
            break
        a, b = sorted((int(ids[new]), int(ids[to[new]])))
        out.append((float(weight[new]), a, b))
    return out


def _known(cells: Cells, rows: DataFrame, near: DataFrame) -> DataFrame:
    """Edges (``EDGE``, each once) that are known before any search: to near neighbours, from each row to the pivot of its
    cell, and the tree of the pivots: whatever the components, each has a known edge to another."""
    spark, pivots = rows.sparkSession, list(zip(range(len(cells.pivot)), cells.pivot.tolist(), strict=True))
    core = rows.select("id", "core")
    table = F.broadcast(spark.createDataFrame(pivots, "cell int, other long"))
    of_pivot = {r.other: r.core for r in table.select("other").join(core.toDF("other", "core"), "other").collect()}
    tree = spark.createDataFrame(_tree_of_pivots(cells.centre, cells.pivot, np.array([of_pivot[i] for i in cells.pivot.tolist()])), EDGE)
    to_pivot = rows.join(table, "cell").filter("id <> other").select("id", "other", F.col("far").alias("dist"))
    edges = near.select("id", F.explode("near").alias("n")).select("id", F.col("n.id").alias("other"), F.col("n.distance").alias("dist"))
    edges = edges.union(to_pivot).groupBy(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).agg(F.min("dist").alias("dist"))
    edges = edges.join(core.toDF("a", "core_a"), "a").join(core.toDF("b", "core_b"), "b")
    return written(edges.select(F.greatest("dist", "core_a", "core_b").alias("w"), "a", "b").union(tree))


def spanning_tree(cells: Cells, core: DataFrame, near: DataFrame) -> DataFrame:
    """``w, a, b`` (a < b) of the minimum spanning tree; ``core``: id, core; ``near``: id, near (``KNOWN`` neighbours)."""
    # a row's unknown edges weigh at least as much as the last of its known ones is far
    last = near.select("id", F.when(F.size("near") >= KNOWN, F.element_at("near", -1)["distance"]).alias("last"))
    rows = written(cells.rows.join(core, "id").join(last, "id", "left"))
    known = _known(cells, rows, near)
    comp, tree = written(core.select("id", F.col("id").alias("comp"))), None
    edge = F.struct("w", "a", "b")
    while True:
        known = written(known.select("w", "a", "b").join(comp.toDF("a", "ca"), "a").join(comp.toDF("b", "cb"), "b").filter("ca <> cb"))
        best = known.select(F.col("ca").alias("comp"), "w", "a", "b").union(known.select("cb", "w", "a", "b"))
        best = written(best.groupBy("comp").agg(F.min(edge).alias("edge")))
        # rows that may have a lighter edge that isn't known
        limits = comp.join(best.select("comp", F.col("edge.w").alias("limit")), "comp")
        open_ = written(rows.join(limits, "id").filter((F.col("last") <= F.col("limit")) & (F.col("core") <= F.col("limit"))))
        chosen, furthest = best, open_.agg(F.max("limit")).first()[0]
        if furthest is not None:
            searched = _foreign(cells, open_, rows.filter(F.col("last") <= furthest).join(comp, "id")).select("comp", edge.alias("edge"))
            chosen = best.union(searched).groupBy("comp").agg(F.min("edge").alias("edge"))
        chosen = chosen.select("edge.w", "edge.a", "edge.b").distinct()
        chosen = written(chosen.join(comp.toDF("a", "ca"), "a").join(comp.toDF("b", "cb"), "b").select("w", "a", "b", "ca", "cb"))
        if chosen.isEmpty():
            return tree if tree is not None else rows.sparkSession.createDataFrame([], EDGE)
        tree = written((chosen.select("w", "a", "b") if tree is None else tree.union(chosen.select("w", "a", "b"))))
        comp = written(_components(chosen, comp))


# --- hierarchy ------------------------------------------------------------------

STATE = ("size", "cluster", "total", "children")


class Merge:
    """Components while edges are merged in order: size, the cluster that they stand for, that cluster's sum of (rows
    times lambda at which they leave it), and the best stability below it.

    A component of fewer rows than ``least`` stands for no cluster (0) and knows the components it came from, by the name
    that they had before (``least`` at most).  ``fell``: (former component, cluster, lambda) of small components that
    fell out of a cluster; ``ended``: (cluster, parent, chosen) of clusters that became part of another one."""

    def __init__(self, least: int, clusters: int = 0):
        self.least, self.clusters = least, clusters
        self.up: dict[int, int] = {}
        self.state: dict[int, list] = {}
        self.members: dict[int, list[int]] = {}
        self.fell: list[tuple[int, int, float]] = []
        self.ended: list[tuple[int, int, bool]] = []

    def know(self, comp: int, state: list) -> None:
        if comp not in self.up:
            self.up[comp], self.state[comp] = comp, state
            if not state[1]:
                self.members[comp] = [comp]

    def find(self, c: int) -> int:
        while self.up[c] != c:
            self.up[c] = c = self.up[self.up[c]]
        return c

    def _end(self, state: list, parent: int, lam: float) -> float:
        size, cluster, total, children = state
        stability = total - size * lam
        self.ended.append((cluster, parent, bool(stability >= children)))
        return max(stability, children)

    def _fall(self, root: int, cluster: int, lam: float) -> None:
        self.fell += [(c, cluster, lam) for c in self.members.pop(root)]

    def edge(self, w: float, a: int, b: int) -> None:
        ra, rb = sorted((self.find(a), self.find(b)))
        lam = 1.0 / max(w, LEAST)
        one, two = self.state[ra], self.state.pop(rb)
        size = one[0] + two[0]
        if one[1] and two[1]:
            self.clusters += 1
            best = self._end(one, self.clusters, lam) + self._end(two, self.clusters, lam)
            new = [size, self.clusters, size * lam, best]
        elif one[1] or two[1]:
            big, small, root = (one, two, rb) if one[1] else (two, one, ra)
            self._fall(root, big[1], lam)
            new = [size, big[1], big[2] + small[0] * lam, big[3]]
        elif size >= self.least:
            self.clusters += 1
            self._fall(ra, self.clusters, lam)
            self._fall(rb, self.clusters, lam)
            new = [size, self.clusters, size * lam, 0.0]
        else:
            self.members[ra] += self.members.pop(rb)
            new = [size, 0, 0.0, 0.0]
        self.up[rb], self.state[ra] = ra, new


def _merged(least: int, clusters: int):
    """One block of edges (with the states of their components) in order; four kinds of rows come out."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        m = Merge(least, clusters)
        for side in "ab":
            for c, *state in zip(*[pdf[f"{k}{side}"].tolist() for k in ("c", *STATE)], strict=True):
                m.know(c, state)
        for w, a, b in zip(pdf["w"].tolist(), pdf["ca"].tolist(), pdf["cb"].tolist(), strict=True):
            m.edge(w, a, b)
        out = [("now", c, m.find(c), 0, 0.0, 0.0) for c in m.up]
        out += [("state", c, s[0], s[1], s[2], s[3]) for c, s in m.state.items()]
        out += [("fell", c, k, 0, lam, 0.0) for c, k, lam in m.fell]
        out += [("ended", c, parent, int(chosen), 0.0, 0.0) for c, parent, chosen in m.ended]
        out += [("clusters", 0, m.clusters, 0, 0.0, 0.0)]
        return pd.DataFrame(out, columns=["kind", "p", "q", "r", "u", "v"])
    return run


def hierarchy(tree: DataFrame, ids: DataFrame, min_cluster_size: int) -> tuple[DataFrame, DataFrame]:
    """``(id, cluster, lam)``: the cluster that each row falls out of, and where; ``(cluster, parent, chosen)``: all
    clusters but the one that holds everything (its number is the largest).

    Edges are merged in order of weight and ids, ``BLOCK_EDGES`` in a task; what a block needs of the ones before is the
    components of its edges' ends and their sums, which are joined to it."""
    ranked = written(distributed_rank(tree, ["w", "a", "b"]))
    n_blocks = -(-ranked.count() // BLOCK_EDGES)
    comp = ids.select("id", F.col("id").alias("comp"))
    state, fell, ended, clusters = None, [], [], 0
    for i in range(n_blocks):
        block = ranked.filter(F.col("rank").between(i * BLOCK_EDGES, (i + 1) * BLOCK_EDGES - 1))
        for side in "ab":
            block = block.join(comp.toDF(side, f"c{side}"), side)
            if state is not None:
                block = block.join(state.toDF(f"c{side}", *[f"{k}{side}" for k in STATE]), f"c{side}", "left")
            new = {"size": F.lit(1).cast("long"), "cluster": F.lit(0).cast("long"), "total": F.lit(0.0), "children": F.lit(0.0)}
            for k, v in new.items():
                block = block.withColumn(f"{k}{side}", F.coalesce(f"{k}{side}", v) if state is not None else v)
        out = written(block.withColumn("g", F.lit(0)).groupBy("g").applyInPandas(
            _merged(min_cluster_size, clusters), "kind string, p long, q long, r long, u double, v double"))
        of = lambda kind: out.filter(F.col("kind") == kind)
        clusters = of("clusters").first().q
        ended.append(of("ended").select(F.col("p").alias("cluster"), F.col("q").alias("parent"), (F.col("r") == 1).alias("chosen")))
        fell.append(written(comp.join(of("fell").select(F.col("p").alias("comp"), F.col("q").alias("cluster"), F.col("u").alias("lam")), "comp")
                            .select("id", "cluster", "lam")))
        if i < n_blocks - 1:
            now = of("now").select(F.col("p").alias("comp"), F.col("q").alias("now"))
            fresh = of("state").select(F.col("p").alias("comp"), F.col("q").alias("size"), F.col("r").alias("cluster"),
                                       F.col("u").alias("total"), F.col("v").alias("children"))
            comp = written(comp.join(now, "comp", "left").select("id", F.coalesce("now", "comp").alias("comp")))
            old = state.join(now, "comp", "left_anti").union(fresh) if state is not None else fresh
            state = written(old.select("comp", *STATE))
    rows = functools.reduce(DataFrame.union, fell) if fell else ids.select("id", F.lit(0).cast("long").alias("cluster"), F.lit(0.0).alias("lam")).limit(0)
    of_cluster = functools.reduce(DataFrame.union, ended) if ended else ids.sparkSession.createDataFrame(
        [], "cluster long, parent long, chosen boolean")
    return rows, of_cluster


def chosen_clusters(clusters: DataFrame) -> DataFrame:
    """``(cluster, label)``: the uppermost chosen cluster at or above each (0: none), by pointer doubling."""
    c = written(clusters.select("cluster", F.col("parent").alias("to"), F.when(F.col("chosen"), F.col("cluster")).otherwise(0).alias("label")))
    while True:
        above = c.select(F.col("cluster").alias("to"), F.col("to").alias("next"), F.col("label").alias("higher"))
        new = c.join(above, "to", "left").select(
            "cluster", F.coalesce("next", F.lit(0)).alias("to"),
            F.when(F.coalesce("higher", F.lit(0)) != 0, F.col("higher")).otherwise(F.col("label")).alias("label"))
        c = written(new)
        if c.filter("to <> 0").isEmpty():
            return c.select("cluster", "label")


def density_hierarchy(points: DataFrame, min_cluster_size: int = 5, min_samples: int | None = None) -> DataFrame:
    """M7: ``id`` and ``cluster`` (:data:`NOISE` outside of all clusters) of every row of ``points`` (``id``, ``x``).

    ``min_samples`` (default: ``min_cluster_size``) rows, the row itself included, reach to a row's core distance.  A
    cluster holds everything below it in the hierarchy; the one that holds all rows is never chosen.  Clusters
    are numbered by their smallest id."""
    k = min_samples or min_cluster_size
    if min_cluster_size < 2 or k < 1:
        raise ValueError("min_cluster_size must be 2 or more, min_samples 1 or more")
    cells = in_cells(points)
    near = written(k_nearest(cells, max(KNOWN, k - 1)))
    ids = cells.rows.select("id")
    # a row with fewer than k - 1 others reaches them all
    core = ids.join(near, "id", "left").select("id", F.coalesce(
        F.lit(0.0) if k == 1 else F.element_at("near", F.least(F.lit(k - 1), F.size("near")))["distance"], F.lit(0.0)).alias("core"))
    core = written(core)
    fell, clusters = hierarchy(spanning_tree(cells, core, near), ids, min_cluster_size)
    labels = chosen_clusters(written(clusters))
    row = ids.join(fell.join(labels, "cluster", "left").select("id", F.coalesce("label", F.lit(0)).alias("label")), "id", "left")
    row = written(row.select("id", F.coalesce("label", F.lit(0)).alias("label")))
    number = row.filter("label <> 0").groupBy("label").agg(F.min("id").alias("cluster"))
    return row.join(number, "label", "left").select("id", F.coalesce("cluster", F.lit(NOISE).cast("long")).alias("cluster"))
