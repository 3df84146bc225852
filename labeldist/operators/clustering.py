"""Cluster evaluation (A1, A2, J2, M10) and clustering jobs (M3-M9).

The evaluation never moves instance rows to one place: the contingency
table is a grouped count (K x C cells, K clusters and C senses), only that
small table is solved for the best one-to-one mapping, and the mapping (at
most K rows) is broadcast back onto the instances.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labeldist.operators import density, mixture, summary
from labeldist.operators import metrics as M
from labeldist.operators.blocks import as_array
from labeldist.session import scratch_path

NOISE = -1            # fixed value: cluster id of noise points


# ------------------------------------------------------------------- A1

def contingency(df: DataFrame, cluster: str = "cluster", label: str = "sense",
                by: Sequence[str] = ()) -> DataFrame:
    """A1 (long form): ``(by..., cluster, label, n)``; noise and NULL labels left out."""
    d = df.filter(F.col(label).isNotNull() & (F.col(cluster) != NOISE))
    return d.groupBy(*by, cluster, label).agg(F.count(F.lit(1)).alias("n"))


def contingency_wide(df: DataFrame, cluster: str, label: str, labels: Sequence,
                     names: Sequence[str] | None = None) -> DataFrame:
    """A1 (cross-tab): one row per cluster, one count column per label.

    The label values are passed in, so the pivot needs no extra job to
    discover them."""
    names = list(names) if names is not None else [str(v) for v in labels]
    p = df.groupBy(cluster).pivot(label, list(labels)).agg(F.count(F.lit(1)))
    p = p.fillna(0, subset=[str(v) for v in labels])
    return p.select(cluster, *[F.col(f"`{v}`").cast("long").alias(n) for v, n in zip(labels, names)])


# ------------------------------------------------------------------- A2

def _least_cost(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The column of each row in an assignment of least cost of a square matrix of whole numbers, and which cells may
    belong to one (reduced cost 0).  Shortest augmenting paths with prices of rows and columns."""
    n = len(cost)
    u, v = np.zeros(n + 1), np.zeros(n + 1)
    owner, way = np.zeros(n + 1, dtype=int), np.zeros(n + 1, dtype=int)     # places from 1; column 0: the row to be placed
    for i in range(1, n + 1):
        owner[0], j = i, 0
        least, used = np.full(n + 1, np.inf), np.zeros(n + 1, bool)
        while owner[j]:
            used[j] = True
            row = owner[j]
            now = np.concatenate([[np.inf], cost[row - 1] - u[row] - v[1:]])
            better = ~used & (now < least)
            least[better], way[better] = now[better], j
            j = int(np.where(used, np.inf, least).argmin())
            step = least[j]
            u[owner[used]] += step
            v[used] -= step
            least[~used] -= step
        while j:
            owner[j], j = owner[way[j]], way[j]
    column = np.empty(n, int)
    column[owner[1:] - 1] = np.arange(n)
    return column, cost - u[1:, None] - v[1:] == 0


def _first_of_equals(column: np.ndarray, tight: np.ndarray, rows: int) -> np.ndarray:
    """Among assignments within the tight cells the one whose columns, row by row, are the smallest."""
    column, n = column.copy(), len(column)
    for i in range(rows):
        owner = np.empty(n, int)
        owner[column] = np.arange(n)
        # rows behind i that can move along tight cells so that the column of i is taken again
        moves, todo = {}, [column[i]]
        open_ = np.zeros(n, bool)
        open_[i + 1:] = True
        while todo:
            c = todo.pop()
            for r in np.flatnonzero(open_ & tight[:, c]):
                open_[r] = False
                moves[r] = c
                todo.append(column[r])
        for j in np.flatnonzero(tight[i]):
            if j == column[i]:
                break
            if owner[j] in moves:
                r, freed = owner[j], column[i]
                column[i] = j
                while True:
                    column[r] = moves[r]
                    if moves[r] == freed:
                        break
                    r = owner[moves[r]]
                break
    return column


def solve_assignment(cells: pd.DataFrame, cluster: str, label: str) -> pd.DataFrame:
    """Best one-to-one cluster -> label mapping for ONE contingency table of any size.

    Maximises the matched count.  Of equally good mappings it is the one that gives the clusters, in ascending order,
    the smallest labels; being left out (more clusters than labels) comes after all labels."""
    ks = sorted(cells[cluster].unique().tolist())
    cs = sorted(cells[label].unique().tolist())
    n = max(len(ks), len(cs))
    gain = np.zeros((n, n))
    np.add.at(gain, ([ks.index(k) for k in cells[cluster]], [cs.index(c) for c in cells[label]]), cells["n"].to_numpy(float))
    column = _first_of_equals(*_least_cost(-gain), len(ks))
    pairs = [(k, cs[j]) for k, j in zip(ks, column, strict=False) if j < len(cs)]
    return pd.DataFrame(pairs, columns=[cluster, label])


def assign_clusters(cells: DataFrame, cluster: str = "cluster", label: str = "sense",
                    by: Sequence[str] = ()) -> DataFrame:
    """A2: optimal mapping per evaluation group, from contingency cells.

    The input is the (K x C)-cell contingency table, never instance rows, so
    each ``applyInPandas`` group holds at most K*C rows however large the
    data is.  Output: ``(by..., cluster, label)``.
    """
    by = list(by)
    schema = cells.select(*by, cluster, label).schema

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        m = solve_assignment(pdf, cluster, label)
        for b in by:
            m.insert(0, b, pdf[b].iloc[0])
        return m[[*by, cluster, label]]

    src = cells if by else cells.withColumn("_g", F.lit(0))
    return src.groupBy(*(by or ["_g"])).applyInPandas(solve, schema)


# ------------------------------------------------------------------- J2, M10

def apply_mapping(df: DataFrame, mapping: DataFrame, cluster: str = "cluster",
                  label: str = "sense", out: str = "predicted_sense",
                  by: Sequence[str] = ()) -> DataFrame:
    """Predicted label per instance; unmapped clusters and noise -> NULL.

    The mapping has at most one row per cluster, so it is broadcast."""
    m = mapping.select(*by, cluster, F.col(label).alias(out))
    return df.join(F.broadcast(m), [*by, cluster], "left")


def evaluate_clusters(df: DataFrame, cluster: str = "cluster", label: str = "sense",
                      by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Contingency -> assignment -> mapping -> (overall, per-label) accuracy.

    Returns ``(mapped_rows, overall_accuracy, accuracy_by_label)``.
    """
    cells = contingency(df, cluster, label, by)
    mapping = assign_clusters(cells, cluster, label, by)
    mapped = apply_mapping(df, mapping, cluster, label, "predicted_sense", by)
    overall = M.accuracy(mapped, label, "predicted_sense", by)
    per = M.accuracy_by_label(mapped, label, "predicted_sense", by)
    return mapped, overall, per


# ------------------------------------------------------------------- M5-M9

def _kmeans(df: DataFrame, k: int, features: str, seed: int, out: str = "cluster"):
    from pyspark.ml.clustering import KMeans
    model = KMeans(k=k, seed=seed, featuresCol=features, predictionCol=out, initMode="k-means||").fit(df)
    return model, model.transform(df)


def grid_density(df: DataFrame, features: str = "features", min_size: int = 5, eps: float | None = None,
                 *, dims: int) -> DataFrame:
    """Density clustering on a grid (re-aim of a density hierarchy).

    Points are projected to ``dims`` principal components and binned into
    cells of width ``eps``; cells holding at least ``min_size`` points are
    dense; dense cells touching (including diagonals) form one cluster,
    found by min-label propagation over the cell graph, iterated until no
    label changes; points in sparse cells are noise (-1).  ``dims`` is the
    caller's choice: all other directions are projected away.  No point pairs are ever formed: each dense
    cell emits its 3^dims neighbour keys.
    """
    from itertools import product

    from pyspark.ml.functions import vector_to_array

    from labeldist.operators.features import reduce
    from labeldist.session import written
    p = reduce(df, features, k=dims, out="_p").withColumn("_pa", vector_to_array("_p")).drop("_p")
    if eps is None:
        st = p.agg(*[F.stddev_pop(F.col("_pa")[i]).alias(f"s{i}") for i in range(dims)]).first()
        spread = max([v for v in st if v] or [1.0])
        eps = spread / 4.0
    cell = F.array(*[F.floor(F.col("_pa")[i] / F.lit(eps)).cast("long") for i in range(dims)])
    p = p.withColumn("_cell", cell).drop("_pa")
    dense = p.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_size).select("_cell")
    offsets = [list(o) for o in product((-1, 0, 1), repeat=dims) if any(o)]
    nb = F.array(*[F.array(*[F.col("_cell")[i] + F.lit(o[i]) for i in range(dims)]) for o in offsets])
    edges = (dense.select("_cell", F.explode(nb).alias("_nb"))
             .join(dense.select(F.col("_cell").alias("_nb")), "_nb"))
    label_of = F.xxhash64("_cell")
    labels = written(dense.select("_cell", label_of.alias("_lab")))
    while True:
        prop = edges.join(labels.select(F.col("_cell").alias("_nb"), "_lab"), "_nb").select("_cell", "_lab")
        new = labels.unionByName(prop).groupBy("_cell").agg(F.min("_lab").alias("_lab"))
        new = written(new)
        changed = new.join(labels.withColumnRenamed("_lab", "_old"), "_cell").filter(
            F.col("_lab") != F.col("_old")).limit(1).count()
        labels = new
        if changed == 0:
            break
    # dense regions concentrate points in few cells: split hot cells
    from labeldist.operators.skew import salted_join
    out = salted_join(p, labels, ["_cell"], "left")
    return out.withColumn("cluster", F.coalesce(F.col("_lab"), F.lit(NOISE).cast("long"))).drop("_cell", "_lab")


def _by_id(df: DataFrame, features: str, labels: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``labels`` of ``(id, x)`` joined to the rows; a row without features has none."""
    path = scratch_path(df.sparkSession, "rows")
    df.withColumn("_id", F.monotonically_increasing_id()).write.parquet(path)
    rows = df.sparkSession.read.parquet(path)
    points = rows.select(F.col("_id").alias("id"), as_array(rows, features).alias("x")).filter(F.col("x").isNotNull())
    found = labels(points).select(F.col("id").alias("_id"), "cluster")
    return rows.join(found, "_id", "left").select(*[F.col(f"`{c}`") for c in df.columns], "cluster")


def cluster(df: DataFrame, algo: str = "kmeans", k: int = 4, features: str = "features", seed: int = 42, **kw) -> DataFrame:
    """M5-M9: add a ``cluster`` column.

    ``kmeans`` is Spark ML's; ``gmm`` :mod:`labeldist.operators.mixture` in all dimensions (``gmm_dims``: on that many
    principal components); ``hierarchical`` (Ward) and ``spectral`` (``affinity``: ``rbf`` with ``gamma``, or ``neighbours``)
    work on :mod:`labeldist.operators.summary`, exact up to ``entries`` distinct rows; ``density`` is
    :func:`labeldist.operators.density.density_hierarchy` (``min_cluster_size``, ``min_samples``), ``grid``
    :func:`grid_density`.
    """
    if algo == "kmeans":
        return _kmeans(df, k, features, seed)[1]
    if algo == "gmm":
        from labeldist.operators.features import reduce
        dims = kw.pop("gmm_dims", None)
        src, col = (reduce(df, features, k=dims, out="_gmm_x"), "_gmm_x") if dims else (df, features)
        return mixture.assign(mixture.fit_mixture(src, col, k, seed, **kw), src, col).drop("_gmm_x")
    if algo in ("hierarchical", "spectral"):
        entries = kw.pop("entries", summary.ENTRIES)
        if k > entries:
            raise ValueError(f"k={k} clusters need at least as many entries of the summary (entries={entries})")
        e = summary.summarise(df, features, entries)
        k = min(k, len(e.n))
        label = summary.ward(e.centre, e.n, k) if algo == "hierarchical" else summary.spectral(
            summary.affinities(e.centre, e.n, **kw), e.n, k)
        return summary.through_leaders(df, e, label, features)
    if algo == "density":
        return _by_id(df, features, lambda points: density.density_hierarchy(points, **kw))
    if algo == "grid":
        return grid_density(df, features, **kw)
    raise ValueError(f"unknown clustering algorithm {algo!r}")
