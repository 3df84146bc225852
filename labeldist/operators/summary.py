"""Agglomeration (M8) and spectral clustering (M9) on a mergeable summary of the rows.

The summary is a table of entries: a leader row, the number and the sum of
the rows that it stands for, and a bound of their distance to the leader.  Every
row joins the first leader within a threshold or becomes one; when there are more than
``entries`` leaders, the threshold rises and leaders join each other.  Each task
summarises its rows, and summaries are merged in groups of tasks.  The threshold starts at
0, so a table of no more than ``entries`` distinct rows is clustered exactly as it is; beyond, rows
lie within the reported bound of the leader that decides for them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labeldist.operators.blocks import as_array
from labeldist.operators.neighbours import distances, nearest
from labeldist.session import written

ENTRIES = 1500       # leaders of a summary
FAN_IN = 16          # summaries that are merged in one task
CHUNK = 2000         # rows that are compared with the leaders at once
SUMMARY = "leader binary, n double, total binary, radius double, threshold double"


@dataclass
class Entries:
    """Leaders (m, d), rows and sums of rows they stand for, and the bound of the rows' distances to them."""
    leader: np.ndarray
    n: np.ndarray
    total: np.ndarray
    radius: np.ndarray
    threshold: float = 0.0

    @property
    def centre(self) -> np.ndarray:
        return self.total / self.n[:, None]

    def table(self) -> pd.DataFrame:
        return pd.DataFrame({"leader": [r.tobytes() for r in self.leader], "n": self.n, "total": [r.tobytes() for r in self.total],
                             "radius": self.radius, "threshold": self.threshold})

    @staticmethod
    def of(pdf: pd.DataFrame) -> Entries:
        pdf = pdf.sort_values(["leader", "n", "total"])      # one order, whatever order they come in
        def rows(c: str) -> np.ndarray:
            return np.frombuffer(b"".join(pdf[c]), float).reshape(len(pdf), -1)
        return Entries(rows("leader"), pdf["n"].to_numpy(), rows("total"), pdf["radius"].to_numpy(), float(pdf["threshold"].max()))


def joined(have: Entries | None, more: Entries, threshold: float) -> Entries:
    """``more`` joined to the leaders ``have`` within the threshold; the rest become leaders, in their order."""
    lists = [[], [], [], []] if have is None else [list(have.leader), list(have.n), list(have.total), list(have.radius)]
    for a in range(0, len(more.n), CHUNK):
        part = slice(a, a + CHUNK)
        x, n, total, radius = more.leader[part], more.n[part], more.total[part], more.radius[part]
        open_ = np.ones(len(x), bool)

        def take(i: int, rows: np.ndarray, away: np.ndarray) -> None:
            lists[1][i] += n[rows].sum()                                    # noqa: B023
            lists[2][i] = lists[2][i] + total[rows].sum(axis=0)             # noqa: B023
            lists[3][i] = max(lists[3][i], float((away + radius[rows]).max()))   # noqa: B023

        if lists[0]:
            near, least = nearest(x, np.array(lists[0]))
            open_ = least > threshold
            for i in np.unique(near[~open_]):
                rows = np.flatnonzero((near == i) & ~open_)
                take(i, rows, least[rows])
        while open_.any():
            j = int(open_.argmax())
            rows = np.flatnonzero(open_)
            away = distances(x[j:j + 1], x[rows])[0]
            rows, away = rows[away <= threshold], away[away <= threshold]
            lists[0].append(x[j])
            lists[1].append(0.0)
            lists[2].append(np.zeros(x.shape[1]))
            lists[3].append(0.0)
            take(len(lists[0]) - 1, rows, away)
            open_[rows] = False
    return Entries(*[np.array(v) for v in lists], threshold)


def shrunk(e: Entries, entries: int) -> Entries:
    """At most so many leaders: the threshold rises until they are few enough."""
    while len(e.n) > entries:
        away = distances(e.leader[:CHUNK], e.leader[:CHUNK])
        np.fill_diagonal(away, np.inf)
        threshold = max(1.5 * e.threshold, float(np.median(away.min(axis=1))))
        # heavy leaders first: they stay where they are
        order = np.argsort(-e.n, kind="stable")
        e = joined(None, Entries(e.leader[order], e.n[order], e.total[order], e.radius[order]), threshold)
    return e


def summarise(df: DataFrame, features: str = "features", entries: int = ENTRIES) -> Entries:
    """The summary of all rows with features; ``entries`` leaders at most come back to the driver."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = None
        for pdf in batches:
            x = pdf["x"].dropna()
            if not len(x):
                continue
            x, times = np.unique(np.stack(x.to_numpy()).astype(float), axis=0, return_counts=True)
            for a in range(0, len(x), CHUNK):
                part, n = x[a:a + CHUNK], times[a:a + CHUNK].astype(float)
                e = joined(e, Entries(part, n, part * n[:, None], np.zeros(len(part))), 0.0 if e is None else e.threshold)
                if len(e.n) > 2 * entries:
                    e = shrunk(e, entries)
        if e is not None:
            yield shrunk(e, entries).table()

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        e = Entries.of(pdf)
        threshold = e.threshold
        return shrunk(joined(None, e, threshold), entries).table()

    rows = written(df.select(as_array(df, features).alias("x")).mapInPandas(run, SUMMARY).withColumn("part", F.spark_partition_id()))
    parts = 1 + (rows.agg(F.max("part")).first()[0] or 0)
    while parts > 1:
        parts = -(-parts // FAN_IN)
        rows = rows.withColumn("part", F.pmod(F.col("part"), F.lit(parts))).groupBy("part").applyInPandas(
            lambda pdf: merge(pdf).assign(part=pdf["part"].iloc[0]), SUMMARY + ", part int")
    found = rows.drop("part").toPandas()
    if not len(found):
        raise ValueError("no rows with features to cluster")
    return Entries.of(found)


def ward(centre: np.ndarray, size: np.ndarray, k: int) -> np.ndarray:
    """Ward's agglomeration of weighted points to ``k`` groups, by chains of nearest neighbours."""
    n = len(size)
    c, s = centre.astype(float).copy(), size.astype(float).copy()
    alive, merges, chain = np.ones(n, bool), [], []
    for _ in range(n - 1):
        if not chain:
            chain = [int(alive.argmax())]
        while True:
            i = chain[-1]
            cost = np.where(alive, s * s[i] / (s + s[i]) * ((c - c[i]) ** 2).sum(axis=1), np.inf)
            cost[i] = np.inf
            j = int(cost.argmin())
            if len(chain) > 1 and cost[chain[-2]] <= cost[j]:
                j = chain[-2]
                break
            chain.append(j)
        chain = chain[:-2]
        merges.append((float(cost[j]), min(i, j), max(i, j)))
        i, j = min(i, j), max(i, j)
        c[i] = (c[i] * s[i] + c[j] * s[j]) / (s[i] + s[j])
        s[i] += s[j]
        alive[j] = False
    return _cut(n, merges, k)


def _cut(n: int, merges: list[tuple[float, int, int]], k: int) -> np.ndarray:
    """Labels after the ``n - k`` lowest merges, numbered by the first point of each group."""
    up = np.arange(n)

    def find(a: int) -> int:
        while up[a] != a:
            up[a] = a = up[up[a]]
        return a

    for _, i, j in sorted(merges, key=lambda m: m[0])[:max(0, n - k)]:
        a, b = sorted((find(i), find(j)))
        up[b] = a
    return np.unique([find(i) for i in range(n)], return_inverse=True)[1]


def affinities(centre: np.ndarray, size: np.ndarray, affinity: str = "rbf", gamma: float = 1.0, neighbours: int = 10) -> np.ndarray:
    """Weights of the graph: ``rbf`` exp(-gamma d^2), or ``neighbours``: 1 between a point and its nearest, halved if only one
    side sees it so.  Points count by their size."""
    d = distances(centre, centre)
    if affinity == "rbf":
        w = np.exp(-gamma * d * d)
    elif affinity == "neighbours":
        w = np.zeros_like(d)
        near = np.argsort(d, axis=1, kind="stable")[:, 1:neighbours + 1]
        w[np.arange(len(d))[:, None], near] = 1.0
        w = (w + w.T) / 2
    else:
        raise ValueError(f"unknown affinity {affinity!r}")
    np.fill_diagonal(w, 0.0)
    return w * np.sqrt(np.outer(size, size))


def spectral(w: np.ndarray, size: np.ndarray, k: int) -> np.ndarray:
    """Groups of a graph's points: the first ``k`` eigenvectors of the normalised Laplacian, rows of unit length, k-means
    from points far from each other."""
    degree = w.sum(axis=1)
    inv = 1.0 / np.sqrt(np.where(degree > 0, degree, 1.0))
    _, vec = np.linalg.eigh(np.eye(len(w)) - inv[:, None] * w * inv[None, :])
    u = vec[:, :k]
    u = u / np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-12)
    start = [int(np.argmax(size))]
    for _ in range(1, k):
        start.append(int(distances(u, u[start]).min(axis=1).argmax()))
    centre, label = u[start], np.full(len(u), -1)
    for _ in range(100):
        new = distances(u, centre).argmin(axis=1)
        if (new == label).all():
            break
        label = new
        for g in range(k):
            if (label == g).any():
                centre[g] = np.average(u[label == g], axis=0, weights=size[label == g])
    return np.unique(label, return_inverse=True)[1]


def through_leaders(df: DataFrame, e: Entries, label: np.ndarray, features: str = "features", out: str = "cluster") -> DataFrame:
    """Every row's label is that of its nearest leader (NULL features: none)."""
    leader, label = e.leader, label.astype(np.int32)

    def run(xs: pd.Series) -> pd.Series:
        known = xs.notna().to_numpy()
        labels = pd.Series(np.full(len(xs), None, object))
        if known.any():
            labels[known] = label[nearest(np.stack(xs[known].to_numpy()).astype(float), leader)[0]]
        return labels.astype("Int32")

    return df.withColumn(out, F.pandas_udf(run, "int")(as_array(df, features)))
