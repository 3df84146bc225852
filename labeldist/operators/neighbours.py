"""Exact nearest neighbours of all rows, in blocks.

Rows go to the nearest of a bounded number of sampled pivots (cells with a
centre and a radius), and cells are laid into parts of bounded size, a hot
cell into several.  Every row first meets its own part, which gives it a
distance to beat; after that only those parts are met that hold a cell near
enough for one of the rows, and within a task only such cells are compared.
Products of whole blocks find the pairs that may be close enough (with room for
rounding); only their distances are taken from differences.  Distances never
leave a task but for the nearest ones of each row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labeldist.session import written

MAX_PIVOTS = 4096
PIVOT_CELLS = 1 << 22      # values of all pivots together
ROWS_PER_CELL = 200
PART_BYTES = 16_000_000
PARTS, PART_ROWS = 24, 1000    # smaller tables are cut into so many parts, of so many rows at least
TOGETHER_BYTES = 32_000_000    # parts that a part meets in one task
COMPARED = 4_000_000       # distances held at once
TILE = (256, 4096)         # rows and targets of a product
LAST_ID = np.iinfo(np.int64).max
ROW = "id long, x binary, cell int, far double, part int"


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows, from differences (products would lose the small ones)."""
    out = np.empty((len(a), len(b)))
    step = max(1, COMPARED // max(1, len(b) * a.shape[1]))
    for i in range(0, len(a), step):
        d = a[i:i + step, None, :] - b[None, :, :]
        out[i:i + step] = np.sqrt(np.einsum("ijk,ijk->ij", d, d))
    return out


def nearest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``a`` the place of its nearest row of ``b`` (by products: rounding decides between equals), and the
    distance to that row."""
    place, square = np.empty(len(a), np.int64), (b * b).sum(axis=1)
    step = max(1, COMPARED // max(1, len(b)))
    for i in range(0, len(a), step):
        place[i:i + step] = (square - 2 * a[i:i + step] @ b.T).argmin(axis=1)
    d = a - b[place]
    return place, np.sqrt(np.einsum("ij,ij->i", d, d))


def matrix(column: pd.Series, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), float).reshape(-1, d)


class Targets:
    """Rows that many others are compared with."""

    def __init__(self, x: np.ndarray):
        self.x, self.middle = x, np.median(x, axis=0)
        moved = x - self.middle
        self.square = np.einsum("ij,ij->i", moved, moved)
        self.rounding = 4 * (x.shape[1] + 8) * np.finfo(float).eps
        # a row times this is its product with the target, less half the target's square, and never less than it would be exactly
        self.right = np.vstack([moved.T, -self.square * (0.5 - self.rounding)])

    def close(self, q: np.ndarray, reach: np.ndarray, use: np.ndarray, wanted: Callable[[np.ndarray, np.ndarray], np.ndarray],
              k: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places in ``q`` and here, and distances, of all pairs at most ``reach`` of the row apart, of targets in ``use`` (a
        mask) and ``wanted``.  ``reach`` may be lowered meanwhile.  With ``k``, a row of infinite reach gets those that
        may be among its ``k`` nearest (its own one not counted) of some targets."""
        d, at, rows = q.shape[1], np.flatnonzero(use), np.arange(len(q))
        moved = q - self.middle
        square = np.einsum("ij,ij->i", moved, moved)
        left = np.hstack([moved, np.ones((len(q), 1))])
        line = -moved.mean(axis=0)
        length = np.sqrt(line @ line)
        if length > 0 and np.isfinite(reach).all() and len(at):
            # no two rows are nearer than their places on a line are
            mine, theirs = moved @ (line / length), (line / length) @ self.right[:-1]
            room = self.rounding * (np.sqrt(square.max()) + np.sqrt(self.square.max()) + reach.max())
            at = at[(theirs[at] >= (mine - reach).min() - room) & (theirs[at] <= (mine + reach).max() + room)]
            if len(at):
                rows = np.flatnonzero((mine + reach >= theirs[at].min() - room) & (mine - reach <= theirs[at].max() + room))
        for b in range(0, len(at), TILE[1]):
            some = at[b:b + TILE[1]]
            right = self.right[:, some[0]:some[-1] + 1] if some[-1] - some[0] + 1 == len(some) else self.right[:, some]
            for a in range(0, len(rows), TILE[0]):
                of = rows[a:a + TILE[0]]
                least = (square[of] - reach[of] ** 2) / 2 - self.rounding * square[of]
                product = left[of] @ right
                if k and len(some) > k and (free := np.flatnonzero(np.isinf(reach[of]))).size:
                    top = np.argpartition(product[free], len(some) - k - 1, axis=1)[:, len(some) - k - 1:]
                    room = 2 * self.rounding * (square[of[free]][:, None] + self.square[some[top]])
                    least[free] = (np.take_along_axis(product[free], top, axis=1) - room).min(axis=1) - self.rounding * square[of[free]]
                i, j = np.divmod(np.flatnonzero(product >= least[:, None]), len(some))
                i, j = of[i], some[j]
                keep = wanted(i, j)
                i, j = i[keep], j[keep]
                step = max(1, COMPARED // d)
                for s in range(0, len(i), step):
                    m, n = i[s:s + step], j[s:s + step]
                    diff = q[m] - self.x[n]
                    far = np.sqrt(np.einsum("ij,ij->i", diff, diff))
                    keep = far <= reach[m]
                    if keep.any():
                        yield m[keep], n[keep], far[keep]


@dataclass
class Cells:
    """Rows (``ROW``) in cells; per cell its pivot, radius and part (a hot cell has more parts than one)."""
    rows: DataFrame
    d: int
    centre: np.ndarray
    radius: np.ndarray
    parts: dict[int, list[int]]      # part -> its cells
    pivot: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))     # ids of the pivots
    part_rows: int = 1

    def near(self, cells: list[int], reach: np.ndarray) -> list[int]:
        """Parts with a cell that may hold a row within ``reach[i]`` of a row of ``cells[i]``."""
        gap = distances(self.centre[cells], self.centre) - self.radius[cells][:, None] - self.radius
        close = (gap <= reach[:, None] * (1 + 1e-9) + 1e-12).any(axis=0)
        return [p for p, of in self.parts.items() if close[of].any()]


def in_cells(points: DataFrame, rows_per_cell: int = ROWS_PER_CELL, part_bytes: int = PART_BYTES) -> Cells:
    """``points``: ``id`` (unique) and ``x`` (array of doubles of one length, without nulls)."""
    n, d = points.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    if not n:
        raise ValueError("no rows")
    wanted = int(max(1, min(MAX_PIVOTS, PIVOT_CELLS // max(d, 1), n // rows_per_cell)))
    # a bounded sample in order of a hash of the ids
    pivots = points.select("id", "x").orderBy(F.xxhash64("id"), "id").limit(wanted).collect()
    centre = np.array([p.x for p in pivots], float).reshape(len(pivots), d)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["x"].to_numpy()).astype(float)
            cell, far = nearest(x, centre)
            yield pd.DataFrame({"id": pdf["id"], "x": [r.tobytes() for r in x], "cell": cell.astype(np.int32), "far": far})

    rows = written(points.select("id", "x").mapInPandas(assign, "id long, x binary, cell int, far double"))
    stats = rows.groupBy("cell").agg(F.max("far").alias("radius"), F.count(F.lit(1)).alias("n")).collect()    # one row a pivot
    radius, size = np.zeros(len(centre)), np.zeros(len(centre), np.int64)
    for s in stats:
        radius[s.cell], size[s.cell] = s.radius, s.n
    # neighbouring cells share a part; a cell larger than a part is cut by a hash of the ids
    limit = max(1, min(part_bytes // (8 * d), max(PART_ROWS, -(-n // PARTS))))
    order, left = [0], set(range(1, len(centre)))
    while left:
        rest = np.array(sorted(left))
        order.append(int(rest[distances(centre[order[-1:]], centre[rest])[0].argmin()]))
        left.remove(order[-1])
    parts, first, cuts, room, part = {}, np.zeros(len(centre), int), np.ones(len(centre), int), 0, -1
    for c in order:
        if not size[c]:
            continue
        if size[c] > room:
            part, room = part + 1, limit
            parts[part] = []
        cuts[c] = -(-size[c] // limit)
        first[c] = part
        parts[part].append(c)
        for _ in range(cuts[c] - 1):
            part += 1
            parts[part] = [c]
        room = room - size[c] if cuts[c] == 1 else 0
    place = points.sparkSession.createDataFrame(
        [(c, int(first[c]), int(cuts[c])) for c in range(len(centre)) if size[c]], "cell int, first int, cuts int")
    rows = rows.join(F.broadcast(place), "cell").select(
        "id", "x", "cell", "far", (F.col("first") + F.pmod(F.xxhash64("id", F.lit(1)), F.col("cuts"))).cast("int").alias("part"))
    return Cells(written(rows), int(d), centre, radius, parts, np.array([p.id for p in pivots], np.int64), limit)


def meet(cells: Cells, queries: DataFrame, targets: DataFrame, pairs: list[tuple[int, int]],
         compare: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``compare`` of the queries of part ``a`` with the targets of parts ``b``, for every pair (a, b): as many parts at a
    time as ``TOGETHER_BYTES`` hold (column ``g`` numbers these meetings)."""
    together, met, rows = max(1, TOGETHER_BYTES // (8 * cells.d * cells.part_rows)), {}, []
    for a, b in pairs:
        met[a] = met.get(a, -1) + 1
        rows.append((a, b, met[a] // together))
    table = cells.rows.sparkSession.createDataFrame(rows or [(-1, -1, 0)], "a int, b int, g int")
    # new names for all columns: both sides may come from one frame
    q = queries.select(*[F.col(c).alias("a" if c == "part" else c) for c in queries.columns]).join(
        F.broadcast(table.select("a", "g").distinct()), "a")
    t = targets.select(*[F.col(c).alias("b" if c == "part" else c) for c in targets.columns]).join(F.broadcast(table), "b")
    q, t = (x.select(*[F.col(c).alias(c) for c in x.columns]) for x in (q, t))
    return q.groupBy("a", "g").cogroup(t.groupBy("a", "g")).applyInPandas(compare, schema)


def by_part(t: pd.DataFrame, d: int) -> list[tuple[Targets, pd.DataFrame]]:
    """The targets of a meeting, part by part and in order of their cells."""
    return [(Targets(matrix(of["x"], d)), of.drop(columns="x")) for _, of in t.sort_values(["b", "cell", "id"]).groupby("b")]


def reach_of(cells: Cells, queries: DataFrame, column: str) -> dict[int, tuple[list[int], np.ndarray]]:
    """For each part the cells of its queries and how far the farthest-reaching query of each looks (null: everywhere)."""
    out: dict[int, tuple[list[int], list[float]]] = {}
    for r in queries.groupBy("part", "cell").agg(F.max(F.coalesce(column, F.lit(float("inf")))).alias("reach")).collect():
        of, reach = out.setdefault(r.part, ([], []))
        of.append(r.cell)
        reach.append(r.reach)
    return {p: (of, np.array(reach)) for p, (of, reach) in out.items()}


def k_nearest(cells: Cells, k: int) -> DataFrame:
    """``id`` and ``near``: the ``k`` nearest other rows of every row (struct of distance and id; ties to the smaller id)."""
    d, centre, radius = cells.d, cells.centre, cells.radius

    def compare(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))]
        parts = [(targets, of["id"].to_numpy(), of["cell"].to_numpy()) for targets, of in by_part(t, d)] if len(q) and len(t) else []
        for c, of in q.groupby("cell"):
            x, own = matrix(of["x"], d), of["id"].to_numpy()
            reach = of["reach"].to_numpy(copy=True) if "reach" in of else np.full(len(of), np.inf)
            best, name = np.full((len(of), k), np.inf), np.full((len(of), k), LAST_ID)
            gap = np.linalg.norm(centre - centre[c], axis=1) - radius - radius[c]
            for targets, ids, cell in parts:
                use = gap[cell] <= reach.max() * (1 + 1e-9) + 1e-12
                for i, j, far in targets.close(x, reach, use, lambda i, j, ids=ids: own[i] != ids[j], k):
                    rows = np.unique(i)
                    row, distance, other = (np.concatenate(v) for v in (
                        (np.repeat(rows, k), i), (best[rows].ravel(), far), (name[rows].ravel(), ids[j])))
                    order = np.lexsort((other, distance, row))
                    row, first = row[order], np.searchsorted(row[order], rows)
                    of_row = np.diff(np.append(first, len(row)))
                    order = order[np.arange(len(row)) - np.repeat(first, of_row) < k]
                    best[rows], name[rows] = distance[order].reshape(-1, k), other[order].reshape(-1, k)
                    reach[rows] = np.minimum(reach[rows], best[rows, k - 1])
            row, rank = np.nonzero(np.isfinite(best))
            found.append((own[row], best[row, rank], name[row, rank]))
        return pd.DataFrame({c: np.concatenate([f[i] for f in found]) for i, c in enumerate(("id", "distance", "other"))})

    schema = "id long, distance double, other long"

    def lists(rows: DataFrame) -> DataFrame:
        near = F.array_sort(F.collect_list(F.struct("distance", F.col("other").alias("id"))))
        return rows.groupBy("id").agg(F.slice(near, 1, k).alias("near"))

    own = written(meet(cells, cells.rows, cells.rows, [(p, p) for p in cells.parts], compare, schema))
    reach = cells.rows.join(lists(own).filter(F.size("near") >= k).select("id", F.col("near")[k - 1]["distance"].alias("reach")), "id", "left")
    reach = written(reach.withColumn("reach", F.coalesce("reach", F.lit(float("inf")))))
    pairs = [(p, b) for p, (of, r) in reach_of(cells, reach, "reach").items() for b in cells.near(of, r) if b != p]
    return lists(own.union(meet(cells, reach, cells.rows, pairs, compare, schema)) if pairs else own)
