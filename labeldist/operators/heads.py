"""Soft-label classifiers per taxonomy level (M11-M17), all heads trained together.

A soft label is a distribution over the senses of a level.  One network holds
the heads of all levels: a linear hidden layer over the features, and for each
level a linear layer on

* ``flat``: the hidden layer;
* ``chain``: the hidden layer and the probabilities of all levels above;
* ``gated``: a weighted sum of the hidden layer and a projection (two layers
  with GELU) of the scores of each level above.  The weights are learned: a
  sigmoid gate with one level above, softmax gates with more.

The loss is the sum of the levels' losses, and its gradient runs through the
levels above.  Rows are packed once into blocks in the shared folder; each step
of L-BFGS is one Spark job in which every task sums loss and gradient over its
blocks, so one row of the size of the parameters comes back, never a row of the
data.  Fits that differ in their starting points take their steps side by side.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Generator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labeldist import taxonomy as tx
from labeldist.operators.blocks import BLOCK_CELLS, as_rows, dense_parts, pack, summed
from labeldist.session import text_batches

LOSSES = ("cross-entropy", "l2", "smooth-l1", "l1")
ARCHS = ("flat", "chain", "gated")
# --- fixed values: starting points of the gates (before sigmoid / softmax) ---
GATE_TWO = 0.5                      # level above against hidden layer
GATES_MORE = (0.25, 0.5)            # each level above, hidden layer
# ------------------------------------------------------------------------------
TOGETHER = 1 << 21       # parameters of the fits that go side by side
CACHED = 1 << 10         # rows of a block that are worked on at a time
HIDDEN = 64              # units of the hidden layer (fewer features: as many as they are)
GELU = np.sqrt(2 / np.pi)


# --- network ----------------------------------------------------------------

def _gelu(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """GELU (by tanh) and its slope."""
    square = x * x
    half = square * (GELU * 0.044715)
    half += GELU
    half *= x
    np.tanh(half, out=half)
    half += 1
    half *= 0.5                     # (1 + tanh) / 2
    square *= GELU * 0.134145
    square += GELU
    square *= x
    square *= 2 * half * (1 - half)
    square += half
    return x * half, square


def _softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _through_softmax(p: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Slope by the scores from the slope by the probabilities."""
    return p * (g - (g * p).sum(axis=1, keepdims=True))


@dataclass
class Net:
    """Shapes of the parameters, and the network's scores and gradients for a block of rows."""
    arch: str
    loss: str
    levels: list[int]
    n_features: int
    hidden: int
    learn_gates: bool = True
    share: list[float] = field(default_factory=list)
    sizes: dict[int, int] = field(default_factory=lambda: dict(tx.LEVEL_SIZES))

    def shapes(self) -> dict[str, tuple[int, ...]]:
        h, mid = self.hidden, max(1, self.hidden // 2)
        out: dict[str, tuple[int, ...]] = {"w": (self.n_features, h), "w_0": (h,)}
        for i, lv in enumerate(self.levels):
            n = self.sizes[lv]
            extra = sum(self.sizes[u] for u in self.levels[:i]) if self.arch == "chain" else 0
            out |= {f"head{lv}": (h + extra, n), f"head{lv}_0": (n,)}
            if self.arch == "gated":
                if lv != self.levels[-1]:
                    out |= {f"up{lv}": (n, mid), f"up{lv}_0": (mid,), f"wide{lv}": (mid, h), f"wide{lv}_0": (h,)}
                if i:
                    out[f"gate{lv}"] = (1,) if i == 1 else (i + 1,)
        return out

    def split(self, theta: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, shape in self.shapes().items():
            n = int(np.prod(shape))
            out[name] = theta[at:at + n].reshape(shape)
            at += n
        return out

    def start(self, seed: int, gates: Mapping[int, Sequence[float]]) -> np.ndarray:
        rng = np.random.default_rng(seed)
        parts = []
        for name, shape in self.shapes().items():
            if name.startswith("gate"):
                parts.append(np.array(gates.get(int(name[4:])) or (
                    [GATE_TWO] if shape == (1,) else [GATES_MORE[0]] * (shape[0] - 1) + [GATES_MORE[1]]), float))
            else:
                parts.append(np.zeros(shape) if name.endswith("_0") else rng.normal(0, shape[0] ** -0.5, shape))
        return np.concatenate([p.ravel() for p in parts])

    def weights(self, i: int, gate: np.ndarray) -> np.ndarray:
        """Weight of each level above, then that of the hidden layer."""
        if i == 1:
            a = 1 / (1 + np.exp(-gate[0]))
            return np.array([a, 1 - a])
        e = np.exp(gate - gate.max())
        return e / e.sum()

    def forward(self, p: dict[str, np.ndarray], x: np.ndarray) -> dict[str, np.ndarray]:
        """Scores of all levels (``s1`` ...) and what the gradient needs."""
        v = {"h": x @ p["w"] + p["w_0"]}
        for i, lv in enumerate(self.levels):
            if self.arch == "chain":
                v[f"in{lv}"] = np.hstack([v["h"], *[v[f"p{u}"] for u in self.levels[:i]]])
            elif self.arch == "gated" and i:
                g = self.weights(i, p[f"gate{lv}"])
                v[f"in{lv}"] = g[-1] * v["h"] + sum(w * v[f"z{u}"] for w, u in zip(g, self.levels[:i], strict=False))
            else:
                v[f"in{lv}"] = v["h"]
            s = v[f"s{lv}"] = v[f"in{lv}"] @ p[f"head{lv}"] + p[f"head{lv}_0"]
            if lv == self.levels[-1]:
                break
            if self.arch == "chain":
                v[f"p{lv}"] = _softmax(s)
            elif self.arch == "gated":
                v[f"a{lv}"], v[f"da{lv}"] = _gelu(s @ p[f"up{lv}"] + p[f"up{lv}_0"])
                v[f"z{lv}"], v[f"dz{lv}"] = _gelu(v[f"a{lv}"] @ p[f"wide{lv}"] + p[f"wide{lv}_0"])
        return v

    def level_loss(self, s: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
        """Summed loss of the rows and its slope by the scores.  Squared, absolute and smooth absolute loss compare
        the scores themselves with the labels, averaged over a level's senses."""
        if self.loss == "cross-entropy":
            s = s - s.max(axis=1, keepdims=True)
            e = np.exp(s)
            total, mass = e.sum(axis=1, keepdims=True), y.sum(axis=1, keepdims=True)
            return float((np.log(total) * mass).sum() - np.vdot(y, s)), e * (mass / total) - y
        d, n = s - y, s.shape[1]
        if self.loss == "l2":
            return float((d * d).sum() / n), 2 * d / n
        if self.loss == "l1":
            return float(np.abs(d).sum() / n), np.sign(d) / n
        near = np.abs(d) < 1
        return float(np.where(near, 0.5 * d * d, np.abs(d) - 0.5).sum() / n), np.where(near, d, np.sign(d)) / n

    def gradient(self, theta: np.ndarray, x: np.ndarray, labels: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Summed loss of each level and the gradient of their sum.  A row of NaN in a level's labels has no label there."""
        p = self.split(theta)
        v = self.forward(p, x)
        flat = np.zeros_like(theta)
        g = self.split(flat)
        losses = np.zeros(len(self.levels))
        to_h, to_s = np.zeros_like(v["h"]), {lv: 0.0 for lv in self.levels}
        to_z = {lv: 0.0 for lv in self.levels}
        for i in range(len(self.levels) - 1, -1, -1):
            lv = self.levels[i]
            known = ~np.isnan(labels[lv]).any(axis=1)
            if known.all():
                losses[i], own = self.level_loss(v[f"s{lv}"], labels[lv])
            else:
                own = self.level_loss(v[f"s{lv}"], np.where(known[:, None], labels[lv], 0.0))[1]
                losses[i] = self.level_loss(v[f"s{lv}"][known], labels[lv][known])[0]
                own = own * known[:, None]
            if self.share:
                losses[i], own = losses[i] * self.share[i], own * self.share[i]
            if self.arch == "gated" and lv != self.levels[-1]:
                t = to_z[lv] * v[f"dz{lv}"]
                g[f"wide{lv}"] += v[f"a{lv}"].T @ t
                g[f"wide{lv}_0"] += t.sum(axis=0)
                t = t @ p[f"wide{lv}"].T * v[f"da{lv}"]
                g[f"up{lv}"] += v[f"s{lv}"].T @ t
                g[f"up{lv}_0"] += t.sum(axis=0)
                own = own + t @ p[f"up{lv}"].T
            own = own + to_s[lv]
            g[f"head{lv}"] += v[f"in{lv}"].T @ own
            g[f"head{lv}_0"] += own.sum(axis=0)
            t = own @ p[f"head{lv}"].T
            above = self.levels[:i]
            if self.arch == "chain":
                to_h += t[:, :self.hidden]
                at = self.hidden
                for u in above:
                    to_s[u] = to_s[u] + _through_softmax(v[f"p{u}"], t[:, at:at + self.sizes[u]])
                    at += self.sizes[u]
            elif self.arch == "gated" and i:
                w = self.weights(i, p[f"gate{lv}"])
                by_weight = np.array([float(np.vdot(t, z)) for z in [*[v[f"z{u}"] for u in above], v["h"]]])
                if self.learn_gates:
                    g[f"gate{lv}"] += (w[0] * w[1] * (by_weight[0] - by_weight[1]) if i == 1
                                       else w * (by_weight - (w * by_weight).sum()))
                to_h += w[-1] * t
                for k, u in enumerate(above):
                    to_z[u] = to_z[u] + w[k] * t
            else:
                to_h += t
        g["w"] += x.T @ to_h
        g["w_0"] += to_h.sum(axis=0)
        return losses, flat


# --- steps ----------------------------------------------------------------------

def descent(theta: np.ndarray, max_iter: int, tol: float,
            memory: int = 10) -> Generator[np.ndarray, tuple[float, np.ndarray], tuple[np.ndarray, list[float]]]:
    """L-BFGS: yields the points whose loss and gradient it is to be sent, and returns what :func:`lbfgs` returns."""
    loss, g = yield theta
    history, pairs, step = [loss], [], 1.0 / max(1.0, float(np.linalg.norm(g)))
    for _ in range(max_iter):
        q, scales = g.copy(), []
        for s, y, r in reversed(pairs):
            a = r * (s @ q)
            scales.append(a)
            q -= a * y
        if pairs:
            q *= (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1])
        for (s, y, r), a in zip(pairs, reversed(scales), strict=True):
            q += (a - r * (y @ q)) * s
        slope, t = float(g @ q), 1.0 if pairs else step
        if slope <= 0:
            pairs = []
            q, slope, t = g, float(g @ g), step
        while True:
            new, new_g = yield theta - t * q
            if np.isfinite(new) and new <= loss - 1e-4 * t * slope:
                break
            t /= 3
            if t * np.abs(q).max() < 1e-10:
                break
        if not np.isfinite(new) or new >= loss:
            if not pairs:
                break
            pairs = []      # try the plain slope once more
            continue
        s, y = -t * q, new_g - g
        if s @ y > 1e-12:
            pairs = [*pairs, (s, y, 1.0 / (s @ y))][-memory:]
        done = loss - new <= tol * max(abs(loss), 1.0)
        theta, loss, g = theta + s, new, new_g
        history.append(loss)
        if done:
            break
    return theta, history


def lbfgs_all(values: Callable[[list[np.ndarray]], list[tuple[float, np.ndarray]]], starts: Sequence[np.ndarray], max_iter: int,
              tol: float, memory: int = 10) -> list[tuple[np.ndarray, list[float]]]:
    """:func:`lbfgs` from every starting point, each as if it were alone; ``values`` measures the points of all that go on."""
    runs = [descent(theta, max_iter, tol, memory) for theta in starts]
    points, found = {i: next(run) for i, run in enumerate(runs)}, {}
    while points:
        for i, measured in zip(list(points), values(list(points.values())), strict=True):
            try:
                points[i] = runs[i].send(measured)
            except StopIteration as end:
                found[i] = end.value
                del points[i]
    return [found[i] for i in range(len(runs))]


def lbfgs(value: Callable[[np.ndarray], tuple[float, np.ndarray]], theta: np.ndarray, max_iter: int, tol: float,
          memory: int = 10) -> tuple[np.ndarray, list[float]]:
    """The lowest point found and the loss after every step; the loss never rises."""
    return lbfgs_all(lambda points: [value(p) for p in points], [theta], max_iter, tol, memory)[0]


# --- fitting, scoring, storing --------------------------------------------------

@dataclass
class HeadsModel:
    """A fitted network.  ``history``: loss after every step."""
    net: Net
    features: str
    theta: np.ndarray
    scale: np.ndarray
    history: list[float] = field(default_factory=list)

    arch = property(lambda self: self.net.arch)
    loss = property(lambda self: self.net.loss)
    levels = property(lambda self: self.net.levels)

    @property
    def gates(self) -> dict[int, list[float]]:
        """For each gated level the weights of the levels above and of the hidden layer."""
        p = self.net.split(self.theta)
        return {lv: self.net.weights(i, p[f"gate{lv}"]).tolist() for i, lv in enumerate(self.levels) if f"gate{lv}" in p}

    def transform(self, df: DataFrame) -> DataFrame:
        return score(self, df)


def packed(df: DataFrame, features: str, labels: Mapping[int, str] | None, levels: Sequence[int]) -> DataFrame:
    """Blocks of the rows with their labels of all levels."""
    labels = labels or {lv: f"dist_l{lv}" for lv in (1, 2, 3)}
    return pack(df, features, [labels[lv] for lv in levels], [tx.LEVEL_SIZES[lv] for lv in levels])


def fit_heads(df: DataFrame, features: str = "features", labels: Mapping[int, str] | None = None, arch: str = "flat",
              levels: Sequence[int] = (1, 2, 3), loss: str = "cross-entropy", max_iter: int = 100, reg: float = 1e-4,
              seed: int = 42, hidden: int = HIDDEN, gates: Mapping[int, Sequence[float]] | None = None,
              learn_gates: bool = True, tol: float = 1e-5) -> HeadsModel:
    """Fit the heads of all ``levels`` together (M14 = a single level).

    ``labels`` maps level -> soft-label array column (default ``dist_l1/l2/l3``); a row whose label of a level is NULL or
    partial is not trained on at that level.  ``gates``: starting points of the gates by level; with ``learn_gates=False``
    they stay.  ``seed`` gives the starting weights.  Features are scaled by their root mean square; ``reg`` is the weight
    of the squared weights (not of gates and constants)."""
    if arch not in ARCHS:
        raise ValueError(f"arch must be one of {ARCHS}")
    if loss not in LOSSES:
        raise ValueError(f"loss must be one of {LOSSES}")
    levels = sorted(levels)
    blocks = packed(df, features, labels, levels)
    return fit_blocks(blocks, features, arch, levels, loss, max_iter, reg, seed, hidden, gates, learn_gates, tol)


def _objective(blocks: DataFrame, arch: str, levels: Sequence[int], loss: str, reg: float, hidden: int,
               learn_gates: bool) -> tuple[Net, np.ndarray, Callable[[list[np.ndarray]], list[tuple[float, np.ndarray]]]]:
    """The network, the scale of the features, and loss and gradient at given points (all from one pass over the blocks)."""
    first = blocks.select("d").first()
    if first is None:
        raise ValueError("no rows with features to train on")
    d = first.d
    net = Net(arch, loss, list(levels), d, min(hidden, d), learn_gates)
    edge = np.cumsum([0, *[net.sizes[lv] for lv in net.levels]])

    def by_level(y: np.ndarray) -> dict[int, np.ndarray]:
        return {lv: y[:, a:b] for lv, a, b in zip(net.levels, edge[:-1], edge[1:], strict=True)}

    def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.concatenate([[len(x)], (x * x).sum(axis=0), [float((~np.isnan(v).any(axis=1)).sum()) for v in by_level(y).values()]])

    k = len(net.levels)
    sums = summed(blocks, squares, 1 + d + k)
    n_rows, mean_square, labelled = sums[0], sums[1:d + 1] / sums[0], np.maximum(sums[d + 1:], 1)
    scale = np.where(mean_square > 0, 1 / np.sqrt(np.maximum(mean_square, 1e-300)), 0.0)
    weighed = np.concatenate([np.full(int(np.prod(s)), 0.0 if name.endswith("_0") or name.startswith("gate") else 1.0)
                              for name, s in net.shapes().items()])
    net.share = (n_rows / labelled).tolist()      # each level is averaged over its own labels

    def values(points: list[np.ndarray]) -> list[tuple[float, np.ndarray]]:
        def gradients(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            total = 0.0
            for a in range(0, len(x), CACHED):
                some, labels = x[a:a + CACHED] * scale, by_level(y[a:a + CACHED])
                total = total + np.concatenate([g for theta in points for g in net.gradient(theta, some, labels)])
            return total

        total = summed(blocks, gradients, len(points) * (k + len(weighed))).reshape(len(points), -1) / n_rows
        return [(float(t[:k].sum()) + 0.5 * reg * float((weighed * theta * theta).sum()), t[k:] + reg * weighed * theta)
                for t, theta in zip(total, points, strict=True)]

    return net, scale, values


def fit_blocks(blocks: DataFrame, features: str, arch: str, levels: Sequence[int], loss: str = "cross-entropy",
               max_iter: int = 100, reg: float = 1e-4, seed: int = 42, hidden: int = HIDDEN,
               gates: Mapping[int, Sequence[float]] | None = None, learn_gates: bool = True, tol: float = 1e-5) -> HeadsModel:
    """:func:`fit_heads` on rows that :func:`packed` has packed already."""
    net, scale, values = _objective(blocks, arch, levels, loss, reg, hidden, learn_gates)
    theta, history = lbfgs(lambda point: values([point])[0], net.start(seed, gates or {}), max_iter, tol)
    return HeadsModel(net, features, theta, scale, history)


def fit_starts(blocks: DataFrame, features: str, arch: str, levels: Sequence[int], gates: Sequence[Mapping[int, Sequence[float]]],
               loss: str = "cross-entropy", max_iter: int = 100, reg: float = 1e-4, seed: int = 42, hidden: int = HIDDEN,
               learn_gates: bool = True, tol: float = 1e-5) -> list[HeadsModel]:
    """:func:`fit_blocks` for each of ``gates``; a step of all these fits is one pass over the blocks (of as many fits at a
    time as have ``TOGETHER`` parameters)."""
    net, scale, values = _objective(blocks, arch, levels, loss, reg, hidden, learn_gates)
    starts = [net.start(seed, g) for g in gates]
    width = max(1, TOGETHER // max(map(len, starts), default=1))
    return [HeadsModel(net, features, theta, scale, history) for a in range(0, len(starts), width)
            for theta, history in lbfgs_all(values, starts[a:a + width], max_iter, tol)]


def score(model: HeadsModel, df: DataFrame) -> DataFrame:
    """Add raw score arrays ``scores_l<level>`` (map-only, no shuffle); NULL features give NULL scores."""
    net, theta, scale = model.net, model.theta, model.scale
    text_batches(df.sparkSession)

    def run(xs: pa.Array) -> pa.Array:
        known = xs.is_valid()
        p, found = net.split(theta), {lv: [np.zeros(0)] for lv in net.levels}
        for x in dense_parts(xs.filter(known), BLOCK_CELLS):
            v = net.forward(p, x * scale)
            for lv in net.levels:
                found[lv].append(v[f"s{lv}"].ravel())
        known = known.to_numpy(zero_copy_only=False)
        first = np.concatenate([[0], np.cumsum(known)])
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(
            pa.array((first * net.sizes[lv]).astype(np.int32)), pa.array(np.concatenate(found[lv])), mask=pa.array(~known)) for lv in net.levels],
            names=[f"scores_l{lv}" for lv in net.levels])

    kind = ", ".join(f"scores_l{lv} array<double>" for lv in net.levels)
    added = df.withColumn("_scores", F.arrow_udf(run, f"struct<{kind}>")(as_rows(df, model.features)))
    return added.select(*[F.col(f"`{c}`") for c in df.columns if not c.startswith("scores_l")],
                        *[F.col(f"_scores.scores_l{lv}").alias(f"scores_l{lv}") for lv in net.levels])


def save_model(model: HeadsModel, path: str) -> None:
    """Persist the parameters and the configuration under ``path``."""
    net = model.net
    meta = json.dumps({"arch": net.arch, "loss": net.loss, "levels": net.levels, "features": model.features,
                       "n_features": net.n_features, "hidden": net.hidden, "history": model.history})
    s = SparkSession.getActiveSession()
    s.createDataFrame([(meta, model.theta.tolist(), model.scale.tolist())], "meta STRING, theta ARRAY<DOUBLE>, scale ARRAY<DOUBLE>"
                      ).coalesce(1).write.mode("overwrite").parquet(path + "/heads")


def load_model(spark: SparkSession, path: str) -> HeadsModel:
    """Load heads saved by :func:`save_model`."""
    row = spark.read.parquet(path + "/heads").first()
    meta = json.loads(row.meta)
    net = Net(meta["arch"], meta["loss"], meta["levels"], meta["n_features"], meta["hidden"])
    return HeadsModel(net, meta["features"], np.array(row.theta), np.array(row.scale), meta["history"])


# --- fixed values: search grid of the gates' starting weights -----------------
GATE_GRID = [0.25, 0.5, 0.622, 0.75]
# --------------------------------------------------------------------------------


def tune_gates(train: DataFrame, valid: DataFrame, features: str = "features", labels: Mapping[int, str] | None = None,
               levels: Sequence[int] = (1, 2, 3), grid: Sequence[float] = GATE_GRID,
               **fit_kw) -> tuple[HeadsModel, list[tuple[float, float]]]:
    """Choose the starting weight of the gates on the validation split.

    For every ``g`` in ``grid`` the gates start with the weight ``g`` for the levels above together and ``1 - g`` for the
    hidden layer (and are learned from there).  The candidates are fitted side by side on ``train`` and each is scored on
    ``valid`` (mean JS over levels, one aggregation); returns the best model and ``(g, mean JS)`` per candidate."""
    from labeldist.functions import distributions as D
    labels = dict(labels or {lv: f"dist_l{lv}" for lv in (1, 2, 3)})
    levels = sorted(levels)
    blocks = packed(train, features, labels, levels)
    starts = [{lv: [float(np.log(g / (1 - g)))] if i == 1 else [*[float(np.log(g / i))] * i, float(np.log(1 - g))]
               for i, lv in enumerate(levels) if i} for g in grid]
    results, best = [], None
    for g, m in zip(grid, fit_starts(blocks, features, "gated", levels, starts, **fit_kw), strict=True):
        js = F.array(*[D.classifier_js(labels[lv], f"scores_l{lv}") for lv in levels])
        v = score(m, valid).select(F.aggregate(js, F.lit(0.0), lambda a, x: a + x).alias("_j")).agg(F.avg("_j")).first()[0]
        v = float(v) / len(levels) if v is not None else float("inf")
        results.append((g, v))
        if best is None or v < best[1]:
            best = (m, v)
    return best[0], results
