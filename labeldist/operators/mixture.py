"""Gaussian mixture (M6) with full covariances in all dimensions, by EM.

Every step is one job: each task sums, per component, the weights of its rows and
their weighted sums and products.  Covariances get ``reg`` times the overall mean variance
on the diagonal, as a prior of one row's weight per component and dimension does:
the penalised log likelihood (``history``, per row) never falls, and no covariance is singular.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labeldist.operators.blocks import as_array, pack, summed

LOG_TAU = float(np.log(2 * np.pi))


@dataclass
class Mixture:
    """Weights (k), means (k, d) and covariances (k, d, d) of the components."""
    weight: np.ndarray
    mean: np.ndarray
    cov: np.ndarray
    history: list[float] = field(default_factory=list)

    def factors(self) -> list[tuple[np.ndarray, float]]:
        """Inverse Cholesky factor and log determinant of each covariance."""
        out = []
        for c in self.cov:
            low = np.linalg.cholesky(c)
            out.append((np.linalg.inv(low), 2 * float(np.log(np.diag(low)).sum())))
        return out

    def log_density(self, x: np.ndarray, factors: Sequence[tuple[np.ndarray, float]]) -> np.ndarray:
        """Log of weight times density, per row and component."""
        out = np.empty((len(x), len(self.weight)))
        with np.errstate(divide="ignore"):
            log_w = np.log(self.weight)
        for j, (inv, log_det) in enumerate(factors):
            z = (x - self.mean[j]) @ inv.T
            out[:, j] = log_w[j] - 0.5 * ((z * z).sum(axis=1) + log_det + x.shape[1] * LOG_TAU)
        return out


def _log_sum(v: np.ndarray) -> np.ndarray:
    top = v.max(axis=1, keepdims=True)
    return (top + np.log(np.exp(v - top).sum(axis=1, keepdims=True)))[:, 0]


def fit_mixture(df: DataFrame, features: str = "features", k: int = 4, seed: int = 42, max_iter: int = 100,
                tol: float = 1e-4, reg: float = 1e-3) -> Mixture:
    """EM from a k-means start until the penalised log likelihood per row rises by less than ``tol``.

    ``reg``: the weight of the prior, in units of the mean variance."""
    blocks = pack(df, features)
    first = blocks.select("d").first()
    if first is None:
        raise ValueError("no rows with features to fit")
    d = first.d
    def moments(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)])

    total = summed(blocks, moments, 1 + 2 * d)
    n, mean = total[0], total[1:d + 1] / total[0]
    spread = float(np.maximum(total[d + 1:] / n - mean * mean, 0).mean())
    prior = reg * (spread if spread > 0 else 1.0)
    centres = mean[None]
    if k > 1:
        centres = np.array(KMeans(k=k, seed=seed, featuresCol="_x", initMode="k-means||").fit(
            df.select(as_array(df, features).alias("_a")).filter(F.col("_a").isNotNull()).select(
                array_to_vector("_a").alias("_x"))).clusterCenters())
    k = len(centres)      # fewer, if there are fewer distinct rows

    size = k * (1 + d + d * d)

    def sums(x: np.ndarray, r: np.ndarray) -> np.ndarray:
        return np.concatenate([r.sum(axis=0), (r.T @ x).ravel(), *[((x * r[:, j:j + 1]).T @ x).ravel() for j in range(k)]])

    def maximised(s: np.ndarray) -> Mixture:
        count = np.maximum(s[:k], 1e-10)
        m = s[k:k + k * d].reshape(k, d) / count[:, None]
        second = s[k + k * d:].reshape(k, d, d)
        cov = np.array([second[j] / count[j] - np.outer(m[j], m[j]) for j in range(k)])
        cov = (cov + cov.transpose(0, 2, 1)) / 2 + (prior * n / k / count)[:, None, None] * np.eye(d)
        return Mixture(s[:k] / s[:k].sum(), m, cov)

    def start(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        away = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2) if len(x) * k * d < 1 << 24 else \
            (x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)
        return sums(x, np.eye(k)[away.argmin(axis=1)])

    model, history = maximised(summed(blocks, start, size)), []
    for _ in range(max_iter):
        factors = model.factors()

        def step(x: np.ndarray, y: np.ndarray, m: Mixture = model, f: list = factors) -> np.ndarray:
            v = m.log_density(x, f)
            whole = _log_sum(v)
            return np.concatenate([[whole.sum()], sums(x, np.exp(v - whole[:, None]))])

        s = summed(blocks, step, 1 + size)
        penalty = 0.5 * prior * n / k * sum(float((inv * inv).sum()) for inv, _ in factors)     # traces of the inverses
        history.append((s[0] - penalty) / n)
        if len(history) > 1 and history[-1] - history[-2] < tol:
            break
        model = maximised(s[1:])
    model.history = history
    return model


def assign(model: Mixture, df: DataFrame, features: str = "features", out: str = "cluster") -> DataFrame:
    """The most likely component of every row (NULL features: none)."""
    factors = model.factors()

    def run(xs: pd.Series) -> pd.Series:
        known = xs.notna().to_numpy()
        labels = pd.Series(np.full(len(xs), None, object))
        if known.any():
            labels[known] = model.log_density(np.stack(xs[known].to_numpy()).astype(float), factors).argmax(axis=1)
        return labels.astype("Int32")

    return df.withColumn(out, F.pandas_udf(run, "int")(as_array(df, features)))
