"""Features (M1-M4): text embedding, standardisation, PCA.

Everything is Spark ML: estimators fit with distributed aggregations and
keep only dimension-sized state (vocabulary size, d means, d x d
covariance), never rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labeldist.operators.blocks import as_array, pack, summed

DEFAULT_FEATURES = 1 << 12  # hashed vocabulary size of the default text encoder
TOKEN_PATTERN = "(?U)\\W+"  # letters of every script belong to words


def check_text_input(df, text_col: str) -> None:
    """M2: fail before any job when the input is not usable."""
    if not isinstance(df, DataFrame):
        raise ValueError("embed() expects a Spark DataFrame")
    if text_col not in df.columns:
        raise ValueError(f"input DataFrame has no column '{text_col}'")


def text_encoder(text_col: str = "text", out: str = "features",
                 num_features: int = DEFAULT_FEATURES) -> Pipeline:
    """Tokenise -> hashed term frequencies -> IDF (a fitted, reusable pipeline)."""
    return Pipeline(stages=[
        RegexTokenizer(inputCol=text_col, outputCol="_tokens", pattern=TOKEN_PATTERN, minTokenLength=1),
        HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=num_features),
        IDF(inputCol="_tf", outputCol=out),
    ])


def embed(df: DataFrame, text_col: str = "arg1_arg2", out: str = "embedding",
          encoder: Callable[[pd.Series], pd.Series] | None = None,
          num_features: int = DEFAULT_FEATURES, dense: bool = False) -> DataFrame:
    """M1: text -> embedding column.

    Default: a TF-IDF pipeline fitted on ``df`` (whole texts); the result
    stays a *sparse* ML vector (a dense array of ``num_features`` values per
    text would multiply the storage of a large corpus), ``dense=True`` gives
    ``ARRAY<FLOAT>``.  A user-supplied ``encoder`` (pandas Series of texts ->
    Series of float lists, e.g. a sentence encoder loaded once per task) runs
    through ``mapInPandas`` in Arrow batches and gives ``ARRAY<FLOAT>``.
    """
    check_text_input(df, text_col)
    if encoder is None:
        model = text_encoder(text_col, "_vec", num_features).fit(df)
        res = model.transform(df).drop("_tokens", "_tf")
        if dense:
            return res.withColumn(out, vector_to_array("_vec", "float32")).drop("_vec")
        return res.withColumnRenamed("_vec", out)

    schema = df.schema.add(out, "array<float>")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf[out] = encoder(pdf[text_col])
            yield pdf

    return df.mapInPandas(run, schema)


def as_features(df: DataFrame, col: str = "embedding", out: str = "features") -> DataFrame:
    """Embedding column (array or ML vector) -> ML vector column."""
    if isinstance(df.schema[col].dataType, VectorUDT):
        return df.withColumn(out, F.col(col))
    return df.withColumn(out, array_to_vector(F.col(col).cast("array<double>")))


def standardize(df: DataFrame, col: str = "features", out: str = "scaled",
                population: bool = True) -> DataFrame:
    """M3: centre and scale every dimension.

    One summary pass (``Summarizer``: mean, variance, count -- d-sized
    results, never rows) and one map-side projection.  ``population=True``
    divides by the population standard deviation (the common single-machine
    convention) instead of the sample one; a constant dimension becomes 0.
    """
    s = df.select(Summarizer.metrics("mean", "variance", "count").summary(F.col(col)).alias("s")).first().s
    n = s["count"]
    f = (n - 1) / n if population and n > 1 else 1.0
    mean = s["mean"].toArray().tolist()
    inv = [1.0 / math.sqrt(v * f) if v > 0 else 0.0 for v in s["variance"].toArray().tolist()]
    lit = lambda xs: "array(" + ", ".join(f"{x!r}D" for x in xs) + ")"
    z = F.expr(f"zip_with(zip_with(_x, {lit(mean)}, (a, b) -> a - b), {lit(inv)}, (a, b) -> a * b)")
    res = df.withColumn("_x", vector_to_array(col))
    return res.withColumn(out, array_to_vector(z)).drop("_x")


def components(df: DataFrame, col: str, k: int, seed: int = 42, max_iter: int = 60, tol: float = 1e-10) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean (d), principal directions (d, k) and their variances (k).

    Subspace iteration with ``k + 10`` random directions: each step is one job in which every task sums the products of
    its rows (which may be sparse) with the directions, ``d * (k + 10)`` numbers; nothing of size d * d is formed unless
    all components are asked for.  It ends when the variances found stay the same to ``tol`` of the largest."""
    blocks = pack(df, col)
    first = blocks.select("d").first()
    if first is None:
        raise ValueError("no rows with features")
    d = first.d
    total = summed(blocks, lambda x, y: np.concatenate([[len(x)], x.sum(axis=0)]), 1 + d)
    n, mean = total[0], total[1:] / total[0]
    width = min(d, k + 10)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, width)))[0]
    before = np.zeros(min(k, d))
    for _ in range(max_iter):
        z = summed(blocks, lambda x, y, q=q: (x.T @ (x @ q)).ravel(), d * width).reshape(d, width) / n - np.outer(mean, mean @ q)
        value, turn = np.linalg.eigh((q.T @ z + z.T @ q) / 2)
        value, turn = value[::-1], turn[:, ::-1]
        if width == d or np.abs(value[:k] - before).max() <= tol * max(value[0], 1e-300):
            break
        before = value[:k]
        q = np.linalg.qr(z @ turn)[0]
    axes = q @ turn[:, :k]
    # one sign for each direction: its largest entry is positive
    return mean, axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])]), np.maximum(value[:k], 0)


def reduce(df: DataFrame, col: str = "features", k: int = 10, out: str = "pca") -> DataFrame:
    """M4: principal components of centred input (see :func:`components`); NULL features give NULL."""
    mean, axes, _ = components(df, col, k)
    shift = mean @ axes

    def run(xs: pd.Series) -> pd.Series:
        known = xs.notna().to_numpy()
        res = pd.Series(np.full(len(xs), None, object))
        if known.any():
            res[known] = pd.Series(list(np.stack(xs[known].to_numpy()).astype(float) @ axes - shift)).to_numpy()
        return res

    return df.withColumn(out, array_to_vector(F.pandas_udf(run, "array<double>")(as_array(df, col))))
