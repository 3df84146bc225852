"""Quality classifier by positive-unlabelled learning.

Only trusted positives and unlabelled text are learned from.  With a class
prior ``p`` (share of positives), the risk of a score g under the logistic loss
is ``p * E_P[loss(g)] + max(0, E_U[loss(-g)] - p * E_P[loss(-g)])``: negatives
are what the unlabelled texts hold beyond their share of positives, and that
part of the risk is kept from going below zero.  It is minimised by Newton
steps; each step's gradient and curvature are sums over all rows, taken by
Spark, and its length is the one with the lowest (non-negative) risk.

A text is described by shares that tell prose from junk (capitals, symbols,
repeated words and lines, lengths).  Each is cut at fixed edges, and every
resulting cell has a weight.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labeldist.llm.common import GAP, column_or_null, crc_mod, slices, stored, text_batches

BATCH_BYTES = 2_000_000
SHARES = (0.0, 0.01, 0.03, 0.07, 0.15, 0.3, 0.5, 0.7, 0.85, 0.95)   # a share falls into the cell of the last edge it exceeds
EDGES: dict[str, tuple[float, ...]] = {
    "capitals": SHARES, "exclamations": SHARES, "bars": SHARES, "symbols": SHARES, "digits": SHARES, "letters": SHARES,
    "repeats": SHARES, "distinct_words": SHARES, "distinct_pairs": SHARES, "distinct_lines": SHARES, "ends": SHARES,
    "word_length": (0, 2, 3, 4, 5, 6, 7, 8, 10, 14),
    "words": (0, 4, 8, 16, 32, 64, 128, 512, 2048, 8192),
}
CELLS = len(SHARES) + 1
WIDTH = len(EDGES) * CELLS + 1   # and a constant
RIDGE = 1e-3
STEPS = 12
LENGTHS = (1.0, 0.5, 0.25, 0.0625)

_LETTER, _CAPITAL, _DIGIT, _SYMBOL, _BANG, _BAR, _OTHER = 1, 2, 3, 4, 5, 6, 0


def _classes() -> np.ndarray:
    """Class of each character of the basic plane, from its Unicode category."""
    out = np.zeros(1 << 16, np.uint8)
    for c in range(len(out)):
        kind = unicodedata.category(chr(c))
        out[c] = (_CAPITAL if kind in ("Lu", "Lt") else _LETTER if kind[0] in "LM" else _DIGIT if kind[0] == "N"
                  else _SYMBOL if kind[0] == "S" or chr(c) in "%&*#@\\/_" else _OTHER)
    out[ord("!")], out[ord("|")] = _BANG, _BAR
    return out


def _distinct(owner: np.ndarray, code: np.ndarray, n: int) -> np.ndarray:
    """Number of distinct codes of each owner."""
    key = np.sort(owner.astype(np.int64) << 32 | code)
    return np.bincount(key[np.diff(key, prepend=-1) != 0] >> 32, minlength=n)


def describe(texts: pa.Array, classes: np.ndarray) -> np.ndarray:
    """The cells (one row per text, one column per feature) of all texts."""
    n = len(texts)
    texts = pc.fill_null(texts, "")
    size = pc.utf8_length(texts).to_numpy().astype(np.int64)
    codes = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32)
    kind = np.where(codes < 1 << 16, classes[np.minimum(codes, (1 << 16) - 1)], _LETTER)
    start = np.concatenate([[0], np.cumsum(size)])
    count = np.zeros((7, n))
    for k in range(1, 7):
        run = np.concatenate([[0], np.cumsum(kind == k)])
        count[k] = run[start[1:]] - run[start[:-1]]
    letters = count[_LETTER] + count[_CAPITAL]

    def coded(pattern: str):
        parts = pc.split_pattern_regex(pc.utf8_lower(texts), pattern)
        flat = parts.flatten()
        full = pc.greater(pc.binary_length(pc.utf8_trim_whitespace(flat)), 0)
        owner = pc.list_parent_indices(parts).to_numpy()[full.to_numpy(zero_copy_only=False)]
        flat = flat.filter(full)
        return owner, flat, flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)

    owner, word, code = coded(GAP)
    words = np.bincount(owner, minlength=n)
    ends = np.bincount(owner, weights=pc.match_substring_regex(word, r"[.!?]$").to_numpy(zero_copy_only=False), minlength=n)
    length = np.bincount(owner, weights=pc.utf8_length(word).to_numpy(), minlength=n)
    next_to = owner[1:] == owner[:-1]
    pair_owner = owner[1:][next_to]
    repeats = np.bincount(pair_owner, weights=(code[1:] == code[:-1])[next_to], minlength=n)
    pairs = np.bincount(pair_owner, minlength=n)
    pair_code = (code[1:] * 1_000_003 + code[:-1])[next_to] % (1 << 31)
    line_owner, _, line_code = coded("\n")
    lines = np.bincount(line_owner, minlength=n)

    def share(x, of):
        return x / np.maximum(of, 1)

    values = {
        "capitals": share(count[_CAPITAL], letters), "exclamations": share(count[_BANG], words), "bars": share(count[_BAR], words),
        "symbols": share(count[_SYMBOL], size), "digits": share(count[_DIGIT], size), "letters": share(letters, size),
        "repeats": share(repeats, pairs), "distinct_words": share(_distinct(owner, code, n), words),
        "distinct_pairs": share(_distinct(pair_owner, pair_code, n), pairs),
        "distinct_lines": share(_distinct(line_owner, line_code, n), lines), "ends": share(ends, words),
        "word_length": share(length, words), "words": words}
    return np.stack([np.searchsorted(edges, values[name], side="left") for name, edges in EDGES.items()], axis=1).astype(np.uint8)


def features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``__cells`` (a byte per feature); null texts count as empty."""
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], column_or_null(docs, "text", "string").alias("__text"))
    text_batches(docs.sparkSession)
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("__cells", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = _classes()
        for batch in batches:
            for part in slices(batch, "__text", BATCH_BYTES):
                cells = describe(part.column("__text"), classes)
                packed = [row.tobytes() for row in cells]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(packed, pa.binary())], names=schema.names)

    return rows.mapInArrow(run, schema)


def _columns(batch: pa.RecordBatch) -> np.ndarray:
    """Places of each row's cells (and the constant) in the weights."""
    cells = np.frombuffer(b"".join(batch.column("__cells").to_pylist()), np.uint8).reshape(batch.num_rows, len(EDGES))
    places = cells + np.arange(len(EDGES)) * CELLS
    return np.concatenate([places, np.full((len(places), 1), WIDTH - 1)], axis=1)


def _total(rows: DataFrame, of_batch, n: int) -> np.ndarray:
    """The sum of ``of_batch(batch)`` (an array of length ``n``, a number fixed by the features) over all rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(n)
        for batch in batches:
            if batch.num_rows:
                out += of_batch(batch)
        some = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(out[some])], names=["k", "v"])

    out = np.zeros(n)
    for r in rows.mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
        out[r.k] = r.v
    return out


@dataclass
class Model:
    weights: np.ndarray
    prior: float


def _softplus(g: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, g)


def fit(rows: DataFrame, prior: float, steps: int = STEPS, ridge: float = RIDGE) -> Model:
    """Learn from ``__cells`` and ``__trusted`` (true: a trusted positive; every row counts as unlabelled)."""
    def means(batch: pa.RecordBatch) -> np.ndarray:
        at, trusted = _columns(batch), batch.column("__trusted").to_numpy(zero_copy_only=False)
        return np.concatenate([np.bincount(at[trusted].ravel(), minlength=WIDTH), [trusted.sum(), len(at)]])

    first = _total(rows, means, WIDTH + 2)
    n_p, n_u = first[-2:]
    if not n_p or not n_u:
        return Model(np.zeros(WIDTH), prior)
    mean_p = first[:WIDTH] / n_p
    penalty = np.full(WIDTH, ridge)
    penalty[-1] = 0.0

    def slope(w: np.ndarray):
        def of(batch: pa.RecordBatch) -> np.ndarray:
            at = _columns(batch)
            s = 1 / (1 + np.exp(-w[at].sum(axis=1)))
            pairs = (at[:, :, None] * WIDTH + at[:, None, :]).reshape(len(at), -1)
            return np.concatenate([np.bincount(at.ravel(), weights=np.repeat(s, at.shape[1]), minlength=WIDTH),
                                   np.bincount(pairs.ravel(), weights=np.repeat(s * (1 - s), pairs.shape[1]), minlength=WIDTH**2)])
        return of

    def risks(ways: list[np.ndarray]):
        def of(batch: pa.RecordBatch) -> np.ndarray:
            at, trusted = _columns(batch), batch.column("__trusted").to_numpy(zero_copy_only=False)
            g = np.stack([w[at].sum(axis=1) for w in ways])
            return np.concatenate([_softplus(-g[:, trusted]).sum(axis=1), _softplus(g[:, trusted]).sum(axis=1), _softplus(g).sum(axis=1)])
        return of

    def risk_of(ways: list[np.ndarray]) -> np.ndarray:
        right, wrong, all_ = _total(rows, risks(ways), 3 * len(ways)).reshape(3, -1)
        negative = all_ / n_u - prior * wrong / n_p
        return prior * right / n_p + np.maximum(0.0, negative) + np.array([(penalty * w * w).sum() / 2 for w in ways])

    w, lowest = np.zeros(WIDTH), np.inf
    for _ in range(steps):
        sums = _total(rows, slope(w), WIDTH + WIDTH**2) / n_u
        gradient = sums[:WIDTH] - prior * mean_p + penalty * w
        curvature = sums[WIDTH:].reshape(WIDTH, WIDTH) + np.diag(penalty + 1e-9)
        step = np.linalg.solve(curvature, gradient)
        ways = [w - x * step for x in LENGTHS]
        risk = risk_of(ways)
        best = int(risk.argmin())
        if not risk[best] < lowest - 1e-6:
            break
        w, lowest = ways[best], risk[best]
    return Model(w, prior)


def score(rows: DataFrame, model: Model) -> DataFrame:
    """Add ``__score``: the chance that a row (with ``__cells``) is a positive."""
    weights = model.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = 1 / (1 + np.exp(-weights[_columns(batch)].sum(axis=1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64())], names=[*batch.schema.names, "__score"])

    return rows.mapInArrow(run, rows.withColumn("__score", F.lit(0.0)).schema)


def classify(docs: DataFrame, labels: DataFrame, held_out: Column, keep: list[str], threshold: float = 0.3) -> DataFrame:
    """``keep`` columns of ``docs``, ``__held_out``, ``__score`` and ``__predicted`` (0 or 1) of every row.

    Trusted positives: documents outside ``held_out`` whose labels (``doc_id,
    quality``) all say 1.  Unlabelled: the texts of all documents outside it.
    The class prior is the share of 1 among the labelled documents outside it.
    Null texts are scored as empty ones, rows without an id or label are
    unlabelled, and without any positive all scores are 0.5.  Texts are whole, however long; repeated rows are scored
    and count each for itself; an empty table gives an empty result.
    """
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(
        (F.min("quality") == 1).alias("__good")).withColumnRenamed("doc_id", "__label_id")
    described = features(docs.withColumns({"__held_out": held_out, "__label_id": column_or_null(docs, "doc_id", "long")}),
                         [*keep, "__held_out", "__label_id"])
    joined = stored(described.join(known, "__label_id", "left").withColumns({
        "__labelled": F.col("__good").isNotNull() & ~F.col("__held_out"),
        "__trusted": F.coalesce(F.col("__good") & ~F.col("__held_out"), F.lit(False))}).drop("__label_id", "__good"), "quality")
    n, good = joined.agg(F.sum(F.col("__labelled").cast("long")), F.sum(F.col("__trusted").cast("long"))).first()
    prior = min(max((good or 0) / n, 0.01), 0.99) if n else 0.5
    model = fit(joined.filter("NOT __held_out").select("__cells", "__trusted"), prior)
    scored = score(joined.select(*[F.col(f"`{c}`") for c in keep], "__held_out", "__cells"), model)
    return scored.drop("__cells").withColumn("__predicted", (F.col("__score") >= threshold).cast("int"))


def op7(docs: DataFrame, labels: DataFrame) -> DataFrame:
    found = classify(docs, labels, crc_mod(F.col("doc_id"), 5) == 0, ["doc_id"])
    return found.select("doc_id", F.col("__held_out").alias("held_out"), F.col("__score").alias("score"),
                        F.col("__predicted").alias("predicted"))
