"""Rows packed into blocks, and sums over all blocks: the steps of iterative fits.

Each task sums over its blocks.  Long sums are cut into slices, and the tasks' slices are
added by Spark before they come back: the driver sees one row of the size of the sums,
however large the data is and however many tasks there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labeldist.session import shuffles_dropped, text_batches, written

BLOCK_CELLS = 1 << 18    # values (rows times features) of a block
DIRECT = 1 << 16         # values that may come back to the driver unadded in a step, from all tasks together
SLICE = 1 << 13          # values of a slice of longer sums


def as_array(df: DataFrame, col: str) -> Column:
    """A column of arrays or ML vectors as an array of doubles."""
    if isinstance(df.schema[col].dataType, VectorUDT):
        return F.when(F.col(col).isNotNull(), vector_to_array(col))
    return F.col(col).cast("array<double>")


def as_rows(df: DataFrame, col: str) -> Column:
    """What :func:`dense_parts` takes: an ML vector as it is (sparse ones stay so on their way to Python), or an array of doubles."""
    return F.col(col) if isinstance(df.schema[col].dataType, VectorUDT) else as_array(df, col)


def dense_parts(column: pa.Array, cells: int) -> Iterator[np.ndarray]:
    """A column of arrays or of ML vectors (all of one length, no nulls) as dense rows, about ``cells`` values at a time."""
    if not len(column):
        return
    if not pa.types.is_struct(column.type):
        x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
        step = max(1, cells // max(1, x.shape[1]))
        yield from (x[a:a + step] for a in range(0, len(x), step))
        return
    field = dict(zip((f.name for f in column.type), column.flatten(), strict=True))
    sparse = field["type"].to_numpy(zero_copy_only=False) == 0
    held = pc.list_value_length(field["values"]).to_numpy(zero_copy_only=False).astype(np.int64)
    size = np.where(sparse, pc.fill_null(field["size"], 0).to_numpy(zero_copy_only=False), held)
    d, first = int(size[0]), np.concatenate([[0], np.cumsum(held)])
    if (size != d).any():
        raise ValueError("vectors of different lengths")
    values = field["values"].flatten().to_numpy(zero_copy_only=False)
    place = np.arange(len(values)) - np.repeat(first[:-1], held)
    place[np.repeat(sparse, held)] = field["indices"].filter(pa.array(sparse)).flatten().to_numpy(zero_copy_only=False)
    step = max(1, cells // max(1, d))
    for a in range(0, len(size), step):
        b = min(a + step, len(size))
        of = slice(first[a], first[b])
        x = np.zeros((b - a, d))
        x[np.repeat(np.arange(b - a), held[a:b]), place[of]] = values[of]
        yield x


def _labels(column: pa.Array, n: int) -> np.ndarray:
    """Label arrays as rows; NaN if the array is NULL, partial or of another size."""
    whole = pc.fill_null(pc.equal(pc.list_value_length(column), n), False)
    y = np.full((len(column), n), np.nan)
    found = column.filter(whole).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
    y[whole.to_numpy(zero_copy_only=False)] = np.where(np.isnan(found).any(axis=1, keepdims=True), np.nan, found)
    return y


def _pack(sizes: Sequence[int]) -> Callable:
    """Rows of a batch as blocks: the features that are not 0 (place, value) and the labels (NaN: none)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column("x").is_valid())
            if not batch.num_rows:
                continue
            y = np.hstack([np.zeros((batch.num_rows, 0)), *[_labels(batch.column(f"y{i}"), n) for i, n in enumerate(sizes)]])
            a = 0
            for part in dense_parts(batch.column("x"), BLOCK_CELLS):
                at = np.flatnonzero(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([len(part)], pa.int64()), pa.array([part.shape[1]], pa.int64()), pa.array([at.astype(np.int32).tobytes()]),
                     pa.array([part.ravel()[at].tobytes()]), pa.array([y[a:a + len(part)].tobytes()])], names=["n", "d", "at", "x", "y"])
                a += len(part)
    return run


def pack(df: DataFrame, features: str, labels: Sequence[str] = (), sizes: Sequence[int] = ()) -> DataFrame:
    """Blocks of rows (features and label arrays of the given sizes) in the shared folder, dealt over as many files as the
    cluster runs tasks at once if the rows came in fewer parts.

    Rows without features are left out; a label array that is NULL, partial or of another size counts as unknown (NaN)."""
    ys = [F.col(c).cast("array<double>").alias(f"y{i}") for i, c in enumerate(labels)]
    text_batches(df.sparkSession)
    blocks = written(df.select(as_rows(df, features).alias("x"), *ys).mapInArrow(
        _pack(sizes), "n long, d long, at binary, x binary, y binary"), large_rows=True)
    files, tasks = len(blocks.inputFiles()), df.sparkSession.sparkContext.defaultParallelism
    if files < tasks and (n := blocks.count()) > files:
        blocks = written(blocks.repartition(min(n, tasks)), large_rows=True)
    return blocks


def unpacked(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of a block."""
    n, d = batch.column("n")[i].as_py(), batch.column("d")[i].as_py()
    x = np.zeros(n * d)
    x[np.frombuffer(batch.column("at")[i].as_py(), np.int32)] = np.frombuffer(batch.column("x")[i].as_py())
    return x.reshape(n, d), np.frombuffer(batch.column("y")[i].as_py()).reshape(n, -1)


def summed(blocks: DataFrame, part: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """Sum of ``part(features, labels)``, an array of ``size`` values, over all blocks.

    There are as many tasks as the cluster runs at once, at most.  Unless all their sums are few values, these are added
    slice by slice in a second stage."""
    blocks = blocks.coalesce(max(1, blocks.sparkSession.sparkContext.defaultParallelism))
    added = blocks.rdd.getNumPartitions() * size > DIRECT
    step = SLICE if added else max(1, size)
    text_batches(blocks.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for i in range(batch.num_rows):
                one = part(*unpacked(batch, i))
                total = one if total is None else total + one
        if total is not None:
            cuts = range(0, size, step)
            yield pa.RecordBatch.from_arrays([pa.array([a // step for a in cuts], pa.int32()),
                                              pa.array([total[a:a + step].tobytes() for a in cuts], pa.binary())], names=["slice", "sums"])

    def add(rows: Sequence[bytes]) -> np.ndarray:
        return sum(np.frombuffer(r) for r in sorted(rows))      # one order of adding, whatever order they come in

    def add_slices(table: pa.Table) -> pa.Table:
        return pa.table({"slice": table.column("slice")[:1], "sums": [add(table.column("sums").to_pylist()).tobytes()]})

    slices: dict[int, list[bytes]] = {}
    with shuffles_dropped(blocks.sparkSession):
        rows = blocks.mapInArrow(run, "slice int, sums binary")
        if added:
            rows = rows.groupBy("slice").applyInArrow(add_slices, "slice int, sums binary")
        for r in rows.collect():
            slices.setdefault(r.slice, []).append(bytes(r.sums))
    return np.concatenate([add(slices[k]) for k in sorted(slices)])
