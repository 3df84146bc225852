"""Rows in blocks and sums over them."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.ml.linalg import Vectors

from labeldist.operators import blocks as B
from labeldist.operators import heads as H
from labeldist.session import written


def table(spark, n, d, parts):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, d))
    return x, spark.createDataFrame([(r.tolist(),) for r in x], "x ARRAY<DOUBLE>").repartition(parts)


def test_long_sums_come_back_once(spark, monkeypatch):
    """However many tasks there are, the driver gets as many values as the sum has."""
    x, df = table(spark, 40, 3, 10)
    blocks, size = B.pack(df, "x"), 3 * B.SLICE + 5
    assert len(blocks.inputFiles()) >= 8
    seen, kind = [], type(df)
    collect = kind.collect

    def watched(self):
        rows = collect(self)
        seen.append(sum(len(r.sums) for r in rows if "sums" in r))
        return rows
    monkeypatch.setattr(kind, "collect", watched)
    got = B.summed(blocks, lambda x, y: np.resize(x.sum(axis=0), size), size)
    assert np.allclose(got, np.resize(x.sum(axis=0), size))
    assert seen == [8 * size]
    assert np.allclose(B.summed(blocks, lambda x, y: x.sum(axis=0), 3), x.sum(axis=0))


def test_steps_leave_no_shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        files = disk.getAllFiles()
        return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}
    x, df = table(spark, 40, 3, 10)
    blocks, size = B.pack(df, "x"), 2 * B.SLICE
    before = shuffled()
    B.summed(blocks, lambda x, y: np.resize(x.sum(axis=0), size), size)
    assert shuffled() <= before
    spark.range(100).selectExpr("id % 7 k").groupBy("k").count().collect()
    assert not shuffled() <= before     # only those of the steps go


def test_blocks_of_one_file_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(B, "BLOCK_CELLS", 30)
    x, df = table(spark, 200, 3, 1)
    blocks = B.pack(df, "x")
    tasks = spark.sparkContext.defaultParallelism
    assert len(blocks.inputFiles()) == min(tasks, 20)
    assert blocks.agg({"n": "sum"}).first()[0] == 200
    assert np.allclose(B.summed(blocks, lambda x, y: x.sum(axis=0), 3), x.sum(axis=0))


def test_sparse_vectors_stay_sparse(spark):
    """Vectors reach Python as they are (not as long arrays), in batches of bounded bytes, and blocks lie in small row groups."""
    rng, d = np.random.default_rng(5), 1 << 12
    places = [np.sort(rng.choice(d, 40, replace=False)) for _ in range(3000)]
    rows = [(i, None if i % 100 == 7 else Vectors.dense(np.bincount(p, minlength=d)) if i % 100 == 9 else Vectors.sparse(d, p, np.arange(1.0, 41.0)),
             [0.1, 0.2, 0.3, 0.4]) for i, p in enumerate(places)]
    df = spark.createDataFrame(rows, ["id", "v", "dist_l1"])
    x = np.zeros((3000, d))
    for i, p in enumerate(places):
        x[i, p] = 1.0 if i % 100 == 9 else np.arange(1.0, 41.0)
    known = np.arange(3000) % 100 != 7
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    blocks = B.pack(df.coalesce(1), "v", ["dist_l1"], [4])
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "4m"
    assert np.allclose(B.summed(blocks, lambda x, y: x.sum(axis=0), d), x[known].sum(axis=0))
    assert blocks.agg({"n": "sum"}).first()[0] == known.sum() and blocks.agg({"n": "max"}).first()[0] <= B.BLOCK_CELLS // d
    net = H.Net("flat", "cross-entropy", [1], d, 8)
    model = H.HeadsModel(net, "v", net.start(1, {}), np.full(d, 0.1))
    scored = H.score(model, df)
    assert "vector_to_array" not in scored._jdf.queryExecution().toString()
    want = net.forward(net.split(model.theta), x * 0.1)["s1"]
    for r in scored.collect():
        assert (r.scores_l1 is None) == (not known[r.id]) and (r.scores_l1 is None or np.allclose(r.scores_l1, want[r.id]))


def test_vectors_of_different_lengths_are_refused(spark):
    column = pa.array([{"type": 0, "size": 3, "indices": [1], "values": [2.0]}, {"type": 1, "size": None, "indices": None, "values": [1.0, 2.0]}],
                      pa.struct([("type", pa.int8()), ("size", pa.int32()), ("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))]))
    with pytest.raises(ValueError):
        list(B.dense_parts(column, 100))


def test_large_rows_lie_in_small_groups(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, rng.bytes(1 << 20)) for i in range(40)], "id INT, x BINARY").coalesce(1)
    meta = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in written(df, large_rows=True).inputFiles()]
    sizes = [m.row_group(i).total_byte_size for m in meta for i in range(m.num_row_groups)]
    assert sum(sizes) > 40e6 and max(sizes) < 12e6
