"""Stateful first-valid stream: attempts arriving out of order over several
micro-batches settle exactly like the batch operator."""

import os

from labeldist.streaming import responses as SR


def good():
    return "[" + ", ".join(["0.5", "0.5"] + ["0.0"] * 26) + "]"


def test_out_of_order_attempts(spark, tmp_dir):
    src = os.path.join(tmp_dir, "src")
    batches = [
        [(1, 2, good()), (2, 1, "[1]")],            # item 1: attempt 2 valid, attempt 1 not yet seen
        [(1, 1, "bad"), (2, 2, "x"), (2, 3, "x")],  # item 1 settles at 2
        [(2, 4, "x"), (2, 5, "x"), (2, 6, good())],  # item 2: five bad -> exhausted (6th ignored)
        [(3, 1, good())],
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "itemid LONG, attempt INT, response STRING").coalesce(1) \
            .write.mode("append").parquet(os.path.join(src, f"b{i}"))
    stream = (spark.readStream.schema("itemid LONG, attempt INT, response STRING")
              .option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(src))
    out, ckpt = os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "ckpt")
    q = (SR.first_valid_stream(stream).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    got = {r.itemid: (r.attempt, r.status) for r in spark.read.parquet(out).collect()}
    assert got == {1: (2, "valid"), 2: (None, "exhausted"), 3: (1, "valid")}
