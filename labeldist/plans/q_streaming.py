"""Check queries that run the Structured Streaming jobs to completion over
response files written from the test tables, then read the results back."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import functions as F

from labeldist.plans import views as V
from labeldist.plans.q_distributions import crowd_pairs
from labeldist.plans.q_prompts import FIRST_SQL
from labeldist.plans.registry import ORACLE, register
from labeldist.session import scratch_path
from labeldist.streaming import responses as SR

RESPONSE_SCHEMA = "itemid LONG, response STRING, attempt INT"


@contextmanager
def state_partitions(spark, n: int | None = None):
    """Shuffle / state-store partitions used by a streaming query started in
    this block (fixed at its first start): the cluster's task slots by
    default, instead of a batch-sized setting."""
    key = "spark.sql.shuffle.partitions"
    old = spark.conf.get(key)
    spark.conf.set(key, str(n or spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(key, old)


def _response_stream(spark, sf):
    """Answers written as one file per attempt, then read as a stream that
    takes one file per micro-batch (attempts arrive over time)."""
    src = scratch_path(spark, "responses")
    V.v_responses(spark, sf).repartition("attempt", F.pmod(F.xxhash64("itemid"), F.lit(8))).write.partitionBy("attempt").parquet(src)
    return spark.readStream.schema(RESPONSE_SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)


def _settled_files(spark, sf):
    out, ckpt = scratch_path(spark, "settled"), scratch_path(spark, "settled-ckpt")
    with state_partitions(spark):
        q = (SR.first_valid_stream(_response_stream(spark, sf)).writeStream.format("parquet")
             .option("path", out).option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    return out


@register("stream_first_valid", FIRST_SQL + "SELECT itemid, attempt FROM firstv")
def stream_first_valid(spark, sf):
    """Q4 as a stateful stream (applyInPandasWithState), file sink, read back."""
    return spark.read.parquet(_settled_files(spark, sf)).select("itemid", "attempt")


@register("stream_running_scores", ORACLE["response_js_by_level"])
def stream_running_scores(spark, sf):
    """Q6 as a stream: settled answers (file stream) joined with static gold
    distributions, running mean per level (complete mode, memory sink)."""
    settled = spark.readStream.schema(SR.OUTPUT_SCHEMA).parquet(_settled_files(spark, sf))
    gold = crowd_pairs(spark, sf).select("itemid", "gold_l1", "gold_l2", "gold_l3")
    name = f"running_scores_{uuid.uuid4().hex[:8]}"
    with state_partitions(spark):
        q = (SR.running_scores(settled, gold).writeStream.outputMode("complete").format("memory")
             .queryName(name).option("checkpointLocation", scratch_path(spark, "scores-ckpt"))
             .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.table(name).select("level", F.round("mean_js", 6).alias("mean_js"), "bad_outputs")
