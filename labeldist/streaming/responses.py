"""Structured Streaming versions of the response jobs.

Model answers arrive over time, one attempt per row ``(key, attempt,
response)``.  The first valid answer of at most ``max_attempts`` is final
only when every earlier attempt has been seen and was invalid; the stateful
operator below keeps, per key, which attempts were seen and which were valid
(bit masks) plus the probabilities of the smallest valid attempt, and emits
one row per key as soon as the answer is settled: ``valid`` (with the
attempt and its probabilities) or ``exhausted`` (all attempts invalid).
State per key is a few integers and one 28-vector, whatever the data size.

The running score (the reference keeps running sums of JS distances) is a
stream-static join of settled answers with the gold distributions followed
by a streaming aggregation.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from labeldist.functions import distributions as D
from labeldist.functions import responses as RS

MAX_ATTEMPTS = 5

OUTPUT_SCHEMA = "itemid LONG, attempt INT, probs ARRAY<DOUBLE>, status STRING"
STATE_SCHEMA = "seen INT, valid INT, best INT, probs STRING, done BOOLEAN"


def _settle(seen: int, valid: int, max_attempts: int):
    """(attempt, status) when settled, else None."""
    for a in range(1, max_attempts + 1):
        bit = 1 << (a - 1)
        if not seen & bit:
            return None
        if valid & bit:
            return a, "valid"
    return None, "exhausted"


def first_valid_stream(responses: DataFrame, key: str = "itemid", attempt: str = "attempt",
                       response: str = "response", max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Q4 on a stream: one settled row per key (append mode)."""
    v = responses.filter(F.col(attempt).between(1, max_attempts)).select(
        F.col(key).cast("long").alias("itemid"), F.col(attempt).cast("int").alias("attempt"),
        RS.validate_response(response).alias("_v"))
    v = v.select("itemid", "attempt", F.col("_v.valid").alias("valid"),
                 F.to_json(F.col("_v.probs")).alias("probs_json"))

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, valid, best, probs, done = state.get if state.exists else (0, 0, 0, None, False)
        if done:
            return
        for pdf in batches:
            for a, ok, pj in zip(pdf["attempt"], pdf["valid"], pdf["probs_json"]):
                bit = 1 << (int(a) - 1)
                seen |= bit
                if ok:
                    valid |= bit
                    if best == 0 or int(a) < best:
                        best, probs = int(a), pj
        settled = _settle(seen, valid, max_attempts)
        if settled is None:
            state.update((seen, valid, best, probs, False))
            return
        a, status = settled
        state.update((seen, valid, best, None, True))
        yield pd.DataFrame({"itemid": [k[0]], "attempt": [a],
                            "probs": [json.loads(probs) if status == "valid" else None],
                            "status": [status]})

    return v.groupBy("itemid").applyInPandasWithState(
        step, OUTPUT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)


def running_scores(settled: DataFrame, gold: DataFrame, key: str = "itemid",
                   levels: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """Q6 on a stream: mean JS per level over valid answers so far and the
    number of exhausted keys (complete / update output mode).

    ``gold`` is a static table ``(key, gold_l1, gold_l2, gold_l3)``."""
    p = settled.withColumn("pred_l3", F.col("probs"))
    p = p.withColumn("pred_l2", D.rollup_level("pred_l3", 2)).withColumn("pred_l1", D.rollup_level("pred_l2", 1))
    j = p.join(gold, key, "left")
    per = F.array(*[F.struct(F.lit(lv).alias("level"), D.response_js(f"gold_l{lv}", f"pred_l{lv}").alias("js"))
                    for lv in levels])
    long = j.select(key, (F.col("status") == "valid").alias("valid"), F.inline(per))
    return long.groupBy("level").agg(F.avg(F.when(F.col("valid"), F.col("js"))).alias("mean_js"),
                                     F.count_if(~F.col("valid")).alias("bad_outputs"))
