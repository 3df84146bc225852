"""Batch prompt jobs.

Prompts are built as data: every instance gets its message array from a
join with a per-language prompt table and a per-language exemplar array
(both bounded by the number of languages x exemplars, so they are
broadcast).  Model calls are outside the library: a caller turns the prompt
table into a responses table ``(key, attempt, response)`` and the jobs here
validate and score it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labeldist.functions import distributions as D
from labeldist.functions import responses as RS
from labeldist.functions import text as TX

MAX_EXAMPLES = 5   # fixed value: at most five exemplars per prompt
MAX_ATTEMPTS = 5   # fixed value: at most five attempts per prompt


def message(role: str, content) -> "F.Column":
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def exemplar_arrays(exemplars: DataFrame, lang: str = "lang", idx: str = "idx",
                    max_examples: int = MAX_EXAMPLES) -> DataFrame:
    """One row per language with its exemplars in order (at most ``max_examples``).

    Ranks with a window partitioned by language; Spark plans
    ``row_number() <= k`` as a per-partition group limit before the shuffle,
    so only k rows per language and task move."""
    w = Window.partitionBy(lang).orderBy(idx)
    top = exemplars.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= max_examples)
    return top.groupBy(lang).agg(F.array_sort(F.collect_list(
        F.struct(F.col(idx).alias("idx"), "question", "answer"))).alias("examples"))


def build_messages(df: DataFrame, prompts: DataFrame, exemplars: DataFrame, k: int,
                   question: str = "question", lang: str = "lang") -> DataFrame:
    """Q1 + J5: ``messages ARRAY<STRUCT<role, content>>`` per instance.

    Main prompt, acknowledgement, ``k`` exemplar turns of the instance's
    language, then the question.  ``prompts`` has ``(lang, prompt, ack)``;
    ``exemplars`` has ``(lang, idx, question, answer)``.
    """
    if not 0 <= k <= MAX_EXAMPLES:
        raise ValueError(f"k must be between 0 and {MAX_EXAMPLES}")
    ex = exemplar_arrays(exemplars, max_examples=MAX_EXAMPLES).withColumnRenamed("lang", lang)
    j = (df.join(F.broadcast(prompts.withColumnRenamed("lang", lang)), lang, "left")
           .join(F.broadcast(ex), lang, "left"))
    turns = F.expr(f"flatten(transform(slice(coalesce(examples, array()), 1, {int(k)}), e -> array("
                   "named_struct('role', 'user', 'content', e.question), "
                   "named_struct('role', 'assistant', 'content', e.answer))))")
    msgs = F.concat(F.array(message("user", F.col("prompt")), message("assistant", F.col("ack"))),
                    turns, F.array(message("user", F.col(question))))
    return j.withColumn("messages", msgs).drop("prompt", "ack", "examples")


def validate(df: DataFrame, response: str = "response", n: int = RS.N_SENSES,
             tol: float = RS.SUM_TOLERANCE) -> DataFrame:
    """Q3 as a DataFrame step: adds ``valid``, ``reason``, ``probs``."""
    v = RS.validate_response(response, n, tol)
    return df.withColumn("_v", v).select("*", "_v.*").drop("_v")


def first_valid(responses: DataFrame, keys: Sequence[str], attempt: str = "attempt",
                response: str = "response", max_attempts: int = MAX_ATTEMPTS,
                items: DataFrame | None = None) -> DataFrame:
    """Q4: the first valid response of at most ``max_attempts`` per key.

    ``(keys..., attempt, probs)`` with NULLs for a key whose attempts are all
    invalid: one aggregation whose ordering is the attempt number of valid
    rows only (``min_by`` skips NULL orderings).  ``items`` (every key that
    should have an answer) is joined only when given, for keys with no
    response rows at all.  The aggregation is partial, so a key with very
    many attempts does not gather its rows on one task.
    """
    keys = list(keys)
    v = validate(responses.filter(F.col(attempt) <= max_attempts), response)
    best = (v.groupBy(*keys)
             .agg(F.min_by(F.struct(F.col(attempt).alias("attempt"), F.col("probs").alias("probs")),
                           F.when(F.col("valid"), F.col(attempt))).alias("_b"))
             .select(*keys, "_b.attempt", "_b.probs"))
    if items is None:
        return best
    return items.join(best, keys, "left")


def score_responses(first: DataFrame, gold: DataFrame, keys: Sequence[str],
                    levels: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """Q5 + Q6 + A9: roll valid 28-vectors up (D2, D3), compare each level
    with the gold distribution (both smoothed, non-finite -> 1.0) and average
    over valid responses; ``bad_outputs`` counts keys without one.  Keys
    without gold have nothing to be compared with and are left out
    (:func:`without_gold` lists them).

    ``gold`` has ``(keys..., gold_l1, gold_l2, gold_l3)``.
    """
    keys = list(keys)
    p = first.withColumn("pred_l3", F.col("probs"))
    p = p.withColumn("pred_l2", D.rollup_level("pred_l3", 2)).withColumn("pred_l1", D.rollup_level("pred_l2", 1))
    j = p.join(gold, keys)
    per = F.array(*[F.struct(F.lit(lv).alias("level"),
                             D.response_js(f"gold_l{lv}", f"pred_l{lv}").alias("js")) for lv in levels])
    long = j.select(*keys, F.col("probs").isNotNull().alias("valid"), F.inline(per))
    from labeldist.operators import metrics as M
    return M.valid_mean(long, "js", "valid", ["level"], out="mean_js")


def without_gold(first: DataFrame, gold: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Answered keys that have no gold distribution (left out by Q6)."""
    return first.join(gold, list(keys), "left_anti")


def audit_exemplars(exemplars: DataFrame, answer: str = "answer", by: Sequence[str] = ()) -> DataFrame:
    """Q7: how many exemplar answers pass the response validator, by reason."""
    v = validate(exemplars, answer)
    return v.groupBy(*by, F.coalesce("reason", F.lit("valid")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
