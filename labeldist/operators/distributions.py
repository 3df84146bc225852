"""DataFrame-level distribution operators (build, roll up, compare, average).

The per-row work is done by the Column functions of
:mod:`labeldist.functions.distributions`; these operators arrange it into
stages so that every array is computed once and only aggregations shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labeldist import taxonomy as tx
from labeldist.functions import distributions as D


def vote_distribution(df: DataFrame, keys: Sequence[str], label_col: str, n_labels: int,
                      count_col: str | None = None, side_col: str | None = None,
                      sides: Sequence[int] = (0, 1), out_prefix: str = "votes") -> DataFrame:
    """Count votes per label into fixed-order arrays, one aggregation.

    Each output row has ``ARRAY<DOUBLE>`` of length ``n_labels`` (absent labels
    count 0).  With ``side_col`` one array per side is produced in the same
    pass (``{out_prefix}_{side}``), so gold and predicted distributions need
    no join.  The aggregation is partial + final: a hot key (one item holding
    a third of all votes) is reduced to one small row per map task before the
    shuffle, so skew does not concentrate raw rows on one reducer.
    """
    w = f"CAST(`{count_col}` AS DOUBLE)" if count_col else "1D"

    def arr(cond: str):
        # one SQL expression: n conditional sums, all fused into the partial aggregation
        return F.expr("array(" + ", ".join(
            f"sum(CASE WHEN {cond}`{label_col}` = {k} THEN {w} ELSE 0D END)" for k in range(n_labels)) + ")")

    if side_col is None:
        aggs = [arr("").alias(out_prefix)]
    else:
        aggs = [arr(f"`{side_col}` = {s} AND ").alias(f"{out_prefix}_{s}") for s in sides]
    return df.groupBy(*keys).agg(*aggs)


def label_vocab(df: DataFrame, col: str, out: str = "label") -> DataFrame:
    """The distinct labels of a distribution map over all rows (not only the first)."""
    return df.select(F.explode(F.map_keys(col)).alias(out)).distinct()


def with_levels_many(df: DataFrame, specs: Sequence[tuple[str, str, bool]]) -> DataFrame:
    """Level columns for several ``(l3_col, prefix, normalize)`` at once,
    in three ``withColumns`` steps (one plan analysis per level, not per column)."""
    out = df.withColumns({f"{p}_l3": (D.l1_normalize(c) if n else F.col(c)) for c, p, n in specs})
    out = out.withColumns({f"{p}_l2": D.rollup_level(f"{p}_l3", 2) for _, p, _ in specs})
    return out.withColumns({f"{p}_l1": D.rollup_level(f"{p}_l2", 1) for _, p, _ in specs})


def distances_by_level(df: DataFrame, gold: str, pred: str, metric: str = "js",
                       keys: Sequence[str] = (), levels: Sequence[int] = (1, 2, 3),
                       out: str = "distance") -> DataFrame:
    """Per-instance distance at every level, long form ``(keys..., level, distance)``.

    ``gold``/``pred`` are column prefixes (``{gold}_l1`` ...).  Metrics:
    ``js`` (both smoothed), ``js_scores`` / ``kl_scores`` / ``hellinger_scores``
    (predictions are raw scores: shifted, normalised; see D7), ``js_response``
    (guarded, D12).
    """
    fn = {
        "js": D.smoothed_js,
        "js_scores": D.classifier_js,
        "kl_scores": D.classifier_kl,
        "hellinger_scores": D.classifier_hellinger,
        "js_response": D.response_js,
    }[metric]
    per_level = F.array(*[
        F.struct(F.lit(lv).alias("level"), fn(f"{gold}_l{lv}", f"{pred}_l{lv}").alias(out))
        for lv in levels])
    return df.select(*keys, F.inline(per_level))


def mean_distance(long_df: DataFrame, by: Sequence[str] = ("level",), col: str = "distance",
                  out: str = "mean_distance", digits: int | None = 6) -> DataFrame:
    """Mean distance per level (and any extra grouping keys)."""
    m = F.avg(col)
    if digits is not None:
        m = F.round(m, digits)
    return long_df.groupBy(*by).agg(m.alias(out))
