"""The three-level sense taxonomy (28 fine senses -> 17 -> 4).

Everything downstream addresses labels by *index* into fixed-order arrays;
this module is the single place where the order is defined.  The taxonomy is
tiny and fixed (28 rows), so it is safe to broadcast it anywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: must equal the corpus layout for results to line up -----
# Level-1 senses, in order.
L1_NAMES = ["temporal", "contingency", "comparison", "expansion"]

# Level-2 senses, in order, with the index of their level-1 parent.
L2_NAMES = [
    "synchronous", "asynchronous", "cause", "condition", "neg-condition",
    "purpose", "concession", "contrast", "similarity", "conjunction",
    "disjunction", "equivalence", "exception", "instantiation",
    "level-of-detail", "manner", "substitution",
]
L2_PARENT = [0, 0, 1, 1, 1, 1, 2, 2, 2, 3, 3, 3, 3, 3, 3, 3, 3]

# Level-3 senses (column names of the 60-column layout), in order, with the
# index of their level-2 parent.  Senses whose level-2 parent has no finer
# split carry the "_3" suffix.
L3_NAMES = [
    "synchronous_3", "precedence", "succession", "reason", "result",
    "arg1-as-cond", "arg2-as-cond", "arg1-as-negcond", "arg2-as-negcond",
    "arg1-as-goal", "arg2-as-goal", "arg1-as-denier", "arg2-as-denier",
    "contrast_3", "similarity_3", "conjunction_3", "disjunction_3",
    "equivalence_3", "arg1-as-excpt", "arg2-as-excpt", "arg1-as-instance",
    "arg2-as-instance", "arg1-as-detail", "arg2-as-detail", "arg1-as-manner",
    "arg2-as-manner", "arg1-as-subst", "arg2-as-subst",
]
L3_PARENT = [0, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 6, 6, 7, 8, 9, 10, 11, 12, 12,
             13, 13, 14, 14, 15, 15, 16, 16]

# The label that is present in crowd distributions but excluded before
# normalising ("no relation").
EXCLUDED_LABEL = "norel"

# Level-1 / level-2 vocabularies of the stand-off annotation corpus, used by
# the one-hot encoder (they differ from the crowd corpus vocabulary).
STANDOFF_L1 = ["Temporal", "Contingency", "Comparison", "Expansion"]
STANDOFF_L2 = [
    "Synchronous", "Asynchronous", "Cause", "Condition", "Purpose",
    "Concession", "Contrast", "Similarity", "Conjunction", "Equivalence",
    "Instantiation", "Level-of-detail", "Manner", "Substitution", "Exception",
    "Disjunction", "Negative-Condition", "Cause+Belief", "Cause+SpeechAct",
    "Condition+SpeechAct", "Concession+SpeechAct",
]
# ---------------------------------------------------------------------------

N_L1, N_L2, N_L3 = len(L1_NAMES), len(L2_NAMES), len(L3_NAMES)
LEVEL_SIZES = {1: N_L1, 2: N_L2, 3: N_L3}
LEVEL_NAMES = {1: L1_NAMES, 2: L2_NAMES, 3: L3_NAMES}


def source_key(l3_name: str) -> str:
    """Key of a level-3 sense inside a crowd distribution literal.

    Single-child senses appear under their level-2 name in the source data.
    """
    return l3_name[:-2] if l3_name.endswith("_3") else l3_name


L3_SOURCE_KEYS = [source_key(n) for n in L3_NAMES]


def groups(level: int) -> list[list[int]]:
    """Child indices (one level finer) of every sense at ``level`` (1 or 2)."""
    if level == 2:
        parent, n = L3_PARENT, N_L2
    elif level == 1:
        parent, n = L2_PARENT, N_L1
    else:
        raise ValueError("roll-up target level must be 1 or 2")
    out: list[list[int]] = [[] for _ in range(n)]
    for child, p in enumerate(parent):
        out[p].append(child)
    return out


def single_child_l2() -> list[int]:
    """Level-2 senses with exactly one level-3 child (carried down, D6)."""
    return [i for i, g in enumerate(groups(2)) if len(g) == 1]


def taxonomy_df(spark: SparkSession) -> DataFrame:
    """28-row dimension table ``(l3_idx, l3, l3_key, l2_idx, l2, l1_idx, l1)``.

    Small and fixed, so callers join it with ``F.broadcast``.
    """
    rows = []
    for i, name in enumerate(L3_NAMES):
        p2 = L3_PARENT[i]
        p1 = L2_PARENT[p2]
        rows.append((i, name, source_key(name), p2, L2_NAMES[p2], p1, L1_NAMES[p1]))
    return spark.createDataFrame(
        rows,
        "l3_idx INT, l3 STRING, l3_key STRING, l2_idx INT, l2 STRING, l1_idx INT, l1 STRING",
    )
