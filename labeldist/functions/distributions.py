"""Column functions over label distributions (arrays of doubles).

A distribution is a fixed-order ``ARRAY<DOUBLE>`` (order given by
:mod:`labeldist.taxonomy` or by a caller's vocabulary); missing values are SQL
``NULL``, never ``NaN``.  Every function is a JVM-side SQL expression
(``transform``, ``aggregate``, ``zip_with``, ``array_max`` ...); no Python
runs per row.

Inputs are column names, SQL expression text, or the result of another
function of this module; results are ``Column``s.  Expressions are composed
as SQL text and handed to Spark in one piece, which keeps plan construction
cheap (one call per function instead of one per element).  A per-row value
needed inside an element-wise lambda (a total, a minimum, the input array
itself) is bound once with :func:`let_sql`, so nothing is evaluated twice.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from labeldist import taxonomy as tx

Expr = Column | str

DEFAULT_MARGIN = 0.001  # smoothing margin of the distance metrics (fixed value)
_LN2 = f"{math.log(2.0)!r}D"
_SQRT2 = f"{math.sqrt(2.0)!r}D"
_SIMPLE = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)*$")
_ids = itertools.count()


def _var(prefix: str) -> str:
    return f"{prefix}{next(_ids)}"


def sql_of(c: Expr) -> str:
    """SQL text of an input (name, SQL text, or a result of this module)."""
    if isinstance(c, str):
        return c
    t = getattr(c, "__dict__", {}).get("_labeldist_sql")
    if t is None:
        raise TypeError("pass a column name, SQL expression text, or a labeldist expression")
    return t


def sql_lit(s: str) -> str:
    """A Spark SQL string literal for ``s`` (backslashes and quotes escaped)."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _out(sql: str) -> Column:
    col = F.expr(sql)
    col.__dict__["_labeldist_sql"] = sql
    return col


def let_sql(value: str, body: Callable[[str], str]) -> str:
    """Bind ``value`` once per row to a lambda variable used by ``body``.

    A one-element ``transform``; simple column references are used as is."""
    if _SIMPLE.match(value):
        return body(value)
    v = _var("v")
    return f"element_at(transform(array({value}), {v} -> {body(v)}), 1)"


def _sum_sql(arr: str) -> str:
    a, x = _var("acc"), _var("x")
    return f"aggregate({arr}, 0D, ({a}, {x}) -> {a} + {x})"


# ---------------------------------------------------------------- parsing ---

def parse_distribution(c: Expr) -> Column:
    """P5: ``"{'a': 0.1, 'b': 0.9}"`` -> ``MAP<STRING, DOUBLE>``; single quotes
    accepted, an unparseable literal gives NULL, duplicate keys do not fail."""
    return _out(f"from_json({sql_of(c)}, 'map<string,double>', map('allowSingleQuotes', 'true'))")


def parse_list(c: Expr) -> Column:
    """``"['en', 'de']"`` -> ``ARRAY<STRING>``."""
    return _out(f"from_json({sql_of(c)}, 'array<string>', map('allowSingleQuotes', 'true'))")


def parse_vector(c: Expr) -> Column:
    """``"[0.1, -2.0, ...]"`` -> ``ARRAY<DOUBLE>``."""
    return _out(f"from_json({sql_of(c)}, 'array<double>')")


def exclude_label(m: Expr, label: str = tx.EXCLUDED_LABEL) -> Column:
    """Drop one key (the excluded ``norel`` label) from a distribution map."""
    k, v = _var("k"), _var("w")
    return _out(f"map_filter({sql_of(m)}, ({k}, {v}) -> {k} <> '{label}')")


def align_distribution(m: Expr, vocab: Sequence[str]) -> Column:
    """Map -> fixed-order array over ``vocab``; absent keys become NULL."""
    return _out(let_sql(sql_of(m), lambda mm: "array(" + ", ".join(
        f"CAST({mm}['{k}'] AS DOUBLE)" for k in vocab) + ")"))


def to_prob(c: Expr) -> Column:
    """Text -> double; empty or unparseable text -> NULL."""
    return _out(f"try_cast(nullif({sql_of(c)}, '') AS DOUBLE)")


# ------------------------------------------------------------ normalising ---

def total_sql(arr: str) -> str:
    """Sum of absolute values, NULL elements counted as 0 (the L1 norm)."""
    a, x = _var("acc"), _var("x")
    return f"aggregate({arr}, 0D, ({a}, {x}) -> {a} + coalesce(abs({x}), 0D))"


def l1_normalize_sql(arr: str) -> str:
    def body(a: str) -> str:
        x = _var("x")
        # a zero total means every non-NULL element is 0: the array stays as it is
        return let_sql(total_sql(a), lambda t: (
            f"CASE WHEN {t} = 0 THEN {a} ELSE transform({a}, {x} -> {x} / {t}) END"))
    return let_sql(arr, body)


def l1_normalize(arr: Expr) -> Column:
    """Divide by the L1 norm; NULL elements stay NULL, zero-sum rows stay zero."""
    return _out(l1_normalize_sql(sql_of(arr)))


def shift_normalize_sql(arr: str) -> str:
    def body(a: str) -> str:
        x = _var("x")
        return let_sql(f"array_min({a})", lambda mn: l1_normalize_sql(f"transform({a}, {x} -> {x} - {mn})"))
    return let_sql(arr, body)


def shift_normalize(arr: Expr) -> Column:
    """Subtract the row minimum (scores become >= 0), then L1-normalise."""
    return _out(shift_normalize_sql(sql_of(arr)))


def smooth_sql(arr: str, margin: float = DEFAULT_MARGIN) -> str:
    x = _var("x")
    return l1_normalize_sql(f"transform({arr}, {x} -> {x} + {float(margin)!r}D)")


def smooth(arr: Expr, margin: float = DEFAULT_MARGIN) -> Column:
    """Add ``margin`` to every element and renormalise."""
    return _out(smooth_sql(sql_of(arr), margin))


def softmax(arr: Expr) -> Column:
    """Softmax of a score vector (our option; the default pipeline uses D7)."""
    def body(a: str) -> str:
        x = _var("x")
        return let_sql(f"array_max({a})", lambda mx: l1_normalize_sql(f"transform({a}, {x} -> exp({x} - {mx}))"))
    return _out(let_sql(sql_of(arr), body))


# ---------------------------------------------------------------- roll-up ---

def rollup_level_sql(arr: str, level: int) -> str:
    return let_sql(arr, lambda a: "array(" + ", ".join(
        " + ".join(f"{a}[{i}]" for i in children) for children in tx.groups(level)) + ")")


def rollup_level(arr: Expr, level: int) -> Column:
    """Roll a distribution one level up the taxonomy.

    ``level=2`` maps 28 fine senses to 17, ``level=1`` maps 17 to 4.  Plain
    unrolled ``+`` (code-generated, NULL-propagating: a parent is NULL when
    any child is NULL)."""
    return _out(rollup_level_sql(sql_of(arr), level))


def complete_level3(l2: Expr) -> Column:
    """Level-3 values of the single-child senses, copied from level 2."""
    return _out(let_sql(sql_of(l2), lambda a: "array(" + ", ".join(
        f"{a}[{i}]" for i in tx.single_child_l2()) + ")"))


def argmax_idx_sql(arr: str) -> str:
    return let_sql(arr, lambda a: (
        f"CASE WHEN array_max({a}) IS NULL THEN CAST(NULL AS INT) "
        f"ELSE CAST(array_position({a}, array_max({a})) AS INT) - 1 END"))


def argmax_idx(arr: Expr) -> Column:
    """0-based index of the first maximum; NULLs skipped; all-NULL -> NULL."""
    return _out(argmax_idx_sql(sql_of(arr)))


def argmax_label(arr: Expr, names: Sequence[str]) -> Column:
    """Name of the first maximum (majority label); all-NULL -> NULL."""
    lits = "array(" + ", ".join(f"'{n}'" for n in names) + ")"
    return _out(let_sql(sql_of(arr), lambda a: (
        f"CASE WHEN array_max({a}) IS NULL THEN CAST(NULL AS STRING) "
        f"ELSE element_at({lits}, CAST(array_position({a}, array_max({a})) AS INT)) END")))


# -------------------------------------------------------------- distances ---

def _rel_entr(x: str, y: str) -> str:
    # x*ln(x/y); 0 when x == 0; +inf when y == 0 < x (elementwise relative entropy); NULL if either is
    return (f"CASE WHEN {x} IS NULL OR {y} IS NULL THEN CAST(NULL AS DOUBLE) "
            f"WHEN {x} > 0 AND {y} > 0 THEN {x} * ln({x} / {y}) "
            f"WHEN {x} = 0 AND {y} >= 0 THEN 0D ELSE double('inf') END")


def _js_term(x: str, y: str) -> str:
    # rel_entr(x, m) with m = (x + y) / 2, written with s = x + y: the tests
    # m > 0 / m >= 0 become s > 0 / s >= 0 and x / m == 2x / s exactly
    # (scaling by 2 is exact), so m itself is never formed
    return (f"CASE WHEN {x} IS NULL OR {y} IS NULL THEN CAST(NULL AS DOUBLE) "
            f"WHEN {x} > 0 AND {x} + {y} > 0 THEN {x} * ln(2D * {x} / ({x} + {y})) "
            f"WHEN {x} = 0 AND {x} + {y} >= 0 THEN 0D ELSE double('inf') END")


def kl_sql(p: str, q: str, normalized: bool = False) -> str:
    a, b = _var("a"), _var("b")
    pn, qn = (p, q) if normalized else (l1_normalize_sql(p), l1_normalize_sql(q))
    terms = f"zip_with({pn}, {qn}, ({a}, {b}) -> {_rel_entr(a, b)})"
    return f"{_sum_sql(terms)} / {_LN2}"


def kl_distance(p: Expr, q: Expr) -> Column:
    """Kullback-Leibler divergence KL(p || q) in bits (inputs normalised first)."""
    return _out(kl_sql(sql_of(p), sql_of(q)))


def js_sql(p: str, q: str, normalized: bool = False) -> str:
    """``normalized=True`` skips re-normalising inputs that already sum to 1
    (outputs of :func:`smooth_sql`), saving two passes over each array."""
    a, b = _var("a"), _var("b")
    pn, qn = (p, q) if normalized else (l1_normalize_sql(p), l1_normalize_sql(q))
    terms = f"zip_with({pn}, {qn}, ({a}, {b}) -> {_js_term(a, b)} + {_js_term(b, a)})"
    # greatest() skips NULLs, so a NULL divergence (a NULL array or element) is passed on by hand
    return let_sql(f"{_sum_sql(terms)} / {_LN2} / 2D",
                   lambda d: f"CASE WHEN {d} IS NOT NULL THEN sqrt(greatest(0D, {d})) END")


def js_distance(p: Expr, q: Expr) -> Column:
    """Jensen-Shannon *distance* (square root of the divergence), base 2.

    Both inputs are L1-normalised first.  Rounding can make the divergence a
    hair below zero for near-identical inputs; it is clamped at 0.  A NULL
    array or element gives NULL.
    """
    return _out(js_sql(sql_of(p), sql_of(q)))


def hellinger_sql(p: str, q: str) -> str:
    a, b = _var("a"), _var("b")
    sq = f"zip_with({p}, {q}, ({a}, {b}) -> pow(sqrt({a}) - sqrt({b}), 2))"
    return f"sqrt({_sum_sql(sq)}) / {_SQRT2}"


def hellinger_distance(p: Expr, q: Expr) -> Column:
    """sqrt(sum((sqrt p - sqrt q)^2)) / sqrt(2), inputs taken as given."""
    return _out(hellinger_sql(sql_of(p), sql_of(q)))


def is_bad_sql(c: str) -> str:
    return let_sql(c, lambda d: f"({d} IS NULL OR isnan({d}) OR abs({d}) = double('inf'))")


def is_bad_distance(c: Expr) -> Column:
    """True when a distance is NULL, NaN or infinite."""
    return _out(is_bad_sql(sql_of(c)))


def guard_sql(c: str, fallback: float = 1.0) -> str:
    return let_sql(c, lambda d: (f"CASE WHEN {d} IS NULL OR isnan({d}) OR abs({d}) = double('inf') "
                                 f"THEN {float(fallback)!r}D ELSE {d} END"))


def guard_distance(c: Expr, fallback: float = 1.0) -> Column:
    """Replace a non-finite distance by ``fallback`` (1.0)."""
    return _out(guard_sql(sql_of(c), fallback))


def classifier_js(gold: Expr, scores: Expr, margin: float = DEFAULT_MARGIN) -> Column:
    """JS distance between a gold distribution and raw classifier scores:
    gold is smoothed, scores are shifted to >= 0, normalised and smoothed."""
    return _out(js_sql(smooth_sql(sql_of(gold), margin), smooth_sql(shift_normalize_sql(sql_of(scores)), margin),
                       normalized=True))


def classifier_kl(gold: Expr, scores: Expr, margin: float = DEFAULT_MARGIN) -> Column:
    """KL distance with the same preparation as :func:`classifier_js`."""
    return _out(kl_sql(smooth_sql(sql_of(gold), margin), smooth_sql(shift_normalize_sql(sql_of(scores)), margin),
                       normalized=True))


def classifier_hellinger(gold: Expr, scores: Expr) -> Column:
    """Hellinger distance: gold unsmoothed, scores shifted and normalised only."""
    return _out(hellinger_sql(sql_of(gold), shift_normalize_sql(sql_of(scores))))


def smoothed_js(p: Expr, q: Expr, margin: float = DEFAULT_MARGIN) -> Column:
    """JS distance of two distributions, both smoothed first."""
    return _out(js_sql(smooth_sql(sql_of(p), margin), smooth_sql(sql_of(q), margin), normalized=True))


def response_js(gold: Expr, pred: Expr, margin: float = DEFAULT_MARGIN) -> Column:
    """JS distance of a model response: both sides smoothed, then guarded."""
    return _out(guard_sql(js_sql(smooth_sql(sql_of(gold), margin), smooth_sql(sql_of(pred), margin),
                                 normalized=True)))
