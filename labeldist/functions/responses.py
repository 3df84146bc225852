"""Column functions for model responses (Q3): is a text a list literal of
exactly ``n`` float literals summing to 1?

Built as one SQL expression (regular expressions and higher-order array
functions, all JVM-side); intermediate values are bound once with
:func:`labeldist.functions.distributions.let_sql`.
"""

from __future__ import annotations

from pyspark.sql import Column

from labeldist.functions.distributions import Expr, _out, _var, let_sql, sql_of

# --- fixed values ------------------------------------------------------------
N_SENSES = 28
SUM_TOLERANCE = 1e-4
# A numeric literal, and a float literal (needs a decimal point or exponent).
NUMBER_PATTERN = "[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?"
FLOAT_PATTERN = "[+-]?(\\d+\\.\\d*([eE][+-]?\\d+)?|\\.\\d+([eE][+-]?\\d+)?|\\d+[eE][+-]?\\d+)"
# Reasons, in the order the checks are made.
REASONS = ["not_list", "length", "not_float", "sum"]
# -----------------------------------------------------------------------------

_LEAD = "^\\s+"
_TRAIL = "\\s+$"
_LIST = "^\\[[\\s\\S]*\\]$"
_INNER = "^\\[([\\s\\S]*)\\]$"
_TRIM = "^\\s+|\\s+$"
_SPACE = "\\s"


def _lit(s: str) -> str:
    """A Spark SQL string literal for ``s`` (backslashes and quotes escaped)."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def list_elements_sql(c: str) -> str:
    """Elements of a ``[a, b, ...]`` literal as trimmed strings; NULL when the
    text is not bracketed.  A trailing comma is allowed, ``[]`` is empty."""
    stripped = f"regexp_replace(regexp_replace({c}, {_lit(_LEAD)}, ''), {_lit(_TRAIL)}, '')"

    def on_inner(inner: str) -> str:
        x = _var("x")
        parts = f"transform(split({inner}, ','), {x} -> regexp_replace({x}, {_lit(_TRIM)}, ''))"
        return let_sql(parts, lambda el: (
            f"CASE WHEN regexp_replace({inner}, {_lit(_SPACE)}, '') = '' THEN CAST(array() AS ARRAY<STRING>) "
            f"WHEN element_at({el}, -1) = '' THEN slice({el}, 1, size({el}) - 1) ELSE {el} END"))

    return let_sql(stripped, lambda s: (
        f"CASE WHEN {s} RLIKE {_lit(_LIST)} THEN "
        f"{let_sql(f'regexp_extract({s}, {_lit(_INNER)}, 1)', on_inner)} END"))


def list_elements(c: Expr) -> Column:
    return _out(list_elements_sql(sql_of(c)))


def validate_response_sql(c: str, n: int = N_SENSES, tol: float = SUM_TOLERANCE) -> str:
    def on_el(el: str) -> str:
        x, y, z, a, b = (_var(p) for p in "xyzab")
        probs = f"transform({el}, {x} -> try_cast({x} AS DOUBLE))"
        total = f"aggregate({probs}, 0D, ({a}, {b}) -> {a} + {b})"
        reason = (f"CASE WHEN {el} IS NULL OR NOT forall({el}, {y} -> {y} RLIKE {_lit('^' + NUMBER_PATTERN + '$')}) "
                  f"THEN 'not_list' WHEN size({el}) <> {n} THEN 'length' "
                  f"WHEN NOT forall({el}, {z} -> {z} RLIKE {_lit('^' + FLOAT_PATTERN + '$')}) THEN 'not_float' "
                  f"WHEN abs({total} - 1D) >= {float(tol)!r}D THEN 'sum' END")
        return let_sql(reason, lambda r: (
            f"named_struct('valid', {r} IS NULL, 'reason', {r}, "
            f"'probs', CASE WHEN {r} IS NULL THEN {probs} END)"))
    return let_sql(list_elements_sql(c), on_el)


def validate_response(c: Expr, n: int = N_SENSES, tol: float = SUM_TOLERANCE) -> Column:
    """Q3: ``struct(valid, reason, probs)``.

    Checks, in order: a bracketed list of numbers (``not_list``), exactly
    ``n`` elements (``length``), every element a float literal -- an integer
    such as ``1`` fails (``not_float``) -- and a sum within ``tol`` of 1
    (``sum``).  Negative floats are accepted.  ``probs`` is set only when
    valid.
    """
    return _out(validate_response_sql(sql_of(c), n, tol))
