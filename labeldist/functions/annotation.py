"""Column functions for pipe-delimited stand-off annotation lines
(P10, P11, P13, P14, P15).  Inputs: column names, SQL text or results of
labeldist functions (see :mod:`labeldist.functions.distributions`)."""

from __future__ import annotations

from pyspark.sql import Column

from labeldist.functions.distributions import Expr, _out, _var, let_sql, sql_lit, sql_of

# --- fixed values ------------------------------------------------------------
# 0-based positions of the fields read from an annotation line.
FIELD_RELATION = 0
FIELD_CONNECTIVE = 7
FIELD_SENSE = 8
FIELD_CONNECTIVE_2 = 10
FIELD_SENSE_2 = 11
FIELD_ARG1_SPANS = 14
FIELD_ARG2_SPANS = 20
# Relation type whose lines may carry a second connective / sense.
SECOND_SENSE_RELATION = "Implicit"
SPAN_PATTERN = "(\\d+)\\.\\.(\\d+)"
# -----------------------------------------------------------------------------


def field_sql(line: str, i: int) -> str:
    return f"nullif(split_part({line}, '|', {i + 1}), '')"


def field(line: Expr, i: int) -> Column:
    """0-based positional field of a ``|``-separated line; empty/missing -> NULL."""
    return _out(field_sql(sql_of(line), i))


def parse_annotation(line: Expr) -> Column:
    """P10: strict positional parse -> struct(relation, connective, sense,
    arg1_spans, arg2_spans).  A short or malformed line gives NULL fields
    instead of sliding to a later field."""
    return _out(let_sql(sql_of(line), lambda l: (
        f"named_struct('relation', {field_sql(l, FIELD_RELATION)}, "
        f"'connective', {field_sql(l, FIELD_CONNECTIVE)}, 'sense', {field_sql(l, FIELD_SENSE)}, "
        f"'arg1_spans', {field_sql(l, FIELD_ARG1_SPANS)}, 'arg2_spans', {field_sql(l, FIELD_ARG2_SPANS)})")))


def parse_second_sense(line: Expr, relation: Expr | None = None) -> Column:
    """Optional second connective and sense, only on implicit lines."""
    def body(l: str) -> str:
        rel = sql_of(relation) if relation is not None else field_sql(l, FIELD_RELATION)
        ok = f"{rel} = '{SECOND_SENSE_RELATION}'"
        return (f"named_struct('multi_connective', CASE WHEN {ok} THEN {field_sql(l, FIELD_CONNECTIVE_2)} END, "
                f"'multi_sense', CASE WHEN {ok} THEN {field_sql(l, FIELD_SENSE_2)} END)")
    return _out(let_sql(sql_of(line), body))


def split_sense(c: Expr, prefix: str = "sense") -> Column:
    """Dotted sense path -> struct(<prefix>1, <prefix>2, <prefix>3,
    <prefix>_final); ``final`` is the deepest level present."""
    def body(parts: str) -> str:
        l1 = f"nullif({parts}[0], '')"
        l2 = f"CASE WHEN size({parts}) >= 2 THEN nullif({parts}[1], '') END"
        l3 = f"CASE WHEN size({parts}) >= 3 THEN nullif({parts}[2], '') END"
        return (f"named_struct('{prefix}1', {l1}, '{prefix}2', {l2}, '{prefix}3', {l3}, "
                f"'{prefix}_final', coalesce({l3}, {l2}))")
    return _out(let_sql(f"split({sql_of(c)}, {sql_lit(chr(92) + '.')}, 3)", body))


def parse_spans_sql(c: str) -> str:
    m = _var("m")
    pat = sql_lit(SPAN_PATTERN)
    return (f"transform(regexp_extract_all({c}, {pat}, 0), {m} -> named_struct("
            f"'b', CAST(regexp_extract({m}, {pat}, 1) AS INT), 'e', CAST(regexp_extract({m}, {pat}, 2) AS INT)))")


def parse_spans(c: Expr) -> Column:
    """``"b..e;b..e"`` -> ARRAY<STRUCT<b INT, e INT>> (0-based, end exclusive)."""
    return _out(parse_spans_sql(sql_of(c)))


def slice_spans(text: Expr, spans: Expr, sep: str = " ") -> Column:
    """The pieces of ``text`` covered by the spans, joined by one blank."""
    def body(t: str) -> str:
        s = _var("s")
        return (f"array_join(transform({sql_of(spans)}, {s} -> substring({t}, {s}.b + 1, {s}.e - {s}.b)), "
                f"{sql_lit(sep)})")
    return _out(let_sql(sql_of(text), body))
