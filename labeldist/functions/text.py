"""Column functions over text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

# --- fixed values ------------------------------------------------------------
# Characters that count as white space (blank texts, trailing white space):
# the code points for which Python's str.isspace() is true, as ranges.
WHITESPACE_RANGES = [(0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680),
                     (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F),
                     (0x3000, 0x3000)]
# Language suffixes removed from majority labels.
LANG_SUFFIX_PATTERN = "_(en|de|fr|cs)$"
# Question template of the prompt jobs: the two prefixes of the two sentences.
QUESTION_PREFIXES = ("Sentence 1: ", "\nSentence 2: ")
# -----------------------------------------------------------------------------

# regex character class body (Java and RE2 syntax) and the literal characters
WHITESPACE_CLASS = "".join(f"\\x{{{a:02X}}}" if a == b else f"\\x{{{a:02X}}}-\\x{{{b:02X}}}"
                           for a, b in WHITESPACE_RANGES)
WHITESPACE_CHARS = "".join(chr(c) for a, b in WHITESPACE_RANGES for c in range(a, b + 1))


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_markup(c: ColumnOrName, tag: str = "SPEAKER") -> Column:
    """Remove every ``<TAG ...>`` element opening (e.g. speaker markup)."""
    return F.regexp_replace(_c(c), f"<{tag}[^>]*>", "")


def pair_text(a: ColumnOrName, b: ColumnOrName, sep: str = " ") -> Column:
    """``a + ' ' + b``; NULL when either side is NULL (not ``concat_ws``)."""
    return F.concat(_c(a), F.lit(sep), _c(b))


def strip_suffix(c: ColumnOrName, pattern: str = LANG_SUFFIX_PATTERN) -> Column:
    """Remove a language suffix at the end of a label."""
    return F.regexp_replace(_c(c), pattern, "")


def short_name(c: ColumnOrName) -> Column:
    """Last ``/``-separated segment of a model or run name."""
    return F.regexp_extract(_c(c), "[^/]+$", 0)


def rstrip(c: ColumnOrName) -> Column:
    """Python-style ``rstrip()``: remove trailing Unicode white space.

    ``TRIM(TRAILING chars FROM ...)`` scans from the end of the string only,
    so it costs the length of the trailing run, not of the text."""
    return F.rtrim(_c(c), F.lit(WHITESPACE_CHARS))


def is_blank(c: ColumnOrName) -> Column:
    """F3 predicate: NULL, empty or white space only (Unicode white space)."""
    x = _c(c)
    return x.isNull() | ~x.rlike(f"[^{WHITESPACE_CLASS}]")


def line(text: ColumnOrName, n: int, sep: str = "\n") -> Column:
    """The ``n``-th line (1-based) of a text; ``''`` when the text has fewer
    lines.  Uses byte-level ``substring_index`` scans that stop after the
    ``n``-th separator, instead of splitting the whole (possibly very long)
    text into an array of lines."""
    t = _c(text)
    if n == 1:
        return F.substring_index(t, sep, 1)
    has = F.octet_length(F.substring_index(t, sep, n - 1)) < F.octet_length(t)
    return F.when(t.isNull(), F.lit(None)).when(
        has, F.substring_index(F.substring_index(t, sep, n), sep, -1)).otherwise(F.lit(""))


def format_question(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Q2: the user question of a prompt for an argument pair (NULL when a
    sentence is missing)."""
    return F.concat(F.lit(QUESTION_PREFIXES[0]), _c(a), F.lit(QUESTION_PREFIXES[1]), _c(b))
