"""Text cleaning (H1-H5): JVM regular expressions, Unicode-aware.

Whitespace follows the definition of the cleaning rules being matched
(``str.isspace``), so it is spelled out as an explicit class rather than
Java's ASCII ``\\s``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwright.functions.columns import q

# Characters counted as whitespace (fixed values, code points).
WHITESPACE = ("\\t\\n\\x0B\\f\\r\\x1C\\x1D\\x1E\\x1F \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}"
              "\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}")
SPECIAL = f"[^a-zA-Z0-9{WHITESPACE}]"
DIGITS = "\\p{Nd}+"
EDGES = f"^[{WHITESPACE}]+|[{WHITESPACE}]+$"

OPERATIONS = ("lowercase", "remove_special", "remove_numbers", "strip")


def lowercase(c: Column) -> Column:
    return F.lower(c)


def remove_special(c: Column) -> Column:
    return F.regexp_replace(c, SPECIAL, "")


def remove_numbers(c: Column) -> Column:
    return F.regexp_replace(c, DIGITS, "")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, EDGES, "")


_OPS = {"lowercase": lowercase, "remove_special": remove_special,
        "remove_numbers": remove_numbers, "strip": strip}


def clean_expr(c: Column, operations: Sequence[str]) -> Column:
    """Fold the operations, in the given order, into one expression."""
    for op in operations:
        if op not in _OPS:
            raise ValueError(f"unknown text operation {op!r}")
        c = _OPS[op](c)
    return c


def clean_text(df: DataFrame, columns: Sequence[str], operations: Sequence[str]) -> DataFrame:
    cs = set(columns)
    return df.select(*[clean_expr(q(c), operations).alias(c) if c in cs else q(c) for c in df.columns])
