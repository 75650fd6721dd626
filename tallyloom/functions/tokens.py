"""Tokens of a line as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The two token styles: vertical tab separates tokens in "blanks" only.
DELIMITERS = {"java": "[ \\t\\n\\r\\f]+", "blanks": "[ \\t\\n\\x0B\\f\\r]+"}


def tokens(line: Column, style: str = "blanks") -> Column:
    """Array of the tokens of ``line`` in order, repeats included; empty for blank and null lines."""
    parts = F.split(F.coalesce(line, F.lit("")), DELIMITERS[style], -1)
    return F.array_remove(parts, "")


def distinct_tokens(line: Column, style: str = "blanks") -> Column:
    """Array of the different tokens of ``line``, sorted by code points."""
    return F.array_sort(F.array_distinct(tokens(line, style)))


def alphabetic(term: Column) -> Column:
    """Whether the whole term consists of ASCII letters."""
    return term.rlike("\\A[A-Za-z]+\\z")
