"""Postfix Boolean queries compiled to one Column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column

OPERATORS: dict[str, Callable[[Column, Column], Column]] = {"AND": lambda a, b: a & b, "OR": lambda a, b: a | b}


def parse_postfix(query: str) -> list[str]:
    """Checked items of a postfix query: terms and the operators AND, OR.

    Raises ValueError if an operator lacks operands, or if not exactly one operand is left at the end.
    """
    items, depth = query.split(), 0
    for item in items:
        if item in OPERATORS:
            if depth < 2:
                raise ValueError(f"{item} lacks operands in {query!r}")
            depth -= 1
        else:
            depth += 1
    if depth != 1:
        raise ValueError(f"{query!r} leaves {depth} operands instead of one")
    return items


def compile_postfix(items: list[str], leaf: Callable[[str], Column]) -> Column:
    """One predicate for a checked query; ``leaf`` turns a term into its predicate."""
    stack: list[Column] = []
    for item in items:
        if item in OPERATORS:
            right, left = stack.pop(), stack.pop()
            stack.append(OPERATORS[item](left, right))
        else:
            stack.append(leaf(item))
    return stack[0]
