"""Small helpers over columns and arrays."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from . import sql as F
from .sql import Expr


def let(value: Expr, body: Callable[[Expr], Expr]) -> Expr:
    """body(value) with value evaluated once, even inside higher-order functions."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def any_of(conditions: list[Expr]) -> Expr:
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(False)


def all_of(conditions: list[Expr]) -> Expr:
    return reduce(lambda a, b: a & b, conditions) if conditions else F.lit(True)


def strings(values: list[str]) -> Expr:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")
