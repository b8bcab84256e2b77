"""Conditions on what is near a candidate: semi-, anti- and band joins of spans within a text."""

from __future__ import annotations

from collections.abc import Callable

from ..functions import sql as F
from ..functions.sql import Expr

from ..functions.core import all_of, any_of, let
from ..functions.regex import find_if_any
from ..functions.text import line_at, line_number
from ..spec.model import Aux, Combined

#: A condition: from the arrays of auxiliary matches and the candidate to a boolean.
Condition = Callable[[Expr], Expr]


def before(c: Expr, a: Expr) -> Expr:
    return a["end"] <= c["start"]


def after(c: Expr, a: Expr) -> Expr:
    return a["start"] >= c["end"]


def around(c: Expr, a: Expr) -> Expr:
    """On either side; what overlaps the candidate doesn't count."""
    return before(c, a) | after(c, a)


SIDES = {"before": before, "after": after, "around": around}


def within(start: Expr, end: Expr, other_start: Expr, other_end: Expr, distance: int) -> Expr:
    """Whether spans overlap, touch, or are at most so far apart."""
    touching = (end >= other_start) & (start <= other_end)
    return touching | (F.least(F.abs(end - other_start), F.abs(other_end - start)) <= distance)


def aux_holds(aux: Aux, content: Expr, c: Expr, matches: Expr) -> Expr:
    """Whether one of the auxiliary matches is where the condition wants it."""

    def near(a: Expr) -> Expr:
        ok = SIDES[aux.side](c, a)
        if aux.max_chars is not None:
            ok = ok & within(a["start"], a["end"], c["start"], c["end"], aux.max_chars)
        if aux.max_lines is not None:
            line = lambda at: line_number(content, at)
            ok = ok & within(line(a["start"]), line(a["end"]), line(c["start"]), line(c["end"]), aux.max_lines)
        return ok

    found = F.exists(matches, near)
    if aux.max_lines is not None:
        found = (F.length(line_at(content, c["start"])) < aux.max_line_length) & found
    return found


def patterns_of(context: Aux | Combined | None) -> list[Aux]:
    if context is None:
        return []
    return [context] if isinstance(context, Aux) else [a for p in context.parts for a in patterns_of(p)]


def holds(context: Aux | Combined, content: Expr, c: Expr, matches: dict[Aux, Expr]) -> Expr:
    if isinstance(context, Aux):
        return aux_holds(context, content, c, matches[context])
    parts = [holds(p, content, c, matches) for p in context.parts]
    if context.kind == "each":
        return all_of(parts)
    return any_of(parts) if context.kind == "either" else ~parts[0]


def filtered(candidates: Expr, context: Aux | Combined | None, content: Expr) -> Expr:
    """The candidates for which the context holds; its patterns are searched once a text, and only if there
    are candidates."""
    if context is None:
        return candidates
    auxes = list(dict.fromkeys(patterns_of(context)))
    found = F.struct(*(F.filter(find_if_any(content, a.pattern), lambda m: m["start"] >= 0).alias(f"a{i}") for i, a in enumerate(auxes)))

    def keep(cs: Expr) -> Expr:
        return let(found, lambda m: F.filter(cs, lambda c: holds(context, content, c, {a: m[f"a{i}"] for i, a in enumerate(auxes)})))

    return let(candidates, lambda cs: F.when(F.size(cs) > 0, keep(cs)).otherwise(cs))
