"""Which of overlapping candidates is reported: a fold over a text's candidates, in a total order."""

from __future__ import annotations

from ..functions import sql as F
from ..functions.sql import Expr

ORDER = ["priority", "start", "end", "rule_key", "rule_id"]


def overlaps(a: Expr, b: Expr) -> Expr:
    """Half-open spans that share a character."""
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def arrival(candidates: Expr) -> Expr:
    """Candidates in the order of arrival: by check, rule and place. Those without a place are left out."""
    keyed = F.transform(F.filter(candidates, lambda c: c["start"] >= 0), lambda c: F.struct(c["rule_key"].alias("k"), c["rule_id"].alias("r"), c["start"].alias("s"), c["end"].alias("e"), c.alias("c")))
    return F.transform(F.array_sort(keyed), lambda x: x["c"])


def groups(candidates: Expr, kind: str) -> Expr:
    """Each candidate joins the first group that has a member it overlaps, else begins one; groups never
    merge. kind: the candidates' SQL type."""
    empty = F.array().cast(f"array<array<{kind}>>")

    def add(gs: Expr, c: Expr) -> Expr:
        hit = lambda g: F.exists(g, lambda x: overlaps(x, c))
        at = F.array_position(F.transform(gs, hit), F.lit(True))
        joined = F.transform(gs, lambda g, i: F.when(i + 1 == at, F.concat(g, F.array(c))).otherwise(g))
        return F.when(at > 0, joined).otherwise(F.concat(gs, F.array(F.array(c))))

    return F.aggregate(candidates, empty, add)


def winner(group: Expr) -> Expr:
    """The first by priority, then by place and name."""
    keyed = F.transform(group, lambda c: F.struct(*(c[k].alias(k) for k in ORDER), c.alias("c")))
    return F.array_min(keyed)["c"]


def resolved(candidates: Expr, kind: str) -> Expr:
    """The winners of all groups. kind: the candidates' SQL type."""
    return F.transform(groups(arrival(candidates), kind), winner)
