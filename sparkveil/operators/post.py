"""Conditions on a candidate's own text, with the reason of a rejection and filters that only mark."""

from __future__ import annotations

import re

import numpy as np
from ..functions import sql as F
from ..functions.sql import Expr

from ..functions.core import all_of, any_of, let
from ..functions.regex import groups_of
from ..functions.text import decode_base64, entropy
from ..spec.model import Decoded, Post

#: Filters that can be set to mark a candidate instead of rejecting it, in the order of messages.
SKIPPABLE = ["ENTROPY_FILTER", "KNOWN_FAKE_SECRET_FILTER", "TEST_FILES_FILTER"]


def threshold_of(value: float) -> float:
    """Thresholds are single precision: the double nearest to the single nearest to the value."""
    return float(np.float32(value))


def is_path(text: Expr) -> Expr:
    """At least two slashes of either kind, and one in some seven characters."""
    slashes = F.length(text) - F.length(F.translate(text, "/\\", ""))
    return (slashes >= 2) & (slashes / F.length(text) >= 0.15)


def is_uri(text: Expr) -> Expr:
    return text.rlike(r"^(?:https?|ftps?|file|smtp|imap)://[^\n\r]*\z")


HEURISTICS = {"path": is_path, "uri": is_uri}


def passes_entropy(text: Expr, threshold: float) -> Expr:
    return entropy(text) >= threshold_of(threshold)


def first_denied(text: Expr, patterns: tuple[str, ...]) -> Expr:
    """The first deny pattern found in the text, else null."""
    return F.coalesce(*(F.when(text.rlike(p), F.lit(p)) for p in patterns), F.lit(None).cast("string"))


def matched_heuristic(text: Expr, names: tuple[str, ...]) -> Expr:
    """The first heuristic that recognises the text, else null; unknown names recognise nothing."""
    return F.coalesce(*(F.when(HEURISTICS[n](text), F.lit(n)) for n in names if n in HEURISTICS), F.lit(None).cast("string"))


def _reason(kind: str, detail: Expr | None = None) -> Expr:
    return F.concat(F.lit(kind + ": "), detail) if detail is not None else F.lit(kind)


def _decoded_reason(text: Expr, d: Decoded) -> Expr:
    def judge(plain: Expr) -> Expr:
        out = F.when(plain.isNull(), _reason("decodedBase64"))
        if d.each or d.none:
            ok = all_of([F.contains(plain, F.lit(x)) for x in d.each]) & ~any_of([F.contains(plain, F.lit(x)) for x in d.none])
            out = out.when(~ok, _reason("decodedBase64"))
        if d.pattern:
            group = 1 if groups_of(d.pattern) else 0
            whole = F.regexp_extract(plain, d.pattern, 0)
            part = F.regexp_extract(plain, d.pattern, group)
            out = out.when(~plain.rlike(d.pattern), _reason("decodedBase64"))
            nested = reason(F.when(F.length(part) > 0, part).otherwise(whole), d.post, ()) if d.post else F.lit(None)
        else:
            nested = reason(plain, d.post, ()) if d.post else F.lit(None)
        return out.otherwise(F.concat(F.lit("decodedBase64 -> "), nested))

    return let(decode_base64(text, d.alphabet), judge)


def reason(text: Expr, post: Post, skipped: tuple[str, ...], groups: Expr | None = None) -> Expr:
    """Why a candidate is rejected, null if it isn't. Filters come in a fixed order, cheap ones included:
    base64, entropy, deny patterns, heuristics, then those of named groups; a group that took no part passes."""
    out = []
    if post.decoded:
        out.append(_decoded_reason(text, post.decoded))
    if post.threshold is not None and "ENTROPY_FILTER" not in skipped:
        out.append(F.when(~passes_entropy(text, post.threshold), _reason("statisticalFilter")))
    if post.pattern_not and "KNOWN_FAKE_SECRET_FILTER" not in skipped:
        out.append(_prefixed("patternNot", first_denied(text, post.pattern_not)))
    if post.heuristics:
        out.append(_prefixed("heuristicFilter", matched_heuristic(text, post.heuristics)))
    for name, own in post.groups:
        if groups is not None:
            value = groups[name]
            out.append(F.when(value.isNotNull(), F.concat(F.lit(f"{name} -> "), reason(value, own, skipped))))
    return F.coalesce(*out, F.lit(None).cast("string"))


def one_pattern(patterns: tuple[str, ...]) -> str | None:
    """A pattern that is found where any of these is; None if groups or references stand in the way."""
    if any(re.search(r"\\[1-9]|\\k<|\(\?<[A-Za-z]", p) for p in patterns):
        return None
    return "|".join(f"(?:{p})" for p in patterns)


def denied(text: Expr, patterns: tuple[str, ...]) -> Expr:
    """Whether a deny pattern is found in the text: one search for all that can be put together."""
    plain = tuple(p for p in patterns if one_pattern((p,)))
    found = [text.rlike(one_pattern(plain))] if plain else []
    return any_of(found + [text.rlike(p) for p in patterns if p not in plain])


def passes(text: Expr, post: Post, skipped: tuple[str, ...], groups: Expr | None = None) -> Expr:
    """Whether reason() is null, in fewer steps."""
    ok = []
    if post.decoded:
        ok.append(_decoded_reason(text, post.decoded).isNull())
    if post.threshold is not None and "ENTROPY_FILTER" not in skipped:
        ok.append(passes_entropy(text, post.threshold))
    if post.pattern_not and "KNOWN_FAKE_SECRET_FILTER" not in skipped:
        ok.append(~denied(text, post.pattern_not))
    ok += [~HEURISTICS[n](text) for n in post.heuristics if n in HEURISTICS]
    for name, own in post.groups:
        if groups is not None:
            ok.append(groups[name].isNull() | passes(groups[name], own, skipped))
    return all_of(ok)


def _prefixed(kind: str, detail: Expr) -> Expr:
    return F.concat(F.lit(kind + ": "), detail)


def marks(text: Expr, post: Post, skipped: tuple[str, ...], groups: Expr | None = None) -> Expr:
    """Names of the filters switched to marking that would have rejected the candidate."""
    found = []
    if post.threshold is not None and "ENTROPY_FILTER" in skipped:
        found.append(F.when(~passes_entropy(text, post.threshold), F.lit("ENTROPY_FILTER")))
    if post.pattern_not and "KNOWN_FAKE_SECRET_FILTER" in skipped:
        found.append(F.when(first_denied(text, post.pattern_not).isNotNull(), F.lit("KNOWN_FAKE_SECRET_FILTER")))
    own = F.filter(F.array(*found), lambda x: x.isNotNull()) if found else F.array().cast("array<string>")
    for name, nested in post.groups:
        if groups is not None and any(s in skipped for s in SKIPPABLE[:2]):
            value = groups[name]
            own = F.array_union(own, F.when(value.isNotNull(), marks(value, nested, skipped)).otherwise(F.array().cast("array<string>")))
    return own


def in_order(tags: Expr) -> Expr:
    """Marks without repeats, in the order of messages."""
    return F.filter(F.array(*map(F.lit, SKIPPABLE)), lambda s: F.array_contains(tags, s))


def combined(passed: Expr, tags: Expr, other_passed: Expr, other_tags: Expr) -> Expr:
    """Outcomes of two filters as one."""
    return F.struct((passed & other_passed).alias("passed"), in_order(F.array_union(tags, other_tags)).alias("skipped"))


def with_suffix(message: Expr, tags: Expr) -> Expr:
    """The message, and after it the filters that were only marked."""
    named = F.concat(message, F.lit(" (low-confidence match, disabled filters: "), F.concat_ws(", ", in_order(tags)), F.lit(")"))
    return F.when(F.size(tags) > 0, named).otherwise(message)
