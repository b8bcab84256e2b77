"""Regular expressions: every match with its place, named groups, and checks of patterns."""

from __future__ import annotations

import re
from dataclasses import dataclass

from . import sql as F
from .sql import Expr

from .core import let

MATCH = "struct<text:string,start:int,end:int,whole_start:int,whole_end:int>"


def groups_of(pattern: str) -> list[tuple[int, str | None]]:
    """(position, name) of the capturing groups in order."""
    out, i, in_class, quoted = [], 0, 0, False
    while i < len(pattern):
        two = pattern[i : i + 2]
        if quoted:
            quoted = two != r"\E"
            i += 1 if quoted else 2
        elif two == r"\Q":
            quoted, i = True, i + 2
        elif pattern[i] == "\\":
            i += 2
        elif pattern[i] == "[":
            in_class += 1
            i += 2 if pattern[i + 1 : i + 2] == "]" else 3 if pattern[i + 1 : i + 3] == "^]" else 1
        elif pattern[i] == "]" and in_class:
            in_class -= 1
            i += 1
        elif pattern[i] == "(" and not in_class:
            named = re.match(r"\(\?<([A-Za-z][A-Za-z0-9]*)>", pattern[i:])
            if named or pattern[i + 1 : i + 2] != "?":
                out.append((i, named and named[1]))
            i += 1
        else:
            i += 1
    return out


def _depths(pattern: str) -> list[int]:
    """Nesting of parentheses at each position; -1 within classes, escapes and quotes."""
    out, depth, i, in_class, quoted = [-1] * len(pattern), 0, 0, 0, False
    while i < len(pattern):
        two = pattern[i : i + 2]
        if quoted:
            if two == r"\E":
                quoted, i = False, i + 2
            else:
                i += 1
        elif two == r"\Q":
            quoted, i = True, i + 2
        elif pattern[i] == "\\":
            i += 2
        elif pattern[i] == "[":
            in_class += 1
            i += 2 if pattern[i + 1 : i + 2] == "]" else 3 if pattern[i + 1 : i + 3] == "^]" else 1
        elif in_class:
            in_class -= pattern[i] == "]"
            i += 1
        else:
            depth -= pattern[i] == ")"
            out[i] = depth
            depth += pattern[i] == "("
            i += 1
    return out


def with_lead(pattern: str) -> str | None:
    """The pattern with what comes before its first group as a group of its own, so that the first group's
    place follows from the lead's length. None where that isn't safe: no group, a group within another
    construct or an alternative, references by number, or flags set in between."""
    groups, depths = groups_of(pattern), _depths(pattern)
    if not groups or re.search(r"\\[1-9]", pattern) or any(d == 0 and c == "|" for d, c in zip(depths, pattern)):
        return None
    at = groups[0][0]
    if depths[at] != 0:
        return None
    flags = re.match(r"(?:\(\?[a-zA-Z-]+\))*", pattern)[0]
    lead = pattern[len(flags) : at]
    if re.search(r"\(\?[a-zA-Z-]+\)", lead) or re.match(r"[*+?{]", lead):
        return None
    closed = next(i for i in range(at + 1, len(pattern)) if pattern[i] == ")" and depths[i] == 0)
    if re.match(r"[*+?{]", pattern[closed + 1 :]):
        return None
    return f"{flags}({lead}){pattern[at:]}"


def context_free(pattern: str) -> bool:
    """Whether what matches depends on its own characters alone: no look-around, anchor or boundary, nothing
    possessive or atomic, no references. A match then matches alone as it does within a text, and stands at
    the first place after the match before it that has the same characters."""
    if r"\Q" in pattern or re.search(r"\\[bBAzZGRXk1-9]", re.sub(r"\\\\", "", pattern)):
        return False
    depths = _depths(pattern)
    for i, c in enumerate(pattern):
        if depths[i] != -1:
            possessive = c == "+" and i > 0 and depths[i - 1] != -1 and pattern[i - 1] in "*+?}"
            if c in "^$" or possessive or c == "(" and re.match(r"\(\?(?:[=!>]|<[=!])", pattern[i:]):
                return False
    return True


#: So many matches are looked for in a text one by one; if there are more, a search for what is between them is cheaper.
FEW = 8


def _find_alone(content: Expr, pattern: str, names: list[str] | None) -> Expr:
    """find_all for patterns free of context: one search of the text for whole matches, whose groups and places
    follow from their own characters."""
    groups = groups_of(pattern)
    lead = with_lead(pattern)
    own, shift = lead or pattern, 1 if lead else 0
    numbers = {n: i + 1 + shift for i, (_, n) in enumerate(groups) if n}
    wanted = [n for n in names or [] if n in numbers]

    def parts(w: Expr) -> Expr:
        fields = [w.alias("whole"), (F.regexp_extract(w, own, 1 + shift) if groups else w).alias("text")]
        if lead:
            fields.append(F.regexp_extract(w, own, 1).alias("lead"))
        return F.struct(*fields, *(F.regexp_extract(w, own, numbers[n]).alias(f"n_{n}") for n in wanted))

    def one(x: Expr, to: Expr) -> Expr:
        at, text = to - F.length(x["whole"]), x["text"]
        # an empty group 1 took no part, as patterns never match nothing
        inner = (F.length(x["lead"]) if lead else F.position(text, x["whole"]) - 1) if groups else F.lit(0)
        start = F.when(F.length(text) == 0, F.lit(-1)).otherwise(at + inner).cast("int")
        end = F.when(F.length(text) == 0, F.lit(-1)).otherwise(at + inner + F.length(text)).cast("int")
        named = [F.when(F.length(x[f"n_{n}"]) > 0, x[f"n_{n}"]).alias(n) for n in wanted]
        return F.struct(text.alias("text"), start.alias("start"), end.alias("end"), at.cast("int").alias("whole_start"), to.cast("int").alias("whole_end"), *named)

    none = F.array().cast("array<int>")
    last = lambda ends: F.coalesce(F.get(ends, F.size(ends) - 1), F.lit(0))

    def build(wholes: Expr) -> Expr:
        one_by_one = F.aggregate(wholes, none, lambda ends, w: F.concat(ends, F.array((F.locate(w, content, last(ends) + 1) - 1 + F.length(w)).cast("int"))))
        between = F.zip_with(wholes, F.slice(F.split(content, pattern, -1), 1, F.size(wholes)), lambda w, piece: (F.length(piece) + F.length(w)).cast("int"))
        summed = F.aggregate(between, none, lambda ends, n: F.concat(ends, F.array((last(ends) + n).cast("int"))))
        # of bytes that are no UTF-8 a search sees other characters than they are
        ends = F.when((F.size(wholes) <= FEW) & F.is_valid_utf8(content), one_by_one).otherwise(summed)
        return F.zip_with(F.transform(wholes, parts), ends, one)

    return let(F.regexp_extract_all(content, F.lit(pattern), F.lit(0)), build)


def find_all(content: Expr, pattern: str, names: list[str] | None = None) -> Expr:
    """Array of all matches: text and place of group 1 (of the whole match if there is no group), place of
    the whole match, and the texts of the named groups asked for, null where they took no part.

    Places come from the pieces between matches: a match starts after all pieces up to it and all
    matches before it. Patterns must not match empty texts. A match whose group 1 took no part has
    the start -1.
    """
    if context_free(pattern):
        return _find_alone(content, pattern, names)
    groups = groups_of(pattern)
    lead = with_lead(pattern)
    own = lead or pattern
    shift = 1 if lead else 0
    numbers = {n: i + 1 + shift for i, (_, n) in enumerate(groups) if n}
    extract = lambda i: F.regexp_extract_all(content, F.lit(own), F.lit(i))
    columns = {"whole": extract(0), "piece": F.slice(F.split(content, own, -1), 1, F.size(extract(0)))}
    if groups:
        columns["group"] = extract(1 + shift)
    if lead:
        columns["lead"] = extract(1)
    wanted = [n for n in names or [] if n in numbers]
    columns |= {f"n_{n}": extract(numbers[n]) for n in wanted}
    field = {k: str(i) for i, k in enumerate(columns)}  # arrays_zip numbers its fields

    def place(acc: Expr, x: Expr) -> Expr:
        at = acc["at"] + F.length(x[field["piece"]])
        return F.struct((at + F.length(x[field["whole"]])).alias("at"), F.concat(acc["out"], F.array(at)).alias("out"))

    def build(zipped: Expr) -> Expr:
        starts = F.aggregate(zipped, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), place, lambda acc: acc["out"])

        def one(x: Expr, at: Expr) -> Expr:
            text = x[field["group"]] if groups else x[field["whole"]]
            # an empty group 1 took no part, as patterns never match nothing
            inner = (F.length(x[field["lead"]]) if lead else F.position(text, x[field["whole"]]) - 1) if groups else F.lit(0)
            start = F.when(F.length(text) == 0, F.lit(-1)).otherwise(at + inner).cast("int")
            end = F.when(F.length(text) == 0, F.lit(-1)).otherwise(at + inner + F.length(text)).cast("int")
            named = [F.when(F.length(x[field[f"n_{n}"]]) > 0, x[field[f"n_{n}"]]).alias(n) for n in wanted]
            return F.struct(text.alias("text"), start.alias("start"), end.alias("end"), at.alias("whole_start"), (at + F.length(x[field["whole"]])).cast("int").alias("whole_end"), *named)

        return F.zip_with(zipped, starts, one)

    return let(F.arrays_zip(*columns.values()), build)


def empty_matches(pattern: str, names: list[str] | None = None) -> Expr:
    """An empty array of find_all's type."""
    known = {n for _, n in groups_of(pattern) if n}
    named = "".join(f",{n}:string" for n in names or [] if n in known)
    return F.array().cast(f"array<{MATCH[:-1]}{named}>>")


def find_if_any(content: Expr, pattern: str, names: list[str] | None = None) -> Expr:
    """find_all, at the price of one search where nothing matches."""
    any_ = content.isNotNull() if context_free(pattern) else content.rlike(pattern)
    return F.when(any_, find_all(content, pattern, names)).otherwise(empty_matches(pattern, names))


@dataclass(frozen=True)
class Finding:
    kind: str
    detail: str


#: Constructs that DuckDB's engine (RE2) has not.
_BEYOND_RE2 = [("lookaround", r"\(\?<?[=!]"), ("possessive quantifier", r"(?<!\\)[*+?}]\+"), ("named group", r"\(\?<[A-Za-z]"), ("back-reference", r"\\k<|\\[1-9]"), ("atomic group", r"\(\?>")]


def beyond_re2(pattern: str) -> list[str]:
    return [name for name, p in _BEYOND_RE2 if re.search(p, pattern)]


def lint(pattern: str) -> list[Finding]:
    """What may make a pattern slow or give it no place: nested or unbounded repeats, empty matches."""
    out = []
    if re.search(r"\((?:[^()\\]|\\.)*[*+](?:[^()\\]|\\.)*\)[*+]", pattern):
        out.append(Finding("nested repeat", "a repeated group that ends in a repeat can take exponential time"))
    if re.search(r"(?<!\\)\.[*+](?![?+])", pattern):
        out.append(Finding("unbounded dot", "bound the repeat of the dot"))
    plain = re.sub(r"\(\?<([A-Za-z]\w*)>", r"(?P<\1>", pattern).replace(r"\k<", r"(?P=")
    try:
        if re.compile(re.sub(r"(?<!\\)([*+?}])\+", r"\1", plain)).search("") is not None:
            out.append(Finding("empty match", "a pattern that matches nothing has no place"))
    except re.error:
        pass  # of the JVM's dialect; it is compiled there
    return out
