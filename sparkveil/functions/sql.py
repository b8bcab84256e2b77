"""Expressions as SQL text, with the names of pyspark.sql.functions.

A rule compiles to thousands of nodes. Built as Column objects each node is several calls to the JVM;
as text a whole rule is one. An Expr becomes a Column with ``column(expr)``, or may be made from one's name
with ``col``.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as _F

_numbers = itertools.count()


def literal(value: Any) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, float):
        return f"{value!r}D"
    if isinstance(value, int):
        return str(value)
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t").replace("\x00", "\\0") + "'"


class Expr:
    def __init__(self, sql: str, name: str | None = None) -> None:
        self.sql, self.name = sql, name

    def _two(self, op: str, other: Any) -> Expr:
        return Expr(f"({self.sql} {op} {_sql(other)})")

    __eq__ = lambda self, o: self._two("=", o)  # type: ignore[assignment]
    __ne__ = lambda self, o: self._two("<>", o)  # type: ignore[assignment]
    __lt__ = lambda self, o: self._two("<", o)
    __le__ = lambda self, o: self._two("<=", o)
    __gt__ = lambda self, o: self._two(">", o)
    __ge__ = lambda self, o: self._two(">=", o)
    __add__ = lambda self, o: self._two("+", o)
    __sub__ = lambda self, o: self._two("-", o)
    __mul__ = lambda self, o: self._two("*", o)
    __truediv__ = lambda self, o: self._two("/", o)
    __and__ = lambda self, o: self._two("AND", o)
    __or__ = lambda self, o: self._two("OR", o)
    __hash__ = object.__hash__

    def __invert__(self) -> Expr:
        return Expr(f"(NOT {self.sql})")

    def __neg__(self) -> Expr:
        return Expr(f"(- {self.sql})")

    def __getitem__(self, field: str) -> Expr:
        return Expr(f"{self.sql}.`{field}`")

    def alias(self, name: str) -> Expr:
        return Expr(self.sql, name)

    def cast(self, kind: str) -> Expr:
        return Expr(f"CAST({self.sql} AS {kind})")

    def isNull(self) -> Expr:
        return Expr(f"({self.sql} IS NULL)")

    def isNotNull(self) -> Expr:
        return Expr(f"({self.sql} IS NOT NULL)")

    def rlike(self, pattern: str) -> Expr:
        return Expr(f"rlike({self.sql}, {literal(pattern)})")

    def startswith(self, text: str) -> Expr:
        return Expr(f"startswith({self.sql}, {literal(text)})")

    def endswith(self, text: str) -> Expr:
        return Expr(f"endswith({self.sql}, {literal(text)})")

    def isin(self, *values: Any) -> Expr:
        own = values[0] if len(values) == 1 and isinstance(values[0], (list, tuple, set)) else values
        return Expr(f"({self.sql} IN ({', '.join(map(literal, own))}))")


class Case(Expr):
    def __init__(self, branches: list[tuple[str, str]]) -> None:
        super().__init__("CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in branches) + " END")
        self.branches = branches

    def when(self, condition: Expr, value: Any) -> Case:
        return Case([*self.branches, (condition.sql, _sql(value))])

    def otherwise(self, value: Any) -> Expr:
        return Expr(self.sql[: -len(" END")] + f" ELSE {_sql(value)} END")


def _sql(value: Any) -> str:
    return value.sql if isinstance(value, Expr) else literal(value)


def _arg(value: Any) -> str:
    """As an argument of a function, a text names a column."""
    return f"`{value}`" if isinstance(value, str) else _sql(value)


def _call(name: str, *args: Any) -> Expr:
    return Expr(f"{name}({', '.join(map(_arg, args))})")


def __getattr__(name: str) -> Callable[..., Expr]:
    if name.startswith("_"):
        raise AttributeError(name)
    return lambda *args: _call(name, *args)


def column(e: Expr) -> Column:
    out = _F.expr(e.sql)
    return out.alias(e.name) if e.name else out


def col(name: str) -> Expr:
    return Expr(".".join(f"`{p}`" for p in name.split(".")))


def lit(value: Any) -> Expr:
    return Expr(literal(value))


def when(condition: Expr, value: Any) -> Case:
    return Case([(condition.sql, _sql(value))])


def struct(*fields: Expr) -> Expr:
    return Expr("named_struct(" + ", ".join(f"{literal(f.name)}, {f.sql}" for f in fields) + ")")


def rpad(text: Expr, size: Expr, pad: str) -> Expr:
    return _call("rpad", text, size, lit(pad))


def split(text: Expr, pattern: str, limit: int = -1) -> Expr:
    return _call("split", text, lit(pattern), limit)


def regexp_replace(text: Expr | str, pattern: str, by: str) -> Expr:
    return _call("regexp_replace", text, lit(pattern), lit(by))


def regexp_extract(text: Expr | str, pattern: str, group: int) -> Expr:
    return _call("regexp_extract", text, lit(pattern), group)


def translate(text: Expr | str, source: str, target: str) -> Expr:
    return _call("translate", text, lit(source), lit(target))


def substring_index(text: Expr | str, mark: str, count: int) -> Expr:
    return _call("substring_index", text, lit(mark), count)


def decode(data: Expr, charset: str) -> Expr:
    return _call("decode", data, lit(charset))


def concat_ws(mark: str, *parts: Any) -> Expr:
    return _call("concat_ws", lit(mark), *parts)


def ltrim(text: Expr, chars: Expr) -> Expr:
    return Expr(f"trim(LEADING {chars.sql} FROM {text.sql})")


def format_string(form: str, *args: Any) -> Expr:
    return _call("format_string", lit(form), *args)


def array_contains(array: Expr, value: Expr) -> Expr:
    return _call("array_contains", array, value)


def _function(body: Callable[..., Expr], arity: int | None = None) -> Expr:
    n = arity or body.__code__.co_argcount
    names = [f"v{next(_numbers)}" for _ in range(n)]
    head = names[0] if n == 1 else f"({', '.join(names)})"  # one name takes no parentheses
    return Expr(f"{head} -> {body(*map(Expr, names)).sql}")


def transform(array: Expr | str, body: Callable[..., Expr]) -> Expr:
    return _call("transform", array, _function(body))


def filter(array: Expr | str, body: Callable[..., Expr]) -> Expr:  # noqa: A001
    return _call("filter", array, _function(body))


def exists(array: Expr | str, body: Callable[..., Expr]) -> Expr:
    return _call("exists", array, _function(body))


def zip_with(a: Expr, b: Expr, body: Callable[..., Expr]) -> Expr:
    return _call("zip_with", a, b, _function(body))


def aggregate(array: Expr, start: Expr, merge: Callable[..., Expr], finish: Callable[..., Expr] | None = None) -> Expr:
    return _call("aggregate", array, start, _function(merge), *([_function(finish)] if finish else []))
