"""Spark SQL expressions as text.

A detection expression has some ten thousand nodes. Building it node by node through the Python gateway
takes seconds per use; writing the same built-in functions as one SQL expression and handing that to
Spark's own parser takes milliseconds. ``fn.<name>(...)`` stands for the Spark SQL function of that name.
"""

from __future__ import annotations

import inspect
import itertools

from pyspark.sql import Column
from pyspark.sql import functions as F

_names = itertools.count()


def _quote(s: str) -> str:
    if "'" not in s:
        return f"r'{s}'"
    if '"' not in s:
        return f'r"{s}"'
    return "concat(" + ", \"'\", ".join(f"r'{p}'" for p in s.split("'")) + ")"


def sql(value) -> str:
    """SQL text of a Python value, an expression, or a lambda."""
    if isinstance(value, X):
        return value.text
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        return f"{value!r}D"
    if isinstance(value, str):
        return _quote(value)
    if isinstance(value, (list, tuple)):
        return f"array({', '.join(map(sql, value))})"
    if callable(value):
        params = [f"v{next(_names)}" for _ in inspect.signature(value).parameters]
        body = sql(value(*map(X, params)))
        head = params[0] if len(params) == 1 else f"({', '.join(params)})"
        return f"{head} -> {body}"
    raise TypeError(f"no SQL text for {type(value).__name__}")


class X:
    """One expression; operators and field access give new expressions."""

    def __init__(self, text: str):
        self.text = text

    def _op(self, symbol: str, other) -> X:
        return X(f"({self.text} {symbol} {sql(other)})")

    def __add__(self, o):
        return self._op("+", o)

    def __sub__(self, o):
        return self._op("-", o)

    def __mul__(self, o):
        return self._op("*", o)

    def __truediv__(self, o):
        return self._op("/", o)

    def __mod__(self, o):
        return self._op("%", o)

    def __eq__(self, o):
        return self._op("=", o)

    def __ne__(self, o):
        return self._op("!=", o)

    def __lt__(self, o):
        return self._op("<", o)

    def __le__(self, o):
        return self._op("<=", o)

    def __gt__(self, o):
        return self._op(">", o)

    def __ge__(self, o):
        return self._op(">=", o)

    def __and__(self, o):
        return self._op("and", o)

    def __or__(self, o):
        return self._op("or", o)

    def __invert__(self):
        return X(f"(not {self.text})")

    def __neg__(self):
        return X(f"(-{self.text})")

    __hash__ = None

    def __getitem__(self, name: str) -> X:
        return X(f"{self.text}.`{name}`")

    def __getattr__(self, name: str) -> X:
        if name.startswith("__"):
            raise AttributeError(name)
        return self[name]

    def cast(self, ddl: str) -> X:
        return X(f"cast({self.text} as {ddl})")

    def try_cast(self, ddl: str) -> X:
        return X(f"try_cast({self.text} as {ddl})")

    def rlike(self, pattern: str) -> X:
        return X(f"rlike({self.text}, {sql(pattern)})")

    def is_null(self) -> X:
        return X(f"({self.text} is null)")

    def is_set(self) -> X:
        return X(f"({self.text} is not null)")

    def between(self, low, high) -> X:
        return X(f"({self.text} between {sql(low)} and {sql(high)})")

    def isin(self, *values) -> X:
        return X(f"({self.text} in ({', '.join(map(sql, values))}))")


class Case(X):
    """``CASE WHEN``; ``otherwise`` closes it."""

    def __init__(self, branches: str = ""):
        super().__init__(f"(case{branches} end)")
        self._branches = branches

    def __getattr__(self, name: str):
        return super().__getattr__(name)

    def when(self, condition, value) -> Case:
        return Case(f"{self._branches} when {sql(condition)} then {sql(value)}")

    def otherwise(self, value) -> X:
        return X(f"(case{self._branches} else {sql(value)} end)") if self._branches else X(sql(value))


class _Functions:
    def __getattr__(self, name: str):
        return lambda *args: X(f"{name}({', '.join(map(sql, args))})")


fn = _Functions()


def lit(value) -> X:
    return X(sql(value))


def when(condition, value) -> Case:
    return Case().when(condition, value)


def struct(**fields) -> X:
    return X("named_struct(" + ", ".join(f"'{k}', {sql(v)}" for k, v in fields.items()) + ")")


def empty(ddl: str) -> X:
    return X(f"cast(array() as {ddl})")


def let(value, body) -> X:
    """Evaluate ``value`` once per row and hand it to ``body``: a lambda variable is never inlined.

    A fold over nothing passes its start value straight to the finishing lambda. (``transform`` over a
    one-element array would bind as well, but it copies every result, arrays and all.)
    """
    return X(f"aggregate(array(), {sql(value)}, {sql(lambda acc, item: acc)}, {sql(body)})")


def bind(body, **columns: Column) -> Column:
    """Column of ``body(row)``, where ``row`` has one field per given column."""
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    return F.call_function("aggregate", F.array(), row, F.expr(sql(lambda acc, item: acc)), F.expr(sql(body)))
