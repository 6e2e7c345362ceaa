"""A small expression tree that lowers to Catalyst columns.

Comparisons are checked against the schema when they are lowered: a string is never
compared with a number, which Spark would only refuse at run time.
"""

from __future__ import annotations

import datetime
import decimal
import operator
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakescan.dtypes import is_numeric, is_string
from lakescan.errors import need_columns

COMPARISONS: dict[str, Callable] = {"=": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
_SPELLINGS = {"==": "=", "<>": "!=", "eq": "=", "ne": "!=", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}
_ARITHMETIC = {"+": operator.add, "-": operator.sub, "*": operator.mul, "/": operator.truediv, "%": operator.mod}
_LITERALS = (bool, int, float, str, type(None), datetime.date, datetime.datetime, decimal.Decimal)


def comparison(name: str) -> str:
    """The canonical form of a comparison's spelling."""
    name = name.strip().lower()
    name = _SPELLINGS.get(name, name)
    if name not in COMPARISONS:
        raise ValueError(f"unknown comparison {name!r}; there are {' '.join([*COMPARISONS, *_SPELLINGS])}")
    return name


@dataclass(frozen=True, eq=False)
class Expr:
    kind: str
    args: tuple

    # -- builders
    def _binary(self, op: str, other: Any, kind: str = "compare") -> Expr:
        return Expr(kind, (op, self, other if isinstance(other, Expr) else lit(other)))

    def eq(self, other):
        return self._binary("=", other)

    def ne(self, other):
        return self._binary("!=", other)

    def lt(self, other):
        return self._binary("<", other)

    def le(self, other):
        return self._binary("<=", other)

    def gt(self, other):
        return self._binary(">", other)

    def ge(self, other):
        return self._binary(">=", other)

    def and_(self, other):
        return self._binary("and", other, "logic")

    def or_(self, other):
        return self._binary("or", other, "logic")

    def not_(self):
        return Expr("not", (self,))

    __eq__, __ne__, __lt__, __le__, __gt__, __ge__ = eq, ne, lt, le, gt, ge
    __and__, __or__, __invert__ = and_, or_, not_
    __hash__ = object.__hash__

    def __add__(self, other):
        return self._binary("+", other, "arithmetic")

    def __sub__(self, other):
        return self._binary("-", other, "arithmetic")

    def __mul__(self, other):
        return self._binary("*", other, "arithmetic")

    def __truediv__(self, other):
        return self._binary("/", other, "arithmetic")

    def __mod__(self, other):
        return self._binary("%", other, "arithmetic")

    def __neg__(self):
        return lit(0)._binary("-", self, "arithmetic")

    def is_null(self):
        return Expr("is_null", (self,))

    def isin(self, values):
        return Expr("in", (self, tuple(values)))

    def like(self, pattern: str):
        """% stands for any text, _ for one character."""
        return Expr("like", (self, pattern))

    def matches(self, pattern: str):
        """A regular expression that is found anywhere."""
        return Expr("matches", (self, pattern))

    def between(self, low, high):
        return self.ge(low).and_(self.le(high))

    # -- inspection
    def referenced_columns(self) -> list[str]:
        """Names in order of first use."""
        if self.kind == "column":
            return [self.args[0]]
        out: list[str] = []
        for a in self.args:
            for x in (a if isinstance(a, tuple) else (a,)):
                if isinstance(x, Expr):
                    out += [n for n in x.referenced_columns() if n not in out]
        return out

    def __repr__(self) -> str:
        a = self.args
        match self.kind:
            case "column":
                return a[0]
            case "literal":
                return "NULL" if a[0] is None else repr(a[0])
            case "not":
                return f"NOT ({a[0]!r})"
            case "is_null":
                return f"({a[0]!r} IS NULL)"
            case "in":
                return f"({a[0]!r} IN {a[1]!r})"
            case "call":
                return f"{a[0]}({', '.join(map(repr, a[1]))})"
            case "like" | "matches":
                return f"({a[0]!r} {'LIKE' if self.kind == 'like' else 'RLIKE'} {a[1]!r})"
            case "cast":
                return f"CAST({a[0]!r} AS {a[1]})"
            case "case":
                return "CASE " + " ".join(f"WHEN {c!r} THEN {v!r}" for c, v in zip(a[0], a[1], strict=True)) + f" ELSE {a[2]!r} END"
            case _:
                return f"({a[1]!r} {a[0].upper()} {a[2]!r})"

    # -- lowering
    def column(self, schema: T.StructType, missing: type[Exception] = KeyError) -> Column:
        """A Catalyst column; names and operand types are checked now."""
        need_columns(schema.names, self.referenced_columns(), missing)
        return self._lower(schema)

    def _type(self, schema: T.StructType) -> T.DataType | None:
        if self.kind == "column":
            return schema[self.args[0]].dataType
        if self.kind == "literal":
            v = self.args[0]
            return next((t for k, t in ((bool, T.BooleanType()), ((int, float, decimal.Decimal), T.DoubleType()), (str, T.StringType())) if isinstance(v, k)), None)
        return None

    def _comparable(self, other: Expr, schema: T.StructType) -> None:
        left, right = self._type(schema), other._type(schema)
        if left and right and (is_string(left) and is_numeric(right) or is_numeric(left) and is_string(right) or isinstance(left, T.BooleanType) != isinstance(right, T.BooleanType)):
            raise TypeError(f"{self!r} is {left.simpleString()} and {other!r} is {right.simpleString()}")

    def _lower(self, schema: T.StructType) -> Column:
        a = self.args
        match self.kind:
            case "column":
                return F.col("`" + a[0].replace("`", "``") + "`")
            case "literal":
                return F.lit(a[0])
            case "not":
                return ~a[0]._lower(schema)
            case "is_null":
                return a[0]._lower(schema).isNull()
            case "in":
                for v in a[1]:
                    a[0]._comparable(lit(v), schema)
                return a[0]._lower(schema).isin(list(a[1]))
            case "like" | "matches":
                a[0]._comparable(lit(a[1]), schema)
                left = a[0]._lower(schema)
                return left.like(a[1]) if self.kind == "like" else left.rlike(a[1])
            case "cast":
                return a[0]._lower(schema).try_cast(a[1])
            case "call":
                return F.call_function(a[0], *(x._lower(schema) for x in a[1]))
            case "case":
                out = a[2]._lower(schema)
                for c, v in reversed(list(zip(a[0], a[1], strict=True))):
                    out = F.when(c._lower(schema), v._lower(schema)).otherwise(out)
                return out
            case "logic":
                left, right = a[1]._lower(schema), a[2]._lower(schema)
                return left & right if a[0] == "and" else left | right
            case "compare":
                a[1]._comparable(a[2], schema)
                return COMPARISONS[a[0]](a[1]._lower(schema), a[2]._lower(schema))
            case _:
                return _ARITHMETIC[a[0]](a[1]._lower(schema), a[2]._lower(schema))


def col(name: str) -> Expr:
    return Expr("column", (name,))


def lit(value: Any) -> Expr:
    if not isinstance(value, _LITERALS):
        raise TypeError(f"a literal can't be a {type(value).__name__}")
    return Expr("literal", (value,))


def compare(name: str, op: str, value: Any) -> Expr:
    return Expr("compare", (comparison(op), col(name), value if isinstance(value, Expr) else lit(value)))


def cast(e: Expr, to: str) -> Expr:
    """Null where a value can't be cast."""
    return Expr("cast", (e, to))


#: Functions by name that mean the same in any SQL.
FUNCTIONS = ("abs", "ceil", "coalesce", "concat", "day", "exp", "floor", "greatest", "least", "length", "ln", "lower", "ltrim", "month", "nullif", "pow", "replace", "round", "rtrim", "sqrt", "substring", "trim", "upper", "year")


def call(name: str, *args: Any) -> Expr:
    """One of FUNCTIONS."""
    if name not in FUNCTIONS:
        raise ValueError(f"unknown function {name!r}; there are {', '.join(FUNCTIONS)}")
    return Expr("call", (name, tuple(a if isinstance(a, Expr) else lit(a) for a in args)))


def case(whens: list[tuple[Expr, Any]], otherwise: Any = None) -> Expr:
    wrap = lambda v: v if isinstance(v, Expr) else lit(v)
    return Expr("case", (tuple(c for c, _ in whens), tuple(wrap(v) for _, v in whens), wrap(otherwise)))
