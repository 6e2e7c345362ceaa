"""Aggregates by name: sum, mean (avg), min, max, count, and count_distinct, stddev and variance (of a sample)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakescan.dtypes import is_numeric

AGGREGATES: dict[str, Callable[[Column], Column]] = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "count": F.count, "count_distinct": F.count_distinct, "stddev": F.stddev_samp, "variance": F.var_samp}


def aggregate_name(name: str) -> str:
    name = name.strip().lower()
    name = {"avg": "mean"}.get(name, name)
    if name not in AGGREGATES:
        raise ValueError(f"unknown aggregate {name!r}; there are {', '.join(AGGREGATES)}")
    return name


def alias_of(op: str, column: str) -> str:
    return f"{aggregate_name(op).upper()}_{column}"


def aggregate_of(op: str, column: str, kind: T.DataType) -> Column:
    """SQL semantics: nulls are skipped; without values a count is 0 and the others null."""
    op = aggregate_name(op)
    if op in ("sum", "mean", "stddev", "variance") and not is_numeric(kind):
        raise TypeError(f"{op} needs a number; {column!r} is {kind.simpleString()}")
    return AGGREGATES[op](F.col("`" + column.replace("`", "``") + "`"))
