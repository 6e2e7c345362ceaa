"""Expressions, operators and aggregates by name."""

from lakescan.functions.aggregates import AGGREGATES, aggregate_of, alias_of
from lakescan.functions.expressions import COMPARISONS, FUNCTIONS, Expr, call, case, cast, col, compare, lit

__all__ = ["AGGREGATES", "COMPARISONS", "FUNCTIONS", "Expr", "aggregate_of", "alias_of", "call", "case", "cast", "col", "compare", "lit"]
