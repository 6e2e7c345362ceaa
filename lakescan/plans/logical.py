"""Logical plans: small immutable nodes, each with its lowering."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from lakescan.functions.expressions import Expr
from lakescan.operators import relational
from lakescan.session import get_spark


class Plan:
    def lower(self, spark: SparkSession) -> DataFrame:
        raise NotImplementedError

    def inputs(self) -> list[Plan]:
        return [x for x in (getattr(self, "input", None), getattr(self, "left", None), getattr(self, "right", None)) if x is not None]

    def title(self) -> str:
        return type(self).__name__

    def pretty(self, depth: int = 0) -> str:
        return "\n".join(["  " * depth + self.title(), *(i.pretty(depth + 1) for i in self.inputs())])

    def collect(self, spark: SparkSession | None = None) -> list:
        return self.lower(spark or get_spark()).collect()

    def optimized(self, spark: SparkSession | None = None) -> str:
        """What Catalyst makes of it."""
        return self.lower(spark or get_spark())._jdf.queryExecution().optimizedPlan().toString()

    # chaining
    def filter(self, e: Expr) -> Plan:
        return Filter(self, e)

    def project(self, columns: list[str]) -> Plan:
        return Project(self, columns)

    def aggregate(self, aggregates: list[tuple], keys: list[str] | None = None) -> Plan:
        return Aggregate(self, aggregates, keys or [])

    def sort(self, by: list) -> Plan:
        return Sort(self, by)

    def limit(self, n: int, offset: int = 0) -> Plan:
        return Limit(self, n, offset)

    def join(self, right: Plan, on=None, how: str = "inner") -> Plan:
        return Join(self, right, on, how)


@dataclass(frozen=True)
class Scan(Plan):
    """source: a path, the name of a temporary view, or a DataFrame."""

    source: object
    columns: list[str] | None = None
    rows: int | None = None

    def lower(self, spark):
        if isinstance(self.source, DataFrame):
            df = self.source
        elif "/" in self.source or "." in self.source:
            from lakescan.scan import scan

            df = scan(self.source, spark).df
        else:
            df = spark.table(self.source)
        df = relational_select(df, self.columns) if self.columns else df
        return df if self.rows is None else df.limit(self.rows)

    def title(self):
        return f"Scan {self.source if isinstance(self.source, str) else 'memory'}" + (f" {self.columns}" if self.columns else "") + (f" limit {self.rows}" if self.rows is not None else "")


def relational_select(df: DataFrame, names: list[str]) -> DataFrame:
    relational.need_columns(df.columns, names)
    return df.select(*map(relational.quoted, names))


@dataclass(frozen=True)
class Filter(Plan):
    input: Plan
    condition: Expr

    def lower(self, spark):
        df = self.input.lower(spark)
        return df.filter(self.condition.column(df.schema))

    def title(self):
        return f"Filter {self.condition!r}"


@dataclass(frozen=True)
class Project(Plan):
    input: Plan
    columns: list[str]

    def lower(self, spark):
        return relational_select(self.input.lower(spark), self.columns)

    def title(self):
        return f"Project {self.columns}"


@dataclass(frozen=True)
class Aggregate(Plan):
    input: Plan
    aggregates: list[tuple]
    keys: list[str] = field(default_factory=list)

    def lower(self, spark):
        return relational.aggregate(self.input.lower(spark), self.keys, self.aggregates)

    def title(self):
        return f"Aggregate {self.aggregates}" + (f" by {self.keys}" if self.keys else "")


@dataclass(frozen=True)
class Sort(Plan):
    input: Plan
    by: list

    def lower(self, spark):
        return relational.sort(self.input.lower(spark), self.by)

    def title(self):
        return f"Sort {self.by}"


@dataclass(frozen=True)
class Limit(Plan):
    input: Plan
    n: int
    offset: int = 0

    def lower(self, spark):
        df = self.input.lower(spark)
        return (df.offset(self.offset) if self.offset else df).limit(self.n)

    def title(self):
        return f"Limit {self.n}" + (f" offset {self.offset}" if self.offset else "")


@dataclass(frozen=True)
class Join(Plan):
    left: Plan
    right: Plan
    on: object = None
    how: str = "inner"

    def lower(self, spark):
        return relational.join(self.left.lower(spark), self.right.lower(spark), self.on, self.how)

    def title(self):
        return f"Join {self.how} {self.on}"


@dataclass(frozen=True)
class Union(Plan):
    parts: list[Plan]

    def lower(self, spark):
        return relational.union_all([p.lower(spark) for p in self.parts])

    def inputs(self):
        return list(self.parts)


@dataclass(frozen=True)
class Empty(Plan):
    schema: str

    def lower(self, spark):
        return spark.createDataFrame([], self.schema)
