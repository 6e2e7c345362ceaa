"""A fixed pipeline over a batch: filter, project, aggregate."""

from __future__ import annotations

from lakescan.frame import Batch
from lakescan.functions.expressions import Expr


class QueryPlan:
    """Steps may be given in any order; several filters must all hold.  Aggregates see projected columns."""

    def __init__(self):
        self.condition: Expr | None = None
        self.columns: list[str] | None = None
        self.aggregates: list[tuple] = []

    def filter(self, e: Expr) -> QueryPlan:
        self.condition = e if self.condition is None else self.condition.and_(e)
        return self

    def project(self, names: list[str]) -> QueryPlan:
        self.columns = names
        return self

    def aggregate(self, op: str, column: str, alias: str | None = None) -> QueryPlan:
        self.aggregates.append((op, column, alias))
        return self

    def lower(self, batch: Batch) -> Batch:
        if self.condition is not None:
            batch = batch.filter(self.condition)
        if self.columns is not None:
            batch = batch.select(self.columns)
        return batch.aggregate(self.aggregates) if self.aggregates else batch

    def execute(self, batch: Batch) -> Batch | dict:
        """Values by alias if there are aggregates, else a batch."""
        out = self.lower(batch)
        return out.df.first().asDict() if self.aggregates else out
