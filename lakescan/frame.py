"""Batch: named columns over a lazy DataFrame.

Methods check names, operators and literals when called; work is done by Spark when values
are asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakescan.array import Array
from lakescan.dtypes import accepted_table, is_integer
from lakescan.errors import need_columns, need_unique
from lakescan.functions.aggregates import aggregate_name, aggregate_of, alias_of
from lakescan.functions.expressions import Expr, col, compare
from lakescan.operators import relational
from lakescan.schema import Schema
from lakescan.session import get_spark


class Batch:
    def __init__(self, names: list[str] | DataFrame, arrays: list | None = None):
        if isinstance(names, DataFrame):
            need_unique(names.columns)
            self.df = names
            return
        arrays = arrays or []
        if len(names) != len(arrays):
            raise ValueError(f"{len(names)} names for {len(arrays)} arrays")
        need_unique(names)
        data = [a.data if isinstance(a, Array) else pa.array(a) for a in arrays]
        if len({len(d) for d in data}) > 1:
            raise ValueError("the arrays differ in length")
        self.df = from_arrow(pa.table(data, names=names)).df if data else get_spark().createDataFrame([], "struct<>")

    # -- metadata
    @property
    def num_rows(self) -> int:
        return self.df.count()

    @property
    def num_columns(self) -> int:
        return len(self.df.columns)

    @property
    def column_names(self) -> list[str]:
        return self.df.columns

    @property
    def schema(self) -> Schema:
        return Schema(self.df.schema)

    @property
    def memory_size(self) -> int:
        return self.to_arrow().nbytes

    def __len__(self) -> int:
        return self.num_rows

    def null_counts(self) -> dict[str, int]:
        """In one pass."""
        if not self.df.columns:
            return {}
        return self.df.agg(*(F.count_if(F.col(relational.quoted(c)).isNull()).alias(c) for c in self.df.columns)).first().asDict()

    def has_nulls(self) -> bool:
        return any(self.null_counts().values())

    def __repr__(self) -> str:
        return f"Batch({self.schema!r})"

    # -- projection and rows
    def column(self, name: str) -> Array:
        need_columns(self.df.columns, [name])
        return Array(self.df.select(relational.quoted(name)).toArrow().column(0))

    def select(self, names: list[str]) -> Batch:
        need_columns(self.df.columns, names)
        return Batch(self.df.select(*map(relational.quoted, names)))

    def slice(self, offset: int, length: int, by: list[str] | None = None) -> Batch:
        """Rows of a defined order: that of `by`, else of the source as Spark reads it."""
        if offset < 0 or length < 0:
            raise ValueError("offset and length can't be negative")
        return Batch((self.df.orderBy(*map(relational.quoted, by)) if by else self.df).offset(offset).limit(length))

    def take(self, indices: list[int], by: list[str]) -> Batch:
        """Rows at positions of the order `by`, in the order of the indices; positions may repeat."""
        return Batch(relational.take(self.df, indices, by))

    def head(self, n: int = 10) -> Batch:
        return self.slice(0, n)

    def with_column(self, name: str, value: Expr) -> Batch:
        return Batch(self.df.withColumn(name, value.column(self.df.schema)))

    def cast(self, name: str, kind: str, strict: bool = False) -> Batch:
        """Values that can't be cast are null, or an error if strict."""
        need_columns(self.df.columns, [name])
        c = F.col(relational.quoted(name))
        return Batch(self.df.withColumn(name, c.cast(kind) if strict else c.try_cast(kind)))

    def __getitem__(self, name: str) -> Expr:
        need_columns(self.df.columns, [name])
        return col(name)

    # -- filter and aggregate
    def filter(self, column: str | Expr, op: str | None = None, value: Any = None) -> Batch:
        """filter("a", ">", 5) or filter(expression); null is not selected."""
        e = column if isinstance(column, Expr) else compare(column, op or "", value)
        return Batch(self.df.filter(e.column(self.df.schema, RuntimeError)))

    def agg(self, op: str, column: str) -> Any:
        """A number.  The sum of no values is 0; other aggregates of none are None."""
        op = aggregate_name(op)
        need_columns(self.df.columns, [column])
        kind = self.df.schema[column].dataType
        out = self.df.agg(aggregate_of(op, column, kind)).first()[0]
        if out is None and op == "sum":
            return 0 if is_integer(kind) else 0.0
        return out

    def aggregate(self, aggregates: list[tuple]) -> Batch:
        """(op, column[, alias]) each; one row, SQL semantics."""
        return Batch(relational.aggregate(self.df, [], aggregates))

    def group_by(self, *keys: str) -> Grouped:
        need_columns(self.df.columns, keys)
        return Grouped(self.df, list(keys))

    def rollup(self, keys: list[str], aggregates: list[tuple], cube: bool = False) -> Batch:
        """Groups by all leading keys, or by all subsets of them; null where a key is summed over."""
        need_columns(self.df.columns, keys)
        return Batch(relational.rollup(self.df, keys, aggregates, cube))

    # -- order, sets and joins
    def sort(self, by: list[tuple[str, bool] | str], nulls_first: bool = False) -> Batch:
        return Batch(relational.sort(self.df, by, nulls_first))

    def limit(self, n: int, offset: int = 0) -> Batch:
        return self.slice(offset, n)

    def join(self, other: Batch, on: list[tuple[str, str] | str] | str | None = None, how: str = "inner") -> Batch:
        return Batch(relational.join(self.df, other.df, on, how))

    def join_asof(self, other: Batch, at: tuple[str, str], by: list[str], values: list[str]) -> Batch:
        """With the values of the other's last row at or before the time."""
        return Batch(relational.asof(self.df, other.df, at, by, values))

    def union(self, *others: Batch) -> Batch:
        return Batch(relational.union_all([self.df, *(o.df for o in others)]))

    def distinct(self) -> Batch:
        return Batch(self.df.distinct())

    def intersect(self, other: Batch) -> Batch:
        """Different rows that both have; nulls are alike."""
        return Batch(self.df.intersect(other.df))

    def subtract(self, other: Batch) -> Batch:
        """Different rows that the other doesn't have; nulls are alike."""
        return Batch(self.df.subtract(other.df))

    # -- functions of the user
    def map_batches(self, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> Batch:
        """Arrow batches in and out, on the executors."""
        return Batch(self.df.mapInArrow(f, schema))

    def map_column(self, name: str, f: Callable, columns: list[str], kind: str) -> Batch:
        """A column out of others by a function of Arrow arrays."""
        need_columns(self.df.columns, columns)
        return Batch(self.df.withColumn(name, F.arrow_udf(f, kind)(*map(relational.quoted, columns))))

    # -- export
    def to_arrow(self) -> pa.Table:
        return self.df.toArrow()

    def to_pandas(self):
        return self.to_arrow().to_pandas()

    def to_numpy(self, name: str):
        return self.column(name).to_numpy()

    def to_tensor(self, name: str) -> pa.Tensor:
        """Of a numeric column without nulls."""
        return pa.Tensor.from_numpy(self.to_numpy(name))

    def to_pydict(self) -> dict[str, list]:
        return self.to_arrow().to_pydict()

    def iter_batches(self, batch_size: int = 10_000) -> Iterator[pa.Table]:
        from lakescan.sinks import batches

        return batches(self.df, batch_size)

    def __arrow_c_stream__(self, requested_schema=None):
        return self.to_arrow().__arrow_c_stream__(requested_schema)

    def __arrow_c_array__(self, requested_schema=None):
        data = self.to_arrow().combine_chunks()
        parts = data.to_batches()
        return (parts[0] if parts else pa.RecordBatch.from_pylist([], schema=data.schema)).__arrow_c_array__(requested_schema)

    def explain(self) -> str:
        return self.df._jdf.queryExecution().explainString(self.df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    def cache(self) -> Batch:
        return Batch(self.df.cache())

    def release(self) -> Batch:
        return Batch(self.df.unpersist())


class Grouped:
    def __init__(self, df: DataFrame, keys: list[str]):
        self.df, self.keys = df, keys

    def agg(self, aggregates: list[tuple]) -> Batch:
        return Batch(relational.aggregate(self.df, self.keys, aggregates))

    def map_groups(self, f: Callable[[pa.Table], pa.Table], schema: str) -> Batch:
        """A table for each group's table.  A group is held by one task, so it must fit there; aggregates have no such bound."""
        return Batch(self.df.groupBy(*map(relational.quoted, self.keys)).applyInArrow(f, schema))


def from_arrow(data: pa.Table | pa.RecordBatch, spark: SparkSession | None = None) -> Batch:
    data = pa.table(data) if not isinstance(data, pa.Table) else data
    need_unique(data.column_names)
    return Batch((spark or get_spark()).createDataFrame(accepted_table(data)))


def from_batch(batch: Batch) -> Batch:
    return Batch(batch.df)


def empty(schema: str, spark: SparkSession | None = None) -> Batch:
    return Batch((spark or get_spark()).createDataFrame([], schema))


__all__ = ["Batch", "Grouped", "alias_of", "empty", "from_arrow", "from_batch"]
