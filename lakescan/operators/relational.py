"""Aggregate, sort, join, union, take and window."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakescan.errors import need_columns
from lakescan.functions.aggregates import aggregate_of, alias_of
from lakescan.session import scratch

JOINS = {"inner": "inner", "left": "left", "right": "right", "full": "full", "cross": "cross", "semi": "left_semi", "anti": "left_anti"}


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def aggregate(df: DataFrame, keys: list[str], aggregates: list[tuple]) -> DataFrame:
    """(op, column[, alias]) each; the default alias is like SUM_value."""
    need_columns(df.columns, [*keys, *(a[1] for a in aggregates)])
    if not aggregates:
        raise ValueError("no aggregates")
    made = [aggregate_of(op, c, df.schema[c].dataType).alias(alias[0] if alias and alias[0] else alias_of(op, c)) for op, c, *alias in aggregates]
    return df.groupBy(*map(quoted, keys)).agg(*made) if keys else df.agg(*made)


def rollup(df: DataFrame, keys: list[str], aggregates: list[tuple], cube: bool = False) -> DataFrame:
    need_columns(df.columns, [*keys, *(a[1] for a in aggregates)])
    made = [aggregate_of(op, c, df.schema[c].dataType).alias(alias[0] if alias and alias[0] else alias_of(op, c)) for op, c, *alias in aggregates]
    return (df.cube if cube else df.rollup)(*map(quoted, keys)).agg(*made)


def sort(df: DataFrame, by: list, nulls_first: bool = False) -> DataFrame:
    """Names, or (name, ascending); the place of nulls is always stated."""
    pairs = [(b, True) if isinstance(b, str) else b for b in by]
    need_columns(df.columns, [n for n, _ in pairs])
    kinds = {(True, True): "asc_nulls_first", (True, False): "asc_nulls_last", (False, True): "desc_nulls_first", (False, False): "desc_nulls_last"}
    return df.orderBy(*(getattr(F.col(quoted(n)), kinds[bool(up), nulls_first])() for n, up in pairs))


def top(df: DataFrame, by: list, n: int) -> DataFrame:
    return sort(df, by).limit(n)


def join(left: DataFrame, right: DataFrame, on, how: str = "inner", null_safe: bool = False) -> DataFrame:
    """Equi-join on name pairs; null keys never match, or match each other if ``null_safe``.

    Of keys with equal names one is kept (in a full join the one that is there).  Other names that
    occur on both sides get ``_right`` on the right one.  No side is broadcast by force: Spark does
    it where statistics show that one is small, and splits skewed partitions otherwise.
    """
    if how not in JOINS:
        raise ValueError(f"unknown join {how!r}; there are {', '.join(JOINS)}")
    pairs = [(p, p) if isinstance(p, str) else tuple(p) for p in ([on] if isinstance(on, str) else on or [])]
    if (how == "cross") == bool(pairs):
        raise ValueError("a cross join has no keys, any other has some")
    need_columns(left.columns, [a for a, _ in pairs])
    need_columns(right.columns, [b for _, b in pairs])
    kept = [n for n in right.columns if (n, n) not in pairs] if how not in ("right", "full") else right.columns
    taken, new = set(left.columns), {}
    for n in kept:
        name = n
        while name in taken or name in new.values():
            name += "_right"
        new[n] = name
    keys = {b: f"__key{k}" for k, (_, b) in enumerate(pairs)}
    side = right.select(*(F.col(quoted(b)).alias(k) for b, k in keys.items()), *(F.col(quoted(n)).alias(new[n]) for n in kept if how not in ("semi", "anti")))
    if how == "cross":
        return left.crossJoin(side)
    cond = reduce(lambda x, y: x & y, (left[quoted(a)].eqNullSafe(side[keys[b]]) if null_safe else left[quoted(a)] == side[keys[b]] for a, b in pairs))
    out = left.join(side, cond, JOINS[how])
    if how in ("semi", "anti"):
        return out
    same = {a for a, b in pairs if a == b}
    shown = [F.coalesce(left[quoted(c)], side[keys[c]]).alias(c) if c in same and how in ("right", "full") else left[quoted(c)] for c in left.columns]
    return out.select(*shown, *(side[quoted(new[n])] for n in kept if n not in same))


def asof(left: DataFrame, right: DataFrame, at: tuple[str, str], by: list[str], values: list[str]) -> DataFrame:
    """Rows of left with the values of right's last row at or before their time, of equal keys ``by``; null if there is none.

    Both sides are dealt out by key and passed once in the order of time: no pairs are made.  Of right's rows at one time the one with the
    greatest values counts.  A null time comes before all others and meets none.
    """
    need_columns(left.columns, [*by, at[0]])
    need_columns(right.columns, [*by, at[1], *values])
    new = {v: v + "_right" if v in left.columns else v for v in values}
    held = F.struct(*(F.col(quoted(v)).alias(n) for v, n in new.items())).alias("__held")
    keys = [F.col(quoted(k)).alias(f"__k{i}") for i, k in enumerate(by)]
    row = F.struct(*map(quoted, left.columns)).alias("__row")
    a = left.select(*keys, F.col(quoted(at[0])).alias("__at"), F.lit(1).alias("__side"), row, F.lit(None).cast(right.select(held).schema["__held"].dataType).alias("__held"))
    b = right.where(F.col(quoted(at[1])).isNotNull()).select(*keys, F.col(quoted(at[1])).alias("__at"), F.lit(0).alias("__side"), F.lit(None).cast(left.select(row).schema["__row"].dataType).alias("__row"), held)
    w = Window.partitionBy(*(f"__k{i}" for i in range(len(by)))).orderBy("__at", "__side", "__held").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("__last", F.last("__held", ignorenulls=True).over(w)).where("__side = 1")
    return both.select("__row.*", *(F.col("__last")[n].alias(n) for n in new.values()))


def union_all(frames: list[DataFrame]) -> DataFrame:
    """By position."""
    if not frames:
        raise ValueError("nothing to unite")
    if len({len(f.columns) for f in frames}) > 1:
        raise ValueError("the inputs differ in their number of columns")
    return reduce(DataFrame.unionAll, frames)


def numbered(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """Adds positions from 0 in the order `by`, without moving all rows to one task.

    Rows are dealt out by range and numbered within partitions; the counts of the partitions before
    are added.  Rows that tie take the order of their other columns.  The numbered rows are written to
    the shared folder, so that both uses see one numbering and lost executors change nothing.
    """
    need_columns(df.columns, by)
    rest = [f.name for f in df.schema if f.name not in by and not isinstance(f.dataType, (T.MapType, T.VariantType))]
    held = df.repartitionByRange(*map(quoted, by)).sortWithinPartitions(*map(quoted, [*by, *rest])).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    held.write.parquet(path := scratch(df.sparkSession))
    held = df.sparkSession.read.schema(held.schema).parquet(path)
    before = held.groupBy("__part").count()
    before = before.withColumn("__before", F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)))
    return held.join(F.broadcast(before.select("__part", F.coalesce("__before", F.lit(0)).alias("__before"))), "__part").withColumn(name, F.col("__at") + F.col("__before")).drop("__part", "__at", "__before")


def take(df: DataFrame, indices: list[int], by: list[str]) -> DataFrame:
    if any(i < 0 for i in indices):
        raise IndexError("an index is negative")
    spark = df.sparkSession
    wanted = spark.createDataFrame([(k, i) for k, i in enumerate(indices)], "__k long, __i long")
    # The list comes from the caller's memory, so it is small enough to send.
    return numbered(df, by, "__row").join(F.broadcast(wanted), F.col("__row") == F.col("__i")).orderBy("__k").drop("__row", "__k", "__i")


def ranked(df: DataFrame, partition_by: list[str], order_by: list, name: str = "rank", function: str = "row_number") -> DataFrame:
    """row_number, rank, dense_rank or ntile-free relatives over a partition."""
    if function not in ("row_number", "rank", "dense_rank", "percent_rank", "cume_dist"):
        raise ValueError(f"unknown ranking {function!r}")
    return df.withColumn(name, getattr(F, function)().over(Window.partitionBy(*partition_by).orderBy(*_orders(order_by))))


def running(df: DataFrame, partition_by: list[str], order_by: list, op: str, column: str, name: str) -> DataFrame:
    """An aggregate from the partition's first row to the present one."""
    need_columns(df.columns, [*partition_by, column])
    w = Window.partitionBy(*partition_by).orderBy(*_orders(order_by)).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, aggregate_of(op, column, df.schema[column].dataType).over(w))


def shifted(df: DataFrame, partition_by: list[str], order_by: list, column: str, by: int, name: str) -> DataFrame:
    """The value so many rows before (after, if negative)."""
    need_columns(df.columns, [*partition_by, column])
    w = Window.partitionBy(*partition_by).orderBy(*_orders(order_by))
    return df.withColumn(name, F.lag(column, by).over(w) if by >= 0 else F.lead(column, -by).over(w))


def _orders(by: list) -> list:
    return [F.col(quoted(b)).asc_nulls_last() if isinstance(b, str) else F.col(quoted(b[0])).asc_nulls_last() if b[1] else F.col(quoted(b[0])).desc_nulls_last() for b in by]
