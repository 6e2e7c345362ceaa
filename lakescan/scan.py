"""Scans: an opened source with its metadata and one-call queries."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakescan.errors import need_columns
from lakescan.frame import Batch
from lakescan.functions.aggregates import aggregate_name, aggregate_of
from lakescan.functions.expressions import Expr, compare
from lakescan.operators.relational import quoted
from lakescan.session import get_spark
from lakescan.sources import arrow_ipc, csv, json, parquet
from lakescan.sources.files import listed, local


#: Files whose footers the driver reads itself to count rows.
FEW = 64


class ScanResult:
    """Lazy: opening reads the schema (and, for text, the records that decide the types)."""

    def __init__(self, spark: SparkSession, path: str, form: str, df: DataFrame):
        self.spark, self.path, self.format, self.df = spark, path, form, df

    # -- metadata
    @property
    def column_names(self) -> list[str]:
        return self.df.columns

    @property
    def num_columns(self) -> int:
        return len(self.df.columns)

    @property
    def num_rows(self) -> int:
        """Of few Parquet files from their footers.  Else counted by the executors, of IPC from one column."""
        if self.format == "parquet" and len(files := listed(self.spark, self.path)) <= FEW:
            return sum(n for _, _, n in parquet.row_groups(self.spark, files))
        return (self._frame(self.df.columns[:1]) if self.format == "ipc" else self.df).count()

    def __len__(self) -> int:
        return self.num_rows

    @property
    def mmap_size(self) -> int:
        """Bytes of mapped files; 0 for formats that aren't mapped."""
        return sum(os.path.getsize(f) for f in arrow_ipc.files_of(self.path)) if self.format == "ipc" else 0

    def batch_row_counts(self) -> list[int]:
        """Rows of each record batch or row group; empty for text formats."""
        if self.format == "ipc":
            return arrow_ipc.row_counts(self.path)
        if self.format == "parquet":
            return [n for _, _, n in parquet.row_groups(self.spark, listed(self.spark, self.path))]
        return []

    @property
    def num_batches(self) -> int:
        return len(self.batch_row_counts()) if self.format in ("ipc", "parquet") else 1

    def __repr__(self) -> str:
        return f"ScanResult({self.path!r}, {self.format}, {self.num_columns} columns)"

    # -- reads
    def _frame(self, columns: list[str]) -> DataFrame:
        """Only these columns are decoded."""
        if self.format == "ipc":
            return arrow_ipc.read(self.spark, self.path, columns)
        return self.df.select(*map(quoted, columns))

    def read_all(self) -> Batch:
        return Batch(self.df)

    def read_columns(self, names: list[str]) -> Batch:
        """In the order asked for."""
        if not names:
            raise ValueError("no columns")
        need_columns(self.df.columns, names, ValueError)
        return Batch(self._frame(names))

    def read_columns_at(self, indices: list[int]) -> Batch:
        if any(not 0 <= i < self.num_columns for i in indices):
            raise IndexError(f"columns {indices} of {self.num_columns}")
        return self.read_columns([self.df.columns[i] for i in indices])

    def read_batch(self, index: int, columns: list[str] | None = None) -> Batch:
        """A record batch or row group; text formats have one batch."""
        groups = parquet.row_groups(self.spark, listed(self.spark, self.path)) if self.format == "parquet" else None
        n = self.num_batches if groups is None else len(groups)
        if not 0 <= index < n:
            raise IndexError(f"batch {index} of {n}")
        if columns is not None:
            need_columns(self.df.columns, columns, IndexError)
        if self.format == "ipc":
            return Batch(arrow_ipc.read(self.spark, self.path, columns, index))
        if groups is not None:
            return Batch(parquet.read_row_group(self.spark, self.df, groups, index, columns))
        return self.read_columns(columns) if columns else self.read_all()

    def read_row_groups(self, indices: Iterable[int] | None = None, columns: list[str] | None = None, number: str | None = None) -> Batch:
        """Row groups, all by default, in one scan, with their numbers in a column if it is named.  Rows of a group named twice come twice; their order is open."""
        if self.format != "parquet":
            raise NotImplementedError("only Parquet has row groups")
        groups = parquet.row_groups(self.spark, listed(self.spark, self.path))
        wanted = range(len(groups)) if indices is None else list(indices)
        for k in wanted:
            if not 0 <= k < len(groups):
                raise IndexError(f"batch {k} of {len(groups)}")
        if columns is not None:
            need_columns(self.df.columns, columns, IndexError)
        return Batch(parquet.read_row_groups(self.spark, self.df, groups, wanted, columns, number))

    def iter_batches(self, batch_size: int = 10_000) -> Iterator[pa.Table]:
        return self.read_all().iter_batches(batch_size)

    # -- queries
    def filter_column(self, column: str, op: str, value: Any) -> Batch:
        """All columns of matching rows; no match gives an empty batch."""
        return self.filter(compare(column, op, value))

    filter_parallel = filter_column

    def filter(self, e: Expr) -> Batch:
        return Batch(self.df.filter(e.column(self.df.schema, RuntimeError)))

    def agg_column(self, op: str, column: str) -> Any:
        """SQL semantics: None without values, but a count is 0.  Reads one column."""
        op = aggregate_name(op)
        need_columns(self.df.columns, [column], RuntimeError)
        return self._frame([column]).agg(aggregate_of(op, column, self.df.schema[column].dataType)).first()[0]

    def filter_agg(self, filter_column: str, op: str, value: Any, agg_column: str, agg_op: str) -> Any:
        """Filter and aggregate in one pass over two columns."""
        agg_op = aggregate_name(agg_op)
        need_columns(self.df.columns, [filter_column, agg_column], RuntimeError)
        frame = self._frame(list(dict.fromkeys([filter_column, agg_column])))
        kept = frame.filter(compare(filter_column, op, value).column(frame.schema, RuntimeError))
        return kept.agg(aggregate_of(agg_op, agg_column, self.df.schema[agg_column].dataType)).first()[0]

    def row_groups_matching_filter(self, column: str, op: str, value: Any) -> list[int]:
        if self.format != "parquet":
            raise NotImplementedError("only Parquet has row groups")
        return parquet.row_groups_matching(listed(self.spark, self.path), column, op, value)

    def schema_metadata(self) -> dict[str, str]:
        if self.format != "parquet":
            return {}
        meta = pq.read_schema(local(listed(self.spark, self.path)[0].path)).metadata or {}
        return {k.decode(): v.decode(errors="replace") for k, v in meta.items()}

    def prefetch(self) -> ScanResult:
        """Keeps the rows in the executors' memory from the first use on."""
        return ScanResult(self.spark, self.path, self.format, self.df.cache())

    def release(self) -> ScanResult:
        self.df.unpersist()
        return self

    def persisted(self) -> bool:
        return self.df.is_cached

    def approximate_rows(self) -> int:
        """By the optimizer's size estimate where the footers can't be read; no job."""
        size = int(str(self.df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        return size // max(1, 8 * self.num_columns)

    def null_count(self, column: str) -> int:
        need_columns(self.df.columns, [column], RuntimeError)
        return self._frame([column]).agg(F.count_if(F.col(quoted(column)).isNull())).first()[0]


def scan_parquet(path: str, spark: SparkSession | None = None) -> ScanResult:
    spark = spark or get_spark()
    return ScanResult(spark, str(path), "parquet", parquet.read(spark, str(path)))


def scan_ipc(path: str, spark: SparkSession | None = None) -> ScanResult:
    spark = spark or get_spark()
    return ScanResult(spark, str(path), "ipc", arrow_ipc.read(spark, str(path)))


def scan_csv(path: str, has_header: bool = True, delimiter: str = ",", spark: SparkSession | None = None, **options) -> ScanResult:
    spark = spark or get_spark()
    return ScanResult(spark, str(path), "csv", csv.read(spark, str(path), has_header, delimiter, **options))


def scan_json(path: str, form: str = "auto", spark: SparkSession | None = None) -> ScanResult:
    spark = spark or get_spark()
    return ScanResult(spark, str(path), "json", json.read(spark, str(path), form))


def scan(path: str, spark: SparkSession | None = None) -> ScanResult:
    """By the name's ending; what is not Parquet, CSV or JSON is Arrow IPC."""
    ending = os.path.splitext(str(path).rstrip("/"))[1].lower()
    reader = {".parquet": scan_parquet, ".pq": scan_parquet, ".csv": scan_csv, ".json": scan_json, ".ndjson": scan_json, ".jsonl": scan_json}.get(ending, scan_ipc)
    return reader(path, spark=spark)
