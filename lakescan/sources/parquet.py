"""Parquet: Spark's reader, and the footer for row groups."""

from __future__ import annotations

from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakescan.functions.expressions import COMPARISONS, comparison
from lakescan.operators.relational import quoted
from lakescan.sources.files import File, local, needed


def read(spark: SparkSession, path: str) -> DataFrame:
    needed(spark, path)
    try:
        return spark.read.parquet(path)
    except Exception as e:
        raise OSError(f"{path} is no Parquet file: {str(e).splitlines()[0]}") from e


def row_groups(spark: SparkSession, files: list[File], threads: int = 16) -> list[tuple[str, int, int]]:
    """file, row group, rows.  Footers only, several at a time, of any store that Spark reads."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def one(f: File) -> list[tuple[str, int, int]]:
        at = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(f.path), conf)
        footer = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(at)
        try:
            return [(f.path, k, block.getRowCount()) for k, block in enumerate(footer.getRowGroups())]
        finally:
            footer.close()

    with ThreadPoolExecutor(threads) as pool:
        return [x for found in pool.map(one, files) for x in found]


#: A row's file without its scheme, whose slashes Spark writes in several ways; the same as known() gives.
FILE = "trim(LEADING '/' FROM substring(_metadata.file_path, instr(_metadata.file_path, ':') + 1))"


def known(spark: SparkSession, df: DataFrame, paths: set[str]) -> dict[str, str]:
    """How rows name their file, for files as they are listed."""
    out = {p: spark._jvm.org.apache.hadoop.fs.Path(p).toUri().toString().split(":", 1)[-1].lstrip("/") for p in paths}
    held = {f.split(":", 1)[-1].lstrip("/") for f in df.inputFiles()}  # none of a cached scan
    if gone := next((p for p, name in out.items() if held and name not in held), None):
        raise OSError(f"{gone} came after the scan was opened")
    return out


def places(groups: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """file, first row there and rows of each group."""
    out, ends = [], {}
    for path, _, n in groups:
        out.append((path, first := ends.get(path, 0), n))
        ends[path] = first + n
    return out


def read_row_group(spark: SparkSession, df: DataFrame, groups: list[tuple[str, int, int]], index: int, columns: list[str] | None = None) -> DataFrame:
    """By the places of its rows in their file; other files aren't read."""
    path, first, n = places(groups)[index]
    at = F.col("_metadata.row_index")
    return df.where((F.expr(FILE) == known(spark, df, {path})[path]) & (at >= first) & (at < first + n)).select(*map(quoted, columns or df.columns))


def read_row_groups(spark: SparkSession, df: DataFrame, groups: list[tuple[str, int, int]], indices: Iterable[int], columns: list[str] | None = None, number: str | None = None) -> DataFrame:
    """Any number of groups in one scan.  Rows meet their group by file and block of rows; a block is as long as a group in the mean, so the work is linear."""
    placed = places(groups)
    wanted = [(k, *placed[k]) for k in indices]
    names = known(spark, df, {path for _, path, _, _ in wanted})
    length = max(1, sum(n for *_, n in wanted) // max(1, len(wanted)))
    found = [(names[path], block, k, first, first + n) for k, path, first, n in wanted if n for block in range(first // length, (first + n - 1) // length + 1)]
    kinds = {"file": pa.string(), "block": pa.int64(), "index": pa.int64(), "first": pa.int64(), "end": pa.int64()}
    table = spark.createDataFrame(pa.table({c: pa.array([x[at] for x in found], kind) for at, (c, kind) in enumerate(kinds.items())}))
    columns = columns or df.columns
    # Under other names, so that no column of the file is taken for one of the table's.
    rows = df.select(F.expr(FILE).alias("row file"), F.col("_metadata.row_index").alias("row at"), *(F.col(quoted(c)).alias(f"row {k}") for k, c in enumerate(columns)))
    if len(names) < len({path for path, _, _ in groups}):  # other files aren't read
        rows = rows.where(F.col("row file").isin(*names.values()))
    met = rows.join(table, F.expr(f"`row file` = file AND `row at` div {length} = block AND `row at` >= first AND `row at` < end"))
    return met.select(*(F.col(f"row {k}").alias(c) for k, c in enumerate(columns)), *([F.col("index").alias(number)] if number else []))


def row_groups_matching(files: list[File], column: str, op: str, value) -> list[int]:
    """Row groups whose statistics don't rule a match out.  Shows what the scan's own pruning can do."""
    op, out, index = comparison(op), [], 0
    for f in files:
        meta = pq.read_metadata(local(f.path))
        at = meta.schema.to_arrow_schema().get_field_index(column)
        if at < 0:
            raise RuntimeError(f"no column {column!r}")
        for k in range(meta.num_row_groups):
            s = meta.row_group(k).column(at).statistics
            if s is None or not s.has_min_max:
                keep = True
            elif op == "=":
                keep = s.min <= value <= s.max
            elif op == "!=":
                keep = not s.min == s.max == value
            else:
                keep = COMPARISONS[op](s.min if op in ("<", "<=") else s.max, value)
            if keep:
                out.append(index)
            index += 1
    return out
