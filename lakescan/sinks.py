"""Sinks: one Arrow IPC file, folders of any format, streams of batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lakescan.sources import arrow_ipc
from lakescan.sources.files import local


def write_ipc_batches(path: str, batches: list[pa.Table], compression: str | None = None) -> None:
    """Several batches of one schema in a single file, kept apart as record batches."""
    if not batches:
        raise ValueError("no batches to write")
    if any(b.schema != batches[0].schema for b in batches):
        raise ValueError("the batches' schemas differ")
    if compression not in (None, "lz4", "zstd"):
        raise ValueError("compression is lz4, zstd or None")
    with pa.ipc.new_file(local(path), batches[0].schema, options=pa.ipc.IpcWriteOptions(compression=compression)) as out:
        for b in batches:
            out.write_table(b.combine_chunks())


def write_ipc_file(path: str, batch, compression: str | None = None) -> None:
    """One file, written by the driver.  For what exceeds its memory use write_ipc_folder."""
    write_ipc_batches(path, [batch.to_arrow()], compression)


def append_ipc_file(path: str, batch, compression: str | None = None) -> None:
    """IPC files have their index at the end, so this writes the file anew with one more batch."""
    with pa.OSFile(local(path)) as f:
        old = pa.ipc.open_file(f)
        held = [pa.Table.from_batches([old.get_batch(k)]) for k in range(old.num_record_batches)]
    write_ipc_batches(path, [*held, batch.to_arrow().cast(held[0].schema) if held else batch.to_arrow()], compression)


def write_ipc_folder(path: str, batch, compression: str | None = None, append: bool = False) -> None:
    arrow_ipc.write_folder(batch.df, path, compression, "append" if append else "overwrite")


def write(batch, path: str, form: str = "parquet", append: bool = False, partition_by: list[str] | None = None, **options) -> None:
    """parquet, csv, json or orc, by the executors."""
    sink = batch.df.write.mode("append" if append else "overwrite").options(**options)
    (sink.partitionBy(*partition_by) if partition_by else sink).format(form).save(path)


def batches(df: DataFrame, rows: int = 10_000) -> Iterator[pa.Table]:
    """Tables of at most so many rows, partition by partition; the driver holds one partition at a time, as Arrow bytes."""

    def packed(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            for at in range(0, b.num_rows, rows):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, b.schema) as out:
                    out.write_batch(b.slice(at, rows))
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["data"])

    for row in df.mapInArrow(packed, "data binary").toLocalIterator(prefetchPartitions=True):
        yield pa.ipc.open_stream(row["data"]).read_all()
