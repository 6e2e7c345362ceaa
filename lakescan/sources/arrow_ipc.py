"""Arrow IPC files as a Spark data source, a partition for each record batch.

Options: path (file, folder or pattern), columns (comma-separated JSON list; only these are
decoded), batch (one batch only), compression (of written files: lz4, zstd).
"""

from __future__ import annotations

import glob
import json
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema

from lakescan.dtypes import accepted_schema, accepted_table
from lakescan.sources.files import local

FORMAT = "lakescan_ipc"


def files_of(path: str) -> list[str]:
    """Local or mounted files; a folder holds a file for each task that wrote."""
    path = local(path)
    if os.path.isdir(path):
        return sorted(x for x in glob.glob(f"{glob.escape(path)}/*") if os.path.isfile(x) and not os.path.basename(x).startswith(("_", ".")))
    return sorted(glob.glob(path)) or [path]


def opened(path: str, columns: list[str] | None = None) -> pa.RecordBatchFileReader:
    source = pa.memory_map(path)
    if columns is None:
        return pa.ipc.open_file(source)
    names = pa.ipc.open_file(source).schema.names
    return pa.ipc.open_file(source, options=pa.ipc.IpcReadOptions(included_fields=[names.index(c) for c in columns]))


def row_counts(path: str) -> list[int]:
    """Of each batch.  Only the narrowest column is decoded."""
    out = []
    for f in files_of(path):
        fields = list(opened(f).schema)
        least = min(fields, key=lambda x: x.type.bit_width if pa.types.is_primitive(x.type) else 1 << 20).name if fields else None
        data = opened(f, [least] if least else None)
        out += [data.get_batch(k).num_rows for k in range(data.num_record_batches)]
    return out


def batches_of(path: str) -> list[tuple[str, int]]:
    return [(f, k) for f in files_of(path) for k in range(opened(f).num_record_batches)]


class Batch(InputPartition):
    def __init__(self, path: str, index: int):
        self.path, self.index = path, index


class Reader(DataSourceReader):
    def __init__(self, options: dict, schema: pa.Schema):
        self.options, self.schema = options, schema

    def partitions(self):
        found = batches_of(self.options["path"])
        if "batch" in self.options:
            found = [found[int(self.options["batch"])]]
        return [Batch(*x) for x in found] or [Batch("", -1)]

    def read(self, partition: Batch) -> Iterator[pa.RecordBatch]:
        if partition.index < 0:
            return
        data = opened(partition.path, self.schema.names).get_batch(partition.index)
        data = pa.Table.from_batches([data]).select(self.schema.names)
        yield from accepted_table(data).cast(accepted_schema(self.schema)).to_batches(max_chunksize=1 << 16)


class Done(WriterCommitMessage):
    def __init__(self, path: str):
        self.path = path


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: pa.Schema, overwrite: bool):
        self.options, self.schema, self.overwrite = options, schema, overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> Done:
        folder = local(self.options["path"])
        os.makedirs(folder, exist_ok=True)
        path = f"{folder}/.{uuid.uuid4().hex}.arrow"  # hidden until the job commits
        options = pa.ipc.IpcWriteOptions(compression=self.options.get("compression"))
        out = None
        for b in batches:
            out = out or pa.ipc.new_file(path, b.schema, options=options)
            out.write_batch(b)
        if out is None:
            return Done("")
        out.close()
        return Done(path)

    def commit(self, messages: list[Done | None]) -> None:
        folder = local(self.options["path"])
        if not any(m and m.path for m in messages):  # the schema of an empty table is kept by a file without batches
            os.makedirs(folder, exist_ok=True)
            path = f"{folder}/.{uuid.uuid4().hex}.arrow"
            pa.ipc.new_file(path, self.schema).close()
            messages = [Done(path)]
        old = files_of(folder) if self.overwrite and os.path.isdir(folder) else []
        for k, m in enumerate(x for x in messages if x and x.path):
            os.rename(m.path, f"{folder}/part-{k:05d}-{os.path.basename(m.path)[1:]}")
        for x in old:
            os.remove(x)

    def abort(self, messages: list[Done | None]) -> None:
        for m in messages:
            if m and m.path and os.path.exists(m.path):
                os.remove(m.path)


class ArrowIpc(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _arrow_schema(self) -> pa.Schema:
        found = opened(files_of(self.options["path"])[0]).schema
        if "columns" in self.options:
            found = pa.schema([found.field(c) for c in json.loads(self.options["columns"])])
        return found

    def schema(self):
        return from_arrow_schema(accepted_schema(self._arrow_schema()))

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options), self._arrow_schema())

    def writer(self, schema, overwrite: bool) -> Writer:
        from pyspark.sql.pandas.types import to_arrow_schema

        return Writer(dict(self.options), to_arrow_schema(schema), overwrite)


def read(spark: SparkSession, path: str, columns: list[str] | None = None, batch: int | None = None) -> DataFrame:
    spark.dataSource.register(ArrowIpc)
    source = spark.read.format(FORMAT).option("path", path)
    if columns is not None:
        source = source.option("columns", json.dumps(columns))
    if batch is not None:
        source = source.option("batch", str(batch))
    try:
        files = files_of(path)
        if not files or not os.path.exists(files[0]):
            raise FileNotFoundError(f"no such file: {path}")
        opened(files[0])
        return source.load()
    except pa.ArrowException as e:
        raise OSError(f"{path} is no Arrow IPC file: {e}") from e


def write_folder(df: DataFrame, path: str, compression: str | None = None, mode: str = "overwrite") -> None:
    """A file for each task, written where the tasks run; they appear when all have succeeded."""
    df.sparkSession.dataSource.register(ArrowIpc)
    sink = df.write.format(FORMAT).mode(mode).option("path", path)
    (sink.option("compression", compression) if compression else sink).save()
