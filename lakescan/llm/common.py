"""What the operators share: reading tables, cutting lineage, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an output batch; keeps what a Python worker holds small.
OUT_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Only if it is unset and none was chosen (as in tests) is one made here, and then only on one
    machine: on a cluster the executors would each write to a folder of their own.
    """
    sc = spark.sparkContext
    if named := spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir"):
        return named
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(made := tempfile.mkdtemp(prefix="lakescan-checkpoint-"))
        delete_at_end(spark, made)
    return sc.getCheckpointDir()


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def delete(spark: SparkSession, path: str) -> None:
    """A file or folder in any store that Spark reaches."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def delete_at_end(spark: SparkSession, path: str) -> None:
    """When the driver's JVM ends."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)


class Tables:
    """Tables written to the shared folder to cut the lineage.  They are compressed, the planner knows their size,
    and whoever made them deletes them when nothing reads them any more.  What a returned DataFrame still reads goes when the driver ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.made = spark, f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}", 0

    def put(self, df: DataFrame) -> DataFrame:
        self.made += 1
        path = f"{self.path}/{self.made}"
        df.write.parquet(path)
        if self.made == 1:
            delete_at_end(self.spark, self.path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._path = path
        return out

    def drop(self, df: DataFrame) -> None:
        delete(self.spark, df._path)

    def clear(self) -> None:
        delete(self.spark, self.path)


def dealt_join(many: DataFrame, one: DataFrame, on: str, by: list[str], hot: int = 256, shares: int = 64) -> DataFrame:
    """Inner join of ``many`` with ``one``, which has one row for each key and the number n of its rows in ``many``.

    The ``hot`` keys of largest n are dealt to ``shares`` tasks by a hash of the columns ``by``; of any other key
    ``many`` holds less than one row in ``hot``.  What is broadcast has ``hot`` rows at most.
    """
    top = F.broadcast(one.orderBy(F.desc("n"), on).limit(hot).select(F.col(on).alias("__key")))
    salt = F.when(F.col("__key").isNotNull(), F.pmod(F.xxhash64(*by), F.lit(shares)).cast("int")).otherwise(0)
    many = many.join(top, F.col(on) == F.col("__key"), "left").withColumn("__salt", salt).drop("__key")
    salts = F.when(F.col("__key").isNotNull(), F.sequence(F.lit(0), F.lit(shares - 1))).otherwise(F.array(F.lit(0)))
    one = one.join(top, F.col(on) == F.col("__key"), "left").withColumn("__salt", F.explode(salts)).drop("__key")
    return many.join(one, [on, "__salt"]).drop("__salt")


def whole_text(column: str = "text"):
    """The text, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def batched(rows: Iterable[tuple], schema: pa.Schema, size: int = OUT_ROWS) -> Iterator[pa.RecordBatch]:
    """Record batches of at most ``size`` rows out of row tuples."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)


def map_rows(df: DataFrame, columns: list[str], make: Callable[[], Callable], fields: list[tuple[str, str, pa.DataType]]) -> DataFrame:
    """Apply a row function, made once per task, with Arrow transfer.

    ``fields`` gives name, Spark type and Arrow type of each output column.  The
    function gets the named columns as positional arguments and returns a tuple.
    """
    schema = pa.schema([(n, t) for n, _, t in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            for at in range(0, b.num_rows, OUT_ROWS):
                part = b.slice(at, OUT_ROWS)
                yield from batched((f(*row) for row in zip(*(part.column(i).to_pylist() for i in range(part.num_columns)), strict=True)), schema)

    return df.select(*columns).mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t, _ in fields))
