"""Tumbling, sliding and session windows with watermarks.

The functions take any DataFrame with a timestamp.  On a stream, give a watermark first: it
bounds the state and decides what is late.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lakescan.functions.aggregates import aggregate_of, alias_of


def _zoned(df: DataFrame, ts: str) -> DataFrame:
    """Watermarks need an instant; times without a zone are taken in the session's zone."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")) if isinstance(df.schema[ts].dataType, T.TimestampNTZType) else df


def _aggregated(df: DataFrame, window, keys: list[str], aggregates: list[tuple]) -> DataFrame:
    made = [aggregate_of(op, c, df.schema[c].dataType).alias(a[0] if a else alias_of(op, c)) for op, c, *a in aggregates]
    out = df.groupBy(window.alias("w"), *keys).agg(*made)
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, *out.columns[1 + len(keys) :])


def watermarked(df: DataFrame, ts: str, delay: str) -> DataFrame:
    return _zoned(df, ts).withWatermark(ts, delay)


def ranged(df: DataFrame, ts: str, size: str, aggregates: list[tuple], keys: list[str] | None = None, slide: str | None = None) -> DataFrame:
    """Tumbling windows, or sliding ones if `slide` is given."""
    df = _zoned(df, ts)
    return _aggregated(df, F.window(ts, size, slide or size), keys or [], aggregates)


def session(df: DataFrame, ts: str, gap: str, aggregates: list[tuple], keys: list[str]) -> DataFrame:
    """Windows that end after a gap without events of the key."""
    df = _zoned(df, ts)
    return _aggregated(df, F.session_window(ts, gap), keys, aggregates)


def stream_of(spark: SparkSession, path: str, schema: T.StructType, form: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    """A stream over a folder that files are added to."""
    source = spark.readStream.format(form).schema(schema)
    return (source.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else source).load(path)


def stream_from(spark: SparkSession, form: str, **options) -> DataFrame:
    """A stream of any source that Spark has, such as rate or, with its package, kafka."""
    return spark.readStream.format(form).options(**options).load()


def run_available(df: DataFrame, sink: str, checkpoint: str, form: str = "parquet", mode: str = "append") -> StreamingQuery:
    """Processes what is there and ends.  With the checkpoint, file sinks are exactly-once over restarts."""
    q = df.writeStream.format(form).outputMode(mode).option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
