"""Session and configuration."""

from __future__ import annotations

import os
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class EngineConfig:
    """Settings, as Spark has them.  0 leaves a size to Spark."""

    num_workers: int = 0
    batch_rows: int = 10_000
    memory_budget: int = 0
    page_bytes: int = 0
    spill_dir: str | None = None
    codegen: bool = True
    optimizer: bool = True
    trace: bool = False
    shuffle_partitions: int = 0

    def spark_conf(self) -> dict[str, str]:
        out = {
            "spark.master": f"local[{self.num_workers or '*'}]",
            "spark.sql.execution.arrow.maxRecordsPerBatch": str(self.batch_rows),
            "spark.sql.codegen.wholeStage": str(self.codegen).lower(),
            "spark.sql.session.timeZone": "UTC",
            "spark.sql.adaptive.enabled": "true",
            "spark.ui.enabled": str(self.trace).lower(),
            "spark.eventLog.enabled": str(self.trace).lower(),
        }
        if self.memory_budget:
            out["spark.driver.memory"] = f"{self.memory_budget}b"
        if self.page_bytes:
            out["spark.buffer.pageSize"] = f"{self.page_bytes}b"
        if self.spill_dir:
            out["spark.local.dir"] = self.spill_dir
        if self.trace:
            out["spark.eventLog.dir"] = self.spill_dir or tempfile.gettempdir()
        if self.shuffle_partitions:
            out["spark.sql.shuffle.partitions"] = str(self.shuffle_partitions)
        if not self.optimizer:
            # Rules that only make a plan faster.
            base = "org.apache.spark.sql.catalyst.optimizer."
            out["spark.sql.optimizer.excludedRules"] = ",".join(base + r for r in ("PushDownPredicates", "ConstantFolding", "BooleanSimplification", "LimitPushDown"))
        return out


def get_spark(config: EngineConfig | None = None) -> SparkSession:
    """The running session, or one with the configuration; a master given from outside (spark-submit) stays."""
    if active := SparkSession.getActiveSession():
        return active
    conf = (config or EngineConfig()).spark_conf()
    if "MASTER" in os.environ or "SPARK_REMOTE" in os.environ:
        conf.pop("spark.master")
    return SparkSession.builder.config(map=conf).getOrCreate()


def scratch(spark: SparkSession) -> str:
    """A new path that all executors see: in the checkpoint folder if the cluster names one.  It goes when the driver's JVM ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.gettempdir()
    folder = f"{base.rstrip('/')}/lakescan-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return f"{folder}/rows"
