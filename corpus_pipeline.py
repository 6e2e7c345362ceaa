"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing, tokens."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lakescan.llm import stages

STAGES = [
    ("quality rules", stages.quality_rules),
    ("line dedup", stages.drop_lines),
    ("simhash near-dedup", stages.near_duplicates),
    ("mixing", stages.mix_sources),
    ("bpe", stages.tokenise),
]

#: The stages parse, link, classify and tokenise in ways that SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's result is written to the shared folder and read again; it goes when the next is written, the last when the driver ends."""
    from lakescan.llm.common import delete, delete_at_end, shared_folder

    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
        if k:
            delete(spark, f"{base}/{k - 1}")
        else:
            delete_at_end(spark, base)
    return docs
