"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stillwater.llm.common import table, written
from stillwater.llm.stages import decontaminate, dedupe, mix, select, shard

STAGES = [("quality", select), ("simhash", dedupe), ("decontamination", decontaminate), ("mixing", mix), ("sharding", shard)]
# The classifier and the fingerprints have no SQL form; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage: every document kept, with its shard and slot."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
