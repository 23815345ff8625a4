"""Pipeline stages: (spark, docs, sf_dir) -> documents that go on, with the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stillwater.llm import decontamination, mixing, near_copies, quality, sharding
from stillwater.llm.common import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Bytes of a batch of texts on its way to Python. A task holds one in the JVM's buffers, in its worker and in the lists
#: and sets made of it, all of it outside the heap; at Spark's 64 MB that outweighs the texts' own share of an executor.
BATCH_BYTES = "4m"


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def select(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    small_batches(spark)
    rows = docs.select(*COLUMNS)
    model = quality.fit(rows, table(spark, sf_dir, "labels"))
    return quality.score(rows, model, *COLUMNS[1:]).where(quality.kept()).select(*COLUMNS)


def dedupe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    small_batches(spark)
    return near_copies.representatives(docs.select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontamination.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: 0 to 3 rows."""
    return mixing.mixed(docs.select(*COLUMNS))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, text_crc32, shard and slot of every row; a document taken twice has two rows."""
    return sharding.assign(docs.select(*COLUMNS), shards=8)
