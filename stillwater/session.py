"""Session settings the package relies on, and reliable lineage cuts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


#: Settings of the series queries alone. HotSpot interprets methods over 8000 bytes for good; rows as wide as the
#: observations reach that in one generated method, which Spark then gives up for expressions compiled in small pieces.
#: A merged shuffle partition unpacks to some thirty times its size in the sorts behind it, so it is kept small.
#: Shuffle files are deleted with the execution that wrote them, not when the driver happens to collect its garbage.
SERIES_SETTINGS = {
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def configure(spark: SparkSession, series: bool = False) -> SparkSession:
    """Runtime SQL settings (no static settings, safe on a shared session)."""
    for name, value in SERIES_SETTINGS.items():
        if series:
            spark.conf.set(name, value)
        elif spark.conf.get(name, None) == value:  # left by a series query of this session
            spark.conf.unset(name)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    # Written intermediates pack many rows into few bytes; judged by the bytes of their files, tables of millions
    # of rows would be broadcast through the driver.
    spark.conf.set("spark.sql.sources.fileCompressionFactor", "12.0")
    return spark


#: Bytes of input files (observations, packed) for which a shuffle has one partition more.
PARTITION_BYTES = 1 << 20


def partition_for(spark: SparkSession, *paths: str) -> None:
    """Number shuffle partitions by the size of the inputs, so that tasks do not grow with them; adaptive execution
    merges what turns out small."""
    size = 0
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        size += path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // PARTITION_BYTES)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(n))


def shuffle_partitions(spark: SparkSession) -> int:
    """Partitions of a shuffle before any are merged."""
    n = spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None)
    return int(n or spark.conf.get("spark.sql.shuffle.partitions"))


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    else:
        raise RuntimeError(
            "spark.checkpoint.dir is not set: iterative filters need a shared "
            "checkpoint folder that survives the loss of an executor"
        )


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder beside the lineage cuts, shared by all executors."""
    _ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a table written to the cluster's checkpoint folder.

    A written table rather than ``checkpoint()``: that keeps the size estimate of
    its plan, and join estimates multiply, so in an iteration they grow without
    bound; a table read back has the size of its files.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that ``cut`` wrote and nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
