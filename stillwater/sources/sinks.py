"""Sinks: S9-S12. Writers keep the declared schema even for empty results."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..schema import THRESHOLD_SUMMARY


def write_observations(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Partitioned by attempt."""
    w = df.write.mode("overwrite").partitionBy("filter_attempt")
    (w.option("header", True).csv(path) if fmt == "csv" else w.parquet(path))


def write_threshold_summary(df: DataFrame, path: str) -> None:
    """S10 with N6: first-seen pair order, then ice condition."""
    ordered = df.orderBy("lake_id", "pair_order", "ice_condition")
    cols = [F.col(f.name).cast(f.dataType).alias(f.name) for f in THRESHOLD_SUMMARY.fields]
    ordered.select(*cols).write.mode("overwrite").parquet(path)


def write_lake_stats(df: DataFrame, path: str) -> None:
    """With the 0/1 selection mask."""
    df.withColumn("keep_mask", F.col("keep_mask").cast("byte")).write.mode("overwrite").parquet(path)


def write_cache(df: DataFrame, path: str) -> None:
    """Fetched observations for later runs, clustered by series."""
    df.repartitionByRange("lake_id", "time").sortWithinPartitions("lake_id", "time").write.mode("overwrite").parquet(path)
