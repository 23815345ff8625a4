"""Observation sources: S1-S4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..config import COLLECTION_TAGS
from ..schema import OBSERVATIONS, REQUIRED, require_columns


def _files_by_header(spark: SparkSession, path: str, required=REQUIRED) -> dict[str, list[str]]:
    """CSV files by their header line; a file whose header lacks a column is an error."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    is_header = F.lit(True)
    for c in required:
        is_header = is_header & F.contains("value", F.lit(c))
    found = lines.groupBy("file").agg(F.max(F.when(is_header, F.col("value"))).alias("header"))
    out: dict[str, list[str]] = {}
    for row in found.orderBy("file").collect():  # a row per file
        if row["header"] is None:
            require_columns(spark.read.option("header", True).csv(row["file"]), required)
        out.setdefault(row["header"], []).append(row["file"])
    return out


def read_observations(spark: SparkSession, path: str, fmt: str = "parquet", schema=OBSERVATIONS) -> DataFrame:
    """Cached observations. CSV columns are matched by the header of their own
    file, so only known columns are read and a missing one is an error."""
    if fmt == "parquet":
        return require_columns(spark.read.parquet(path))
    parts = []
    for header, files in _files_by_header(spark, path).items():
        names = [c.strip().strip('"') for c in header.split(",")]
        text = T.StructType([T.StructField(c, T.StringType()) for c in names])
        df = require_columns(spark.read.option("header", True).schema(text).csv(files))
        cols = []
        for f in schema.fields:
            raw = F.col(f.name) if f.name in names else F.lit(None).cast("string")
            if isinstance(f.dataType, (T.LongType, T.IntegerType)):
                # integers may be written with a decimal point
                raw = F.coalesce(raw.try_cast("long"), raw.try_cast("double").cast("long"))
            elif f.dataType != T.StringType():
                raw = raw.try_cast("double")
            cols.append(raw.cast(f.dataType).alias(f.name))
        parts.append(df.select(*cols))
    if not parts:
        return spark.createDataFrame([], schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def parse_responses(
    bodies: DataFrame, body: str = "body", schema=OBSERVATIONS, required=REQUIRED, block: int = 2000,
) -> DataFrame:
    """Observations out of landed JSON envelopes whose ``results.csv`` holds
    CSV text, one response per row.

    Bodies that are missing, not JSON, blank or lack a required column give no
    rows. Columns are matched by header name, whatever their order. A body is only
    cut into blocks of ``block`` lines where it lies; the blocks go to all tasks,
    each with its header, so one long body does not stay in one task.
    """
    text = F.get_json_object(F.col(body), "$.results.csv")
    lines = F.filter(F.split(text, r"\r?\n"), lambda s: F.length(F.trim(s)) > 0)
    t = bodies.select(lines.alias("lines")).filter(F.size("lines") > 1)
    t = t.withColumn("header", F.transform(F.split(F.col("lines")[0], ","), lambda s: F.trim(F.regexp_replace(s, '"', ""))))
    t = t.filter(F.size(F.array_except(F.array(*[F.lit(c) for c in required]), F.col("header"))) == 0)
    starts = F.sequence(F.lit(2), F.size("lines"), F.lit(block))
    parts = t.select("header", F.explode(F.transform(starts, lambda i: F.slice("lines", i, F.lit(block)))).alias("part"))
    rows = parts.hint("rebalance").select("header", F.explode("part").alias("line"))
    # quoted cells may hold commas: cut on commas outside quotes
    cells = F.split("line", r',(?=(?:[^"]*"[^"]*")*[^"]*$)')
    rows = rows.withColumn("cells", F.transform(cells, lambda s: F.regexp_replace(F.trim(s), '^"|"$', "")))
    pos = lambda c: F.array_position("header", F.lit(c)).cast("int") - 1
    out = []
    for f in schema.fields:
        raw = F.get("cells", pos(f.name))
        if f.dataType == T.StringType():
            out.append(F.nullif(raw, F.lit("")).alias(f.name))
        elif f.dataType == T.DoubleType():
            out.append(raw.try_cast("double").alias(f.name))
        else:
            whole = F.coalesce(raw.try_cast("long"), raw.try_cast("double").cast("long"))
            out.append(whole.cast(f.dataType).alias(f.name))
    return rows.select(*out)


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """S2 from files: one response body per file."""
    return parse_responses(spark.read.option("wholetext", True).text(path).withColumnRenamed("value", "body"))


def only_collection(df: DataFrame, name: str) -> DataFrame:
    """One collection, with its version tag."""
    if name not in COLLECTION_TAGS:
        raise ValueError(f"unsupported collection {name!r}; expected one of {sorted(COLLECTION_TAGS)}")
    return df.filter(F.col("collection_shortname") == name).withColumn("version_tag", F.lit(COLLECTION_TAGS[name]))
