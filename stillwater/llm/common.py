"""Reading, lineage cuts and connected components shared by the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stillwater.session import configure, cut

# ASCII white space, as the contracts state it.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the cluster's checkpoint folder.

    The plan behind it is no longer needed, so its shuffle files may go: they are
    only removed when the driver collects its garbage, which is asked for here.
    """
    out = cut(df)
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``written`` made and nothing reads any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def source_key(source: str):
    """A source as a key without nulls that keeps code point order, null last."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("t"))


def buckets(rows: int, per_bucket: int, most: int = 65536) -> int:
    """A power of two of buckets with about ``per_bucket`` rows each."""
    n = 1
    while n < most and rows > n * per_bucket:
        n *= 2
    return n


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of an undirected graph; component is the smallest node reachable.

    Alternating large-star and small-star steps: every round is two map-side
    combined minima and joins on the node, a hub's rows are split by the skew
    join, and no component is ever gathered. Only nodes with an edge to another
    node are returned. Nulls at either end and loops are left out.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    e, before = written(e), None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(least.select("u", F.col("m").alias("v"))).where("u > v").distinct()
        now, old = written(small), e
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("v").cast("decimal(38,0)"))).first()
        discard(old)
        e = now
        if state == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = state
