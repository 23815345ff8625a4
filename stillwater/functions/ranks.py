"""Positions in an order that no single task has to hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import cut


def running_total(df: DataFrame, keys: list[str], order: list[str], weight: str | None = None, out: str = "before") -> DataFrame:
    """Adds ``out``: the weight (rows, without one) of all rows of the same ``keys`` that come before a row in ``order``.

    Rows are dealt by ranges of (keys, order) and written once, so that ranges keep their
    numbers if a task is run again. Totals per range are added over ranges, of which a key
    has at most as many as there are partitions; a row adds only what precedes it in its range.
    Ties in ``order`` share a range and are counted one after the other in no stated order,
    so give an order without ties where that matters. A NULL key is a key.
    """
    w = F.col(weight) if weight else F.lit(1).cast("long")
    dealt = cut(df.repartitionByRange(*keys, *order).withColumn("__range", F.spark_partition_id()))
    upto = lambda cols, by: W.partitionBy(*cols).orderBy(*by).rowsBetween(W.unboundedPreceding, -1)
    totals = dealt.groupBy(*keys, "__range").agg(F.sum(w).alias("__w"))
    start = totals.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__range").alias("__r"),
                          F.coalesce(F.sum("__w").over(upto(keys, ["__range"])), F.lit(0)).alias("__start"))
    inside = dealt.withColumn(out, F.coalesce(F.sum(w).over(upto([*keys, "__range"], order)), F.lit(0)))
    same = F.col("__range") == F.col("__r")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return inside.join(start, same).withColumn(out, F.col(out) + F.col("__start")).drop("__range", "__r", "__start", *[f"__k_{k}" for k in keys])
