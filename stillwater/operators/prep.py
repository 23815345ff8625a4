"""Preparation of raw observations: P1-P6.

Series that one task may order each (counted first) are numbered behind one shuffle. With a
longer one, every ordered step runs inside (series, day) partitions and what must cross a day
boundary (ordinals, neighbours) travels through a table with one row per
series and day, whose size is bounded by the calendar and not by the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..config import DAY, FILL_VALUE
from ..functions import groups
from ..functions.ranks import running_total
from ..functions.columns import (
    fill_to_null, ice_condition, seconds_to_timestamp, version_suffix,
)

SERIES = "lake_id"


def day_of(time):
    return F.floor(time / F.lit(DAY)).cast("long")


def prepare(raw: DataFrame, tie_break: list[str]) -> DataFrame:
    """Usable rows with ordinal, timestamp and duplicate flag.

    ``index_col`` numbers the rows of a series by time and then by the declared
    arrival columns. ``is_first`` marks the first row of each timestamp (P6).
    """
    valid_time = F.col("time").isNotNull() & ~F.isnan("time") & (F.col("time") != FILL_VALUE)
    rows = raw.filter(valid_time).withColumn("day", day_of(F.col("time")))
    if groups.largest_group(raw, [SERIES]) <= groups.GATHERED_ROWS:
        whole = W.partitionBy(SERIES).orderBy("time", *tie_break)
        numbered = rows.filter(F.col(SERIES).isNotNull()).withColumn("__rn", F.row_number().over(whole))
        return _finished(_usable(numbered, whole).withColumn("__before", F.lit(0)), tie_break)
    per_day = W.partitionBy(SERIES, "day").orderBy("time", *tie_break)
    days = (
        rows.groupBy(SERIES, "day").agg(F.count("*").alias("__n"))
        .withColumn(
            "__before",
            F.coalesce(
                F.sum("__n").over(
                    W.partitionBy(SERIES).orderBy("day").rowsBetween(W.unboundedPreceding, -1)
                ),
                F.lit(0),
            ),
        )
        .drop("__n")
    )
    numbered = rows.withColumn("__rn", F.row_number().over(per_day))
    return _finished(_usable(numbered, per_day).join(days, [SERIES, "day"]), tie_break)


def _usable(numbered: DataFrame, order) -> DataFrame:
    usable = numbered.withColumn("wse", fill_to_null(F.col("wse"))).filter(F.col("wse").isNotNull())
    return usable.withColumn(
        "is_first",
        F.coalesce(F.lag("time").over(order) != F.col("time"), F.lit(True)),
    )


def _finished(out: DataFrame, tie_break: list[str]) -> DataFrame:
    return (
        out.withColumn("index_col", F.col("__before") + F.col("__rn") - 1)
        .withColumn("datetime", seconds_to_timestamp(F.col("time")))
        .withColumn("wse_u", fill_to_null(F.col("wse_u")))
        .withColumn("wse_std", fill_to_null(F.col("wse_std")))
        .withColumn("xtrk_dist", fill_to_null(F.col("xtrk_dist")))
        .withColumn("crid_scenario", version_suffix(F.col("crid")))
        .withColumn("ice_condition", ice_condition(F.col("ice_clim_f")))
        .drop("__before", "__rn", *[c for c in tie_break if c not in ("time",)])
    )


def distinct_times(obs: DataFrame) -> DataFrame:
    """One row per timestamp, the first in arrival order."""
    return obs.filter("is_first")


def first_seen_order(df: DataFrame, id_col: str, position_col: str) -> DataFrame:
    """Distinct ids with their first position and its rank from 1, ranked by ranges of positions."""
    first = df.groupBy(id_col).agg(F.min(position_col).alias("first_position"))
    placed = running_total(first, [], ["first_position", id_col], out="first_rank")
    return placed.withColumn("first_rank", F.col("first_rank") + 1)


def exclude(df: DataFrame, ids: DataFrame, key: str = SERIES) -> DataFrame:
    """P20: drop the listed ids (the planner broadcasts the list if it is small)."""
    return df.join(ids.select(key).distinct(), key, "left_anti")
