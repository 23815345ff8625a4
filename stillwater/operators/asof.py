"""As-of joins and ordered neighbours without one task per series.

``nearest`` takes series that one task may order each (counted first) in one pass over both
sides. Otherwise rows of a series are cut into fixed time slots. Inside a slot an ordered window
finds the neighbours; across slots they come from a table holding the first and
last candidate of each slot, bounded by the calendar.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..config import DAY
from ..functions import groups


def prev_next(
    left: DataFrame,
    right: DataFrame,
    key: str,
    left_time: str,
    right_time: str,
    value_cols: list[str],
    slot_seconds: float = DAY,
) -> DataFrame:
    """Adds ``prev`` (latest right row at or before) and ``next`` (earliest at
    or after) as structs (t, values...). Right times must be unique per key."""
    slot = lambda t: F.floor(F.col(t) / F.lit(float(slot_seconds))).cast("long")
    r = right.filter(F.col(right_time).isNotNull()).select(
        key,
        slot(right_time).alias("__slot"),
        F.struct(F.col(right_time).alias("t"), *value_cols).alias("__r"),
    )
    has_time = left.filter(F.col(left_time).isNotNull())
    l = has_time.select(
        key, slot(left_time).alias("__slot"), F.col(left_time).alias("__t"), F.struct(*left.columns).alias("__l")
    )
    both = l.unionByName(r.withColumn("__t", F.col("__r.t")), allowMissingColumns=True)
    # right rows of equal time must sit inside both frames: range frames do that
    # (both directions use a growing frame, which Spark evaluates in one pass)
    grow = lambda order: W.partitionBy(key, "__slot").orderBy(order).rangeBetween(W.unboundedPreceding, W.currentRow)
    inside = both.select(
        key,
        "__slot",
        "__l",
        F.last("__r", ignorenulls=True).over(grow(F.col("__t").asc())).alias("__p"),
        F.last("__r", ignorenulls=True).over(grow(F.col("__t").desc())).alias("__n"),
    ).filter(F.col("__l").isNotNull())
    ends = r.groupBy(key, "__slot").agg(F.min("__r").alias("__first"), F.max("__r").alias("__last"))
    spine = l.select(key, "__slot").distinct().unionByName(r.select(key, "__slot").distinct()).distinct()
    earlier = W.partitionBy(key).orderBy("__slot").rowsBetween(W.unboundedPreceding, -1)
    later = W.partitionBy(key).orderBy(F.col("__slot").desc()).rowsBetween(W.unboundedPreceding, -1)
    carry = spine.join(ends, [key, "__slot"], "left").select(
        key,
        "__slot",
        F.last("__last", ignorenulls=True).over(earlier).alias("__cp"),
        F.last("__first", ignorenulls=True).over(later).alias("__cn"),
    )
    out = inside.join(carry, [key, "__slot"]).select(
        "__l.*", F.coalesce("__p", "__cp").alias("prev"), F.coalesce("__n", "__cn").alias("next")
    )
    untimed = left.filter(F.col(left_time).isNull())
    return out.unionByName(untimed, allowMissingColumns=True)


def nearest(
    left: DataFrame,
    right: DataFrame,
    key: str,
    left_time: str,
    right_time: str,
    value_cols: list[str],
    tolerance,
    slot_seconds: float = DAY,
) -> DataFrame:
    """Nearest right row within ``tolerance`` seconds (number or Column);
    at equal distance the earlier one wins."""
    sides = [df.select(key).filter(F.col(key).isNotNull()) for df in (left, right)]
    if groups.largest_group(sides[0].unionByName(sides[1]), [key]) <= groups.GATHERED_ROWS:
        j = _around(left, right, key, left_time, right_time, value_cols)
    else:
        j = prev_next(left, right, key, left_time, right_time, value_cols, slot_seconds)
    t = F.col(left_time)
    back, ahead = t - F.col("prev.t"), F.col("next.t") - t
    pick = F.when(F.col("next").isNull() | (back <= ahead), F.col("prev")).otherwise(F.col("next"))
    tol = tolerance if not isinstance(tolerance, (int, float)) else F.lit(float(tolerance))
    j = j.withColumn("__pick", pick).withColumn("__ok", F.abs(F.col("__pick.t") - t) <= tol)
    out = j.select(
        *left.columns,
        F.when(F.col("__ok"), F.col("__pick.t")).alias(right_time),
        *[F.when(F.col("__ok"), F.col(f"__pick.{c}")).alias(c) for c in value_cols],
    )
    return out


def _around(left, right, key, left_time, right_time, value_cols) -> DataFrame:
    """What ``prev_next`` adds, for series that one task may order each. A right row carries the one behind it, so the
    last right row up to a time brings both; in front of the first one stands a row without values that carries it.
    Where a right row has the time itself, ``next`` is the one behind it."""
    t = F.col(right_time).cast("double")
    r = right.filter(F.col(right_time).isNotNull() & F.col(key).isNotNull()).select(
        key, t.alias("__t"), F.struct(F.col(right_time).alias("t"), *value_cols).alias("__p"))
    order = W.partitionBy(key).orderBy("__t")
    r = r.withColumns({"__n": F.lead("__p").over(order), "__first": F.row_number().over(order) == 1})
    at = lambda t, p, n: F.struct(t.alias("t"), p.alias("p"), n.alias("n"))
    own, nobody = at(F.col("__t"), F.col("__p"), F.col("__n")), F.when(F.lit(False), F.col("__p"))
    before = at(F.lit(float("-inf")), nobody, F.col("__p"))
    r = r.select(key, F.explode(F.when(F.col("__first"), F.array(before, own)).otherwise(F.array(own))).alias("__r"))
    r = r.select(key, F.col("__r.t").alias("__t"), F.lit(0).alias("__left"), F.struct("__r.p", "__r.n").alias("__r"))
    l = left.filter(F.col(left_time).isNotNull() & F.col(key).isNotNull())
    both = l.withColumns({"__t": F.col(left_time).cast("double"), "__left": F.lit(1)}).unionByName(r, allowMissingColumns=True)
    upto = W.partitionBy(key).orderBy("__t", "__left").rowsBetween(W.unboundedPreceding, 0)
    found = both.withColumn("__r", F.last("__r", ignorenulls=True).over(upto)).filter("__left = 1")
    out = found.select(*left.columns, F.col("__r.p").alias("prev"), F.col("__r.n").alias("next"))
    return out.unionByName(left.filter(F.col(left_time).isNull()), allowMissingColumns=True)


def series_gaps(df: DataFrame, key: str, time: str, slot_seconds: float = DAY) -> DataFrame:
    """Seconds since the previous row of the series, per row."""
    slot = F.floor(F.col(time) / F.lit(float(slot_seconds))).cast("long")
    rows = df.withColumn("__slot", slot)
    ends = rows.groupBy(key, "__slot").agg(F.max(time).alias("__last"))
    carry = ends.select(
        key, "__slot", F.lag("__last").over(W.partitionBy(key).orderBy("__slot")).alias("__before")
    )
    inner = F.lag(time).over(W.partitionBy(key, "__slot").orderBy(time))
    return (
        rows.withColumn("__prev", inner)
        .join(carry, [key, "__slot"])
        .withColumn("gap_seconds", F.col(time) - F.coalesce("__prev", "__before"))
        .drop("__slot", "__prev", "__before")
    )


def coverage(df: DataFrame, key: list[str], time: str, rows=None) -> DataFrame:
    """N2/O5 inputs per series: rows, first and last time, longest gap.

    Gaps inside a day come from an ordered window per (series, day), gaps
    between days from the day table.
    """
    d = df if rows is None else df.filter(rows)
    d = d.withColumn("__slot", F.floor(F.col(time) / F.lit(DAY)).cast("long"))
    inner = F.col(time) - F.lag(time).over(W.partitionBy(*key, "__slot").orderBy(time))
    days = d.withColumn("__in", inner).groupBy(*key, "__slot").agg(
        F.count("*").alias("__n"), F.min(time).alias("__a"), F.max(time).alias("__b"), F.max("__in").alias("__in")
    )
    across = F.col("__a") - F.lag("__b").over(W.partitionBy(*key).orderBy("__slot"))
    return days.withColumn("__gap", F.greatest(across, F.col("__in"))).groupBy(*key).agg(
        F.sum("__n").alias("n_rows"),
        F.min("__a").alias("t_first"),
        F.max("__b").alias("t_last"),
        F.max("__gap").alias("max_gap"),
    )
