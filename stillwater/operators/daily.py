"""Daily series on a shared calendar: D1-D6.

The day tables hold one row per series and day, so windows over a whole series
are bounded by its calendar length however many observations it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

KEY = "lake_id"


def daily_means(df: DataFrame, ts: str, values: dict[str, str]) -> DataFrame:
    """Mean per day; {output name: input column}."""
    return df.groupBy(KEY, F.to_date(ts).alias("date")).agg(*[F.avg(c).alias(n) for n, c in values.items()])


def spine(bounds: DataFrame, first: str = "first_date", last: str = "last_date") -> DataFrame:
    """Every day between two date columns."""
    days = F.sequence(F.col(first), F.col(last), F.expr("interval 1 day"))
    return bounds.withColumn("date", F.explode(days))


def _with_neighbours(days: DataFrame, cols: list[str]) -> DataFrame:
    """``__a_<c>`` and ``__b_<c>``: the last value up to a day and the first from it
    on, as (d, v). All columns share one ascending and one descending order."""
    item = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col("date").alias("d"), F.col(c).alias("v")))
    grow = lambda order: W.partitionBy(KEY).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    for mark, order in (("a", F.col("date").asc()), ("b", F.col("date").desc())):
        days = days.withColumns({f"__{mark}_{c}": F.last(item(c), ignorenulls=True).over(grow(order)) for c in cols})
    return days


def _linear(day: Column, a: Column, b: Column) -> Column:
    """D3: linear between neighbours, flat beyond the ends."""
    span = F.datediff(b["d"], a["d"]).cast("double")
    frac = F.datediff(day, a["d"]).cast("double") / span
    return (
        F.when(a.isNull(), b["v"])
        .when(b.isNull() | (a["d"] == b["d"]), a["v"])
        .otherwise(a["v"] + (b["v"] - a["v"]) * frac)
    )


def _filled(c: str) -> Column:
    return _linear(F.col("date"), F.col(f"__a_{c}"), F.col(f"__b_{c}"))


def interpolate_daily(days: DataFrame, cols: list[str]) -> DataFrame:
    """D3 on a complete calendar."""
    near = _with_neighbours(days, cols)
    return near.select(*[_filled(c).alias(c) if c in cols else c for c in days.columns])


def _both(fn, a: str, b: str) -> Column:
    """``fn`` of two columns, NULL where one is."""
    return F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), fn(a, b))


def _filled_days(knots: DataFrame, cols: list[str]) -> DataFrame:
    """Every day from ``w1`` to ``w2`` with the last value up to it (``__a_<c>``, of day ``__ad_<c>``) and the first one
    behind it (``__b_<c>``, ``__bd_<c>``), from the days that hold a value of any column. A day between two of them has
    the former's last values and the latter's next ones, so the calendar is written out behind the windows and never
    ordered. Days are numbers and no column is a struct: every day of the calendar carries them all."""
    upto = W.partitionBy(KEY).orderBy("__day").rowsBetween(W.unboundedPreceding, 0)
    after = W.partitionBy(KEY).orderBy(F.col("__day").desc()).rowsBetween(W.unboundedPreceding, -1)
    latest = lambda c, w: F.last(c, ignorenulls=True).over(w)
    has = lambda c: F.when(F.col(c).isNotNull(), F.col("__day"))
    k = knots.withColumns({"__day": F.unix_date("date"), "__w1": F.unix_date("w1"), "__w2": F.unix_date("w2")})
    k = k.select(KEY, "__day", "__w1", "__w2", *cols, *[latest(has(c), upto).alias(f"__ad_{c}") for c in cols],
                 *[latest(F.col(c), upto).alias(f"__a_{c}") for c in cols])
    k = k.withColumns({**{f"__bd_{c}": latest(has(c), after) for c in cols},
                       **{f"__b_{c}": latest(F.col(c), after) for c in cols}, "__to": latest(F.col("__day"), after)}).drop(*cols)
    first, last = F.greatest("__day", "__w1"), F.least(F.coalesce(F.col("__to") - 1, F.col("__day")), F.col("__w2"))
    return k.filter(first <= last).withColumn("__day", F.explode(F.sequence(first, last))).drop("__to")


def _between(c: str, ad: Column, a: Column, bd: Column) -> Column:
    """D3 for a day of ``_filled_days``; ``ad`` and ``bd`` are NULL where a neighbour is not to count."""
    day, b = F.col("__day"), F.col(f"__b_{c}")
    frac = (day - ad).cast("double") / (bd - ad).cast("double")
    return (
        F.when(ad.isNull(), F.when(bd.isNotNull(), b))
        .when(bd.isNull() | (ad == day), a)
        .otherwise(a + (b - a) * frac)
    )


def daily_series(
    obs: DataFrame,
    gauge: DataFrame,
    columns: dict[str, str],
    ts: str = "datetime",
    gauge_ts: str = "gauge_datetime",
    gauge_value: str = "gauge_wse",
    major_gap_days: int = 90,
    window_column: str = "wse",
) -> DataFrame:
    """Paired daily series over the observation-gauge overlap.

    ``columns`` maps output names to observation columns. The overlap comes
    from ``window_column`` and the gauge. Days strictly inside a gauge gap of
    at least ``major_gap_days`` are left out (D5), and the gauge is not
    interpolated from readings outside the overlap.
    """
    names = list(columns)
    every = [*names, "daily_gauge"]
    means = {**columns, "__window": window_column}
    # one row per day with any value, the only rows that are ordered
    empty = lambda cs: [F.lit(None).cast("double").alias(c) for c in cs]
    rows = obs.select(KEY, F.to_date(ts).alias("date"), *[F.col(c).cast("double").alias(n) for n, c in means.items()], *empty(["daily_gauge"]))
    read = gauge.filter(F.col(gauge_value).isNotNull()).select(
        KEY, F.to_date(gauge_ts).alias("date"), *empty(means), F.col(gauge_value).cast("double").alias("daily_gauge"))
    knots = rows.unionByName(read).groupBy(KEY, "date").agg(*[F.avg(c).alias(c) for c in [*means, "daily_gauge"]])
    series = W.partitionBy(KEY).orderBy("date").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    for mark, c in (("o", "__window"), ("g", "daily_gauge")):
        day = F.when(F.col(c).isNotNull(), F.col("date"))
        knots = knots.withColumns({f"{mark}1": F.min(day).over(series), f"{mark}2": F.max(day).over(series)})
    # observations only count on the calendar that both span together
    knots = knots.withColumns({"w1": _both(F.greatest, "o1", "g1"), "w2": _both(F.least, "o2", "g2")}).filter(
        F.col(KEY).isNotNull() & (F.col("w1") <= F.col("w2"))
        & (F.col("date") >= F.least("o1", "g1")) & (F.col("date") <= F.greatest("o2", "g2"))
    ).drop("__window", "o1", "o2", "g1", "g2")
    days = _filled_days(knots, every)
    before, behind = F.col("__ad_daily_gauge"), F.col("__bd_daily_gauge")
    inside_gap = (F.col("__day") != before) & (behind - before >= major_gap_days)
    kept = days.filter(~F.coalesce(inside_gap, F.lit(False)))
    ends = {c: (F.col(f"__ad_{c}"), F.col(f"__bd_{c}")) for c in names}
    ends["daily_gauge"] = F.when(before >= F.col("__w1"), before), F.when(behind <= F.col("__w2"), behind)
    return kept.select(KEY, F.date_from_unix_date("__day").alias("date"),
                       *[_between(c, ad, F.col(f"__a_{c}"), bd).alias(c) for c, (ad, bd) in ends.items()])
