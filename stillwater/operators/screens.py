"""Outlier screens: O1-O8 and the Tukey fallback W5."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..config import Attempt, DAY
from ..functions.columns import lit_false, tukey_baseline
from ..functions.quantiles import between_ranks, gathered, grouped_quantiles, null_safe_join
from ..functions.groups import largest_group
from ..session import cut
from . import asof


def _check(lower_q: float, upper_q: float) -> None:
    if not 0 <= lower_q < upper_q <= 1:
        raise ValueError("need 0 <= lower_q < upper_q <= 1")


def tukey_bounds(df, keys, value="wse", multiplier=3.0, lower_q=0.25, upper_q=0.75, aggs=(), largest=None):
    """O1 bounds per group."""
    _check(lower_q, upper_q)
    q = grouped_quantiles(df, keys, value, [lower_q, upper_q], ["__ql", "__qh"], aggs, largest)
    iqr = F.col("__qh") - F.col("__ql")
    m = F.lit(float(multiplier))
    return (
        q.withColumn("lower_bound", F.col("__ql") - m * iqr)
        .withColumn("upper_bound", F.col("__qh") + m * iqr)
        .drop("__ql", "__qh")
    )


def remove_tukey(df, keys=("lake_id",), value="wse", multiplier=3.0, lower_q=0.25, upper_q=0.75):
    """O1: rows inside the bounds; rows with a missing value go."""
    keys = list(keys)
    b = tukey_bounds(df, keys, value, multiplier, lower_q, upper_q)
    return null_safe_join(df, b, keys, "inner").filter(
        (F.col(value) >= F.col("lower_bound")) & (F.col(value) <= F.col("upper_bound"))
    )


def near_median(df, keys=("lake_id",), value="wse", max_distance=150.0):
    """O2: rows within ``max_distance`` of the group median (inclusive)."""
    keys = list(keys)
    m = grouped_quantiles(df, keys, value, [0.5], ["series_median"])
    return null_safe_join(df, m, keys, "inner").filter(
        F.abs(F.col(value) - F.col("series_median")) <= F.lit(float(max_distance))
    )


def screen_interval(
    df, key="lake_id", value="wse", multiplier=3.0, lower_q=0.1, upper_q=0.9, max_distance=150.0, iterations=1,
):
    """Repeated O1+O2 as one surviving interval per series:
    (key, lo, hi, n_steps, n_kept).

    Series that one task may gather (counted first) run all rounds on their sorted values. Both
    screens are intervals on the value, so otherwise one row per series is carried from round
    to round; a series that a round leaves as it is takes no part in the next.
    """
    _check(lower_q, upper_q)
    dist = F.lit(float(max_distance))
    rows = cut(df.select(key, value).filter(F.col(value).isNotNull()))  # every round reads it
    largest = largest_group(rows, [key])
    if gathered(largest):
        return _gathered_interval(rows, key, value, float(multiplier), lower_q, upper_q, dist, iterations)
    live = rows.withColumns({"lo": F.lit(float("-inf")), "hi": F.lit(float("inf")), "n0": F.lit(None).cast("long")})
    state, done = None, []
    inside = lambda lo, hi: (F.col(value) >= lo) & (F.col(value) <= hi)
    for step in range(1, iterations + 1):
        carried = [F.first(c).alias(c) for c in ("lo", "hi", "n0")] + [F.count("*").alias("n")]
        bounds = cut(tukey_bounds(live, [key], value, multiplier, lower_q, upper_q, carried, largest))
        if step > 1:  # counted now: what the round before has left
            same = F.col("n") == F.col("n0")
            done.append(bounds.filter(same).select(key, "lo", "hi", F.lit(step - 1).alias("n_steps"), F.col("n").alias("n_kept")))
            bounds = bounds.filter(~same)
            if bounds.isEmpty():
                state = None
                break
        limits = bounds.select(key, F.greatest("lo", "lower_bound").alias("lo"), F.least("hi", "upper_bound").alias("hi"), "n")
        carried = [F.first(c).alias(c) for c in ("lo", "hi", "n")]
        inner = rows.join(limits, key).filter(inside(F.col("lo"), F.col("hi")))
        med = grouped_quantiles(inner, [key], value, [0.5], ["med"], carried, largest)
        state = cut(med.select(key, F.greatest("lo", F.col("med") - dist).alias("lo"),
                               F.least("hi", F.col("med") + dist).alias("hi"), F.col("n").alias("n0")))
        live = rows.join(state, key).filter(inside(F.col("lo"), F.col("hi")))
    if state is not None:
        left = live.groupBy(key).agg(*[F.first(c).alias(c) for c in ("lo", "hi")], F.count("*").alias("n_kept"))
        done.append(left.select(key, "lo", "hi", F.lit(iterations).alias("n_steps"), "n_kept"))
    return reduce(DataFrame.unionByName, done)


def _gathered_interval(rows, key, value, multiplier, lower_q, upper_q, dist, iterations):
    """``screen_interval`` from the sorted values of each series."""
    def let(x, fn):  # one evaluation of x, however often fn names it
        return F.get(F.transform(F.array(x), fn), F.lit(0))

    def kept(s, lo, hi):  # s is sorted
        return F.filter(s, lambda v: (v >= lo) & (v <= hi))

    def state(s, lo, hi, n0, n_steps):
        return F.struct(s.alias("s"), lo.alias("lo"), hi.alias("hi"), n0.alias("n0"), n_steps.alias("n_steps"))

    def run(st, b):
        return let(kept(st["s"], b["lo"], b["hi"]), lambda t: let(
            between_ranks(t, 0.5), lambda med: let(
                F.struct(F.greatest(b["lo"], med - dist).alias("lo"), F.least(b["hi"], med + dist).alias("hi")),
                lambda c: state(kept(t, c["lo"], c["hi"]), c["lo"], c["hi"], F.size(st["s"]), F.lit(None).cast("int")))))

    def limits(st):
        lo, hi = between_ranks(st["s"], lower_q), between_ranks(st["s"], upper_q)
        return let(F.struct(lo.alias("a"), hi.alias("b")), lambda q: F.struct(
            F.greatest(st["lo"], q["a"] - F.lit(multiplier) * (q["b"] - q["a"])).alias("lo"),
            F.least(st["hi"], q["b"] + F.lit(multiplier) * (q["b"] - q["a"])).alias("hi")))

    def step(st, i):
        settled = st["n_steps"].isNotNull() | (F.size(st["s"]) == 0)
        same = F.size(st["s"]) == st["n0"]  # what the round before has left
        return (F.when(settled, st)
                .when(same, state(st["s"], st["lo"], st["hi"], st["n0"], i - 1))
                .otherwise(let(limits(st), lambda b: run(st, b))))

    t = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.col(value).cast("double"))).alias("__s"))
    start = state(F.col("__s"), F.lit(float("-inf")), F.lit(float("inf")), F.lit(None).cast("int"), F.lit(None).cast("int"))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(iterations)), start, step)
    t = t.select(key, end.alias("__e")).filter(F.size("__e.s") > 0)
    return t.select(key, "__e.lo", "__e.hi", F.coalesce("__e.n_steps", F.lit(iterations)).alias("n_steps"),
                    F.size("__e.s").cast("long").alias("n_kept"))


def tukey_interval(obs, multiplier=3.0, lower_q=0.25, upper_q=0.75, iterations=5, predicate=None):
    """Baseline rows and, per series that keeps any, the interval of ``tukey_fallback``."""
    base = obs.filter(tukey_baseline() if predicate is None else lit_false(predicate))
    return base, cut(screen_interval(base, "lake_id", "wse", multiplier, lower_q, upper_q, 150.0, iterations))


def tukey_fallback(obs, multiplier=3.0, lower_q=0.25, upper_q=0.75, iterations=5, predicate=None):
    """Baseline rows that survive up to ``iterations`` rounds of O1+O2, with
    ``n_steps`` (1-based count of rounds run)."""
    base, iv = tukey_interval(obs, multiplier, lower_q, upper_q, iterations, predicate)
    return base.join(iv, "lake_id").filter((F.col("wse") >= F.col("lo")) & (F.col("wse") <= F.col("hi"))).drop(
        "lo", "hi", "n_kept"
    )


_SCREEN_LEVELS = {
    "pass_version": ["lake_id", "pass_id", "crid_scenario"],
    "pass": ["lake_id", "pass_id"],
    "version": ["lake_id", "crid_scenario"],
    "series": ["lake_id"],
}


def screen_ice(
    obs, by_pass=True, by_version=True, multiplier=3.0, lower_q=0.25, upper_q=0.75,
    used="upper", filter_by="both",
):
    """O3: drop ice rows outside the Tukey bounds of comparable ice-free rows.

    Reference bounds are aggregated at every grouping level the options allow;
    each ice row takes the finest level its pass and version occur in. Rows
    without an ice flag go as soon as the series has an ice-free row.
    """
    if used not in ("upper", "lower", "both") or filter_by not in ("area", "wse", "both"):
        raise ValueError("used must be upper|lower|both and filter_by area|wse|both")
    values = {"area": ["area_total"], "wse": ["wse"], "both": ["area_total", "wse"]}[filter_by]
    free = obs.filter(F.col("ice_clim_f") <= 1)
    levels = ["series"] + (["pass"] if by_pass else []) + (["version"] if by_version else [])
    if by_pass and by_version:
        levels.append("pass_version")
    out = obs
    for level in levels:
        keys = _SCREEN_LEVELS[level]
        counts = [F.count(c).alias(f"n_{c}") for c in ("area_total", "wse")]
        if (lower_q, upper_q) == (0, 1):  # the extremes need no quantile
            agg = free.groupBy(*keys).agg(
                *[f(c).alias(f"{p}_{c}") for c in values for f, p in ((F.min, "ql"), (F.max, "qh"))], *counts
            )
        else:
            agg = None
            for c in values:
                q = grouped_quantiles(free, keys, c, [lower_q, upper_q], [f"ql_{c}", f"qh_{c}"],
                                      counts if agg is None else ())
                agg = q if agg is None else null_safe_join(agg, q, keys, "left")
        packed = agg.select(*keys, F.struct(*[c for c in agg.columns if c not in keys]).alias(f"__{level}"))
        out = null_safe_join(out, packed, keys, "left")
    series = F.col("__series")
    if by_pass and by_version:
        # both occur but never together: fall back to all ice-free rows
        ref = (
            F.when(F.col("__pass").isNotNull() & F.col("__version").isNotNull(), F.coalesce("__pass_version", "__series"))
            .when(F.col("__pass").isNotNull(), F.col("__pass"))
            .when(F.col("__version").isNotNull(), F.col("__version"))
            .otherwise(series)
        )
    elif by_pass or by_version:
        ref = F.coalesce("__pass" if by_pass else "__version", "__series")
    else:
        ref = series
    out = out.withColumn("__ref", ref)
    enough = (F.col("__ref.n_area_total") >= 2) | (F.col("__ref.n_wse") >= 2)
    ok = F.lit(True)
    m = F.lit(float(multiplier))
    for c in values:
        lo_q, hi_q = F.col(f"__ref.ql_{c}"), F.col(f"__ref.qh_{c}")
        upper = F.col(c) <= hi_q + m * (hi_q - lo_q)
        lower = F.col(c) >= lo_q - m * (hi_q - lo_q)
        test = {"upper": upper, "lower": lower, "both": upper & lower}[used]
        ok = ok & (F.col(c).isNull() | (F.col(f"__ref.n_{c}") < 2) | lit_false(test))
    keep = (
        F.when(series.isNull(), True)
        .when(F.col("ice_clim_f") <= 1, True)
        .when(F.col("ice_clim_f") > 1, ~lit_false(enough) | ok)
        .otherwise(False)
    )
    return out.filter(keep).drop("__ref", *[f"__{lv}" for lv in levels])


def drop_in_gaps(candidates: DataFrame, baseline: DataFrame, max_gap_days: float, key="lake_id", time="time"):
    """Drop candidates strictly inside baseline gaps longer than the limit."""
    # copies of a time collapse first, so right times are unique
    times = baseline.filter(F.col(time).isNotNull()).groupBy(key, time).agg(F.count("*").alias("__copies"))
    j = asof.prev_next(candidates, times, key, time, time, ["__copies"])
    t, a, b = F.col(time), F.col("prev.t"), F.col("next.t")
    inside = ((b - a) > F.lit(float(max_gap_days) * DAY)) & (t > a) & (t < b)
    return j.filter(~lit_false(inside)).drop("prev", "next")


def supported(cov: DataFrame, attempt: Attempt) -> Column:
    """O5 verdict on a coverage table (rows, t_first, t_last, max_gap)."""
    enough = F.col("n_rows") >= F.lit(attempt.min_rows)
    if attempt.allow_major_gap:
        return lit_false(enough)
    no_gap = ~lit_false(F.col("max_gap") > F.lit(attempt.max_gap_days * DAY))
    long = (F.col("t_last") - F.col("t_first")) >= F.lit(attempt.min_range_days * DAY)
    return lit_false(enough & no_gap & long)


def smallest_residual(curves: list[Column], observed: Column) -> Column:
    """Signed curve-minus-value of smallest size; missing curves ignored,
    the first of equals wins."""
    parts = F.array(
        *[
            F.struct(F.coalesce(F.abs(c - observed), F.lit(float("inf"))).alias("size"), F.lit(i).alias("i"),
                     (c - observed).alias("r"))
            for i, c in enumerate(curves)
        ]
    )
    return F.array_min(parts)["r"]


def clip_residuals(rows, z_threshold, spread, range_col, residual="residual", key="lake_id", stats=None):
    """Keep |z| < z_threshold or |residual|/range < spread (both strict).

    ``range_col`` is the reference range per row. All-zero residuals use a unit
    deviation.
    """
    if stats is None:
        stats = rows.groupBy(key).agg(
            F.avg(residual).alias("__mean"), F.stddev_pop(residual).alias("__std"),
            F.sum(F.abs(residual)).alias("__size"),
        )
    j = null_safe_join(rows, stats, [key], "inner")
    dev = F.col(residual) - F.col("__mean")
    z = F.when(F.col("__size") == 0, dev).otherwise(F.try_divide(dev, F.col("__std")))
    zt = z_threshold if isinstance(z_threshold, Column) else F.lit(float(z_threshold))
    sp = spread if isinstance(spread, Column) else F.lit(float(spread))
    rel = F.try_divide(F.abs(residual), F.col(range_col))
    return j.filter(lit_false(F.abs(z) < zt) | lit_false(rel < sp)).drop("__mean", "__std", "__size")
