"""Threshold calibration and application: T1-T15.

Observations are touched by one aggregation (to version x pass x ice cells);
everything after it works on the cells, a table bounded by the orbit geometry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..config import Bounds, Grouping, METRICS
from ..functions.columns import conservative, lit_false
from ..functions.quantiles import null_safe_join

KEYS = ["lake_id", "crid_scenario", "pass_id"]


def threshold_cells(obs: DataFrame, predicate: Column | None = None) -> DataFrame:
    """One row per (series, version, pass, ice state) seen, with the extremes of
    its calibration subset (T1 at the finest level)."""
    cons = conservative() if predicate is None else lit_false(predicate)
    return obs.groupBy(*KEYS, "ice_condition").agg(
        F.min("index_col").alias("first_seen"),
        F.count(F.when(cons, 1)).alias("n_cons"),
        F.max(F.when(cons, F.col("wse_std"))).alias("wse_std"),
        F.max(F.when(cons, F.col("wse_u"))).alias("wse_u"),
        F.min(F.when(cons, F.abs("xtrk_dist"))).alias("xtrk_dist"),
    )


def _base_rows(cells: DataFrame) -> DataFrame:
    """Both ice states and a pooled row for every pair seen."""
    states = F.array(F.lit("ice-free"), F.lit("ice-covered"), F.lit("both"))
    pairs = cells.groupBy(*KEYS).agg(
        F.min("first_seen").alias("pair_order"), F.sum("n_cons").alias("pair_cons")
    ).withColumn("ice_condition", F.explode(states))
    joined = null_safe_join(pairs, cells, KEYS + ["ice_condition"], "left")
    n = F.when(F.col("ice_condition") == "both", F.col("pair_cons")).otherwise(F.col("n_cons"))
    return joined.withColumn(
        "grouping_scheme", F.when(n.isNull(), 3).when(n > 0, 1).otherwise(2).cast("int")
    ).drop("pair_cons", "n_cons", "first_seen")


def _fill(df: DataFrame, col: str, keys: list[str], target: Column, agg) -> DataFrame:
    """One T5 level: missing values of target rows take the reduced group value."""
    pooled = agg(F.col(col)).over(W.partitionBy("lake_id", *keys))
    return df.withColumn(col, F.when(target, F.coalesce(F.col(col), pooled)).otherwise(F.col(col)))


def calibrate(
    obs: DataFrame,
    grouping: Grouping = Grouping(),
    predicate: Column | None = None,
) -> DataFrame:
    """Thresholds per (series, version, pass, ice condition)."""
    both = F.col("ice_condition") == "both"
    t = _base_rows(threshold_cells(obs, predicate)).repartition("lake_id")
    t = t.withColumn("is_both", both)
    for i, metric in enumerate(METRICS):
        agg = F.min if metric == "xtrk_dist" else F.max
        keys = [k for k, on in (("crid_scenario", grouping.by_version[i]), ("pass_id", grouping.by_pass[i])) if on]
        ice_keys = keys + (["ice_condition"] if grouping.by_ice[i] else [])
        by_cell = agg(F.col(metric)).over(W.partitionBy("lake_id", *ice_keys))
        pooled = agg(F.col(metric)).over(W.partitionBy("lake_id", *keys))
        t = t.withColumn(f"{metric}_thr_cal", F.when(both, pooled).otherwise(by_cell))
    ice = ~F.col("is_both")
    split = [] if grouping.compat else ["is_both"]
    for col in ("wse_std_thr_cal", "wse_u_thr_cal"):
        t = _fill(t, col, ["ice_condition", "pass_id"], ice, F.max)
        t = _fill(t, col, ["ice_condition", "crid_scenario"], ice, F.max)
        if not grouping.compat:
            t = _fill(t, col, ["ice_condition"], ice, F.max)
    col = "xtrk_dist_thr_cal"
    t = _fill(t, col, ["pass_id", "ice_condition"], ice, F.min)
    t = _fill(t, col, ["pass_id", "crid_scenario"] + split, ice, F.min)
    if not grouping.compat:
        t = _fill(t, col, ["pass_id"] + split, ice, F.min)
        for key in ("pass_id", "crid_scenario"):
            for metric in METRICS:
                agg = F.min if metric == "xtrk_dist" else F.max
                t = _fill(t, f"{metric}_thr_cal", [key] + split, F.col("is_both"), agg)
    return t.select(
        *KEYS, "ice_condition", *[f"{m}_thr_cal" for m in METRICS], "grouping_scheme", "pair_order"
    )


def _limits(bounds: Bounds, i: int) -> tuple[float, float, float]:
    """(default, low, high) of metric i; the distance is a lower threshold."""
    lo, hi = (bounds.std, bounds.u, bounds.xtrk)[i]
    return (lo if METRICS[i] == "xtrk_dist" else hi), lo, hi


def bounded(cal: Column, bounds: Bounds, i: int) -> Column:
    """Default for a missing threshold, then clip."""
    default, lo, hi = _limits(bounds, i)
    return F.least(F.greatest(F.coalesce(cal, F.lit(float(default))), F.lit(float(lo))), F.lit(float(hi)))


def _wide(thr: DataFrame, metrics: list[str], words: list[str]) -> DataFrame:
    """One row per (series, version, pass) with the needed calibrated values."""
    aggs = [
        F.max(F.when(F.col("ice_condition") == w, F.col(f"{m}_thr_cal"))).alias(f"__{m}_{w}")
        for m in metrics for w in words
    ]
    return thr.groupBy(*KEYS).agg(*aggs)


def with_thresholds(obs: DataFrame, thr: DataFrame, bounds: Bounds = Bounds(), flag: str = "passes",
                    trace: bool = True) -> DataFrame:
    """Trace columns and the pass flag on every observation."""
    return with_flags(obs, thr, {flag: bounds}, trace)


def with_flags(obs: DataFrame, thr: DataFrame, flags: dict[str, Bounds], trace: bool = False) -> DataFrame:
    """Pass flags of several bounds; the thresholds meet the observations once."""
    rules = [b.free_rules + b.ice_rules for b in flags.values()]
    words = sorted({w for r in rules for w in r if w != "not apply"})
    needed = [m for i, m in enumerate(METRICS)
              if any(r[k] != "not apply" for r in rules for k in (i, i + len(METRICS)))]
    out = null_safe_join(obs, _wide(thr, needed, words), KEYS, "left") if needed else obs
    for flag, bounds in flags.items():
        out = _flagged(out, bounds, flag)
        if not trace:
            out = out.drop(*trace_columns())
    return out.drop(*[f"__{m}_{w}" for m in needed for w in words])


def _flagged(out: DataFrame, bounds: Bounds, flag: str) -> DataFrame:
    covered = F.col("ice_condition") == "ice-covered"
    ice_touched = lit_false(F.col("ice_clim_f") >= 1)
    ok = F.lit(True)
    for i, m in enumerate(METRICS):
        def pick(rule):
            return F.lit(None).cast("double") if rule == "not apply" else F.col(f"__{m}_{rule}")

        free, cov = bounds.free_rules[i], bounds.ice_rules[i]
        source = F.when(covered, F.lit(cov)).otherwise(F.lit(free))
        active = source != "not apply"
        cal = F.when(covered, pick(cov)).otherwise(pick(free))
        bound = F.when(active, bounded(cal, bounds, i))
        if m == "xtrk_dist":
            app = bound
            passed = F.abs(m) >= F.col(f"{m}_thr_app")
        else:
            floor = F.lit(float(bounds.std_ice_min if m == "wse_std" else bounds.u_ice_min))
            app = F.when(ice_touched, F.greatest(bound, F.when(bound.isNotNull(), floor))).otherwise(bound)
            passed = F.col(m) <= F.col(f"{m}_thr_app")
        out = (
            out.withColumn(f"{m}_thr_source", source)
            .withColumn(f"{m}_thr_cal", cal)
            .withColumn(f"{m}_thr_bound", bound)
            .withColumn(f"{m}_thr_app", app)
        )
        ok = ok & ((F.col(f"{m}_thr_source") == "not apply") | lit_false(passed))
    return out.withColumn(flag, ok)


def trace_columns() -> list[str]:
    return [f"{m}_thr_{part}" for m in METRICS for part in ("source", "cal", "bound", "app")]


def apply_thresholds(obs: DataFrame, thr: DataFrame, bounds: Bounds = Bounds()) -> DataFrame:
    """Rows that pass every active threshold, original columns only."""
    return with_thresholds(obs, thr, bounds, trace=False).filter("passes").drop("passes")


def threshold_summary(obs: DataFrame, thr: DataFrame, bounds: Bounds = Bounds()) -> DataFrame:
    """Bounds only on threshold rows that an observation selects."""
    seen = obs.groupBy(*KEYS).agg(
        F.max((F.col("ice_condition") == "ice-free").cast("int")).alias("__free"),
        F.max((F.col("ice_condition") == "ice-covered").cast("int")).alias("__cov"),
    )
    out = null_safe_join(thr, seen, KEYS, "left")
    for i, m in enumerate(METRICS):
        chosen = lit_false(
            ((F.col("__free") == 1) & (F.col("ice_condition") == bounds.free_rules[i]))
            | ((F.col("__cov") == 1) & (F.col("ice_condition") == bounds.ice_rules[i]))
        )
        out = out.withColumn(f"{m}_thr_bound", F.when(chosen, bounded(F.col(f"{m}_thr_cal"), bounds, i)))
    return out.drop("__free", "__cov")


def blank_unused(df: DataFrame) -> DataFrame:
    """No bound or applied value where thresholds were not the final filter."""
    unused = F.col("filter_attempt").isin("3_tukey", "4_none")
    for c in df.columns:
        if c.endswith("_thr_bound") or c.endswith("_thr_app"):
            df = df.withColumn(c, F.when(~unused, F.col(c)))
    return df
