"""Scoring of labelled series against gauges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import ValidationConfig
from ..functions.columns import benchmark_columns, timestamp_to_seconds
from ..operators import asof, metrics as M
from ..operators.daily import daily_series
from ..session import cut, discard

KEY = "lake_id"
_FLAGS = ["ice_clim_f", "quality_f", "xovr_cal_q", "crid"]
SHORT = {"Raw": "raw", "Stringent": "stringent", "Permissive": "permissive", "Filtered": "filtered"}


def match_gauges(labelled: DataFrame, gauge: DataFrame, tolerance: DataFrame | float) -> DataFrame:
    """Nearest reading within the tolerance of the lake's source.

    ``gauge`` has lake_id, gauge_time (seconds), gauge_wse with unique times per
    lake; ``tolerance`` is seconds or a table (lake_id, tolerance).
    """
    if isinstance(tolerance, (int, float)):
        return asof.nearest(labelled, gauge, KEY, "time", "gauge_time", ["gauge_wse"], tolerance)
    # joined behind the match, whose rows are dealt by lake already
    any_far = asof.nearest(labelled, gauge, KEY, "time", "gauge_time", ["gauge_wse"], float("inf"))
    j = any_far.join(tolerance.select(KEY, F.col("tolerance").alias("__tol")), KEY, "left")
    near = F.abs(F.col("gauge_time") - F.col("time")) <= F.col("__tol")
    return j.select(*labelled.columns, *[F.when(near, F.col(c)).alias(c) for c in ("gauge_time", "gauge_wse")])


def gauge_seconds(gauge: DataFrame, ts="gauge_datetime") -> DataFrame:
    """Normalised gauges to (lake_id, gauge_time, gauge_wse); readings sharing a
    timestamp become one, the largest value, so the nearest reading is unique."""
    return (
        gauge.filter(F.col(ts).isNotNull())
        .groupBy(KEY, timestamp_to_seconds(F.col(ts)).alias("gauge_time")).agg(F.max("gauge_wse").alias("gauge_wse"))
    )


def scored_rows(labelled: DataFrame, gauge: DataFrame, tolerance) -> DataFrame:
    """Matched rows with benchmark columns and the datum-corrected gauge."""
    return M.with_corrected_gauge(matched_rows(labelled, gauge, tolerance))


def matched_rows(labelled: DataFrame, gauge: DataFrame, tolerance) -> DataFrame:
    """Matched rows with benchmark columns, written: the offset reads them a second time."""
    return cut(match_gauges(benchmark_columns(labelled), gauge, tolerance))


def daily_tables(labelled: DataFrame, gauge: DataFrame, cfg: ValidationConfig) -> DataFrame:
    """D6 for every method at once, on one shared calendar."""
    cols = {f"daily_{SHORT[m]}": c for m, c in cfg.methods.items()}
    from ..functions.columns import seconds_to_timestamp

    g = gauge.withColumn("gauge_datetime", seconds_to_timestamp(F.col("gauge_time")))
    return daily_series(benchmark_columns(labelled), g, cols, major_gap_days=cfg.major_gauge_gap_days)


def method_errors(scored: DataFrame, cfg: ValidationConfig) -> DataFrame:
    """Error row per (lake, method), also where nothing matched. Only matched rows are spread over the methods."""
    long = M.method_long(scored.filter(F.col("gauge_corrected").isNotNull()), cfg.methods, [KEY, "gauge_corrected"])
    methods = F.array(*[F.lit(m) for m in cfg.methods])
    frame = scored.select(KEY).distinct().withColumn("method", F.explode(methods))
    return frame.join(M.pair_errors(long, [KEY, "method"], cfg), [KEY, "method"], "left").fillna(0, ["n_match", "n_used"])


def _pivot(long: DataFrame, cfg: ValidationConfig, cols: list[str]) -> DataFrame:
    return long.groupBy(KEY).agg(
        *[
            F.max(F.when(F.col("method") == m, F.col(c))).alias(f"{c}_{SHORT[m]}")
            for c in cols for m in cfg.methods
        ]
    )


def lake_stats(
    labelled: DataFrame, gauge: DataFrame, registry: DataFrame, tolerance,
    cfg: ValidationConfig = ValidationConfig(),
) -> DataFrame:
    """One row per registered lake; lakes without data keep NULL metrics.

    ``labelled`` carries wse_adjusted, filter_flag and the outcome columns.
    """
    # the errors read no other column of a row
    matched = matched_rows(labelled.select(KEY, "time", "wse", "wse_adjusted", *_FLAGS), gauge, tolerance)
    scored = cut(M.with_corrected_gauge(matched).select(KEY, *cfg.methods.values(), "gauge_corrected"))
    discard(matched)
    errors = _pivot(method_errors(scored, cfg), cfg, ["n_match", "n_used", "mae", "median_error"])
    daily = daily_tables(labelled, gauge, cfg)
    methods = [f"daily_{SHORT[m]}" for m in cfg.methods]
    dm = cut(M.daily_metrics(daily, methods, cfg))  # a row per lake, read twice
    kept = M.retained_variability(labelled, dm)
    ret = M.retention(labelled.withColumn("kept", F.col("filter_flag") == 1))
    meta = labelled.groupBy(KEY).agg(
        *[F.min_by(c, "index_col").alias(c) for c in ("filter_attempt", "n_while", "n_while_r2", "intra_cycle_flag", "p_ref_area")]
    ).withColumnRenamed("p_ref_area", "lake_area")
    out = registry.select(KEY, "gauge_source")
    for part in (meta, errors, dm.drop("long_enough"), kept, ret):
        out = out.join(part, KEY, "left")
    for c in out.columns:
        if c.startswith(("n_match_", "n_used_")):
            out = out.withColumn(c, F.coalesce(c, F.lit(0)))
    rename = {c: c.replace("_daily_", "_") for c in out.columns if "_daily_" in c}
    out = out.withColumnsRenamed(rename)
    return out.withColumn("filter_attempt", F.coalesce("filter_attempt", F.lit("no data")))
