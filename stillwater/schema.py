"""Explicit schemas of the tables that cross a boundary."""

from __future__ import annotations

from pyspark.sql import DataFrame, types as T

OBSERVATIONS = T.StructType(
    [
        T.StructField("lake_id", T.LongType()),
        T.StructField("time", T.DoubleType()),
        T.StructField("time_str", T.StringType()),
        T.StructField("wse", T.DoubleType()),
        T.StructField("wse_u", T.DoubleType()),
        T.StructField("wse_std", T.DoubleType()),
        T.StructField("xtrk_dist", T.DoubleType()),
        T.StructField("quality_f", T.IntegerType()),
        T.StructField("xovr_cal_q", T.IntegerType()),
        T.StructField("ice_clim_f", T.IntegerType()),
        T.StructField("cycle_id", T.IntegerType()),
        T.StructField("pass_id", T.IntegerType()),
        T.StructField("crid", T.StringType()),
        T.StructField("collection_shortname", T.StringType()),
        T.StructField("p_ref_area", T.DoubleType()),
        T.StructField("area_total", T.DoubleType()),
        T.StructField("p_lat", T.DoubleType()),
        T.StructField("p_lon", T.DoubleType()),
    ]
)

REQUIRED = [
    "lake_id", "time", "wse", "wse_u", "wse_std", "xtrk_dist", "quality_f",
    "xovr_cal_q", "ice_clim_f", "cycle_id", "pass_id", "crid",
    "collection_shortname", "p_ref_area", "area_total",
]

THRESHOLDS = T.StructType(
    [
        T.StructField("lake_id", T.LongType()),
        T.StructField("crid_scenario", T.StringType()),
        T.StructField("pass_id", T.IntegerType()),
        T.StructField("ice_condition", T.StringType()),
        T.StructField("wse_std_thr_cal", T.DoubleType()),
        T.StructField("wse_u_thr_cal", T.DoubleType()),
        T.StructField("xtrk_dist_thr_cal", T.DoubleType()),
        T.StructField("grouping_scheme", T.IntegerType()),
    ]
)

THRESHOLD_SUMMARY = T.StructType(
    THRESHOLDS.fields
    + [
        T.StructField("wse_std_thr_bound", T.DoubleType()),
        T.StructField("wse_u_thr_bound", T.DoubleType()),
        T.StructField("xtrk_dist_thr_bound", T.DoubleType()),
        T.StructField("filter_attempt", T.StringType()),
    ]
)


def require_columns(df: DataFrame, required=REQUIRED) -> DataFrame:
    """S3: fail early, naming every missing column."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df
