"""Scalar Column expressions: predicates, labels and coercions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..config import EPOCH_2000_UNIX, FILL_VALUE


def lit_false(cond: Column) -> Column:
    """A missing comparison counts as not satisfied."""
    return F.coalesce(cond, F.lit(False))


def fill_to_null(c: Column) -> Column:
    """Fill value, NaN and infinities become NULL."""
    inf = F.lit(float("inf"))
    return F.when((c != FILL_VALUE) & ~F.isnan(c) & (F.abs(c) < inf), c)


def to_number(c: Column) -> Column:
    """Numeric coercion, unreadable text becomes NULL."""
    return c.try_cast("double")


def seconds_to_timestamp(time: Column) -> Column:
    """Seconds since 2000-01-01 UTC to a zone-naive UTC timestamp."""
    return F.timestamp_seconds(time + F.lit(float(EPOCH_2000_UNIX))).cast("timestamp_ntz")


def timestamp_to_seconds(ts: Column) -> Column:
    """Zone-naive UTC timestamp to seconds since 2000-01-01 (microsecond exact)."""
    micros = F.unix_micros(ts.cast("timestamp"))
    return (micros - F.lit(EPOCH_2000_UNIX * 1_000_000)) / F.lit(1e6)


def version_suffix(crid: Column) -> Column:
    """Last two characters of the trimmed version id, else 'unknown'."""
    t = F.trim(crid)
    return F.when(F.length(t) >= 2, F.substring(t, -2, 2)).otherwise(F.lit("unknown"))


def is_new_version(crid: Column) -> Column:
    """Ends with C2, or the second-last character is D."""
    return lit_false(crid.endswith("C2") | crid.rlike("^.*D.$"))


def conservative(df_cols=F.col) -> Column:
    """Calibration subset."""
    q, x = df_cols("quality_f"), df_cols("xovr_cal_q")
    return lit_false((x < 1) & ((q < 1) | ((q == 1) & is_new_version(df_cols("crid")))))


def tukey_baseline() -> Column:
    """P10: baseline of the Tukey fallback."""
    return lit_false(
        (F.col("quality_f") == 0) & (F.col("xovr_cal_q") == 0) & (F.col("ice_clim_f") < 2)
    )


def stringent() -> Column:
    """P11."""
    return lit_false((F.col("xovr_cal_q") < 1) & (F.col("ice_clim_f") < 1) & (F.col("quality_f") < 1))


def permissive() -> Column:
    """P12."""
    new = is_new_version(F.col("crid"))
    q = F.col("quality_f")
    return lit_false(
        (F.col("xovr_cal_q") < 2)
        & (F.col("ice_clim_f") < 2)
        & (((q < 1) & ~new) | ((q < 3) & new))
    )


def high_quality() -> Column:
    """Rows the second round may bring back."""
    return lit_false(
        (F.col("xovr_cal_q") == 0) & (F.col("quality_f") == 0) & (F.col("ice_clim_f") == 0)
    )


def baseline_hygiene() -> Column:
    """O6."""
    return lit_false((F.col("xovr_cal_q") < 2) & (F.col("quality_f") < 3))


def ice_condition(ice: Column) -> Column:
    """A missing flag counts as ice-free."""
    return F.when(ice >= 2, F.lit("ice-covered")).otherwise(F.lit("ice-free"))


def quality_labels(df: DataFrame) -> DataFrame:
    """Class labels of the native flags."""
    q, new = F.col("quality_f"), is_new_version(F.col("crid"))
    x, ice = F.col("xovr_cal_q"), F.col("ice_clim_f")
    dist = F.abs("xtrk_dist")
    return (
        df.withColumn(
            "quality_class",
            F.when(((q == 1) & ~new) | ((q == 3) & new), "bad")
            .when((q == 2) & new, "degraded")
            .when((q == 1) & new, "suspect"),
        )
        .withColumn("xovr_class", F.when(x == 2, "bad").when(x == 1, "suspect"))
        .withColumn("ice_class", F.when(ice == 2, "full").when(ice == 1, "partial"))
        .withColumn("xtrk_outside", lit_false((dist < 10000) | (dist > 60000)))
    )


def above_calibrated(df: DataFrame) -> DataFrame:
    """``wse_std`` above the calibrated threshold of its row (trace columns needed)."""
    return df.withColumn("wse_std_above", lit_false(F.col("wse_std") > F.col("wse_std_thr_cal")))


def benchmark_columns(df: DataFrame) -> DataFrame:
    """The value where a benchmark holds, else NULL."""
    return df.withColumn("wse_stringent", F.when(stringent(), F.col("wse"))).withColumn(
        "wse_permissive", F.when(permissive(), F.col("wse"))
    )


def wrap_longitude(lon: Column) -> Column:
    """To [-180, 180)."""
    return F.pmod(lon + F.lit(180.0), F.lit(360.0)) - F.lit(180.0)


def where(df: DataFrame, predicate: str | Column) -> DataFrame:
    """User-supplied predicate (SQL text or Column); bad text raises."""
    if isinstance(predicate, Column):
        return df.filter(lit_false(predicate))
    try:
        return df.filter(lit_false(F.expr(predicate)))
    except Exception as exc:
        raise ValueError(f"invalid predicate {predicate!r}: {exc}") from exc


def area_bin(area: Column, edges: list, labels: list[str]) -> Column:
    """Right-closed bins, lowest edge included.

    Edges are numbers or Columns (the figure set starts and ends at the data).
    """
    if len(edges) != len(labels) + 1:
        raise ValueError("edges must be one longer than labels")
    e = [x if isinstance(x, Column) else F.lit(float(x)) for x in edges]
    out = None
    for i, label in enumerate(labels):
        low = (area >= e[i]) if i == 0 else (area > e[i])
        cond = low & (area <= e[i + 1])
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out
