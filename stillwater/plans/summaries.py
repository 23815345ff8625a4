"""Cross-lake validation tables: X1-X23.

Inputs hold one row per lake (or lake x cycle); they still grow with the number
of lakes, so quantiles and ranks avoid putting all lakes into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..config import DAY, ValidationConfig
from ..functions.columns import area_bin, to_number, wrap_longitude
from ..functions.quantiles import grouped_quantiles
from ..operators import asof, metrics as M
from ..sources import fixed

KEY = "lake_id"
METHODS = ["raw", "stringent", "permissive", "filtered"]
VARIABILITY = ["std", "amp", "idr"]
AREA_LABELS_FIGURE = ["first", "<=1", "<=10", "<=100", "<=1000", "<=10000", "last"]
AREA_LABELS_FIXED = ["<=0.1", "<=1", "<=10", "<=100", "<=1000", "<=10000", ">10000"]


def coverage_sets(registry, raw, prepared, thresholds) -> DataFrame:
    """Registered lakes absent from observations, series or thresholds."""
    ids = registry.select(KEY).distinct()
    out = None
    for name, df in (("observations", raw), ("series", prepared), ("thresholds", thresholds)):
        gone = ids.join(df.select(KEY), KEY, "left_anti").withColumn("missing_in", F.lit(name))
        out = gone if out is None else out.unionByName(gone)
    return out


def invalid_lakes(registry, matched, cfg: ValidationConfig = ValidationConfig()) -> DataFrame:
    """Registered lakes that cannot be scored, with the reasons."""
    t = matched.groupBy(KEY).agg(
        F.count("gauge_wse").alias("n_gauge"),
        F.count(F.when(F.col("wse").isNotNull() & F.col("gauge_wse").isNotNull(), 1)).alias("n_pairs"),
    )
    j = registry.select(KEY).distinct().join(t, KEY, "left")
    j = j.select(
        KEY, F.col("n_gauge").isNull().alias("no_data"),
        F.coalesce(F.col("n_gauge") == 0, F.lit(False)).alias("no_gauge_joined"),
        F.coalesce(F.col("n_pairs") < cfg.min_raw_matches, F.lit(False)).alias("few_pairs"),
    )
    return j.filter("no_data or no_gauge_joined or few_pairs")


def source_counts(stats, invalid) -> DataFrame:
    """Lakes per gauge source before and after removal, side by side."""
    def count(df, name):
        return df.filter(F.col("gauge_source").isNotNull()).groupBy("gauge_source").agg(F.countDistinct(KEY).alias(name))

    left = stats.join(invalid.select(KEY), KEY, "left_anti")
    j = count(stats, "n_before").join(count(left, "n_after"), "gauge_source", "full_outer")
    return j.fillna(0, ["n_before", "n_after"])


def attempt_share(stats) -> DataFrame:
    """Percentage of lakes per attempt."""
    n = stats.groupBy("filter_attempt").agg(F.count("*").alias("n_lakes"))
    return n.withColumn("share", 100.0 * F.col("n_lakes") / F.sum("n_lakes").over(W.partitionBy(F.lit(1))))


def reference_lakes(labelled, cfg: ValidationConfig = ValidationConfig()) -> DataFrame:
    """Lakes whose retained series supports validation, with its coverage."""
    if cfg.reference_selection not in ("strict_only", "strict_plus_gap_checked_lenient"):
        raise ValueError(f"unsupported reference_selection {cfg.reference_selection!r}")
    attempt = labelled.groupBy(KEY).agg(F.first("filter_attempt").alias("filter_attempt"))
    cov = asof.coverage(labelled.filter("filter_flag = 1"), [KEY], "time")
    j = attempt.join(cov, KEY, "left").select(
        KEY, F.lower(F.trim("filter_attempt")).alias("filter_attempt"),
        F.floor((F.col("t_last") - F.col("t_first")) / DAY).alias("span_days"),
        (F.col("max_gap") / DAY).alias("max_gap_days"),
    )
    keep = F.col("filter_attempt") == "1_strict"
    if cfg.reference_selection != "strict_only":
        keep = keep | (
            (F.col("filter_attempt") == "2_lenient")
            & (F.coalesce("span_days", F.lit(0)) >= cfg.reference_min_span_days)
            & F.coalesce(F.col("max_gap_days") <= cfg.reference_max_gap_days, F.lit(False))
        )
    return j.withColumn("keep_mask", keep.cast("int"))


def with_keep_mask(stats, reference) -> DataFrame:
    """1 for reference lakes."""
    return stats.join(reference.select(KEY, "keep_mask"), KEY, "left").withColumn(
        "keep_mask", F.coalesce("keep_mask", F.lit(0))
    )


def selection_shares(masked) -> DataFrame:
    """Kept, validated and cross-pass corrected shares (percent)."""
    valid = (F.col("keep_mask") == 1) & F.col("mae_filtered").isNotNull()
    pct = lambda c: 100.0 * F.avg(c.cast("double"))
    return masked.agg(
        F.count("*").alias("n_lakes"), pct(F.col("keep_mask") == 1).alias("kept_share"),
        pct(valid).alias("validated_share"),
        (100.0 * F.avg(F.when(valid, (F.col("intra_cycle_flag") == 1).cast("double")))).alias("corrected_share"),
    )


def validated(masked) -> DataFrame:
    """Lakes of the summaries below: reference lakes with an error value."""
    return masked.filter((F.col("keep_mask") == 1) & F.col("mae_filtered").isNotNull())


def normalised_error(value, gauge):
    """X16 column: |V - Vg| / Vg for Vg > 0."""
    return F.when(F.col(gauge) > 0, F.abs(F.col(value) - F.col(gauge)) / F.col(gauge))


def norm_variability(stats) -> DataFrame:
    """Long table (lake, statistic, method, rel_err)."""
    parts = [
        F.struct(F.lit(v).alias("statistic"), F.lit(m).alias("method"), normalised_error(f"{v}_{m}", f"{v}_gauge").alias("rel_err"))
        for v in VARIABILITY for m in METHODS
    ]
    return stats.select(KEY, "lake_area", F.explode(F.array(*parts)).alias("e")).select(KEY, "lake_area", "e.*")


def metric_long(stats) -> DataFrame:
    """Per-lake metrics in long form (lake, metric, method, value)."""
    e = [F.struct(F.lit("mae").alias("metric"), F.lit(m).alias("method"), F.col(f"mae_{m}").alias("value")) for m in METHODS]
    e += [F.struct(F.lit("correlation").alias("metric"), F.lit(m).alias("method"), F.col(f"corr_{m}").alias("value")) for m in METHODS]
    e += [
        F.struct(F.lit(f"rel_{v}").alias("metric"), F.lit(m).alias("method"), normalised_error(f"{v}_{m}", f"{v}_gauge").alias("value"))
        for v in VARIABILITY for m in METHODS
    ]
    rate = {"raw": F.lit(1.0), "stringent": F.col("retention_stringent"), "permissive": F.col("retention_permissive"),
            "filtered": F.col("retention_rate")}
    e += [F.struct(F.lit("retention").alias("metric"), F.lit(m).alias("method"), (100.0 * rate[m]).alias("value")) for m in METHODS]
    return stats.select(KEY, F.explode(F.array(*e)).alias("e")).select(KEY, "e.*").filter(F.col("value").isNotNull())


def percentile_summary(long, cfg: ValidationConfig = ValidationConfig()) -> DataFrame:
    """P50, P25, P75 and the summary percentile per metric and method;
    metrics where higher is better use the complementary percentile."""
    s = cfg.summary_percentile / 100.0
    q = grouped_quantiles(
        long.withColumn("__k", F.concat_ws("/", "metric", "method")), ["__k", "metric", "method"], "value",
        [0.25, 0.5, 0.75, s, 1.0 - s], ["p25", "p50", "p75", "__hi", "__lo"], [F.count("value").alias("n")],
    )
    better_high = F.col("metric").isin("correlation", "retention")
    return q.withColumn("p_summary", F.when(better_high, F.col("__lo")).otherwise(F.col("__hi"))).drop("__k", "__hi", "__lo")


def extra_residual(stats, cfg: ValidationConfig = ValidationConfig()) -> DataFrame:
    """sqrt(max(0, r_daily^2 - r_retained^2)), summarised per statistic."""
    parts = []
    for v in VARIABILITY:
        g, d, r = (to_number(F.col(f"{v}_{x}")) for x in ("gauge", "filtered", "retained"))
        rd, rr = F.abs(d - g) / d, F.abs(r - g) / d
        val = F.when((d > 0) & g.isNotNull() & r.isNotNull(), F.sqrt(F.greatest(F.lit(0.0), rd * rd - rr * rr)))
        parts.append(F.struct(F.lit(v).alias("statistic"), val.alias("r_extra")))
    long = stats.select(F.explode(F.array(*parts)).alias("e")).select("e.*").filter(F.col("r_extra").isNotNull())
    return grouped_quantiles(long, ["statistic"], "r_extra", [cfg.summary_percentile / 100.0], ["p_summary"],
                             [F.count("*").alias("n")])


def area_histogram(masked, bins_per_decade: int = 10) -> DataFrame:
    """Log-spaced lake-area counts of four groups; last bin closed."""
    valid = (F.col("keep_mask") == 1) & F.col("mae_filtered").isNotNull()
    groups = {"all": F.lit(True), "strict": F.col("filter_attempt") == "1_strict", "kept": F.col("keep_mask") == 1, "validated": valid}
    d = masked.filter(F.col("lake_area") > 0)
    ends = d.agg(F.min("lake_area").alias("a"), F.max("lake_area").alias("b")).select(
        "a", "b",
        F.greatest(F.lit(5), F.log10(F.col("b") / F.col("a")).cast("int") * bins_per_decade).alias("n_edges"),
    )
    pos = F.log10(F.col("lake_area") / F.col("a")) / F.nullif(F.log10(F.col("b") / F.col("a")), F.lit(0.0)) * (F.col("n_edges") - 1)
    b = F.least(F.floor(F.round(pos, 9)).cast("int"), F.col("n_edges") - 2)
    counted = d.crossJoin(F.broadcast(ends)).withColumn("bin", F.coalesce(b, F.lit(0)))  # ends: one row
    return counted.groupBy("bin").agg(
        *[F.count(F.when(c, 1)).alias(f"n_{n}") for n, c in groups.items()],
        F.min("n_edges").alias("n_edges"), F.min("a").alias("area_min"), F.max("b").alias("area_max"),
    )


def anomalies(scored) -> DataFrame:
    """X11: every value minus the mean retained value of its lake."""
    mean = scored.groupBy(KEY).agg(F.avg("wse_adjusted").alias("__m"))
    j = scored.join(mean, KEY)
    cols = {"raw": "wse", "filtered": "wse_adjusted", "stringent": "wse_stringent", "permissive": "wse_permissive",
            "gauge": "gauge_corrected"}
    return j.select(KEY, "index_col", *[(F.col(c) - F.col("__m")).alias(f"anom_{n}") for n, c in cols.items()])


def ecdf(long, group: list[str], value: str, buckets: int = 256) -> DataFrame:
    """Position of each value in its group, percent (i / n, ties apart).

    Values are bucketed between approximate quantiles of the group, so a large
    group is ranked bucket by bucket, evenly whatever its outliers, with offsets
    from the bucket counts.
    """
    d = long.filter(F.col(value).isNotNull() & (F.abs(value) < float("inf")))
    cuts = F.percentile_approx(value, [i / buckets for i in range(1, buckets)], 20 * buckets)
    ends = d.groupBy(*group).agg(cuts.alias("__cuts"), F.count("*").alias("n"))
    d = d.join(ends, group)
    d = d.withColumn("__bucket", F.size(F.filter("__cuts", lambda c: c < F.col(value)))).drop("__cuts")
    counts = d.groupBy(*group, "__bucket").agg(F.count("*").alias("__c"))
    counts = counts.withColumn(
        "__before", F.sum("__c").over(W.partitionBy(*group).orderBy("__bucket").rowsBetween(W.unboundedPreceding, 0)) - F.col("__c")
    ).drop("__c")
    rn = F.row_number().over(W.partitionBy(*group, "__bucket").orderBy(value, KEY))
    out = d.withColumn("__rn", rn).join(counts, [*group, "__bucket"])
    return out.withColumn("pct", (F.col("__before") + F.col("__rn")) / F.col("n") * 100.0).drop("__bucket", "__before", "__rn")


def retention_by_cycle(scored, cfg: ValidationConfig = ValidationConfig()) -> DataFrame:
    """Retained share per lake and cycle with the cycle's start date."""
    d = scored.filter(F.col("cycle_id").between(cfg.start_cycle, cfg.end_cycle))
    n = d.groupBy(KEY, "cycle_id").agg(
        F.count("wse").alias("n_raw"), F.count("wse_adjusted").alias("n_filtered"),
        F.count("wse_stringent").alias("n_stringent"), F.count("wse_permissive").alias("n_permissive"),
    )
    for m in ("filtered", "stringent", "permissive"):
        n = n.withColumn(f"ret_{m}", F.try_divide(F.col(f"n_{m}").cast("double"), F.col("n_raw")) * 100.0)
    lookup = F.broadcast(fixed.cycle_lookup(scored.sparkSession))  # 36 rows
    return n.join(lookup, "cycle_id", "left")


def box_stats(long, group: list[str], value: str) -> DataFrame:
    """P5/P25/P50/P75/P95 per group."""
    return grouped_quantiles(long, group, value, [0.05, 0.25, 0.5, 0.75, 0.95], ["p5", "p25", "p50", "p75", "p95"],
                             [F.count(value).alias("n")])


def error_by_ice(scored, cfg: ValidationConfig = ValidationConfig()) -> DataFrame:
    """Errors per lake, method and ice state, relative to the sample
    deviation of the retained values."""
    ice = F.col("ice_clim_f")
    conds = F.array_compact(
        F.array(F.when(ice < 1, F.lit("Ice-free")), F.when(ice >= 1, F.lit("Ice-covered")), F.lit("Ice-both"))
    )
    matched = scored.filter(F.col("gauge_corrected").isNotNull())  # the others have no error to spread
    long = M.method_long(matched.withColumn("__conds", conds), cfg.methods, [KEY, "gauge_corrected", "__conds"])
    long = long.withColumn("ice_cond", F.explode("__conds")).drop("__conds")
    err = M.pair_errors(long, [KEY, "method", "ice_cond"], cfg)
    lake = scored.groupBy(KEY).agg(
        F.stddev_samp("wse_adjusted").alias("__s"),
        F.max_by(F.col("p_ref_area"), F.when(F.col("p_ref_area").isNotNull(), F.col("index_col"))).alias("lake_area"),
    )
    # every combination has a row, also where nothing matched
    methods = F.array(*[F.lit(m) for m in cfg.methods])
    states = F.array(*[F.lit(s) for s in ("Ice-free", "Ice-covered", "Ice-both")])
    frame = lake.withColumn("method", F.explode(methods)).withColumn("ice_cond", F.explode(states))
    out = frame.join(err, [KEY, "method", "ice_cond"], "left").fillna(0, ["n_match", "n_used"])
    rel = F.when(F.col("__s") > 0, F.col("mae") / F.col("__s"))
    return out.withColumn("rel_err", rel).drop("__s")


def error_by_ice_summary(errors, cfg: ValidationConfig = ValidationConfig()) -> DataFrame:
    """P50 and the summary percentile of X14 by state and method."""
    s = cfg.summary_percentile / 100.0
    e = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in ("mae", "rel_err")])
    long = errors.select("ice_cond", "method", F.explode(e).alias("e")).select("ice_cond", "method", "e.*")
    return grouped_quantiles(long, ["ice_cond", "method", "metric"], "value", [0.5, s], ["p50", "p_summary"],
                             [F.count("value").alias("n")])


def with_area_bins(df, figure: bool = False) -> DataFrame:
    """The fixed edges, or the figure's edges that start and end at the
    data (needs five lakes)."""
    area = F.col("lake_area")
    if not figure:
        return df.withColumn("area_bin", area_bin(area, [0, 0.1, 1, 10, 100, 1000, 10000, float("inf")], AREA_LABELS_FIXED))
    ends = df.filter(area > 0).agg(F.min("lake_area").alias("__a"), F.max("lake_area").alias("__b"),
                                   F.countDistinct(KEY).alias("__n"))
    edges = [F.col("__a"), 0.1, 1, 10, 100, 1000, 10000, F.col("__b")]
    binned = F.when(F.col("__n") >= 5, area_bin(area, edges, AREA_LABELS_FIGURE))
    return df.crossJoin(F.broadcast(ends)).withColumn("area_bin", binned).drop("__a", "__b", "__n")  # ends: one row


def area_bin_reduction(stats) -> DataFrame:
    """How far the filter lowers the median relative error of the standard
    deviation against the stringent benchmark, per area bin."""
    long = norm_variability(stats.filter((F.col("std_gauge") > 0) & F.col("lake_area").isNotNull())).filter(
        (F.col("statistic") == "std") & F.col("method").isin("stringent", "filtered"))
    binned = with_area_bins(long, figure=True).filter(F.col("area_bin").isNotNull())
    n = binned.groupBy("area_bin").agg(F.countDistinct(KEY).alias("n_lakes"))
    q = grouped_quantiles(binned, ["area_bin", "method"], "rel_err", [0.5], ["m"])
    w = q.groupBy("area_bin").agg(
        F.max(F.when(F.col("method") == "stringent", F.col("m"))).alias("median_stringent"),
        F.max(F.when(F.col("method") == "filtered", F.col("m"))).alias("median_filtered"),
    ).filter(F.col("median_stringent").isNotNull() & F.col("median_filtered").isNotNull())
    red = F.when(F.col("median_stringent") > 0,
                 (F.col("median_stringent") - F.col("median_filtered")) / F.col("median_stringent") * 100)
    return w.join(n, "area_bin").withColumn("reduction_pct", red)


def reduction_range(reduction) -> DataFrame:
    """Smallest, largest and median reduction across bins (seven rows)."""
    return reduction.agg(F.min("reduction_pct").alias("min_reduction"), F.max("reduction_pct").alias("max_reduction"),
                         F.percentile("reduction_pct", 0.5).alias("median_reduction"))


def variability_summary(long, group: list[str], cfg: ValidationConfig = ValidationConfig()) -> DataFrame:
    """N, median, mean, summary percentile and P90 of the relative error."""
    return grouped_quantiles(
        long, group, "rel_err", [0.5, cfg.summary_percentile / 100.0, 0.9], ["median", "p_summary", "p90"],
        [F.count("rel_err").alias("n"), F.avg("rel_err").alias("mean")],
    )


def lake_dimension(obs) -> DataFrame:
    """First complete position and area per lake, positive area, wrapped
    longitude."""
    cols = [to_number(F.col(c)).alias(c) for c in ("p_lat", "p_lon", "p_ref_area")]
    d = obs.select(KEY, "index_col", *cols).dropna(subset=[KEY, "p_lat", "p_lon", "p_ref_area"])
    first = d.groupBy(KEY).agg(F.min_by(F.struct("p_lat", "p_lon", "p_ref_area"), "index_col").alias("s"))
    out = first.select(KEY, "s.*").filter(F.col("p_ref_area") > 0)
    return out.withColumn("p_lon", wrap_longitude(F.col("p_lon")))


def geo_table(stats, dimension, metric: str) -> DataFrame:
    """Metric with position per lake, and the symmetric colour limit (P95 of
    the size, else its maximum, else one)."""
    d = stats.select(KEY, metric).join(dimension, KEY).filter(F.col(metric).isNotNull())
    d = d.withColumn("__size", F.abs(metric))
    lim = grouped_quantiles(d, [], "__size", [0.95], ["__p"], [F.max("__size").alias("__m")])
    limit = F.when(F.col("__p") > 0, F.col("__p")).when(F.col("__m") > 0, F.col("__m")).otherwise(1.0)
    return d.crossJoin(F.broadcast(lim)).withColumn("colour_limit", limit).drop("__size", "__p", "__m")  # one row


def area_stats(dimension) -> DataFrame:
    """X23."""
    return grouped_quantiles(
        dimension, [], "p_ref_area", [0.5], ["median_area"],
        [F.min("p_ref_area").alias("min_area"), F.max("p_ref_area").alias("max_area"),
         F.avg("p_ref_area").alias("mean_area"), F.count("*").alias("n_lakes")],
    )
