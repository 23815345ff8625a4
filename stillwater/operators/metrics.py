"""Accuracy, variability and correlation metrics: M1-M13 pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..config import ValidationConfig
from ..functions import groups
from ..functions.columns import lit_false, permissive, stringent
from ..functions.quantiles import grouped_medians, grouped_quantiles, percentiles
from ..functions.ranks import running_total
from ..session import cut

KEY = "lake_id"


def mae(a: Column, b: Column) -> Column:
    """M2 aggregate: pairs with a missing side are skipped."""
    return F.avg(F.abs(a - b))


def median_residual(a: Column, b: Column) -> Column:
    """M1 aggregate: median of a - b (group below the heavy-row limit)."""
    return percentiles(a - b, [0.5])[0]


def pearson(a: Column, b: Column) -> Column:
    """M3 aggregate over complete pairs; NULL for < 2 pairs or a constant side."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return F.when(F.count(F.when(both, 1)) >= 2, r)


def spearman(df: DataFrame, a: str, b: str, out: str = "spearman") -> DataFrame:
    """M3: correlation of average ranks per series. Series that one task may order each (counted first)
    are ranked behind one shuffle. Otherwise equal values are counted before
    they are ordered, so ties are one row, and the order is dealt by ranges, so a
    long series is ranked by many tasks."""
    pairs = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(KEY, a, b)
    if groups.largest_group(pairs, [KEY]) <= groups.GATHERED_ROWS:
        def ranked(c):
            ties = F.count("*").over(W.partitionBy(KEY, c))
            return F.rank().over(W.partitionBy(KEY).orderBy(c)) + (ties - 1) / 2

        j = pairs.repartition(KEY).withColumn("__ra", ranked(a)).withColumn("__rb", ranked(b))
        return j.groupBy(KEY).agg(pearson(F.col("__ra"), F.col("__rb")).alias(out))
    pairs = cut(pairs)

    def ranks(c, name):
        counted = pairs.groupBy(KEY, c).agg(F.count("*").alias("__c"))
        placed = running_total(counted, [KEY], [c], "__c", "__before")
        return placed.select(KEY, c, (F.col("__before") + (F.col("__c") + 1) / 2).alias(name))

    j = pairs.join(ranks(a, "__ra"), [KEY, a]).join(ranks(b, "__rb"), [KEY, b])
    return j.groupBy(KEY).agg(pearson(F.col("__ra"), F.col("__rb")).alias(out))


def std_pop(c) -> Column:
    """M4."""
    return F.stddev_pop(c)


def amplitude(c) -> Column:
    """M5."""
    return F.max(c) - F.min(c)


def p10_p90(c) -> Column:
    """M6 (bounded groups: daily tables)."""
    p = percentiles(c, [0.1, 0.9])
    return p[1] - p[0]


def datum_offset(matched: DataFrame) -> DataFrame:
    """M8: gauge-minus-series offset per series with its five fallbacks.

    ``matched`` carries wse, wse_adjusted, ice_clim_f and gauge_wse.
    """
    g, adj, raw = F.col("gauge_wse"), F.col("wse_adjusted"), F.col("wse")
    free = lit_false(F.col("ice_clim_f") < 1)
    t = grouped_medians(
        matched, [KEY],
        {
            "adj_free": F.when(free, g - adj), "adj_all": g - adj,
            "raw_free": F.when(free, g - raw), "raw_all": g - raw,
            "med_gauge": g, "med_adj": adj, "med_raw": raw,
        },
        [F.count(adj).alias("n_adj")],
    )
    has = F.col("n_adj") > 0
    pick = lambda a, b: F.when(has, F.col(a)).otherwise(F.col(b))
    return t.select(
        KEY,
        F.coalesce(
            pick("adj_free", "raw_free"), pick("adj_all", "raw_all"), F.col("raw_all"),
            F.col("med_gauge") - pick("med_adj", "med_raw"), F.lit(0.0),
        ).alias("bias"),
    )


def with_corrected_gauge(matched: DataFrame) -> DataFrame:
    return matched.join(datum_offset(matched), KEY, "left").withColumn(
        "gauge_corrected", F.col("gauge_wse") - F.col("bias")
    )


def method_long(df: DataFrame, methods: dict[str, str], keep: list[str]) -> DataFrame:
    """One row per (row, method) with the method's value."""
    entries = F.array(*[F.struct(F.lit(m).alias("method"), F.col(c).alias("value")) for m, c in methods.items()])
    return df.select(*keep, F.explode(entries).alias("e")).select(*keep, "e.*")


def pair_errors(df: DataFrame, keys: list[str], cfg: ValidationConfig, value="value", ref="gauge_corrected"):
    """M7 per group: matched pairs, pairs left after dropping zero residuals,
    MAE and median residual of those."""
    r = F.col(value) - F.col(ref)
    used = lit_false(F.abs(r) > F.lit(cfg.zero_residual_tol))
    d = df.withColumn("__r", F.when(used, r))
    out = grouped_quantiles(
        d, keys, "__r", [0.5], ["median_error"],
        [F.count(r).alias("n_match"), F.count("__r").alias("n_used"), F.avg(F.abs("__r")).alias("mae")],
    )
    enough = F.col("n_used") >= cfg.min_matched
    return out.select(
        *keys, "n_match", "n_used",
        F.when(enough, F.col("mae")).alias("mae"), F.when(enough, F.col("median_error")).alias("median_error"),
    )


def daily_metrics(daily: DataFrame, columns: list[str], cfg: ValidationConfig, gauge="daily_gauge") -> DataFrame:
    """M3-M6 and M9 per series on a daily table (bounded by the calendar)."""
    aggs = [F.min("date").alias("overlap_start"), F.max("date").alias("overlap_end")]
    for c in columns + [gauge]:
        aggs += [std_pop(c).alias(f"std_{c}"), amplitude(c).alias(f"amp_{c}"), p10_p90(c).alias(f"idr_{c}")]
    for c in columns:
        aggs.append(pearson(F.col(c), F.col(gauge)).alias(f"corr_{c}"))
    t = daily.groupBy(KEY).agg(*aggs)
    long = F.datediff("overlap_end", "overlap_start") >= cfg.min_daily_span_days
    t = t.withColumn("long_enough", long)
    fixed = {KEY, "overlap_start", "overlap_end", "long_enough"}
    return t.select(KEY, "overlap_start", "overlap_end", "long_enough",
                    *[F.when(F.col("long_enough"), F.col(c)).alias(c) for c in t.columns if c not in fixed])


def retained_variability(obs: DataFrame, overlap: DataFrame) -> DataFrame:
    """Variability of retained days inside the overlap, no interpolation."""
    d = (
        obs.filter(F.col("wse_adjusted").isNotNull())
        .groupBy(KEY, F.to_date("datetime").alias("date")).agg(F.avg("wse_adjusted").alias("v"))
        .join(overlap.filter("long_enough").select(KEY, "overlap_start", "overlap_end"), KEY)
        .filter((F.col("date") >= F.col("overlap_start")) & (F.col("date") <= F.col("overlap_end")))
    )
    return d.groupBy(KEY).agg(
        std_pop("v").alias("std_retained"), amplitude("v").alias("amp_retained"), p10_p90("v").alias("idr_retained")
    )


def retention(obs: DataFrame) -> DataFrame:
    """Shares of kept rows and of fully iced rows (``kept`` flag column)."""
    share = lambda c: F.avg(c.cast("double"))
    return obs.groupBy(KEY).agg(
        F.count(F.when(F.col("kept"), 1)).alias("retention_n"),
        share(F.coalesce("kept", F.lit(False))).alias("retention_rate"),
        share(stringent()).alias("retention_stringent"),
        share(permissive()).alias("retention_permissive"),
        share(lit_false(F.col("ice_clim_f") == 2)).alias("ice_duration"),
    )
