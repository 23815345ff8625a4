"""Gauge sources, registry and cleaning rules: S5-S8, J7, J8, P20, P21."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

HOURS_24, DAYS_16 = 86400.0, 16 * 86400.0


@dataclass(frozen=True)
class GaugeSource:
    """How one source names its key, time and value; ``priority`` orders sources."""

    name: str
    priority: int
    key: str = "PLD_Lake_ID"
    time: tuple[str, ...] = ("gauge_datetime",)
    value: str = "gauge_wse"
    tolerance: float = HOURS_24
    encoding: str = "UTF-8"


# Source names, columns and tolerances, in order of preference.
# The Latin-2 files are read as Latin-1, which Spark's reader accepts: both are
# one byte per character and agree on ASCII, which the key, time and value
# columns are written in.
_LATIN = {"encoding": "ISO-8859-1"}
SOURCES = [
    GaugeSource("India", 1, key="Reservoir_name", time=("Date",), value="Level", tolerance=DAYS_16),
    GaugeSource("China", 2, time=("Year", "Month", "Day", "Hour", "Minute", "Second"), value="WSE/m"),
    GaugeSource("West_Africa", 3),
    GaugeSource("Tefe", 4),
    GaugeSource("Amazon_floodplain", 5),
    GaugeSource("Ceara_Brazil", 6),
    GaugeSource("Other_Brazil", 7),
    GaugeSource("BAFU", 8, **_LATIN),
    GaugeSource("NVE", 9, **_LATIN),
    GaugeSource("US", 10, **_LATIN),
    GaugeSource("Canada_GNSS", 11, **_LATIN),
    GaugeSource("Canada_no_GNSS", 12, **_LATIN),
]

GAUGE_SCHEMA = T.StructType(
    [
        T.StructField("lake_id", T.LongType()),
        T.StructField("gauge_source", T.StringType()),
        T.StructField("gauge_datetime", T.TimestampNTZType()),
        T.StructField("gauge_wse", T.DoubleType()),
    ]
)


def time_from_parts(cols: list[Column]) -> Column:
    """Year..second columns to a zone-naive timestamp."""
    parts = [c.try_cast("double").cast("int") for c in cols[:5]]
    return F.make_timestamp_ntz(*parts, cols[5].try_cast("decimal(16,6)"))


def _csv(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    # every column as text: no inference pass, bad numbers become NULL later
    return spark.read.option("header", True).option("encoding", encoding).csv(path)


def read_source(spark: SparkSession, path: str, spec: GaugeSource) -> DataFrame:
    """S5 for a source keyed by lake id."""
    df = _csv(spark, path, spec.encoding)
    cols = [F.col(f"`{c}`") for c in spec.time]
    ts = time_from_parts(cols) if len(cols) == 6 else F.try_to_timestamp(cols[0]).cast("timestamp_ntz")
    return df.select(
        F.col(f"`{spec.key}`").try_cast("double").cast("long").alias("lake_id"),
        F.lit(spec.name).alias("gauge_source"),
        ts.alias("gauge_datetime"),
        F.col(f"`{spec.value}`").try_cast("double").alias("gauge_wse"),
    )


def text_key(c: Column) -> Column:
    """Names match regardless of case and outer blanks."""
    return F.lower(F.trim(c.cast("string")))


def read_by_name(spark: SparkSession, path: str, metadata: DataFrame, spec: GaugeSource) -> DataFrame:
    """A source keyed by reservoir name, through (lake_id, reservoir_name)."""
    df = _csv(spark, path, spec.encoding)
    m = metadata.select("lake_id", text_key(F.col("reservoir_name")).alias("__name"))
    g = df.withColumn("__name", text_key(F.col(f"`{spec.key}`")))
    return g.join(m, "__name").select(
        "lake_id",
        F.lit(spec.name).alias("gauge_source"),
        F.try_to_timestamp(F.col(f"`{spec.time[0]}`")).cast("timestamp_ntz").alias("gauge_datetime"),
        F.col(f"`{spec.value}`").try_cast("double").alias("gauge_wse"),
    )


def mid_month(month: Column) -> Column:
    """A month stands for the 15th at noon."""
    return F.try_to_timestamp(F.concat(month, F.lit("-15 12:00:00"))).cast("timestamp_ntz")


def longest_district(df: DataFrame, key="lake_id", district="District", ts="gauge_datetime") -> DataFrame:
    """Rows of the sub-gauge with the longest whole-day span; the first
    name wins a tie, a missing name is a sub-gauge of its own."""
    spans = df.groupBy(key, district).agg(
        F.floor((F.unix_micros(F.max(ts).cast("timestamp")) - F.unix_micros(F.min(ts).cast("timestamp"))) / 86400000000)
        .alias("__span")
    )
    w = W.partitionBy(key).orderBy(F.col("__span").desc_nulls_last(), F.col(district).asc_nulls_last())
    best = spans.withColumn("__r", F.row_number().over(w)).filter("__r = 1").select(
        F.col(key).alias("__k"), F.col(district).alias("__d")
    )
    return df.join(best, (F.col(key) == F.col("__k")) & F.col(district).eqNullSafe(F.col("__d")), "left_semi")


def read_monthly(spark: SparkSession, path: str, metadata: DataFrame, name="India") -> DataFrame:
    """Monthly variant: exact (name, state), mid-month stamp, longest district."""
    df = _csv(spark, path, "UTF-8")
    m = metadata.select("lake_id", F.col("reservoir_name").alias("__n"), F.col("reservoir_state").alias("__s"))
    g = df.join(m, (F.col("`Reservoir Name`") == F.col("__n")) & (F.col("State") == F.col("__s")))
    g = g.select(
        "lake_id", F.lit(name).alias("gauge_source"), mid_month(F.col("Date")).alias("gauge_datetime"),
        F.col("Level").try_cast("double").alias("gauge_wse"), "District",
    )
    return longest_district(g).drop("District")


def union_sources(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def preferred_source(registry: DataFrame) -> DataFrame:
    """A lake listed by several sources keeps the first listed."""
    w = W.partitionBy("lake_id").orderBy("priority", "gauge_source")
    return registry.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def assemble(
    spark: SparkSession, files: list[tuple[GaugeSource, str]], metadata: DataFrame | None = None,
    monthly_path: str | None = None, monthly_lakes=(), excluded_lakes=(),
) -> tuple[DataFrame, DataFrame]:
    """Readings of each lake's preferred source, and the registry
    (lake_id, gauge_source, priority, tolerance) behind them.

    Sources keyed by a name go through ``metadata``; the lakes of the monthly route
    take their readings from the monthly table instead of that source.
    """
    monthly_lakes, excluded_lakes = list(monthly_lakes), list(excluded_lakes)
    parts = []
    for spec, path in files:
        by_name = spec.key != GaugeSource("", 0).key
        part = read_by_name(spark, path, metadata, spec) if by_name else read_source(spark, path, spec)
        if by_name and monthly_path is not None:
            part = part.filter(~F.col("lake_id").isin(monthly_lakes))
            month = read_monthly(spark, monthly_path, metadata, spec.name)
            part = part.unionByName(month.filter(F.col("lake_id").isin(monthly_lakes)))
        parts.append(part)
    readings = union_sources(parts).filter("lake_id is not null and gauge_datetime is not null and gauge_wse is not null")
    readings = readings.filter(~F.col("lake_id").isin(excluded_lakes))
    order = F.create_map(*[F.lit(x) for spec, _ in files for x in (spec.name, spec.priority)])
    tolerance = F.create_map(*[F.lit(x) for spec, _ in files for x in (spec.name, spec.tolerance)])
    listed = readings.select("lake_id", "gauge_source").distinct().withColumns(
        {"priority": order[F.col("gauge_source")], "tolerance": tolerance[F.col("gauge_source")]})
    registry = preferred_source(listed)
    return readings.join(registry.select("lake_id", "gauge_source"), ["lake_id", "gauge_source"]), registry


RULE_SCHEMA = (
    "lake_id long, t_from timestamp_ntz, t_from_open boolean, t_to timestamp_ntz, t_to_open boolean, "
    "v_lt double, v_gt double"
)


def apply_cleaning(gauge: DataFrame, rules: DataFrame, ts="gauge_datetime", value="gauge_wse") -> DataFrame:
    """Drop readings that a rule of their lake rejects, and missing ones.

    A rule rejects inside its time range (open or closed ends, NULL is
    unbounded) when the value is below ``v_lt`` or above ``v_gt`` (both strict),
    or always when the rule has no value limit.
    """
    r = rules.select(F.col("lake_id").alias("__lake"), *[c for c in rules.columns if c != "lake_id"])
    after = F.col("t_from").isNull() | F.when(F.col("t_from_open"), F.col(ts) > F.col("t_from")).otherwise(
        F.col(ts) >= F.col("t_from"))
    before = F.col("t_to").isNull() | F.when(F.col("t_to_open"), F.col(ts) < F.col("t_to")).otherwise(
        F.col(ts) <= F.col("t_to"))
    low = F.coalesce(F.col(value) < F.col("v_lt"), F.lit(False))
    high = F.coalesce(F.col(value) > F.col("v_gt"), F.lit(False))
    always = F.col("v_lt").isNull() & F.col("v_gt").isNull()
    hit = (F.col("lake_id") == F.col("__lake")) & after & before & (low | high | always)
    return gauge.filter(F.col(value).isNotNull()).join(r, hit, "left_anti")
