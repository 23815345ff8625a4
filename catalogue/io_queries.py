"""Sources and sinks over the given tables: what is written to files is read back and compared."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from catalogue.duck import FILL, r6, sql
from catalogue.queries import KEY, _masked, r, register
from stillwater.config import COLLECTION_TAGS
from stillwater.functions import columns as C
from stillwater.operators import prep, thresholds as T
from stillwater.schema import OBSERVATIONS
from stillwater.session import scratch_path
from stillwater.sources import gauges as SG, observations as SO, sinks
from stillwater.sources.tables import ARRIVAL, table

_IDS = ["lake_id", "pass_id", "cycle_id", "quality_f", "crid"]
_VALUES = ["time", "wse", "wse_u", "area_total"]
_ROWS = f"select {', '.join(_IDS)}, {', '.join(f'{r6(f'nullif({c}, {FILL})')} as {c}' for c in _VALUES)} from obs"
_SOURCE_COLUMNS = [f.name for f in OBSERVATIONS.fields if f.name != "time_str"]


def _rows(got):
    return got.select(*_IDS, *[r(C.fill_to_null(F.col(c))).alias(c) for c in _VALUES])


@register(sql("obs", body=_ROWS))
def csv_cache(t):
    """Two CSV files with permuted headers."""
    path, half = scratch_path(t.spark, "io"), F.col("lake_id") % 2
    t.raw.filter(half == 0).select(*_SOURCE_COLUMNS).write.option("header", True).csv(f"{path}/a")
    t.raw.filter(half == 1).select(*reversed(_SOURCE_COLUMNS)).write.option("header", True).csv(f"{path}/b")
    got = SO.read_observations(t.spark, f"{path}/*", "csv")
    return _rows(got)


@register(sql("obs", body=_ROWS))
def parquet_cache(t):
    """The observation cache."""
    path = scratch_path(t.spark, "io")
    sinks.write_cache(t.raw.select(*_SOURCE_COLUMNS), path)
    return _rows(SO.read_observations(t.spark, path))


@register(sql("obs", body=_ROWS))
def response_envelopes(t):
    """Responses of some thousand rows at most, beside bodies that hold nothing."""
    line = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in _SOURCE_COLUMNS])
    # a response takes one share of its lake's rows, dealt by their arrival
    shares = t.raw.groupBy("lake_id").agg(F.ceil(F.count("*") / 1000).alias("shares"))
    dealt = t.raw.join(shares, "lake_id").withColumn("share", F.pmod(F.xxhash64(*ARRIVAL), "shares"))
    per_lake = dealt.select("lake_id", "share", line.alias("line")).groupBy("lake_id", "share").agg(F.collect_list("line").alias("lines"))
    text = F.concat(F.lit(",".join(_SOURCE_COLUMNS) + "\n"), F.array_join("lines", "\n"))
    bodies = per_lake.select(F.to_json(F.struct(F.struct(text.alias("csv")).alias("results"))).alias("body"))
    empty = per_lake.select(F.when(F.col("lake_id") % 3 == 0, "not json").when(F.col("lake_id") % 3 == 1, '{"results": {}}').alias("body"))
    path = scratch_path(t.spark, "io")
    bodies.union(empty).write.parquet(path)
    return _rows(SO.parse_responses(t.spark.read.parquet(path)))


_TAG = "SWOT_L2_HR_LakeSP_D"


@register(sql("obs", body=f"select lake_id, '{COLLECTION_TAGS[_TAG]}' as version_tag, count(*) as n from obs where collection_shortname = '{_TAG}' group by 1"))
def collection_filter(t):
    return SO.only_collection(t.raw, _TAG).groupBy("lake_id", "version_tag").agg(F.count("*").alias("n"))


@register(sql("p", body="select lake_id, first_position, row_number() over (order by first_position, lake_id) as first_rank from"
              " (select lake_id, min(l_orderkey) as first_position from p group by 1)"))
def ordered_ids(t):
    """Lakes in the order of their first order."""
    return prep.first_seen_order(t.raw.filter("wse <> -999999999999e0"), KEY, "l_orderkey")


_TEXT = """case when l_orderkey % 7 = 0 then 'bad' when l_orderkey % 11 = 0 then '' when l_orderkey % 13 = 0 then 'NaN'
 when l_orderkey % 17 = 0 then 'Infinity' when l_orderkey % 19 = 0 then '-999999999999' else cast(l_quantity as varchar(40)) end"""


@register(f"""select l_orderkey, l_linenumber, case when not regexp_matches(x, '^(bad|NaN|Infinity|-999999999999|)$') then cast(x as double) end as value,
 x <> 'bad' and x <> '' as readable from (select *, {_TEXT} as x from lineitem)""")
def coerced_numbers(t):
    """Text to numbers, then NaN, infinities and the fill value to missing."""
    raw = table(t.spark, t.dir, "lineitem").withColumn("x", F.expr(_TEXT.replace("varchar(40)", "string")))
    n = C.to_number(F.col("x"))
    return raw.select("l_orderkey", "l_linenumber", C.fill_to_null(n).alias("value"), n.isNotNull().alias("readable"))


def _gauge_times(t):
    return t.gauge.withColumn("ts", C.seconds_to_timestamp(F.col("gauge_time")))


_THREE = "case when lake_id % 3 = 0 then 'India' when lake_id % 3 = 1 then 'China' else 'West_Africa' end"


@register(sql("gauge", body=f"""select lake_id, {_THREE} as gauge_source, {r6('gauge_time')} as gauge_time, {r6('gauge_wse')} as gauge_wse,
 case when lake_id % 3 = 0 then 1382400e0 else 86400e0 end as tolerance from gauge"""))
def gauge_registry_files(t):
    """Three source files to one registry; a lake listed twice keeps the first source."""
    path, g = scratch_path(t.spark, "io"), _gauge_times(t)
    spec = {s.name: s for s in SG.SOURCES}
    name = F.concat(F.lit("Lake "), F.col("lake_id").cast("string"))
    by_name = g.filter("lake_id % 3 = 0").select(
        F.upper(F.concat(F.lit(" "), name, F.lit(" "))).alias("Reservoir_name"), F.col("ts").cast("string").alias("Date"), F.col("gauge_wse").alias("Level"))
    part = lambda f: f(F.col("ts").cast("timestamp"))
    by_parts = g.filter("lake_id % 3 = 1").select(
        F.col("lake_id").alias("PLD_Lake_ID"), part(F.year).alias("Year"), part(F.month).alias("Month"), part(F.dayofmonth).alias("Day"),
        part(F.hour).alias("Hour"), part(F.minute).alias("Minute"), part(F.second).alias("Second"), F.col("gauge_wse").alias("WSE/m"))
    # The last file lists the lakes of the others again, with other readings.
    plain = g.select(F.col("lake_id").alias("PLD_Lake_ID"), F.col("ts").cast("string").alias("gauge_datetime"),
                     F.when(F.col("lake_id") % 3 == 2, F.col("gauge_wse")).otherwise(F.col("gauge_wse") + 1).alias("gauge_wse"))
    files = []
    for s, df in (("India", by_name), ("China", by_parts), ("West_Africa", plain)):
        df.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{path}/{s}")
        files.append((spec[s], f"{path}/{s}"))
    lakes = t.registry.select("lake_id", F.concat(F.lit("lake "), F.col("lake_id").cast("string")).alias("reservoir_name"))
    readings, registry = SG.assemble(t.spark, files, lakes)
    out = readings.join(registry.select("lake_id", "tolerance"), "lake_id")
    return out.select("lake_id", "gauge_source", r(C.timestamp_to_seconds(F.col("gauge_datetime"))).alias("gauge_time"), r("gauge_wse").alias("gauge_wse"), "tolerance")


@register(sql("gauge", body=f"""select lake_id, cast(cast(date_trunc('month', timestamp '2000-01-01' + to_seconds(cast(gauge_time as bigint)))
 + interval '14 days 12 hours' as timestamp) as varchar) as stamp, count(*) as n, {r6('sum(gauge_wse)')} as level from gauge group by 1, 2"""))
def monthly_readings(t):
    """Month stamps of a table keyed by (name, state)."""
    path, g = scratch_path(t.spark, "io"), _gauge_times(t)
    g.select(F.col("lake_id").cast("string").alias("Reservoir Name"), F.lit("S").alias("State"), F.lit("D").alias("District"),
             F.date_format("ts", "yyyy-MM").alias("Date"), F.col("gauge_wse").alias("Level")).write.option("header", True).csv(path)
    lakes = t.registry.select("lake_id", F.col("lake_id").cast("string").alias("reservoir_name"), F.lit("S").alias("reservoir_state"))
    got = SG.read_monthly(t.spark, path, lakes)
    return got.groupBy("lake_id", F.date_format("gauge_datetime", "yyyy-MM-dd HH:mm:ss").alias("stamp")).agg(
        F.count("*").alias("n"), r(F.sum("gauge_wse")).alias("level"))


@register(sql("lab", body=f"select filter_attempt, lake_id, count(*) as n, sum(filter_flag) as n_kept, {r6('sum(wse_adjusted)')} as total from lab group by 1, 2"))
def observation_sink(t):
    """Written by attempt and read back."""
    path = scratch_path(t.spark, "io")
    sinks.write_observations(t.labelled, path)
    back = t.spark.read.parquet(path)
    return back.groupBy("filter_attempt", "lake_id").agg(
        F.count("*").alias("n"), F.sum("filter_flag").alias("n_kept"), r(F.sum("wse_adjusted")).alias("total"))


@register(sql("thr", body="""select lake_id, crid_scenario, pass_id, ice_condition, row_number() over (partition by lake_id order by pair_order, ice_condition) as place,
 wse_std_thr_cal, wse_u_thr_cal, xtrk_dist_thr_cal from thr"""))
def threshold_sink(t):
    """The order of the written rows, from their places in the files."""
    path = scratch_path(t.spark, "io")
    missing = lambda c, kind: F.lit(None).cast(kind).alias(c)
    names = [f for f in sinks.THRESHOLD_SUMMARY.fields if f.name not in t.thr.columns]
    sinks.write_threshold_summary(t.thr.select("*", *[missing(f.name, f.dataType) for f in names]), path)
    back = t.spark.read.parquet(path).select("*", "_metadata.file_name", "_metadata.row_index")
    place = F.row_number().over(W.partitionBy("lake_id").orderBy("file_name", "row_index"))
    return back.select("lake_id", "crid_scenario", "pass_id", "ice_condition", place.alias("place"),
                       "wse_std_thr_cal", "wse_u_thr_cal", "xtrk_dist_thr_cal")


@register(sql("masked", body=f"select lake_id, filter_attempt, cast(keep_mask as int) as keep_mask, {r6('mae_filtered')} as mae_filtered from masked"))
def statistics_sink(t):
    """With the selection mask."""
    path = scratch_path(t.spark, "io")
    sinks.write_lake_stats(_masked(t), path)
    back = t.spark.read.parquet(path)
    return back.select("lake_id", "filter_attempt", F.col("keep_mask").cast("int").alias("keep_mask"), r("mae_filtered").alias("mae_filtered"))
