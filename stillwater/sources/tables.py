"""Observation and gauge views over the star-schema tables.

Every lineitem row becomes one observation of the series of its supplier and
every order one gauge reading, so all work grows with the tables. The
supplier's nation decides what the series looks like (clean, offset passes,
a long gap, a short record, few good flags) by its flags and days; no row is left
out for it. A few measurements of every series carry the fill value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

ARRIVAL = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]

SCENARIO = """case when s_nationkey between 10 and 12 then 'flagged'
 when s_nationkey in (13, 14, 18) then 'offset'
 when s_nationkey between 15 and 17 then 'gap'
 when s_nationkey in (19, 20) then 'short'
 when s_nationkey in (21, 22) then 'poor' else 'plain' end"""

# The day of an observation, d0 being the ship date's days from 1995-01-01: a series with a gap
# has its days of that time moved behind it, a short record is pressed into half a year.
DAY_OF = """cast(case when scenario = 'gap' and d0 >= 1096 and d0 < 1339 then d0 + 243
 when scenario = 'short' then 821 + floor(d0 * 183 / 2.6e3) else d0 end as int)"""

# Rows of a series with few good flags that are flagged as bad.
FLAGGED = """(scenario = 'poor' or (scenario = 'flagged'
 and not (l_returnflag = 'A' and l_linestatus = 'F' and l_orderkey % 40 = 0)))"""

OBS_COLUMNS = {
    "lake_id": "l_suppkey",
    "time": "cast(d95 - 1826 as double) * 8.64e4 + cast(case when l_partkey % 11 = 0 then 0"
    " else (l_orderkey * 7919 + l_linenumber * 104729) % 86400 end as double)",
    "wse": "case when l_partkey % 53 = 7 then -999999999999e0 else 1e2 + abs((d95 % 365) - 182) / 1.82e1"
    " + (l_extendedprice - 52500) / 9.7e4"
    " + case when l_quantity >= 49 then 2.5e1 when l_quantity <= 1 then -2.5e1 else 0e0 end"
    " + case when scenario = 'offset' then (l_linenumber - 4) * 4e0 else 0e0 end end",
    "wse_u": "case when l_partkey % 41 = 0 then -999999999999e0 else round(l_tax * 2, 6) end",
    "wse_std": "round(l_discount * 8 + case when l_partkey % 37 = 0 then 10 else 0 end, 6)",
    "xtrk_dist": "cast((l_partkey % 150) * 1000 - 75000 as double)",
    "quality_f": f"cast(case when {FLAGGED} then 3 when l_returnflag = 'A' then 0 when l_returnflag = 'N' then 1 else 2 + l_partkey % 2 end as int)",
    "xovr_cal_q": f"cast(case when {FLAGGED} then 2 when l_linestatus = 'F' then 0 else l_partkey % 3 end as int)",
    "ice_clim_f": "cast(case when month(date '1995-01-01' + d95) in (12, 1, 2) then 2"
    " when month(date '1995-01-01' + d95) in (3, 11) then 1 else 0 end as int)",
    "cycle_id": "cast(floor(d95 / 2.1e1) as int) + 1",
    "pass_id": "cast(l_linenumber as int)",
    "crid": "case when d95 < 1096 then 'PGC0' when d95 < 1826 then 'PIC2' else 'PID0' end",
    "collection_shortname": "'SWOT_L2_HR_LakeSP_D'",
    "area_total": "l_quantity",
    "p_ref_area": "round(greatest(s_acctbal, 0) + 2e-2, 2)",
    "p_lat": "cast(s_suppkey % 140 - 60 as double)",
    "p_lon": "cast((s_suppkey * 37) % 360 as double)",
}

GAUGE_WSE = (
    "2.5e2 + abs((d95 % 365) - 182) / 1.82e1 + (o_totalprice % 100) / 1e3"
    " + case when o_orderkey % 97 = 0 then 5e2 else 0e0 end"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw observations, with the arrival columns that break time ties."""
    # What one side knows alone is derived before the join: a filter on the time is pushed into the join, where it
    # would otherwise repeat all of it for every row in a method too long to be compiled.
    li = table(spark, sf_dir, "lineitem").withColumn("d0", F.expr("datediff(cast(l_shipdate as date), date'1995-01-01')"))
    su = table(spark, sf_dir, "supplier").select("s_suppkey", F.expr(SCENARIO).alias("scenario"), "s_acctbal")
    j = li.join(su, li.l_suppkey == su.s_suppkey).withColumn("d95", F.expr(DAY_OF))
    cols = [F.expr(e).alias(c) for c, e in OBS_COLUMNS.items()]
    return j.select(*cols, *ARRIVAL)


def gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gauge readings: one per lake and timestamp (the latest order wins)."""
    orders = table(spark, sf_dir, "orders")
    su = table(spark, sf_dir, "supplier")
    n = su.agg(F.count("*").alias("n"))  # one row: the only broadcast here
    g = (
        orders.join(F.broadcast(n))
        .withColumn("d95", F.expr("datediff(cast(o_orderdate as date), date'1995-01-01')"))
        .select(
            F.expr("o_custkey % n").alias("lake_id"),
            F.expr("cast(d95 - 1826 as double) * 8.64e4 + 4.32e4").alias("gauge_time"),
            F.expr(GAUGE_WSE).alias("gauge_wse"),
            "o_orderkey",
        )
    )
    return g.groupBy("lake_id", "gauge_time").agg(F.max_by("gauge_wse", "o_orderkey").alias("gauge_wse"))


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (lake, gauge source): the nation of the supplier first, then
    the nations of the customers whose orders feed the lake's gauge."""
    su = table(spark, sf_dir, "supplier")
    return su.select(
        F.col("s_suppkey").alias("lake_id"),
        F.concat(F.lit("nation_"), F.col("s_nationkey").cast("string")).alias("gauge_source"),
        F.col("s_nationkey").cast("int").alias("priority"),
    )
