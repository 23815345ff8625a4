import numpy as np
from pyspark.sql import functions as F

from stillwater.config import ValidationConfig
from stillwater.functions import groups
from stillwater.functions.quantiles import grouped_quantiles, percentiles
from stillwater.operators import asof, grid as G, metrics as M, prep, screens, wavelets
from stillwater.operators.daily import daily_series
from stillwater.plans import summaries as X, validation as V
from stillwater.session import configure, cut, partition_for
from stillwater.sources import tables

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_filter_on_the_time_does_not_repeat_the_scenario(spark):
    """A filter pushed into the join held the whole expression of the scenario six times."""
    rows = prep.prepare(tables.observations(spark, SF), tables.ARRIVAL)
    assert not [line for line in plan(rows).splitlines() if "Join" in line and "s_nationkey" in line]


def test_small_groups_are_gathered_without_a_join(spark):
    df = spark.range(3000).selectExpr("id % 7 as k", "cast(id * 31 % 997 as double) as v")
    got = grouped_quantiles(df, ["k"], "v", [0.9, 0.1, 0.5], list("abc"), [F.count("v").alias("n")])
    assert "Join" not in plan(got) and got.columns == ["k", "a", "b", "c", "n"]
    one = got.where("k = 3").first()
    want = df.where("k = 3").select(F.percentile("v", [0.9, 0.1, 0.5])).first()[0]
    assert [one.a, one.b, one.c] == want and one.n == 429


def test_packed_tables_are_not_taken_for_small(spark):
    """300,000 ordinals take less than 10 MB of files and over 10 MB in a broadcast."""
    df = cut(spark.range(300_000).selectExpr("id * 7919 % 300007 as index_col", "id % 1000 as lake_id"))
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    assert size > 10 << 20


def test_partitions_follow_the_input(spark, tmp_path):
    path = tmp_path / "big.bin"
    path.write_bytes(bytes(9 << 20))
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    partition_for(spark, str(path))
    assert spark.conf.get(key) == "9"
    partition_for(spark, f"{SF}/supplier.parquet")
    assert spark.conf.get(key) == spark.conf.get("spark.sql.shuffle.partitions")


def test_percentiles_sort_plain_values(spark):
    """``F.percentile`` took a map of objects per group, most of the time of the daily metrics."""
    v = F.when(F.col("id") % 7 > 0, F.col("id") * 31 % 997 / 8)
    df = spark.range(5000).select((F.col("id") % 6).alias("k"), F.when(F.col("id") % 6 > 0, v).alias("v"))
    probs = [0.0, 0.1, 0.5, 0.6827, 1.0]
    got = df.groupBy("k").agg(percentiles("v", probs).alias("got"), F.percentile("v", probs).alias("want"))
    for r in got.collect():
        assert r.got == (r.want or [None] * 5)
    assert "percentile(" not in plan(grouped_quantiles(df, ["k"], "v", [0.5], ["m"]))


def test_the_calendar_is_written_behind_the_windows(spark):
    """Every day of the calendar was joined and ordered twice, from one task that wrote it out."""
    obs = spark.sql("""select * from values (1L, timestamp_ntz'2024-01-02 06:00:00', 10d, null), (1L, timestamp_ntz'2024-01-02 18:00:00', 12d, 3d),
      (1L, timestamp_ntz'2024-01-06 06:00:00', 19d, 5d), (1L, timestamp_ntz'2024-05-01 06:00:00', 1d, 7d), (2L, timestamp_ntz'2024-01-01 00:00:00', 1d, 1d)
      as t(lake_id, datetime, wse, other)""")
    gauge = spark.sql("""select * from values (1L, timestamp_ntz'2024-01-01 12:00:00', 1d), (1L, timestamp_ntz'2024-01-05 12:00:00', 5d),
      (1L, timestamp_ntz'2024-01-07 12:00:00', 9d), (1L, timestamp_ntz'2024-04-30 12:00:00', 2d) as t(lake_id, gauge_datetime, gauge_wse)""")
    d = daily_series(obs, gauge, {"a": "wse", "b": "other"})
    nodes = [line for line in plan(d).splitlines() if "Generate" in line or "Window" in line]
    assert "Generate" in nodes[0] and "Generate" not in "".join(nodes[1:])
    got = [(str(r.date), r.a, r.b, r.daily_gauge) for r in d.where("lake_id = 1").orderBy("date").collect()]
    # readings outside the overlap do not fill it, and days strictly inside the gauge's gap are left out
    assert got == [
        ("2024-01-02", 11.0, 3.0, 5.0), ("2024-01-03", 13.0, 3.5, 5.0), ("2024-01-04", 15.0, 4.0, 5.0), ("2024-01-05", 17.0, 4.5, 5.0),
        ("2024-01-06", 19.0, 5.0, 7.0), ("2024-01-07", 19 + (1 - 19) * (1 / 116), 5 + 2 * (1 / 116), 9.0),
        ("2024-04-30", 19 + (1 - 19) * (115 / 116), 5 + 2 * (115 / 116), 2.0)]
    assert d.where("lake_id = 2").count() == 0


def test_settings_of_the_series_queries_end_with_them(spark):
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    configure(spark, series=True)
    assert spark.conf.get(name) == "8000" and spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "8m"
    configure(spark)
    assert spark.conf.get(name) == before


def test_empty_slots_are_written_behind_the_windows(spark):
    """Every slot of the grid was joined and ordered twice, from one task that wrote the grid out."""
    day = 86400.0
    rows = [(1, t * day, v) for t, v in ((0.5, 1.0), (0.75, 2.0), (4.25, 9.0), (5.0, 3.0))] + [(2, 3 * day, 5.0)]
    base = spark.createDataFrame(rows, "lake_id long, time double, wse double")
    for grid in (G.regular_grid(base), G.regular_grid(base, midnight=True)):
        nodes = [line for line in plan(grid).splitlines() if "Generate" in line or "Window" in line]
        assert "Generate" in nodes[0] and "Generate" not in "".join(nodes[1:])
    got = [(r.k, r.g / day, round(r.y, 9), r.before and r.before.t / day, r.after and r.after.t / day)
           for r in G.regular_grid(base).where("lake_id = 1").orderBy("k").collect()]
    line = lambda g: round(2 + 7 * (g - 0.75) / 3.5, 9)
    assert got == [(0, 0.5, 1.0, None, 4.25), (1, 1.5, line(1.5), 0.75, 4.25), (2, 2.5, line(2.5), 0.75, 4.25),
                   (3, 3.5, line(3.5), 0.75, 5.0), (4, 4.5, 7.0, 4.25, None)]
    mid = [(r.k, r.g / day, round(r.y, 9)) for r in G.regular_grid(base, midnight=True).orderBy("lake_id", "k").collect()]
    assert mid == [(0, 0.0, 1.0), *[(k, float(k), line(k)) for k in (1, 2, 3, 4)], (5, 5.0, 3.0), (0, 3.0, 5.0)]


def test_bands_of_a_small_grid_are_not_left_in_one_task(spark):
    """The grid's partitions were merged by their size, and all bands unpacked in one task of 1,289 MB."""
    grid = spark.range(3000).selectExpr("id % 60 as lake_id", "id div 60 as k", "49L as k_last", "cast(id as double) as g", "sin(id) as y")
    got = wavelets.denoise(grid, level=1, threshold=0.1)
    got.collect()
    assert got.rdd.getNumPartitions() >= 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def both_forms(monkeypatch, make):
    """Rows of the gathered form and of the one for series that no task may order."""
    out = []
    for limit in (groups.GATHERED_ROWS, 0):
        monkeypatch.setattr(groups, "GATHERED_ROWS", limit)
        out.append((plan(df := make()), sorted(map(str, df.collect()))))
    return out


def test_series_are_numbered_behind_one_shuffle(spark, monkeypatch):
    """Days were counted, summed and joined back, three shuffles of nearly all rows."""
    raw = cut(tables.observations(spark, SF).withColumn("lake_id", F.when(F.col("lake_id") != 3, F.col("lake_id"))))
    (one, got), (many, want) = both_forms(monkeypatch, lambda: prep.prepare(raw, tables.ARRIVAL).select(
        "lake_id", "index_col", "is_first", "time", "wse", "wse_u", "day", *[c for c in raw.columns if c.startswith("ice")]))
    assert got == want and len(got) > 4000
    assert "Join" not in one and "Join" in many


def test_nearest_reading_in_one_pass(spark, monkeypatch):
    """Slots were ordered twice and carried over a spine that was joined back."""
    left = spark.range(400).selectExpr("if(id % 40 = 7, null, id % 5) as lake_id", "id as i", "if(id % 50 = 9, null, cast(id * 7919 % 3001 as double)) as time")
    right = spark.range(90).selectExpr("id % 4 as lake_id", "cast(id * 31 % 97 * 30 as double) as gauge_time", "cast(id as double) as gauge_wse")
    near = lambda tol: asof.nearest(left, right, "lake_id", "time", "gauge_time", ["gauge_wse"], tol, 500.0)
    for tol in (20.0, float("inf")):
        (one, got), (many, want) = both_forms(monkeypatch, lambda: near(tol))
        monkeypatch.undo()
        assert got == want and "Join" not in one and "Join" in many


def test_rounds_of_the_fallback_run_on_sorted_values(spark, monkeypatch):
    """Every round wrote two tables and shuffled the values three times."""
    rng = np.random.default_rng(8)
    rows = [(i, float(v)) for i in range(12) for v in np.concatenate([rng.normal(0, 1, 30 + i), rng.normal(0, 60 * i, 2 * i), [400.0] * (i % 2)])]
    df = spark.createDataFrame(rows + [(77, 1.0), (78, None)], "lake_id long, wse double")
    run = lambda: sorted(map(str, screens.screen_interval(df, multiplier=1.0, lower_q=0.25, upper_q=0.75, iterations=4).collect()))
    writes = []
    monkeypatch.setattr(screens, "cut", lambda d: writes.append(1) or cut(d))
    got, n = run(), len(writes)
    monkeypatch.setattr("stillwater.functions.quantiles.SKETCH_ACCURACY", 100)
    assert got == run() and n == 1 and len(got) == 13


def test_ranks_of_series_that_one_task_may_order(spark, monkeypatch):
    """Both orders were dealt by ranges, written and joined back to the pairs."""
    df = spark.range(900).selectExpr("id % 4 as lake_id", "cast(id * 31 % 83 as double) as a", "if(id % 11 = 0, null, cast(id * 7 % 19 as double)) as b")
    (one, got), (many, want) = both_forms(monkeypatch, lambda: M.spearman(df, "a", "b").select("lake_id", F.round("spearman", 9)))
    assert got == want and "Join" not in one and "Join" in many


def test_only_matched_rows_are_spread_over_the_methods(spark):
    """All rows were spread, eight times by ice state, though few have a reading."""
    df = spark.sql("""select *, wse wse_adjusted, wse wse_stringent, wse wse_permissive, 1d p_ref_area from values
      (1L, 1L, 3d, 1d, 0), (1L, 2L, 5d, null, 2), (2L, 1L, 4d, null, 0) as t(lake_id, index_col, wse, gauge_corrected, ice_clim_f)""")
    df, cfg = cut(df), ValidationConfig()
    errors, by_ice = V.method_errors(df, cfg), X.error_by_ice(df, cfg)
    assert {(r.lake_id, r.n_match) for r in errors.collect()} == {(1, 1), (2, 0)} and errors.count() == 8
    assert sorted(r.n_match for r in by_ice.collect()) == [0] * 16 + [1] * 8
    for p in (plan(errors), plan(by_ice)):
        assert "isnotnull(gauge_corrected" in p[p.rindex("explode"):] or "isnotnull(gauge_corrected" in p[p.index("Generate explode(array(struct"):]


def test_the_calendar_carries_no_structs(spark):
    """Each of its days carried ten structs, and dates were counted on by an interval."""
    obs = spark.sql("select 1L lake_id, timestamp_ntz'2024-01-02 06:00:00' + make_dt_interval(cast(id as int)) datetime, cast(id as double) wse from range(5)")
    gauge = spark.sql("select 1L lake_id, timestamp_ntz'2024-01-01 12:00:00' + make_dt_interval(cast(id * 3 as int)) gauge_datetime, 2d gauge_wse from range(4)")
    d = daily_series(obs, gauge, {"a": "wse"})
    assert "struct" not in plan(d) and "interval" not in plan(d).lower().split("generate")[0] and d.count() == 5
