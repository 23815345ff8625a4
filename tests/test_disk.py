"""What goes to disk: slots of a grid, columns that nobody reads, files that nobody reads again."""

import numpy as np
from pyspark.sql import functions as F

from catalogue import queries as Q, workflow_queries
from stillwater.config import DAY, FilterConfig
from stillwater.functions import groups
from stillwater.operators import grid as G, kernels, prep, smoothers, thresholds as T
from stillwater.plans import filtering
from stillwater.session import configure, cut

rng = np.random.default_rng(11)


def executed(df):
    return df._jdf.queryExecution().sparkPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


def observations(spark, lakes=4, n=40):
    rows = [(i, k, float(t), float(rng.normal())) for i in range(lakes)
            for k, t in enumerate(np.sort(rng.choice(int(90 * DAY), n, replace=False)))]
    return spark.createDataFrame(rows, "lake_id long, index_col long, time double, wse double")


def shown(df, *cols):
    return sorted(map(str, df.select("lake_id", "index_col", *[F.round(c, 9).alias(c) for c in cols]).collect()))


def test_no_slot_is_dealt_by_its_number(spark, monkeypatch):
    """Every slot of the curve was shuffled once more to meet the few rows that read it."""
    base = observations(spark)
    rows = base.unionByName(spark.sql("select 9L lake_id, 0L index_col, 5d time, 1d wse union all select null, 1L, 5d, 1d"))
    origin, curve = smoothers.grid_curve(base, "median", window=5)
    got = G.at_times(rows, curve, origin)
    assert not [line for line in executed(got).splitlines() if "hashpartitioning(lake_id" in line and "k#" in line.split("hashpartitioning")[1].split(")")[0]]
    have = shown(got, "smooth")
    monkeypatch.setattr(groups, "GATHERED_ROWS", 0)
    spread = G.at_times(rows, curve, origin)
    assert have == shown(spread, "smooth")
    assert sum("smooth=None" in x for x in have) == 2 and len(have) == 162


def test_shuffle_files_go_with_the_execution(spark):
    """They stayed until the driver collected its garbage, those of all written intermediates together."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    configure(spark, series=True)
    assert spark.conf.get(name) == "true"
    configure(spark)
    assert spark.conf.get(name) == before


def test_hampel_meets_its_curve_as_arrays(spark):
    """Behind the grouped call all slots were shuffled to be ordered again."""
    base = observations(spark)
    origin, grid = smoothers.grid_of(base, "hampel")
    curve = smoothers.curve_on(grid, "hampel", window=7)
    assert "FlatMapGroupsInPandas" not in executed(curve) and curve.columns == ["lake_id", "k", "k_last", "g", "y", "curve"]
    for i, s in curve.toPandas().groupby("lake_id"):
        s = s.sort_values("k")
        assert s.k.tolist() == list(range(len(s))) and np.allclose(s.curve, kernels.hampel(s.y.to_numpy(), 7))


def test_wavelet_bands_need_no_rows(spark):
    """Each band was a flow of rows through eight windows and an aggregation: 423 s of 604 s of tasks."""
    origin, curve = smoothers.grid_curve(observations(spark), "wavelet")
    behind = curve._jdf.queryExecution().optimizedPlan().toString().split("Aggregate")[0]
    assert "Window" not in behind and "Sort" not in behind
    for i, s in curve.toPandas().groupby("lake_id"):
        s = s.sort_values("k")
        assert np.allclose(s.curve, kernels.wavelet_denoise(s.y.to_numpy(), "db4"))


def test_local_levels_side_by_side(monkeypatch):
    """Every step of EM went over arrays in plans of their own, and the arrays were written and dealt anew five times."""
    lines = [np.cumsum(rng.normal(size=n)) for n in (40, 1, 2, 3, 200, 199, 40, 7)] + [np.full(30, 3.0)]
    for cells in (1 << 20, 100):
        monkeypatch.setattr(kernels, "CELLS", cells)
        for got, y in zip(kernels.local_level_lines(lines, 10), lines):
            assert np.allclose(got, kernels.local_level_smooth(y, 10), rtol=1e-10, atol=1e-10)


def test_sweep_writes_no_grid_and_joins_once(spark, monkeypatch):
    """The grid was written with four structs a slot, and each of six curves was shuffled to meet the rows."""
    written = []
    monkeypatch.setattr(smoothers, "cut", lambda df: written.append(df.columns) or df)
    base = observations(spark)
    got = smoothers.sweep(base, base, "savgol")
    assert not written and got._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 4
    many = got.select("lake_id", "index_col", *[F.get("curves", F.lit(i)).alias(f"c{i}") for i in range(6)])
    for i, p in enumerate(smoothers.DEFAULT_SWEEPS["savgol"]):
        origin, curve = smoothers.grid_curve(base, "savgol", **p)
        one = G.at_times(base, curve, origin, out=f"c{i}")
        assert shown(many, f"c{i}") == shown(one, f"c{i}")
    waves = smoothers.sweep(base, base, "hampel")
    assert written == [["lake_id", "k", "k_last", "g", "y"]] and waves.filter("size(curves) = 3").count() == 160


def raw(spark):
    """Two lakes over four years, one of them with offset passes, and one of a few days."""
    return spark.sql("""select *, cast(if(month(timestamp_seconds(time + 946684800)) in (12, 1, 2), 2, 0) as int) ice_clim_f from (
      select id % 2 lake_id, cast(id div 2 * 5 as double) * 86400 + id % 7 time, 100 + sin(id / 20d) + if(id % 2 = 1, id div 2 % 3 * 4, 0) + if(id % 97 = 5, 30, 0) wse,
       if(id % 31 = 3, 0.45d, 0.1d + id % 5 / 50d) wse_u, id % 9 / 10d wse_std, 20000d + id % 11 * 3000 xtrk_dist, cast(if(id % 31 = 3, 3, 0) as int) quality_f, cast(id % 2 as int) xovr_cal_q,
       cast(id div 2 * 5 div 21 as int) cycle_id, cast(id div 2 % 3 as int) pass_id, if(id < 300, 'PIC2', 'PID0') crid, 10 + id % 13 / 2d area_total, 5d p_ref_area,
       1d p_lat, 2d p_lon, 'D' collection_shortname from range(600)
      union all select 7, cast(id as double) * 86400, 1d, 0.1d, 0.1d, 20000d, 0, 0, 1, 1, 'PIC2', 10d, 5d, 1d, 2d, 'D' from range(6))""")


def written(monkeypatch, *modules):
    """Columns of what the modules write."""
    got = []
    for m in modules:
        monkeypatch.setattr(m, "cut", lambda df: got.append(df.columns) or cut(df))
    return got


def test_gates_of_both_attempts_join_once(spark):
    """Every row was dealt twice to meet the same thresholds."""
    obs = cut(prep.distinct_times(prep.prepare(raw(spark), [])))
    thr, cfg = cut(T.calibrate(obs)), FilterConfig()
    both = filtering.flagged_rows(obs, thr, cfg)
    assert both._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    one = T.with_thresholds(obs, thr, cfg.strict.bounds, flag="ok_strict", trace=False)
    one = T.with_thresholds(one, thr, cfg.lenient.bounds, flag="ok_lenient", trace=False)
    assert [c for c in both.columns if c in one.columns] == one.columns
    pick = lambda df: sorted(map(str, df.select("lake_id", "index_col", "ok_strict", "ok_lenient").collect()))
    assert pick(both) == pick(one) and len(set(x.split("ok_")[1] for x in pick(both))) > 1


def test_a_step_leaves_no_residuals_behind(spark, monkeypatch):
    """They were written with every column of the rows and kept to the end."""
    obs = cut(prep.distinct_times(prep.prepare(raw(spark), [])))
    rows = filtering.flagged_rows(obs, cut(T.calibrate(obs)), FilterConfig()).filter("ok_strict").select(*filtering._ROW)
    rows = rows.withColumns({"attempt": F.lit(1), "round": F.lit(1), "minfrac_frozen": F.lit(False), "is_base": F.col("clean")})
    columns, gone = written(monkeypatch, filtering), []
    monkeypatch.setattr(filtering, "discard", lambda *t: gone.extend(x.columns for x in t))
    left = filtering.filter_step(cut(rows), FilterConfig())
    residuals = [c for c in columns if "residual" in c]
    assert len(residuals) == 1 and "ok_lenient" not in residuals[0] and gone == residuals
    assert 0 < left.count() < 600


def test_workflow_deletes_what_it_has_read(spark, monkeypatch):
    """All prepared columns went through every join of the labels, and no table was deleted before the end."""
    t = Q.Tables(spark, "none")
    t._memo["p"] = prep.prepare(raw(spark), [])
    want = filtering.run_filter(cut(t.p))["observations"]
    columns, gone = written(monkeypatch, workflow_queries, filtering), []
    for m in (workflow_queries, filtering):
        monkeypatch.setattr(m, "discard", lambda *tables: gone.extend(sorted(x.columns) for x in tables))
    rows = workflow_queries._labelled(t)
    assert "p_lat" not in {c for some in columns for c in some} and "datetime" not in columns[-1]
    assert sorted(workflow_queries._READ) in gone and ["index_col", "lake_id", "wse", "wse_adjusted"] in gone and len(gone) == 8 and all(c in gone for c in map(sorted, columns[:1]))
    pick = lambda df: sorted(map(str, df.select(*rows.columns).collect()))
    assert pick(rows) == pick(want) and {r[0] for r in rows.select("filter_attempt").distinct().collect()} >= {"1_strict"}
