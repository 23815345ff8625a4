import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stillwater.config import ValidationConfig
from stillwater.functions import columns as C
from stillwater.operators import daily, metrics as M
from stillwater.plans import summaries as X, validation as V
from stillwater.schema import REQUIRED
from stillwater.sources import fixed, gauges, observations as S, sinks

rng = np.random.default_rng(5)
LINE = {"lake_id": "7", "time": "1.5", "wse": "10", "wse_u": "0.1", "wse_std": "bad", "xtrk_dist": "5", "quality_f": "0",
        "xovr_cal_q": "1.0", "ice_clim_f": "2", "cycle_id": "3", "pass_id": "4", "crid": "PIC2",
        "collection_shortname": "SWOT_L2_HR_LakeSP_D", "p_ref_area": "1", "area_total": "2"}


def csv_text(cols):
    return ",".join(cols) + "\n" + ",".join(LINE[c] for c in cols) + "\n"


def test_parse_responses(spark):
    good = json.dumps({"results": {"csv": csv_text(REQUIRED[::-1])}})
    lacking = json.dumps({"results": {"csv": csv_text(REQUIRED[1:])}})
    bodies = [(good,), ("",), (None,), ("not json",), (json.dumps({"status": 400}),), (json.dumps({"results": {"csv": " "}}),), (lacking,)]
    got = S.parse_responses(spark.createDataFrame(bodies, "body string")).collect()
    assert len(got) == 1
    r = got[0]
    assert (r.lake_id, r.time, r.xovr_cal_q, r.crid, r.wse_std, r.p_lat) == (7, 1.5, 1, "PIC2", None, None)


def test_long_response_is_cut_into_blocks(spark):
    lines = [",".join(str(i) if c == "lake_id" else LINE[c] for c in REQUIRED) for i in range(1003)]
    bodies = spark.createDataFrame([(json.dumps({"results": {"csv": "\n".join([",".join(REQUIRED), *lines[:n]])}}),) for n in (1003, 10, 11, 0)], "body string")
    for block in (10, 2000):
        got = S.parse_responses(bodies, block=block)
        assert sorted(r.lake_id for r in got.collect()) == sorted([*range(1003), *range(10), *range(11)])


def test_csv_cache_and_missing_column(spark, tmp_path):
    (tmp_path / "a.csv").write_text(csv_text(REQUIRED))
    r = S.read_observations(spark, str(tmp_path / "a.csv"), "csv").first()
    assert r.lake_id == 7 and r.xovr_cal_q == 1 and r.wse_std is None
    (tmp_path / "b.csv").write_text(csv_text(REQUIRED[:-1]))
    with pytest.raises(ValueError, match="area_total"):
        S.read_observations(spark, str(tmp_path / "b.csv"), "csv")
    with pytest.raises(ValueError):
        S.only_collection(spark.range(1), "other")


def test_gauge_readers(spark, tmp_path):
    (tmp_path / "c.csv").write_text("PLD_Lake_ID,Year,Month,Day,Hour,Minute,Second,WSE/m\n5,2024,2,29,8,0,30,12.5\n")
    china = next(s for s in gauges.SOURCES if s.name == "China")
    r = gauges.read_source(spark, str(tmp_path / "c.csv"), china).first()
    assert str(r.gauge_datetime) == "2024-02-29 08:00:30" and r.gauge_wse == 12.5
    (tmp_path / "l.csv").write_bytes("PLD_Lake_ID,gauge_datetime,gauge_wse,Name\n6,2024-01-01 00:00:00,x,Łódź\n".encode("iso-8859-2"))
    r = gauges.read_source(spark, str(tmp_path / "l.csv"), next(s for s in gauges.SOURCES if s.name == "US")).first()
    assert r.lake_id == 6 and r.gauge_wse is None
    (tmp_path / "m.csv").write_text("Reservoir Name,State,District,Date,Level\nA,S,d1,2024-01,1\nA,S,d2,2024-01,2\nA,S,d2,2024-03,3\nA,T,d9,2020-01,9\n")
    meta = spark.createDataFrame([(9, "A", "S")], "lake_id long, reservoir_name string, reservoir_state string")
    got = gauges.read_monthly(spark, str(tmp_path / "m.csv"), meta).orderBy("gauge_datetime").collect()
    assert [(str(r.gauge_datetime), r.gauge_wse) for r in got] == [("2024-01-15 12:00:00", 2.0), ("2024-03-15 12:00:00", 3.0)]
    (tmp_path / "n.csv").write_text("Reservoir_name,Date,Level\n a ,2024-01-02,4\nzz,2024-01-02,5\n")
    got = gauges.read_by_name(spark, str(tmp_path / "n.csv"), meta, gauges.SOURCES[0]).collect()
    assert [(r.lake_id, r.gauge_wse) for r in got] == [(9, 4.0)]


def test_cleaning_rules(spark):
    rules = fixed.cleaning_rules(spark)
    rows = [(4530176703, "2024-01-01 00:00:00", v) for v in (699.0, 700.0, 750.0, 751.0)]
    rows += [(2510260562, t, 240.0) for t in ("2023-07-01 00:00:00", "2023-07-02 00:00:00", "2024-03-28 00:00:00", "2025-01-01 00:00:00")]
    rows += [(1, "2024-01-01 00:00:00", -5.0), (1, "2024-01-01 00:00:00", None)]
    rows += [(2510165942, t, 1.0) for t in ("2025-01-01 00:00:00", "2025-01-01 00:00:01")]
    g = spark.createDataFrame(rows, "lake_id long, gauge_datetime string, gauge_wse double").withColumn(
        "gauge_datetime", F.col("gauge_datetime").cast("timestamp_ntz"))
    got = sorted((r.lake_id, str(r.gauge_datetime)[:19], r.gauge_wse) for r in gauges.apply_cleaning(g, rules).collect())
    assert [v for i, _, v in got if i == 4530176703] == [700.0, 750.0]
    assert [t for i, t, _ in got if i == 2510260562] == ["2023-07-01 00:00:00", "2025-01-01 00:00:00"]
    assert [t for i, t, _ in got if i == 2510165942] == ["2025-01-01 00:00:01"] and len([1 for i, *_ in got if i == 1]) == 1
    assert rules.count() == 66 and len(set(fixed.EXCLUDED_LAKES)) == 37


def test_sink_keeps_schema_when_empty(spark, tmp_path):
    cols = ("lake_id long, crid_scenario string, pass_id int, ice_condition string, wse_std_thr_cal double, wse_u_thr_cal double, "
            "xtrk_dist_thr_cal double, grouping_scheme int, pair_order long, wse_std_thr_bound double, wse_u_thr_bound double, "
            "xtrk_dist_thr_bound double, filter_attempt string")
    sinks.write_threshold_summary(spark.createDataFrame([], cols), str(tmp_path / "t"))
    assert len(spark.read.parquet(str(tmp_path / "t")).columns) == 12


def daily_reference(obs, gauge, gap):
    o = obs.groupby("date").wse.mean()
    f = obs.groupby("date").adj.mean()
    g = gauge.groupby("date").g.mean()
    full = pd.date_range(o.index.min(), o.index.max(), freq="D")
    interp = lambda s, i: s.reindex(i).interpolate(limit_direction="both").bfill().ffill()
    days = pd.date_range(max(o.index.min(), g.index.min()), min(o.index.max(), g.index.max()), freq="D")
    keep = pd.Series(True, index=days)
    for a, b in zip(g.index[:-1], g.index[1:]):
        if (b - a).days >= gap:
            keep[(days > a) & (days < b)] = False
    k = days[keep]
    return interp(o, full).reindex(k), interp(f, full).reindex(k), interp(g, k)


def test_daily_series_against_pandas(spark):
    d0 = pd.Timestamp("2023-01-01")
    od = np.sort(rng.choice(300, 60, replace=False))
    gd = np.sort(np.r_[rng.choice(100, 30, replace=False), 150 + rng.choice(190, 60, replace=False)]) - 20
    obs = pd.DataFrame({"lake_id": 1, "date": d0 + pd.to_timedelta(od, "D"), "wse": rng.normal(size=60)})
    obs["adj"] = np.where(rng.random(60) < 0.6, obs.wse, np.nan)
    gauge = pd.DataFrame({"lake_id": 1, "date": d0 + pd.to_timedelta(gd, "D"), "g": rng.normal(size=len(gd))})
    so = spark.createDataFrame(obs).withColumn("adj", F.when(~F.isnan("adj"), F.col("adj")))
    got = daily.daily_series(so, spark.createDataFrame(gauge), {"a": "wse", "b": "adj"}, "date", "date", "g", 40)
    got = got.toPandas().sort_values("date")
    a, b, g = daily_reference(obs, gauge, 40)
    assert list(pd.to_datetime(got.date)) == list(a.index)
    for mine, ref in ((got.a, a), (got.b, b), (got.daily_gauge, g)):
        assert np.allclose(mine, ref)


def test_datum_fallbacks(spark):
    rows = [
        (1, 10.0, 9.0, 0, 20.0), (1, 10.0, 8.0, 2, 30.0),  # ice-free pairs with the adjusted value
        (2, 10.0, 9.0, 2, 20.0), (2, 10.0, None, 0, 25.0),  # no ice-free pair: all adjusted pairs
        (3, 10.0, None, 0, 22.0),  # nothing adjusted: raw value
        (4, 10.0, 9.0, 2, None), (4, 11.0, None, 2, 30.0),  # adjusted never meets the gauge: raw pairs
        (5, 10.0, None, 0, None),  # no gauge at all
    ]
    df = spark.createDataFrame(rows, "lake_id long, wse double, wse_adjusted double, ice_clim_f int, gauge_wse double")
    got = {r.lake_id: r.bias for r in M.datum_offset(df).collect()}
    assert got == {1: 11.0, 2: 11.0, 3: 12.0, 4: 19.0, 5: 0.0}


def test_pair_errors_drop_zero_residuals(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0), (1, 2.0, 1.0), (1, 1.0, 4.0), (1, None, 4.0), (2, 3.0, 3.0)],
                               "lake_id long, value double, gauge_corrected double")
    got = {r.lake_id: r for r in M.pair_errors(df, ["lake_id"], ValidationConfig()).collect()}
    assert (got[1].n_match, got[1].n_used, got[1].mae, got[1].median_error) == (3, 2, 2.0, -1.0)
    assert got[2].n_used == 0 and got[2].mae is None


def test_correlation_guards(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (1, 2.0, 4.0), (1, 5.0, None), (2, 1.0, 1.0), (2, 1.0, 3.0), (3, 1.0, 1.0)],
                               "lake_id long, a double, b double")
    got = {r.lake_id: r.r for r in df.groupBy("lake_id").agg(M.pearson(F.col("a"), F.col("b")).alias("r")).collect()}
    assert abs(got[1] - 1) < 1e-12 and got[2] is None and got[3] is None


def test_ecdf_and_bins(spark):
    v = rng.normal(size=200).round(1)
    df = spark.createDataFrame([(i, "m", float(x)) for i, x in enumerate(v)] + [(500, "k", 3.0)], "lake_id long, g string, x double")
    got = X.ecdf(df, ["g"], "x").toPandas()
    m = got[got.g == "m"].sort_values("pct")
    assert np.allclose(m.x, np.sort(v)) and np.allclose(m.pct, np.arange(1, 201) / 2)
    assert got[got.g == "k"].pct.iloc[0] == 100.0
    a = spark.createDataFrame([(i, float(x)) for i, x in enumerate([0, 0.1, 0.11, 1, 10, 1e4, 1e5])], "lake_id long, lake_area double")
    assert [r.area_bin for r in X.with_area_bins(a).orderBy("lake_id").collect()] == ["<=0.1", "<=0.1", "<=1", "<=1", "<=10", "<=10000", ">10000"]
    with pytest.raises(ValueError):
        C.area_bin(F.col("lake_area"), [0, 1], ["a", "b"])


def test_reference_selection(spark):
    rows = [(1, 0.0, "1_strict", 1), (2, 0.0, "2_lenient", 1), (2, 100 * 86400.0, "2_lenient", 1), (2, 200 * 86400.0, "2_lenient", 1),
            (2, 320 * 86400.0, "2_lenient", 1), (2, 366 * 86400.0, "2_lenient", 1),
            (3, 0.0, "2_lenient", 1), (3, 121 * 86400.0, "2_lenient", 1), (3, 200 * 86400.0, "2_lenient", 0), (3, 366 * 86400.0, "2_lenient", 1),
            (4, 0.0, "3_tukey", 1)]
    df = spark.createDataFrame(rows, "lake_id long, time double, filter_attempt string, filter_flag int")
    assert {r.lake_id: r.keep_mask for r in X.reference_lakes(df).collect()} == {1: 1, 2: 1, 3: 0, 4: 0}
    strict = X.reference_lakes(df, ValidationConfig(reference_selection="strict_only"))
    assert {r.lake_id: r.keep_mask for r in strict.collect()} == {1: 1, 2: 0, 3: 0, 4: 0}


def test_every_twin_belongs_to_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 80
