import pytest
from pyspark.sql import functions as F

from stillwater.config import Bounds, FilterConfig, Grouping
from stillwater.functions import columns as C
from stillwater.operators import prep, thresholds as T
from stillwater.schema import require_columns

FILL = -999999999999.0
SCHEMA = ("lake_id long, time double, wse double, wse_u double, wse_std double, xtrk_dist double, quality_f int, "
          "xovr_cal_q int, ice_clim_f int, pass_id int, crid string, arrival int")


def row(time=0.0, wse=1.0, u=0.1, std=0.5, x=20000.0, q=0, xo=0, ice=0, p=1, crid="PIC2", arrival=0, lake=1):
    return (lake, time, wse, u, std, x, q, xo, ice, p, crid, arrival)


def prepared(spark, rows):
    return prep.prepare(spark.createDataFrame(rows, SCHEMA), ["arrival"])


def test_fill_duplicates_and_ordinals(spark):
    rows = [row(90000.0, arrival=3), row(5.0, u=FILL, arrival=2), row(5.0, wse=9.0, arrival=1), row(7.0, wse=FILL),
            row(FILL), row(float("nan")), row(200000.0, wse=float("nan")), row(300000.0, std=float("nan"))]
    got = {r.index_col: r for r in prepared(spark, rows).collect()}
    assert sorted(got) == [0, 1, 3, 5]  # unusable rows keep their ordinal
    assert got[0].wse == 9.0 and got[0].is_first and not got[1].is_first
    assert got[1].wse_u is None and got[5].wse_std is None
    assert str(got[3].datetime) == "2000-01-02 01:00:00"


def test_version_rules(spark):
    df = spark.createDataFrame([("PGC0",), ("PIC2",), ("PID0 ",), ("x",), (None,), ("PGD1",)], "crid string")
    got = [tuple(r) for r in df.select(C.version_suffix(F.col("crid")), C.is_new_version(F.col("crid"))).collect()]
    assert got == [("C0", False), ("C2", True), ("D0", False), ("unknown", False), ("unknown", False), ("D1", True)]


def test_missing_column_and_predicate_errors(spark):
    df = spark.createDataFrame([(1,)], "lake_id long")
    with pytest.raises(ValueError, match="wse"):
        require_columns(df)
    with pytest.raises(ValueError, match="invalid predicate"):
        C.where(df, "no such thing (")
    with pytest.raises(ValueError):
        Bounds(free_rules=("ice-free", "ice-free", "nope"))
    with pytest.raises(ValueError):
        FilterConfig(filter_type="savgol2")


def test_schemes_and_fallback(spark):
    # pass 1 has clean ice-free rows; pass 2 was seen in ice only and never clean
    rows = [row(0.0, std=0.5), row(86400.0, std=0.8, u=0.2), row(2 * 86400.0, p=2, ice=2, q=3), row(3 * 86400.0, p=2, ice=2, xo=2)]
    t = {(r.pass_id, r.ice_condition): r for r in T.calibrate(prepared(spark, rows)).collect()}
    assert t[1, "ice-free"].grouping_scheme == 1 and t[1, "ice-covered"].grouping_scheme == 3
    assert t[2, "ice-covered"].grouping_scheme == 2 and t[2, "both"].grouping_scheme == 2
    assert t[1, "ice-free"].wse_std_thr_cal == 0.8 and t[1, "ice-covered"].wse_std_thr_cal is None
    assert t[2, "ice-free"].wse_std_thr_cal == 0.8  # not stratified by pass
    assert t[2, "ice-free"].xtrk_dist_thr_cal is None and t[1, "both"].xtrk_dist_thr_cal == 20000.0
    # the pooled row of pass 2 borrows from the same version among pooled rows
    assert t[2, "both"].xtrk_dist_thr_cal == 20000.0
    c = {(r.pass_id, r.ice_condition): r for r in T.calibrate(prepared(spark, rows), Grouping(compat=True)).collect()}
    assert c[2, "both"].xtrk_dist_thr_cal is None


@pytest.mark.parametrize("cal,bound", [(None, 3.0), (4.5, 3.0), (-1.0, 0.0), (1.2, 1.2)])
def test_bounds(spark, cal, bound):
    df = spark.createDataFrame([(cal,)], "c double")
    assert df.select(T.bounded(F.col("c"), Bounds(), 0)).first()[0] == bound


def test_gate_override_and_missing_value(spark):
    rows = [row(0.0, std=0.5), row(1e5, std=2.9, ice=1, q=3), row(2e5, std=2.9, q=3), row(3e5, std=FILL, q=3), row(4e5, u=0.4, q=3, ice=2)]
    p = prepared(spark, rows)
    got = {r.index_col: r for r in T.with_thresholds(p, T.calibrate(p)).collect()}
    assert got[1].passes and got[1].wse_std_thr_app == 3.0 and got[1].wse_std_thr_bound == 0.5
    assert not got[2].passes and not got[3].passes and not got[4].passes
    assert got[0].xtrk_dist_thr_source == "not apply" and got[0].xtrk_dist_thr_app is None
