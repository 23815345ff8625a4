"""Registered queries: every operator over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from stillwater.config import Bounds, DAY, FilterConfig, Grouping, LENIENT, STRICT, ValidationConfig
from stillwater.functions import columns as C
from stillwater.functions.quantiles import grouped_quantiles
from stillwater.operators import asof, cycles, daily, grid as G, metrics as M, prep, screens, smoothers
from stillwater.operators import thresholds as T
from stillwater.plans import filtering, summaries as X, validation as V
from stillwater.session import configure, cut, discard, partition_for
from stillwater.sources import gauges as SG, tables
from stillwater.sources.fixed import CYCLE_START
from catalogue import duck
from catalogue.duck import METH, r6, sql

KEY = "lake_id"
VCFG = ValidationConfig()
QUERIES: dict = {}
ORACLE: dict = {}


def r(c) -> F.Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6) + F.lit(0.0)


def rounded(df: DataFrame, plain: list[str], values: list[str]) -> DataFrame:
    return df.select(*plain, *[r(v).alias(v) for v in values])


def register(oracle: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark, series=True)
            partition_for(spark, f"{sf_dir}/lineitem.parquet", f"{sf_dir}/orders.parquet")
            return fn(Tables(spark, sf_dir))

        run.__name__ = fn.__name__
        QUERIES[fn.__name__] = run
        if oracle is not None:
            ORACLE[fn.__name__] = oracle
        return fn

    return deco


# What the scores and their tables read of the labelled rows.
_SCORED = [KEY, "index_col", "time", "wse", "wse_adjusted", "ice_clim_f", "quality_f", "xovr_cal_q", "crid", "p_ref_area"]
# What gates and curves read of the prepared rows.
_CORE = [KEY, "index_col", "time", "wse", "wse_u", "wse_std", "xtrk_dist", "area_total", "pass_id", "crid", "crid_scenario",
         "ice_clim_f", "ice_condition", "quality_f", "xovr_cal_q", "is_first"]
# What labels, scores and statistics read of the prepared rows.
_SLIM = [c for c in _SCORED if c != "wse_adjusted"] + ["datetime", "is_first"]


class Tables:
    """Lazily built inputs of one query."""

    def __init__(self, spark, sf_dir):
        self.spark, self.dir = spark, sf_dir
        self._memo = {}

    def _once(self, name, make):
        if name not in self._memo:
            self._memo[name] = make()
        return self._memo[name]

    def _freed(self, name, df):
        """``df``, which has been written, without the table it was written from."""
        if name in self._memo:
            discard(self._memo.pop(name))
        return df

    @property
    def raw(self):
        return self._once("raw", lambda: tables.observations(self.spark, self.dir))

    @property
    def p(self):
        return self._once("p", lambda: prep.prepare(self.raw, tables.ARRIVAL))

    @property
    def stored(self):
        """The prepared table, written once for queries that read it repeatedly."""
        return self._once("stored", lambda: cut(self.p))

    @property
    def matchable(self):
        """What the nearest reading is searched for, without what a query does not return."""
        return self._once("matchable", lambda: cut(self.p.select(KEY, "index_col", "time")))

    @property
    def u(self):
        return self._once("u", lambda: prep.distinct_times(self.stored))

    @property
    def core(self):
        """Rows of distinct times with the columns of gates and curves alone, unless all are written already."""
        if "stored" in self._memo:
            return self.u
        return self._once("core", lambda: cut(prep.distinct_times(self.p).select(*_CORE)))

    @property
    def thr(self):
        return self._once("thr", lambda: cut(T.calibrate(self.core)))

    @property
    def gauge(self):
        return self._once("gauge", lambda: cut(tables.gauges(self.spark, self.dir)))

    @property
    def registry(self):
        return self._once("registry", lambda: tables.registry(self.spark, self.dir))

    @property
    def tolerance(self):
        su = tables.table(self.spark, self.dir, "supplier")
        return su.select(
            F.col("s_suppkey").alias(KEY),
            F.when(F.col("s_nationkey").isin(8, 9), 16 * DAY).otherwise(DAY).alias("tolerance"),
        )

    @property
    def baseline(self):
        """Rows the strict attempt fits its curve to."""
        def make():
            rows = T.apply_thresholds(self.core, self.thr).filter(C.baseline_hygiene())
            return self._freed("core", cut(rows.select(KEY, "index_col", "time", "wse")))

        return self._once("baseline", make)

    @property
    def labelled(self):
        """All rows labelled by the Tukey fallback (no cycle correction)."""
        return self._once("labelled", lambda: cut(_labelled(self.stored)))

    @property
    def slim(self):
        """The labelled table with the columns of scores and statistics alone, unless all are written already."""
        def make():
            return _labelled(cut(self.p.select(*_SLIM)))

        return self._memo["labelled"] if "labelled" in self._memo else self._once("slim", make)

    @property
    def scored(self):
        return self._once("scored", lambda: cut(V.scored_rows(self.slim.select(*_SCORED), self.gauge, self.tolerance)))

    @property
    def stats(self):
        return self._once(
            "stats", lambda: cut(V.lake_stats(self.slim.transform(cut), self.gauge, self.registry, self.tolerance, VCFG)))


def _labelled(rows):
    """The fallback keeps an interval of values per series, so its rows are told by it without a join of rows."""
    _, iv = screens.tukey_interval(prep.distinct_times(rows))
    out = rows.join(iv.select(KEY, "lo", "hi"), KEY, "left")
    kept = C.lit_false(F.col("is_first") & C.tukey_baseline() & F.col("wse").between(F.col("lo"), F.col("hi")))
    return (
        out.withColumn("wse_adjusted", F.when(kept, F.col("wse"))).withColumn("filter_flag", kept.cast("int"))
        .withColumn("filter_attempt", F.when(F.col("lo").isNotNull(), "3_tukey").otherwise("4_none"))
        .withColumn("n_while", F.lit(0)).withColumn("n_while_r2", F.lit(-2))
        .withColumn("intra_cycle_flag", F.lit(0)).drop("lo", "hi")
    )


# ------------------------------------------------------------ preparation
_PREP = ["lake_id", "index_col", "wse_u", "wse_std", "xtrk_dist", "crid_scenario", "ice_condition", "is_first"]


@register(sql("p", body=f"select lake_id, index_col, {r6('time')} as time, {r6('wse')} as wse, wse_u, wse_std, xtrk_dist,"
              " crid_scenario, ice_condition, is_first, cast(date as varchar) as day from p"))
def prep_obs(t):
    return t.p.select(*_PREP, r("time").alias("time"), r("wse").alias("wse"), F.to_date("datetime").cast("string").alias("day"))


@register(sql("u", body=f"select lake_id, index_col, {r6('time')} as time from u"))
def dedupe_time(t):
    return t.u.select(KEY, "index_col", r("time").alias("time"))


@register(sql("p", body="select crid, crid_scenario, is_new, count(*) as n from p group by all"))
def version_suffix(t):
    return t.p.groupBy("crid", "crid_scenario", C.is_new_version(F.col("crid")).alias("is_new")).agg(F.count("*").alias("n"))


@register(sql("p", body="""select lake_id,
 count(*) filter (where (quality_f = 1 and not is_new) or (quality_f = 3 and is_new)) as n_bad,
 count(*) filter (where quality_f = 2 and is_new) as n_degraded, count(*) filter (where quality_f = 1 and is_new) as n_suspect,
 count(*) filter (where xovr_cal_q = 2) as n_xovr_bad, count(*) filter (where xovr_cal_q = 1) as n_xovr_suspect,
 count(*) filter (where ice_clim_f = 2) as n_ice_full, count(*) filter (where ice_clim_f = 1) as n_ice_partial,
 count(*) filter (where abs(xtrk_dist) < 10000 or abs(xtrk_dist) > 60000) as n_outside from p group by 1"""))
def quality_classes(t):
    q = C.quality_labels(t.p)
    n = lambda c, v: F.count(F.when(F.col(c) == v, 1))
    return q.groupBy(KEY).agg(
        n("quality_class", "bad").alias("n_bad"), n("quality_class", "degraded").alias("n_degraded"),
        n("quality_class", "suspect").alias("n_suspect"), n("xovr_class", "bad").alias("n_xovr_bad"),
        n("xovr_class", "suspect").alias("n_xovr_suspect"), n("ice_class", "full").alias("n_ice_full"),
        n("ice_class", "partial").alias("n_ice_partial"), F.count(F.when(F.col("xtrk_outside"), 1)).alias("n_outside"),
    )


@register(sql("p", body=f"""select lake_id, index_col, {r6("case when is_stringent then wse end")} as wse_stringent,
 {r6("case when is_permissive then wse end")} as wse_permissive from p"""))
def benchmark_masks(t):
    return rounded(C.benchmark_columns(t.p), [KEY, "index_col"], ["wse_stringent", "wse_permissive"])


@register(sql("p", body="select lake_id, count(*) as n from p where ice_clim_f = 2 and wse_std > 0.5 group by 1"))
def user_predicate(t):
    return C.where(t.p, "ice_clim_f = 2 and wse_std > 0.5").groupBy(KEY).agg(F.count("*").alias("n"))


@register(sql("p", body=f"""select lake_id, {r6('p_lat')} as p_lat, {r6('pmod')} as p_lon, {r6('p_ref_area')} as p_ref_area
 from (select distinct lake_id, p_lat, p_ref_area, (p_lon + 180e0) - 360e0 * floor((p_lon + 180e0) / 360e0) - 180e0 as pmod from p)"""))
def lake_dimension(t):
    return rounded(X.lake_dimension(t.p), [KEY], ["p_lat", "p_lon", "p_ref_area"])


# ------------------------------------------------------------- thresholds
_CAL = ["wse_std_thr_cal", "wse_u_thr_cal", "xtrk_dist_thr_cal"]
_CALROW = ["lake_id", "crid_scenario", "pass_id", "ice_condition", "grouping_scheme"]
_CALSQL = ", ".join(_CALROW) + ", " + ", ".join(f"{r6(c)} as {c}" for c in _CAL)


def _cal_oracle(*args, **kw):
    return sql("u", body=f"select {_CALSQL} from ({duck.calibrate(*args, **kw)})")


@register(_cal_oracle())
def calibrate_default(t):
    return rounded(t.thr, _CALROW, _CAL)


@register(_cal_oracle((0, 0, 0), (1, 1, 1), (1, 1, 1)))
def calibrate_by_pass(t):
    return rounded(T.calibrate(t.u, Grouping((False,) * 3, (True,) * 3, (True,) * 3)), _CALROW, _CAL)


@register(_cal_oracle((1, 1, 1), (1, 0, 1), (1, 1, 0)))
def calibrate_by_version(t):
    g = Grouping((True,) * 3, (True, False, True), (True, True, False))
    return rounded(T.calibrate(t.u, g), _CALROW, _CAL)


@register(_cal_oracle((0, 0, 0), (0, 0, 0), (0, 0, 0)))
def calibrate_global(t):
    return rounded(T.calibrate(t.u, Grouping((False,) * 3, (False,) * 3, (False,) * 3)), _CALROW, _CAL)


@register(_cal_oracle((1, 1, 1), (1, 1, 1), (1, 1, 1), compat=True))
def calibrate_compat(t):
    return rounded(T.calibrate(t.u, Grouping((True,) * 3, (True,) * 3, (True,) * 3, compat=True)), _CALROW, _CAL)


@register(sql("thr", body="select lake_id, ice_condition, grouping_scheme, count(*) as n from thr group by all"))
def grouping_scheme(t):
    return t.thr.groupBy(KEY, "ice_condition", "grouping_scheme").agg(F.count("*").alias("n"))


@register(sql("ok", body=f"select lake_id, index_col, {r6('wse')} as wse from ok where passes"))
def apply_thresholds_strict(t):
    return rounded(T.apply_thresholds(t.u, t.thr), [KEY, "index_col"], ["wse"])


@register(sql("okl", body=f"select lake_id, index_col, {r6('wse')} as wse from okl where passes"))
def apply_thresholds_lenient(t):
    return rounded(T.apply_thresholds(t.u, t.thr, LENIENT.bounds), [KEY, "index_col"], ["wse"])


_XF, _XC = ("both", "ice-free", "ice-free"), ("ice-covered", "not apply", "both")


@register(sql("u", "thr", body=f"select lake_id, index_col from ({duck.gated(duck.STRICT, _XF, _XC)}) where passes"))
def apply_xtrk_rule(t):
    return T.apply_thresholds(t.u, t.thr, Bounds(free_rules=_XF, ice_rules=_XC)).select(KEY, "index_col")


_TRACE = [c for c in T.trace_columns() if not c.endswith("_source")]
_SOURCE = [c for c in T.trace_columns() if c.endswith("_source")]


@register(sql("u", "thr", body=f"select lake_id, index_col, passes, {', '.join(_SOURCE)}, "
              + ", ".join(f"{r6(c)} as {c}" for c in _TRACE) + f" from ({duck.gated(duck.STRICT, _XF, _XC)})"))
def threshold_trace(t):
    return rounded(T.with_thresholds(t.u, t.thr, Bounds(free_rules=_XF, ice_rules=_XC)),
                   [KEY, "index_col", "passes", *_SOURCE], _TRACE)


@register(sql("ok", body=f"""select {_CALSQL}, {', '.join(f"{r6('b.' + c)} as {c}" for c in ('wse_std_thr_bound', 'wse_u_thr_bound', 'xtrk_dist_thr_bound'))}
 from thr left join (select lake_id, crid_scenario, pass_id, 'ice-free' as ice_condition, max(wse_std_thr_bound) as wse_std_thr_bound,
  max(wse_u_thr_bound) as wse_u_thr_bound, max(xtrk_dist_thr_bound) as xtrk_dist_thr_bound from ok group by 1, 2, 3) b
 using (lake_id, crid_scenario, pass_id, ice_condition)"""))
def threshold_summary(t):
    return rounded(T.threshold_summary(t.u, t.thr), _CALROW,
                   _CAL + ["wse_std_thr_bound", "wse_u_thr_bound", "xtrk_dist_thr_bound"])


# ---------------------------------------------------------------- screens
@register(sql("u", body=f"""select lake_id, index_col, {r6('lo')} as lower_bound, {r6('hi')} as upper_bound from (
 select u.*, ql - 3e0 * (qh - ql) as lo, qh + 3e0 * (qh - ql) as hi from u join (select lake_id, quantile_cont(wse, 0.25) ql,
 quantile_cont(wse, 0.75) qh from u group by 1) q using (lake_id)) where wse >= lo and wse <= hi"""))
def tukey_once(t):
    return rounded(screens.remove_tukey(t.u), [KEY, "index_col"], ["lower_bound", "upper_bound"])


@register(sql("u", body=f"""select lake_id, index_col, {r6('m')} as series_median from u join (select lake_id,
 quantile_cont(wse, 0.5) m from u group by 1) q using (lake_id) where abs(wse - m) <= 10"""))
def median_distance(t):
    return rounded(screens.near_median(t.u, max_distance=10.0), [KEY, "index_col"], ["series_median"])


@register(sql("w5", body=f"select lake_id, index_col, {r6('wse')} as wse, n_steps from w5"))
def tukey_fallback(t):
    out = screens.tukey_fallback(t.u)
    return out.select(KEY, "index_col", r("wse").alias("wse"), "n_steps")


def _ice_sql(by_pass, by_version, m, lo, hi, used, filt):
    aggs = ", ".join(f"count({c}) as n_{c}, quantile_cont({c}, {lo}) as ql_{c}, quantile_cont({c}, {hi}) as qh_{c}" for c in ("area_total", "wse"))
    levels = [("a", "lake_id")] + ([("pp", "lake_id, pass_id")] if by_pass else []) + ([("vv", "lake_id, crid_scenario")] if by_version else [])
    if by_pass and by_version:
        levels.append(("pv", "lake_id, pass_id, crid_scenario"))
    ctes = "".join(f", {n} as (select {k}, {aggs} from u where ice_clim_f <= 1 group by {k})" for n, k in levels)
    joins = " ".join(f"left join {n} using ({k})" for n, k in levels)

    def ref(c):
        if by_pass and by_version:
            return (f"case when pp.n_wse is not null and vv.n_wse is not null then (case when pv.n_wse is not null then pv.{c} else a.{c} end) "
                    f"when pp.n_wse is not null then pp.{c} when vv.n_wse is not null then vv.{c} else a.{c} end")
        if by_pass or by_version:
            n = "pp" if by_pass else "vv"
            return f"case when {n}.n_wse is not null then {n}.{c} else a.{c} end"
        return f"a.{c}"

    cols = ", ".join(f"{ref(f'{q}_{c}')} as {q}_{c}" for q in ("n", "ql", "qh") for c in ("area_total", "wse"))
    tests = []
    for c in {"area": ["area_total"], "wse": ["wse"], "both": ["area_total", "wse"]}[filt]:
        up, down = f"{c} <= qh_{c} + {m} * (qh_{c} - ql_{c})", f"{c} >= ql_{c} - {m} * (qh_{c} - ql_{c})"
        cond = {"upper": up, "lower": down, "both": f"({up} and {down})"}[used]
        tests.append(f"({c} is null or n_{c} < 2 or {cond})")
    return sql("u", body=f"""select lake_id, index_col from (with zz as (select 1 x){ctes} select u.lake_id, u.index_col, u.ice_clim_f,
  u.wse, u.area_total, a.n_wse is null as no_free, {cols} from u {joins}) where no_free or ice_clim_f <= 1 or
  (ice_clim_f > 1 and ((n_area_total < 2 and n_wse < 2) or ({' and '.join(tests)})))""")


@register(_ice_sql(True, True, "2e-1", 0.25, 0.75, "both", "both"))
def ice_screen_pass_version(t):
    return screens.screen_ice(t.u, True, True, 0.2, 0.25, 0.75, "both", "both").select(KEY, "index_col")


@register(_ice_sql(True, False, "3e-1", 0, 1, "upper", "both"))
def ice_screen_pass(t):
    return screens.screen_ice(t.u, True, False, 0.3, 0, 1, "upper", "both").select(KEY, "index_col")


@register(_ice_sql(False, False, "2e-1", 0.1, 0.9, "upper", "wse"))
def ice_screen_all(t):
    return screens.screen_ice(t.u, False, False, 0.2, 0.1, 0.9, "upper", "wse").select(KEY, "index_col")


@register(sql("u", "bs", body="""select lake_id, index_col from (select a.*, b.time as nt from (select u.lake_id, u.index_col, u.time,
 b.time as pt from u asof left join bs b on u.lake_id = b.lake_id and u.time >= b.time) a asof left join bs b
 on a.lake_id = b.lake_id and a.time <= b.time) where not coalesce(nt - pt > 20 * 8.64e4 and time > pt and time < nt, false)"""))
def gap_drop(t):
    return screens.drop_in_gaps(t.u, t.baseline, 20).select(KEY, "index_col")


_COV = """select lake_id, count(*) as n_rows, min(time) as t_first, max(time) as t_last, max(gap) as max_gap,
 quantile_cont(gap, 0.5) as median_gap from (select lake_id, time, time - lag(time) over (partition by lake_id order by time) as gap from {src}) group by 1"""


@register(sql("bs", body=f"""select lake_id, n_rows, {r6('max_gap / 8.64e4')} as max_gap_days,
 n_rows >= 365 / 9e1 + 1 and not coalesce(max_gap > 90 * 8.64e4, false) and t_last - t_first >= 365 * 8.64e4 as strict_ok,
 n_rows >= 365 / 9e1 + 1 as lenient_ok from ({_COV.format(src='bs')})"""))
def support_check(t):
    cov = asof.coverage(t.baseline, [KEY], "time")
    return cov.select(
        KEY, "n_rows", r(F.col("max_gap") / DAY).alias("max_gap_days"),
        screens.supported(cov, STRICT).alias("strict_ok"), screens.supported(cov, LENIENT).alias("lenient_ok"),
    )


@register(sql("u", body=f"""select lake_id, {r6('max_gap')} as max_gap, {r6('median_gap')} as median_gap from ({_COV.format(src='u')})"""))
def gap_stats(t):
    g = asof.series_gaps(t.u, KEY, "time")
    q = grouped_quantiles(g, [KEY], "gap_seconds", [0.5], ["median_gap"], [F.max("gap_seconds").alias("max_gap")])
    return rounded(q, [KEY], ["max_gap", "median_gap"])


# ------------------------------------------------------------------ joins
@register(sql("near", body=f"""select lake_id, index_col, {r6('case when abs(gt - time) <= 86400 then gt end')} as gauge_time,
 {r6('case when abs(gt - time) <= 86400 then gw end')} as gauge_wse from near"""))
def gauge_nearest_24h(t):
    return rounded(V.match_gauges(t.matchable, t.gauge, DAY), [KEY, "index_col"], ["gauge_time", "gauge_wse"])


@register(sql("matched", body=f"select lake_id, index_col, {r6('gauge_time')} as gauge_time, {r6('gauge_wse')} as gauge_wse from matched"))
def gauge_nearest_by_source(t):
    return rounded(V.match_gauges(t.matchable, t.gauge, t.tolerance), [KEY, "index_col"], ["gauge_time", "gauge_wse"])


@register(sql("u", "bs", body=f"""select a.lake_id, a.index_col, {r6('pt')} as prev_time, {r6('b.time')} as next_time from (
 select u.lake_id, u.index_col, u.time, b.time as pt from u asof left join bs b on u.lake_id = b.lake_id and u.time >= b.time) a
 asof left join bs b on a.lake_id = b.lake_id and a.time <= b.time"""))
def asof_prev_next(t):
    left = t.u.select(KEY, "index_col", "time")
    b = t.baseline.select(KEY, F.col("time").alias("base_time"))
    j = asof.prev_next(left, b, KEY, "time", "base_time", [])
    return j.select(KEY, "index_col", r("prev.t").alias("prev_time"), r("next.t").alias("next_time"))


@register("""with listed as (select c_custkey % (select count(*) from supplier) as lake_id, 'customer_' || c_nationkey as gauge_source,
  100 + c_nationkey as priority from customer union all select s_suppkey, 'nation_' || s_nationkey, s_nationkey from supplier where s_acctbal > 0)
 select lake_id, arg_min(gauge_source, priority) as gauge_source from listed group by 1""")
def gauge_registry(t):
    n = tables.table(t.spark, t.dir, "supplier")
    k = n.agg(F.count("*").alias("n"))  # one row
    cu = tables.table(t.spark, t.dir, "customer").join(F.broadcast(k)).select(
        F.expr("c_custkey % n").alias(KEY), F.concat(F.lit("customer_"), F.col("c_nationkey").cast("string")).alias("gauge_source"),
        (F.col("c_nationkey") + 100).alias("priority"))
    own = t.registry.join(n.filter("s_acctbal > 0").select(F.col("s_suppkey").alias(KEY)), KEY, "left_semi")
    # copies of a (lake, source) pair collapse before the ranking
    listed = cu.unionByName(own).groupBy(KEY, "gauge_source").agg(F.min("priority").alias("priority"))
    return SG.preferred_source(listed).select(KEY, "gauge_source")


_RULES = """select s_suppkey as lake_id,
 case when s_nationkey between 5 and 9 then timestamp '1996-01-01' end as t_from,
 case when s_nationkey between 5 and 9 then timestamp '1999-01-01 12:00:00' end as t_to,
 case when s_nationkey < 10 then 252e0 end as v_lt, case when s_nationkey < 20 then 5e2 end as v_gt from supplier where s_nationkey < 23"""


@register(sql("gauge", body=f"""select lake_id, {r6('gauge_time')} as gauge_time, {r6('gauge_wse')} as gauge_wse from gauge g where not exists (
 select 1 from ({_RULES}) q where q.lake_id = g.lake_id
 and (t_from is null or g.gauge_time > epoch(t_from) - 946684800) and (t_to is null or g.gauge_time <= epoch(t_to) - 946684800)
 and (coalesce(gauge_wse < v_lt, false) or coalesce(gauge_wse > v_gt, false) or (v_lt is null and v_gt is null)))"""))
def gauge_clean_rules(t):
    su = tables.table(t.spark, t.dir, "supplier").filter("s_nationkey < 23")
    inside = F.col("s_nationkey").between(5, 9)
    rules = su.select(
        F.col("s_suppkey").alias(KEY),
        F.when(inside, F.expr("timestamp_ntz'1996-01-01'")).alias("t_from"), F.lit(True).alias("t_from_open"),
        F.when(inside, F.expr("timestamp_ntz'1999-01-01 12:00:00'")).alias("t_to"), F.lit(False).alias("t_to_open"),
        F.when(F.col("s_nationkey") < 10, 252.0).alias("v_lt"), F.when(F.col("s_nationkey") < 20, 500.0).alias("v_gt"),
    )
    g = t.gauge.withColumn("gauge_datetime", C.seconds_to_timestamp(F.col("gauge_time")))
    return rounded(SG.apply_cleaning(g, rules), [KEY], ["gauge_time", "gauge_wse"])


@register("""select s_suppkey as lake_id from supplier where s_suppkey not in (select s_suppkey from supplier where s_acctbal < 0)""")
def exclusion_list(t):
    bad = tables.table(t.spark, t.dir, "supplier").filter("s_acctbal < 0").select(F.col("s_suppkey").alias(KEY))
    return prep.exclude(t.registry, bad).select(KEY)


@register("""with s as (select o_custkey, o_orderpriority, max(cast(o_orderdate as date)) - min(cast(o_orderdate as date)) as span
 from orders group by 1, 2), b as (select o_custkey, o_orderpriority, row_number() over (partition by o_custkey order by span desc, o_orderpriority) as r from s)
 select o_custkey as lake_id, o_orderpriority as district, o_orderkey from orders join b using (o_custkey, o_orderpriority) where r = 1""")
def longest_sub_gauge(t):
    o = tables.table(t.spark, t.dir, "orders").select(
        F.col("o_custkey").alias(KEY), F.col("o_orderpriority").alias("district"), "o_orderkey",
        F.col("o_orderdate").cast("timestamp_ntz").alias("gauge_datetime"))
    return SG.longest_district(o, district="district").select(KEY, "district", "o_orderkey")


# ----------------------------------------------------------------- cycles
_CYC = "select lake_id, cycle_id, avg(wse) as m, stddev_samp(wse) as s, quantile_cont(time, 0.5) as mid from u group by 1, 2"
_GATE = f"""select lake_id, quantile_cont(s, 0.5) as intra_std, stddev_samp(m) as inter_std,
 coalesce(quantile_cont(s, 0.5) > stddev_samp(m), false) as apply from ({_CYC}) group by 1"""
_BIAS = """select d.*, wse - b as adj from (select *, wse - avg(wse) over (partition by lake_id) as dep from u) d join (
 select lake_id, pass_id, quantile_cont(dep, 0.5) as b from (select *, wse - avg(wse) over (partition by lake_id) as dep from u) group by 1, 2) q
 using (lake_id, pass_id)"""


@register(sql("u", body=f"select lake_id, cycle_id, {r6('m')} as wse_cycle_avg, {r6('mid')} as mid_time from ({_CYC})"))
def cycle_mean(t):
    return rounded(cycles.cycle_means(t.u), [KEY, "cycle_id"], ["wse_cycle_avg", "mid_time"])


@register(sql("u", body=f"select lake_id, {r6('intra_std')} as intra_std, {r6('inter_std')} as inter_std, apply from ({_GATE})"))
def cycle_gate(t):
    return cycles.cycle_gate(t.u).select(KEY, r("intra_std").alias("intra_std"), r("inter_std").alias("inter_std"), "apply")


@register(sql("u", body=f"""select lake_id, pass_id, {r6('a')} as median_area from (select *, row_number() over (partition by lake_id
 order by a desc nulls last, pass_id) as rr from (select lake_id, pass_id, quantile_cont(area_total, 0.5) as a from u group by 1, 2)) where rr = 1"""))
def best_pass(t):
    return rounded(cycles.best_pass(t.u), [KEY, "pass_id"], ["median_area"])


_ADJUST = f"""with g as ({_GATE}), b as ({_BIAS}), on_ as (select b.* from b join g using (lake_id) where apply),
 q as (select lake_id, quantile_cont(adj, 0.1) lo, quantile_cont(adj, 0.9) hi from on_ group by 1)
 select lake_id, index_col, wse, adj as wse_adjusted from on_ join q using (lake_id) where adj >= lo - 3 * (hi - lo) and adj <= hi + 3 * (hi - lo)
 union all select lake_id, index_col, wse, wse from u join g using (lake_id) where not apply"""


@register(sql("u", body=f"select lake_id, index_col, {r6('wse_adjusted')} as wse_adjusted from ({_ADJUST})"))
def pass_bias_adjust(t):
    return rounded(cycles.adjust_cycles(t.u)[2], [KEY, "index_col"], ["wse_adjusted"])


@register(sql("u", body=f"""select lake_id, index_col, {r6('wse')} as wse_adjusted from u join ({_GATE}) g using (lake_id)
 left join (select lake_id, arg_min(pass_id, (-a, pass_id)) as bp from (select lake_id, pass_id, quantile_cont(area_total, 0.5) as a from u group by 1, 2)
 group by 1) b using (lake_id) where not apply or pass_id = bp"""))
def best_pass_rows(t):
    return rounded(cycles.adjust_cycles(t.u)[1], [KEY, "index_col"], ["wse_adjusted"])


# ------------------------------------------------------ grids and smoothers
def _grid_cols(name):
    return f"select lake_id, k, {r6('g')} as g, {r6('y')} as y from {name}"


@register(sql("grid", body=_grid_cols("grid")))
def daily_grid(t):
    return rounded(G.regular_grid(t.baseline), [KEY, "k"], ["g", "y"])


_CURVE = f"select lake_id, k, {r6('curve')} as curve from "


@register(sql("sg", body=_CURVE + "sg"))
def savgol_daily(t):
    return rounded(smoothers.savgol(G.regular_grid(t.baseline)), [KEY, "k"], ["curve"])


@register(sql("med", body=_CURVE + "med"))
def median_daily(t):
    return rounded(smoothers.running_median(G.regular_grid(t.baseline)), [KEY, "k"], ["curve"])


_PCHIP = """with a as (select lake_id, time as x, wse as y, lead(time) over w - time as h, (lead(wse) over w - wse) / (lead(time) over w - time) as d,
  count(*) over (partition by lake_id) as n, row_number() over w as i from bs window w as (partition by lake_id order by time)),
 b as (select *, lag(h) over w as hp, lag(d) over w as dp, lag(h, 2) over w as hpp, lag(d, 2) over w as dpp, lead(h) over w as hn, lead(d) over w as dn
  from a window w as (partition by lake_id order by x)),
 e as (select *, case when i = 1 then h when i = n then hp end as e0, case when i = 1 then hn when i = n then hpp end as e1,
  case when i = 1 then d when i = n then dp end as f0, case when i = 1 then dn when i = n then dpp end as f1 from b),
 s as (select lake_id, x, y, case when n = 1 then 0 when n = 2 then f0
  when i = 1 or i = n then (case when sign(v) <> sign(f0) then 0 when sign(f0) <> sign(f1) and abs(v) > abs(3 * f0) then 3 * f0 else v end)
  when dp * d <= 0 then 0 else (3 * h + 3 * hp) / ((2 * h + hp) / dp + (h + 2 * hp) / d) end as s
  from (select *, ((2 * e0 + e1) * f0 - e0 * f1) / (e0 + e1) as v from e)),
 gr as (select grid.lake_id, k, g, x as x0, s.y as y0, s as s0 from grid asof join s on grid.lake_id = s.lake_id and grid.g >= s.x),
 g2 as (select gr.*, s.x as x1, s.y as y1, s.s as s1 from gr asof left join s on gr.lake_id = s.lake_id and gr.g <= s.x)
 select lake_id, k, case when x1 = g then y1 else (1 + 2 * u) * (1 - u) * (1 - u) * y0 + u * (1 - u) * (1 - u) * (x1 - x0) * s0
  + u * u * (3 - 2 * u) * y1 + u * u * (u - 1) * (x1 - x0) * s1 end as y
 from (select *, case when x1 > x0 then (g - x0) / (x1 - x0) end as u from g2)"""


@register(sql("bs", "grid", body=f"select lake_id, k, {r6('y')} as y from ({_PCHIP})"))
def pchip_daily(t):
    return rounded(G.pchip_grid(t.baseline), [KEY, "k"], ["y"])


_RESID = """select u.lake_id, u.index_col, u.time, u.wse, u.area_total, u.pass_id, u.ice_clim_f, hi - lo as rng, coalesce((nx.curve - c.curve)
 * ((u.time - c.g) / 8.64e4) + c.curve, c.curve) - u.wse as resid
 from (select * from ok where passes) u join (select lake_id, min(time) t0, max(time) t1, min(wse) lo, max(wse) hi from bs group by 1) o
 on u.lake_id = o.lake_id and u.time between t0 and t1
 asof join sg c on u.lake_id = c.lake_id and u.time >= c.g left join sg nx on nx.lake_id = c.lake_id and nx.k = c.k + 1"""
CLIP = f"""select * from (select *, avg(resid) over (partition by lake_id) as m, stddev_pop(resid) over (partition by lake_id) as s
 from ({_RESID})) where abs(resid - m) < 2.576 * s or abs(resid) < 7e-2 * rng"""


def _residual_rows(t):
    ok = T.apply_thresholds(t.core, t.thr).withColumn("clean", C.baseline_hygiene())
    ok = t._freed("core", cut(ok.select(KEY, "index_col", "time", "wse", "clean")))  # curve, ends and rows read it
    base = ok.filter("clean")
    ends = base.groupBy(KEY).agg(F.min("time").alias("t0b"), F.max("time").alias("t1b"), (F.max("wse") - F.min("wse")).alias("rng"))
    origin, curve = smoothers.grid_curve(base, "savgol")
    rows = ok.join(ends, KEY).filter(F.col("time").between(F.col("t0b"), F.col("t1b")))
    rows = G.at_times(rows, curve, origin).withColumn("residual", F.col("smooth") - F.col("wse"))
    return cut(rows.select(KEY, "index_col", "rng", "residual"))  # the clip reads it twice


@register(sql("ok", "sg", "bs", body=f"select lake_id, index_col, {r6('resid')} as residual from ({CLIP})"))
def residual_clip_step(t):
    return rounded(screens.clip_residuals(_residual_rows(t), 2.576, 0.07, "rng"), [KEY, "index_col"], ["residual"])


_STEP = f"""with rr as ({CLIP}), sup as ({_COV.format(src='bs')}),
 c as (select rr.* from rr join sup using (lake_id) where n_rows >= 365 / 9e1 + 1 and not coalesce(max_gap > 90 * 8.64e4, false) and t_last - t_first >= 365 * 8.64e4),
 fp as (select lake_id, pass_id, count(area_total) na, count(wse) nw, min(area_total) al, max(area_total) ah, min(wse) wl, max(wse) wh from c where ice_clim_f <= 1 group by 1, 2),
 fa as (select lake_id, sum(na) na, sum(nw) nw, min(al) al, max(ah) ah, min(wl) wl, max(wh) wh from fp group by 1),
 x as (select c.*, fa.na is null as nofree, coalesce(fp.na, fa.na) na, coalesce(fp.nw, fa.nw) nw, coalesce(fp.al, fa.al) al, coalesce(fp.ah, fa.ah) ah,
  coalesce(fp.wl, fa.wl) wl, coalesce(fp.wh, fa.wh) wh, fa.nw anw, fa.wl awl, fa.wh awh, fa.na ana from c left join fp using (lake_id, pass_id) left join fa using (lake_id)),
 y as (select lake_id, index_col, wse from x where nofree or ice_clim_f <= 1 or (
  ((na < 2 and nw < 2) or ((na < 2 or area_total <= ah + 3e-1 * (ah - al)) and (nw < 2 or wse <= wh + 3e-1 * (wh - wl))))
  and ((ana < 2 and anw < 2) or anw < 2 or wse <= awh + 2e-1 * (awh - awl)))),
 q as (select lake_id, quantile_cont(wse, 0.1) lo, quantile_cont(wse, 0.9) hi from y group by 1),
 z as (select y.* from y join q using (lake_id) where wse >= lo - 3 * (hi - lo) and wse <= hi + 3 * (hi - lo)),
 mm as (select lake_id, quantile_cont(wse, 0.5) m from z group by 1)
 select lake_id, index_col from z join mm using (lake_id) where abs(wse - m) <= 150"""


@register(sql("ok", "sg", "bs", body=f"select * from ({_STEP})"))
def round1_step(t):
    cfg = FilterConfig()
    f = filtering.flagged_rows(t.core, t.thr, cfg).filter("ok_strict")
    f = f.select(*filtering._ROW).withColumn("attempt", F.lit(1)).withColumn("round", F.lit(1))
    f = f.withColumn("minfrac_frozen", F.lit(False)).withColumn("is_base", F.col("clean"))
    # support, curve and states read it
    return filtering.filter_step(t._freed("core", cut(f.drop("ok_lenient", "clean", "best"))), cfg)


def _curve_query(kind):
    def run(t):
        origin, curve = smoothers.grid_curve(t.baseline, kind)
        return rounded(G.at_times(t.baseline.select(KEY, "index_col", "time"), curve, origin), [KEY, "index_col"], ["smooth"])

    run.__name__ = f"{kind}_curve"
    return run


for _kind, _twin in (("wavelet", "wav"), ("hampel", "ham"), ("kalman", "kal")):
    register(sql(_twin, "bs", body=duck.at_times(_twin)))(_curve_query(_kind))


@register(sql("cubic", body=f"select lake_id, index_col, spline_ok, case when spline_ok then {r6('f')} end as smooth from cubic"))
def spline_curve(t):
    b = t.baseline.select(KEY, "index_col", "time", "wse")
    return rounded(smoothers.spline(b, b), [KEY, "index_col", "spline_ok"], ["smooth"])


@register(sql("lo0", "lo1", body=duck.LOWESS_SQL))
def lowess_curve(t):
    b = t.baseline.select(KEY, "index_col", "time", "wse", F.lit(True).alias("is_base"), F.lit(True).alias("is_eval"))
    return rounded(smoothers.lowess(b), [KEY, "index_col"], ["bottom", "top", "residual"])


@register(sql("sweep", body=duck.SWEEP_SQL))
def savgol_sweep(t):
    b = t.baseline.select(KEY, "index_col", "time", "wse")
    s = smoothers.sweep(b, b, "savgol")
    best = screens.smallest_residual([F.get("curves", F.lit(i)) for i in range(6)], F.col("wse"))
    return rounded(s.withColumn("residual", best), [KEY, "index_col"], ["bottom", "top", "residual"])


# --------------------------------------------------------------- workflow
@register()
def filter_hierarchy(t):
    o = filtering.run_filter(t.stored)["observations"]
    return o.select(KEY, "index_col", "filter_flag", r("wse_adjusted").alias("wse_adjusted"), "filter_attempt",
                    "n_while", "n_while_r2", "intra_cycle_flag")


@register()
def filter_strict(t):
    rows = filtering.flagged_rows(t.u, t.thr, FilterConfig()).withColumn("ok_lenient", F.lit(False))
    return filtering.low_pass(rows, FilterConfig())


@register(sql("ok", body="select lake_id, index_col, case when passes then 1 else 0 end as filter_flag, '1_strict' as filter_attempt from ok"))
def filter_threshold_only(t):
    cfg = FilterConfig(apply_low_pass=False, adjust_cycles=False)
    o = filtering.run_filter(t.stored, cfg)["observations"]
    return o.filter("is_first").select(KEY, "index_col", "filter_flag", "filter_attempt")


@register(sql("lab", body=f"select lake_id, index_col, filter_flag, {r6('wse_adjusted')} as wse_adjusted, filter_attempt from lab"))
def tukey_labelled(t):
    return t.labelled.select(KEY, "index_col", "filter_flag", r("wse_adjusted").alias("wse_adjusted"), "filter_attempt")


# ---------------------------------------------------------- daily and metrics
_D = [f"daily_{s}" for _, s, _ in METH] + ["daily_gauge"]


@register(sql("daily", body="select lake_id, cast(date as varchar) as date, " + ", ".join(f"{r6(c)} as {c}" for c in _D) + " from daily"))
def daily_overlap_gaps(t):
    d = V.daily_tables(t.labelled, t.gauge, VCFG)
    return d.select(KEY, F.col("date").cast("string").alias("date"), *[r(c).alias(c) for c in _D])


@register(sql("u", body=f"""with od as (select lake_id, date, avg(wse) v from u group by 1, 2), b as (select lake_id, min(date) a, max(date) z from od group by 1),
 d as (select lake_id, cast(unnest(generate_series(a, z, interval 1 day)) as date) as date from b), n as (select d.lake_id, d.date,
  last_value(case when v is not null then d.date end ignore nulls) over f pd, last_value(v ignore nulls) over f pv,
  first_value(case when v is not null then d.date end ignore nulls) over g nd, first_value(v ignore nulls) over g nv
  from d left join od on od.lake_id = d.lake_id and od.date = d.date
  window f as (partition by d.lake_id order by d.date rows between unbounded preceding and current row),
  g as (partition by d.lake_id order by d.date rows between current row and unbounded following))
 select lake_id, cast(date as varchar) as date, {r6("case when pd = nd then pv else pv + (nv - pv) * (cast(date_diff('day', pd, date) as double) / date_diff('day', pd, nd)) end")} as wse from n"""))
def daily_interp(t):
    od = daily.daily_means(t.u, "datetime", {"wse": "wse"})
    ends = od.groupBy(KEY).agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    d = daily.spine(ends).drop("first_date", "last_date").join(od, [KEY, "date"], "left")
    d = daily.interpolate_daily(d, ["wse"])
    return d.select(KEY, F.col("date").cast("string").alias("date"), r("wse").alias("wse"))


@register(sql("offs", body=f"select lake_id, {r6('bias')} as bias from offs"))
def datum_offset(t):
    m = cut(V.match_gauges(t.labelled.select(KEY, "time", "wse", "wse_adjusted", "ice_clim_f"), t.gauge, t.tolerance))
    return rounded(M.datum_offset(m), [KEY], ["bias"])


@register(sql("errs", body=f"select lake_id, method, n_match, n_used, {r6('mae')} as mae, {r6('median_error')} as median_error from errs"))
def mae_by_method(t):
    return rounded(V.method_errors(t.scored, VCFG), [KEY, "method", "n_match", "n_used"], ["mae", "median_error"])


_VAR = [f"{v}_{s}" for s in [s for _, s, _ in METH] + ["gauge"] for v in ("std", "amp", "idr")]


@register(sql("dm", body="select lake_id, " + ", ".join(f"{r6(c)} as {c}" for c in _VAR) + " from dm"))
def variability_by_method(t):
    d = V.daily_tables(t.labelled, t.gauge, VCFG)
    m = M.daily_metrics(d, [c for c in _D if c != "daily_gauge"], VCFG)
    return m.select(KEY, *[r(c.replace("_", "_daily_", 1)).alias(c) for c in _VAR])


_COR = [f"corr_{s}" for _, s, _ in METH]


@register(sql("dm", body="select lake_id, " + ", ".join(f"{r6(c)} as {c}" for c in _COR) + " from dm"))
def correlation_by_method(t):
    d = V.daily_tables(t.labelled, t.gauge, VCFG)
    m = M.daily_metrics(d, [c for c in _D if c != "daily_gauge"], VCFG)
    return m.select(KEY, *[r(c.replace("_", "_daily_", 1)).alias(c) for c in _COR])


@register(sql("scored", body=f"""with q as (select lake_id, wse, gauge_corrected as g from scored where gauge_corrected is not null),
 k as (select lake_id, rank() over (partition by lake_id order by wse) + (count(*) over (partition by lake_id, wse) - 1) / 2e0 as a,
  rank() over (partition by lake_id order by g) + (count(*) over (partition by lake_id, g) - 1) / 2e0 as b from q)
 select lake_id, {r6(duck.corr('a', 'b'))} as spearman from k group by 1"""))
def spearman(t):
    return rounded(M.spearman(t.scored, "wse", "gauge_corrected"), [KEY], ["spearman"])


@register(sql("ret", body="select lake_id, retention_n, " + ", ".join(
    f"{r6(c)} as {c}" for c in ("retention_rate", "retention_stringent", "retention_permissive", "ice_duration")) + " from ret"))
def retention(t):
    m = M.retention(t.labelled.withColumn("kept", F.col("filter_flag") == 1))
    return rounded(m, [KEY, "retention_n"], ["retention_rate", "retention_stringent", "retention_permissive", "ice_duration"])


_ST_PLAIN = ["lake_id", "gauge_source", "filter_attempt", "retention_n"] + [f"{c}_{s}" for c in ("n_match", "n_used") for _, s, _ in METH]
_ST_VAL = (
    ["lake_area"] + [f"{c}_{s}" for c in ("mae", "median_error") for _, s, _ in METH] + _VAR + _COR
    + ["std_retained", "amp_retained", "idr_retained", "retention_rate", "retention_stringent", "retention_permissive", "ice_duration"]
)


@register(sql("stats", body="select " + ", ".join(_ST_PLAIN) + ", " + ", ".join(f"{r6(c)} as {c}" for c in _ST_VAL) + " from stats"))
def lake_stats(t):
    return rounded(t.stats, _ST_PLAIN, _ST_VAL)


# -------------------------------------------------------------- summaries
# The registry also lists lakes that nobody observed, that were observed 10,000 days after any gauge
# reading, that have one row and that have no usable value.
_UNSEEN, _LATE, _ONCE, _ROUGH = 1000000, 2000000, 3000000, 4000000
_MORE_SQL = "(select * from registry" + "".join(
    f" union all select lake_id + {n}, gauge_source, priority from registry where lake_id % 9 = {i}"
    for i, n in enumerate((_UNSEEN, _LATE, _ONCE, _ROUGH))) + ")"
_BAD_SQL = f"""select r.lake_id, n is null as no_data, coalesce(n = 0, false) as no_gauge_joined, coalesce(n < 2, false) as few_pairs
 from (select distinct lake_id from {_MORE_SQL}) r left join (
  select lake_id, count(gauge_wse) as n from matched group by 1
  union all select lake_id + {_LATE}, 0 from matched group by 1
  union all select lake_id + {_ONCE}, count(gauge_wse) from matched where index_col = 0 group by 1) m
 on m.lake_id = r.lake_id where n is null or n < 2"""


def _shifted(df, n):
    return df.withColumn(KEY, F.col(KEY) + n)


def _more_lakes(t):
    out = t.registry
    for i, n in enumerate((_UNSEEN, _LATE, _ONCE, _ROUGH)):
        out = out.unionByName(_shifted(t.registry.filter(F.col(KEY) % 9 == i), n))
    return out


def _more_raw(t):
    late = _shifted(t.raw.filter(F.col(KEY) % 9 == 1), _LATE).withColumn("time", F.col("time") + 1e4 * DAY)
    rough = _shifted(t.raw.filter(F.col(KEY) % 9 == 3), _ROUGH).withColumn("wse", F.lit(C.FILL_VALUE))
    return t.raw.unionByName(late).unionByName(rough)


def _invalid(t):
    rows = prep.prepare(_more_raw(t), tables.ARRIVAL)
    once = _shifted(t.stored.filter((F.col(KEY) % 9 == 2) & (F.col("index_col") == 0)), _ONCE)
    gauge, tolerance = t.gauge, t.tolerance
    for n in (_LATE, _ONCE):
        gauge, tolerance = gauge.unionByName(_shifted(t.gauge, n)), tolerance.unionByName(_shifted(t.tolerance, n))
    return X.invalid_lakes(_more_lakes(t), V.match_gauges(rows.unionByName(once), gauge, tolerance))


@register(sql("u", "thr", "registry", body=f"""select lake_id, 'observations' as missing_in from {_MORE_SQL} where lake_id not in (
  select l_suppkey from lineitem union all select l_suppkey + {_LATE} from lineitem union all select l_suppkey + {_ROUGH} from lineitem)
 union all select lake_id, 'series' from {_MORE_SQL} where lake_id not in (select lake_id from u union all select lake_id + {_LATE} from u)
 union all select lake_id, 'thresholds' from {_MORE_SQL} where lake_id not in (select lake_id from thr union all select lake_id + {_LATE} from thr)"""))
def coverage_sets(t):
    raw = _more_raw(t)
    series = prep.distinct_times(prep.prepare(raw, tables.ARRIVAL))
    return X.coverage_sets(_more_lakes(t), raw, series, T.calibrate(series))


@register(sql("matched", "registry", body=_BAD_SQL))
def invalid_lakes(t):
    return _invalid(t)


@register(sql("matched", "registry", body=f"""select gauge_source, count(distinct lake_id) as n_before,
 count(distinct lake_id) filter (where lake_id not in (select lake_id from ({_BAD_SQL}))) as n_after from {_MORE_SQL} group by 1"""))
def source_counts(t):
    return X.source_counts(_more_lakes(t), _invalid(t))


@register(sql("ret", "registry", body=f"""select coalesce(filter_attempt, 'no data') as filter_attempt, count(*) as n_lakes,
 {r6('100 * count(*) / (sum(count(*)) over () * 1e0)')} as share from registry left join ret using (lake_id) group by 1"""))
def attempt_share(t):
    a = t.registry.join(t.labelled.groupBy(KEY).agg(F.first("filter_attempt").alias("filter_attempt")), KEY, "left")
    a = a.withColumn("filter_attempt", F.coalesce("filter_attempt", F.lit("no data")))
    return rounded(X.attempt_share(a), ["filter_attempt", "n_lakes"], ["share"])


_REF = f"""with cov as ({_COV.format(src='bs')}), att as (select lake_id, case
  when n_rows >= 365 / 9e1 + 1 and not coalesce(max_gap > 90 * 8.64e4, false) and t_last - t_first >= 365 * 8.64e4 then '1_strict'
  when n_rows >= 365 / 9e1 + 1 then '2_lenient' else '4_none' end as filter_attempt from cov),
 ob as ({_COV.format(src='lab where filter_flag = 1')})
 select l.lake_id, coalesce(filter_attempt, '4_none') as filter_attempt, floor((t_last - t_first) / 8.64e4) as span_days, max_gap / 8.64e4 as max_gap_days,
  case when filter_attempt = '1_strict' or (filter_attempt = '2_lenient' and coalesce(floor((t_last - t_first) / 8.64e4), 0) >= 365
   and coalesce(max_gap / 8.64e4 <= 120, false)) then 1 else 0 end as keep_mask
 from (select distinct lake_id from p) l left join att using (lake_id) left join ob using (lake_id)"""


def _attempts(t):
    """Attempt by the temporal support of the strict baseline."""
    cov = asof.coverage(t.baseline, [KEY], "time")
    a = cov.select(KEY, F.when(screens.supported(cov, STRICT), "1_strict").when(screens.supported(cov, LENIENT), "2_lenient")
                   .otherwise("4_none").alias("filter_attempt"))
    lab = t.labelled.drop("filter_attempt").join(a, KEY, "left")
    return lab.withColumn("filter_attempt", F.coalesce("filter_attempt", F.lit("4_none")))


@register(sql("bs", "lab", body=f"select lake_id, filter_attempt, cast(span_days as bigint) as span_days, {r6('max_gap_days')} as max_gap_days, keep_mask from ({_REF})"))
def reference_lakes(t):
    return X.reference_lakes(_attempts(t)).select(KEY, "filter_attempt", "span_days", r("max_gap_days").alias("max_gap_days"), "keep_mask")


def _valid_stats(t):
    """Lakes of the summaries: those with an error value for the filtered series."""
    return t.stats.filter("mae_filtered is not null")


_MLONG = " union all ".join(
    [f"select lake_id, 'mae' as metric, '{s}' as method, mae_{s} as value from vs" for _, s, _ in METH]
    + [f"select lake_id, 'correlation', '{s}', corr_{s} from vs" for _, s, _ in METH]
    + [f"select lake_id, 'rel_{v}', '{s}', case when {v}_gauge > 0 then abs({v}_{s} - {v}_gauge) / {v}_gauge end from vs"
       for v in ("std", "amp", "idr") for _, s, _ in METH]
    + [f"select lake_id, 'retention', '{s}', 100 * {c} from vs" for s, c in
       (("raw", "1e0"), ("stringent", "retention_stringent"), ("permissive", "retention_permissive"), ("filtered", "retention_rate"))])
duck.CTE["vs"] = "select * from stats where mae_filtered is not null"
duck.CTE["ml"] = f"select * from ({_MLONG}) where value is not null"
duck.CTE["nv"] = "select vs.lake_area, ml.lake_id, substr(metric, 5) as statistic, method, value as rel_err from ml join vs using (lake_id) where metric like 'rel_%'"


@register(sql("ml", body=f"""select metric, method, count(*) as n, {r6('quantile_cont(value, 0.25)')} as p25, {r6('quantile_cont(value, 0.5)')} as p50,
 {r6('quantile_cont(value, 0.75)')} as p75, {r6("case when metric in ('correlation', 'retention') then quantile_cont(value, 0.3173) else quantile_cont(value, 0.6827) end")} as p_summary
 from ml group by 1, 2"""))
def percentile_summary(t):
    s = X.percentile_summary(X.metric_long(_valid_stats(t)), VCFG)
    return rounded(s, ["metric", "method", "n"], ["p25", "p50", "p75", "p_summary"])


@register(sql("ml", body=f"""select metric, method, lake_id, {r6('value')} as value,
 {r6('row_number() over (partition by metric, method order by value, lake_id) * 100e0 / count(*) over (partition by metric, method)')} as pct from ml"""))
def ecdf_by_method(t):
    e = X.ecdf(X.metric_long(_valid_stats(t)), ["metric", "method"], "value")
    return rounded(e, ["metric", "method", KEY], ["value", "pct"])


@register(sql("vs", body=" union all ".join(f"""select '{v}' as statistic, count(*) as n, {r6('quantile_cont(x, 0.6827)')} as p_summary from (
 select sqrt(greatest(0, ((abs({v}_filtered - {v}_gauge) / {v}_filtered) ** 2) - ((abs({v}_retained - {v}_gauge) / {v}_filtered) ** 2))) as x from vs
 where {v}_filtered > 0 and {v}_gauge is not null and {v}_retained is not null) having count(*) > 0""" for v in ("std", "amp", "idr"))))
def extra_residual(t):
    return rounded(X.extra_residual(_valid_stats(t), VCFG), ["statistic", "n"], ["p_summary"])


@register(sql("nv", body=f"select lake_id, statistic, method, {r6('rel_err')} as rel_err from nv"))
def norm_variability(t):
    n = X.norm_variability(_valid_stats(t)).filter(F.col("rel_err").isNotNull())
    return rounded(n, [KEY, "statistic", "method"], ["rel_err"])


@register(sql("nv", body=f"""select statistic, method, count(*) as n, {r6('avg(rel_err)')} as mean, {r6('quantile_cont(rel_err, 0.5)')} as median,
 {r6('quantile_cont(rel_err, 0.6827)')} as p_summary, {r6('quantile_cont(rel_err, 0.9)')} as p90 from nv group by 1, 2"""))
def norm_variability_summary(t):
    n = X.norm_variability(_valid_stats(t)).filter(F.col("rel_err").isNotNull())
    s = X.variability_summary(n, ["statistic", "method"], VCFG)
    return rounded(s, ["statistic", "method", "n"], ["mean", "median", "p_summary", "p90"])


_FIXBIN = """case when lake_area >= 0 and lake_area <= 0.1 then '<=0.1' when lake_area > 0.1 and lake_area <= 1 then '<=1' when lake_area > 1 and lake_area <= 10 then '<=10'
 when lake_area > 10 and lake_area <= 100 then '<=100' when lake_area > 100 and lake_area <= 1000 then '<=1000'
 when lake_area > 1000 and lake_area <= 10000 then '<=10000' when lake_area > 10000 then '>10000' end"""


@register(sql("nv", body=f"""select {_FIXBIN} as area_bin, statistic, count(*) as n, {r6('quantile_cont(rel_err, 0.5)')} as median, {r6('avg(rel_err)')} as mean,
 {r6('quantile_cont(rel_err, 0.6827)')} as p_summary from nv where method = 'filtered' group by 1, 2"""))
def area_bin_summary(t):
    n = X.norm_variability(_valid_stats(t)).filter(F.col("rel_err").isNotNull() & (F.col("method") == "filtered"))
    s = X.variability_summary(X.with_area_bins(n), ["area_bin", "statistic"], VCFG)
    return rounded(s, ["area_bin", "statistic", "n"], ["median", "mean", "p_summary"])


@register(sql("vs", body=f"""with f as (select *, abs(std_stringent - std_gauge) / std_gauge as es, abs(std_filtered - std_gauge) / std_gauge as ef from vs
 where std_gauge > 0 and lake_area is not null), e as (select min(lake_area) filter (where lake_area > 0) a, max(lake_area) z, count(*) n from f),
 b as (select f.*, case when n < 5 then null when lake_area >= a and lake_area <= 0.1 then 'first' when lake_area > 0.1 and lake_area <= 1 then '<=1'
  when lake_area > 1 and lake_area <= 10 then '<=10' when lake_area > 10 and lake_area <= 100 then '<=100' when lake_area > 100 and lake_area <= 1000 then '<=1000'
  when lake_area > 1000 and lake_area <= 10000 then '<=10000' when lake_area > 10000 and lake_area <= z then 'last' end as area_bin from f, e)
 select area_bin, count(*) as n_lakes, {r6('ms')} as median_stringent, {r6('mf')} as median_filtered, {r6('(ms - mf) / ms * 100')} as reduction_pct from (
 select *, quantile_cont(es, 0.5) over (partition by area_bin) ms, quantile_cont(ef, 0.5) over (partition by area_bin) mf from b where area_bin is not null)
 where ms is not null and mf is not null group by area_bin, ms, mf"""))
def area_bin_reduction(t):
    x = X.area_bin_reduction(_valid_stats(t))
    return rounded(x, ["area_bin", "n_lakes"], ["median_stringent", "median_filtered", "reduction_pct"])


@register(sql("scored", body=f"""select lake_id, index_col, {r6('wse - m')} as anom_raw, {r6('wse_adjusted - m')} as anom_filtered, {r6('wse_stringent - m')} as anom_stringent,
 {r6('wse_permissive - m')} as anom_permissive, {r6('gauge_corrected - m')} as anom_gauge from (select *, avg(wse_adjusted) over (partition by lake_id) m from scored)"""))
def anomalies(t):
    return rounded(X.anomalies(t.scored), [KEY, "index_col"], [f"anom_{n}" for n in ("raw", "filtered", "stringent", "permissive", "gauge")])


_CYCLES = ", ".join(f"({c}, '{s}')" for c, s in CYCLE_START)


@register(sql("lab", body=f"""select lake_id, l.cycle_id, cast(cast(start_time as date) as varchar) as start_date, count(wse) as n_raw, count(wse_adjusted) as n_filtered,
 count(wse_stringent) as n_stringent, count(wse_permissive) as n_permissive, {r6('count(wse_adjusted) * 1e2 / count(wse)')} as ret_filtered,
 {r6('count(wse_stringent) * 1e2 / count(wse)')} as ret_stringent, {r6('count(wse_permissive) * 1e2 / count(wse)')} as ret_permissive
 from lab l left join (values {_CYCLES}) c(cycle_id, start_time) on l.cycle_id = c.cycle_id where l.cycle_id between 1 and 32 group by 1, 2, 3"""))
def retention_by_cycle(t):
    x = X.retention_by_cycle(C.benchmark_columns(t.labelled), VCFG)
    x = x.withColumn("start_date", F.to_date("start_time").cast("string"))
    return rounded(x, [KEY, "cycle_id", "start_date", "n_raw", "n_filtered", "n_stringent", "n_permissive"],
                   ["ret_filtered", "ret_stringent", "ret_permissive"])


@register(sql("lab", body=f"""select cycle_id, count(*) as n, {', '.join(f"{r6(f'quantile_cont(x, {q})')} as {n}" for n, q in
 (('p5', 0.05), ('p25', 0.25), ('p50', 0.5), ('p75', 0.75), ('p95', 0.95)))} from (select lake_id, cycle_id, count(wse_adjusted) * 1e2 / count(wse) as x
 from lab where cycle_id between 1 and 32 group by 1, 2) group by 1"""))
def box_stats(t):
    x = X.retention_by_cycle(C.benchmark_columns(t.labelled), VCFG)
    return rounded(X.box_stats(x, ["cycle_id"], "ret_filtered"), ["cycle_id", "n"], ["p5", "p25", "p50", "p75", "p95"])


duck.CTE["elong"] = """select *, 'Ice-free' as ice_cond from mlong where ice_clim_f < 1 union all select *, 'Ice-covered' from mlong where ice_clim_f >= 1
 union all select *, 'Ice-both' from mlong"""
duck.CTE["eice"] = f"""select f.lake_id, f.method, f.ice_cond, coalesce(n_match, 0) as n_match, coalesce(n_used, 0) as n_used, mae, median_error,
 case when s > 0 then mae / s end as rel_err from (select lake_id, method, ice_cond, s from (select lake_id, stddev_samp(wse_adjusted) as s from scored group by 1)
 cross join (values ('Raw'), ('Stringent'), ('Permissive'), ('Filtered')) m(method) cross join (values ('Ice-free'), ('Ice-covered'), ('Ice-both')) c(ice_cond)) f
 left join ({duck.errors('elong', 'lake_id, method, ice_cond')}) e using (lake_id, method, ice_cond)"""


@register(sql("eice", body=f"select lake_id, method, ice_cond, n_match, n_used, {r6('mae')} as mae, {r6('median_error')} as median_error, {r6('rel_err')} as rel_err from eice"))
def error_by_ice(t):
    e = X.error_by_ice(t.scored, VCFG)
    return rounded(e, [KEY, "method", "ice_cond", "n_match", "n_used"], ["mae", "median_error", "rel_err"])


@register(sql("eice", body=f"""select ice_cond, method, metric, count(v) as n, {r6('quantile_cont(v, 0.5)')} as p50, {r6('quantile_cont(v, 0.6827)')} as p_summary from (
 select ice_cond, method, 'mae' as metric, mae as v from eice union all select ice_cond, method, 'rel_err', rel_err from eice) group by 1, 2, 3"""))
def error_by_ice_summary(t):
    s = X.error_by_ice_summary(X.error_by_ice(t.scored, VCFG), VCFG)
    return rounded(s, ["ice_cond", "method", "metric", "n"], ["p50", "p_summary"])


@register(sql("stats", "p", body=f"""with d as (select s.lake_id, mae_filtered as v, p_lat, p_lon from stats s join (select distinct lake_id, p_lat,
 (p_lon + 180e0) - 360e0 * floor((p_lon + 180e0) / 360e0) - 180e0 as p_lon from p where p_ref_area > 0) q using (lake_id) where mae_filtered is not null)
 select lake_id, {r6('v')} as mae_filtered, {r6('p_lat')} as p_lat, {r6('p_lon')} as p_lon, {r6('(select quantile_cont(abs(v), 0.95) from d)')} as colour_limit from d"""))
def geo_table(t):
    g = X.geo_table(t.stats, X.lake_dimension(t.stored), "mae_filtered")
    return rounded(g, [KEY], ["mae_filtered", "p_lat", "p_lon", "colour_limit"])


@register(sql("p", body=f"""select count(*) as n_lakes, {r6('min(a)')} as min_area, {r6('max(a)')} as max_area, {r6('quantile_cont(a, 0.5)')} as median_area,
 {r6('avg(a)')} as mean_area from (select lake_id, any_value(p_ref_area) as a from p group by 1)"""))
def area_stats(t):
    return rounded(X.area_stats(X.lake_dimension(t.p)), ["n_lakes"], ["min_area", "max_area", "median_area", "mean_area"])


def _masked(t):
    """Statistics with the attempt and mask of the reference selection."""
    ref = cut(X.reference_lakes(_attempts(t)))
    stats = t.stats.drop("filter_attempt").join(ref.select(KEY, "filter_attempt"), KEY, "left")
    return X.with_keep_mask(stats.withColumn("filter_attempt", F.coalesce("filter_attempt", F.lit("no data"))), ref)


duck.CTE["ref"] = _REF
duck.CTE["masked"] = "select stats.* exclude (filter_attempt), coalesce(ref.filter_attempt, 'no data') as filter_attempt, coalesce(keep_mask, 0) as keep_mask from stats left join ref using (lake_id)"


@register(sql("masked", body=f"""select count(*) as n_lakes, {r6('avg(keep_mask * 1e2)')} as kept_share,
 {r6('avg(case when keep_mask = 1 and mae_filtered is not null then 1e2 else 0e0 end)')} as validated_share,
 {r6('avg(0e0) filter (where keep_mask = 1 and mae_filtered is not null)')} as corrected_share from masked"""))
def selection_shares(t):
    return rounded(X.selection_shares(_masked(t)), ["n_lakes"], ["kept_share", "validated_share", "corrected_share"])


@register(sql("masked", body="""with d as (select * from masked where lake_area > 0), e as (select min(lake_area) a, max(lake_area) b,
  greatest(5, cast(trunc(log10(max(lake_area) / min(lake_area))) as int) * 10) n from d)
 select cast(least(floor(round(log10(lake_area / a) / log10(b / a) * (n - 1), 9)), n - 2) as int) as bin, count(*) as n_all,
 count(*) filter (where filter_attempt = '1_strict') as n_strict, count(*) filter (where keep_mask = 1) as n_kept, count(*) filter (where keep_mask = 1 and mae_filtered is not null) as n_validated from d, e group by 1"""))
def area_histogram(t):
    return X.area_histogram(_masked(t)).select("bin", "n_all", "n_strict", "n_kept", "n_validated")



# ------------------------------------------------- labels, trace and shares by state
@register(sql("ok", body="select lake_id, index_col, coalesce(wse_std > wse_std_thr_cal, false) as wse_std_above from ok"))
def std_above_threshold(t):
    return C.above_calibrated(T.with_thresholds(t.u, t.thr, STRICT.bounds)).select(KEY, "index_col", "wse_std_above")


def _traced(rows, names, used):
    kept = lambda c: used or c.endswith(("_source", "_cal"))
    cols = [f"o.{c}" if c.endswith("_source") else f"{r6('o.' + c)} as {c}" if kept(c) else f"cast(null as double) as {c}" for c in names]
    return f"select l.lake_id, l.index_col, {', '.join(cols)} from {rows} l left join {'ok' if used else 'okl'} o using (lake_id, index_col)"


@register(sql("p", "ok", body=_traced("p", T.trace_columns(), True)))
def filter_trace(t):
    """W8 in threshold-only mode: trace of the strict attempt, blank on repeated times."""
    cfg = FilterConfig(apply_low_pass=False, adjust_cycles=False, append_trace=True)
    o = filtering.run_filter(t.stored, cfg)["observations"]
    return rounded(o, [KEY, "index_col", *_SOURCE], _TRACE)


@register(sql("lab", "okl", body=_traced("lab", T.trace_columns(), False)))
def fallback_trace(t):
    """Series of the Tukey fallback have no bound and no applied threshold."""
    o = filtering.append_trace(t.labelled, t.u, t.thr, FilterConfig())
    return rounded(o, [KEY, "index_col", *_SOURCE], _TRACE)


@register(sql("ok", body=f"""select {_CALSQL}, '1_strict' as filter_attempt,
 {', '.join(f"{r6('b.' + c)} as {c}" for c in ('wse_std_thr_bound', 'wse_u_thr_bound', 'xtrk_dist_thr_bound'))}
 from thr left join (select lake_id, crid_scenario, pass_id, 'ice-free' as ice_condition, max(wse_std_thr_bound) as wse_std_thr_bound,
  max(wse_u_thr_bound) as wse_u_thr_bound, max(xtrk_dist_thr_bound) as xtrk_dist_thr_bound from ok group by 1, 2, 3) b
 using (lake_id, crid_scenario, pass_id, ice_condition)"""))
def attempt_summary(t):
    """The threshold table with the attempt that used it."""
    s = filtering.run_filter(t.stored, FilterConfig(apply_low_pass=False, adjust_cycles=False))["threshold_summary"]
    return rounded(s, [*_CALROW, "filter_attempt"], _CAL + ["wse_std_thr_bound", "wse_u_thr_bound", "xtrk_dist_thr_bound"])


@register(sql("eice", body=f"""select ice_cond, method, lake_id, {r6('mae')} as value,
 {r6('row_number() over (partition by ice_cond, method order by mae, lake_id) * 100e0 / count(*) over (partition by ice_cond, method)')} as pct
 from eice where mae is not null"""))
def ecdf_by_ice(t):
    e = X.error_by_ice(t.scored, VCFG).withColumnRenamed("mae", "value")
    return rounded(X.ecdf(e, ["ice_cond", "method"], "value"), ["ice_cond", "method", KEY], ["value", "pct"])


@register(f"""select round(min(reduction_pct), 6) as min_reduction, round(max(reduction_pct), 6) as max_reduction,
 round(quantile_cont(reduction_pct, 0.5), 5) as median_reduction from ({ORACLE["area_bin_reduction"]})""")
def reduction_range(t):
    """The reductions of the bins in one row."""
    x = rounded(X.area_bin_reduction(_valid_stats(t)), ["area_bin"], ["reduction_pct"])
    m = X.reduction_range(x)
    return m.select("min_reduction", "max_reduction", F.round("median_reduction", 5).alias("median_reduction"))


from catalogue import filter_twin, io_queries, workflow_queries  # noqa: E402,F401  (register themselves)
