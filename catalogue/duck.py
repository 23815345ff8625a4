"""DuckDB SQL twins of the registered queries, written from the semantics."""

from __future__ import annotations

import numpy as np

from stillwater.operators.kernels import WAVELET_TAPS
from stillwater.sources.tables import ARRIVAL, DAY_OF, GAUGE_WSE, OBS_COLUMNS, SCENARIO

FILL = "-999999999999e0"
ARR = ", ".join(ARRIVAL)
RAW = ", ".join(f"{e} as {c}" for c, e in OBS_COLUMNS.items())


def r6(x: str) -> str:
    return f"round({x}, 6) + 0e0"


CTE: dict[str, str] = {}
CTE["obs"] = f"""select {RAW}, {ARR} from (select *, {DAY_OF} as d95 from (
 select *, {SCENARIO} as scenario,
  date_diff('day', date '1995-01-01', cast(l_shipdate as date)) as d0
 from lineitem join supplier on l_suppkey = s_suppkey))"""
NEW = "(crid like '%C2' or regexp_matches(crid, '^.*D.$'))"
CTE["num"] = f"select *, row_number() over (partition by lake_id order by time, {ARR}) - 1 as index_col from obs"
CTE["p"] = f"""select * exclude (wse_u, wse_std, xtrk_dist),
  nullif(wse_u, {FILL}) as wse_u, nullif(wse_std, {FILL}) as wse_std, nullif(xtrk_dist, {FILL}) as xtrk_dist,
  case when length(trim(crid)) >= 2 then right(trim(crid), 2) else 'unknown' end as crid_scenario,
  case when ice_clim_f >= 2 then 'ice-covered' else 'ice-free' end as ice_condition,
  coalesce(lag(time) over (partition by lake_id order by index_col) <> time, true) as is_first,
  cast(timestamp '2000-01-01' + to_seconds(cast(time as bigint)) as date) as date,
  xovr_cal_q < 1 and (quality_f < 1 or (quality_f = 1 and {NEW})) as cons,
  quality_f = 0 and xovr_cal_q = 0 and ice_clim_f < 2 as tb,
  xovr_cal_q < 1 and ice_clim_f < 1 and quality_f < 1 as is_stringent,
  xovr_cal_q < 2 and ice_clim_f < 2 and ((quality_f < 1 and not {NEW}) or (quality_f < 3 and {NEW})) as is_permissive,
  {NEW} as is_new
 from num where wse <> {FILL}"""
CTE["u"] = "select * from p where is_first"
CTE["gauge"] = f"""select lake_id, gauge_time, max_by(gauge_wse, o_orderkey) as gauge_wse from (
 select o_custkey % (select count(*) from supplier) as lake_id,
  cast(d95 - 1826 as double) * 8.64e4 + 4.32e4 as gauge_time, {GAUGE_WSE} as gauge_wse, o_orderkey
 from (select *, date_diff('day', date '1995-01-01', cast(o_orderdate as date)) as d95 from orders)) group by 1, 2"""
CTE["registry"] = "select s_suppkey as lake_id, 'nation_' || s_nationkey as gauge_source, s_nationkey as priority from supplier"
CTE["tol"] = "select s_suppkey as lake_id, case when s_nationkey in (8, 9) then 1382400e0 else 86400e0 end as tolerance from supplier"


def calibrate(by_version=(0, 0, 0), by_pass=(0, 0, 1), by_ice=(1, 1, 1), compat=False) -> str:
    m = [("wse_std", "wse_std", "max"), ("wse_u", "wse_u", "max"), ("xtrk_dist", "abs(xtrk_dist)", "min")]
    sql = """with pairs as (select lake_id, crid_scenario, pass_id, min(index_col) as pair_order,
  count(*) filter (where cons) as pc from u group by all),
 seen as (select lake_id, crid_scenario, pass_id, ice_condition, count(*) filter (where cons) as nc from u group by all),
 b0 as (select pairs.*, ic.ice_condition, case when ic.ice_condition = 'both' then (case when pc > 0 then 1 else 2 end)
   when nc is null then 3 when nc > 0 then 1 else 2 end as grouping_scheme
  from pairs cross join (values ('ice-free'), ('ice-covered'), ('both')) ic(ice_condition)
  left join seen using (lake_id, crid_scenario, pass_id, ice_condition))"""
    for i, (name, expr, agg) in enumerate(m):
        keys = ["lake_id"] + (["crid_scenario"] if by_version[i] else []) + (["pass_id"] if by_pass[i] else [])
        ik = keys + (["ice_condition"] if by_ice[i] else [])
        sql += f""", i{i} as (select {', '.join(ik)}, {agg}({expr}) as v from u where cons group by all),
 p{i} as (select {', '.join(keys)}, {agg}({expr}) as v from u where cons group by all),
 b{i + 1} as (select b{i}.*, case when b{i}.ice_condition = 'both' then p{i}.v else i{i}.v end as c{i}
  from b{i} left join i{i} using ({', '.join(ik)}) left join p{i} using ({', '.join(keys)}))"""
    steps = []  # (column, keys, target, agg)
    split = [] if compat else ["ice_condition = 'both'"]
    ice, both = "ice_condition <> 'both'", "ice_condition = 'both'"
    for c in (0, 1):
        steps += [(c, ["ice_condition", "pass_id"], ice, "max"), (c, ["ice_condition", "crid_scenario"], ice, "max")]
        if not compat:
            steps.append((c, ["ice_condition"], ice, "max"))
    steps += [(2, ["pass_id", "ice_condition"], ice, "min"), (2, ["pass_id", "crid_scenario"] + split, ice, "min")]
    if not compat:
        steps.append((2, ["pass_id"] + split, ice, "min"))
        for k in ("pass_id", "crid_scenario"):
            steps += [(c, [k] + split, both, "min" if c == 2 else "max") for c in (0, 1, 2)]
    for n, (c, keys, tgt, agg) in enumerate(steps):
        sql += f""", b{n + 4} as (select * replace (case when {tgt} then
  coalesce(c{c}, {agg}(c{c}) over (partition by lake_id, {', '.join(keys)})) else c{c} end as c{c}) from b{n + 3})"""
    return sql + f""" select lake_id, crid_scenario, pass_id, ice_condition, c0 as wse_std_thr_cal, c1 as wse_u_thr_cal,
 c2 as xtrk_dist_thr_cal, grouping_scheme, pair_order from b{len(steps) + 3}"""


CTE["thr"] = calibrate()
STRICT = dict(std=(0, 3), u=(0, 0.5), x=(0, 75000), fs=3, fu=0.1)
LENIENT = dict(std=(0.5, 5), u=(0.1, 0.5), x=(0, 75000), fs=5, fu=0.1)


def gated(b=STRICT, free=("ice-free", "ice-free", "not apply"), cov=("ice-free", "ice-free", "not apply")) -> str:
    """Rows of u with the 12 trace columns and the pass flag."""
    names = ["wse_std", "wse_u", "xtrk_dist"]
    sel, app, ok = [], [], []
    for i, n in enumerate(names):
        lo, hi = (b["std"], b["u"], b["x"])[i]
        default = lo if i == 2 else hi

        def val(rule):
            return "cast(null as double)" if rule == "not apply" else f"max({n}_thr_cal) filter (where t.ice_condition = '{rule}')"

        sel.append(f"case when u.ice_condition = 'ice-covered' then '{cov[i]}' else '{free[i]}' end as {n}_thr_source")
        sel.append(f"case when u.ice_condition = 'ice-covered' then w.{n}_cov else w.{n}_free end as {n}_thr_cal")
        bound = f"least(greatest(coalesce({n}_thr_cal, {float(default)!r}e0), {float(lo)!r}e0), {float(hi)!r}e0)"
        app.append(f"case when {n}_thr_source <> 'not apply' then {bound} end as {n}_thr_bound")
        if i == 2:
            ok.append(f"({n}_thr_source = 'not apply' or coalesce(abs(xtrk_dist) >= {n}_thr_bound, false))")
        else:
            ok.append(f"({n}_thr_source = 'not apply' or coalesce({n} <= {n}_thr_app, false))")
    wide = ", ".join(
        f"{'cast(null as double)' if rules[i] == 'not apply' else f'''max({n}_thr_cal) filter (where ice_condition = '{rules[i]}')'''} as {n}_{tag}"
        for i, n in enumerate(names) for tag, rules in (("free", free), ("cov", cov))
    )
    fs, fu = float(b["fs"]), float(b["fu"])
    return f"""select *, {' and '.join(ok)} as passes from (select *,
  case when ice_clim_f >= 1 then greatest(wse_std_thr_bound, case when wse_std_thr_bound is not null then {fs!r}e0 end) else wse_std_thr_bound end as wse_std_thr_app,
  case when ice_clim_f >= 1 then greatest(wse_u_thr_bound, case when wse_u_thr_bound is not null then {fu!r}e0 end) else wse_u_thr_bound end as wse_u_thr_app,
  xtrk_dist_thr_bound as xtrk_dist_thr_app
 from (select *, {', '.join(app)} from (select u.*, {', '.join(sel)} from u left join
  (select lake_id, crid_scenario, pass_id, {wide} from thr group by all) w using (lake_id, crid_scenario, pass_id))))"""


CTE["ok"] = gated()
CTE["okl"] = gated(LENIENT)


def w5(multiplier="3e0", lo=0.25, hi=0.75, steps=5) -> str:
    sql = "with s0 as (select lake_id, index_col, wse from u where tb)"
    for i in range(1, steps + 1):
        sql += f""", t{i} as (select s.* from s{i - 1} s join (select lake_id, quantile_cont(wse, {lo}) ql, quantile_cont(wse, {hi}) qh
  from s{i - 1} group by 1) q using (lake_id) where wse >= ql - {multiplier} * (qh - ql) and wse <= qh + {multiplier} * (qh - ql)),
 s{i} as (select t.* from t{i} t join (select lake_id, quantile_cont(wse, 0.5) m from t{i} group by 1) q using (lake_id)
  where abs(wse - m) <= 150)"""
    for i in range(steps + 1):
        sql += f", c{i} as (select lake_id, count(*) n{i} from s{i} group by 1)"
    first = " ".join(f"when n{i} = n{i - 1} then {i}" for i in range(1, steps + 1))
    joins = " ".join(f"join c{i} using (lake_id)" for i in range(1, steps + 1))
    return sql + f""" select s.*, n.n_steps from s{steps} s join
  (select lake_id, case {first} else {steps} end as n_steps from c0 {joins}) n using (lake_id)"""


CTE["w5"] = w5()
CTE["lab"] = """select p.*, w5.wse as wse_adjusted, case when w5.wse is null then 0 else 1 end as filter_flag,
 case when p.is_stringent then p.wse end as wse_stringent, case when p.is_permissive then p.wse end as wse_permissive,
 case when count(w5.wse) over (partition by p.lake_id) > 0 then '3_tukey' else '4_none' end as filter_attempt
 from p left join w5 on p.lake_id = w5.lake_id and p.index_col = w5.index_col"""
CTE["near"] = """select m.* exclude (bt, bw, nt, nw), case when pick_back then bt else nt end as gt,
  case when pick_back then bw else nw end as gw from (
 select b.*, a.gauge_time as nt, a.gauge_wse as nw,
  a.gauge_time is null or (b.time - b.bt <= a.gauge_time - b.time) as pick_back
 from (select l.*, g.gauge_time as bt, g.gauge_wse as bw from lab l asof left join gauge g
   on l.lake_id = g.lake_id and l.time >= g.gauge_time) b
 asof left join gauge a on b.lake_id = a.lake_id and b.time <= a.gauge_time) m"""
CTE["matched"] = """select n.* exclude (gt, gw), case when abs(gt - time) <= tolerance then gt end as gauge_time,
 case when abs(gt - time) <= tolerance then gw end as gauge_wse from near n join tol using (lake_id)"""
CTE["offs"] = """select lake_id, coalesce(
  case when na > 0 then a1 else r1 end, case when na > 0 then a2 else r2 end, r2,
  mg - case when na > 0 then ma else mr end, 0) as bias from (
 select lake_id, count(wse_adjusted) na,
  quantile_cont(gauge_wse - wse_adjusted, 0.5) filter (where ice_clim_f < 1) a1, quantile_cont(gauge_wse - wse_adjusted, 0.5) a2,
  quantile_cont(gauge_wse - wse, 0.5) filter (where ice_clim_f < 1) r1, quantile_cont(gauge_wse - wse, 0.5) r2,
  quantile_cont(gauge_wse, 0.5) mg, quantile_cont(wse_adjusted, 0.5) ma, quantile_cont(wse, 0.5) mr
 from matched group by 1)"""
CTE["scored"] = "select m.*, gauge_wse - bias as gauge_corrected from matched m join offs using (lake_id)"
METH = [("Raw", "raw", "wse"), ("Stringent", "stringent", "wse_stringent"), ("Permissive", "permissive", "wse_permissive"),
        ("Filtered", "filtered", "wse_adjusted")]
CTE["mlong"] = " union all ".join(
    f"select lake_id, ice_clim_f, '{m}' as method, {c} as value, gauge_corrected as ref from scored" for m, _, c in METH)


def errors(src: str, keys: str) -> str:
    return f"""select {keys}, count(r) as n_match, count(r) filter (where abs(r) > 1e-7) as n_used,
  avg(abs(r)) filter (where abs(r) > 1e-7) as mae, quantile_cont(r, 0.5) filter (where abs(r) > 1e-7) as median_error
 from (select *, value - ref as r from {src}) group by {keys}"""


CTE["errs"] = errors("mlong", "lake_id, method")


def daily(cols: list[tuple[str, str]], src="lab") -> str:
    means = ", ".join(f"avg({c}) as {n}" for n, c in cols)
    sql = f"""with od as (select lake_id, date, {means}, avg(wse) as win from {src} group by 1, 2),
 gd as (select lake_id, cast(timestamp '2000-01-01' + to_seconds(cast(gauge_time as bigint)) as date) as date,
   avg(gauge_wse) as g from gauge group by 1, 2),
 ob as (select lake_id, min(date) o1, max(date) o2 from od where win is not null group by 1),
 gb as (select lake_id, min(date) g1, max(date) g2 from gd group by 1),
 span as (select lake_id, greatest(o1, g1) w1, least(o2, g2) w2, least(o1, g1) f1, greatest(o2, g2) f2
  from ob join gb using (lake_id) where greatest(o1, g1) <= least(o2, g2)),
 days as (select lake_id, w1, w2, cast(unnest(generate_series(f1, f2, interval 1 day)) as date) as date from span),
 d as (select days.*, {', '.join(n for n, _ in cols)}, g from days left join od using (lake_id, date) left join gd using (lake_id, date))"""
    names = [n for n, _ in cols] + ["g"]
    nb = ", ".join(
        f"""last_value(case when {n} is not null then date end ignore nulls) over b as {n}_pd, last_value({n} ignore nulls) over b as {n}_pv,
 first_value(case when {n} is not null then date end ignore nulls) over a as {n}_nd, first_value({n} ignore nulls) over a as {n}_nv"""
        for n in names)
    sql += f""", nb as (select lake_id, w1, w2, date, {', '.join(names)}, {nb} from d
  window b as (partition by lake_id order by date rows between unbounded preceding and current row),
  a as (partition by lake_id order by date rows between current row and unbounded following)),
 kept as (select * replace (case when g_pd >= w1 then g_pd end as g_pd, case when g_pd >= w1 then g_pv end as g_pv,
   case when g_nd <= w2 then g_nd end as g_nd, case when g_nd <= w2 then g_nv end as g_nv) from nb
  where date between w1 and w2 and not coalesce(g is null and date_diff('day', g_pd, g_nd) >= 90, false))"""
    lin = lambda n: f"""case when {n}_pd is null then {n}_nv when {n}_nd is null or {n}_pd = {n}_nd then {n}_pv
  else {n}_pv + ({n}_nv - {n}_pv) * (cast(date_diff('day', {n}_pd, date) as double) / date_diff('day', {n}_pd, {n}_nd)) end"""
    out = ", ".join(f"{lin(n)} as {n if n != 'g' else 'daily_gauge'}" for n in names)
    return sql + f" select lake_id, date, {out} from kept"


CTE["daily"] = daily([(f"daily_{s}", c) for _, s, c in METH])


def variab(c: str) -> str:
    return f"stddev_pop({c})", f"max({c}) - min({c})", f"quantile_cont({c}, 0.9) - quantile_cont({c}, 0.1)"


def corr(a: str, b: str) -> str:
    x, y = f"case when {b} is not null then {a} end", f"case when {a} is not null then {b} end"
    return (f"case when count({x}) >= 2 and stddev_pop({x}) * stddev_pop({y}) > 0 then "
            f"covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) end")


_agg, _guard = [], []
for _s in [s for _, s, _ in METH] + ["gauge"]:
    for _v, _e in zip(("std", "amp", "idr"), variab(f"daily_{_s}")):
        _agg.append(f"{_e} as {_v}_{_s}")
        _guard.append(f"{_v}_{_s}")
for _, _s, _ in METH:
    _agg.append(f"{corr(f'daily_{_s}', 'daily_gauge')} as corr_{_s}")
    _guard.append(f"corr_{_s}")
CTE["dm"] = f"""select lake_id, w1 as overlap_start, w2 as overlap_end, {', '.join(f"case when w2 - w1 >= 365 then {c} end as {c}" for c in _guard)}
 from (select lake_id, min(date) w1, max(date) w2, {', '.join(_agg)} from daily group by 1)"""
CTE["kept_var"] = f"""select lake_id, {', '.join(f'{e} as {v}_retained' for v, e in zip(('std', 'amp', 'idr'), variab('v')))}
 from (select lake_id, date, avg(wse_adjusted) as v from lab join dm using (lake_id)
  where overlap_end - overlap_start >= 365 and date between overlap_start and overlap_end and wse_adjusted is not null
  group by 1, 2) group by 1"""
CTE["ret"] = """select lake_id, count(*) filter (where filter_flag = 1) as retention_n, avg(filter_flag * 1e0) as retention_rate,
 avg(case when is_stringent then 1e0 else 0e0 end) as retention_stringent,
 avg(case when is_permissive then 1e0 else 0e0 end) as retention_permissive,
 avg(case when ice_clim_f = 2 then 1e0 else 0e0 end) as ice_duration,
 any_value(filter_attempt) as filter_attempt, any_value(p_ref_area) as lake_area from lab group by 1"""
_piv = ", ".join(f"max({c}) filter (where method = '{m}') as {c}_{s}" for c in ("n_match", "n_used", "mae", "median_error") for m, s, _ in METH)
CTE["stats"] = f"""select registry.lake_id, gauge_source, coalesce(filter_attempt, 'no data') as filter_attempt, lake_area,
 {', '.join(f'coalesce({c}_{s}, 0) as {c}_{s}' for c in ('n_match', 'n_used') for _, s, _ in METH)},
 {', '.join(f'{c}_{s}' for c in ('mae', 'median_error') for _, s, _ in METH)},
 {', '.join(_guard)}, std_retained, amp_retained, idr_retained,
 retention_n, retention_rate, retention_stringent, retention_permissive, ice_duration
 from registry left join ret using (lake_id) left join (select lake_id, {_piv} from errs group by 1) using (lake_id)
 left join dm using (lake_id) left join kept_var using (lake_id)"""


# ------------------------------------------------------------------ grids
def grid(base: str, midnight: bool = False) -> str:
    """Daily grid of table ``base`` (lake_id, time, wse), linear, flat ends."""
    end = (lambda x: f"floor({x} / 8.64e4) * 8.64e4") if midnight else (lambda x: x)
    return f"""with o as (select lake_id, {end('min(time)')} t0, {end('max(time)')} t1 from {base} group by 1),
 sp as (select lake_id, t0, cast(floor((t1 - t0) / 8.64e4) as bigint) k_last,
   unnest(generate_series(0, cast(floor((t1 - t0) / 8.64e4) as bigint))) as k from o),
 gg as (select *, t0 + k * 8.64e4 as g from sp),
 pv as (select gg.*, b.time as pt, b.wse as pv from gg asof left join {base} b on gg.lake_id = b.lake_id and gg.g >= b.time),
 nx as (select pv.*, b.time as nt, b.wse as nv from pv asof left join {base} b on pv.lake_id = b.lake_id and pv.g <= b.time)
 select lake_id, k, k_last, g, case when nt = g then nv when pt is null then nv when nt is null then pv
  else (nv - pv) / (nt - pt) * (g - pt) + pv end as y from nx"""


CTE["bs"] = "select lake_id, index_col, time, wse from ok where passes and xovr_cal_q < 2 and quality_f < 3"
CTE["grid"] = grid("bs")


def _weights(longest=21, order=3):
    """Smoothing matrices of every odd window the short-grid rule can pick."""
    rows = []
    for wl in range(5, longest + 1, 2):
        b = np.vander(np.arange(-(wl // 2), wl // 2 + 1) / (wl // 2), order + 1, increasing=True)
        hat = b @ np.linalg.pinv(b)
        rows += [f"({wl}, {i}, {j}, {float(hat[i, j]):.17e})" for i in range(wl) for j in range(wl)]
    return f"select * from (values {', '.join(rows)}) t(wl, i, j, w)"


CTE["sgw"] = _weights()
# row i of the weights applies to the window starting at s; interior rows use
# the centre row through lag / lead
def _centre(window=21, order=3):
    h = window // 2
    b = np.vander(np.arange(-h, h + 1) / h, order + 1, increasing=True)
    c = (b @ np.linalg.pinv(b))[h]
    return " + ".join(f"{float(c[h + j]):.17e} * lead(y, {j}) over w" if j > 0 else f"{float(c[h + j]):.17e} * lag(y, {-j}) over w"
                      for j in range(-h, h + 1))




def savgol(window=21, order=3, weights="sgw") -> str:
    h = window // 2
    return f"""select lake_id, k, k_last, g, y, case when k_last < {window} or k < {h} or k > k_last - {h} then e.curve else mid end as curve from (
 select *, {_centre(window, order)} as mid from grid window w as (partition by lake_id order by k)) left join (
 select a.lake_id, a.k, sum(w.w * n.y) as curve from (select *, case when k < wl // 2 then 0 when k > k_last - wl // 2 then k_last + 1 - wl else k - wl // 2 end as s
  from (select *, case when k_last >= {window} then {window} else k_last - k_last % 2 + 1 end as wl from grid) where (k_last < {window} or k < {h} or k > k_last - {h}) and wl <= k_last + 1) a
 join {weights} w on w.wl = a.wl and w.i = a.k - a.s join grid n on n.lake_id = a.lake_id and n.k = a.s + w.j group by 1, 2) e using (lake_id, k)"""


CTE["sg"] = savgol()
SWEEP = [(w, p) for p in (2, 3) for w in (11, 21, 31)]
CTE["sgw2"], CTE["sgw3"] = _weights(31, 2), _weights(31, 3)
for _i, (_w, _p) in enumerate(SWEEP):
    CTE[f"sw{_i}"] = savgol(_w, _p, f"sgw{_p}")
CTE["med"] = """select a.lake_id, a.k, a.k_last, a.g, a.y, quantile_cont(coalesce(n.y, 0), 0.5) as curve from
 (select grid.*, unnest(range(-10, 11)) as j from grid) a left join grid n on n.lake_id = a.lake_id and n.k = a.k + a.j
 where abs(a.j) <= case when a.k_last < 21 then (a.k_last + 1) // 2 else 10 end group by all"""


# Hampel day by day: ten values as left behind, the day itself and ten to come.
CTE["hgrid"] = grid("bs", midnight=True)
CTE["ham"] = """with recursive ys as (select lake_id, list(y order by k) as a, count(*) as n from hgrid group by 1),
 r as (select lake_id, 9::bigint as k, a[1:10] as prev, a[10] as curve from ys where n >= 21
  union all
  select lake_id, k, list_append(prev[2:10], v), v from (
   select lake_id, k, prev, case when mad > 0 and abs(y - med) > 3 * mad then med else y end as v from (
    select *, 1.4826e0 * list_median(list_transform(w, lambda x: abs(x - med))) as mad from (
     select *, list_median(w) as med from (
      select r.lake_id, r.k + 1 as k, prev, a[r.k + 2] as y, list_concat(prev, a[r.k + 2:r.k + 12]) as w
      from r join ys on ys.lake_id = r.lake_id where r.k + 1 < n - 10)))))
 select hgrid.lake_id, hgrid.k, g, coalesce(r.curve, y) as curve from hgrid left join r on r.lake_id = hgrid.lake_id and r.k = hgrid.k"""


def _wavelet_tables(bands: int = 5) -> None:
    """db4 bands ``wv`` by joins on mirrored places, then folded curves ``wr``."""
    taps = WAVELET_TAPS["db4"]
    reach = len(taps) - 1
    high = [w if j % 2 else -w for j, w in enumerate(taps)]
    down = ", ".join(f"({j}, {a!r}::double, {b!r}::double)" for j, (a, b) in enumerate(zip(taps[::-1], high)))
    up = ", ".join(f"({j}, {a!r}::double, {b!r}::double)" for j, (a, b) in enumerate(zip(taps, high[::-1])))
    steps = " + ".join(f"cast(k_last + 1 >= {reach * 2 ** b} as int)" for b in range(1, bands + 1))
    CTE["wv0"] = f"select lake_id, k, k_last + 1 as n, {steps} as steps, y as a from grid"
    for b in range(bands):
        CTE[f"wv{b + 1}"] = f"""select o.lake_id, i as k, o.n, o.steps, sum(lo * s.a) as a, sum(hi * s.a) as d from (
 select *, 2 * i + 1 - j as q from (select lake_id, n as len, (n + {reach}) // 2 as n, steps, unnest(range((n + {reach}) // 2)) as i
  from (select distinct lake_id, n, steps from wv{b} where steps > {b})), (values {down}) taps(j, lo, hi)) o
 join wv{b} s on s.lake_id = o.lake_id and s.k = case when q < 0 then -q - 1 when q >= len then 2 * len - 1 - q else q end group by 1, 2, 3, 4"""
    CTE["wvt"] = """select lake_id, m / 6.745e-1 * sqrt(2 * ln(n)) as cutoff from (select lake_id, quantile_cont(abs(d), 0.5) as m from wv1 group by 1)
 join (select distinct lake_id, n from wv0) using (lake_id)"""
    CTE[f"wr{bands}"] = f"select lake_id, k, a from wv{bands}"
    for b in range(bands - 1, -1, -1):
        CTE[f"wr{b}"] = f"""select lake_id, k, a from wv{b} where steps = {b} union all
 select o.lake_id, o.k, sum(lo * x.a + hi * x.d) as a from (select *, (k + {reach - 1} - j) // 2 as q from wv{b}, (values {up}) taps(j, lo, hi)
  where steps > {b} and k + {reach - 1} >= j and (k + {reach - 1} - j) % 2 = 0) o
 join (select r.lake_id, r.k, r.a, sign(d) * greatest(abs(d) - cutoff, 0) as d from wr{b + 1} r join wv{b + 1} w on w.lake_id = r.lake_id and w.k = r.k
  join wvt c on c.lake_id = r.lake_id) x on x.lake_id = o.lake_id and x.k = o.q group by 1, 2"""


_wavelet_tables()
CTE["wav"] = "select grid.lake_id, grid.k, g, a as curve from grid join wr0 r on r.lake_id = grid.lake_id and r.k = grid.k"


def _kalman_tables(steps: int = 10) -> None:
    """Local level by plain recursions: a filter forward, a smoother backward, an EM step, folded over the list of a lake."""
    CTE["kp0"] = "select lake_id, list(y order by k) as y, 1e0 as q, 1e0 as r, arg_min(y, k) as m0, 1e0 as p0 from grid group by 1"
    for i in range(steps + 1):
        mean, var = "a.m + (a.v + q) / (a.v + q + r) * (x.y - a.m)", "r * (a.v + q) / (a.v + q + r)"
        CTE[f"kf{i}"] = f"""select *, list_reduce(list_prepend({{'y': 0e0, 'm': m0, 'v': p0 - q, 't': []::struct(m double, v double)[]}},
 list_transform(y, lambda w: {{'y': w, 'm': 0e0, 'v': 0e0, 't': []::struct(m double, v double)[]}})),
 lambda a, x: {{'y': x.y, 'm': {mean}, 'v': {var}, 't': list_append(a.t, {{'m': {mean}, 'v': {var}}})}}).t as f from kp{i}"""
        last = i == steps  # only then the whole curve is kept
        back = "(x.m + x.v / (x.v + q) * (a.s - x.m))"
        rest = "(x.v + (x.v / (x.v + q)) ** 2 * (a.z - x.v - q))"
        CTE[f"kb{i}"] = f"""select *, list_reduce(list_transform(list_reverse(list_zip(f, y)), lambda w: {{'y': w[2], 'm': w[1].m, 'v': w[1].v, 's': w[1].m, 'z': w[1].v,
  'e': (w[2] - w[1].m) ** 2 + w[1].v, 'u': 0e0{", 't': [w[1].m]" if last else ""}}}), lambda a, x: {{'y': x.y, 'm': x.m, 'v': x.v, 's': {back}, 'z': {rest},
  'e': a.e + (x.y - {back}) ** 2 + {rest}, 'u': a.u + (a.s - {back}) ** 2 + a.z + {rest} - 2 * a.z * x.v / (x.v + q)
  {f", 't': list_append(a.t, {back})" if last else ""}}}) as b from kf{i}"""
        CTE[f"kp{i + 1}"] = f"""select lake_id, y, case when len(y) > 1 then b.u / (len(y) - 1) else q end as q, b.e / len(y) as r, b.s as m0, b.z as p0 from kb{i}"""
    CTE["kal"] = f"""select grid.lake_id, grid.k, g, kb{steps}.b.t[len(kb{steps}.y) - grid.k] as curve from grid join kb{steps} on kb{steps}.lake_id = grid.lake_id"""


_kalman_tables()


def at_times(curve: str, rounded: bool = True) -> str:
    """Linear evaluation of a grid curve at the baseline's times."""
    value = "coalesce((nx.curve - c.curve) * ((b.time - c.g) / 8.64e4) + c.curve, c.curve)"
    return f"""select b.lake_id, b.index_col, {r6(value) if rounded else value} as smooth
 from bs b asof join {curve} c on b.lake_id = c.lake_id and b.time >= c.g left join {curve} nx on nx.lake_id = c.lake_id and nx.k = c.k + 1"""


def best_residual(curves: list[str], observed: str) -> str:
    """Signed curve minus value of smallest size, the first of equals."""
    size = [f"coalesce(abs({c} - {observed}), 'inf'::double)" for c in curves]
    least = f"least({', '.join(size)})"
    return "case " + " ".join(f"when {s} = {least} then {c} - {observed}" for s, c in zip(size, curves)) + " end"


_c = [f"c{i}" for i in range(len(SWEEP))]
CTE["sweep"] = "select b.lake_id, b.index_col, b.wse, " + ", ".join(f"e{i}.smooth as c{i}" for i in range(len(SWEEP))) + " from bs b " + " ".join(
    f"left join ({at_times(f'sw{i}', False)}) e{i} on e{i}.lake_id = b.lake_id and e{i}.index_col = b.index_col" for i in range(len(SWEEP)))
SWEEP_SQL = f"""select lake_id, index_col, {r6(f"least({', '.join(_c)})")} as bottom, {r6(f"greatest({', '.join(_c)})")} as top,
 {r6(best_residual(_c, 'wse'))} as residual from sweep"""


def _line(source: str) -> str:
    """Local line at each point of ``source`` from weighted neighbours (d, w, y)."""
    return f"""select lake_id, index_col, f, any_value(v) as v, any_value(po) as o, case when sum(w) > 0 then
  sum(w * y) / sum(w) - sum(w * d) / sum(w) * ((sum(w * d * y) / sum(w) - sum(w * d) / sum(w) * (sum(w * y) / sum(w)))
   / greatest(sum(w * d * d) / sum(w) - (sum(w * d) / sum(w)) ** 2, 1e-12)) end as fit from {source} group by 1, 2, 3"""


# Local lines over every fraction: neighbours by ordinal, tricube weights, one round of robustness weights.
CTE["lob"] = """select lake_id, index_col, (time - min(time) over l) / 8.64e4 as x, wse as y,
 row_number() over (partition by lake_id order by time) - 1 as o, count(*) over l as n from bs window l as (partition by lake_id)"""
CTE["lok"] = """select distinct lake_id, f, least(n, greatest(1, cast(floor((case when f = 4 then 5e-1 else 1e-1 + f * ((5e-1 - 1e-1) / 4) end) * n + 1e-10) as bigint))) as k
 from lob, range(5) r(f) where n >= 3"""
CTE["lom"] = """select a.lake_id, f, a.o as j, (a.x + c.x) / 2 as mid from lob a join lok using (lake_id) join lob c on c.lake_id = a.lake_id and c.o = a.o + k"""
CTE["low"] = """select p.lake_id, p.index_col, p.f, p.k, p.x as a, p.y as v, p.o as po, coalesce(m.j + 1, 0) as i from (select * from lob join lok using (lake_id)) p
 asof left join lom m on p.lake_id = m.lake_id and p.f = m.f and p.x > m.mid"""
CTE["lon"] = """select low.lake_id, low.index_col, low.f, v, po, c.o, c.x - a as d, c.y, (1 - least(abs(c.x - a) / nullif(greatest(a - s.x, e.x - a), 0), 1) ** 3) ** 3 as t
 from low join lob s on s.lake_id = low.lake_id and s.o = i join lob e on e.lake_id = low.lake_id and e.o = i + k - 1
 join lob c on c.lake_id = low.lake_id and c.o between i and i + k - 1"""
CTE["lo0"] = _line("(select *, t as w from lon)")
CTE["lor"] = """select lake_id, f, o, case when fit is null then 0 when m = 0 then (case when abs(v - fit) > 0 then 0 else 1 end)
 else (1 - least(abs(v - fit) / (6 * m), 1) ** 2) ** 2 end as rw from lo0 join (select lake_id, f, quantile_cont(abs(v - fit), 0.5) as m from lo0 group by 1, 2) using (lake_id, f)"""
CTE["lo1"] = _line("(select lon.*, t * rw as w from lon join lor using (lake_id, f, o))")
LOWESS_SQL = f"""select bs.lake_id, bs.index_col, {r6('lo')} as bottom, {r6('hi')} as top, {r6('best')} as residual from bs left join (
 select lake_id, index_col, min(fit) as lo, max(fit) as hi, arg_min(fit - v, {{'s': abs(fit - v), 'it': it, 'f': f}}) filter (where fit is not null) as best
 from (select *, 0 as it from lo0 union all select *, 1 from lo1) group by 1, 2) using (lake_id, index_col)"""


# Least-squares cubic by polynomials orthogonal over a lake's own times.
CTE["cubic"] = """with x as (select lake_id, index_col, wse as y,
  2 * (time - min(time) over l) / nullif(max(time) over l - min(time) over l, 0) - 1 as x, count(*) over l as n from bs window l as (partition by lake_id)),
 p1 as (select *, x - avg(x) over l as p1 from x window l as (partition by lake_id)),
 p2 as (select *, x * p1 - sum(x * p1 * p1) over l / sum(p1 * p1) over l * p1 - sum(p1 * p1) over l / n as p2 from p1 window l as (partition by lake_id)),
 p3 as (select *, x * p2 - sum(x * p2 * p2) over l / sum(p2 * p2) over l * p2 - sum(p2 * p2) over l / sum(p1 * p1) over l * p1 as p3
  from p2 window l as (partition by lake_id)),
 f as (select *, avg(y) over l + sum(y * p1) over l / sum(p1 * p1) over l * p1 + sum(y * p2) over l / sum(p2 * p2) over l * p2
  + sum(y * p3) over l / sum(p3 * p3) over l * p3 as f from p3 window l as (partition by lake_id))
 select lake_id, index_col, coalesce(n > 3 and sum((y - f) ** 2) over (partition by lake_id) <= 1e6, false) as spline_ok, f from f"""


def sql(*names: str, body: str) -> str:
    """WITH the named tables and everything before them that they may need."""
    need: list[str] = []

    def add(n):
        for m in CTE:
            if m != n and m not in need and _mentions(CTE[n], m):
                add(m)
        if n not in need:
            need.append(n)

    for n in names:
        add(n)
    head = "with " + ",\n".join(f"{n} as materialized ({CTE[n]})" for n in need)
    return f"{head},\n{body[5:]}" if body.startswith("with ") else f"{head}\n{body}"


def _mentions(text: str, name: str) -> bool:
    import re

    return re.search(rf"(?:from|join)\s+{name}\b", text) is not None
