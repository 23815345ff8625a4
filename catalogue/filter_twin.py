"""SQL twin of the iterated filter: its steps unrolled to the fixpoint on the data.

A series that a step leaves as it is has finished and is carried along; its number of
iterations is where its row count stops falling. Savgol
curve, evaluation on the baseline; the lenient attempt takes the series that the
strict one leaves, the Tukey fallback what both leave.
"""

from __future__ import annotations

import re

from catalogue import duck
from catalogue.duck import r6
from catalogue.queries import _ADJUST, _COV, _STEP, ORACLE

ROUND1, ROUND2 = 11, 5  # steps until no series of the test data changes; the second is the filter's own cap
_ENOUGH = "n_rows >= 365 / 9e1 + 1"
_STRICT_OK = f"{_ENOUGH} and not coalesce(max_gap > 90 * 8.64e4, false) and t_last - t_first >= 365 * 8.64e4"


def _step(tag: str, cand: str, base: str, z: str, spread: str, lenient: bool) -> str:
    """Registers base, grid and curve of one step; returns the query of its survivors."""
    duck.CTE[f"fb{tag}"] = f"select lake_id, index_col, time, wse from {cand} where {base}"
    duck.CTE[f"fg{tag}"] = duck.grid(f"fb{tag}")
    duck.CTE[f"fs{tag}"] = re.sub(r"\bgrid\b", f"fg{tag}", duck.CTE["sg"])
    rows = f"select * from {cand}"
    if lenient:  # rows strictly inside a long gap of the base are left out
        rows = f"""select c.* exclude (gap_a) from (select c.*, a.time as gap_a from {cand} c asof left join fb{tag} a
 on c.lake_id = a.lake_id and c.time >= a.time) c asof left join fb{tag} b on c.lake_id = b.lake_id and c.time <= b.time
 where not coalesce(c.time > gap_a and c.time < b.time and b.time - gap_a > 90 * 8.64e4, false)"""
    body = _STEP.replace("(select * from ok where passes) u", f"({rows}) u")
    body = re.sub(r"\bbs\b", f"fb{tag}", re.sub(r"\bsg\b", f"fs{tag}", body))
    if lenient:
        body = body.replace(_STRICT_OK, _ENOUGH)
    return body.replace("2.576 * s", f"{z} * s").replace("7e-2 * rng", f"{spread} * rng")


def _iterations(prefix: str, n: int) -> str:
    """Per lake: the first step that removed nothing, the last one if there is none."""
    counts = " union all ".join(f"select lake_id, {i} as i, count(*) as n from {prefix}{i} group by 1" for i in range(n + 1))
    return f"""select lake_id, coalesce(min(i) filter (where n >= before), {n}) as n_steps from (
 select *, lag(n) over (partition by lake_id order by i) as before from ({counts})) group by 1"""


def _attempt(x: str, ok: str, name: str, lenient: bool, only: str = "true") -> None:
    """Registers {x}kept: lake_id, index_col, filter_attempt, n_while, n_while_r2 of one attempt."""
    supported = lambda rows: f"(select lake_id from ({_COV.format(src=rows)}) where {_ENOUGH if lenient else _STRICT_OK})"
    cte, alive_in = duck.CTE, lambda q: f"(lake_id, index_col) in (select (lake_id, index_col) from ({q}))"
    def going(prefix, i):
        """Lakes that the step before changed; the others stay as they are."""
        if i == 1:
            return "true"
        return f"""lake_id in (select lake_id from (select lake_id, count(*) as n from {prefix}{i - 1} group by 1)
 join (select lake_id, count(*) as m from {prefix}{i - 2} group by 1) using (lake_id) where n < m)"""

    cte[f"{x}r0"] = f"select * from {ok} where passes and {only}"
    for i in range(1, ROUND1 + 1):
        cte[f"{x}ra{i}"] = f"select * from {x}r{i - 1} where {going(f'{x}r', i)}"
        alive = _step(f"{x}a{i}", f"{x}ra{i}", "xovr_cal_q < 2 and quality_f < 3", "2.576", "7e-2", lenient)
        cte[f"{x}r{i}"] = f"select * from {x}r{i - 1} where not ({going(f'{x}r', i)}) or {alive_in(alive)}"
    cte[f"{x}lock"] = f"select * from {x}r{ROUND1} where lake_id in {supported(f'{x}r{ROUND1}')}"
    locked, best = alive_in(f"select * from {x}lock"), "quality_f = 0 and xovr_cal_q = 0 and ice_clim_f = 0"
    cte[f"{x}h0"] = f"select * from {ok} where lake_id in (select lake_id from {x}lock) and ({locked} or (passes and {best}))"
    for i in range(1, ROUND2 + 1):
        cte[f"{x}ha{i}"] = f"select * from {x}h{i - 1} where {going(f'{x}h', i)}"
        alive = _step(f"{x}b{i}", f"{x}ha{i}", "true", "3.5e0", "5e-2", lenient)
        cte[f"{x}h{i}"] = f"""select * from {x}h{i - 1} where not ({going(f'{x}h', i)})
 or (lake_id in {supported(f'fb{x}b{i}')} and ({locked} or {alive_in(alive)}))"""
    cte[f"{x}n1"], cte[f"{x}n2"] = _iterations(f"{x}r", ROUND1), _iterations(f"{x}h", ROUND2)
    cte[f"{x}kept"] = f"""select k.lake_id, k.index_col, '{name}' as filter_attempt, a.n_steps as n_while, b.n_steps as n_while_r2
 from {x}h{ROUND2} k join {x}n1 a using (lake_id) join {x}n2 b using (lake_id) where k.lake_id in {supported(f'{x}h{ROUND2}')}"""


def register_twins() -> None:
    _attempt("q", "ok", "1_strict", False)
    ORACLE["filter_strict"] = duck.sql("qkept", body="select * from qkept")
    _attempt("v", "okl", "2_lenient", True, "lake_id not in (select lake_id from qkept)")
    duck.CTE["fall"] = """select * from qkept union all select * from vkept union all
 select lake_id, index_col, '3_tukey', max(n_steps) over (partition by lake_id), -2 from w5
 where lake_id not in (select lake_id from qkept) and lake_id not in (select lake_id from vkept)"""
    duck.CTE["fret"] = "select u.* from u join fall using (lake_id, index_col)"
    duck.CTE["fadj"] = re.sub(r"\bu\b", "fret", _ADJUST)
    duck.CTE["fmeta"] = """select lake_id, coalesce(any_value(filter_attempt), '4_none') as filter_attempt, coalesce(any_value(n_while), 0) as n_while,
 coalesce(any_value(n_while_r2), 0) as n_while_r2 from (select distinct lake_id from u) left join fall using (lake_id) group by 1"""
    ORACLE["filter_hierarchy"] = duck.sql("p", "fmeta", "fadj", body=f"""select p.lake_id, p.index_col, case when a.index_col is null then 0 else 1 end as filter_flag,
 {r6('a.wse_adjusted')} as wse_adjusted, filter_attempt, n_while, n_while_r2, coalesce(c.changed, 0) as intra_cycle_flag
 from p left join fadj a using (lake_id, index_col) left join fmeta using (lake_id)
 left join (select lake_id, max(case when wse <> wse_adjusted then 1 else 0 end) as changed from fadj group by 1) c using (lake_id)""")


register_twins()
