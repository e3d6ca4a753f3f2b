"""Queries for axes, vetoes, audits of the universe and tests of robustness, with checking SQL. They join those of demos.py."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pitwright.functions import exprs as X
from pitwright.operators import pit, universe, vetoes, xsec
from pitwright.plans import axes, portfolio, robustness
from pitwright.plans.demos import _LAGS, _RET, _SUMS, _ZPANEL, demo, ORACLE, r, returns, table, zpanel
from pitwright.sources.files import written
from pitwright.sources.roles import for_checking, role

_FUND = "revenue_ttm cogs_ttm op_income_ttm net_income_ttm cfo_ttm capex_ttm dep_ttm inventory receivable payable assets equity ppe payroll liabilities employees".split()

_FP = f"""(select a.code, a.month, px as close, amount as adv20, net_flow, industry, bucket, {", ".join(_FUND)} from (select p.*, s.industry, case when s.employees >= 500 then 'big' else 'small' end as bucket from ({{panel}}) p join ({{security}}) s on s.code = p.code) a
 asof left join ({{fund}}) f on a.code = f.code and a.month >= f.knowledge_date)"""


def fpanel(spark, sf):
    """The panel with industry, size, and the newest statements knowable at each month's end."""
    s = role(spark, sf, "security").select("code", "industry", F.when(F.col("employees") >= 500, "big").otherwise("small").alias("bucket"))
    p = role(spark, sf, "panel").join(s, "code").select("code", "month", F.col("px").alias("close"), F.col("amount").alias("adv20"), "net_flow", "industry", "bucket")
    return pit.asof_join(p, role(spark, sf, "fund"), "code", "month", "knowledge_date", _FUND, ["period_end"])


def rounded(df, keys: list[str], columns: list[str], n: int = 4):
    return df.select(*keys, *(r(c, n).alias(c) for c in columns))


def _div(a: str, b: str) -> str:
    return f"case when abs({b}) > 1e-12 then ({a}) / ({b}) end"


def _dlog(a: str, b: str) -> str:
    return f"case when {a} > 0 and {b} > 0 then ln({a}) - ln({b}) end"


def _r(*columns: str, n: int = 4) -> str:
    return ", ".join(f"round({c}, {n}) as {c}" for c in columns)


_W = "window w as (partition by code order by month)"
_B = f"""(select *, turn_days - lag(turn_days, 12) over w as d_turn, accruals - lag(accruals, 12) over w as d_accruals, {_dlog("revenue_ttm", "lag(revenue_ttm, 12) over w")} as dlog_rev,
 case when count(gpm) over v >= 6 and count(gpm) over v = count(*) over v then regr_slope(gpm, rn) over v end as b1
 from (select *, dio + dso as turn_days, {_div("net_income_ttm - cfo_ttm", "(assets + lag(assets, 12) over w) / 2")} as accruals from (select *, row_number() over w as rn, {_div("revenue_ttm - cogs_ttm", "revenue_ttm")} as gpm, 365 * {_div("inventory", "cogs_ttm")} as dio, 365 * {_div("receivable", "revenue_ttm")} as dso
 from {_FP} a {_W}) b {_W}) c window w as (partition by code order by month), v as (partition by code order by month rows between 11 preceding and current row))"""


@demo(f"select code, month, {_r('gpm', 'turn_days', 'd_turn', 'dlog_rev', 'accruals', 'd_accruals')}, round(b1, 6) as b1 from {_B} d")
def axis_b(spark, sf):
    f = axes.quality_features(fpanel(spark, sf).withColumn("contract_liab", F.lit(None).cast("double")))
    return f.select("code", "month", *(r(c).alias(c) for c in ("gpm", "turn_days", "d_turn", "dlog_rev", "accruals", "d_accruals")), r("b1", 6).alias("b1"))


_C = f"""(select *, {_dlog("ic", "lag(ic, 12) over w")} as dlog_ic, roic - lag(roic, 12) over w as d_roic, va - lag(va, 12) over w as d_va, {_dlog("employees", "lag(employees, 12) over w")} as dlog_emp from
 (select *, {_div("op_income_ttm * 0.78", "(ic + lag(ic, 12) over w) / 2")} as roic, {_div("coalesce(op_income_ttm, 0) + coalesce(payroll, 0) + coalesce(dep_ttm, 0)", "employees")} as va, {_div("abs(capex_ttm)", "abs(dep_ttm)")} as c3, {_div("liabilities", "equity")} as debt_ratio from
 (select *, coalesce(receivable, 0) + coalesce(inventory, 0) - coalesce(payable, 0) + coalesce(ppe, 0) as ic from {_FP} a) b {_W}) c {_W})"""


@demo(f"select code, month, {_r('dlog_ic', 'roic', 'd_roic', 'd_va', 'dlog_emp', 'c3', 'debt_ratio')} from {_C} d")
def axis_c(spark, sf):
    f = axes.resource_features(fpanel(spark, sf).withColumn("intangible", F.lit(None).cast("double")))
    f = f.withColumnsRenamed({"dlog_IC": "dlog_ic", "ROIC": "roic", "d_ROIC": "d_roic", "d_va_per_emp": "d_va"})
    return rounded(f, ["code", "month"], ["dlog_ic", "roic", "d_roic", "d_va", "dlog_emp", "c3", "debt_ratio"])


_FLOW = "(select code, last_day(day) as month, max_by(c, day) as cum120 from (select *, case when count(net_flow) over v >= 40 then sum(net_flow) over v end as c from ({daily}) d window v as (partition by code order by day rows between 119 preceding and current row)) e group by code, last_day(day))"
_D = f"""(select p.*, dlog_p - dlog_e as dlog_m, -{_div("cum120", "adv20 * 250")} as d3 from (select *, {_dlog("net_income_ttm", "lag(net_income_ttm, 6) over w")} as dlog_e, {_dlog("close", "lag(close, 6) over w")} as dlog_p from {_FP} a {_W}) p left join {_FLOW} f on f.code = p.code and f.month = p.month)"""


def dpanel(spark, sf):
    return axes.reflection_features(fpanel(spark, sf).join(axes.net_flow_120(role(spark, sf, "daily")), ["code", "month"], "left"))


@demo(f"""select code, month, round(-dlog_m, 4) as d1, round(d3, 9) as d3, case when dlog_e > 0 and dlog_m <= 0 then 'neglect' when dlog_e > 0 and dlog_m > 0 then 'growth' when dlog_e <= 0 and dlog_m > 0 then 'hope' else 'decline' end as state from {_D} d""")
def axis_d(spark, sf):
    return dpanel(spark, sf).select("code", "month", r("d1").alias("d1"), r("d3", 9).alias("d3"), F.col("D_state").alias("state"))


# a checking engine's ladder: each step adds columns to the query before


def _sql_cells(src: str) -> str:
    for c0, coarser in (("c0", "l2"), ("c1", "l3")):
        made = "c1" if c0 == "c0" else "cell"
        src = f"(select *, case when count(*) over (partition by {c0}) < 8 then {coarser} else {c0} end as {made} from {src} {c0}_)"
    return src


def _labelled(src: str) -> str:
    return _sql_cells(f"(select *, strftime(month, '%Y%m') as l3, strftime(month, '%Y%m') || '|' || industry as l2, strftime(month, '%Y%m') || '|' || industry || '|' || bucket as c0 from {src} lab)")


def _sql_z(src: str, x: str, out: str) -> str:
    for k, cell in enumerate(("cell", "l2", "l3")):
        over = f"over (partition by {cell})"
        src = f"(select *, avg({x}) {over} as m_, stddev_pop({x}) {over} as s_, count({x}) {over} as n_ from {src} z1)"
        src = f"(select *, case when {x} is not null then least(greatest({x}, m_ - 2 * s_), m_ + 2 * s_) end as c_ from {src} z2)"
        src = f"(select *, avg(c_) {over} as m2_, stddev_pop(c_) {over} as s2_ from {src} z3)"
        src = f"(select * exclude (m_, s_, n_, c_, m2_, s2_), case when n_ >= 8 and {x} is not null then case when s2_ > 1e-12 then (c_ - m2_) / s2_ else 0 end end as {out}_{k} from {src} z4)"
    return f"(select * exclude ({out}_0, {out}_1, {out}_2), coalesce({out}_0, {out}_1, {out}_2) as {out} from {src} z5)"


def _sql_rank(src: str, x: str, out: str, cells: tuple[str, ...] = ("cell", "l2", "l3"), least: int = 8) -> str:
    for k, cell in enumerate(cells):
        src = f"(select *, case when {x} is not null and count({x}) over (partition by {cell}) >= {least} then (rank() over (partition by {cell} order by {x} nulls last) + (count(*) over (partition by {cell}, {x}) - 1) / 2) / count({x}) over (partition by {cell}) end as {out}_{k} from {src} r1)"
    made = ", ".join(f"{out}_{k}" for k in range(len(cells)))
    return f"(select * exclude ({made}), coalesce({made}) as {out} from {src} r2)"


def scored_panel(spark, sf):
    """The panel with axes x and y (rounded, so that ties are ties in any engine), U and VETO. Written once, with the columns that scores and
    folds use: what stands on it reads it several times, and writes its columns again at each step."""
    made = {"E_X": r(F.log("adv20"), 6), "E_Y": r(F.log("revenue_ttm"), 6), "E_Z": r("d1", 6), "U": r(F.rint(F.pmod("code", F.lit(7)).cast("double")) / 7, 6), "VETO": F.when(F.pmod("code", F.lit(5)) == 0, 0).otherwise(1)}
    p = dpanel(spark, sf).withColumns(made).select("code", "month", "industry", "bucket", "adv20", *made)
    return xsec.cells(written(p), "month", "industry", "bucket")


def _score_sql(names: list[str]) -> str:
    q = _labelled(f"(select *, round(ln(adv20), 6) as e_x, round(ln(revenue_ttm), 6) as e_y, round(-dlog_m, 6) as e_z, round((code % 7) / 7, 6) as u, case when code % 5 = 0 then 0 else 1 end as veto from {_D} s0)")
    for e in names:
        q = _sql_rank(_sql_z(q, e, f"z_{e}"), e, f"p_{e}")
    n = " + ".join(f"(z_{e} is not null)::int" for e in names)
    total = " + ".join(f"coalesce(z_{e}, 0)" for e in names)
    ok, bad = (" + ".join(f"coalesce(p_{e} {op} 0.5, false)::int" for e in names) for op in (">=", "<"))
    q = f"(select *, case when {n} > 0 then ({total}) / ({n}) end as e_raw, case when ({bad}) = 0 and ({ok}) >= 2 then 1 else 0 end as floor_ from {q} s1)"
    return _sql_rank(q, "e_raw", "e")


_SIGNAL = f"(select *, coalesce(e, 0) * u * veto * floor_ as signal, (e_x is not null)::int || '' || (e_y is not null)::int || (e_z is not null)::int as pack_profile, (e_x is not null)::int + (e_y is not null)::int + (e_z is not null)::int as n_axes from {_score_sql(['e_x', 'e_y', 'e_z'])} s2)"
_SCORED = _sql_rank(_SIGNAL, "signal", "signal_rank", ("month",), 1)


@demo(f"select code, month, round(e_raw, 4) as e_raw, cast(floor_ as int) as passes, pack_profile, n_axes, round(signal, 4) as signal, round(signal_rank, 4) as signal_rank from {_SCORED} s3")
def score(spark, sf):
    p = scored_panel(spark, sf)
    s = axes.score(p, axes.live_axes(p, ["E_X", "E_Y", "E_Z"]))
    return s.select("code", "month", r("E_raw").alias("e_raw"), F.col("FLOOR").alias("passes"), "pack_profile", "n_axes", r("Signal").alias("signal"), r("Signal_rank").alias("signal_rank"))


@demo(f"select 'E_X' as axis, round(avg((e_x is not null)::int), 6) as coverage from {_D} d0 cross join lateral (select ln(adv20) as e_x) l union all select 'E_Y', round(avg((revenue_ttm > 0 is true)::int), 6) from {_D} d1 union all select 'E_Z', round(avg((dlog_m is not null)::int), 6) from {_D} d2 union all select 'E_NONE', 0.0")
def axis_liveness(spark, sf):
    from pitwright.operators import audits

    p = scored_panel(spark, sf).withColumn("E_NONE", F.lit(None).cast("double"))
    names = ["E_X", "E_Y", "E_Z", "E_NONE"]
    live = axes.live_axes(p, names)  # E_NONE isn't
    shown = audits.axis_coverage(p, names, names)
    return shown.select("axis", F.when(F.col("axis").isin(live), r("coverage", 6)).otherwise(0.0).alias("coverage"))


_UZ = _sql_z(_sql_z(_labelled(f"(select *, round(-dlog_m, 6) as d1 from {_D} u0)"), "d1", "z1"), "d3", "z3")
_U = f"(select *, case when z1 is not null or z3 is not null then (coalesce(z1, 0) + coalesce(z3, 0)) / ((z1 is not null)::int + (z3 is not null)::int) end as u_raw from {_UZ} u1)"


@demo(f"select code, month, round(u_raw, 4) as u_raw, (z1 is not null)::int + (z3 is not null)::int as used, round(u, 3) as u from {_sql_rank(_U, 'u_raw', 'u')} u2")
def u_score(spark, sf):
    p = xsec.cells(dpanel(spark, sf).withColumn("d1", r("d1", 6)), "month", "industry", "bucket")
    u = axes.u_score(p, ("d1", "d3"))
    return u.select("code", "month", r("U_raw").alias("u_raw"), F.col("U_axes_used").alias("used"), r("U", 3).alias("u"))


def _chain(src: str, *columns: str) -> str:
    for c in columns:
        src = _sql_z(src, c, f"z_{c}")
    return src


def _mean(*cs: str) -> str:
    n = " + ".join(f"({c} is not null)::int" for c in cs)
    return f"case when {n} > 0 then ({' + '.join(f'coalesce({c}, 0)' for c in cs)}) / ({n}) end"


@demo(f"""select code, month, round(tp1, 4) as tp_b1, round(tp2, 4) as tp_b2, round(0.5 * {_mean("tp1", "tp2")} + 0.5 * z_b1, 4) as e_axb from (select *, z_dlog_rev * -z_d_turn as tp1, z_dlog_rev * -z_d_accruals as tp2 from {_chain(_labelled(_B), "dlog_rev", "d_turn", "d_accruals", "b1")} t) u""")
def tp_scores(spark, sf):
    f = axes.quality_features(fpanel(spark, sf).withColumn("contract_liab", F.lit(None).cast("double")))
    return axes.quality_axis(xsec.cells(f, "month", "industry", "bucket")).select("code", "month", r("TP_B1").alias("tp_b1"), r("TP_B2").alias("tp_b2"), r("E_AXB").alias("e_axb"))


@demo(f"""select code, month, round(tp1, 4) as tp_c1, round(tp2, 4) as tp_c2, round(0.5 * {_mean("tp1", "tp2")} + 0.5 * z_c3, 4) as e_axc from (select *, z_dlog_ic * z_d_roic as tp1, z_dlog_emp * z_d_va as tp2 from {_chain(_labelled(_C), "dlog_ic", "d_roic", "dlog_emp", "d_va", "c3")} t) u""")
def tp_resources(spark, sf):
    f = axes.resource_features(fpanel(spark, sf).withColumn("intangible", F.lit(None).cast("double")))
    return axes.resource_axis(xsec.cells(f, "month", "industry", "bucket")).select("code", "month", r("TP_C1").alias("tp_c1"), r("TP_C2").alias("tp_c2"), r("E_AXC").alias("e_axc"))


@demo(f"""with t as (select z_dlog_rev * -z_d_turn as a, z_dlog_rev * -z_d_accruals as b from {_chain(_labelled(_B), "dlog_rev", "d_turn", "d_accruals")} t0), n as (select count(*) as n from t)
 select 'TP_B1' as product, count(a) as n, round(avg(a), 4) as mean, count(*) filter (a > 1) as fired, round(count(*) filter (a > 1) / max(n.n), 6) as share from t, n union all select 'TP_B2', count(b), round(avg(b), 4), count(*) filter (b > 1), round(count(*) filter (b > 1) / max(n.n), 6) from t, n""")
def tp_fire_stats(spark, sf):
    from pitwright.operators import audits

    f = axes.quality_features(fpanel(spark, sf).withColumn("contract_liab", F.lit(None).cast("double")))
    t = audits.fired_products(axes.quality_axis(xsec.cells(f, "month", "industry", "bucket")), ["TP_B1", "TP_B2"])
    return t.select("product", "n", r("mean").alias("mean"), "fired", r("share", 6).alias("share"))


_V = f"""(select *, d_rev > 0 and abs(d_rev) > 1e-12 and (coalesce(inventory - lag(inventory, 12) over w, 0) + coalesce(receivable - lag(receivable, 12) over w, 0)) / d_rev > 1.5 as bad1,
 sum(dilution) over (partition by code order by month rows between 2 preceding and current row) > 0 as bad3, n1 > quantile_cont(n1, 0.9) over (partition by month) and d_eff_tax < -0.03 as bad8 from
 (select *, revenue_ttm - lag(revenue_ttm, 12) over w as d_rev, case when code % 6 = month(month) % 6 and net_flow < 0 then 1 else 0 end as dilution, case when code % 4 <> 1 then floor(adv20 / 100) end as n1, (code % 9 - 5) / 50 as d_eff_tax from {_FP} a {_W}) b {_W})"""
_VS = f"""(select code, month, case when bad1 then 0 else 1 end as v1, case when code % 5 <> 2 and month(month) % 4 >= 2 then 0 else 1 end as v2, case when bad3 then 0 else 1 end as v3, case when equity <= 0 or code % 29 = 3 then 0 else 1 end as v5,
 case when adv20 >= 50000 and close > 0 then 1 else 0 end as v6, case when code % 8 <> 6 and (code % 50) / 50 < 0.05 then 0 else 1 end as v7, case when bad8 then 0 else 1 end as v8 from {_V} c)"""


def vetoed(spark, sf):
    k, m = F.col("code"), F.month("month")
    p = fpanel(spark, sf).withColumns(
        {
            "dilution": F.when((k % 6 == m % 6) & (F.col("net_flow") < 0), 1).otherwise(0), "bad_3q": F.when(k % 5 != 2, m % 4 - 1), "sim_risk_pct": F.when(k % 8 != 6, (k % 50) / 50),
            "n1": F.when(k % 4 != 1, F.floor(F.col("adv20") / 100).cast("double")), "d_eff_tax": (k % 9 - 5) / 50,
        }
    )
    return vetoes.vetoes(p, 50_000, role(spark, sf, "security").where("code % 29 = 3").select("code"))


@demo(f"select *, v1 * v2 * v3 * v5 * v6 * v7 * v8 as veto from {_VS} d")
def vetoes_table(spark, sf):
    return vetoed(spark, sf).select("code", "month", *(F.col(f"V{k}").alias(f"v{k}") for k in (1, 2, 3, 5, 6, 7, 8)), F.col("VETO").alias("veto"))


@demo(" union all ".join(f"select 'V{k}' as rule, {'count(*) * 0' if k == 4 else f'count(*) filter (v{k} = 0)'} as n, round({'avg(0.0)' if k == 4 else f'avg((v{k} = 0)::int)'}, 6) as share from {_VS} d{k}" for k in range(1, 9)))
def veto_fired(spark, sf):
    return vetoes.fired(vetoed(spark, sf)).select("rule", "n", r("share", 6).alias("share"))


@demo(f"select code, month, round(case when code % 7 > 0 and (code % 7) / 7 >= 0.5 then adv20 end, 2) as kept from {_FP} a")
def theta_gate(spark, sf):
    p = fpanel(spark, sf).withColumn("theta", F.when(F.col("code") % 7 > 0, (F.col("code") % 7) / 7))
    return p.select("code", "month", r(vetoes.pack_gate("adv20", "theta"), 2).alias("kept"))


_Q = """(select *, sign(target - lag(target) over (partition by code, analyst order by pub_date, uid)) as rev from ({reports}) q)"""


@demo(f"""select code, month, n_analyst, round(tp_median, 4) as tp_median, rev_up::bigint as rev_up, rev_dn::bigint as rev_dn, round(-rev_up / n_analyst, 6) as d2, -(n_analyst - lag(n_analyst) over (partition by code order by month)) as d4 from
 (select code, month, count(distinct analyst) as n_analyst, median(target) as tp_median, sum(case when rev > 0 then 1 else 0 end) as rev_up, sum(case when rev < 0 then 1 else 0 end) as rev_dn from
 (select *, unnest([last_day(pub_date), last_day(last_day(pub_date) + interval 1 day), last_day(last_day(pub_date) + interval 32 day), last_day(last_day(pub_date) + interval 63 day)]) as month from {_Q} a) b where pub_date > month - interval 90 day group by code, month) c""")
def consensus_signals(spark, sf):
    c = axes.consensus(role(spark, sf, "reports"))
    return c.select("code", "month", "n_analyst", r("tp_median").alias("tp_median"), "rev_up", "rev_dn", r("d2", 6).alias("d2"), "d4")


_AWARDED = """(select code, month, cast(month + interval 15 day as date) as known, sum(a) as award, sum(rr) / sum(n) as win_rate, sum(a * a) / (sum(a) * sum(a)) as hhi from (select code, month, org, sum(award) as a, sum(case when rate between 50 and 120 then rate else award / plan * 100 end) as rr, count(*) as n from ({awards}) z group by code, month, org) y group by code, month)"""
_Q_PANEL = f"""(select *, {_dlog("s12", "lag(s12, 12) over w")} as q1, win_rate - lag(win_rate, 12) over w as q2, lag(hhi, 12) over w - hhi as q3 from (select *, case when count(award) over v >= 6 then sum(award) over v end as s12 from
 (select p.*, t.award, t.win_rate, t.hhi from {_ZPANEL} p asof left join {_AWARDED} t on t.code = p.code and p.month >= t.known) x window v as (partition by code order by month rows between 11 preceding and current row)) u {_W})"""


@demo(f"""select code, month, round(q1, 4) as q1, round(q2, 4) as q2, round(q3, 4) as q3, round(tp1, 4) as tp_q1, round(tp2, 4) as tp_q2, round({_mean("tp1", "tp2")}, 4) as e_p from (select *, z_q1 * z_q2 as tp1, z_q3 * z_q2 as tp2 from {_chain(_labelled(_Q_PANEL), "q1", "q2", "q3")} t) u""")
def procurement_pack(spark, sf):
    p = axes.procurement_axis(xsec.cells(axes.award_features(zpanel(spark, sf), role(spark, sf, "awards")), "month", "industry", "bucket"))
    return rounded(p.withColumnsRenamed({"TP_Q1": "tp_q1", "TP_Q2": "tp_q2", "E_P": "e_p"}), ["code", "month"], ["q1", "q2", "q3", "tp_q1", "tp_q2", "e_p"])


@demo("""with t as (select conv_id, role, turn, w, count(*)::double as n from (select conv_id, role, turn, unnest(string_split_regex(regexp_replace(text, '[^\\p{L}\\p{N}]', ' ', 'g'), ' +')) as w from conversations) a where length(w) >= 2 group by all),
 s as (select conv_id, role, turn, sum(n * n) as sq from t group by all), p as (select * from (select conv_id, role, turn, lag(turn) over (partition by conv_id, role order by turn) as before from conversations) b where turn - before <= 2),
 d as (select p.conv_id, p.role, p.turn, sum(x.n * y.n) as dot from p join t x on x.conv_id = p.conv_id and x.role = p.role and x.turn = p.turn join t y on y.conv_id = p.conv_id and y.role = p.role and y.turn = p.before and y.w = x.w group by all)
 select p.conv_id, p.role, p.turn, round(coalesce(dot, 0) / sqrt(s.sq * s0.sq), 6) as sim from p left join s on s.conv_id = p.conv_id and s.role = p.role and s.turn = p.turn left join s s0 on s0.conv_id = p.conv_id and s0.role = p.role and s0.turn = p.before
 left join d on d.conv_id = p.conv_id and d.role = p.role and d.turn = p.turn""")
def text_cosine(spark, sf):
    t = table(spark, sf, "conversations").select("conv_id", "role", "turn", "text")
    return axes.text_similarity(t, ["conv_id", "role"], "turn").select("conv_id", "role", "turn", r("sim", 6).alias("sim"))


# ---- the universe


@demo(f"""with m as (select month, count(*) as a, sum((adv20 >= 50000)::int) as b, sum((adv20 >= 50000 and coalesce(revenue_ttm > 0, false))::int) as c from {_FP} x group by month),
 g as (select 1 as place, 'held' as gate, a as n from m union all select 2, 'liquid', b from m union all select 3, 'reported', c from m), s as (select place, gate, avg(n) as mean, min(n)::bigint as least, max(n)::bigint as most from g group by place, gate)
 select place, gate, round(mean, 4) as mean, least, most, round(mean / lag(mean) over (order by place), 6) as kept from s""")
def attrition(spark, sf):
    f = universe.funnel(fpanel(spark, sf), {"held": "true", "liquid": "adv20 >= 50000", "reported": "revenue_ttm > 0"})
    return f.select("place", "gate", r("mean").alias("mean"), "least", "most", r("kept", 6).alias("kept"))


_SNAP = "(select p.code, s.market, p.month as snap_date from ({panel}) p join ({security}) s on s.code = p.code where p.code % 7 <> 2 or p.month < date '1997-01-01')"


def snapshots(spark, sf):
    s = role(spark, sf, "panel").join(role(spark, sf, "security").select("code", "market"), "code")
    return s.where("code % 7 <> 2 or month < date '1997-01-01'").select("code", "market", F.col("month").alias("snap_date"))


@demo(f"select code, market, snap_date from (select *, count(*) over (partition by snap_date) as n from {_SNAP} a) b, (select median(n) as mid from (select count(*) as n from {_SNAP} c group by snap_date) d) e where n >= 0.8 * mid")
def partial_snapshot_filter(spark, sf):
    return universe.whole_snapshots(snapshots(spark, sf))


@demo(f"""with s as (select * from {_SNAP} a), m as (select market, max(snap_date) as covered from s group by market) select code, last_day(cast(seen + interval 1 day as date)) as delisting_date from (select code, max(snap_date) as seen, max_by(market, snap_date) as market from s group by code) c join m on m.market = c.market
 where covered >= (select max(snap_date) from s) - interval 200 day and seen < (select max(snap_date) from s) - interval 200 day and code not in (select code from ({{security}}) x where code % 14 = 9)""")
def delist_infer(spark, sf):
    return universe.inferred_delistings(snapshots(spark, sf), role(spark, sf, "security").where("code % 14 = 9"))


@demo("""select code, name, market, listing_date, sources, conflict from (select code, name, market, case when code % 3 = 0 then least(listing_date, date '1994-01-03') else listing_date end as listing_date, case when code % 3 = 0 then 'first+second' else 'second' end as sources, code % 3 = 0 and listing_date - date '1994-01-03' > 5 as conflict from ({security}) s) a""")
def master_merge(spark, sf):
    s = role(spark, sf, "security")
    first = s.where("code % 3 = 0").select("code", F.lit(" ").alias("name"), "market", "industry", F.lit("1994-01-03").cast("date").alias("listing_date"), "delisting_date", F.lit(0).alias("priority"), F.lit("first").alias("source"))
    second = s.select("code", "name", "market", "industry", "listing_date", "delisting_date", F.lit(1).alias("priority"), F.lit("second").alias("source"))
    return universe.master(first.unionByName(second)).select("code", "name", "market", "listing_date", "sources", "conflict")


# ---- plans and their tests

_PICKS = f"(select month, code, 1.0 / count(*) over (partition by month) as w from (select *, row_number() over (partition by month order by volume desc, code) as place from {_RET} a) b where place <= 5)"


def picked(spark, sf):
    s = returns(spark, sf).withColumns({"signal": F.col("volume"), "arm": F.lit("base")})
    p = portfolio.picks(s, ["arm"], "signal", low=5, high=5)
    return p.select("arm", "month", "code", "signal", (1.0 / F.count("*").over(Window.partitionBy("month"))).alias("w"))


@demo(f"""select month, code, round(p / sum(p) over (partition by month), 6) as raw from (select month, code, case when spread < 1e-6 then 1 else pow(greatest(d, 0) + 1e-9, least(2, 0.5 + 8 * spread)) end as p from
 (select *, avg(abs(d)) over (partition by month) as spread from (select month, code, signal - median(signal) over (partition by month) as d from (select month, code, volume / 1000 as signal, row_number() over (partition by month order by volume desc, code) as place from {_RET} a) b where place <= 5) c) e) f""")
def raw_weights(spark, sf):
    p = picked(spark, sf).withColumn("signal", F.col("signal") / 1000)
    return portfolio.raw_weights(p, ["month"], "signal").select("month", "code", r("raw", 6).alias("raw"))


@demo("""select day, case when later < date '2019-06-03' then 0.003 when later < date '2021-01-01' then 0.0025 when later < date '2023-01-01' then 0.0023 when later < date '2024-01-01' then 0.002 when later < date '2025-01-01' then 0.0018 else 0.0015 end as rate
 from (select distinct day, cast(day + interval 276 month as date) as later from ({daily}) d) x""")
def sales_tax(spark, sf):
    """The days of the table 23 years on, so that they meet all steps."""
    return role(spark, sf, "daily").select("day").distinct().select("day", X.sales_tax(F.add_months("day", 276)).alias("rate"))


def plan_panel(spark, sf):
    """code, month, signal, adv20, fwd_ret of the scored panel."""
    s = axes.score(scored_panel(spark, sf), ["E_X", "E_Y", "E_Z"]).drop("arm")
    ret = returns(spark, sf).select("code", "month", F.col("ret").alias("fwd_ret"))
    return s.withColumn("signal", F.when(F.col("Signal") > 0, F.col("Signal_rank"))).join(ret, ["code", "month"], "left")


def month_returns(spark, sf):
    """Mean returns of a month, of codes in two arms."""
    a = returns(spark, sf).where("ret is not null").withColumn("arm", F.when(F.col("code") % 2 == 0, "even").otherwise("odd"))
    return a.groupBy("arm", "month").agg(F.avg("ret").alias("ret"))


_MONTHS = f"(select case when code % 2 = 0 then 'even' else 'odd' end as arm, month, avg(ret) as ret from {_RET} a where ret is not null group by all)"


@demo(f"""with a as (select arm, ret, row_number() over (partition by arm order by month) - 1 as i, count(*) over (partition by arm) as n from {_MONTHS} q), b as (select arm, ret, case when i < (n % 8) * (n // 8 + 1) then i // (n // 8 + 1) else n % 8 + (i - (n % 8) * (n // 8 + 1)) // (n // 8) end as b from a),
 s as (select arm, b, sum(ret) as s from b group by all), t as (select *, sum(s) over (partition by arm) - s as rest from s) select arm, count(*) as blocks, round(avg(case when rest > 0 and s <= 0 then 1.0 else 0.0 end), 6) as pbo from t group by arm""")
def block_pbo(spark, sf):
    return robustness.block_pbo(month_returns(spark, sf)).select("arm", "blocks", r("pbo", 6).alias("pbo"))


@demo(f"""with m as (select month, avg(ret) > 0 as up from {_RET} a where ret is not null group by month), h as (select q.*, up, row_number() over w - 1 < count(*) over (partition by arm) // 2 as first from {_MONTHS} q join m on m.month = q.month window w as (partition by arm order by q.month)),
 x as (select arm, ret, case when first then 'first_half' else 'second_half' end as regime from h union all select arm, ret, case when up then 'market_up' else 'market_down' end from h union all select arm, ret, case when month < date '1998-06-01' then 'before' else 'from' end from h) select arm, regime, count(*) as n, round(avg(ret), 6) as mean_ret, round(avg((ret > 0)::int), 6) as hit_rate from x group by all having count(*) >= 6""")
def regimes(spark, sf):
    up = returns(spark, sf).where("ret is not null").groupBy("month").agg((F.avg("ret") > 0).alias("up"))
    return robustness.regimes(month_returns(spark, sf), up, split="1998-06-01").select("arm", "regime", "n", r("mean_ret", 6).alias("mean_ret"), r("hit_rate", 6).alias("hit_rate"))


@demo(f"""with a as (select arm, ret as x, avg(ret) over (partition by arm) as m from {_MONTHS} q), b as (select arm, count(*) as n, any_value(m) as m, sqrt(sum((x - m) ^ 2) / (count(*) - 1)) as sd, avg((x - m) ^ 3) / avg((x - m) ^ 2) ^ 1.5 as skew, avg((x - m) ^ 4) / avg((x - m) ^ 2) ^ 2 as kurt from a group by arm),
 c as (select *, m / sd as sr, sqrt(2 * ln(12)) * (1 - 0.5772156649) + 0.5772156649 * sqrt(2 * ln(12 * exp(1))) as best from b), z as (select arm, n, sr, (sr - best / sqrt(n)) * sqrt(n - 1) / sqrt(greatest(1e-12, 1 - skew * sr + (kurt - 1) / 4 * sr * sr)) as z from c)
 select arm, n, round(sr, 6) as sharpe, case when n >= 12 then round(0.5 + sign(z) * sum(exp((2 * k + 1) * ln(abs(z)) - z * z / 2 - lgamma(2 * k + 2) + k * ln(2) + lgamma(k + 1))) / sqrt(2 * pi()), 6) end as dsr from z, range(150) t(k) group by arm, n, sr, z""")
def deflated_sharpe(spark, sf):
    return robustness.deflated_sharpe(month_returns(spark, sf)).select("arm", "n", r("sharpe", 6).alias("sharpe"), r("dsr", 6).alias("dsr"))


_PLAN = ("code", "month", "signal", "adv20", "fwd_ret")


def with_returns(spark, sf):
    ret = returns(spark, sf).select("code", "month", F.col("ret").alias("fwd_ret"))
    return scored_panel(spark, sf).join(ret, ["code", "month"], "left")


def masked_months(spark, sf):
    windows = spark.sql("select * from values (date '1996-03-31', date '1996-09-30') as t(start, end)")
    return pit.mask_windows(role(spark, sf, "panel").select("month").distinct(), windows)


@demo(f"""select masked, count(*) as months, round(avg(s), 6) as rate from (select month, case when month between date '1995-09-30' and date '1997-03-30' then 1 else 0 end as masked, avg((volume > 300)::int) as s from ({{panel}}) p group by month) a group by masked""")
def firing_rate(spark, sf):
    p = role(spark, sf, "panel").select("month", F.col("volume").alias("signal"))
    return robustness.firing(p, masked_months(spark, sf), 300).select("masked", "months", r("rate", 6).alias("rate"))


_F = _labelled(f"(select a.*, ln(adv20) as f_size, {_div('equity', 'assets')} as f_qual, x.ret as fwd_ret from {_FP} a join {_RET} x on x.code = a.code and x.month = a.month)")


def _sql_cell_z(src: str, x: str, out: str) -> str:
    over = "over (partition by cell)"
    src = f"(select *, avg({x}) {over} as m_, stddev_pop({x}) {over} as s_, count({x}) {over} as n_ from {src} y1)"
    src = f"(select *, case when {x} is not null then least(greatest({x}, m_ - 2 * s_), m_ + 2 * s_) end as c_ from {src} y2)"
    src = f"(select *, avg(c_) {over} as m2_, stddev_pop(c_) {over} as s2_ from {src} y3)"
    return f"(select * exclude (m_, s_, n_, c_, m2_, s2_), case when n_ >= 8 and {x} is not null then case when s2_ > 1e-12 then (c_ - m2_) / s2_ else 0 end end as {out} from {src} y4)"


@demo(f"""with a as (select *, count(*) over (partition by month) as rows_ from {_sql_cell_z(_sql_cell_z(_F, 'f_size', 'z1'), 'f_qual', 'z2')} q), l as (select month, fwd_ret, 'f_size' as factor, z1 as z from a where rows_ >= 30 union all select month, fwd_ret, 'f_qual', z2 from a where rows_ >= 30),
 k as (select *, z - min(z) over (partition by month, factor) + 1e-9 as w from l where z is not null and fwd_ret is not null) select month, factor, round(sum(w * fwd_ret) / sum(w) - avg(fwd_ret), 6) as ret from k group by month, factor having count(*) >= 11""")
def factor_returns(spark, sf):
    p = fpanel(spark, sf).join(returns(spark, sf).select("code", "month", F.col("ret").alias("fwd_ret")), ["code", "month"])
    p = xsec.cells(p.withColumns({"f_size": F.log("adv20"), "f_qual": X.safe_div(F.col("equity"), F.col("assets"))}), "month", "industry", "bucket")
    return robustness.factor_returns(p, ["f_size", "f_qual"]).select("month", "factor", r("ret", 6).alias("ret"))


_ALPHA = f"""with f as ({ORACLE["factor_returns"]}), w as (select month, max(case when factor = 'f_size' then ret end) as x1, max(case when factor = 'f_qual' then ret end) as x2 from f group by month having count(*) = 2),
 a as (select q.arm, q.month, q.ret as y, x1, x2, count(*) over (partition by q.arm) as n from {_MONTHS} q join w on w.month = q.month),
 b as (select arm, (covar_pop(x1, y) * var_pop(x2) - covar_pop(x2, y) * covar_pop(x1, x2)) / (var_pop(x1) * var_pop(x2) - covar_pop(x1, x2) ^ 2) as b1, (covar_pop(x2, y) * var_pop(x1) - covar_pop(x1, y) * covar_pop(x1, x2)) / (var_pop(x1) * var_pop(x2) - covar_pop(x1, x2) ^ 2) as b2 from a group by arm),
 z as (select a.arm, month, y - b1 * x1 - b2 * x2 as v from a join b on b.arm = a.arm where n >= 24), e as (select arm, month, v - avg(v) over (partition by arm) as e, v, floor(4 * pow(count(*) over (partition by arm) / 100, 2.0 / 9)) as lags from z), l as (select *, {_LAGS} from e window w as (partition by arm order by month)),
 s as (select arm, count(*) as n, avg(v) as m, sum(e * e) + {_SUMS} as s from l group by arm) select arm, n, round(m, 6) as alpha, case when n >= 12 and s > 0 then round(m / sqrt(s / n / n), 4) end as t from s"""


@demo(_ALPHA)
def factor_alpha(spark, sf):
    f = factor_returns(spark, sf)
    return robustness.alpha(month_returns(spark, sf), f, ["f_size", "f_qual"]).select("arm", "n", r("alpha", 6).alias("alpha"), r("t").alias("t"))


@demo(f"select arm as subject, 'positive mean' as test, avg(ret) > 0 as passed, count(*)::double as n from {_MONTHS} q group by arm")
def verdict_table(spark, sf):
    t = month_returns(spark, sf).groupBy("arm").agg(F.avg("ret").alias("mean_ret"), F.count("*").alias("n"))
    return robustness.verdicts(t, F.col("mean_ret") > 0, False, "positive mean").select("subject", "test", "passed", F.col("metrics")["n"].alias("n"))


# ---- the flagship, which demos.py defines, in the other engine

_FLAG = _sql_z(_sql_z(_labelled(f"(select p.*, ln(ytd_revenue) as lr from {_ZPANEL} p asof left join ({{statements}}) s on p.code = s.code and p.month >= s.knowledge_date)"), "x", "z1"), "lr", "z2")
ORACLE["flagship"] = for_checking(f"""select month, code, place, signal from (select *, row_number() over (partition by month order by signal desc, code) as place, greatest(5, least(25, cast(round_even(count(*) over (partition by month) * 0.05, 0) as int))) as k
 from (select month, code, round(z1 * z2, 6) as signal from {_FLAG} f) g where signal is not null) h where place <= k""")
