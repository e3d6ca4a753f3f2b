"""Queries of the month-by-month fold and of the tests that stand on it, with SQL that runs the months by recursion."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitwright.plans import axes, portfolio, robustness
from pitwright.plans.axis_demos import _PLAN, masked_months, plan_panel, with_returns
from pitwright.plans.demos import _RET, ORACLE, demo, r, signals
from pitwright.plans.plan_demos import _BASE_ARM, _noise_arm

MONEY = ("turnover", "cost", "ret_gross", "ret")


def _fold(panel: str) -> str:
    """arm, month, names, turnover, cost, ret_gross, ret of panel: arm, month, code, signal, picked, exits, adv, fwd_ret."""
    return f"""(with recursive p as materialized (select * from {panel} p0), m as (select arm, month, row_number() over (partition by arm order by month) as i from (select distinct arm, month from p) m0), q as materialized (select p.*, m.i from p join m on m.arm = p.arm and m.month = p.month),
 l as materialized (select arm, i, list(struct_pack(c := code, p := picked, e := exits) order by signal desc nulls last, code) as names from q group by arm, i),
 h as (select arm, 0::bigint as i, cast([] as struct(c bigint, a bigint)[]) as held from (select distinct arm from m) h0 union all
  select l.arm, l.i, cast(list_transform(list_slice(list_filter(l.names, lambda x: x.p = 1 or (x.e = 0 and len(list_filter(h.held, lambda y: y.c = x.c and y.a < 24)) > 0)), 1, 25), lambda x: struct_pack(c := x.c, a := coalesce(list_filter(h.held, lambda y: y.c = x.c)[1].a + 1, 0))) as struct(c bigint, a bigint)[]) from h join l on l.arm = h.arm and l.i = h.i + 1),
 t as (select q.arm, q.i, q.code, coalesce(q.signal, 0) as s, q.adv, q.fwd_ret, case when q.adv > 0 then least(0.12, greatest(0.1 * q.adv / 30000000, 0.01)) else 0.12 end as cap from (select arm, i, unnest(held).c as code from h) u join q on q.arm = u.arm and q.i = u.i and q.code = u.code),
 t1 as (select *, s - median(s) over (partition by arm, i) as d from t), t2 as (select *, avg(abs(d)) over (partition by arm, i) as spread from t1), t3 as (select *, case when spread < 1e-6 then 1 else pow(greatest(d, 0) + 1e-9, least(2, 0.5 + 8 * spread)) end as p from t2),
 t4 as materialized (select *, p / sum(p) over (partition by arm, i) as raw from t3),
 v as (select a.arm, a.i, a.code, any_value(a.raw) as raw, any_value(a.cap) as cap, (1 - coalesce(sum(b.cap) filter (b.raw / b.cap > a.raw / a.cap), 0)) / sum(b.raw) filter (b.raw / b.cap <= a.raw / a.cap) as lev from t4 a join t4 b on b.arm = a.arm and b.i = a.i group by a.arm, a.i, a.code),
 w as materialized (select x.arm, x.i, x.code, x.fwd_ret, case when y.lev is null then x.cap else least(x.cap, x.raw * y.lev) end as w from t4 x left join (select arm, i, min(lev) as lev from v where raw * lev <= cap + 1e-15 group by arm, i) y on y.arm = x.arm and y.i = x.i),
 d as (select coalesce(x.arm, y.arm) as arm, coalesce(x.i, y.i + 1) as i, coalesce(x.code, y.code) as code, coalesce(x.w, 0) - coalesce(y.w, 0) as d from w x full join w y on y.arm = x.arm and y.code = x.code and y.i + 1 = x.i),
 k as (select d.arm, d.i, sum(abs(d)) as turnover, sum(abs(d) * (0.00015 + case when q.adv > 0 then 0.1 * sqrt(least(1, abs(d) * 30000000 / q.adv)) else 0.02 end + case when d < 0 then 0.003 else 0 end)) as cost from d left join q on q.arm = d.arm and q.i = d.i and q.code = d.code group by d.arm, d.i),
 g as (select arm, i, count(*) as names, sum(w * coalesce(fwd_ret, 0)) as gross from w group by arm, i)
 select m.arm, m.month, coalesce(g.names, 0) as names, coalesce(k.turnover, 0) as turnover, coalesce(k.cost, 0) as cost, coalesce(g.gross, 0) as ret_gross, coalesce(g.gross, 0) - coalesce(k.cost, 0) as ret from m left join g on g.arm = m.arm and g.i = m.i left join k on k.arm = m.arm and k.i = m.i)"""


def _flagged(arms: str) -> str:
    """arms (arm, code, month, signal, adv, fwd_ret, exits) with picked."""
    return f"""(select * exclude (place, k), (signal is not null and place <= k)::int as picked from (select *, row_number() over (partition by arm, month order by signal desc nulls last, code) as place, greatest(5, least(25, cast(round_even(count(signal) over (partition by arm, month) * 0.05, 0) as int))) as k from {arms} f0) f1)"""


def _run(arms: str) -> str:
    """The fold of arms (arm, code, month, signal) over the panel, with codes that an arm ever picks."""
    full = f"(select a.arm, a.code, a.month, a.signal, p.amount as adv, x.ret as fwd_ret, 0 as exits from ({arms}) a join ({{panel}}) p on p.code = a.code and p.month = a.month left join {_RET} x on x.code = a.code and x.month = a.month)"
    return _fold(f"(select * from (select *, max(picked) over (partition by arm, code) as ever from {_flagged(full)} r0) r1 where ever = 1)")


def _compared(arms: str, base: str) -> str:
    return f"""with s as (select arm, count(*) as n, avg(names) as names, avg(ret) as mean_ret, case when stddev_samp(ret) > 0 then avg(ret) / stddev_samp(ret) * sqrt(12) end as sharpe from {_run(arms)} c group by arm)
 select arm, n, round(names, 4) as names, round(mean_ret, 6) as mean_ret, round(sharpe, 5) as sharpe, round(sharpe - (select max(sharpe) from s where arm = '{base}'), 5) as delta from s"""


def rounded(table):
    return table.select("arm", "n", r("names").alias("names"), r("mean_ret", 6).alias("mean_ret"), r("sharpe", 5).alias("sharpe"), r("delta", 5).alias("delta"))


def compared(arms, base: str):
    """Ranks are rounded, so that ties are ties in any engine."""
    return rounded(robustness.compared(robustness.run(arms.withColumn("signal", r("signal"))), base))


_TWO = f"(select unnest(['base', 'inverse']) as arm, code, month, volume * unnest([1, -1]) as signal, amount as adv, ret as fwd_ret, (volume < 50)::int as exits from {_RET} b0)"


@demo(f"""select arm, month, names, round(turnover, 8) as turnover, round(cost, 8) as cost, round(ret_gross, 8) as ret_gross, round(ret, 8) as ret from {_fold(f"(select * from (select *, max(picked) over (partition by arm, code) as ever from {_flagged(_TWO)} b1) b2 where ever = 1)")} b""")
def backtest(spark, sf):
    s = signals(spark, sf)
    arms = s.unionByName(s.withColumn("signal", -F.col("volume")).withColumn("arm", F.lit("inverse")))
    flags = portfolio.flagged(arms, ["arm"], "signal")
    few = flags.join(flags.where("picked = 1").select("arm", "code").distinct(), ["arm", "code"], "left_semi")
    panel = few.select("arm", "month", "code", "signal", "picked", (F.col("volume") < 50).cast("int").alias("exits"), F.col("amount").alias("adv"), F.col("ret").alias("fwd_ret"))
    return portfolio.backtest(panel).select("arm", "month", "names", *(r(c, 8).alias(c) for c in MONEY))  # costs are often whole multiples of 5e-7


@demo(_compared(ORACLE["leak_shift"], "base"))
def leak_test(spark, sf):
    p = plan_panel(spark, sf).select(*_PLAN).withColumn("signal", r("signal"))
    return compared(robustness.leak_arms(p), "base")


@demo(_compared(" union all ".join([_BASE_ARM, *map(_noise_arm, (1, 2, 3))]), "base"))
def noise_test(spark, sf):
    return compared(robustness.noise_arms(with_returns(spark, sf), [1, 2, 3], ["E_X", "E_Y", "E_Z"]), "base")


@demo(_compared(ORACLE["product_scores"], "plain"))
def product_test(spark, sf):
    p = axes.standardised(with_returns(spark, sf), {"z_x": "E_X", "z_y": "E_Y", "z_z": "E_Z"})
    p = p.withColumns({"TP_1": r(F.col("z_x") * F.col("z_y"), 6), "TP_2": r(F.col("z_x") * F.col("z_z"), 6)})
    return compared(robustness.product_arms(p, ["TP_1", "TP_2"], ["E_X", "E_Y"]), "plain")


@demo(_compared(ORACLE["arm_scores"], "all"))
def ablation(spark, sf):
    return compared(robustness.ablation_arms(with_returns(spark, sf), ["E_X", "E_Y", "E_Z"]), "all")


@demo(f"""with f as ({_run(_BASE_ARM)[1:-1]}), x as (select arm, 'gross' as basis, ret_gross as r from f union all select arm, 'net', ret from f)
 select arm, basis, count(*) as n, round(avg(r), 6) as mean_ret, round(case when stddev_samp(r) > 0 then avg(r) / stddev_samp(r) * sqrt(12) end, 5) as sharpe from x group by arm, basis""")
def cost_survival(spark, sf):
    p = plan_panel(spark, sf).select(*_PLAN).withColumn("signal", r("signal"))
    s = robustness.cost_survival(robustness.run(robustness.arms_of(p, {"base": F.col("signal")})))
    return s.select("arm", "basis", "n", r("mean_ret", 6).alias("mean_ret"), r("sharpe", 5).alias("sharpe"))


@demo(_compared(f"select 'full' as arm, code, month, signal from ({_BASE_ARM}) c0 union all select 'clean', code, month, signal from ({_BASE_ARM}) c1 where month not between date '1995-09-30' and date '1997-03-30'", "full"))
def policy_test(spark, sf):
    p = plan_panel(spark, sf).select(*_PLAN).withColumn("signal", r("signal"))
    return compared(robustness.clean_month_arms(p, masked_months(spark, sf)), "full")
