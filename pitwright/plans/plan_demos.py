"""Queries for picks, weights, costs, statistics, arms, verdicts and checks, with checking SQL. They join those of demos.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitwright.operators import audits, pit, prices, xsec
from pitwright.plans import axes, portfolio, robustness
from pitwright.plans.axis_demos import _D, _MONTHS, _PICKS, _PLAN, _SCORED, _VS, _labelled, _sql_rank, _sql_z, masked_months, month_returns, picked, plan_panel, scored_panel, vetoed, with_returns
from pitwright.plans.demos import _LAGS, _PRICES, _RET, _SUMS, _Z, _ZPANEL, demo, gapped, r, returns, table, zpanel
from pitwright.sources.roles import role

# ---- picks, weights, costs, returns


@demo(f"""select month, code, place from (select *, row_number() over (partition by month order by signal_rank desc, code) as place, greatest(5, least(25, cast(round_even(count(*) over (partition by month) * 0.05, 0) as int))) as k
 from (select s.code, s.month, round(signal_rank, 4) as signal_rank from {_SCORED} s join {_PRICES} q on q.code = s.code and q.month = s.month where veto = 1 and floor_ = 1 and exec_px is not null) a) b where place <= k""")
def eligible_picks(spark, sf):
    s = axes.score(scored_panel(spark, sf), ["E_X", "E_Y", "E_Z"]).drop("Signal").withColumn("signal", r("Signal_rank"))
    p = s.withColumn("arm", F.lit("base")).join(prices.month_panel(gapped(spark, sf)).select("code", "month", "exec_px"), ["code", "month"], "left")
    return portfolio.picks(portfolio.eligible(p, "signal"), ["arm"], "signal").select("month", "code", "place")


_HELD = f"""(select month, code, volume / 1000 as signal, case when code % 4 > 0 then amount / 3 end as adv from (select *, row_number() over (partition by month order by volume desc, code) as place from {_RET} a) b where place <= 12)"""
_RAW = f"""(select month, code, adv, p / sum(p) over (partition by month) as raw, case when adv > 0 then least(0.12, greatest(0.1 * adv / 30000000, 0.01)) else 0.12 end as cap from (select *, case when spread < 1e-6 then 1 else pow(greatest(d, 0) + 1e-9, least(2, 0.5 + 8 * spread)) end as p from
 (select *, avg(abs(d)) over (partition by month) as spread from (select *, signal - median(signal) over (partition by month) as d from {_HELD} c) e) f) g)"""
#: The level of the water: of all levels at which some names are capped, the one that a name just reaches.
_LEVEL = f"""(select a.month, a.code, (1 - coalesce(sum(b.cap) filter (b.raw / b.cap > a.raw / a.cap), 0)) / sum(b.raw) filter (b.raw / b.cap <= a.raw / a.cap) as lev, any_value(a.raw) as raw, any_value(a.cap) as cap from {_RAW} a join {_RAW} b on b.month = a.month group by a.month, a.code)"""
_W = f"""(select x.month, x.code, x.adv, least(x.cap, x.raw * coalesce(l.lev, 1e18)) as w from {_RAW} x left join (select month, min(lev) as lev from {_LEVEL} y where raw * lev <= cap + 1e-15 group by month) l on l.month = x.month)"""


def weighted(spark, sf):
    p = returns(spark, sf).withColumns({"signal": F.col("volume"), "arm": F.lit("base")})
    p = portfolio.picks(p, ["arm"], "signal", low=12, high=12)
    p = p.select("arm", "month", "code", (F.col("signal") / 1000).alias("signal"), F.when(F.col("code") % 4 > 0, F.col("amount") / 3).alias("adv"))
    return portfolio.capped_weights(p, ["arm", "month"], "signal", "adv")


@demo(f"select month, code, round(w, 6) as w from {_W} a")
def size_weights(spark, sf):
    return weighted(spark, sf).select("month", "code", r("w", 6).alias("w"))


@demo(f"""with m as (select month, row_number() over (order by month) as i from (select distinct month from ({{panel}}) p) a), h as (select i, code, w, adv from {_W} q join m on m.month = q.month), d as (select coalesce(x.i, y.i + 1) as i, coalesce(x.w, 0) - coalesce(y.w, 0) as d, x.adv from h x full join h y on x.code = y.code and x.i = y.i + 1)
 select m.month, round(sum(abs(d)), 5) as turnover, round(sum(abs(d) * (0.00015 + case when adv > 0 then 0.1 * sqrt(least(1, abs(d) * 30000000 / adv)) else 0.02 end + case when d < 0 then 0.003 else 0 end)), 7) as cost from d join m on m.i = d.i group by m.month""")
def trade_cost(spark, sf):
    months = role(spark, sf, "panel").select("month").distinct()
    return portfolio.trade_costs(weighted(spark, sf), months, ["arm"]).select("month", r("turnover", 5).alias("turnover"), r("cost", 7).alias("cost"))


_GONE = f"""(select k.month, k.code, k.w, coalesce(q.fwd_ret, case when s.delisting_date > k.month and s.delisting_date <= last_day(cast(k.month + interval 1 day as date)) then -1 end, 0) as ret from {_PICKS} k left join (select * from {_PRICES} q0 where code % 10 <> 3 or month <> date '1999-05-31') q on q.code = k.code and q.month = k.month join ({{security}}) s on s.code = k.code)"""


@demo(f"select month, round(sum(w * ret), 6) as ret, count(*) as names from {_GONE} a group by month")
def portfolio_returns(spark, sf):
    """A tenth of the names is delisted in June 1999, and their return of the month before is unknown."""
    q = prices.month_panel(gapped(spark, sf)).where("code % 10 <> 3 or month <> date '1999-05-31'")
    h = portfolio.held_returns(picked(spark, sf), q, role(spark, sf, "security"))
    return h.groupBy("month").agg(r(F.sum(F.col("w") * F.col("ret")), 6).alias("ret"), F.count("*").alias("names"))


_IDX = "(select month, close / lag(close) over (order by month) - 1 as ret from (select last_day(day) as month, max_by(close, day) as close from (select day, sum(amount) / sum(volume) as close from ({daily}) d group by day) e group by last_day(day)) f)"


@demo(f"select month, round(ret, 6) as ret from {_IDX} i")
def bench_returns(spark, sf):
    return prices.benchmark(index(spark, sf)).select("month", r("ret", 6).alias("ret"))


def index(spark, sf):
    return role(spark, sf, "daily").groupBy("day").agg((F.sum("amount") / F.sum("volume")).alias("close"))


def small_returns(spark, sf):
    """Mean returns of arms, made small, so that wealth stays a number that can be shown; and the same arms with a month that loses all."""
    x = F.col("ret") / 20 - 0.2
    lost = F.when(F.col("month") == "1997-06-30", -1.0).otherwise(x)
    return month_returns(spark, sf).select("month", F.explode(F.array(F.struct("arm", x.alias("ret")), F.struct(F.concat("arm", F.lit(" lost")).alias("arm"), lost.alias("ret")))).alias("x")).select("x.arm", "month", "x.ret")


_SMALL = f"(select arm, month, ret / 20 - 0.2 as ret from {_MONTHS} m0 union all select arm || ' lost', month, case when month = date '1997-06-30' then -1 else ret / 20 - 0.2 end from {_MONTHS} m1)"


def _hac(src: str, key: str) -> str:
    """key, n and t of column x of src (key, month, x)."""
    return f"""(select {key}, n, case when n >= 12 and s > 0 then m / sqrt(s / n / n) end as t from (select {key}, count(*) as n, avg(x) as m, sum(e * e) + {_SUMS} as s from (select *, {_LAGS} from (select {key}, month, x, x - avg(x) over (partition by {key}) as e, floor(4 * pow(count(*) over (partition by {key}) / 100, 2.0 / 9)) as lags
 from {src} h0 where x is not null) h1 window w as (partition by {key} order by month)) h2 group by {key}) h3)"""


@demo(f"""with b as (select q.arm, q.month, q.ret as x1, i.ret as x2, q.ret - i.ret as x from {_SMALL} q join {_IDX} i on i.month = q.month where q.ret is not null and i.ret is not null)
 select b.arm, count(*) as months, round(product(1 + x1) - 1, 5) as total, round(product(1 + x2) - 1, 5) as index_total, round(avg(x), 6) as excess_mean, round(any_value(h.t), 4) as t from b join {_hac("b", "arm")} h on h.arm = b.arm group by b.arm""")
def bench_compare(spark, sf):
    c = portfolio.against_benchmark(small_returns(spark, sf), prices.benchmark(index(spark, sf)))
    return c.select("arm", "months", r("total", 5).alias("total"), r("index_total", 5).alias("index_total"), r("excess_mean", 6).alias("excess_mean"), r("t").alias("t"))


@demo(f"""with a as (select arm, month, ret as x from {_SMALL} q), w as (select *, product(1 + x) over (partition by arm order by month) as wealth from a), d as (select *, wealth / greatest(1, max(wealth) over (partition by arm order by month)) - 1 as dd from w),
 u as (select arm, coalesce(max(n), 0) as underwater from (select arm, count(*) as n from (select arm, dd < -1e-9 as low, row_number() over (partition by arm order by month) - row_number() over (partition by arm, dd < -1e-9 order by month) as run from d) e where low group by arm, run) f group by arm),
 s as (select arm, count(*) as n, pow(product(1 + x), 12 / count(*)) - 1 as cagr, stddev_samp(x) * sqrt(12) as vol, stddev_samp(case when x < 0 then x end) * sqrt(12) as low, min(dd) as mdd, avg((x > 0)::int) as hit, avg(x) as mean, product(1 + x) - 1 as total from d group by arm)
 select s.arm, s.n, round(cagr, 5) as cagr, round(vol, 5) as vol, round(cagr / vol, 4) as sharpe, round(cagr / low, 4) as sortino, round(mdd, 5) as mdd, round(cagr / abs(mdd), 4) as calmar, round(hit, 5) as hit_rate, round(mean, 6) as mean, round(h.t, 4) as t, underwater, round(total, 4) as total
 from s join u on u.arm = s.arm join {_hac("a", "arm")} h on h.arm = s.arm""")
def perf_stats(spark, sf):
    s = portfolio.statistics(small_returns(spark, sf), "arm", "ret")
    five, four = ("cagr", "vol", "mdd", "hit_rate"), ("sharpe", "sortino", "calmar", "t", "total")
    return s.select("arm", "n", *(r(c, 5).alias(c) for c in five), *(r(c).alias(c) for c in four), r("mean", 6).alias("mean"), "underwater")


# ---- arms

_SIG = f"(select s.code, s.month, case when signal > 0 then round(signal_rank, 4) end as signal, x.ret as fwd_ret from {_SCORED} s left join {_RET} x on x.code = s.code and x.month = s.month)"


@demo(f"""select 'base' as arm, code, month, signal from {_SIG} a union all select 'early', code, month, lead(signal) over (partition by code order by month) from {_SIG} b union all
 select 'oracle', code, month, coalesce(case when fwd_ret is not null then round((rank() over (partition by month order by fwd_ret nulls last) + (count(*) over (partition by month, fwd_ret) - 1) / 2) / count(fwd_ret) over (partition by month), 4) end, signal) from {_SIG} c""")
def leak_shift(spark, sf):
    p = plan_panel(spark, sf).select(*_PLAN).withColumn("signal", r("signal"))
    a = robustness.leak_arms(p)
    return a.select("arm", "code", "month", r("signal").alias("signal"))


def _arm_sql(src: str, names: list[str], u: str = "u", veto: str = "veto") -> str:
    """src with e, floor_, signal and signal_rank of one set of axes."""
    for e in names:
        src = _sql_rank(_sql_z(src, e, f"z_{e}"), e, f"p_{e}")
    n, total = " + ".join(f"(z_{e} is not null)::int" for e in names), " + ".join(f"coalesce(z_{e}, 0)" for e in names)
    ok, bad = (" + ".join(f"coalesce(p_{e} {op} 0.5, false)::int" for e in names) for op in (">=", "<"))
    src = f"(select *, case when {n} > 0 then ({total}) / ({n}) end as e_raw, case when ({bad}) = 0 and ({ok}) >= 2 then 1 else 0 end as floor_ from {src} a1)"
    return _sql_rank(f"(select *, coalesce(e, 0) * {u} * {veto} * floor_ as signal from {_sql_rank(src, 'e_raw', 'e')} a2)", "signal", "signal_rank", ("month",), 1)


_AXES = _labelled(f"(select code, month, industry, bucket, round(ln(adv20), 6) as e_x, round(ln(revenue_ttm), 6) as e_y, round(-dlog_m, 6) as e_z, round((code % 7) / 7, 6) as u, case when code % 5 = 0 then 0 else 1 end as veto from {_D} s0)")


@demo(" union all ".join(f"select '{name}' as arm, code, month, round(signal_rank, 4) as signal from {_arm_sql(_AXES, names)} s{k}" for k, (name, names) in enumerate((("all", ["e_x", "e_y", "e_z"]), ("without_E_X", ["e_y", "e_z"]), ("without_E_Y", ["e_x", "e_z"]), ("without_E_Z", ["e_x", "e_y"])))))
def arm_scores(spark, sf):
    a = robustness.ablation_arms(with_returns(spark, sf), ["E_X", "E_Y", "E_Z"])
    return a.select("arm", "code", "month", r("signal").alias("signal"))


def _noised(seed: int) -> str:
    ranked = _sql_rank(f"(select *, (('0x' || substr(md5('{seed}|' || code || '|' || month), 1, 5))::bigint + 0.5) / 1048576 as noise from {_SCORED} n0)", "noise", "e_noise")
    return _sql_rank(f"(select *, coalesce(e_noise, 0) * u * veto * floor_ as s_noise from {ranked} n1)", "s_noise", "r_noise", ("month",), 1)


_BASE_ARM = f"select 'base' as arm, code, month, case when signal > 0 then round(signal_rank, 4) end as signal from {_SCORED} a"


def _noise_arm(seed: int) -> str:
    return f"select 'noise_{seed}' as arm, code, month, case when s_noise > 0 then round(r_noise, 4) end as signal from {_noised(seed)} b{seed}"


@demo(f"{_BASE_ARM} union all {_noise_arm(1)}")
def noise_scores(spark, sf):
    a = robustness.noise_arms(with_returns(spark, sf), [1], ["E_X", "E_Y", "E_Z"])
    return a.select("arm", "code", "month", r("signal").alias("signal"))


_ZXYZ = _sql_z(_sql_z(_sql_z(_AXES, "e_x", "z_x"), "e_y", "z_y"), "e_z", "z_z")
_TPS = f"(select *, round(z_x * z_y, 6) as tp_1, round(z_x * z_z, 6) as tp_2 from {_ZXYZ} t0)"


@demo(f"select 'product' as arm, code, month, case when signal > 0 then round(signal_rank, 4) end as signal from {_arm_sql(_TPS, ['tp_1', 'tp_2'])} a union all select 'plain', code, month, case when signal > 0 then round(signal_rank, 4) end from {_arm_sql(_AXES, ['e_x', 'e_y'])} b")
def product_scores(spark, sf):
    p = axes.standardised(with_returns(spark, sf), {"z_x": "E_X", "z_y": "E_Y", "z_z": "E_Z"})
    p = p.withColumns({"TP_1": r(F.col("z_x") * F.col("z_y"), 6), "TP_2": r(F.col("z_x") * F.col("z_z"), 6)})
    a = robustness.product_arms(p, ["TP_1", "TP_2"], ["E_X", "E_Y"])
    return a.select("arm", "code", "month", r("signal").alias("signal"))


# ---- verdicts

_THREE = f"(select case code % 3 when 0 then 'base' when 1 then 'oracle' else 'early' end as arm, month, avg(ret) / 20 as ret from {_RET} a where ret is not null group by all)"


def three_arms(spark, sf):
    k = F.col("code") % 3
    a = returns(spark, sf).where("ret is not null").withColumn("arm", F.when(k == 0, "base").when(k == 1, "oracle").otherwise("early"))
    return a.groupBy("arm", "month").agg((F.avg("ret") / 20).alias("ret"), F.lit(5).alias("names"))


def _metrics(df, **names: str):
    return df.select("test", "passed", "kill", *(r(F.col("metrics")[key]).alias(c) for c, key in names.items()))


@demo(f"""with s as (select arm, avg(ret) / stddev_samp(ret) * sqrt(12) as sharpe from {_THREE} a group by arm), w as (select max(sharpe) filter (arm = 'base') as b, max(sharpe) filter (arm = 'oracle') as o, max(sharpe) filter (arm = 'early') as e from s)
 select 'R1' as test, o - b > 0.5 as passed, false as kill, round(b, 4) as base, round(o, 4) as oracle, round(e, 4) as early from w""")
def leak_verdict(spark, sf):
    t = robustness.leak_verdict(robustness.compared(three_arms(spark, sf), "base"))
    return _metrics(t, base="sharpe_base", oracle="sharpe_oracle", early="sharpe_early")


@demo(f"""with s as (select arm, avg(ret) / stddev_samp(ret) * sqrt(12) as sharpe from {_THREE} a group by arm), p as (select 1 as one, month, max(ret) filter (arm = 'oracle') - max(ret) filter (arm = 'base') as x from {_THREE} b group by month)
 select 'R2' as test, t > 1 and (select sharpe from s where arm = 'oracle') > (select sharpe from s where arm = 'base') as passed, true as kill, round((select sharpe from s where arm = 'oracle'), 4) as better, round((select sharpe from s where arm = 'base'), 4) as worse, round(t, 4) as t from {_hac("p", "one")} h""")
def paired_verdict(spark, sf):
    a = three_arms(spark, sf)
    t = robustness.paired_verdict(a, robustness.compared(a, "base"), "oracle", "base")
    return _metrics(t, better="sharpe_oracle", worse="sharpe_base", t="t")


@demo(f"""with a as (select month, ret, month between date '1995-09-30' and date '1997-03-30' as masked from {_THREE} b where arm = 'base'), f as (select avg(ret) / stddev_samp(ret) * sqrt(12) as s from a), c as (select avg(ret) / stddev_samp(ret) * sqrt(12) as s, avg(ret) as m, count(*) as n from a where not masked)
 select 'R10' as test, case when c.n >= 24 then c.s > 0 and c.m > 0 and c.s >= 0.5 * f.s end as passed, false as kill, round(f.s, 4) as full_, round(c.s, 4) as clean, c.n::double as n from f, c""")
def policy_verdict(spark, sf):
    base = three_arms(spark, sf).where("arm = 'base'").drop("arm")
    clean = base.join(F.broadcast(masked_months(spark, sf).where("masked = 0").select("month")), "month")
    both = base.withColumn("arm", F.lit("full")).unionByName(clean.withColumn("arm", F.lit("clean")))
    return _metrics(robustness.policy_verdict(robustness.compared(both, "full")), full_="sharpe_full", clean="sharpe_clean", n="n_clean")


@demo(f"""select count(*) as n, round(avg((mean_ret >= 1.0)::int), 6) as p from (select draw, avg(ret) as mean_ret from (select draw, ret, row_number() over (partition by draw, month order by md5('s|' || draw || '|' || month || '|' || code)) as n from (select * from {_RET} a where ret is not null) b, (select unnest(range(40)) as draw) d) c where n <= 5 group by draw) e""")
def placebo_p(spark, sf):
    p = returns(spark, sf).where("ret is not null").select("month", "code", F.col("ret").alias("fwd_ret"))
    return robustness.placebo_p(portfolio.placebo(p, 40, 5), 1.0).select("n", r("p", 6).alias("p"))


@demo(f"select a, b, n, round(rho, 6) as rho, abs(rho) > 0.7 as close from (select 'x' as a, 'v' as b, count(*) as n, corr(x, v) as rho from {_ZPANEL} q union all select 'x', 'y', count(*), corr(x, y) from (select *, x + v / 400 as y from {_ZPANEL} q2) q3 union all select 'v', 'y', count(*), corr(v, y) from (select *, x + v / 400 as y from {_ZPANEL} q4) q5) z")
def axis_corr_flags(spark, sf):
    p = zpanel(spark, sf).withColumn("y", F.col("x") + F.col("v") / 400)
    return xsec.corr_pairs(p, ["x", "v", "y"]).select("a", "b", "n", r("rho", 6).alias("rho"), (F.abs("rho") > 0.7).alias("close"))


# ---- checks, on tables that are wrong here and there


def _rules(names: dict[str, str], src: str) -> str:
    return " union all ".join(f"select '{k}' as rule, count(*) filter ({c}) as violations from {src} v_{k}" for k, c in names.items())


_BAD_PIT = "(select period_end as event_date, case when code % 7 = 3 then null when code % 5 = 0 then period_end - 3 else knowledge_date end as kd from ({statements}) s)"


@demo(_rules({"unknown_yet": "kd > date '1998-06-15'", "before_event": "kd < event_date", "undated": "kd is null"}, _BAD_PIT))
def check_pit(spark, sf):
    k = F.col("code")
    s = role(spark, sf, "statements").select(F.col("period_end").alias("event_date"), F.when(k % 7 == 3, None).when(k % 5 == 0, F.date_sub("period_end", 3)).otherwise(F.col("knowledge_date")).alias("knowledge_date"))
    return audits.pit_violations(s, F.lit("1998-06-15").cast("date"))


_BAD_UNI = "(select s.code, m.month, listing_date, delisting_date, p.code is not null as there from ({security}) s cross join (select distinct month from ({panel}) q) m left join (select code, month from ({panel}) q where code % 10 <> 5) p on p.code = s.code and p.month = m.month)"


@demo(_rules({"not_listed": "there and listing_date > month", "gone": "there and delisting_date <= month", "missing": "not there and listing_date <= month and coalesce(delisting_date > month, true)"}, _BAD_UNI))
def check_universe(spark, sf):
    p = role(spark, sf, "panel").select("code", "month")
    return audits.universe_violations(p.where("code % 10 <> 5"), role(spark, sf, "security"), p.select("month").distinct())


@demo(_rules({"too_early": "day < vf", "too_late": "day > vt"}, "(select cast(o_orderdate as date) as day, case when c_custkey % 11 <> 0 then date '1996-01-31' end as vf, case when c_custkey % 7 <> 0 then date '1999-12-31' end as vt from orders join customer on c_custkey = o_custkey)"))
def check_mapping(spark, sf):
    k = F.col("o_custkey")
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("c_custkey") == k)
    o = o.select(F.to_date("o_orderdate").alias("day"), F.when(k % 11 != 0, "1996-01-31").cast("date").alias("valid_from"), F.when(k % 7 != 0, "1999-12-31").cast("date").alias("valid_to"))
    return audits.mapping_violations(o, "day")


@demo(f"""with c as (select month, avg(z + month(month) % 2 * 0.3) as m, count(*) as n, count(z) as nz, count(*) filter (p <= 0 or p > 1) as bad from (select z.*, (rank() over (partition by month order by v) + (count(*) over (partition by month, v) - 1) / 2.0) / count(v) over (partition by month) + (code % 4 = 0)::int as p from {_Z} z) y group by month)
 select 'mean' as rule, count(*) filter (abs(m) > 0.15) as violations from c union all select 'rank', sum(bad)::bigint from c union all select 'small', count(*) filter (n < 8 and nz > 0) from c""")
def check_cells(spark, sf):
    p = xsec.rank_pct(xsec.zscore(zpanel(spark, sf), "x", "month", "z"), "v", "month", "p")
    p = p.withColumns({"z": F.col("z") + F.month("month") % 2 * 0.3, "p": F.col("p") + (F.col("code") % 4 == 0).cast("int")})
    return audits.cell_violations(p, "z", "p", "month")


@demo(_rules({"not_binary": "v1 = 2", "not_product": "(case when code % 13 = 0 then 1 else v1 * v3 * v5 end) <> v1 * v3 * v5"}, f"(select code, case when code % 17 = 0 then 2 else v1 end as v1, v3, v5 from {_VS} v0)"))
def check_vetoes(spark, sf):
    v = vetoed(spark, sf).withColumn("V1", F.when(F.col("code") % 17 == 0, 2).otherwise(F.col("V1")))
    v = v.withColumn("VETO", F.when(F.col("code") % 13 == 0, 1).otherwise(F.col("V1") * F.col("V3") * F.col("V5")))
    return audits.veto_violations(v, ["V1", "V3", "V5"])


@demo("select 'differs' as rule, count(*) filter (code < 0) as violations from ({panel}) p")
def check_order(spark, sf):
    return audits.order_violations(zpanel(spark, sf), lambda p: xsec.zscore(p, "x", "month", "z"), ["code", "month"], "z")


_BAD_W = f"(select *, sum(w) over (partition by month) as total, row_number() over (partition by month order by w) as n from (select month, code, case when code % 9 = 0 then -w when month(month) = 5 then w * 1.4 else w end as w, 0.12 as cap from {_W} w0) w1)"


@demo(_rules({"negative": "w < 0", "over_cap": "w > cap + 1e-9", "over_one": "n = 1 and total > 1 + 1e-9"}, _BAD_W))
def check_weights(spark, sf):
    w = weighted(spark, sf).withColumn("w", F.when(F.col("code") % 9 == 0, -F.col("w")).when(F.month("month") == 5, F.col("w") * 1.4).otherwise(F.col("w")))
    return audits.weight_violations(w, ["month"], "w", F.lit(0.12))


_BAD_R = "(select *, lag(s) over w as s0, lag(rk) over w as r0 from (select code, month, volume as s, round((rank() over (partition by month order by volume) + (count(*) over (partition by month, volume) - 1) / 2.0) / count(*) over (partition by month) - (code % 10 = 0)::int, 8) as rk from ({panel}) p) q window w as (partition by month order by rk, s))"


@demo(_rules({"inverted": "s < s0 and rk > r0", "split_tie": "s = s0 and rk <> r0"}, _BAD_R))
def check_ranks(spark, sf):
    p = xsec.rank_pct(role(spark, sf, "panel"), "volume", "month", "rk", min_n=1).withColumn("rk", r(F.col("rk") - (F.col("code") % 10 == 0).cast("int"), 8))
    return audits.rank_violations(p, "month", "volume", "rk")


@demo("select count(*) as n_rows, count(*) filter (code % 7 = 3) as no_knowledge_date from ({statements}) s")
def step_ledger(spark, sf):
    """What an observed step leaves behind: it is read from the step's own pass over the data."""
    s = role(spark, sf, "statements").withColumns({"event_date": F.col("period_end"), "knowledge_date": F.when(F.col("code") % 7 != 3, F.col("knowledge_date"))})
    df, seen = audits.observed(audits.unique_columns(s), "statements")
    df.write.format("noop").mode("overwrite").save()
    got = seen.get
    return spark.range(1).select(F.lit(got["n_rows"]).cast("long").alias("n_rows"), F.lit(got["no_knowledge_date"]).cast("long").alias("no_knowledge_date"))


@demo("select name, count(*) as windows, min(start) as start, max(end_) as end_ from (select name, last_day(cast(start as date)) as start, coalesce(end_, (select max(month) from ({panel}) p)) as end_ from (values ('N', date '1996-03-31', date '1996-09-30'), ('N', date '1998-12-31', null), ('P', date '1997-06-30', null)) t(name, start, end_)) x group by name")
def policy_calendar(spark, sf):
    """Windows of packs, an open end closed at the table's last month."""
    w = spark.sql("select * from values ('N', date '1996-03-31', date '1996-09-30'), ('N', date '1998-12-31', cast(null as date)), ('P', date '1997-06-30', cast(null as date)), ('N', date '1996-03-31', date '1996-09-30') as t(name, start, end)")
    c = pit.policy_calendar(w, role(spark, sf, "panel").agg(F.max("month").alias("month")))
    return c.groupBy("name").agg(F.count("*").alias("windows"), F.min("start").alias("start"), F.max("end").alias("end_"))
