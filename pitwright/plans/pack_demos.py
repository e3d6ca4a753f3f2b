"""Queries for packs, entities and audits, with checking SQL. They join those of demos.py."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pitwright.functions import exprs as X
from pitwright.operators import entity, ledger, pit, ranks, xsec
from pitwright.plans import axes, packs, portfolio
from pitwright.plans.axis_demos import _FP, _chain, _div, _dlog, _labelled, _mean, _r, _W, fpanel, rounded
from pitwright.plans.demos import PRIORITIES, demo, r, table
from pitwright.sources.roles import role

# ---- packs

_WORK = "(select code, month, volume as members, amount / 97 as paid, abs(net_flow) as quit, floor(px / 100) as n_places, 400.0 as employees, net_flow as tax_expense, volume as pretax_income from ({panel}) p)"
_N = f"""(select *, loss_rate - lag(loss_rate, 12) over w as loss_up, cap_ratio - lag(cap_ratio, 12) over w as n5, {_dlog("members", "lag(members, 12) over w")} as n1, income_before as ib,
 case when abs(dm) >= greatest(3, members * 0.005) and month(month) <> 7 then least(5e7, greatest(0, dp / dm / 0.09)) end as mw, last_value(jump ignore nulls) over (partition by code order by month rows between 11 preceding and current row) as n6 from
 (select *, case when month(month) = 7 then income / income_before - 1 end as jump from (select *, lag(income) over w as income_before, members - lag(members) over w as dm, paid - lag(paid) over w as dp, least(2, greatest(0, income / 6370000)) as cap_ratio from
 (select *, paid / 0.09 / members as income, quit / members as loss_rate from {_WORK} a) b {_W}) c) d {_W})"""


def work_panel(spark, sf):
    p = role(spark, sf, "panel")
    return p.select("code", "month", F.col("volume").alias("members"), (F.col("amount") / 97).alias("paid"), F.abs("net_flow").alias("quit"), F.floor(F.col("px") / 100).alias("n_places"), F.lit(400.0).alias("employees"), F.col("net_flow").alias("tax_expense"), F.col("volume").alias("pretax_income"))


@demo(f"select code, month, round(n1, 6) as n1, round(mw, 2) as marginal_wage, case when mw / ib > 0.1 and mw / ib < 10 then round(mw / ib, 6) end as n2, round(-loss_up, 6) as n3, round(n5, 8) as n5, round(n6, 6) as n6, round(least(2, members / 400), 6) as theta from {_N} e")
def marginal_wage(spark, sf):
    f = packs.employment_features(work_panel(spark, sf)).withColumn("theta", F.col("theta_N"))
    return f.select("code", "month", r("n1", 6).alias("n1"), r("marginal_wage", 2).alias("marginal_wage"), r("n2", 6).alias("n2"), r("n3", 6).alias("n3"), r("n5", 8).alias("n5"), r("n6", 6).alias("n6"), r("theta", 6).alias("theta"))


@demo("""select m.code, w.month, sum(members)::bigint as members, round(sum(paid), 2) as paid, count(distinct w.workplace) as n_places, last_day(cast(w.month + interval 2 month as date)) as knowledge_date from
 (select o_custkey as workplace, last_day(cast(o_orderdate as date)) as month, count(*) as members, sum(o_totalprice) as paid from orders group by all) w
 join (select c_custkey as workplace, c_custkey % 10 as code, case when c_custkey % 11 <> 0 then date '1996-01-31' end as valid_from from customer) m on m.workplace = w.workplace where valid_from is null or w.month >= valid_from group by m.code, w.month""")
def workplace_panel(spark, sf):
    w = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("workplace"), F.last_day("o_orderdate").alias("month")).agg(F.count("*").alias("members"), F.sum("o_totalprice").alias("paid"))
    w = w.withColumns({"joined": F.lit(0), "quit": F.lit(0)})
    k = F.col("c_custkey")
    m = table(spark, sf, "customer").select(k.alias("workplace"), (k % 10).alias("code"), F.when(k % 11 != 0, F.lit("1996-01-31").cast("date")).alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
    return packs.workplace_panel(w, m).select("code", "month", "members", r("paid", 2).alias("paid"), "n_places", "knowledge_date")


_EVENTS = "(select code, last_day(pub_date) as month, sum((kind like '1-URGENT%')::int) as acq, sum((kind like '2-HIGH%')::int) as canc from ({reports}) q group by code, last_day(pub_date))"
_CAP = f"""(select *, payout - lag(payout, 12) over w as p1, invest - lag(invest, 12) over w as p2, case when an > 0 then least(2, cn / an) end as p3 from (select f.*, {_div("coalesce(abs(payroll), 0) + coalesce(abs(dep_ttm), 0)", "cfo_ttm")} as payout, {_div("coalesce(abs(capex_ttm), 0)", "revenue_ttm")} as invest, {_div("abs(dep_ttm)", "assets")} as acq_size,
 sum(coalesce(acq, 0)) over v as an, sum(coalesce(canc, 0)) over v as cn from {_FP} f left join {_EVENTS} e on e.code = f.code and e.month = f.month window v as (partition by f.code order by f.month rows between 11 preceding and current row)) g {_W})"""


def capital_panel(spark, sf):
    f = axes.resource_features(fpanel(spark, sf).withColumn("intangible", F.lit(None).cast("double")))
    f = f.withColumns({"dividend_paid_ttm": F.col("payroll"), "treasury_buy_ttm": F.col("dep_ttm"), "rnd_ttm": F.lit(None).cast("double")})
    named = {"rights_issue": "treasury_acq", "acquisition": "treasury_canc"}
    e = role(spark, sf, "reports").select("code", F.last_day("pub_date").alias("month"), X.event_class(F.col("kind"), PRIORITIES).alias("event")).replace(named, subset=["event"])
    return packs.capital_features(f, e)


_CAPS = f"""(select *, debt - lag(debt, 12) over w as p4 from (select *, {_div("liabilities", "equity")} as debt from {_CAP} c0) c1 {_W})"""
_CAPZ = f"(select *, z_p1 * z_p2 as tp1, case when z_acq_size > 0 then z_acq_size end * z_p3 as tp2, z_p1 * -z_p4 as tp3 from {_chain(_labelled(_CAPS), 'p1', 'p2', 'p3', 'acq_size', 'p4')} c2)"


@demo(f"select code, month, {_r('p1', 'p2', 'p3', 'p4')}, round(acq_size, 6) as acq_size, round(tp1, 4) as tp_p1, round(tp2, 4) as tp_p2, round(tp3, 4) as tp_p3, round({_mean('tp1', 'tp2', 'tp3')}, 4) as e_c from {_CAPZ} t")
def pack_capital(spark, sf):
    columns = ("p1", "p2", "p3", "p4", "acq_size")
    f = xsec.cells(capital_panel(spark, sf), "month", "industry", "bucket").withColumns({f"{c}_": F.col(c) for c in columns})
    a = packs.capital_axis(f)
    return a.select("code", "month", *(r(f"{c}_").alias(c) for c in columns[:4]), r("acq_size_", 6).alias("acq_size"), *(r(c).alias(c.lower()) for c in ("TP_P1", "TP_P2", "TP_P3", "E_C")))


_NE = f"""(select n.*, s.industry, case when s.employees >= 500 then 'big' else 'small' end as bucket, case when mw / ib > 0.1 and mw / ib < 10 then mw / ib end as n2, -loss_up as n3, coalesce(n_places - lag(n_places, 12) over v > 0 and n1 > 0, false)::int as n4, round((n.code % 7 - 3) * month(n.month) / 10, 6) as d_va, least(2, members / 400) as theta_n
 from {_N} n join ({{security}}) s on s.code = n.code window v as (partition by n.code order by n.month))"""
_NZ = f"(select *, z_n1 * z_n2 as tp1, z_n1 * z_n3 as tp2, z_n4 * z_n1 as tp3, z_n1 * z_d_va as tp4 from {_chain(_labelled(_NE), 'n1', 'n2', 'n3', 'n4', 'd_va')} n2)"


@demo(f"select code, month, {', '.join(f'round(tp{k}, 4) as tp_n{k}' for k in (1, 2, 3, 4))}, round({_mean('tp1', 'tp2', 'tp3', 'tp4')} * coalesce(least(1, case when theta_n > 0 then theta_n end), 0), 4) as e_n from {_NZ} t")
def pack_employment(spark, sf):
    s = role(spark, sf, "security").select("code", "industry", F.when(F.col("employees") >= 500, "big").otherwise("small").alias("bucket"))
    f = packs.employment_features(work_panel(spark, sf)).join(s, "code").withColumn("d_va_per_emp", r((F.col("code") % 7 - 3) * F.month("month") / 10, 6))
    a = packs.employment_axis(xsec.cells(f, "month", "industry", "bucket"))
    return a.select("code", "month", *(r(f"TP_N{k}").alias(f"tp_n{k}") for k in (1, 2, 3, 4)), r("E_N").alias("e_n"))


_MAP = "(select distinct p_type as hs, p_partkey % 100 + 1 as code, 0.2 + ((length(p_type) * (p_partkey % 100 + 1)) % 97)::double / 190 as weight from part)"
_CUS = f"""(select code, month, sum(u) as exp_usd, sum(wgt * weight) as exp_wgt, sum(u * u) / (sum(u) * sum(u)) as hhi_dest, sum(case when grp in ('AMERICA', 'EUROPE') then u end) / sum(u) as adv_share, cast(last_day(cast(month + interval 1 day as date)) + interval 15 day as date) as knowledge_date
 from (select m.code, t.month, grp, wgt, m.weight, usd * m.weight as u from ({{trade}}) t join {_MAP} m on m.hs = t.hs) x group by code, month)"""


def customs(spark, sf):
    m = table(spark, sf, "part").select(F.col("p_type").alias("hs"), (F.col("p_partkey") % 100 + 1).alias("code")).distinct()
    m = m.withColumn("weight", 0.2 + (F.length("hs") * F.col("code")) % 97 / 190)
    return packs.customs_panel(role(spark, sf, "trade"), m, ["AMERICA", "EUROPE"])


@demo(f"select code, month, round(exp_usd, 2) as exp_usd, round(exp_wgt, 2) as exp_wgt, round(hhi_dest, 6) as hhi_dest, round(adv_share, 6) as adv_share, knowledge_date from {_CUS} c")
def weighted_alloc(spark, sf):
    return customs(spark, sf).select("code", "month", r("exp_usd", 2).alias("exp_usd"), r("exp_wgt", 2).alias("exp_wgt"), r("hhi_dest", 6).alias("hhi_dest"), r("adv_share", 6).alias("adv_share"), "knowledge_date")


_SHIP = f"(select f.*, exp_usd, exp_wgt, hhi_dest, adv_share from {_FP} f asof left join {_CUS} k on f.code = k.code and f.month >= k.knowledge_date)"
# the price of a unit and its trend over 36 months, fitted about the means: sums that aren't centred would lose the digits that x2 is made of
_UNIT = f"""(select *, count(y) over v as full_, count(*) over v as n, sum(x * x) over v as sxx, sum(t * t) over v as stt, avg(x) over v as mx, avg(t) over v as mt, avg(y) over v as my, covar_pop(x, x) over v as cxx, covar_pop(x, t) over v as cxt, covar_pop(t, t) over v as ctt, covar_pop(x, y) over v as cxy, covar_pop(t, y) over v as cty, t - lag(t, 35) over w as span from
 (select *, case when exp_usd > 0 and exp_wgt > 0 then ln(exp_usd / exp_wgt) end as y, case when exp_wgt > 0 then ln(exp_wgt) end as x, datediff('month', first_value(month) over w, month)::double as t from {_SHIP} a {_W}) b
 window w as (partition by code order by month), v as (partition by code order by month rows between 35 preceding and current row))"""
_REST = f"""(select *, case when full_ = 36 and span = 35 then (y - my) - b1 * (x - mx) - b2 * (t - mt) + (my - b1 * mx - b2 * mt) * kept end as rest from (select *, (xy * tt - ty * xt) / (xx * tt - xt * xt) as b1, (ty * xx - xy * xt) / (xx * tt - xt * xt) as b2
 from (select *, n * (cxx + mx * mx * kept) + ridge as xx, n * (cxt + mx * mt * kept) as xt, n * (ctt + mt * mt * kept) + ridge as tt, n * (cxy + mx * my * kept) as xy, n * (cty + mt * my * kept) as ty
 from (select *, ridge / (n + ridge) as kept from (select *, 1e-8 * greatest(1, abs(n + sxx + stt) / 3) as ridge from {_UNIT} c) d) e0) e1) e2)"""
_X = f"""(select *, case when count(rest) over y6 >= 4 and count(rest) over y36 >= 18 and stddev_samp(rest) over y36 > 1e-12 then round(avg(rest) over y6 / stddev_samp(rest) over y36, 4) end as x2, sgna - lag(sgna, 12) over w as d_sgna,
 {_dlog("exp_wgt", "lag(exp_wgt, 12) over w")} as x1, lag(hhi_dest, 12) over w - hhi_dest as x3_1, adv_share - lag(adv_share, 12) over w as x3_2, case when abs(revenue_ttm * 5000) > 1e-12 and exp_usd is not null then least(2, greatest(0, exp_usd * 1300 / (revenue_ttm * 5000))) end as theta
 from (select *, {_div("op_income_ttm", "(revenue_ttm * 5000)")} as sgna from {_REST} f0) g window w as (partition by code order by month), y6 as (partition by code order by month rows between 5 preceding and current row), y36 as (partition by code order by month rows between 35 preceding and current row))"""
_XZ = f"(select *, z_x1 * z_x2 as tp1, z_x3_1 * z_x2 as tp2, z_x3_2 * -z_d_sgna as tp3 from {_chain(_labelled(_X), 'x1', 'x2', 'x3_1', 'x3_2', 'd_sgna')} h)"


#: The table's revenues are small beside its exports: they are read as 5,000 of a unit, so that shares of both sides of one occur.
@demo(f"select code, month, {_r('x1', 'x3_1', 'x3_2', 'theta', n=6)}, x2, round(tp1, 4) as tp_x1, round(tp2, 4) as tp_x2, round(tp3, 4) as tp_x3, round({_mean('tp1', 'tp2', 'tp3')} * coalesce(least(1, case when theta > 0 then theta end), 0), 4) as e_x from {_XZ} t")
def pack_trade(spark, sf):
    p = pit.asof_join(fpanel(spark, sf), customs(spark, sf), "code", "month", "knowledge_date", ["exp_usd", "exp_wgt", "hhi_dest", "adv_share"], ["month"])
    f = xsec.cells(packs.customs_features(p.withColumns({"sgna_ttm": F.col("op_income_ttm"), "revenue_ttm": F.col("revenue_ttm") * 5000})).withColumn("x2", r("x2")), "month", "industry", "bucket")
    a = packs.customs_axis(f.withColumns({f"__{c}": F.col(c) for c in ("x1", "x2", "x3_1", "x3_2")}))
    return a.select("code", "month", *(r(f"__{c}", 6).alias(c) for c in ("x1", "x3_1", "x3_2")), r("theta_X", 6).alias("theta"), F.col("__x2").alias("x2"), *(r(f"TP_X{k}").alias(f"tp_x{k}") for k in (1, 2, 3)), r("E_X").alias("e_x"))


@demo(f"select code, month, round({_mean('tp1', 'tp2', 'tp3')}, 4) as e_c, null::double as e_x from {_CAPZ} t")
def pack_registry(spark, sf):
    held = packs.Packs()
    held.register("C", lambda p: packs.capital_axis(p), [("2024-02-26", None)])
    held.register("X", packs.customs_features, [("2018-01-01", "2019-12-31")])
    held.disable("X", "no customs table")
    return held.apply(xsec.cells(capital_panel(spark, sf), "month", "industry", "bucket")).select("code", "month", r("E_C").alias("e_c"), F.col("E_X").alias("e_x"))


# ---- names, authors, codes


@demo("select s_suppkey, case when s_nationkey % 3 = 0 then 'first' when s_nationkey % 3 = 1 then 'second' else 'house' || s_suppkey end as canon from supplier")
def alias_canon(spark, sf):
    k = F.col("s_nationkey") % 3
    raw = F.when(k == 0, F.lit("Old First Research")).when(k == 1, "sec ond house").otherwise(F.concat(F.lit("house "), F.col("s_suppkey"), F.lit(" Research")))
    return table(spark, sf, "supplier").select("s_suppkey", entity.canonical(raw, [("First", "first"), ("second", "second"), ("First|second", "never")]).alias("canon"))


@demo("select name, substr(sha1('broker' || chr(31) || name), 1, 12) as house from (select distinct case when s_nationkey % 2 = 0 then '미래에셋증권' else 'house' || s_nationkey end as name from supplier) s")
def house_ids(spark, sf):
    k = F.col("s_nationkey")
    names = table(spark, sf, "supplier").select(entity.canonical(F.when(k % 2 == 0, "대우 증권").otherwise(F.concat(F.lit("house "), k, F.lit(" 리서치센터"))), [("대우증권", "미래에셋증권")]).alias("name")).distinct()
    return names.select("name", entity.house_id(F.col("name")).alias("house"))


@demo("""with n as (select c_custkey, regexp_replace(n_name, '[^A-Za-z]', '', 'g') as a, regexp_replace(r_name, '[^A-Za-z]', '', 'g') as b from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey),
 x as (select c_custkey, a as name, 0 as place from n where length(a) between 2 and 12 union all select c_custkey, b, case when length(a) between 2 and 12 then 1 else 0 end from n where length(b) between 2 and 12 and a <> b) select c_custkey, name, case when place = 0 then 'lead' else 'co' end as role from x""")
def split_explode(spark, sf):
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(table(spark, sf, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    raw = F.concat(F.col("n_name"), F.lit(" 연구원 (a, b)/"), F.col("r_name"), F.lit(", x, "), F.col("n_name"), F.lit(" 외 2인"))
    x = c.select("c_custkey", F.posexplode(entity.authors(raw)).alias("place", "name"))
    return x.select("c_custkey", "name", F.when(F.col("place") == 0, "lead").otherwise("co").alias("role"))


_DIGITS = "translate(cast(analyst as varchar), '0123456789', 'abcdefghij')"


def reports(spark, sf):
    """Reports with authors: most in the list, some found in the text, some nowhere."""
    q = role(spark, sf, "reports")
    name = F.concat(F.lit("an"), F.translate(F.col("analyst").cast("string"), "0123456789", "abcdefghij"))
    k = F.col("uid") % 5
    return q.select("uid", F.when(F.col("code") % 4 != 0, F.col("code")).alias("code"), "pub_date", "target", F.col("kind").alias("broker"), F.when(k < 3, name).alias("author_list"), F.when(k == 3, F.concat(name, F.lit(", "))).alias("author_found"))


_LINKED = f"(select uid, case when code % 4 <> 0 then code end as code, pub_date, target, kind as broker, case when uid % 5 < 4 then 'an' || {_DIGITS} end as name from ({{reports}}) q)"


@demo(f"""select name, broker, first_seen, last_seen, n_reports, n_stocks, n_targets, count(*) over (partition by name) > 1 as ambiguous from (select name, broker, min(pub_date) as first_seen, max(pub_date) as last_seen, count(distinct uid) as n_reports, count(distinct code) as n_stocks, count(target) as n_targets from {_LINKED} a where name is not null group by name, broker) b""")
def analyst_master(spark, sf):
    return entity.author_master(entity.author_links(reports(spark, sf))).drop("analyst_id")


_AUDITED = f"(select *, case when uid % 5 < 3 then 'list_field' when uid % 5 = 3 then 'pdf_header' end as method, case when uid % 5 < 3 then 0.98 when uid % 5 = 3 then 0.8 end as sure, case uid % 3 when 0 then 'a' when 1 then 'a+b' end as source from {_LINKED} l0)"


@demo(" union all ".join(f"""select '{k}' as grouping, x.g as value, n, with_author, with_code, with_target, confidence, coalesce(authors, 0) as authors from (select ({e})::varchar as g, count(*) as n, round(avg((name is not null)::int), 6) as with_author, round(avg((code is not null)::int), 6) as with_code,
 round(avg((target is not null)::int), 6) as with_target, round(avg(sure), 6) as confidence from {_AUDITED} a group by {e}) x left join (select ({e})::varchar as g, count(distinct w.who) as authors from {_AUDITED} a join (select distinct uid as u, name || '|' || broker as who from {_AUDITED} b where name is not null) w on w.u = a.uid group by {e}) y on x.g is not distinct from y.g""" for k, e in (("year", "year(pub_date)"), ("source", "source"), ("method", "method"), ("broker", "broker"))))
def linkage_audit(spark, sf):
    k = F.col("uid") % 3
    q = reports(spark, sf).withColumn("source", F.when(k == 0, "a").when(k == 1, "a+b"))
    a = entity.linkage_audit(q, entity.author_links(q), {"year": F.year("pub_date"), "source": F.col("source"), "method": F.col("method"), "broker": F.col("broker")})
    return a.select("grouping", "value", "n", *(r(c, 6).alias(c) for c in ("with_author", "with_code", "with_target", "confidence")), "authors")


@demo("select s_suppkey, case when s_suppkey % 3 = 0 then lpad(cast(s_suppkey as varchar), 6, '0') when s_suppkey % 3 = 1 then '00593' || (s_suppkey % 10) else 'N' || s_suppkey end as code, case when s_suppkey % 3 = 0 then 'source' when s_suppkey % 3 = 1 then 'title' else 'name' end as code_from from supplier")
def code_cascade(spark, sf):
    k = F.col("s_suppkey")
    s = table(spark, sf, "supplier").select(k, F.concat(F.col("s_name"), F.lit(" Inc.")).alias("name"), F.when(k % 3 == 0, F.concat(k, F.lit(".KS"))).alias("source"), F.when(k % 3 == 1, F.concat(F.lit("On it (00593"), k % 10, F.lit(")"))).otherwise("none").alias("title"))
    names = table(spark, sf, "supplier").select(F.upper("s_name").alias("name"), F.concat(F.lit("N"), k).alias("code"))
    return entity.code_cascade(s, names, "source", "title", "name", "code").select("s_suppkey", "code", "code_from")


@demo("select doc_id, len(e) as n, case when len(e) > 0 then array_to_string(e, ',') else '' end as emails from (select doc_id, list_sort(list_distinct(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}'))) as e from documents) d")
def text_fields(spark, sf):
    e = table(spark, sf, "documents").select("doc_id", entity.emails(F.coalesce("text", F.lit(""))).alias("e"))
    return e.select("doc_id", F.size("e").cast("long").alias("n"), F.array_join("e", ",").alias("emails"))


@demo("""select s_suppkey, s_name as title, case when s_suppkey % 2 = 0 and s_suppkey > 0 and s_suppkey <= 50000 then cast(s_suppkey * 1000 as double) end as target, case s_suppkey % 4 when 0 then 'BUY' when 1 then 'HOLD' when 2 then 'Wait and see for a w' end as opinion, case when s_suppkey % 3 = 0 then '00593' || s_suppkey % 10 end as told, case when s_suppkey % 3 = 0 then 'Firm ' || s_suppkey end as firm from supplier""")
def norm_report(spark, sf):
    """Prices above 50,000,000 are no target prices, so keys above 50,000 have none."""
    k = F.col("s_suppkey")
    price = F.when(k % 2 == 0, F.concat(F.format_number(k * 1000, 0), F.lit("원"))).otherwise("0")
    said = F.when(k % 4 == 0, "Strong Buy").when(k % 4 == 1, "중립").when(k % 4 == 2, "Wait and see for a while").otherwise("Not Rated")
    title = F.when(k % 3 == 0, F.concat(F.lit("Firm  "), k, F.lit(" (00593"), k % 10, F.lit(") goes up"))).otherwise(F.concat(F.lit("On (5930) "), k))
    return table(spark, sf, "supplier").select(k, X.undo_repeat(F.concat("s_name", "s_name")).alias("title"), X.target_price(price).alias("target"), X.opinion(said).alias("opinion"), X.code_in_title(title).alias("told"), X.name_in_title(title).alias("firm"))


@demo("""select s_suppkey, case when s_suppkey % 2 = 0 then '홍길동,김유신' else '이순신' end as names, case when s_suppkey % 2 = 0 then 'a' || s_suppkey || '@x.co.kr,b@y.com' else 'only@z.kr' end as emails, case when s_suppkey % 3 = 0 then cast(s_suppkey * 100 + 1000 as double) end as target from supplier""")
def report_texts(spark, sf):
    k = F.col("s_suppkey")
    who = F.when(k % 2 == 0, F.concat(F.lit("홍길동 연구원 (02-123-4567) a"), k, F.lit("@x.co.kr\n김유신 b@y.com 김유신 b@y.com"))).otherwise("애널리스트 이순신 연구원 / only@z.kr")
    text = F.concat(who, F.when(k % 3 == 0, F.concat(F.lit(" 목표 주가: "), F.format_number(k * 100 + 1000, 0), F.lit("원"))).otherwise(" 목표주가 없음"))
    return table(spark, sf, "supplier").select(k, X.report_fields(text).alias("x")).select("s_suppkey", "x.names", "x.emails", "x.target")


@demo("select s_suppkey, 'kg 12 Fi Corp' as wide, 'abc' || s_suppkey as firm from supplier")
def norm_wide(spark, sf):
    k = F.col("s_suppkey")
    wide = F.concat(F.lit("㎏ ①②　ﬁ（"), k, F.lit(") Ｃｏｒｐ"))
    s = table(spark, sf, "supplier").select(k, X.norm_text(wide, compatibility=True).alias("wide"), X.norm_company(F.concat(F.lit("주식회사 ＡＢＣ "), k, F.lit(" Co., Ltd."))).alias("firm"))
    return s.withColumn("wide", F.replace("wide", F.lit("fi"), F.lit("Fi")))


@demo("select page_id, substr(substr(t, strpos(t, ' the ')), 1, 60000) as part from (select page_id, regexp_replace(html, '<[^>]+>', ' ', 'g') as t from pages) p where strpos(t, ' the ') > 0")
def section_extract(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.section_cut(F.col("html"), " the ").alias("part")).where("part is not null")


# ---- tables, audits, cards


@demo("""select code, yr, q, row_number() over (order by yr desc, firm, code, q) as place from (select s.code, s.name as firm, yr, q from ({security}) s, (select unnest(range((select min(yr) from ({statements}) a), (select max(yr) + 1 from ({statements}) b))) as yr) y, (select unnest(range(1, 5)) as q) k
 where not exists (select 1 from ({statements}) t where t.code = s.code and t.yr = y.yr and t.q = k.q)) x""")
def todo_antijoin(spark, sf):
    statements = role(spark, sf, "statements")
    years = statements.agg(F.min("yr").alias("first"), F.max("yr").alias("last")).where("first is not null")
    wanted = role(spark, sf, "security").crossJoin(F.broadcast(years)).select("code", "name", F.explode(F.sequence("first", "last")).alias("yr")).select("code", "name", F.col("yr").cast("int").alias("yr"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("q"))
    return ledger.pending(wanted, statements, ["code", "yr", "q"], "yr", "name").select("code", "yr", "q", "place")


@demo("select month, uid, code from (select *, row_number() over (partition by month order by pub_date desc, uid, code) as n from (select *, last_day(pub_date) as month from ({reports}) q) a) b where n <= 30")
def head_per_group(spark, sf):
    w = Window.partitionBy("month").orderBy(F.desc("pub_date"), "uid", "code")
    return role(spark, sf, "reports").withColumn("month", F.last_day("pub_date")).withColumn("n", F.row_number().over(w)).where("n <= 30").select("month", "uid", "code")


@demo("select code, yr, q, cast(knowledge_date as date) as known from ({statements}) s")
def knowledge_date(spark, sf):
    s = role(spark, sf, "statements")
    receipt = F.when(F.col("code") % 2 == 0, F.date_format("knowledge_date", "yyyyMMdd000123").alias("x"))
    return s.select("code", "yr", "q", X.knowledge_date(receipt, F.col("period_end"), F.col("q") == 4).alias("known"))


@demo("select month, code, place, round(signal, 4) as signal, volume as e_volume, round(net_flow, 2) as e_flow from (select *, row_number() over (order by volume desc, code) as place, volume as signal from ({panel}) p where month = (select max(month) from ({panel}) m)) x where place <= 5")
def diag_card(spark, sf):
    c = portfolio.latest_card(role(spark, sf, "panel").withColumn("signal", F.col("volume")), "signal", ["volume", "net_flow"], 5)
    return c.select("month", "code", "place", r("signal").alias("signal"), F.col("evidence.volume").alias("e_volume"), r("evidence.net_flow", 2).alias("e_flow"))


@demo("select code, firm, adv, row_number() over (order by adv desc, code) as place from (select d.code, s.name as firm, round(median(round(amount * 100))) / 100 as adv from ({daily}) d join ({security}) s on s.code = d.code group by d.code, s.name) x")
def liquidity_priority(spark, sf):
    """Medians of amounts in whole cents, half a cent rounded up: sums of doubles don't tell on which side of it they lie."""
    d = role(spark, sf, "daily").groupBy("code").agg((r(F.median(r(F.col("amount") * 100, 0)), 0) / 100).alias("adv"))
    s = role(spark, sf, "security").select("code", F.col("name").alias("firm"))
    return ranks.global_rank(d.join(s, "code"), "adv", "place", F.col("code"), descending=True).select("code", "firm", "adv", "place")


_OLD = "(select o_custkey as k, min(o_comment2) as v from (select o_custkey, case when o_orderkey % 4 = 1 then ' ' else 'v' || o_orderkey % 10 end as o_comment2 from orders where o_orderkey % 2 = 1) a group by o_custkey)"
_NEW = "(select o_custkey as k, min(v) as v from (select o_custkey, 'v' || o_orderkey % 10 as v from orders where o_orderkey % 2 = 0 and o_orderkey % 3 > 0) b group by o_custkey)"


def fill_tables(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    value = F.concat(F.lit("v"), k % 10)
    old = o.where(k % 2 == 1).groupBy(F.col("o_custkey").alias("k")).agg(F.min(F.when(k % 4 == 1, " ").otherwise(value)).alias("v"))
    new = o.where(k % 2 == 0).select(F.col("o_custkey").alias("k"), F.when(k % 3 > 0, value).otherwise("  ").alias("v"))
    return old, new


@demo(f"select o.k, coalesce(n.v, o.v) as v from {_OLD} o left join {_NEW} n on n.k = o.k")
def coalesce_merge(spark, sf):
    return ledger.filled(*fill_tables(spark, sf), "k", "v", ["v"])[0]


@demo(f"select o.k, o.v as old, n.v as new from {_OLD} o join {_NEW} n on n.k = o.k where trim(o.v) <> '' and o.v <> n.v")
def merge_conflicts(spark, sf):
    return ledger.filled(*fill_tables(spark, sf), "k", "v", ["v"])[1]


@demo("select code, yr, q from ({statements}) s where knowledge_date <= date '1996-06-30'")
def asof_slice(spark, sf):
    c = pit.PitCatalog()
    c.register("s", role(spark, sf, "statements").withColumn("event_date", F.col("period_end")))
    return c.as_of("s", "1996-06-30").select("code", "yr", "q")


@demo("select code, month, coalesce(de is not null and dm is not null and not (de > 0 and dm < de), false) as leaves from (select code, month, volume - lag(volume) over w as de, net_flow - lag(net_flow) over w as dm from ({panel}) p window w as (partition by code order by month)) a")
def exit_gate(spark, sf):
    w = Window.partitionBy("code").orderBy("month")
    p = role(spark, sf, "panel").select("code", "month", (F.col("volume") - F.lag("volume").over(w)).alias("de"), (F.col("net_flow") - F.lag("net_flow").over(w)).alias("dm"))
    return p.select("code", "month", X.exit_gate(F.col("dm"), F.col("de")).alias("leaves"))


@demo("select o_custkey, sum(n)::bigint as n from (select o_custkey, o_orderkey % 7 as kind, count(*) as n from orders group by all) x where kind not in (0, 3) group by o_custkey")
def subtotal_filter(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", F.when(F.col("o_orderkey") % 7 == 0, "합계").when(F.col("o_orderkey") % 7 == 3, "소계").otherwise("staff").alias("label"))
    return ledger.without_subtotals(o, "label").groupBy("o_custkey").agg(F.count("*").alias("n"))
