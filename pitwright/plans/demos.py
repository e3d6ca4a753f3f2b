"""One query for each operator, over the tables of a folder, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitwright.functions import exprs as X
from pitwright.operators import ledger, pit, prices, ranks, tswin, universe, xsec
from pitwright.plans import portfolio
from pitwright.sources.roles import for_checking, role

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def demo(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = for_checking(sql)
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r(c, n: int = 4):
    return F.round(c, n)


# ---- functions


@demo("select s_suppkey, lower(replace(s_name, '#', ' ')) as clean, lpad(cast(s_suppkey as varchar), 6, '0') as code, case when abs(s_acctbal) > 5 then round(s_nationkey / s_acctbal, 6) end as ratio from supplier")
def norm_text(spark, sf):
    s = table(spark, sf, "supplier")
    ratio = F.when(F.abs("s_acctbal") > 5, X.safe_div(F.col("s_nationkey"), F.col("s_acctbal")))
    return s.select("s_suppkey", F.lower(X.norm_text(F.col("s_name"))).alias("clean"), X.security_code(F.concat(F.col("s_suppkey").cast("string"), F.lit(".KS"))).alias("code"), r(ratio, 6).alias("ratio"))


@demo("""select o_orderkey, case when k < 5 then d when k = 5 and year(d) <= 1996 then cast(d as date) end as day, (k >= 6 or (k = 5 and year(d) > 1996))::int as failed from (select o_orderkey, cast(o_orderdate as date) as d, o_orderkey % 8 as k from orders) o""")
def norm_dates(spark, sf):
    """Each order's day as written by different sources; two digits of a year beyond the run's next one are of the last century, so that days
    after 1996, written as of this century, would be wrong and are shown as failed, like texts that are no days."""
    k, d = F.col("o_orderkey") % 8, F.to_date("o_orderdate")
    text = F.lit("n/a")
    for n, form in enumerate(("yyyyMMdd", "yyyy.MM.dd", "yyyy/MM/dd", "yyyy-MM-dd", "yy.MM.dd")):
        text = F.when(k == n, F.date_format(d, form)).otherwise(text)
    text = F.when(k == 5, F.when(F.year(d) > 1996, F.concat(F.date_format(d, "yyyy"), F.lit(".13.40"))).otherwise(F.date_format(d, "yy-MM-dd"))).when(k == 6, "").otherwise(text)
    day = X.mixed_date(text, F.lit("2002-06-30").cast("date"))
    return table(spark, sf, "orders").select("o_orderkey", day.alias("day"), day.isNull().cast("int").alias("failed"))


@demo("""select code, count(*) as n, count(bucket) as has_bucket, min(bucket) as bucket from (select code, case when employees is null then 'unknown' when employees >= 1000 then '1000+' when employees >= 300 then '300-999'
 when employees >= 100 then '100-299' when employees >= 50 then '50-99' else '<50' end as bucket from ({security}) s) x group by code""")
def size_buckets(spark, sf):
    s = role(spark, sf, "security").select("code", X.size_bucket(F.col("employees")).alias("bucket"))
    return s.groupBy("code").agg(F.count("*").alias("n"), F.count("bucket").alias("has_bucket"), F.min("bucket").alias("bucket"))


@demo("select last_day(cast(d as date)) as month from (select unnest(generate_series(date_trunc('month', min(day)), date_trunc('month', max(day)), interval 1 month)) as d from ({daily}) p) g")
def month_grid(spark, sf):
    first, last = role(spark, sf, "daily").agg(F.min("day").cast("string"), F.max("day").cast("string")).first()
    return universe.month_grid(spark, first, last)


#: Event patterns for the priorities of the test tables' orders.
PRIORITIES = (("1-URGENT", "rights_issue"), ("2-HIGH", "acquisition"), ("3-MEDIUM", "cancellation"))


@demo("select uid, case k when 0 then 'treasury_canc' when 1 then 'rights_issue' when 2 then 'cb_issue' when 3 then 'dividend' when 4 then 'treasury_acq' end as event from (select distinct uid, uid % 6 as k from ({reports}) q) a")
def disclosure_class(spark, sf):
    k, title = F.col("uid") % 6, F.lit("정정신고")
    for n, t in enumerate(("주요사항보고서(자기주식 소각 결정)", "유상증자결정 및 감자", "전환사채권발행결정", "현금ㆍ현물배당 결정", "자기주식  취득 후 이익소각")):
        title = F.when(k == n, t).otherwise(title)
    return role(spark, sf, "reports").select("uid").distinct().select("uid", X.event_class(title).alias("event"))


@demo("""select code, month, event, count(*) as n from (select code, last_day(pub_date) as month, case when kind like '1-URGENT%' then 'rights_issue' when kind like '2-HIGH%' then 'acquisition' when kind like '3-MEDIUM%' then 'cancellation' end as event from ({reports}) q) z where event is not null group by code, month, event""")
def event_class(spark, sf):
    e = role(spark, sf, "reports").select("code", F.last_day("pub_date").alias("month"), X.event_class(F.col("kind"), PRIORITIES).alias("event"))
    return e.where("event is not null").groupBy("code", "month", "event").agg(F.count("*").alias("n"))


@demo("""select code, month, sum(case when kind like '1-URGENT%' then 1 else 0 end) as rights_issue, sum(case when kind like '2-HIGH%' then 1 else 0 end) as acquisition, sum(case when kind like '3-MEDIUM%' then 1 else 0 end) as cancellation
 from (select *, last_day(pub_date) as month from ({reports}) q) z group by code, month""")
def event_pivot(spark, sf):
    e = role(spark, sf, "reports").select("code", F.last_day("pub_date").alias("month"), X.event_class(F.col("kind"), PRIORITIES).alias("event"))
    names = [n for _, n in PRIORITIES]
    wide = e.groupBy("code", "month").pivot("event", names).count()
    return wide.select("code", "month", *(F.coalesce(n, F.lit(0)).cast("decimal(38,0)").alias(n) for n in names))


# ---- point in time


@demo("select code, yr, q, period_end as event_date, greatest(knowledge_date, period_end) as knowledge_date, 'statements' as _src from ({statements}) s")
def pit_frame(spark, sf):
    s = role(spark, sf, "statements")
    return pit.pit_frame(s, F.col("period_end"), F.col("knowledge_date"), "statements").select("code", "yr", "q", "event_date", "knowledge_date", "_src")


@demo("select 'statements' as name, 'code,yr,q' as keys, count(*) as n_rows, count(distinct (code, yr, q)) as n_keys, min(knowledge_date) as first_known, max(knowledge_date) as last_known from ({statements}) s")
def pit_report(spark, sf):
    c = pit.PitCatalog()
    c.register("statements", role(spark, sf, "statements").withColumn("event_date", F.col("period_end")), ["code", "yr", "q"])
    return c.report()


@demo("select code, yr, q from (select *, row_number() over (partition by code order by knowledge_date desc, period_end desc) as n from ({statements}) s where knowledge_date <= date '1998-06-15') x where n = 1")
def asof_latest(spark, sf):
    c = pit.PitCatalog()
    c.register("s", role(spark, sf, "statements").withColumn("event_date", F.col("period_end")), ["code"])
    return c.latest("s", "1998-06-15").select("code", "yr", "q")


@demo("select p.code, p.month, s.yr, s.q, round(s.ytd_revenue, 2) as ytd_revenue from ({panel}) p asof left join ({statements}) s on p.code = s.code and p.month >= s.knowledge_date")
def asof_join(spark, sf):
    p, s = role(spark, sf, "panel").select("code", "month"), role(spark, sf, "statements")
    out = pit.asof_join(p, s, "code", "month", "knowledge_date", ["yr", "q", "ytd_revenue"], ["period_end"])
    return out.withColumn("ytd_revenue", r("ytd_revenue", 2))


@demo("select p.code, p.day, s.yr, s.q, round(s.ytd_revenue, 2) as ytd_revenue from (select case when code % 3 = 0 then 0 when code % 7 = 0 then null else code end as code, day from ({daily}) d) p asof left join (select case when code % 3 = 0 then 0 else code end as code, yr, q, ytd_revenue, knowledge_date + (code % 11)::int as known from ({statements}) s where code % 3 <> 0 or code = 3) s on p.code = s.code and p.day >= s.known")
def asof_join_spread(spark, sf):
    """A key that holds a third of all rows, which is counted, found and laid in ranges of 3,000 rows."""
    code = F.when(F.col("code") % 3 == 0, 0)
    d = role(spark, sf, "daily").select(code.when(F.col("code") % 7 == 0, None).otherwise(F.col("code")).alias("code"), "day")
    s = role(spark, sf, "statements").where("code % 3 <> 0 or code = 3").withColumn("known", F.date_add("knowledge_date", (F.col("code") % 11).cast("int")))
    s = s.withColumn("code", code.otherwise(F.col("code")))
    return pit.asof_join(d, s, "code", "day", "known", ["yr", "q", "ytd_revenue"], ["period_end"], rows=3000).withColumn("ytd_revenue", r("ytd_revenue", 2))


@demo("""select code, month, members, cast(spend as double) as spend from (select s.code, m.month, count(*) as members, round(sum(price), 2) as spend from (select c_custkey, last_day(cast(o_orderdate as date)) as month, o_totalprice as price from orders join customer on c_custkey = o_custkey) m
 join (select c_custkey as ck, c_custkey % 10 as code, case when c_custkey % 11 <> 0 then date '1996-01-31' end as valid_from, case when c_custkey % 7 <> 0 then date '1999-12-31' end as valid_to from customer) s on ck = c_custkey
 where (valid_from is null or month >= valid_from) and (valid_to is null or month <= valid_to) group by s.code, m.month) x""")
def valid_interval_join(spark, sf):
    facts = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), F.last_day("o_orderdate").alias("month"), F.col("o_totalprice").alias("price"))
    k = F.col("c_custkey")
    mapping = table(spark, sf, "customer").select("c_custkey", (k % 10).alias("code"), F.when(k % 11 != 0, F.lit("1996-01-31").cast("date")).alias("valid_from"), F.when(k % 7 != 0, F.lit("1999-12-31").cast("date")).alias("valid_to"))
    return pit.valid_interval_join(facts, mapping, "c_custkey", "month").groupBy("code", "month").agg(F.count("*").alias("members"), r(F.sum("price"), 2).alias("spend"))


@demo("""with m as (select distinct month from ({panel}) p), w(s, e) as (values (date '1996-03-31', date '1996-09-30'), (date '1998-12-31', null))
 select month, max(case when month between s - interval 6 month and s + interval 6 month or coalesce(month between e - interval 6 month and e + interval 6 month, false) then 1 else 0 end) as masked from m, w group by month""")
def policy_mask(spark, sf):
    months = role(spark, sf, "panel").select("month").distinct()
    windows = spark.sql("select * from values (date '1996-03-31', date '1996-09-30'), (date '1998-12-31', cast(null as date)) as t(start, end)")
    return pit.mask_windows(months, windows)


# ---- cross-section

_ZPANEL = "(select p.code, p.month, s.industry, case when employees >= 500 then 'big' else 'small' end as bucket, ln(amount) as x, volume as v from ({panel}) p join ({security}) s on s.code = p.code)"


def zpanel(spark, sf):
    p = role(spark, sf, "panel").join(role(spark, sf, "security").select("code", "industry", "employees"), "code")
    return p.select("code", "month", "industry", F.when(F.col("employees") >= 500, "big").otherwise("small").alias("bucket"), F.log("amount").alias("x"), F.col("volume").alias("v"))


_Z = """(select *, case when n >= 8 then case when s2 > 1e-12 then (c - m2) / s2 else 0 end end as z from (select *, avg(c) over (partition by month) as m2, stddev_pop(c) over (partition by month) as s2 from
 (select *, least(greatest(x, m - 2 * s), m + 2 * s) as c from (select *, avg(x) over (partition by month) as m, stddev_pop(x) over (partition by month) as s, count(x) over (partition by month) as n from """ + _ZPANEL + """ a) b) d) e)"""


@demo(f"select code, month, round(z, 4) as z from {_Z} f")
def xsec_z(spark, sf):
    return xsec.zscore(zpanel(spark, sf), "x", "month", "z").select("code", "month", r("z").alias("z"))


@demo(f"select code, month, case when n >= 8 then round(rk / n, 6) end as p from (select code, month, rank() over (partition by month order by v) + (count(*) over (partition by month, v) - 1) / 2.0 as rk, count(v) over (partition by month) as n from {_ZPANEL} a) b")
def xsec_rank(spark, sf):
    return xsec.rank_pct(zpanel(spark, sf), "v", "month", "p").select("code", "month", r("p", 6).alias("p"))


_CELLS = f"""(select *, case when count(*) over (partition by c1) < 8 then ym else c1 end as cell from (select *, case when count(*) over (partition by c0) < 8 then l2 else c0 end as c1 from
 (select *, strftime(month, '%Y%m') as ym, strftime(month, '%Y%m') || '|' || industry as l2, strftime(month, '%Y%m') || '|' || industry || '|' || bucket as c0 from {_ZPANEL} a) b) d)"""


@demo(f"select code, month, cell from {_CELLS} e")
def cells(spark, sf):
    return xsec.cells(zpanel(spark, sf), "month", "industry", "bucket").select("code", "month", "cell")


@demo(f"""with c as (select * from {_CELLS} e), a as (select *, case when count(*) over (partition by cell) >= 8 then (rank() over (partition by cell order by v) + (count(*) over (partition by cell, v) - 1) / 2.0) / count(*) over (partition by cell) end as p1,
 case when count(*) over (partition by ym) >= 8 then (rank() over (partition by ym order by v) + (count(*) over (partition by ym, v) - 1) / 2.0) / count(*) over (partition by ym) end as p3 from c) select code, month, round(coalesce(p1, p3), 6) as p from a""")
def xsec_ladder(spark, sf):
    c = xsec.cells(zpanel(spark, sf), "month", "industry", "bucket")
    return xsec.ladder(c, "v", ["cell", "cell_l3"], "p", xsec.rank_pct).select("code", "month", r("p", 6).alias("p"))


@demo(f"select count(*) as n, round(corr(x, v), 6) as rho, 'x' as a, 'v' as b from {_ZPANEL} q")
def axis_corr(spark, sf):
    c = xsec.corr_pairs(zpanel(spark, sf), ["x", "v"])
    return c.select("n", r("rho", 6).alias("rho"), "a", "b")


@demo("select month, round(quantile_cont(volume, 0.9), 4) as q90 from ({panel}) p group by month")
def month_quantile(spark, sf):
    return ranks.quantiles(role(spark, sf, "panel"), ["month"], "volume", {"q90": 0.9}, rows=500).withColumn("q90", r("q90"))


# ---- windows along time


@demo("select code, month, round(ln(amount) - ln(lag(amount, 12) over w), 6) as dlog12, round(volume - lag(volume, 1) over w, 4) as d1 from ({panel}) p window w as (partition by code order by month)")
def panel_diffs(spark, sf):
    w = tswin.along()
    return role(spark, sf, "panel").select("code", "month", r(X.dlog(F.col("amount"), F.lag("amount", 12).over(w)), 6).alias("dlog12"), r(F.col("volume") - F.lag("volume").over(w)).alias("d1"))


@demo("""select code, month, case when count(volume) over w >= 4 then round(avg(volume) over w, 4) end as mean6, case when count(volume) over w >= 4 then round(stddev_samp(volume) over w, 4) end as sd6 from ({panel}) p window w as (partition by code order by month rows between 5 preceding and current row)""")
def rolling_stats(spark, sf):
    w = tswin.along()
    return role(spark, sf, "panel").select("code", "month", r(tswin.rolling("volume", F.avg, w, 6, 4)).alias("mean6"), r(tswin.rolling("volume", F.stddev_samp, w, 6, 4)).alias("sd6"))


@demo("""select code, month, case when count(volume) over w >= 6 then round(regr_slope(volume, rn) over w, 4) end as slope from (select *, row_number() over (partition by code order by month) as rn from ({panel}) p) a window w as (partition by code order by month rows between 11 preceding and current row)""")
def rolling_slope(spark, sf):
    w = tswin.along()
    return role(spark, sf, "panel").withColumn("rn", F.row_number().over(w)).select("code", "month", r(tswin.slope("volume", "rn", w)).alias("slope"))


_OLS = """(select code, month, px as y, ln(volume) as x, t, count(px) over v as full_, count(*) over v as n, sum(ln(volume)) over v as sx, sum(t) over v as st, sum(ln(volume) * ln(volume)) over v as sxx, sum(ln(volume) * t) over v as sxt, sum(t * t) over v as stt, sum(px) over v as sy, sum(ln(volume) * px) over v as sxy, sum(t * px) over v as sty
 from (select *, (row_number() over (partition by code order by month))::double as t from ({panel}) p) a window v as (partition by code order by month rows between 35 preceding and current row))"""
_RIDGED = f"(select *, n + k as a, sxx + k as e, stt + k as i from (select *, 1e-8 * greatest(1, abs(n + sxx + stt) / 3) as k from {_OLS} b) c)"


def _det(a, b, c, d, e, f, g, h, i):
    return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"


@demo(f"""select code, month, case when full_ = 36 then round(y - ({_det("sy", "sx", "st", "sxy", "e", "sxt", "sty", "sxt", "i")} + {_det("a", "sy", "st", "sx", "sxy", "sxt", "st", "sty", "i")} * x + {_det("a", "sx", "sy", "sx", "e", "sxy", "st", "sxt", "sty")} * t) / {_det("a", "sx", "st", "sx", "e", "sxt", "st", "sxt", "i")}, 4) end as resid from {_RIDGED} d""")
def rolling_ols(spark, sf):
    p = role(spark, sf, "panel").withColumn("t", F.row_number().over(tswin.along()))
    return tswin.ols_residual(p, "px", "volume", "t", tswin.along()).select("code", "month", r("resid").alias("resid"))


@demo("select code, month, round(last_value(v ignore nulls) over (partition by code order by month rows between 11 preceding and current row), 4) as held from (select code, month, case when month(month) = 12 then volume end as v from ({panel}) p) a")
def ffill_limit(spark, sf):
    p = role(spark, sf, "panel").withColumn("v", F.when(F.month("month") == 12, F.col("volume")))
    return p.select("code", "month", r(tswin.ffill("v", tswin.along(), 11)).alias("held"))


@demo("""select code, yr, q, round(case when q = 1 then ytd_revenue when lag(q) over w = q - 1 then ytd_revenue - lag(ytd_revenue) over w end, 2) as revenue_q from ({statements}) s window w as (partition by code, yr order by q)""")
def ytd_to_quarter(spark, sf):
    s = tswin.quarterly(role(spark, sf, "statements"), "ytd_revenue", "revenue_q", ["code"], "yr", "q")
    return s.select("code", "yr", "q", r("revenue_q", 2).alias("revenue_q"))


@demo("select code, month, case when count(*) over w = 3 then min(case when volume < 150 then 1 else 0 end) over w end as streak from ({panel}) p window w as (partition by code order by month rows between 2 preceding and current row)")
def streak(spark, sf):
    p = role(spark, sf, "panel").withColumn("f", F.when(F.col("volume") < 150, 1).otherwise(0))
    return p.select("code", "month", tswin.streak(F.col("f"), tswin.along()).alias("streak"))


@demo("select code, month, case when row_number() over w > 30 then round(median(volume) over (partition by code order by month rows between unbounded preceding and 1 preceding), 4) end as lagged_median from ({panel}) p window w as (partition by code order by month)")
def expanding_median(spark, sf):
    return tswin.expanding_median(role(spark, sf, "panel"), "volume", "code", ["month"]).select("code", "month", r("lagged_median").alias("lagged_median"))


#: Daily rows without some months of some codes, so that next rows are far and next months missing.
_GAPS = "(select * from ({daily}) d0 where (month(day) + year(day) + code) % 13 <> 5)"
_PRICES = """(select code, month, signal_day, close, adv20, exec_px, case when lead(month) over w = last_day(cast(month + interval 1 day as date)) and abs(exec_px) > 1e-12 then lead(exec_px) over w / exec_px - 1 end as fwd_ret from
 (select code, month, x.d as signal_day, x.c as close, x.a as adv20, coalesce(case when x.n - x.d <= 10 then x.o end, x.c) as exec_px from (select code, last_day(day) as month, max_by({'d': day, 'c': close_px, 'a': adv20, 'o': next_open, 'n': next_day}, day) as x from
 (select *, case when count(amount) over v >= 10 then avg(amount) over v end as adv20, lead(open_px) over w as next_open, lead(day) over w as next_day from """ + _GAPS + """ d1 window w as (partition by code order by day), v as (partition by code order by day rows between 19 preceding and current row)) d2
 group by code, last_day(day)) d3) d4 window w as (partition by code order by month))"""
_RET = f"(select p.code, p.month, fwd_ret as ret, p.amount, p.volume from ({{panel}}) p join {_PRICES} q on q.code = p.code and q.month = p.month)"


def gapped(spark, sf):
    return role(spark, sf, "daily").where("(month(day) + year(day) + code) % 13 <> 5")


def returns(spark, sf):
    """The panel of the months with prices, and what they return if traded at the executable price."""
    q = prices.month_panel(gapped(spark, sf)).select("code", "month", F.col("fwd_ret").alias("ret"))
    return role(spark, sf, "panel").join(q, ["code", "month"]).select("code", "month", "ret", "amount", "volume")


@demo(f"select code, month, signal_day, round(close, 8) as close, round(adv20, 8) as adv20, round(exec_px, 8) as exec_px, round(fwd_ret, 8) as fwd_ret from {_PRICES} a")
def price_panel(spark, sf):
    p = prices.month_panel(gapped(spark, sf))
    return p.select("code", "month", "signal_day", *(r(c, 8).alias(c) for c in ("close", "adv20", "exec_px", "fwd_ret")))


@demo("select code, day, round(close_px / lag(close_px) over w - 1, 6) as ret1d, lead(day) over w as next_day from " + _GAPS + " d window w as (partition by code order by day)")
def daily_returns(spark, sf):
    return prices.daily_features(gapped(spark, sf)).select("code", "day", r("ret1d", 6).alias("ret1d"), "next_day")


@demo("select code, month, round(px / lag(px, 12) over (partition by code order by month) - 1, 6) as mom12 from ({panel}) p")
def momentum_12(spark, sf):
    return role(spark, sf, "panel").select("code", "month", r(tswin.momentum("px", tswin.along()), 6).alias("mom12"))


_MEANS = f"(select month, avg(ret) / 20 as m from {_RET} a where ret is not null group by month)"
#: Beside the means an arm that loses all in a month.
_WITH_LOSS = f"(select 'base' as arm, month, m from {_MEANS} b0 union all select 'lost', month, case when month = date '1997-06-30' then -1 else m end from {_MEANS} b1)"
_DOWN = f"(select arm, month, wealth, wealth / greatest(1, max(wealth) over (partition by arm order by month)) - 1 as dd from (select arm, month, product(1 + m) over (partition by arm order by month) as wealth from {_WITH_LOSS} b) c)"


def month_means(spark, sf):
    base = returns(spark, sf).where("ret is not null").groupBy("month").agg((F.avg("ret") / 20).alias("m"))
    return base.select("month", F.explode(F.array(F.struct(F.lit("base").alias("arm"), "m"), F.struct(F.lit("lost").alias("arm"), F.when(F.col("month") == "1997-06-30", -1.0).otherwise(F.col("m")).alias("m")))).alias("x")).select("month", "x.*")


@demo(f"select arm, month, round(wealth, 4) as wealth, round(dd, 4) as drawdown from {_DOWN} d")
def drawdown(spark, sf):
    return tswin.drawdown(month_means(spark, sf), "m", ["arm"], "month").select("arm", "month", r("wealth").alias("wealth"), r("drawdown").alias("drawdown"))


@demo(f"select arm, max(n) as underwater from (select arm, count(*) filter (where low) as n from (select arm, dd < -1e-9 as low, row_number() over (partition by arm order by month) - row_number() over (partition by arm, dd < -1e-9 order by month) as run from {_DOWN} d) e group by arm, low, run) f group by arm")
def underwater(spark, sf):
    return tswin.underwater(tswin.drawdown(month_means(spark, sf), "m", ["arm"], "month"), ["arm"], "month")


_LAGS = ", ".join(f"lag(e, {k}) over w as l{k}" for k in range(1, 6))
_SUMS = " + ".join(f"2 * coalesce(sum(greatest(1 - {k} / (lags + 1), 0) * e * l{k}), 0)" for k in range(1, 6))


@demo(f"""with a as (select code, month, ret - avg(ret) over (partition by code) as e, ret, floor(4 * pow(count(*) over (partition by code) / 100, 2.0 / 9)) as lags from {_RET} q where ret is not null),
 l as (select *, {_LAGS} from a window w as (partition by code order by month)), s as (select code, count(*) as n, avg(ret) as m, sum(e * e) + {_SUMS} as s from l group by code) select code, n, case when n >= 12 and s > 0 then round(m / sqrt(s / n / n), 4) end as t from s""")
def hac_t(spark, sf):
    return tswin.hac_t(returns(spark, sf), "ret", ["code"], "month").select("code", "n", r("t").alias("t"))


# ---- tables and ledgers


@demo("select uid, event_type from (select event_id % 3000 as uid, event_type, row_number() over (partition by event_id % 3000 order by ts desc, event_id desc) as n from events) x where n = 1")
def journal_latest(spark, sf):
    j = table(spark, sf, "events").withColumn("uid", F.col("event_id") % 3000)
    return pit.latest(j, ["uid"], F.desc("ts"), F.desc("event_id")).select("uid", "event_type")


@demo("select o_custkey, round(v, 2) as v from (select *, row_number() over (partition by o_custkey order by b desc, o_orderkey desc) as n from (select o_custkey, o_orderkey, o_totalprice as v, case when o_orderkey % 3 = 0 then 1 else 0 end as b from orders) a) x where n = 1")
def upsert_latest(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").alias("v"))
    fresh = F.col("o_orderkey") % 3 == 0
    return ledger.upsert(o.where(~fresh), o.where(fresh), ["o_custkey"], ["o_orderkey"]).select("o_custkey", r("v", 2).alias("v"))


@demo("select md5(text) as digest, min(doc_id) as first_id, count(*) as n from documents group by md5(text)")
def content_dedup(spark, sf):
    return table(spark, sf, "documents").groupBy(F.md5("text").alias("digest")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))


@demo("select o_custkey, count(*) as n from (select *, min(o_shard) over (partition by o_custkey) as m from (select o_custkey, o_orderkey % 3 as o_shard from orders) a) b where m = o_shard group by o_custkey")
def source_priority(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", (F.col("o_orderkey") % 3).alias("p"))
    return ledger.source_priority(o, "o_custkey", "p").groupBy("o_custkey").agg(F.count("*").alias("n"))


@demo("select o_custkey, count(*) as n from (select o_custkey from orders where o_orderkey % 2 = 0 union all select o_custkey from orders where o_orderkey % 2 = 1 and o_custkey not in (select o_custkey from orders where o_orderkey % 2 = 0)) x group by o_custkey")
def tier_merge(spark, sf):
    o = table(spark, sf, "orders")
    even = F.col("o_orderkey") % 2 == 0
    return ledger.tier_merge(o.where(even), o.where(~even), ["o_custkey"]).groupBy("o_custkey").agg(F.count("*").alias("n"))


@demo("""select code, case when reason = 'forward' then cast(hi + interval 1 day as date) else date '1995-01-01' end as from_day, reason from (select s.code, hi, case when lo is null then 'full' when lo > date '1995-01-11' then 'backward' when hi < date '2001-11-25' then 'forward' end as reason from ({security}) s left join (select code, min(day) as lo, max(day) as hi from ({daily}) d group by code) h on h.code = s.code) x where reason is not null""")
def coverage_gaps(spark, sf):
    return ledger.coverage_gaps(role(spark, sf, "daily"), role(spark, sf, "security").select("code"), "code", "day", "1995-01-01", "2001-11-30")


@demo("select month, (select count(distinct o_orderpriority) from orders) - count(distinct o_orderpriority) as missing from (select last_day(cast(o_orderdate as date)) as month, o_orderpriority from orders) a group by month")
def month_type_coverage(spark, sf):
    o = table(spark, sf, "orders").select(F.last_day("o_orderdate").alias("month"), "o_orderpriority")
    return ledger.set_coverage(o, "month", "o_orderpriority").select("month", F.col("missing").cast("long").alias("missing"))


_TWO = """(select o_custkey as key, o_orderkey as uid, 'a' as src, cast(o_orderdate as date) as d, o_totalprice as p, o_clerk as words, o_orderpriority || repeat('x', o_orderkey % 3) as title from (select *, case when o_orderkey % 5 = 0 then 'nan' else o_orderstatus end as o_clerk from orders) o where o_orderkey % 3 < 2
 union all select o_custkey, o_orderkey, 'b', cast(o_orderdate as date), o_totalprice, case when o_orderkey % 5 = 0 then 'nan' else o_orderstatus end, o_orderpriority || repeat('x', o_orderkey % 3) from orders where o_orderkey % 3 > 0)"""


@demo(f"""select key, min(uid) as uid, case when count(distinct src) = 2 then 'a+b' else min(src) end as source, min(d) as pub_date, round(max(p), 2) as target, min(case when words <> 'nan' then words end) as words, min((100 - length(title), title)).title as title
 from (select *, title as t from {_TWO} y) x group by key""".replace("min((100 - length(title), title)).title", "min(lpad((100 - length(title))::varchar, 3, '0') || title)[4:]"))
def ledger_merge(spark, sf):
    k = F.col("o_orderkey")
    words = F.when(k % 5 == 0, "nan").otherwise(F.col("o_orderstatus"))
    title = F.concat("o_orderpriority", F.repeat(F.lit("x"), (k % 3).cast("int")))
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("key"), k.alias("uid"), F.to_date("o_orderdate").alias("pub_date"), title.alias("title"), words.alias("words"), F.col("o_totalprice").alias("target"))
    a, b = o.where("uid % 3 < 2").withColumn("source", F.lit("a")), o.where("uid % 3 > 0").withColumn("source", F.lit("b"))
    once = ledger.ledger_merge(a.unionByName(b), "key", words=["words"])
    again = ledger.ledger_merge(once.unionByName(a, allowMissingColumns=True), "key", words=["words"])
    return again.select("key", "uid", "source", "pub_date", r("target", 2).alias("target"), "words", "title")


@demo("select key, count(*) as n from (select sha1(strftime(pub_date, '%Y%m%d') || chr(31) || kind || chr(31) || code || chr(31) || 'On ' || kind2) as key from (select *, replace(kind, '-', ' ') as kind2 from ({reports}) q) a) b group by key")
def dedup_keys(spark, sf):
    title = F.concat(F.lit("On  ["), F.col("uid"), F.lit("] "), F.col("kind"))
    q = role(spark, sf, "reports").select(ledger.dedup_key(F.col("pub_date"), F.col("kind"), F.col("code").cast("string"), title).alias("key"))
    return q.groupBy("key").agg(F.count("*").alias("n"))


@demo("select name, code, score from (select l.name, s_suppkey as code, round(100 * (1 - levenshtein(l.name, s_name) / length(s_name)), 6) as score, row_number() over (partition by l.name order by levenshtein(l.name, s_name), s_suppkey) as n from (select distinct replace(s_name, '#0', '#1') as name from supplier) l join supplier on substr(l.name, 1, 11) = substr(replace(s_name, '#0', '#1'), 1, 11) where 100 * (1 - levenshtein(l.name, s_name) / length(s_name)) >= 92) x where n = 1")
def fuzzy_match(spark, sf):
    s = table(spark, sf, "supplier")
    left = s.select(F.replace("s_name", F.lit("#0"), F.lit("#1")).alias("name"))
    right = s.select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("code"))
    return ledger.fuzzy_match(left, right, "name", "code", block=0).withColumn("score", r("score", 6))


# ---- aggregations


@demo("select code, month, round(sum(sh * sh), 6) as hhi from (select code, month, org, sum(award) / sum(sum(award)) over (partition by code, month) as sh from ({awards}) a group by code, month, org) x group by code, month")
def hhi(spark, sf):
    a = role(spark, sf, "awards").groupBy("code", "month", "org").agg(F.sum("award").alias("s"))
    share = F.col("s") / F.sum("s").over(Window.partitionBy("code", "month"))
    return a.withColumn("sh", share).groupBy("code", "month").agg(r(F.sum(F.col("sh") * F.col("sh")), 6).alias("hhi"))


@demo("select code, month, count(*) as awards, count(distinct org) as orgs, round(avg(case when rate between 50 and 120 then rate else award / plan * 100 end), 4) as win_rate from ({awards}) a group by code, month")
def award_panel(spark, sf):
    rate = F.when(F.col("rate").between(50, 120), F.col("rate")).otherwise(X.safe_div(F.col("award"), F.col("plan")) * 100)
    return role(spark, sf, "awards").groupBy("code", "month").agg(F.count("*").alias("awards"), F.countDistinct("org").alias("orgs"), r(F.avg(rate)).alias("win_rate"))


@demo("select month, grp, count(*) as lines, round(sum(wgt), 2) as wgt from ({trade}) t group by month, grp")
def region_rollup(spark, sf):
    return role(spark, sf, "trade").groupBy("month", "grp").agg(F.count("*").alias("lines"), r(F.sum("wgt"), 2).alias("wgt"))


@demo("select month, round(sum(case when grp in ('AMERICA', 'EUROPE') then usd else 0 end) / sum(usd), 6) as share from ({trade}) t group by month")
def subset_share(spark, sf):
    t = role(spark, sf, "trade")
    return t.groupBy("month").agg(r(F.sum(F.when(F.col("grp").isin("AMERICA", "EUROPE"), F.col("usd")).otherwise(0.0)) / F.sum("usd"), 6).alias("share"))


@demo("select code, analyst, pub_date, uid, round(target, 2) as target, cast(sign(target - lag(target) over (partition by code, analyst order by pub_date, uid)) as double) as change from ({reports}) q where target is not null")
def revision(spark, sf):
    q = role(spark, sf, "reports").where("target is not null")
    w = Window.partitionBy("code", "analyst").orderBy("pub_date", "uid")
    return q.select("code", "analyst", "pub_date", "uid", r("target", 2).alias("target"), F.signum(F.col("target") - F.lag("target").over(w)).alias("change"))


@demo("""select code, month, analysts, round(target, 4) as target, rev_up, rev_dn, round(-rev_up / nullif(analysts, 0), 6) as d2, -(analysts - lag(analysts) over (partition by code order by month)) as d4 from
 (select code, month, count(distinct analyst) as analysts, median(target) as target, count(*) filter (rev > 0) as rev_up, count(*) filter (rev < 0) as rev_dn from (select *, unnest([last_day(pub_date), last_day(pub_date + interval 1 month), last_day(pub_date + interval 2 month), last_day(pub_date + interval 3 month)]) as month from
 (select *, sign(target - lag(target) over (partition by code, analyst order by pub_date, uid)) as rev from ({reports}) q where pub_date is not null) v) x
 where pub_date > month - interval 90 day and pub_date <= month group by code, month) c""")
def consensus(spark, sf):
    """The whole consensus of each month: who covers a code, the middle target, upward and downward revisions by the same analyst, and what
    they say (d2, d4); reports without a code are a group of their own."""
    from pitwright.plans.axes import consensus as of

    c = of(role(spark, sf, "reports"), named=False)
    return c.select("code", "month", F.col("n_analyst").alias("analysts"), r("tp_median").alias("target"), "rev_up", "rev_dn", r("d2", 6).alias("d2"), "d4")


# ---- universe


@demo("select month, code from ({security}) s, (select distinct month from ({panel}) p) m where listing_date <= month and (delisting_date is null or delisting_date > month)")
def universe_members(spark, sf):
    months = role(spark, sf, "panel").select("month").distinct()
    return universe.members(months, role(spark, sf, "security"))


@demo("""with c as (select day, row_number() over (order by day) as rn from (select distinct day from ({daily}) d) x), f as (select code, listing_date, min(rn) as r0 from ({security}) s join c on day >= listing_date group by code, listing_date)
 select code, case when listing_date < (select min(day) from c) then cast(listing_date + interval 365 day as date) else coalesce(c.day, date '2100-01-01') end as seasoned from f left join c on c.rn = r0 + 250""")
def seasoning(spark, sf):
    days = role(spark, sf, "daily").select("day").distinct()
    return universe.seasoning(role(spark, sf, "security"), days)


# ---- portfolio and tests


def signals(spark, sf):
    return returns(spark, sf).withColumn("signal", F.col("volume")).withColumn("arm", F.lit("base"))


@demo(f"select month, code, place from (select *, row_number() over (partition by month order by volume desc, code) as place, greatest(5, least(25, cast(round_even(count(*) over (partition by month) * 0.05, 0) as int))) as k from {_RET} a) b where place <= k")
def topn_month(spark, sf):
    return portfolio.picks(signals(spark, sf), ["arm"], "signal").select("month", "code", "place")


@demo(f"""select arm, year(month) as yr, count(*) as months, round(product(1 + m) - 1, 4) as ret, round(avg(m), 6) as mean, round(avg((m > 0)::int), 4) as hit_rate, round(avg(n), 4) as names
 from (select y.arm, y.month, y.m, c.n from {_WITH_LOSS} y join (select month, count(ret) as n from {_RET} a where ret is not null group by month) c on c.month = y.month) z group by arm, year(month)""")
def yearly_perf(spark, sf):
    names = returns(spark, sf).where("ret is not null").groupBy("month").agg(F.count("ret").alias("n"))
    y = portfolio.yearly(month_means(spark, sf).join(names, "month"), "m", ["arm"], names="n")
    return y.select("arm", F.col("year").alias("yr"), "months", r("ret").alias("ret"), r("mean", 6).alias("mean"), r("hit_rate").alias("hit_rate"), r("names").alias("names"))


@demo(f"""select draw, round(avg(ret), 6) as mean_ret from (select draw, ret, row_number() over (partition by draw, month order by md5('s|' || draw || '|' || month || '|' || code)) as n from (select * from {_RET} a where ret is not null) b, (select unnest(range(1000)) as draw) d) c where n <= 5 group by draw""")
def placebo(spark, sf):
    p = returns(spark, sf).where("ret is not null").select("month", "code", F.col("ret").alias("fwd_ret"))
    return portfolio.placebo(p, 1000, 5).select("draw", r("mean_ret", 6).alias("mean_ret"))


@demo(f"""with s as (select code, count(*) as n, avg(ret) as m from {_RET} a where ret is not null group by code), p as (select code, 1 / (1 + abs(m) * n) as p from s), o as (select *, row_number() over (order by p) as k, count(*) over () as c from p)
 select code, coalesce(k <= max(case when p <= 0.3 * k / c then k end) over (), false) as passed from o""")
def bh_fdr(spark, sf):
    s = returns(spark, sf).where("ret is not null").groupBy("code").agg(F.count("*").alias("n"), F.avg("ret").alias("m"))
    return portfolio.bh_fdr(s.select("code", (1 / (1 + F.abs("m") * F.col("n"))).alias("p")), "p", 0.3).select("code", "passed")


@demo(f"""with c as (select code, sum(ret / 10) as s from {_RET} a where ret is not null group by code), o as (select *, row_number() over (order by s desc, code) as k, count(*) over () as n, sum(s) over () as base from c),
 q as (select unnest([0.01, 0.05, 0.1]) as top), k as (select top, greatest(1, round_even((select max(n) from o) * top, 0))::bigint as names from q) select top, names, round(sum(case when k <= names then s else 0 end), 4) as part, round(sum(case when k > names then s else 0 end), 4) as rest from k, o group by top, names""")
def tail_contrib(spark, sf):
    held = returns(spark, sf).where("ret is not null").select("code", F.lit(0.1).alias("w"), "ret")
    t = portfolio.tail_contribution(held, "code", "w", "ret")
    return t.select("top", "names", r("part").alias("part"), r("rest").alias("rest"))


# ---- the flagship: point-in-time join, cell score, product, picks of the month


def flagship(spark: SparkSession, sf: str, statements: DataFrame | None = None) -> DataFrame:
    """Picks of each month by the product of two scores, of which one is of the newest statements that were known."""
    from pitwright.plans.axes import standardised

    p = zpanel(spark, sf)
    s = role(spark, sf, "statements") if statements is None else statements
    a = pit.asof_join(p, s, "code", "month", "knowledge_date", ["ytd_revenue", "qty"], ["period_end"])
    c = xsec.cells(a.withColumn("lr", F.log("ytd_revenue")), "month", "industry", "bucket")
    c = standardised(c, {"z1": "x", "z2": "lr"})
    scored = c.withColumn("signal", r(F.col("z1") * F.col("z2"), 6)).withColumn("arm", F.lit("base"))
    return portfolio.picks(scored, ["arm"], "signal").select("month", "code", "place", "signal")


QUERIES["flagship"] = flagship
