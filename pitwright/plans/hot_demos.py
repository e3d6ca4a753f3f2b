"""Queries of operators that hold with hot keys and without blocks, with checking SQL. They join those of demos.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitwright.operators import audits, ledger, names, tswin, xsec
from pitwright.plans.axis_demos import _D, dpanel
from pitwright.plans.demos import _ZPANEL, demo, r, table, zpanel
from pitwright.sources.roles import role

# ---- cells that are too large for a task


@demo(f"select code, month, round((rank() over (order by v) + (count(*) over (partition by v) - 1) / 2.0) / count(v) over (), 6) as p from {_ZPANEL} a")
def xsec_rank_hot(spark, sf):
    """Ranks in a cell that holds all rows, in ranges of 3,000 values."""
    return xsec.rank_pct(zpanel(spark, sf).withColumn("all", F.lit("all")), "v", "all", "p", rows=3000).select("code", "month", r("p", 6).alias("p"))


@demo("""select code, month, case when row_number() over w > 30 then round(median(volume) over (partition by code % 7 order by month, code rows between unbounded preceding and 1 preceding), 4) end as lagged_median from ({panel}) p window w as (partition by code % 7 order by month, code)""")
def expanding_median_blocks(spark, sf):
    """Sections of a seventh of all rows, in blocks of 900."""
    p = role(spark, sf, "panel").withColumn("g", F.col("code") % 7)
    return tswin.expanding_median(p, "volume", "g", ["month", "code"], rows=900).select("code", "month", r("lagged_median").alias("lagged_median"))


# ---- names as sets of words

_WORDS = "(select s_suppkey as code, lower(n_name) || ' ' || translate(lpad(s_suppkey::varchar, 5, '0'), '0123456789', 'qwrtpsdfgh') || ' trading house' as name from supplier join nation on n_nationkey = s_nationkey)"
_RENAMED = f"""(select case code % 6 when 0 then 'house trading ' || name when 1 then substr(name, 1, length(name) - 6) || ' of house' when 2 then replace(name, 'trading', 'tradng') when 3 then 'the ' || name || ' of the far north'
 when 4 then replace(name, 'trading house', 'ltd') else replace(name, 'house', 'hose') || ' x' end as name from {_WORDS} w)"""
_SETS = "(select *, array_to_string(list_sort(list_intersect(ta, tb)), ' ') as s, array_to_string(list_filter(ta, lambda x: not list_contains(tb, x)), ' ') as x, array_to_string(list_filter(tb, lambda x: not list_contains(ta, x)), ' ') as y from p)"


@demo(f"""with recursive a as (select distinct name, list_sort(list_distinct(string_split(name, ' '))) as ta from {_RENAMED} n), b as (select name as other, min(code) as code, list_sort(list_distinct(string_split(name, ' '))) as tb from {_WORDS} n group by name),
p as (select * from a, b), z as (select *, length(s) as ls, length(x) as lx, length(y) as ly, case when s <> '' and x <> '' then 1 else 0 end as gx, case when s <> '' and y <> '' then 1 else 0 end as gy from {_SETS} q),
c as (select name, code, x, y, lx, ly, 2 * ls + gx + gy + lx + ly as total, case when ls > 0 then greatest(100 * (1 - (gx + lx) / (2 * ls + gx + lx)), 100 * (1 - (gy + ly) / (2 * ls + gy + ly))) else 0 end as parts from z),
near as (select * from c where abs(lx - ly) <= 0.08 * total + 1e-9),
lcs(name, code, i, line) as (select name, code, 0, list_transform(range(ly + 1), lambda k: 0::bigint) from near
 union all select l.name, l.code, i + 1, list_transform(range(n.ly + 1), lambda k: list_max(list_transform(range(k + 1), lambda j: case when j > 0 and substr(n.y, j, 1) = substr(n.x, i + 1, 1) then line[j] + 1 else line[j + 1] end))) from lcs l join near n on n.name = l.name and n.code = l.code where i < n.lx),
w as (select l.name, l.code, 100 * (1 - (n.lx + n.ly - 2 * line[-1]) / n.total) as whole from lcs l join near n on n.name = l.name and n.code = l.code and l.i = n.lx),
f as (select c.name, c.code, greatest(parts, coalesce(whole, 0)) as score from c left join w on w.name = c.name and w.code = c.code)
select name, code, round(score, 6) as score from (select *, row_number() over (partition by name order by score desc, code) as k from f where score >= 92 - 1e-9) g where k = 1""")
def token_matches(spark, sf):
    """Names of suppliers in which words are turned round, left out, added or written wrong, against the names as they are."""
    s = table(spark, sf, "supplier").join(F.broadcast(table(spark, sf, "nation")), F.col("n_nationkey") == F.col("s_nationkey"))
    k, letters = F.col("code"), F.translate(F.lpad(F.col("s_suppkey").cast("string"), 5, "0"), "0123456789", "qwrtpsdfgh")
    right = s.select(F.col("s_suppkey").alias("code"), F.concat_ws(" ", F.lower("n_name"), letters, F.lit("trading house")).alias("name"))
    n = F.col("name")
    kinds = [F.concat(F.lit("house trading "), n), F.concat(F.expr("substring(name, 1, length(name) - 6)"), F.lit(" of house")), F.replace(n, F.lit("trading"), F.lit("tradng")), F.concat(F.lit("the "), n, F.lit(" of the far north")), F.replace(n, F.lit("trading house"), F.lit("ltd"))]
    changed = F.concat(F.replace(n, F.lit("house"), F.lit("hose")), F.lit(" x"))
    for i, e in enumerate(kinds):
        changed = F.when(k % 6 == i, e).otherwise(changed)
    return names.token_set_matches(right.select(changed.alias("name")), right, "name", "code").withColumn("score", r("score", 6))


# ---- audits


@demo(f"""select state, count(*) as n, round(count(*) / (select count(*) from {_D} e), 6) as share from (select case when dlog_e > 0 and dlog_m <= 0 then 'neglect' when dlog_e > 0 and dlog_m > 0 then 'growth' when dlog_e <= 0 and dlog_m > 0 then 'hope' else 'decline' end as state from {_D} d) s group by state""")
def state_mix(spark, sf):
    return audits.state_mix(dpanel(spark, sf)).select("state", "n", r("share", 6).alias("share"))


@demo("""with m as (select o_custkey as key, min(o_orderkey) as uid, max(o_totalprice) as target from orders group by o_custkey), x as (select key, case when key % 7 = 1 then target + 1 else target end as target from m where key % 5 > 0 union all select -key, target from m where key % 11 = 2),
 j as (select m.key as a, x.key as b, m.target as t, x.target as u from m full join x on x.key = m.key) select 'lost' as rule, count(*) filter (b is null) as violations from j union all select 'added', count(*) filter (a is null) from j union all select 'changed', count(*) filter (t <> u) from j union all select 'twice', 0""")
def check_merge(spark, sf):
    """A merge of orders by customer, against one in which keys are lost, added and changed."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("uid"), F.to_date("o_orderdate").alias("pub_date"), F.col("o_orderpriority").alias("title"), F.col("o_totalprice").alias("target"), F.lit("a").alias("source"))
    once = ledger.ledger_merge(o, "key")
    k = F.col("key")
    again = ledger.ledger_merge(once.unionByName(o), "key")
    wrong = again.where(k % 5 > 0).withColumn("target", F.when(k % 7 == 1, F.col("target") + 1).otherwise(F.col("target")))
    return audits.merge_violations(once, wrong.unionByName(again.where(k % 11 == 2).withColumn("key", -k)), "key")
