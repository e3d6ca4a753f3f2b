"""The tables of a folder in the roles of a panel: SQL that reads the same in Spark and in a checking engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitwright.sources.files import dealt

TABLES = "region nation customer supplier part orders lineitem events documents pages".split()

_AWARD = ("l_suppkey as code", "last_day(cast(o_orderdate as date)) as month", "o_orderkey as id", "c_mktsegment as org", "o_totalprice as award", "1.1 * o_totalprice as plan", "case when o_orderkey % 5 <> 0 then 80.0 + o_orderkey % 30 end as rate")

ROLES = {
    "daily": """select l_suppkey as code, cast(l_shipdate as date) as day, sum(l_extendedprice) / sum(l_quantity) as close_px, min(l_extendedprice / l_quantity) as open_px,
        sum(l_extendedprice) as amount, sum(l_quantity) as volume, sum(case when l_returnflag = 'A' then l_quantity when l_returnflag = 'R' then -l_quantity else 0 end) as net_flow
        from {lineitem} group by l_suppkey, cast(l_shipdate as date)""",
    "panel": """select code, last_day(day) as month, max_by(close_px, day) as px, sum(amount) as amount, sum(volume) as volume, sum(net_flow) as net_flow from ({daily}) d group by code, last_day(day)""",
    "security": """select s_suppkey as code, s_name as name, n_name as industry, r_name as market,
        case when s_suppkey % 9 = 4 then cast('1996-09-01' as date) else cast('1994-01-01' as date) end as listing_date,
        case when s_suppkey % 10 = 3 then cast('1999-06-30' as date) end as delisting_date,
        case when s_suppkey % 13 <> 0 then abs(s_acctbal) / 10 end as employees
        from {supplier} join {nation} on s_nationkey = n_nationkey join {region} on n_regionkey = r_regionkey""",
    "statements": """select code, yr, q, sum(rev) over (partition by code, yr order by q) as ytd_revenue, sum(cost) over (partition by code, yr order by q) as ytd_cogs, qty, period_end,
        cast(period_end + case when q = 4 then interval 90 day else interval 45 day end as date) as knowledge_date
        from (select l_suppkey as code, year(l_shipdate) as yr, quarter(l_shipdate) as q, sum(l_extendedprice) as rev, sum(l_extendedprice * (1 - l_discount) * 0.7) as cost, sum(l_quantity) as qty, max(last_day(cast(l_shipdate as date))) as period_end
        from {lineitem} where (l_suppkey + quarter(l_shipdate)) % 17 <> 0 group by l_suppkey, year(l_shipdate), quarter(l_shipdate)) g""",
    "fund": """select code, period_end, knowledge_date, case when full_year then rev end as revenue_ttm, case when full_year then cogs end as cogs_ttm, case when full_year then rev - cogs - spent end as op_income_ttm,
        case when full_year then (rev - cogs) / 4 - taxed end as net_income_ttm, case when full_year then (rev - cogs) / 5 end as cfo_ttm, case when full_year then spent end as capex_ttm, case when full_year then taxed end as dep_ttm,
        qty * 300 as inventory, tax_q * 3 as receivable, disc_q as payable, rev_q + qty * 500 as assets, rev_q - disc_q * 8 as equity, rev_q * 0.4 as ppe, taxed as payroll, disc_q * 8 as liabilities, lines + 20 as employees
        from (select code, period_end, qty, rev_q, tax_q, disc_q, cast(period_end + case when q = 4 then interval 90 day else interval 45 day end as date) as knowledge_date, count(*) over w = 4 as full_year,
        sum(rev_q) over w as rev, sum(cogs_q) over w as cogs, sum(disc_q) over w as spent, sum(tax_q) over w as taxed, sum(lines_q) over w as lines
        from (select l_suppkey as code, year(l_shipdate) as yr, quarter(l_shipdate) as q, sum(l_extendedprice) as rev_q, sum(l_extendedprice * (1 - l_discount) * 0.7) as cogs_q, sum(l_extendedprice * l_discount) as disc_q, sum(l_extendedprice * l_tax) as tax_q,
        sum(l_quantity) as qty, count(*) as lines_q, max(last_day(cast(l_shipdate as date))) as period_end from {lineitem} group by l_suppkey, year(l_shipdate), quarter(l_shipdate)) g
        window w as (partition by code order by yr, q rows between 3 preceding and current row)) h""",
    "reports": """select o_orderkey as uid, l_suppkey as code, o_custkey % 60 as analyst, cast(o_orderdate as date) as pub_date, case when o_orderkey % 7 <> 0 then max(o_totalprice) end as target, max(o_orderpriority) as kind
        from {orders} join {lineitem} on l_orderkey = o_orderkey group by o_orderkey, l_suppkey, o_custkey % 60, cast(o_orderdate as date)""",
    "trade": """select last_day(cast(o_orderdate as date)) as month, p_type as hs, r_name as grp, sum(l_extendedprice) as usd, sum(l_quantity) as wgt from {lineitem} join {orders} on o_orderkey = l_orderkey join {part} on p_partkey = l_partkey
        join {customer} on c_custkey = o_custkey join {nation} on n_nationkey = c_nationkey join {region} on r_regionkey = n_regionkey group by last_day(cast(o_orderdate as date)), p_type, r_name""",
    "awards": f"""select distinct {", ".join(_AWARD)}
        from {{orders}} join {{lineitem}} on l_orderkey = o_orderkey join {{customer}} on c_custkey = o_custkey""",
}


#: What roles read of each table.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_nationkey int, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_type string",
    "orders": "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_shipdate timestamp",
}
#: Types that are read as a declared one without loss.
READ_AS = {"int": {"int", "smallint", "tinyint"}, "bigint": {"bigint", "int", "smallint", "tinyint"}, "double": {"double", "float", "bigint", "int"}, "timestamp": {"timestamp", "timestamp_ntz", "date"}, "string": {"string"}, "date": {"date"}}


def conforming(df: DataFrame, schema: str) -> DataFrame:
    """df with the declared columns in their declared types, other columns as they are; an error names all that are absent or of a type
    that can't be read as the declared one without loss."""
    kinds = dict(df.dtypes)
    wanted = {f.name: f.dataType.simpleString() for f in T.StructType.fromDDL(schema).fields}
    wrong = [f"{c} {k}: {kinds.get(c, 'absent')}" for c, k in wanted.items() if kinds.get(c) not in READ_AS.get(k, {k})]
    if wrong:
        raise TypeError("not as declared: " + ", ".join(wrong))
    return df.withColumns({c: df[c].cast(k) for c, k in wanted.items() if kinds[c] != k})


def expanded(sql: str) -> str:
    """sql with roles written out; what is left in braces are tables."""
    while True:
        out = sql
        for name, text in ROLES.items():
            out = out.replace(f"({{{name}}})", f"({text})")
        if out == sql:
            return out
        sql = out


def _awards(t: dict[str, DataFrame], n: int) -> DataFrame:
    """The rows of the role's SQL, for n lines: orders meet customers before they meet lines, so lines move once to be told apart, and once
    more so that the awards of a code's month lie together."""
    orders = t["orders"].count()
    placed = dealt(t["orders"], orders, "o_custkey").join(dealt(t["customer"], orders, "c_custkey"), F.col("c_custkey") == F.col("o_custkey"))
    met = dealt(placed, n, "o_orderkey").join(dealt(t["lineitem"], n, "l_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return dealt(met.selectExpr(*_AWARD).distinct(), n, "code", "month")


def role(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = expanded(ROLES[name])
    read = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in sql}
    used = {t: conforming(df, SCHEMAS[t]) if t in SCHEMAS else df for t, df in read.items()}
    if {"orders", "lineitem"} <= used.keys():  # they meet by order, in parts of counted rows
        n = used["lineitem"].count()
        if name == "awards":
            return _awards(used, n)
        used |= {"lineitem": dealt(used["lineitem"], n, "l_orderkey"), "orders": dealt(used["orders"], n, "o_orderkey")}
    return spark.sql(sql, **used)


def for_checking(sql: str) -> str:
    """sql over roles, written as ({name}), and tables, for an engine that has the tables as views."""
    out = expanded(sql)
    for t in TABLES:
        out = out.replace(f"{{{t}}}", t)
    return out
