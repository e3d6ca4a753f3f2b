"""The query consensus against a plain loop and against its SQL."""

import datetime as dt
import random
import statistics

import pytest

from tests.test_findings import both

LINES = "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_shipdate timestamp"


def month_end(day, k):
    m = day.year * 12 + day.month + k
    return dt.date(m // 12, m % 12 + 1, 1) - dt.timedelta(days=1)


def test_consensus_counts_revisions(spark, tmp_path):
    """Missing codes and targets, several reports of an analyst on a day, equal targets; a target against none before is no revision."""
    rnd = random.Random(4)
    start = dt.datetime(1995, 11, 20)
    orders = [(k, rnd.choice([1, 2, 61, 63]), rnd.choice([100.0, 200.0, 300.0, None]), start + dt.timedelta(days=rnd.randrange(0, 300, 3)), "1-URGENT") for k in range(300)]
    lines = [(k, 1, code, 1.0, 1.0, 0.0, 0.0, "N", start) for k in range(300) for code in rnd.sample([1, 2, 3, None], rnd.choice([1, 2]))]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, LINES).write.parquet(f"{tmp_path}/lineitem.parquet")
    of = {o[0]: o for o in orders}
    reports = sorted(((of[k][3].date(), k, code, of[k][1] % 60, of[k][2] if k % 7 else None) for k, code in {(x[0], x[2]) for x in lines}), key=lambda x: x[:2])
    last, months = {}, {}
    for day, _, code, analyst, target in reports:
        before = last.get((code, analyst))
        last[code, analyst] = target
        rev = 0 if before is None or target is None else (target > before) - (target < before)
        for k in range(4):
            if day > month_end(day, k) - dt.timedelta(days=90):
                months.setdefault((code, month_end(day, k)), []).append((analyst, target, rev))
    want, covered = {}, {}
    for (code, month), rows in sorted(months.items(), key=lambda x: x[0][1]):
        n, up, down = len({a for a, _, _ in rows}), sum(r > 0 for _, _, r in rows), sum(r < 0 for _, _, r in rows)
        targets = [t for _, t, _ in rows if t is not None]
        want[code, month] = (n, statistics.median(targets) if targets else None, up, down, pytest.approx(-up / n, abs=1e-6), covered[code] - n if code in covered else None)
        covered[code] = n
    got, sql = both(spark, tmp_path, "consensus")
    assert {r[:2]: r[2:] for r in got} == want and len(got) == len(want)
    assert got == sql
    assert sum(x[2] for x in want.values()) > 50 and sum(x[3] for x in want.values()) > 50
