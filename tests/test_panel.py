"""Operators against exact cases and against plain Python."""

import datetime as dt
import glob
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitwright.functions import exprs as X
from pitwright.operators import ledger, pit, tswin, xsec
from pitwright.plans import demos
from pitwright.sources.roles import role
from tests import plain

DATA = "/root/testdata/sf0.001"
D = dt.date


def test_asof_join_keeps_rows_without_key_and_never_looks_ahead(spark):
    left = spark.createDataFrame([(c, m, f) for c, f in (("A", "c1"), ("B", None), ("C", "c3")) for m in (D(2020, 1, 31), D(2020, 2, 29))], "code string, month date, firm string")
    right = spark.createDataFrame([("c1", 100.0, D(2020, 1, 15)), ("c1", 999.0, D(2020, 5, 15)), ("c3", 300.0, D(2020, 1, 31)), (None, 1.0, D(2020, 1, 1))], "firm string, v double, known date")
    got = pit.asof_join(left, right, "firm", "month", "known", ["v"], ["v"]).orderBy("code", "month").collect()
    assert [r["v"] for r in got] == [100, 100, None, None, 300, 300]


def test_register_refuses_tables_without_dates(spark):
    with pytest.raises(KeyError):
        pit.PitCatalog().register("x", spark.range(1))


def test_pit_frame_clamps_and_drops(spark):
    df = spark.createDataFrame([(D(2020, 3, 1), D(2020, 2, 1)), (D(2020, 3, 1), None)], "e date, k date")
    got = pit.pit_frame(df, F.col("e"), F.col("k"), "s").collect()
    assert [(r["event_date"], r["knowledge_date"], r["_src"]) for r in got] == [(D(2020, 3, 1), D(2020, 3, 1), "s")]


def test_security_codes(spark):
    cases = {"005930": "005930", "5930": "005930", "A005930": "005930", "005930.KS": "005930", "09701K": "09701K", "": None, "abcdef": None, "008465W": None, "00846W": None, "J00123": None}
    got = spark.createDataFrame(list(cases.items()), "c string, want string").select("want", X.security_code(F.col("c")).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in got)


def test_dates_prices_and_gates(spark):
    got = spark.range(1).select(*(X.mixed_date(F.lit(s)).alias(f"d{k}") for k, s in enumerate(["26.01.19", "19.12.31", "2024-11-30", "20241130", "none"])), X.target_price(F.lit("95,000")).alias("p"), X.target_price(F.lit("0")).alias("z"), X.undo_repeat(F.lit("ABCDABCD")).alias("r")).first()
    assert list(got) == [D(2026, 1, 19), D(2019, 12, 31), D(2024, 11, 30), D(2024, 11, 30), None, 95000.0, None, "ABCD"]
    cases = [(0.05, 0.10, False), (0.15, 0.10, True), (-0.20, -0.05, True), (0.05, -0.05, True), (None, 0.1, False), (0.1, None, False)]
    rows = spark.createDataFrame(cases, "dm double, de double, want boolean").select("want", X.exit_gate(F.col("dm"), F.col("de")).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in rows)


def test_zscore_of_an_outlier_and_of_a_small_cell(spark):
    rows = [("a", 1.0)] * 30 + [("a", 1000.0)] + [("b", 1.0), ("b", 2.0)]
    got = xsec.zscore(spark.createDataFrame(rows, "cell string, x double"), "x", "cell", "z").collect()
    assert max(r["z"] for r in got if r["cell"] == "a") <= 6
    assert all(r["z"] is None for r in got if r["cell"] == "b")


def test_rolling_ols_equals_numpy(spark):
    rng = np.random.default_rng(1)
    rows = [(c, D(2000 + k // 12, k % 12 + 1, 28), float(rng.normal()), float(rng.uniform(1, 9)), k) for c in range(2) for k in range(50)]
    got = tswin.ols_residual(spark.createDataFrame(rows, "code int, month date, y double, q double, t int"), "y", "q", "t", tswin.along()).orderBy("code", "month").collect()
    for k, r in enumerate(got):
        own = [x for x in rows if x[0] == r["code"] and x[1] <= r["month"]][-36:]
        if len(own) < 36:
            assert r["resid"] is None
            continue
        x = np.array([[1, math.log(o[3]), o[4]] for o in own])
        a = x.T @ x
        b = np.linalg.solve(a + np.eye(3) * 1e-8 * max(1, abs(np.trace(a)) / 3), x.T @ np.array([o[2] for o in own]))
        assert r["resid"] == pytest.approx(own[-1][2] - x[-1] @ b, abs=1e-7)


def test_ledger_merge_is_idempotent(spark):
    rows = [("k", 2, "naver", D(2020, 1, 2), "long title", 90000.0), ("k", 1, "hankyung", D(2020, 1, 1), "title", 95000.0)]
    df = spark.createDataFrame(rows, "key string, uid long, source string, pub_date date, title string, target double")
    once = ledger.ledger_merge(df, "key")
    twice = ledger.ledger_merge(once.unionByName(df), "key")
    assert once.collect() == twice.collect()
    assert once.first()["source"] == "hankyung+naver" and once.first()["target"] == 95000


def test_weights_respect_caps():
    for signal, adv in (([0.5] * 12, [1e12] * 12), ([0.99, 0.1, 0.1, 0.1, 0.1], [1e12] * 5), ([0.9, 0.8, 0.7], [1e6, 1e6, np.nan])):
        w = plain.weights(np.array(signal), np.array(adv), 1e9)
        cap = np.minimum(0.12, np.where(np.nan_to_num(adv) > 0, np.maximum(0.1 * np.nan_to_num(adv) / 1e9, 0.01), 0.12))
        assert (w <= cap + 1e-12).all() and w.sum() <= 1 + 1e-9


def test_interval_join_open_ends(spark):
    facts = spark.createDataFrame([(1, D(2019, 6, 30)), (1, D(2021, 1, 1))], "k int, d date")
    mapping = spark.createDataFrame([(1, D(2020, 1, 1), None)], "k int, valid_from date, valid_to date")
    assert pit.valid_interval_join(facts, mapping, "k", "d").count() == 1


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def _plain(v):
    if isinstance(v, dt.datetime):
        return v.date()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 4)
    return float(v) if type(v).__name__ in ("int", "Decimal") else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="tables are absent")
@pytest.mark.parametrize("name", ["asof_join", "xsec_z", "xsec_ladder", "cells", "rolling_slope", "expanding_median", "hhi", "placebo", "ledger_merge", "seasoning", "topn_month", "policy_mask", "coverage_gaps"])
def test_demo_equals_sql(spark, duck, name):
    df = demos.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    rel = duck.execute(demos.ORACLE[name])
    at = [[d[0] for d in rel.description].index(c) for c in cols]
    want = sorted((tuple(_plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert sorted((tuple(_plain(r[c]) for c in cols) for r in df.collect()), key=repr) == want


@pytest.mark.skipif(not os.path.isdir(DATA), reason="tables are absent")
def test_flagship_uses_nothing_before_it_is_known(spark):
    """Statements that become known after a day, changed beyond recognition, change nothing up to that day, and something after it."""
    day = D(1997, 6, 30)
    s = role(spark, DATA, "statements")
    changed = s.withColumn("ytd_revenue", F.when(F.col("knowledge_date") > F.lit(day), F.col("ytd_revenue") * (1 + F.col("code") % 5 * 7)).otherwise(F.col("ytd_revenue")))
    a, b = ([tuple(r) for r in demos.flagship(spark, DATA, x).orderBy("month", "code").collect()] for x in (s, changed))
    assert [r for r in a if r[0] <= day] == [r for r in b if r[0] <= day]
    assert [r for r in a if r[0] > day] != [r for r in b if r[0] > day]
