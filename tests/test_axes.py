"""Axes, vetoes, audits and tests of robustness: against SQL on small tables, and against exact cases."""

import datetime as dt
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitwright.functions import exprs as X
from pitwright.operators import tswin, universe, vetoes
from pitwright.plans import axis_demos, demos, fold_demos, plan_demos, portfolio, robustness  # noqa: F401
from tests.test_panel import DATA, _plain, duck  # noqa: F401

D = dt.date


@pytest.mark.skipif(not os.path.isdir(DATA), reason="tables are absent")
@pytest.mark.parametrize("name", ["axis_b", "axis_c", "axis_d", "vetoes_table", "consensus_signals", "procurement_pack", "text_cosine", "attrition", "partial_snapshot_filter", "delist_infer", "master_merge", "trade_cost", "raw_weights", "block_pbo", "regimes", "factor_returns", "hac_t", "backtest", "leak_test", "cost_survival", "deflated_sharpe"])
def test_demo_equals_sql(spark, duck, name):  # noqa: F811
    df = demos.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    rel = duck.execute(demos.ORACLE[name])
    at = [[d[0] for d in rel.description].index(c) for c in cols]
    want = sorted((tuple(_plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert sorted((tuple(_plain(r[c]) for c in cols) for r in df.collect()), key=repr) == want


def test_queries_of_both_modules_are_listed():
    assert demos.QUERIES["ablation"] is fold_demos.ablation


def test_unknown_changes_hold_and_count_as_decline(spark):
    rows = spark.createDataFrame([(0.1, 0.2), (0.3, 0.2), (0.1, -0.2), (None, -0.2), (0.1, None), (-0.1, 0.2)], "dm double, de double")
    got = rows.select(X.exit_gate(F.col("dm"), F.col("de")).alias("out"), X.state_label(F.col("de"), F.col("dm")).alias("s")).collect()
    assert [r["out"] for r in got] == [False, True, True, False, False, False]
    assert [r["s"] for r in got] == ["growth", "growth", "hope", "decline", "decline", "neglect"]


def test_hac_t_equals_plain_sums(spark):
    x = np.random.default_rng(1).normal(0.1, 1, 130)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "k string, i int, x double")
    e, lags = x - x.mean(), math.floor(4 * (len(x) / 100) ** (2 / 9))
    s = (e * e).sum() + sum(2 * (1 - k / (lags + 1)) * (e[k:] * e[:-k]).sum() for k in range(1, lags + 1))
    assert tswin.hac_t(df, "x", ["k"], "i").first()["t"] == pytest.approx(x.mean() / math.sqrt(s / len(x) ** 2))


def test_vetoes_of_missing_columns_pass_but_for_liquidity(spark):
    df = spark.createDataFrame([("A", D(2020, 1, 31), 4e8, 10.0), ("B", D(2020, 1, 31), None, 10.0), ("C", D(2020, 1, 31), 4e8, 0.0)], "code string, month date, adv20 double, close double")
    assert {r["code"]: r["VETO"] for r in vetoes.vetoes(df).collect()} == {"A": 1, "B": 0, "C": 0}
    listed = spark.createDataFrame([("A",), ("A",)], "code string")
    assert {r["code"]: r["V5"] for r in vetoes.vetoes(df, administrative=listed).collect()} == {"A": 0, "B": 1, "C": 1}


def test_delisting_at_a_month_end_is_the_next_one(spark):
    rows = [("X", "m", D(2019, 1, 31)), ("Y", "m", D(2020, 6, 30)), ("Z", "dead", D(2018, 1, 31)), ("W", "m", D(2019, 1, 15))]
    got = universe.inferred_delistings(spark.createDataFrame(rows, "code string, market string, snap_date date"), spark.createDataFrame([], "code string"))
    assert {r["code"]: r["delisting_date"] for r in got.collect()} == {"X": D(2019, 2, 28), "W": D(2019, 1, 31)}


def test_fold_counts_a_delisting_and_costs(spark):
    rows = [("a", D(2020, 1, 31), "X", 1.0, 1, 0, 0.0, None, D(2020, 2, 10)), ("a", D(2020, 1, 31), "Y", 1.0, 1, 0, 0.0, 0.1, None), ("a", D(2020, 2, 29), "Y", 1.0, 0, 1, 0.0, 0.1, None)]
    df = spark.createDataFrame(rows, "arm string, month date, code string, signal double, picked int, exits int, adv double, fwd_ret double, delisting_date date")
    one, two = sorted(portfolio.backtest(df).collect(), key=lambda r: r["month"])
    assert one["ret_gross"] == pytest.approx(0.12 * (-1 + 0.1)) and one["cost"] == pytest.approx(0.24 * (1.5e-4 + 0.02))
    assert two["names"] == 0 and two["turnover"] == pytest.approx(0.24) and two["cost"] == pytest.approx(0.24 * (1.5e-4 + 0.02 + 0.0025))


def test_arms_share_one_panel(spark):
    p = spark.createDataFrame([("A", D(2020, 1, 31), 0.5, 0.1), ("A", D(2020, 2, 29), None, 0.2)], "code string, month date, signal double, fwd_ret double")
    got = {(r["arm"], r["month"].month): r["signal"] for r in robustness.leak_arms(p).collect()}
    assert got == {("base", 1): 0.5, ("base", 2): None, ("oracle", 1): 1.0, ("oracle", 2): 1.0, ("early", 1): None, ("early", 2): None}


def test_dsr_equals_formula(spark):
    x = np.random.default_rng(2).normal(0.02, 0.05, 60)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "arm string, month int, ret double")
    sr, c = x.mean() / x.std(ddof=1), x - x.mean()
    skew, kurt = (c**3).mean() / (c**2).mean() ** 1.5, (c**4).mean() / (c**2).mean() ** 2
    best = (math.sqrt(2 * math.log(12)) * (1 - 0.5772156649) + 0.5772156649 * math.sqrt(2 * math.log(12 * math.e))) / math.sqrt(60)
    z = (sr - best) * math.sqrt(59) / math.sqrt(1 - skew * sr + (kurt - 1) / 4 * sr * sr)
    assert robustness.deflated_sharpe(df).first()["dsr"] == pytest.approx(0.5 * (1 + math.erf(z / math.sqrt(2))))


def test_normal_share_equals_the_error_function(spark):
    z = [None, -40.0, -8.4, -3.0, -0.5, 0.0, 1e-9, 1.96, 6.0, 8.4, 40.0]
    got = spark.createDataFrame([(v,) for v in z], "z double").select("z", robustness.normal_share(F.col("z")).alias("p")).collect()
    assert [r["p"] for r in got if r["z"] is None] == [None]
    assert all(r["p"] == pytest.approx(0.5 * (1 + math.erf(r["z"] / math.sqrt(2))), abs=1e-13) for r in got if r["z"] is not None)


def test_label_of_a_month_and_the_current_one(spark):
    rows = [("A", D(2019, 1, 31)), ("A", D(2019, 1, 31)), ("A", D(2020, 6, 30)), ("A", D(2022, 1, 31)), ("B", D(2020, 6, 30)), ("C", D(2020, 6, 30))]
    panel = spark.createDataFrame(rows, "code string, month date")
    now = spark.createDataFrame([("A", "new"), ("B", "b")], "code string, industry string")
    dated = spark.createDataFrame([("A", None, D(2020, 12, 31), "old"), ("A", D(2020, 1, 1), D(2020, 12, 31), "mid"), ("A", D(2020, 1, 1), D(2020, 12, 31), None), ("B", D(2021, 1, 1), None, "later")], "code string, valid_from date, valid_to date, industry string")
    got = sorted((r["code"], r["month"].year, r["industry"]) for r in universe.labelled(panel, now, "industry", dated).collect() if r["industry"])
    assert got == [("A", 2019, "old"), ("A", 2019, "old"), ("A", 2020, "mid"), ("A", 2022, "new"), ("B", 2020, "b")]
    assert universe.labelled(panel, now, "industry").count() == universe.labelled(panel, now, "industry", dated.limit(0)).count() == 6
