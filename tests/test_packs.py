"""Packs and report entities against hand-made cases."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from pitwright.functions.exprs import clip
from pitwright.operators import entity, ledger
from pitwright.plans import axis_demos, demos, pack_demos, packs  # noqa: F401

D = dt.date
DATA = "/root/testdata/sf0.01"


def test_clip_keeps_null(spark):
    got = spark.createDataFrame([(None,), (-1.0,), (0.5,), (9.0,)], "x double").select(clip(F.col("x"), 0.0, 2.0).alias("c")).collect()
    assert [r["c"] for r in got] == [None, 0.0, 0.5, 2.0]


def test_packs_without_policy_are_refused_and_disabled_ones_are_null(spark):
    held = packs.Packs()
    with pytest.raises(ValueError):
        held.register("N", lambda p: p, [])
    held.register("N", lambda p: p.withColumn("E_N", F.lit(1.0)), [("2020-01-01", None)])
    held.register("X", lambda p: p.withColumn("E_X", F.lit(1.0)), [("2020-01-01", None)])
    held.disable("X", "no table")
    row = held.apply(spark.range(1)).first()
    assert (row["E_N"], row["E_X"]) == (1.0, None)


def test_marginal_wage_skips_july_and_small_changes(spark):
    rows = [(D(2020, 5, 31), 100, 900.0), (D(2020, 6, 30), 110, 990.0), (D(2020, 7, 31), 130, 1200.0), (D(2020, 8, 31), 132, 1300.0), (D(2020, 9, 30), None, None)]
    p = spark.createDataFrame([("A", m, n and float(n), v, 1.0, 1.0, None, None, None) for m, n, v in rows], "code string, month date, members double, paid double, quit double, n_places double, employees double, tax_expense double, pretax_income double")
    got = packs.employment_features(p).orderBy("month").collect()
    assert [r["marginal_wage"] and round(r["marginal_wage"], 6) for r in got] == [None, 100.0, None, None, None]
    assert [r["near_band"] for r in got] == [1, 1, 0, 0, 0] and [r["theta_N"] for r in got] == [None] * 5


def test_price_residual_needs_months_without_a_gap(spark):
    months = [D(2000 + k // 12, k % 12 + 1, 28) for k in range(60)]
    rows = [(c, m, 100.0 + k * k % 17, 50.0 + k % 7, 0.1, 0.5, 1.0, 1.0) for c, gap in (("A", None), ("B", 30)) for k, m in enumerate(months) if k != gap]
    p = spark.createDataFrame(rows, "code string, month date, exp_usd double, exp_wgt double, hhi_dest double, adv_share double, revenue_ttm double, sgna_ttm double")
    n = {r["code"]: r["n"] for r in packs.customs_features(p).groupBy("code").agg(F.count("resid").alias("n")).collect()}
    assert n == {"A": 25, "B": 0}


def test_authors_and_links(spark):
    rows = [(1, "한국", "홍길동 연구원, 김철수/홍길동 외 2인", "x", "c", D(2020, 1, 1), 1.0), (2, "한국", "", "Ann Lee, Bo", None, D(2020, 1, 2), None), (3, "한국", None, None, None, D(2020, 1, 3), None), (4, "미국", "홍길동", None, "d", D(2020, 1, 4), None)]
    q = spark.createDataFrame(rows, "uid long, broker string, author_list string, author_found string, code string, pub_date date, target double")
    links = entity.author_links(q)
    assert {(r["uid"], r["name"], r["role"], r["confidence"]) for r in links.collect()} == {(1, "홍길동", "lead", 0.98), (1, "김철수", "co", 0.98), (2, "AnnLee", "lead", 0.8), (2, "Bo", "co", 0.8), (4, "홍길동", "lead", 0.98)}
    assert {r["name"] for r in entity.author_master(links).where("ambiguous").collect()} == {"홍길동"}
    audits = {(r["grouping"], r["value"]): r for r in entity.linkage_audit(q, links, {"yr": F.year("pub_date"), "method": F.col("method")}).collect()}
    audit = audits["yr", "2020"]
    assert {k: (r["n"], r["authors"], r["confidence"]) for k, r in audits.items()} == {("yr", "2020"): (4, 5, pytest.approx(2.76 / 3)), ("method", "list_field"): (2, 3, pytest.approx(0.98)), ("method", "pdf_header"): (1, 2, pytest.approx(0.8)), ("method", None): (1, 0, None)}
    assert (audit["n"], audit["with_author"], audit["with_code"], audit["with_target"]) == (4, 0.75, 0.5, 0.25)


def test_subtotals_go_and_nulls_stay(spark):
    df = spark.createDataFrame([("합 계",), ("staff",), (None,), ("소계",)], "label string")
    assert {r["label"] for r in ledger.without_subtotals(df, "label").collect()} == {"staff", None}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="tables are absent")
def test_gaps_of_all_years_and_all_veto_rules(spark):
    held = {tuple(r) for r in demos.role(spark, DATA, "statements").select("code", "yr", "q").collect()}
    codes = [r["code"] for r in demos.role(spark, DATA, "security").select("code").collect()]
    years = {yr for _, yr, _ in held}
    want = sorted((c, yr, q) for c in codes for yr in range(min(years), max(years) + 1) for q in range(1, 5) if (c, yr, q) not in held)
    assert sorted(map(tuple, demos.QUERIES["todo_antijoin"](spark, DATA).select("code", "yr", "q").collect())) == want
    assert sorted(r["rule"] for r in demos.QUERIES["veto_fired"](spark, DATA).collect()) == [f"V{k}" for k in range(1, 9)]
