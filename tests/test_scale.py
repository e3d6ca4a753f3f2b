"""Operators whose plans hold with hot keys, against brute force."""

import datetime as dt
import itertools
import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitwright.functions import exprs as X
from pitwright.operators import audits, entity, ledger, pit, ranks, tswin, universe
from pitwright.plans import portfolio
from pitwright.sources import files, roles
from tests import plain

D = dt.date


def day(k):
    return D(2000, 1, 1) + dt.timedelta(days=k)


@pytest.mark.parametrize("rows", [1_000_000, 60, 7])
def test_asof_join_with_a_hot_key_ties_and_nulls(spark, rows):
    rnd = random.Random(3)
    left = [(k, None if k % 11 == 0 else "hot" if k % 3 else f"c{k % 5}", day(rnd.randrange(900))) for k in range(400)]
    right = [("hot" if k % 2 else f"c{k % 5}", day(rnd.randrange(300, 700) // 7 * 7), k, None if k % 6 == 0 else float(k)) for k in range(150)] + [(None, day(1), 999, 1.0)]
    lhs, rhs = spark.createDataFrame(left, "id int, key string, at date"), spark.createDataFrame(right, "key string, known date, seq int, v double")
    got = {r["id"]: (r["seq"], r["v"]) for r in pit.asof_join(lhs, rhs, "key", "at", "known", ["seq", "v"], ["seq"], rows=rows).collect()}
    for i, key, at in left:
        there = [x for x in right if key is not None and x[0] == key and x[1] <= at]
        best = max(there, key=lambda x: (x[1], x[2])) if there else None
        assert got[i] == ((best[2], best[3]) if best else (None, None))


@pytest.mark.parametrize("rows", [50_000, 40, 7, 1])
def test_expanding_medians(spark, rows):
    """Sections of one block and of many, one without a name, a number that a third of all rows have, in and out of order."""
    rnd = random.Random(4)
    spread = [1.5, 2.0, 7.25, rnd.random, lambda: -rnd.random() * 9, lambda: float(len(data))]
    data = []
    for k in range(150):
        v = rnd.choice(spread)
        data.append((None if k % 31 == 0 else "hot" if k % 3 else f"s{k % 4}", k, None if k % 9 == 0 or 60 < k < 70 else v() if callable(v) else v))
    df = spark.createDataFrame(rnd.sample(data, len(data)), "section string, t int, x double")
    own = tswin.expanding_median(df, "x", "section", ["t"], "a", 5, rows=rows)
    got = {r["t"]: r for r in tswin.expanding_median(own, "x", None, ["t"], "b", 1, lagged=False, rows=rows).collect()}
    assert len(got) == len(data)
    for s, t, _ in data:
        before = [x for r, k, x in data if r == s and k < t and x is not None]
        upto = [x for _, k, x in data if k <= t and x is not None]
        assert got[t]["a"] == (statistics.median(before) if len(before) >= 5 else None)
        assert got[t]["b"] == (statistics.median(upto) if upto else None)
    assert tswin.expanding_median(df.limit(0), "x", None, ["t"]).collect() == []


def test_hac_t_of_long_series(spark):
    """More than 12 lags, against plain sums."""
    rng = np.random.default_rng(2)
    n = 21_000
    x = np.convolve(rng.normal(0.05, 1, n + 5), np.ones(5), "valid")[:n]
    df = spark.createDataFrame([("a", k, float(v)) for k, v in enumerate(x)] + [("b", k, float(k % 3)) for k in range(30)], "k string, t int, x double")
    got = {r["k"]: r["t"] for r in tswin.hac_t(df, "x", ["k"], "t").collect()}
    e, lags = x - x.mean(), math.floor(4 * (n / 100) ** (2 / 9))
    assert lags > 12
    s = (e @ e) + 2 * sum((1 - k / (lags + 1)) * (e[k:] @ e[:-k]) for k in range(1, lags + 1))
    assert got["a"] == pytest.approx(x.mean() / math.sqrt(s / n / n), rel=1e-9) and got["b"] is not None


def test_fuzzy_matches_of_names_with_one_beginning(spark):
    rnd = random.Random(9)
    names = [f"Supplier#{k:06d}" for k in range(40)] + ["a rather long name of a house in the city " + c * 3 for c in "xyz"] + ["Superb"]
    wrong = [n[:k] + rnd.choice("#0x") + n[k + rnd.choice((0, 1)) :] for n in names for k in (9, len(n) - 2)]
    left, right = spark.createDataFrame([(w,) for w in wrong], "name string"), spark.createDataFrame([(n, k) for k, n in enumerate(names)], "name string, code int")
    got = {r["name"]: (r["code"], round(r["score"], 6)) for r in ledger.fuzzy_match(left, right, "name", "code").collect()}

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
        return row[-1]

    for w in set(wrong):
        scored = [(-100 * (1 - edits(w, n) / max(len(w), len(n))), k) for k, n in enumerate(names) if n[:2] == w[:2]]
        best = min(scored) if scored else (0, None)
        assert got.get(w) == ((best[1], round(-best[0], 6)) if -best[0] >= 92 else None), w


@pytest.mark.parametrize("rows", [1_000_000, 90, 7])
def test_global_ranks(spark, rows):
    rnd = random.Random(5)
    data = [(k, None if k % 50 == 0 else float(rnd.choice([1, 1, 1, rnd.random()]))) for k in range(700)]
    df = spark.createDataFrame(data, "code int, x double")
    got = {r["code"]: r["n"] for r in ranks.global_rank(df, "x", "n", F.col("code"), descending=True, rows=rows).collect()}
    order = sorted(data, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert got == {c: k + 1 for k, (c, _) in enumerate(order)}


def test_capped_weights_equal_the_loop(spark):
    rnd = random.Random(6)
    rows = [(f"m{m}", f"c{k:02d}", rnd.choice([0.5, rnd.random(), 3 * rnd.random()]), rnd.choice([None, 0.0, 1e5, 1e7, 4e8])) for m in range(25) for k in range(rnd.randrange(1, 26))]
    got = portfolio.capped_weights(spark.createDataFrame(rows, "month string, code string, signal double, adv double"), ["month"], "signal", "adv").collect()
    for m, g in itertools.groupby(sorted(got, key=lambda r: (r["month"], r["code"])), key=lambda r: r["month"]):
        own = sorted((r for r in rows if r[0] == m), key=lambda r: r[1])
        want = plain.weights(np.array([r[2] for r in own]), np.array([np.nan if r[3] is None else r[3] for r in own]), portfolio.ACCOUNT)
        assert np.allclose([r["w"] for r in g], want, atol=1e-9)


def test_backtest_equals_a_plain_loop(spark):
    rnd = random.Random(7)
    months = [D(2020 + k // 12, k % 12 + 1, 28) for k in range(30)]
    rows = [("a", m, f"c{c}", rnd.random(), int(rnd.random() < 0.3), int(rnd.random() < 0.2), rnd.choice([0.0, 1e6, 1e9]), None if rnd.random() < 0.1 else rnd.uniform(-0.2, 0.2)) for m in months for c in range(8) if rnd.random() < 0.9]
    got = portfolio.backtest(spark.createDataFrame(rows, "arm string, month date, code string, signal double, picked int, exits int, adv double, fwd_ret double"), most=4, hold=3).orderBy("month").collect()
    age, before = {}, {}
    for m, r in zip(months, got, strict=True):
        here = {x[2]: x for x in rows if x[1] == m}
        names = {c for c, x in here.items() if x[4]} | {c for c, a in age.items() if c in here and not here[c][5] and a < 3}
        names = sorted(names, key=lambda c: (-here[c][3], c))[:4]
        w = dict(zip(names, plain.weights(np.array([here[c][3] for c in names]), np.array([here[c][6] for c in names]), portfolio.ACCOUNT)))
        turnover = cost = 0.0
        for c in sorted({*w, *before}):
            d, adv = w.get(c, 0) - before.get(c, 0), here[c][6] if c in here else 0.0
            turnover += abs(d)
            cost += abs(d) * (1.5e-4 + (0.1 * math.sqrt(min(1, abs(d) * portfolio.ACCOUNT / adv)) if adv else 0.02) + (plain.tax_on(m) if d < 0 else 0))
        gross = sum(v * (here[c][7] or 0) for c, v in w.items())
        assert (r["names"], round(r["turnover"], 9), round(r["cost"], 9), round(r["ret"], 9)) == (len(w), round(turnover, 9), round(cost, 9), round(gross - cost, 9))
        age, before = {c: age.get(c, -1) + 1 for c in w}, w


def test_names_texts_and_files(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(entity.authors(F.lit("홍길동 연구원, 김유신수석/이 순신 외 2인 (리서치센터) · Bob Lee; 증권  강감찬 및 홍길동"))) == ["홍길동", "김유신", "이순신", "BobLee", "강감찬"]
    assert one(entity.canonical(F.lit("대우 증권 리서치센터"), [("대우증권", "미래에셋증권")])) == "미래에셋증권" and one(entity.canonical(F.lit(" 리서치 "), [])) == "리서치" and one(entity.canonical(F.lit(" "), [])) is None
    assert one(X.amount(F.lit("−1,234"))) == -1234 and one(X.amount(F.lit("x"))) is None
    assert one(X.norm_company(F.lit("(주)가나다 Co., Ltd."))) == "가나다" and one(X.norm_company(F.lit("주식회사가나다"))) == "가나다"
    assert one(files.day_in_path(F.lit("/a/2019-01-02/b_20210430.pdf"))) == D(2021, 4, 30) and one(files.day_in_path(F.lit("/a/1999-01-02/x"))) is None
    assert one(files.day_in_path(F.lit("/a/2019-01-02/rep_20200304_20210506.pdf"))) == D(2020, 3, 4) and one(files.day_in_path(F.lit("/a/2019.01.02/2018/rep_20201399.pdf"))) == D(2019, 1, 2)
    people = one(X.report_fields(F.lit("담당 홍길동연구원 (02-123-4567) hong.gd@x.co.kr. / 김유신 수석 kim@y.com\nTP(원) 12,500 목표주가 9,000")))
    assert (people["names"], people["emails"], people["target"]) == ("홍길동,김유신", "hong.gd@x.co.kr,kim@y.com", 12500.0)
    assert one(X.report_fields(F.lit("no one")))["names"] == "" and one(X.report_fields(F.lit(None).cast("string")))["target"] is None
    with pytest.raises(ValueError):
        audits.unique_columns(spark.range(1).select("id", "id"))


def test_declared_types_are_kept_and_wrong_ones_refused(spark):
    df = spark.createDataFrame([(1, "x", 2.0)], "l_orderkey int, extra string, l_tax double")
    assert dict(roles.conforming(df, "l_orderkey long, l_tax double").dtypes) == {"l_orderkey": "bigint", "extra": "string", "l_tax": "double"}
    with pytest.raises(TypeError, match="l_tax bigint: double, l_lost string: absent"):
        roles.conforming(df, "l_orderkey long, l_tax bigint, l_lost string")


def test_range_joins_have_no_nested_loops(spark):
    D_ = lambda m, d=1: D(2020, m, d)
    months = spark.createDataFrame([(D(2019, 12, 31),), (D_(1, 31),), (D_(6, 30),), (D(2021, 1, 31),)], "month date")
    sec = spark.createDataFrame([("a", D(2018, 1, 1), D_(6, 30)), ("b", None, D_(2, 1)), ("c", D_(2, 1), None), ("d", None, None), ("e", D(2022, 1, 1), None)], "code string, listing_date date, delisting_date date")
    got = universe.members(months, sec)
    assert {tuple(r) for r in got.collect()} == {(D(2019, 12, 31), "a"), (D_(1, 31), "a"), (D(2019, 12, 31), "b"), (D_(1, 31), "b"), (D_(6, 30), "c"), (D(2021, 1, 31), "c")}
    windows = spark.createDataFrame([(D_(1, 15), D_(3, 1)), (D(2023, 1, 1), None)], "start date, end date")
    masked = pit.mask_windows(months, windows, 2)
    assert {r["month"]: r["masked"] for r in masked.collect()} == {D(2019, 12, 31): 1, D_(1, 31): 1, D_(6, 30): 0, D(2021, 1, 31): 0}
    facts = spark.createDataFrame([("k", D(2019, 5, 1)), ("k", D_(5, 1)), ("k", D(2021, 5, 1)), ("x", D_(5, 1))], "key string, day date")
    mapping = spark.createDataFrame([("k", 1, None, D(2019, 12, 31)), ("k", 2, D_(1, 1), None), ("x", 3, D_(6, 1), D_(7, 1))], "key string, to int, valid_from date, valid_to date")
    joined = pit.valid_interval_join(facts, mapping, "key", "day")
    assert {(r["day"], r["to"]) for r in joined.collect()} == {(D(2019, 5, 1), 1), (D_(5, 1), 2), (D(2021, 5, 1), 2)}
    snaps = spark.createDataFrame([("a", D(2019, 11, 30)), ("b", D_(1, 31)), ("c", D_(2, 28))], "code string, snap_date date")
    newest = universe.snapshot_members(months, snaps, 100)
    assert {tuple(r) for r in newest.collect()} == {(D(2019, 12, 31), "a"), (D_(1, 31), "b")}
    for df in (got, masked, joined, newest):
        assert "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString()


def test_members_of_many_arms_equal_a_plain_loop(spark):
    """Arms with months of their own, months in which nothing can be held, codes that are gone for a while, missing signals and exits."""
    rnd = random.Random(8)
    rows = []
    for arm, hold_off in (("a", 0), ("b", 7), ("c", 3)):
        for k in range(26):
            if arm == "b" and k % 5 == 2:
                continue  # a month that the arm doesn't have
            for c in range(12):
                if rnd.random() < 0.8:
                    quiet = hold_off <= k < hold_off + 6 and arm != "a"
                    rows.append((arm, D(2020 + k // 12, k % 12 + 1, 28), c, rnd.choice([None, float("nan"), 0.5, rnd.random(), rnd.random()]), 0 if quiet else int(rnd.random() < 0.15), rnd.choice([0, 0, 0, 0, 1, None]), None, 0.01))
    df = spark.createDataFrame(rows, "arm string, month date, code int, signal double, picked int, exits int, adv double, fwd_ret double")
    near = portfolio.candidates(df.withColumn("signal", portfolio._known(F.col("signal"))), hold=4)
    got = {(r["arm"], r["__i"], r["code"]): r["age"] for r in portfolio.members(near, hold=4, most=5).collect()}
    want = {}
    for arm in "abc":
        held = {}
        for i, (m, g) in enumerate(itertools.groupby(sorted((r for r in rows if r[0] == arm), key=lambda r: r[1]), key=lambda r: r[1])):
            names = [r for r in g if r[4] or (r[2] in held and r[5] == 0 and held[r[2]] < 4)]
            low = lambda r: (r[3] is None or math.isnan(r[3]), -(r[3] or 0) if r[3] == r[3] else 0, r[2])
            held = {r[2]: held.get(r[2], -1) + 1 for r in sorted(names, key=low)[:5]}
            want |= {(arm, i + 1, c): a for c, a in held.items()}
    assert got == want and {a for a, _, _ in got} == set("abc")
    assert sorted(r["names"] for r in portfolio.backtest(df.where("picked = 0")).collect()) == [0] * df.select("arm", "month").where("picked = 0").distinct().count()
    assert portfolio.backtest(df.limit(0)).count() == 0
