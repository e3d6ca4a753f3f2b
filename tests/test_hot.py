"""Operators whose groups may hold most of the rows, against plain computations."""

import random
import statistics
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitwright.operators import ranks, tswin, xsec


def _cells(n=4000, hot=0.9):
    rnd = random.Random(3)
    rows = []
    for k in range(n):
        cell = "hot" if rnd.random() < hot else rnd.choice(["a", "b", None, "tiny" if k % 40 == 0 else "a"])
        rows.append((k, cell, None if k % 17 == 0 else rnd.choice([1.0, 2.5, float(rnd.randrange(50)), rnd.gauss(0, 9)])))
    return rows


@pytest.mark.parametrize("rows", [1_000_000, 200])
def test_ranks_in_a_cell_of_nine_tenths(spark, rows):
    data = _cells()
    got = {r["k"]: r["p"] for r in xsec.rank_pct(spark.createDataFrame(data, "k int, cell string, x double"), "x", "cell", "p", rows=rows).collect()}
    by = defaultdict(list)
    for _, c, x in data:
        if x is not None:
            by[c].append(x)
    for k, c, x in data:
        want = None if x is None or len(by[c]) < 8 else (sum(v < x for v in by[c]) + (sum(v == x for v in by[c]) + 1) / 2) / len(by[c])
        assert got[k] == (None if want is None else pytest.approx(want, abs=1e-12))


def test_zscores_of_several_features_and_levels(spark):
    data = _cells()
    df = spark.createDataFrame([(k, c, "all", x, None if x is None else -x * 3) for k, c, x in data], "k int, cell string, wide string, x double, y double")
    got = {r["k"]: r for r in xsec.zscores(df, {"zx": "x", "zy": "y"}, ["cell", "wide"]).collect()}

    def z(values):
        v = np.array(values)
        c = np.clip(v, v.mean() - 2 * v.std(), v.mean() + 2 * v.std())
        return (c - c.mean()) / c.std()

    want = {}
    for level in ("wide", "cell"):
        by = defaultdict(list)
        for k, c, x in data:
            if x is not None:
                by[c if level == "cell" else "all"].append((k, x))
        for rows in by.values():
            if len(rows) >= 8:
                want |= dict(zip([k for k, _ in rows], z([x for _, x in rows]), strict=True))
    for k, _, x in data:
        assert got[k]["zx"] == (None if x is None else pytest.approx(want[k], abs=1e-9)) and got[k]["zy"] == (None if x is None else pytest.approx(-want[k], abs=1e-9))


@pytest.mark.parametrize("rows", [1_000_000, 30])
def test_quantiles_of_a_hot_group(spark, rows):
    data = [(c, x) for _, c, x in _cells(2500)]
    got = {r["g"]: r for r in ranks.quantiles(spark.createDataFrame(data, "g string, x double"), ["g"], "x", {"q0": 0.0, "q5": 0.5, "q9": 0.9, "q1": 1.0}, rows).collect()}
    by = defaultdict(list)
    for c, x in data:
        if x is not None:
            by[c].append(x)
    assert set(got) == set(by)
    for c, v in by.items():
        assert [got[c][q] for q in ("q0", "q5", "q9", "q1")] == pytest.approx([float(np.quantile(v, q)) for q in (0, 0.5, 0.9, 1)], abs=1e-9)
        assert got[c]["q5"] == pytest.approx(statistics.median(v))
    empty = spark.createDataFrame([], "g string, x double")
    assert ranks.quantiles(empty, ["g"], "x", {"q": 0.5}).collect() == []


def test_growth_with_losses(spark):
    rows = [("a", 1, 0.1), ("a", 2, -1.0), ("a", 3, 0.1), ("b", 1, 0.5), ("b", 2, None), ("b", 3, -1.5), ("c", 1, None)]
    df = spark.createDataFrame(rows, "arm string, t int, r double")
    got = {r["arm"]: r["g"] for r in df.groupBy("arm").agg(tswin.growth(F.col("r")).alias("g")).collect()}
    assert got["a"] == 0 and got["b"] == pytest.approx(1.5 * -0.5) and got["c"] is None
    down = {(r["arm"], r["t"]): (r["wealth"], r["drawdown"]) for r in tswin.drawdown(df, "r", ["arm"], "t").collect()}
    assert down["a", 1] == (pytest.approx(1.1), pytest.approx(0.0)) and down["a", 2] == (0.0, -1.0) and down["a", 3] == (0.0, -1.0)
