"""Queries against their SQL on tables on which both once differed, and operators on what was found to be wrong."""

import datetime as dt
import math
import random
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pitwright.operators import audits, names, pit, ranks, tswin
from pitwright.plans import axes, axis_demos, texts
from pitwright.sources import files
from pitwright.sources.roles import role
from tests.test_names import ratio

NATION = [(0, "CHINA", 0), (1, "NEW LAND", 0)]


def both(spark, folder, query):
    """Rows of a query and of its SQL over the tables of a folder."""
    c = duckdb.connect()
    for t in folder.iterdir():
        c.execute(f"create view {t.stem} as select * from read_parquet('{t}/*.parquet')")
    sql = c.execute(entry.oracle_sql()[query]).fetchall()
    return sorted(map(tuple, entry.queries()[query](spark, str(folder)).collect()), key=str), sorted(sql, key=str)


def suppliers(spark, folder, keys):
    spark.createDataFrame([(k, f"Supplier#{k:09d}", k % 2, 10.0 * k) for k in keys], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(f"{folder}/supplier.parquet")
    spark.createDataFrame(NATION, "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{folder}/nation.parquet")
    spark.createDataFrame([(0, "ASIA")], "r_regionkey int, r_name string").write.parquet(f"{folder}/region.parquet")


def test_order_violations_pass_over_last_bits(spark):
    """Two values that differ in their last bits, on both sides of half a unit of the ninth digit; another that really differs."""
    df = spark.createDataFrame([(1, 0.1234567885), (2, 0.5), (3, None)], "k int, x double")
    calls = []

    def step(p):
        calls.append(1)
        off = F.when(F.col("k") == 1, 1e-15).when(F.col("k") == 2, 3e-9).otherwise(0.0) * (1 if len(calls) % 2 else -1)
        return p.withColumn("z", F.col("x") + off)

    assert [tuple(r) for r in audits.order_violations(df, step, ["k"], "z").collect()] == [("differs", 1)]


def test_inventory_below_a_folder_that_names_a_day(spark, tmp_path):
    root = tmp_path / "app-20261130152512-0001" / "x"
    for k, day in enumerate(("2006-01-31", "2006-02-28")):
        (root / f"asof={day}").mkdir(parents=True)
        (root / f"asof={day}" / f"part-0000{k}-aaaa2012-0131-4aaa-8aaa-aaaaaaaaaaaa.txt").write_text("1")
    (root / "none.txt").write_text("1")
    for path in (str(root), f"file://{root}", f"file:{root}/"):
        got = {r["path"].split("/")[-1]: r["day"] for r in files.inventory(spark, path, {}).collect()}
        assert sorted(got.values()) == [dt.date(2006, 1, 31), dt.date(2006, 2, 28), dt.date(2026, 11, 30)] and got["none.txt"] == dt.date(2026, 11, 30)


def test_liquidity_priority_with_half_cents(spark, tmp_path):
    suppliers(spark, tmp_path, range(1, 40))
    day = dt.datetime(1996, 1, 1)
    rows = [(k, day + dt.timedelta(days=d), x, 1.0, "A") for k in range(1, 40) for d in (0, 1) for x in (58000.07 + k / 10 + d * 0.01 * (2 * k + 1), 0.11 * k, 0.03)]
    spark.createDataFrame(rows, "l_suppkey long, l_shipdate timestamp, l_extendedprice double, l_quantity double, l_returnflag string").withColumns({c: F.lit(1).cast(t) for c, t in (("l_orderkey", "long"), ("l_partkey", "long"), ("l_discount", "double"), ("l_tax", "double"))}).write.parquet(f"{tmp_path}/lineitem.parquet")
    got, sql = both(spark, tmp_path, "liquidity_priority")
    assert got == sql and len(got) == 39


@pytest.mark.parametrize(("query", "keys", "n"), [("match_lineage", [100, 102, 1000, 1001, 1002, 1003, 10000, 10001, 10002, 10005, 10009, 10030], None), ("norm_report", [2, 49998, 50000, 50002, 60001, 60002], 6)])
def test_queries_with_large_keys(spark, tmp_path, query, keys, n):
    suppliers(spark, tmp_path, keys)
    got, sql = both(spark, tmp_path, query)
    assert got == sql and got and len(got) == (n or len(got))


def test_token_sets_go_on_from_what_words_find(spark):
    """Names of common words and five letters, each with a word written wrong: their best partners, against all pairs; those that words
    find bound the others, so few pairs of common grams are scored."""
    rnd = random.Random(2)
    tail = lambda: "".join(rnd.choice("qwrtpsdfgh") for _ in range(5))
    right = [(f"nation_{k % 3} {tail()} trading house", k) for k in range(400)]
    changes = [lambda n: n.replace("trading", "tradng"), lambda n: n.replace("house", "hose") + " x", lambda n: n[:10] + rnd.choice("qwr") + n[11:], lambda n: n.replace(" trading", "trading"), lambda n: n.replace("trading house", "ltd"), lambda n: n[1:]]
    left = [(changes[k % 6](n),) for k, (n, _) in enumerate(right[:90])]
    a, b = spark.createDataFrame(left, "name string"), spark.createDataFrame(right, "name string, code int")
    seen, plain_close = [], names.close_pairs

    def counted(*args):
        pairs = plain_close(*args)
        seen.append(pairs.count())
        return pairs

    names.close_pairs = counted
    try:
        got = {r[0]: (r[1], round(r[2], 6)) for r in names.token_set_matches(a, b, "name", "code").collect()}
    finally:
        names.close_pairs = plain_close
    want = {}
    for (x,) in left:
        score, code = min((-round(ratio(x, n), 6), k) for n, k in right)
        if -score >= 92:
            want[x] = (code, -score)
    assert got == want and len(want) > 60 and seen[0] < 90 * 400 / 30


def test_residual_of_logs_that_hardly_vary(spark):
    """Logs of about 18 that differ in the sixth digit, against exact fractions: sums of squares that aren't centred leave 4 digits of it."""
    rng = random.Random(5)
    q = [float(round(6e7 * (1 + 1e-5 * rng.random()))) for _ in range(40)]
    y = [7 + 1e-3 * rng.random() for _ in range(40)]
    rows = [(1, k, y[k], q[k], 40 + k) for k in range(40)]
    got = tswin.ols_residual(spark.createDataFrame(rows, "code int, month int, y double, q double, t int"), "y", "q", "t", tswin.along()).orderBy("month").collect()
    for k in range(35, 40):
        data = [(Fraction(1), Fraction(math.log(q[j])), Fraction(40 + j), Fraction(y[j])) for j in range(k - 35, k + 1)]
        m = [[sum(r[i] * r[j] for r in data) for j in range(4)] for i in range(3)]
        ridge = Fraction(1e-8) * max(1, sum(m[i][i] for i in range(3)) / 3)
        for i in range(3):
            m[i][i] += ridge
        for i in range(3):
            m[i] = [v / m[i][i] for v in m[i]]
            m = [row if j == i else [v - row[i] * u for v, u in zip(row, m[i], strict=True)] for j, row in enumerate(m)]
        want = float(data[-1][3] - sum(data[-1][i] * m[i][3] for i in range(3)))
        assert got[k]["resid"] == pytest.approx(want, rel=1e-9)


def test_words_of_texts_are_never_shuffled(spark):
    """Words are counted where a text, or a text and its neighbour, lies: no plan lays them out as rows, groups or orders them."""
    rows = [(1, 1, "b a  a!ab ab"), (1, 2, "ab zz"), (1, 3, "."), (1, 6, "ab"), (2, 1, None), (2, 2, "ab cd cd éé")]
    df = spark.createDataFrame(rows, "k int, n int, text string")
    top, sim = texts.top_tokens(df, ["k", "n"], "text", 2), axes.text_similarity(df, ["k"], "n")
    assert sorted(map(tuple, top.collect())) == [(1, 1, "ab", 2, 1), (1, 2, "ab", 1, 1), (1, 2, "zz", 1, 2), (1, 6, "ab", 1, 1), (2, 2, "ab", 1, 2), (2, 2, "cd", 2, 1)]
    assert sorted(map(tuple, sim.collect()), key=str) == [(1, 2, pytest.approx(0.5**0.5)), (1, 3, None), (2, 2, None)]
    for made in (top, sim):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan and "Aggregate" not in plan


def test_scored_panel_is_read_from_one_narrow_table(spark):
    """What stands on the scored panel doesn't make it again from the lines, and carries no statements along."""
    p = axis_demos.scored_panel(spark, "/root/testdata/sf0.001")
    assert not set(axis_demos._FUND) & set(p.columns) and "lineitem" not in p._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["reports", "awards"])
def test_parts_of_what_lines_and_orders_make_have_counted_rows(spark, monkeypatch, name):
    """As many parts as the rows need, though all of it would fit one by its bytes."""
    monkeypatch.setattr(files, "PART_ROWS", 500)
    sizes = [n for _, n in role(spark, "/root/testdata/sf0.001", name).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) > 3000 and max(sizes) < 1000


def test_sums_of_whole_groups_within_and_over_ranges(spark):
    """A group that lies in many ranges, one that fills a range's end, and small ones, whose whole sums come without a join."""
    rows = [(g, float(x)) for g, n in (("a", 3), ("b", 40), ("c", 1), ("d", 9), ("e", 2)) for x in range(n)]
    df = spark.createDataFrame(rows, "g string, x double").withColumn("n", F.lit(1).cast("long"))
    for size in (1, 7, 1000):
        got = ranks.running_sum(df, "g", ["x"], "n", "upto", "all", size).collect()
        assert sorted((r["g"], r["x"], r["upto"], r["all"]) for r in got) == [(g, x, int(x) + 1, sum(h == g for h, _ in rows)) for g, x in rows]


def test_asof_join_makes_its_sides_once_in_parts_of_counted_rows(spark, monkeypatch):
    """Neither side's expressions are in the plan any more, which has as many parts as the rows need, hot keys or none."""
    monkeypatch.setattr(files, "PART_ROWS", 100)
    left = spark.range(3000).select((F.col("id") % 40).alias("k"), (F.col("id") + 7).alias("t"))
    right = spark.range(900).select((F.col("id") % 30).alias("k"), F.col("id").alias("u"), (F.col("id") * 3).alias("v"))
    for rows in (1_000_000, 110):
        got = pit.asof_join(left, right, "k", "t", "u", ["v"], ["u"], rows=rows)
        sizes = [n for _, n in got.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 3000 and max(sizes) < 700 and "Range" not in got._jdf.queryExecution().optimizedPlan().toString().replace("__range", "")
        want = {(r["k"], r["t"]): max((u for u in range(r["k"], min(900, r["t"] + 1), 30)), default=None) if r["k"] < 30 else None for r in left.collect()}
        assert {(r["k"], r["t"]): r["v"] for r in got.collect()} == {x: None if u is None else 3 * u for x, u in want.items()}
