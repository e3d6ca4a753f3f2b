"""Mixing: targets against plain water-filling, flights against their constraints, the mix against its totals and reruns."""

import random
from collections import Counter, defaultdict
from itertools import product

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pitwright.llm import mixing


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    """Share, stop, share what is above again, until nothing is."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, free, left = dict.fromkeys(names, 0.0), set(names), float(sum(sizes.values()))
    while left > 1e-9 and free:
        share = sum(weight[s] for s in free)
        for s in free:
            target[s] += left * weight[s] / share
        left = sum(max(0, target[s] - most * sizes[s]) for s in names)
        for s in names:
            if target[s] >= most * sizes[s]:
                target[s] = float(most * sizes[s])
                free.discard(s)
    return target


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.floats(0, 1)), max_size=40), st.integers(0, 10**6))
def test_flight_keeps_both_totals(units, seed):
    sizes, p = [s for s, _ in units], [x for _, x in units]
    out = mixing.fly(sizes, p, random.Random(seed))
    assert abs(sum(out) - sum(p)) < 1e-6 and abs(sum(s * x for s, x in zip(sizes, out, strict=True)) - sum(s * x for s, x in zip(sizes, p, strict=True))) < 1e-5
    left = [s for s, x in zip(sizes, out, strict=True) if 0 < x < 1]
    assert len(left) <= 2 and len(set(left)) == len(left) and all(0 <= x <= 1 for x in out)


def test_flight_and_landing_keep_expectations():
    sizes, p, n = [3, 5, 7, 11, 2, 9], [0.2, 0.5, 0.7, 0.4, 0.9, 0.3], 4000
    seen = [0.0] * 6
    for seed in range(n):
        for k, x in enumerate(mixing.fly(sizes, p, random.Random(seed))):
            seen[k] += x / n
    assert all(abs(a - b) < 0.03 for a, b in zip(seen, p, strict=True))


def test_landing_is_the_nearest_of_all_outcomes():
    rng = random.Random(3)
    for _ in range(200):
        sizes, p = [rng.randint(0, 40) for _ in range(6)], [rng.choice([0.0, 1.0, rng.random()]) for _ in range(6)]
        p = mixing.fly(sizes, p, rng)
        out = mixing.land(sizes, p)
        off = lambda x, sizes=sizes, p=p: (round(abs(sum(s * (a - b) for s, a, b in zip(sizes, x, p, strict=True))), 6), round(abs(sum(x) - sum(p)), 6))
        assert set(out) <= {0.0, 1.0} and all(a == b for a, b in zip(out, p, strict=True) if b in (0.0, 1.0))
        assert off(out) == min(off([b if b in (0.0, 1.0) else t for b, t in zip(p, x, strict=True)]) for x in product((0, 1), repeat=6))


def _docs(spark, n=6000):
    rng = random.Random(11)
    rows = []
    for k in range(n):
        source = "hot" if k % 3 == 0 else rng.choice(["a", "b", "cé", None, "", "Z", "tiny"]) if k % 50 else "tiny"
        rows.append((k, " ".join(["w"] * int(rng.paretovariate(1.2) * 3)) if k % 97 else None, source))
    rows += [(7, "x y z", "hot")] * 2500 + [(None, "q r", None)] * 3
    return spark.createDataFrame(rows, "doc_id long, text string, source string"), rows


def test_mix_of_a_table(spark):
    docs, rows = _docs(spark)
    got = mixing.mix(docs).collect()
    size = lambda t: len((t or "").split())
    by = defaultdict(int)
    for _, t, s in rows:
        by[s] += size(t)
    want = plain_targets(by)
    assert Counter((r["doc_id"], r["size"], r["source"]) for r in got) == Counter((i, size(t), s) for i, t, s in rows)
    taken, most = defaultdict(int), max(size(t) for _, t, _ in rows)
    for r in got:
        taken[r["source"]] += r["taken"]
        assert r["source_size"] == by[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * (1 + want[r["source"]])
        assert r["taken"] == r["size"] * r["copies"] and 0 <= r["taken"] <= 3 * r["size"]
    for s in by:
        assert abs(taken[s] - want[s]) <= most, s  # only the landing's two documents can miss it
        rate = want[s] / by[s]
        copies = [r["copies"] for r in got if r["source"] == s]
        assert abs(sum(copies) - rate * len(copies)) <= 2 and {int(rate), int(rate) + 1} >= set(copies)
    again = mixing.mix(docs.repartition(7, F.rand(3))).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_many_blocks_land_as_near(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS", 16)
    monkeypatch.setattr(mixing, "FAN", 8)
    docs, rows = _docs(spark, 3000)
    got = mixing.mix(docs)
    off = got.groupBy("source").agg(F.abs(F.sum("taken") - F.first("target")).alias("off"), F.max("size").alias("most")).collect()
    assert got.count() == len(rows) and all(r["off"] <= r["most"] for r in off)


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, "a", 5), (2, "", "b", 6), (3, " \n", None, 7)], "doc_id long, text string, source string, size int")
    assert sorted((r["doc_id"], r["size"], r["target"], r["taken"]) for r in mixing.mix(docs).collect()) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0), (3, 0, 0.0, 0)]
    assert mixing.mix(docs.where(F.lit(False))).count() == 0
    one = spark.createDataFrame([(1, "w " * 500_000, "a")], "doc_id long, text string, source string").collect()
    assert [(r["target"], r["taken"]) for r in mixing.mix(spark.createDataFrame(one)).collect()] == [(500_000.0, 500_000)]
