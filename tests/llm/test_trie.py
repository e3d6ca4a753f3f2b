"""The conversation trie against a plain one, with bands so low that totals cross several levels of them."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pitwright.llm import conversation_trie as ct


def plain(sequences):
    """Rows of trie() from lists of (role, text) by conversation."""
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, turns in sorted(sequences.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                kids[tuple(turns[: d - 1])].add(tuple(turns[:d]))
        ends[tuple(turns)].append(c)
    leaves, saved = Counter(), Counter()
    for node, who in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not kids[node]
            saved[node[:d]] += (len(who) - 1) * len(node[-1][1].encode()) if node else 0
    sha = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    return Counter((min(who), len(n), min(members[n[:-1]]) if n else None, len(who), len(kids[n]), leaves[n], saved[n], sha(ends[n])) for n, who in members.items())


def rebuilt(table):
    own = defaultdict(list)
    for c, _, role, text in sorted((r for r in table if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own[c].append((role or "", text or ""))
    heads = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    return {c: own.get(c - c % 5, [])[: heads[c]] + turns[heads[c] :] for c, turns in own.items()}


def of(df):
    return Counter(map(tuple, df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()))


SCHEMA = "conv_id long, turn long, role string, text string"


def given_trie(spark, rows):
    return ct.trie(*ct.branched(ct.ordered(spark.createDataFrame(rows, SCHEMA))))


@pytest.mark.parametrize("band", [2, 3, 16])
def test_trie_of_many_conversations(spark, monkeypatch, band):
    monkeypatch.setattr(ct, "BAND", band)
    monkeypatch.setattr(ct, "CHUNK", 3)
    rng = random.Random(band)
    rows = []
    for c in [*range(60), 1000, 1001, 1004]:
        for t in range(rng.choice([1, 3, 9, 14, 40 if c % 9 == 0 else 5])):
            rows.append((c, t if t else None, rng.choice(["user", None]) if c % 3 else "user", rng.choice(["a", "bé", None]) if c % 2 else "same"))
    rng.shuffle(rows)
    assert of(given_trie(spark, rows)) == plain(rebuilt(rows))


def test_hot_conversation_and_hot_end(spark, monkeypatch):
    monkeypatch.setattr(ct, "BAND", 4)
    rows = [(5, t, "u", f"x{t}") for t in range(700)] + [(c, t, "u", "hello") for c in range(100, 500) for t in range(9)]
    rows += [(c, 0, "u", "hello") for c in range(500, 520)]
    assert of(given_trie(spark, rows)) == plain(rebuilt(rows))


def test_odd_tables(spark):
    rows = [(None, 0, "u", "lost"), (3, None, None, None), (3, 2, "u", "b"), (3, 1, "u", "é" * 200_000), (4, 0, "u", "t"), (4, 0, "u", "t"), (4, 0, "u", "t")]
    extra = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", place string, bytes int")
    assert of(ct.trie(*ct.branched(ct.ordered(extra)))) == plain(rebuilt(rows))
    empty = spark.createDataFrame([], SCHEMA)
    assert ct.trie(*ct.branched(ct.ordered(empty))).count() == 0


def test_running_totals_divide_equal_rows(spark):
    df = spark.createDataFrame([(k % 3 if k % 2 else 1, 7, k) for k in range(3000)], "c long, o long, v long").select("c", "o", "v")
    got = ct.running(df, "c", [F.col("o").asc()], {"n": ("sum", "o"), "x": ("bit_xor", "v")}).groupBy("c").agg(F.max("n").alias("n"), F.count_distinct("n").alias("k"), F.count("*").alias("all")).collect()
    assert all(r["n"] == 7 * r["all"] and r["k"] == r["all"] for r in got)
