"""Periodic runs against all pairs of places."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pitwright.llm import periodic_runs as pr


def all_runs(words, min_length, min_exponent):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i >= q:
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items() if e - s >= max(min_length, min_exponent * q))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=60), st.sampled_from([(6, 4), (2, 2), (5, 3)]))
def test_runs_of_small_alphabets(words, bounds):
    assert pr.word_runs(words, *bounds) == all_runs(words, *bounds)


def test_runs_of_planted_repetitions():
    rng = random.Random(5)
    for _ in range(150):
        n = rng.randint(20, 300)
        words = [b"%d" % rng.randint(0, rng.choice([1, 4, 1000])) for _ in range(n)]
        for _ in range(rng.randint(1, 4)):
            s = rng.randrange(n - 4)
            p, e = rng.randint(1, (n - s) // 2), rng.randint(s, n)
            words[s:e] = [words[s + (i - s) % p] for i in range(s, e)]
        for bounds in ((6, 4), (2, 2)):
            assert pr.word_runs(words, *bounds) == all_runs(words, *bounds)


def test_words_may_come_in_pieces():
    rng = random.Random(7)
    words = [rng.randint(0, 2) for _ in range(400)]
    whole, pieces = pr.Catchers(), pr.Catchers()
    whole.extend(words)
    for k in range(0, 400, 7):
        pieces.extend(words[k : k + 7])
    assert whole.finish() == pieces.finish()


def test_hard_texts_stay_near_linear():
    fib = [b"a"], [b"a", b"b"]
    while len(fib[1]) < 6000:
        fib = fib[1], fib[1] + fib[0]
    for words in ([b"a"] * 20_000, ([b"a"] * 2500 + [b"b"]) * 4, fib[1]):
        pr.word_runs(words)
    assert pr.word_runs([b"a"] * 20_000) == [(0, 20_000, 1)]
    assert (0, 10_004, 2501) in pr.word_runs(([b"a"] * 2500 + [b"b"]) * 4)


def test_table_of_odd_rows(spark):
    rows = [(1, "x y " * 6), (1, "x y " * 6), (2, None), (3, ""), (4, " \t\n"), (None, "a a a a a a a"), (5, "é b " * 300_000), (6, "one two three")]
    docs = spark.createDataFrame([(i, t, "n", [1]) for i, t in rows], "doc_id long, text string, n_words string, runs array<int>")
    got = pr.find(docs).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    assert [tuple(x) for x in by_id[1]["runs"]] == [(0, 12, 2)] and by_id[1]["collapsed"] == "x y" and sum(r["doc_id"] == 1 for r in got) == 2
    assert [tuple(x) for x in by_id[None]["runs"]] == [(0, 7, 1)] and by_id[None]["collapsed"] == "a"
    assert all(by_id[i]["runs"] == [] and by_id[i]["collapsed"] == "" and by_id[i]["n_words"] == 0 for i in (2, 3, 4))
    assert by_id[5]["n_words"] == 300_000 and by_id[5]["collapsed"] == "é b"
    assert by_id[6]["collapsed"] == "one two three"
    assert pr.find(docs.where(F.lit(False))).count() == 0
