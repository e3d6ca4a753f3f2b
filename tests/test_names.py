"""Similarity joins of names against all pairs."""

import random

from pyspark.sql import functions as F

from pitwright.operators import ledger, names

WORDS = ["corp", "bank", "of", "america", "first", "national", "steel", "a", "b", "trust", "holding", "north", "western", "électro"]


def common(x, y):
    row = [0] * (len(y) + 1)
    for c in x:
        new = [0]
        for j, d in enumerate(y):
            new.append(max(new[-1], row[j + 1], row[j] + 1 if c == d else 0))
        row = new
    return row[-1]


def ratio(a, b):
    a, b = set(a.split()), set(b.split())
    s, x, y = " ".join(sorted(a & b)), " ".join(sorted(a - b)), " ".join(sorted(b - a))
    if s and (not x or not y):
        return 100.0
    gap = 1 if s else 0
    best = [100 * (1 - (len(x) + len(y) - 2 * common(x, y)) / (2 * len(s) + 2 * gap + len(x) + len(y)))]
    return max(best + [100 * (1 - (1 + len(z)) / (2 * len(s) + 1 + len(z))) for z in (x, y) if s])


def test_token_sets_against_all_pairs(spark):
    rnd = random.Random(4)
    letters = lambda: "".join(rnd.choice("abcde") for _ in range(rnd.randint(1, 9)))
    right = [(" ".join(rnd.choice(WORDS) if rnd.random() < 0.7 else letters() for _ in range(rnd.randint(1, 6))), k) for k in range(300)]
    left = []
    for name, _ in right[:150]:
        x = " ".join(rnd.sample(name.split(), len(name.split())))
        for _ in range(rnd.randint(0, 3)):
            k = rnd.randrange(len(x) + 1)
            x = rnd.choice([x[:k] + x[k + 1 :], x[:k] + rnd.choice("abk ") + x[k:], x[:k] + rnd.choice("xyz") + x[k + 1 :]])
        left.append((x,))
    left += [("B of A Corp",), ("",), ("  ",), (None,), ("a a a",)]
    right += [("A B Corp", 900), ("Corp of A B", 901), ("", 902), (None, 903), ("a", 904)]
    got = {r[0]: (r[1], round(r[2], 6)) for r in names.token_set_matches(spark.createDataFrame(left, "name string"), spark.createDataFrame(right, "name string, code int"), "name", "code").collect()}
    want = {}
    for (a,) in left:
        if a and a.split():
            score, code = min((-round(ratio(a, b), 6), k) for b, k in right if b and b.split())
            if -score >= 92:
                want[a] = (code, -score)
    assert got == want and got["B of A Corp"][1] == 100.0


def test_words_and_beginnings_that_all_names_have(spark):
    """3,000 names of one beginning and two common words: those with a letter left out find their own, and few pairs are laid out."""
    rnd = random.Random(6)
    right = [("trading company " + "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(14)) + " " + "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(14)), k) for k in range(3000)]
    left = [(n.replace("company", "compny"),) for n, _ in right[:300]]
    a, b = spark.createDataFrame(left, "name string"), spark.createDataFrame(right, "name string, code int")
    got = names.token_set_matches(a, b, "name", "code").collect()
    assert {r["name"]: r["code"] for r in got} == {n: k for k, (n,) in enumerate(left)}
    keyed = lambda df, x: names.with_grams(df.select(names.tokens(F.col("name")).alias("t"), F.col("name").alias(x)), "t", words=True).withColumn("__edits", F.lit(7))
    assert names.gram_pairs(keyed(a, "a"), keyed(b, "b"), "a", "b").count() < 300 * 3000 / 20


def test_edit_matches_without_blocks(spark):
    """Three edits and more, also in the first letters, against all pairs by a plain edit distance."""
    rnd = random.Random(8)
    right = [("a house with a rather long beginning that all have " + "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(5, 30))), k) for k in range(120)]
    left = []
    for n, _ in right[:60]:
        for _ in range(rnd.randint(0, 5)):
            k = rnd.choice([0, rnd.randrange(len(n))])
            n = rnd.choice([n[:k] + n[k + 1 :], n[:k] + "z" + n[k:], n[:k] + "y" + n[k + 1 :]])
        left.append((n,))
    got = {r["name"]: (r["code"], round(r["score"], 6)) for r in ledger.fuzzy_match(spark.createDataFrame(left, "name string"), spark.createDataFrame(right, "name string, code int"), "name", "code", block=0).collect()}

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
        return row[-1]

    for (w,) in left:
        score, code = min((-100 * (1 - edits(w, n) / max(len(w), len(n))), k) for n, k in right)
        assert got.get(w) == ((code, round(-score, 6)) if -score >= 92 else None), w
