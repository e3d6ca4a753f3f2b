"""Draws by a keyed hash, against hashlib."""

import datetime as dt
import hashlib
import random

import pytest

from pitwright.operators import draws
from pitwright.plans import portfolio


def begin(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def test_rows_whose_hash_begins_below_a_bound(spark, monkeypatch):
    """Tails of any length, empty, of more bytes than characters and longer than a block; tables that are cut at all places."""
    monkeypatch.setattr(draws, "TOGETHER", 7)
    rnd = random.Random(1)
    rows = [(k, rnd.choice(["", "|x", "|é", "|1995-01-31|", "|" + "y" * 40]) + str(rnd.choice([k, k**7])), rnd.choice([0, 2**30, 2**32 - 1, 2**32])) for k in range(60)]
    rows += [(100 + m, "z" * m, 2**31) for m in range(49, 53)] + [(200, "z" * 53, 0)]  # 55 bytes are one block; of longer ones all pass
    df = spark.createDataFrame(rows, "k int, tail string, bound long")
    got = sorted(map(tuple, draws.below(df, 12, "s", "tail", "bound", len(rows)).collect()))
    assert got == sorted((d, k) for d in range(12) for k, tail, bound in rows if len(f"s|{d}{tail}".encode()) > 55 or begin(f"s|{d}{tail}") <= bound)
    assert draws.below(df.limit(0), 12, "s", "tail", "bound", 0).collect() == []


@pytest.mark.parametrize("wide", [False, True])
def test_placebo_draws_are_the_least_hashes(spark, monkeypatch, wide):
    """A large month, one with fewer rows than are drawn, missing codes and returns; rows aren't multiplied by draws before they are hashed."""
    kept, plain = [], portfolio.written
    monkeypatch.setattr(portfolio, "written", lambda df: kept.append(df) or plain(df))
    rnd = random.Random(2)
    code = lambda k: None if k == 5 else f"{'long name of a house ' * 3 * wide}{k}"
    rows = [(dt.date(2020, 1 + m, 28), code(k), rnd.random()) for m, n in enumerate((400, 3, 60)) for k in range(n)]
    got = {r["draw"]: r["mean_ret"] for r in portfolio.placebo(spark.createDataFrame(rows, "month date, code string, fwd_ret double"), 11, 4).collect()}
    for d in range(11):
        drawn = []
        for m in {r[0] for r in rows}:
            own = sorted((hashlib.md5("|".join(["s", str(d), str(m), *([c] if c is not None else [])]).encode()).hexdigest(), x) for month, c, x in rows if month == m)
            drawn += [x for _, x in own[:4]]
        assert got[d] == pytest.approx(sum(drawn) / len(drawn))
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in kept if {"draw", "fwd_ret"} <= set(df.columns)]
    assert len(plans) == 1 and "explode" not in plans[0]
