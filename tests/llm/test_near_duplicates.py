"""Near-duplicates of the pipeline: what the keys in front of the fingerprints bring together."""

import itertools
import random

import numpy as np
import pytest

from pitwright.llm import simhash
from tests.llm.test_operators import docs_of, prose


def test_unrelated_texts_are_no_cluster(spark, monkeypatch):
    """Short texts without a shingle in common, whose fingerprints agree by chance, are not held against each other."""
    clustered = []
    plain = simhash.verified
    monkeypatch.setattr(simhash, "verified", lambda roots, *a: clustered.append(roots.count()) or plain(roots, *a))
    items = [(k, " ".join(f"w{k}x{i}" for i in range(8 + k % 5))) for k in range(1500)]
    items += [(5000 + 100 * k + j, prose(k, 60) + f" {word}") for k in range(3) for j, word in enumerate(("one", "two"))]
    kept = {r["doc_id"] for r in simhash.one_of_each(docs_of(spark, items)).collect()}
    assert kept == {*range(1500), 5000, 5100, 5200}
    assert clustered == [6]


@pytest.mark.parametrize("small, block", [(64, 64_000), (2, 64_000), (2, 3)])
def test_groups_of_any_size_lose_no_link(spark, monkeypatch, small, block):
    """Chains of near copies, a family of near copies of one text and copies of a row, in groups compared together, alone and in blocks."""
    monkeypatch.setattr(simhash, "SMALL", small)
    rnd, items = random.Random(2), []
    for k in range(6):
        words = prose(300 + k, 120).split()
        for v in range(14):
            items.append((100 * k + v, " ".join(words)))
            words[rnd.randrange(len(words))] = f"new{k}v{v}"  # a chain: each differs from the one before in a word
    base = prose(400, 150).split()
    items += [(2000 + v, " ".join([*base[:v], f"other{v}", *base[v + 1 :]])) for v in range(0, 120, 4)]
    items += [(3000, ""), (3001, None), (3002, "word"), (3003, "Word")]
    sets = {i: set(simhash.shingle_hashes(t, 5).tolist()) for i, t in items}
    label = {i: i for i in sets}
    linked = [(i, j) for i, j in itertools.combinations(sets, 2) if simhash.cosine(np.array(sorted(sets[i])), np.array(sorted(sets[j]))) >= 0.8]
    for _ in range(20):
        for i, j in linked:
            label[i] = label[j] = min(label[i], label[j])
    got = sorted(r["doc_id"] for r in simhash.one_of_each(docs_of(spark, items), block=block).collect())
    assert got == sorted(set(label.values()))


def test_sets_at_the_similarity_have_a_key_in_common():
    rng, n = np.random.default_rng(1), simhash.keys_for(0.8)
    shares = []
    for _ in range(400):
        all_ = np.unique(rng.integers(0, 2**64, size=260, dtype=np.uint64))[:250]
        a, b = all_, all_[rng.permutation(len(all_))[:160]]  # one within the other, at 0.64 of its size: the least share of their union
        assert simhash.cosine(a, b) == pytest.approx(0.8)
        shares.append((simhash.least_keys(a, n) == simhash.least_keys(np.sort(b), n)).mean())
    assert min(shares) > 0 and np.mean(shares) == pytest.approx(0.64**simhash.WIDTH, abs=0.02)
    # as spread as keys that have nothing to do with each other would be
    assert np.std(shares) == pytest.approx((0.64**3 * (1 - 0.64**3) / n) ** 0.5, rel=0.15)


def test_majority_of_many_rows():
    h = np.random.default_rng(3).integers(0, 2**64, size=(1000, 3), dtype=np.uint64)
    for n in (0, 1, 2, 255, 256, 1000):
        bits = (h[:n, :, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
        want = ((2 * bits.sum(axis=0) > n).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        assert (simhash.majority(h[:n]) == want).all()
