"""SimHash near-duplicates: vantage-point trees for few bits, keys of least hashes in front of a similarity.

Fingerprints are SimHashes of word shingles. For links by few bits, a tree of vantage points, grown on the driver from a bounded sample, cuts
the space by distance: at a node with vantage v and radius r, points with d(v, x) <= r are inside, the others outside,
and by the triangle inequality a linked pair can only cross the sphere if both its points lie within the link distance
of it. So each split makes three shards: inside, outside, and the boundary, where only inside-outside pairs are
compared. All fingerprints are routed down the tree; its shards are compared exactly, in blocks of bounded size. Each
block hands on a spanning forest of its links, and connected components over the distinct fingerprints join them: no
link is lost, and no group of copies is ever expanded into pairs.

Two rules of linking, each a conjunction of metrics:
- bits: 64-bit fingerprints that differ in at most `within` bits;
- similarity s: the cosine of the sets of shingles, which is what the bits of a SimHash estimate (the shared shingles over
  the geometric mean of both sizes), is at least s. 512-bit fingerprints within a radius that a pair at s passes but for six
  standard deviations, and set sizes of a ratio of at least s squared, only name candidates; see `verified`. (In 256 bits,
  unrelated texts pass by chance about once in a million pairs, so that all of a large corpus would be one cluster.) So wide a
  radius holds most of a random neighbourhood, where no Hamming sphere can prune: only texts with a key in common are
  compared. A key is WIDTH of the least values that hashes take on the set; sets at s share at least s squared of their union,
  so with as many keys as `keys_for` says a pair at s has one in common but for a chance of MISSED. Which texts have a key in
  common is found from ids alone, so work and disk follow the number of texts, not its square; only texts that share much are
  compared in squares, and those near the first of a group are linked through it.

Defined results: a null or empty text has fingerprint zero and links like any other; repeated rows and copies share
a fingerprint; an empty table gives an empty result; null ids take part, but are never a component's id unless all
its ids are null. Extra columns are passed over (one_of_each hands them on).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitwright.llm.common import LOWER, UPPER, cut, positional, row_key
from pitwright.llm.graph import components

#: Points of the sample that grows the tree, and blocks of a shard that one task compares.
SAMPLE, BLOCK = 20_000, 64_000
#: Shards are of about LEAF points for up to LEAF_UNTIL points, and grow as the number of points to the power LEAF_POWER: each
#: split saves a third of the comparisons, but puts six tenths of the points into one more shard, so fewer levels than
#: the logarithm of the number keep the routed rows in proportion.
LEAF, LEAF_UNTIL, LEAF_POWER = 12_000, 50_000, 0.4
#: A split must shrink the comparisons to this share, or the node stays a shard.
WORTH = 0.9
MAX_DEPTH = 24
#: Least values in a key, and the chance that a pair at the similarity has no key in common.
WIDTH, MISSED = 3, 1e-7
#: Groups of so many texts with a common key are compared many to a task, of about TOGETHER rows; larger ones each in blocks.
SMALL, TOGETHER = 64, 50_000
#: Candidates may differ in this many standard deviations more bits, of the first 128 and of all 512, than a pair at the similarity.
FIRST_ROOM, ROOM = 5, 6
#: Rows of a cluster of candidates that one task compares: those apart from its hub, and all.
APART, ALL = 256, 1_024
BROADCAST_NODES = 200_000

_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
_MIX = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)
#: Columns of a wide fingerprint.
WORDS = ["fp", *(f"e{k + 1}" for k in range(len(_MIX)))]


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of space-joined words, of the whole sequence if it is shorter, none without words."""
    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(line, 42)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    n = len(words) - shingle + 1
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    return np.fromiter((digest(line[s:e], 42) for s, e in zip(starts, ends[shingle - 1 :].tolist(), strict=True)), dtype=np.uint64, count=n)


def majority(hashes: np.ndarray) -> np.ndarray:
    """For hashes of shape (n, words): the words whose bits are set in over half of the rows."""
    n, words = hashes.shape
    counts = np.zeros(64 * words, dtype=np.int64)
    for at in range(0, n, 255):  # as many ones fit a byte
        bits = np.unpackbits(np.ascontiguousarray(hashes[at : at + 255].astype("<u8")).view(np.uint8), axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > n, bitorder="little").view("<u8").astype(np.uint64)


def fingerprint_of(text: str | None, shingle: int) -> int:
    return int(majority(shingle_hashes(text, shingle)[:, None])[0])


def fingerprint(text: Column, shingle: int = 3) -> Column:
    """SimHash as a long: bit i is set if it is in over half of the shingles' XXH64 (seed 42)."""

    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint_of(t, shingle) for t in texts], dtype=np.uint64).view(np.int64))

    return simhash(text)


def keys_for(s: float) -> int:
    """So many keys of WIDTH least values have sets of cosine s in common at least one of, but for MISSED."""
    return 1 if s >= 1 else math.ceil(math.log(MISSED) / math.log1p(-(s ** (2 * WIDTH))))


def least_keys(hashes: np.ndarray, n: int) -> np.ndarray:
    """n keys of 32 bits, each made of the least values that WIDTH hashes take on a set that isn't empty. That texts which share
    nothing may have equal keys does no harm: what a key brings together is compared."""
    odd = (np.arange(1, n * WIDTH + 1, dtype=np.uint64) * _MIX[2] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    values, least = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32), np.empty(n * WIDTH, dtype=np.uint32)
    step = max(1, (1 << 14) // len(values))  # tables that stay in the cache
    for at in range(0, n * WIDTH, step):
        x = values[None, :] * odd[at : at + step, None]
        x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        least[at : at + step] = (x ^ (x >> np.uint32(12))).min(axis=1)
    least = least.astype(np.uint64).reshape(n, WIDTH)
    key = np.zeros(n, dtype=np.uint64)
    for k in range(WIDTH):
        key = (key ^ least[:, k]) * _MIX[0]
        key ^= key >> np.uint64(29)
    return (key >> np.uint64(32)).astype(np.uint32).view(np.int32)


def wide_fingerprint(text: Column, shingle: int = 5, keys: int = 1) -> Column:
    """struct(WORDS, size, keys): a 512-bit SimHash of the set of shingles in eight longs, the set's size (1 at least), and its keys
    (none of a set that is empty)."""

    @F.pandas_udf(", ".join(f"{c} long" for c in [*WORDS, "size"]) + ", keys array<int>")
    def simhash(texts: pd.Series) -> pd.DataFrame:
        out, sizes, found = np.zeros((len(texts), len(WORDS)), dtype=np.uint64), np.ones(len(texts), dtype=np.int64), []
        for k, t in enumerate(texts):
            h = np.unique(shingle_hashes(t, shingle))
            mixed = (h ^ (h >> np.uint64(31)))[:, None] * _MIX[None, :]
            out[k] = majority(np.concatenate([h[:, None], mixed ^ (mixed >> np.uint64(29))], axis=1))
            sizes[k] = max(1, len(h))
            found.append(least_keys(h, keys) if len(h) else np.zeros(0, dtype=np.int32))
        return pd.DataFrame(out.view(np.int64), columns=WORDS).assign(size=sizes, keys=pd.Series(found, dtype=object))

    return simhash(text)


@dataclass(frozen=True)
class Rule:
    """When two points link (for similarity: may link). within: bits of the first `words` longs; total, ratio: bits of 512 and ratio
    of sizes, or None; cosine: the similarity that a link is verified at."""

    within: int
    total: int | None = None
    ratio: float | None = None
    cosine: float | None = None

    @property
    def words(self) -> int:
        return 1 if self.total is None else 2

    @staticmethod
    def bits(within: int) -> Rule:
        return Rule(within)

    @staticmethod
    def similarity(s: float) -> Rule:
        p = math.acos(min(1.0, s)) / math.pi  # of a bit to differ
        return Rule(*(int(n * p + room * math.sqrt(n * p * (1 - p))) for n, room in ((128, FIRST_ROOM), (64 * len(WORDS), ROOM))), s * s, s)

    @property
    def reach(self) -> float:
        """In the logarithm of sizes, with room for rounding."""
        return -math.log(self.ratio) + 1e-9 if self.ratio else math.inf

    def near(self, wide: np.ndarray, log_size: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the pairs of places i, j may link."""
        ok = np.bitwise_count(wide[i, : self.words] ^ wide[j, : self.words]).sum(axis=1) <= self.within
        if self.total is not None:
            at = np.flatnonzero(ok)
            i, j = i[at], j[at]
            ok[at] = (np.bitwise_count(wide[i] ^ wide[j]).sum(axis=1) <= self.total) & (np.abs(log_size[i] - log_size[j]) <= self.reach)
        return ok


@dataclass
class Points:
    fp: np.ndarray
    log_size: np.ndarray  # passed over: the tree is for bits

    def __len__(self) -> int:
        return len(self.fp)

    def __getitem__(self, at) -> Points:
        return Points(self.fp[at], self.log_size[at])

    def distances(self, vantage: int) -> np.ndarray:
        return np.bitwise_count(self.fp ^ np.uint64(vantage)).astype(np.int16)


@dataclass
class Node:
    """A split of the tree, or a shard if `shard` is set. cross: only pairs of side 0 and side 1 are compared here."""

    cross: bool
    shard: int = -1
    vantage: int = 0
    radius: float = 0
    reach: float = 0
    children: tuple = ()  # inside, outside, then one or two boundaries

    def deal(self, d: np.ndarray, side: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(mask, side) for each child, from the distances to the vantage point."""
        inside = d <= self.radius
        near = inside & (d > self.radius - self.reach)
        far = ~inside & (d <= self.radius + self.reach)
        out = [(inside, side), (~inside, side)]
        if self.cross:
            return [*out, ((near & (side == 0)) | (far & (side == 1)), side), ((far & (side == 0)) | (near & (side == 1)), side)]
        return [*out, (near | far, far.astype(np.int8))]


def _work(side: np.ndarray, cross: bool) -> float:
    ones = float(side.sum())
    return (len(side) - ones) * ones if cross else len(side) ** 2 / 2


def grow(sample: Points, total: int, rule: Rule, leaf: int = LEAF) -> Node:
    """The tree for `total` points of which `sample` is a part. Deterministic."""
    scale, count = total / max(1, len(sample)), [0]
    leaf = leaf * max(1.0, total / LEAF_UNTIL) ** LEAF_POWER

    def split(pts: Points, side: np.ndarray, cross: bool, depth: int) -> Node:
        if len(pts) * scale > leaf and depth < MAX_DEPTH and len(pts) >= 32:
            best, least = None, WORTH * _work(side, cross)
            for k in range(8):
                vantage = pts.fp[(k * 2654435761) % len(pts)]
                d = pts.distances(vantage)
                node = Node(cross, -1, vantage, float(np.median(d)), rule.within)
                parts = node.deal(d, side)
                cost = sum(_work(s[m], cross or k > 1) for k, (m, s) in enumerate(parts))
                if cost <= least:
                    best, least = (node, parts), cost
            if best:
                node, parts = best
                node.children = tuple(split(pts[m], s[m], cross or k > 1, depth + 1) for k, (m, s) in enumerate(parts))
                return node
        count[0] += 1
        return Node(cross, count[0] - 1)

    return split(sample, np.zeros(len(sample), dtype=np.int8), False, 0)


def route(root: Node, pts: Points) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in pts, shard, side) for each shard that a point has to be in; side is -1 where all pairs are compared."""
    places, shards, sides = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int32)], [np.zeros(0, dtype=np.int8)]
    stack = [(root, np.arange(len(pts)), np.zeros(len(pts), dtype=np.int8))]
    while stack:
        node, at, side = stack.pop()
        if not len(at):
            continue
        if node.shard >= 0:
            places.append(at)
            shards.append(np.full(len(at), node.shard, dtype=np.int32))
            sides.append(side if node.cross else np.full(len(at), -1, dtype=np.int8))
            continue
        for child, (mask, s) in zip(node.children, node.deal(pts[at].distances(node.vantage), side), strict=True):
            stack.append((child, at[mask], s[mask]))
    return np.concatenate(places), np.concatenate(shards), np.concatenate(sides)


def merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (each the least place of its class) after classes of i and j are one."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        parent = np.arange(len(label))
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
        label = parent[label]


def forest(wide: np.ndarray, log_size: np.ndarray, part: np.ndarray, same: bool, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """(place, its class's least place) of the classes that the links make: within all places, or between part 0 and 1."""
    rows = np.arange(len(wide)) if same else np.flatnonzero(part == 0)
    cols = rows if same else np.flatnonzero(part == 1)
    label = np.arange(len(wide))
    step = max(1, (1 << 20) // max(1, len(cols)))
    right = [np.ascontiguousarray(wide[cols, k]) for k in range(rule.words)]
    for at in range(0, len(rows), step):
        own = rows[at : at + step]
        bits = sum(np.bitwise_count(wide[own, k][:, None] ^ right[k][None, :]) for k in range(rule.words))
        i, j = np.nonzero(bits <= rule.within)
        i, j = own[i], cols[j]
        ahead = label[i] != label[j]
        i, j = i[ahead], j[ahead]
        if rule.total is not None:
            ok = rule.near(wide, log_size, i, j)
            i, j = i[ok], j[ok]
        label = merge(label, i, j)
    member = np.flatnonzero(label != np.arange(len(label)))
    return member, label[member]


def links(points: DataFrame, rule: Rule, sample: int = SAMPLE, leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """(a, b): a spanning forest of the links of each compared block. points: distinct, with columns node and fp."""
    total = points.count()
    picked = np.array([r["fp"] for r in points.select("fp").orderBy(F.xxhash64("node"), "node").limit(sample).collect()], dtype=np.int64).view(np.uint64)
    tree = grow(Points(picked, np.zeros(len(picked))), total, rule, leaf)

    def routed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            places, shards, sides = route(tree, Points(b["fp"].to_numpy(np.int64).view(np.uint64), np.zeros(len(b))))
            for s in range(0, len(places), 1 << 17):
                some = slice(s, s + (1 << 17))
                yield b.iloc[places[some]].assign(shard=shards[some], side=sides[some])

    columns = ["node", "fp"]
    placed = cut(points.select(*columns).mapInPandas(routed, ", ".join(f"{c} long" for c in columns) + ", shard int, side int"), "shards")
    sizes = placed.groupBy("shard").agg(F.ceil(F.count("*") / block).cast("int").alias("nb"))  # as many rows as the tree has shards, which the sample bounds
    own, other = F.col("block"), F.col("other")
    cells = (
        placed.join(F.broadcast(sizes), "shard")
        .withColumn("block", F.pmod(F.xxhash64("node", F.lit(7)), F.col("nb")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))  # 0 for nearly all shards
        .withColumn("i", F.when(F.col("side") == -1, F.least(own, other)).when(F.col("side") == 0, own).otherwise(other))
        .withColumn("j", F.when(F.col("side") == -1, F.greatest(own, other)).when(F.col("side") == 0, other).otherwise(own))
        .withColumn("part", F.when(F.col("side") == -1, (own != F.col("i")).cast("int")).otherwise(F.col("side")))
        .withColumn("cross", F.col("side") >= 0)
    )

    def compare(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        same = not key[1] and key[2] == key[3]
        i, j = forest(np.ascontiguousarray(b[["fp"]].to_numpy(np.int64)).view(np.uint64), np.zeros(len(b)), b["part"].to_numpy(), same, rule)
        node = b["node"].to_numpy(np.int64)
        return pd.DataFrame({"a": node[i], "b": node[j]}, dtype=np.int64)

    return cells.select(*columns, "shard", "cross", "i", "j", "part").groupBy("shard", "cross", "i", "j").applyInPandas(compare, "a long, b long").distinct()


def _wide(b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints and logarithms of sizes."""
    return np.ascontiguousarray(b[WORDS].to_numpy(np.int64)).view(np.uint64), np.log(np.maximum(1, b["size"].to_numpy(np.int64)))


def _edges(node: np.ndarray, i: np.ndarray, j: np.ndarray) -> pd.DataFrame:
    out = pd.DataFrame({"a": node[i], "b": node[j]}, dtype=np.int64)
    return out[out["a"] != out["b"]]


def candidates(own: DataFrame, points: DataFrame, rule: Rule, block: int = BLOCK) -> DataFrame:
    """(a, b): pairs of nodes with a key in common that may link, as many as join each class of a compared block. own: node, keys, of
    equal nodes one row or more; points: distinct, with columns node, WORDS and size."""
    keyed = own.dropDuplicates(["node"]).select("node", F.posexplode("keys").alias("place", "key"))
    w = Window.partitionBy("place", "key")
    shared = keyed.withColumn("n", F.count("*").over(w)).where("n > 1").groupBy("place", "key").agg(F.array_sort(F.collect_list("node")).alias("nodes"))
    # the same texts have many keys in common
    groups = cut(shared.select("nodes").distinct().select(F.xxhash64("nodes").alias("of"), F.size("nodes").alias("n"), "nodes"), "groups")
    rows = lambda on: groups.where(on).select("of", "n", F.explode("nodes").alias("node")).join(points, "node")
    n_small = groups.where(F.col("n") <= SMALL).agg(F.sum("n")).first()[0] or 0

    def compare_small(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("of", kind="stable")
        wide, log_size = _wide(b)
        of, (node, at) = b["of"].to_numpy(np.int64), np.unique(b["node"].to_numpy(np.int64), return_inverse=True)
        label = np.arange(len(node))
        for d in range(1, SMALL):
            i = np.flatnonzero(of[d:] == of[:-d])
            if not len(i):
                break
            i = i[rule.near(wide, log_size, i, i + d)]
            label = merge(label, at[i], at[i + d])
        member = np.flatnonzero(label != np.arange(len(label)))
        return _edges(node, member, label[member])

    def compare_large(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        (wide, log_size), node, part = _wide(b), b["node"].to_numpy(np.int64), b["part"].to_numpy()
        if key[1] != key[2]:
            return _edges(node, *forest(wide, log_size, part, False, rule))
        # what is near the first one is linked through it; the others are laid beside all
        every = np.arange(len(node))
        near = rule.near(wide, log_size, np.zeros(len(node), dtype=np.int64), every)
        both = np.concatenate([np.flatnonzero(~near), every])
        i, j = forest(wide[both], log_size[both], np.repeat([0, 1], [len(both) - len(node), len(node)]), False, rule)
        return pd.concat([_edges(node, np.flatnonzero(near), np.zeros(near.sum(), dtype=np.int64)), _edges(node, both[i], both[j])])

    parts = F.pmod("of", F.lit(max(1, -(-n_small // TOGETHER))))
    small = rows(F.col("n") <= SMALL).groupBy(parts.alias("part")).applyInPandas(compare_small, "a long, b long")
    own_block = F.pmod(F.xxhash64("node", F.lit(7)), F.ceil(F.col("n") / block)).cast("int")
    cells = (
        rows(F.col("n") > SMALL)
        .withColumn("own", own_block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n") / block) - 1).cast("int"))))  # 0 for nearly all groups
        .select("of", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("part"), "node", *WORDS, "size")
    )
    return small.unionAll(cells.groupBy("of", "i", "j").applyInPandas(compare_large, "a long, b long")).distinct()


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    """Of two arrays without repeats, as sets; 1 for two empty ones."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return len(np.intersect1d(a, b, assume_unique=True)) / math.sqrt(len(a) * len(b))


def shingle_set(text: Column, shingle: int) -> Column:
    @F.pandas_udf("array<long>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(shingle_hashes(t, shingle)).view(np.int64) for t in texts], dtype=object)

    return of(text)


def linked_apart(words: np.ndarray, sets: list[np.ndarray], part: np.ndarray, hub: np.ndarray, rule: Rule) -> list[tuple[int, int]]:
    """Places (i, j) of a spanning forest of the true links of part 0 to part 1; places with `hub` are linked already."""
    label = np.arange(len(words))
    if hub.any():
        label[hub] = np.flatnonzero(hub)[0]
    log_size = np.log(np.maximum(1, np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))))
    others, out = np.flatnonzero(part == 1), []
    for i in np.flatnonzero(part == 0).tolist():
        bits = np.bitwise_count(words[others] ^ words[i]).sum(axis=1)
        near = np.flatnonzero((bits <= rule.total) & (np.abs(log_size[others] - log_size[i]) <= rule.reach))
        for j in others[near[np.argsort(bits[near], kind="stable")]].tolist():
            if label[i] != label[j] and cosine(sets[i], sets[j]) >= rule.cosine:
                label[label == label[j]] = label[i]
                out.append((i, j))
    return out


def verified(roots: DataFrame, points: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """(a, b): links of nodes whose sets of shingles have a cosine of rule.cosine or more, as many as join each
    component. roots: (node, root) of the clusters that the candidates make; sets: (node, sh) of their nodes.

    Each node is compared with its cluster's hub, the root. Those that link to it need no comparison among each other; the
    others are compared with the whole cluster, in blocks, but for pairs that aren't candidates or are joined already.
    """
    floor = F.lit(rule.cosine)

    @F.pandas_udf("double")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([cosine(np.asarray(x, dtype=np.int64), np.asarray(y, dtype=np.int64)) for x, y in zip(a, b, strict=True)], dtype=float)

    members = cut(roots.join(points.select("node", *WORDS), "node").join(sets, "node"), "members")
    hubs = cut(members.where("node = root").select(F.col("root").alias("of"), F.col("sh").alias("hub_sh")), "hubs")
    judged = cut(members.join(hubs, F.col("root") == F.col("of")).select(*members.columns, (alike("sh", "hub_sh") >= floor).alias("hub")), "judged")
    star = judged.where("hub and node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    sizes = judged.groupBy("root").agg(F.sum((~F.col("hub")).cast("int")).alias("apart"), F.count("*").alias("n")).where("apart > 0")
    sizes = cut(sizes.select(F.col("root").alias("of"), F.ceil(F.col("apart") / APART).cast("int").alias("ni"), F.ceil(F.col("n") / ALL).cast("int").alias("nj")), "apart")
    rows = judged.join(sizes, F.col("root") == F.col("of"))
    own = lambda n: F.pmod(F.xxhash64("node", F.lit(11)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["root", "node", *WORDS, "sh", "hub"]
    cells = rows.where("not hub").select(*columns, own("ni").alias("i"), every("nj").alias("j"), F.lit(0).alias("part"))
    cells = cells.unionAll(rows.select(*columns, every("ni").alias("i"), own("nj").alias("j"), F.lit(1).alias("part")))

    def compare(b: pd.DataFrame) -> pd.DataFrame:
        # a node that is in both parts is linked to itself by a similarity of 1, which joins its two places
        words = np.ascontiguousarray(b[WORDS].to_numpy(np.int64)).view(np.uint64)
        pairs = linked_apart(words, [np.asarray(x, dtype=np.int64) for x in b["sh"]], b["part"].to_numpy(), b["hub"].to_numpy(bool), rule)
        node = b["node"].to_numpy(np.int64)
        return pd.DataFrame([(node[i], node[j]) for i, j in pairs if node[i] != node[j]], columns=["a", "b"], dtype=np.int64)

    return star.unionAll(cells.groupBy("root", "i", "j").applyInPandas(compare, "a long, b long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, within: int = 3, **sizes) -> DataFrame:
    """(id, fp long, component_id): one row for each row of docs; component_id is the smallest id reachable over links."""
    own = cut(docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col), shingle).alias("fp")), "fingerprints")
    mins = cut(own.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    roots = cut(components(links(mins.select(F.col("fp").alias("node"), "fp"), Rule.bits(within), **sizes), "a", "b"), "roots")
    named = mins.join(roots, mins["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    best = cut(named.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    of = cut(named.select("fp", "root").join(best, "root").select(F.col("fp").alias("of"), "component_id"), "by-fingerprint")
    return own.join(of, own["fp"] == of["of"]).select(F.col("id").alias(id_col), "fp", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, **sizes) -> DataFrame:
    """The rows of docs without near-duplicates (cosine of the sets of shingles): of each component the row with
    the smallest id stays (among equal ids the one with the smaller hash over all columns; of repeated rows, one)."""
    columns = docs.columns
    docs, at = positional(docs)
    id_col, text_col = at[id_col], at[text_col]
    k1, k2 = row_key(docs)
    wide = wide_fingerprint(F.col(text_col), shingle, keys_for(similarity)).alias("w")
    own = cut(docs.select(F.col(id_col).alias("id"), k1, k2, wide).select("id", "__k1", "__k2", "w.*").withColumn("node", F.xxhash64(*WORDS, "size")), "fingerprints")
    mins = cut(own.groupBy("node", *WORDS, "size").agg(F.min(F.struct(F.col("id").isNull().alias("n"), "id", "__k1", "__k2")).alias("least")), "distinct")
    rule = Rule.similarity(similarity)
    clusters = cut(components(candidates(own.select("node", "keys"), mins.drop("least"), rule, **sizes), "a", "b"), "clusters")
    named = cut(clusters.join(mins, "node").select("node", F.col("least.__k1").alias("w1"), F.col("least.__k2").alias("w2")), "representatives")
    few = F.broadcast(named) if named.count() <= BROADCAST_NODES else named
    texts = docs.select(k1, k2, F.col(text_col).alias("__text")).join(few, (F.col("__k1") == F.col("w1")) & (F.col("__k2") == F.col("w2"))).select("node", "__text").dropDuplicates(["node"])
    roots = cut(components(verified(clusters, mins, texts.select("node", shingle_set(F.col("__text"), shingle).alias("sh")), rule), "a", "b"), "roots")
    best = cut(mins.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("least").alias("least")).select(F.col("least.__k1").alias("w1"), F.col("least.__k2").alias("w2")), "kept")
    kept = docs.select("*", k1, k2).join(best, (F.col("__k1") == F.col("w1")) & (F.col("__k2") == F.col("w2"))).drop("w1", "w2")
    if own.groupBy("__k1", "__k2").count().where("count > 1").isEmpty():
        return kept.drop("__k1", "__k2").toDF(*columns)
    return kept.dropDuplicates(["__k1", "__k2"]).drop("__k1", "__k2").toDF(*columns)
