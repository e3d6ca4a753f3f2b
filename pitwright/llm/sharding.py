"""Minimax contiguous partition of atomic groups into shards, with DataFrame functions only.

Equal texts are one group, and groups are ordered by the digest of their text. The smallest capacity is searched for by
bisection: a capacity is feasible if greedy cutting (each shard takes groups as long as they fit) needs no more than the
given number of shards; there the groups are cut.

A greedy step asks the written table of running sums for "the last group that ends at or before x". The driver holds the
ends in at most BINS ranges, each with its least and greatest end: a step into a gap between ranges, or into a range of one
or two ends, is exact, any other lies between two bounds. Bisection with both bounds leaves an interval of capacities; the
ranges that its steps fall into are then split, in one job for all of them, until capacity and cuts are exact. Each round
narrows the ranges by a factor of hundreds, so a handful of jobs finish at any size.

Running sums are made without a window over everything: rows are dealt by ranges of the digest (and the id, so that a hot
group lies in many ranges), summed within each range, and raised by the sums of the ranges before it, of which there are
as many as shuffle partitions.

Defined results: a null text has size 1 and is a group with the other nulls; an empty text likewise, apart from nulls; an
empty table gives an empty result; a group that is larger than the even share makes its shard that large; fewer groups
than shards leave shards empty; repeated rows and equal ids get slots of their own; extra columns are passed over.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitwright.llm.common import cut

#: Ranges of ends that a job hands to the driver.
BINS = 4_096


def _dealt(df: DataFrame, order: list[str]) -> DataFrame:
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return cut(df.repartitionByRange(parts, *order).withColumn("__range", F.spark_partition_id()), "ranges")


def _running(dealt: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """dealt with, for each item of sums, a column named by its key: the sum of its value's column up to and with this row."""
    totals = dealt.groupBy("__range").agg(*(F.sum(c).alias(f"__{c}") for c in dict.fromkeys(sums.values()))).orderBy("__range").collect()
    before, start = [], dict.fromkeys(sums.values(), 0)
    for r in totals:
        before.append((r["__range"], *start.values()))
        start = {c: n + r[f"__{c}"] for c, n in start.items()}
    offsets = dealt.sparkSession.createDataFrame(before, "__range int, " + ", ".join(f"__{c} long" for c in start))  # a row for each range
    w = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = dealt.join(F.broadcast(offsets), "__range")
    return out.select(*(c for c in dealt.columns if c != "__range"), *((F.sum(c).over(w) + F.col(f"__{c}")).alias(k) for k, c in sums.items()))


@dataclass
class Ends:
    """What is known of the ends: ranges in order, each with its bin, its least and greatest end and how many it holds."""

    bin: np.ndarray
    least: np.ndarray
    most: np.ndarray
    n: np.ndarray

    def up_to(self, x: int) -> tuple[int, int]:
        """(an end at or before x, a bound of the last such end); 0 where there is none."""
        k = int(np.searchsorted(self.least, x, side="right")) - 1
        if k < 0:
            return 0, 0
        if self.most[k] <= x:
            return int(self.most[k]), int(self.most[k])
        return int(self.least[k]), int(self.least[k]) if self.n[k] <= 2 else x

    def path(self, capacity: int, shards: int, bound: int) -> list[int]:
        """Greedy cuts with the ends that are known (bound 0), or with their bounds (1)."""
        at, out = 0, []
        for _ in range(shards):
            at = max(at, self.up_to(at + capacity)[bound])
            out.append(at)
        return out

    def least_capacity(self, low: int, high: int, total: int, shards: int, bound: int) -> int:
        """The least capacity from low to high whose path reaches the total; high is taken to."""
        while low < high:
            mid = (low + high) // 2
            if self.path(mid, shards, bound)[-1] >= total:
                high = mid
            else:
                low = mid + 1
        return low

    def open_ranges(self, low: int, high: int, shards: int) -> np.ndarray:
        """Whether the steps of paths with capacities from low to high can fall within a range."""
        starts, ends = [0, *self.path(low, shards, 0)[:-1]], [0, *self.path(high, shards, 1)[:-1]]
        hit = np.zeros(len(self.n), dtype=bool)
        for a, b in zip(starts, ends, strict=True):
            hit |= (self.most > a + low) & (self.least <= b + high)
        return hit & (self.n > 2)


def _ranges(ends: DataFrame, total: int, bins: int, known: Ends | None = None, split: np.ndarray | None = None) -> Ends:
    """All ends in `bins` ranges of equal width, or those that are marked in `split` cut anew, the others as known."""
    of = F.floor(F.col("end") / F.lit(-(-total // bins))).cast("long")
    if known is None:
        rows = ends.groupBy(of.alias("bin")).agg(F.min("end").alias("least"), F.max("end").alias("most"), F.count("*").alias("n")).collect()
        old = np.zeros((0, 4), dtype=np.int64)
    else:
        marked = np.flatnonzero(split)
        pieces = max(2, bins // len(marked))
        parts = [(int(known.bin[k]), int(known.least[k]), int(known.most[k]), -(-(int(known.most[k]) - int(known.least[k]) + 1) // pieces)) for k in marked]
        windows = ends.sparkSession.createDataFrame(parts, "bin long, low long, high long, width long")  # at most as many rows as ranges
        near = ends.where(F.col("end").between(min(p[1] for p in parts), max(p[2] for p in parts))).select("end", of.alias("bin"))
        placed = near.join(F.broadcast(windows), "bin").where("end between low and high")
        rows = placed.groupBy("bin", "low", F.floor((F.col("end") - F.col("low")) / F.col("width")).alias("piece")).agg(F.min("end").alias("least"), F.max("end").alias("most"), F.count("*").alias("n")).select("bin", "least", "most", "n").collect()
        old = np.stack([known.bin, known.least, known.most, known.n], axis=1)[~split]
    table = np.concatenate([np.array([tuple(r) for r in rows], dtype=np.int64).reshape(-1, 4), old])
    return Ends(*np.ascontiguousarray(table[np.argsort(table[:, 1], kind="stable")].T))


def minimax_cuts(ends: DataFrame, total: int, largest: int, shards: int, bins: int = BINS) -> tuple[int, list[int]]:
    """(capacity, running sums at which shards end). ends: column end, the running sums of groups; largest: the largest group."""
    low = max(largest, -(-total // shards))
    high = min(total, low + largest)  # feasible: cutting greedily leaves less than the largest group unused in each shard
    known = _ranges(ends, total, bins)
    while True:
        low, high = known.least_capacity(low, high, total, shards, 1), known.least_capacity(low, high, total, shards, 0)
        split = known.open_ranges(low, high, shards)
        if not split.any():
            return high, known.path(high, shards, 0)
        known = _ranges(ends, total, bins, known, split)


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, shard and slot for every row of docs."""
    text = F.col(text_col)
    size = F.when(text.isNull(), F.lit(1)).otherwise(F.octet_length(text) + 1).cast("long")
    crc = F.crc32(F.coalesce(text, F.lit("")).cast("binary"))
    key = F.when(text.isNull(), F.lit("")).otherwise(F.sha2(text, 256))
    rows = docs.select(F.col(id_col).alias("id"), size.alias("size"), crc.alias("crc"), key.alias("key"))
    dealt = _dealt(rows.withColumn("one", F.lit(1).cast("long")), ["key", "id"])
    groups = _dealt(dealt.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")), ["key"])
    ends = cut(_running(groups, ["key"], {"end": "bytes", "last": "rows"}).select("key", "bytes", "end", "last"), "ends")
    ranked = _running(dealt, ["key", "id"], {"rank": "one"})
    total, largest = ends.agg(F.coalesce(F.max("end"), F.lit(0)), F.coalesce(F.max("bytes"), F.lit(1))).first()
    _, cuts = minimax_cuts(ends, total, largest, shards) if total else (0, [])
    last = {r["end"]: r for r in ends.where(F.col("end").isin(sorted(set(cuts) - {0}))).collect()}  # one for each shard at most
    number, first, done = F.lit(0), F.lit(0).cast("long"), 0
    for k, e in enumerate(cuts[:-1]):
        if e not in last:
            continue
        after = F.col("key") > last[e]["key"]
        number, first, done = F.when(after, F.lit(k + 1)).otherwise(number), F.when(after, F.lit(last[e]["last"])).otherwise(first), e
    return ranked.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), number.cast("int").alias("shard"), (F.col("rank") - 1 - first).alias("slot"))
