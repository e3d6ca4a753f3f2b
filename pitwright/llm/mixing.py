"""Mixing sources to target weights by balanced sampling with the cube method.

Sources get weights in the order of their names and share all words by them; a target stops at a number of times its source's
size, and what is above is shared out again. A document of a source with target r times its size is taken floor(r) times, and
once more with probability r - floor(r). Which ones these are is drawn by the cube method, balanced on two totals of each
source: its words and its documents. Flight: of three documents whose probabilities lie between 0 and 1, the probabilities
move along the direction that leaves both totals as they are (the null space of the constraints, their cross product; of two
documents of equal size, one against the other), up or down at random so that each keeps its expectation, until one is 0
or 1; then the next document comes in. At most two documents of a source are left. Landing: their four outcomes are tried,
and the one nearest to the source's words, then to its documents, is taken.

Flights run in blocks of about ROWS rows that hold rows of all sources, dealt by a hash of the row, so a hot source lies in
all blocks; rows that are equal in id, source and size are counted first and fly as one (between equal rows a flight always
ends with all but one decided). The at most two left of each source and block meet in groups of FAN blocks, and so on; the
last group lands. So rounds are the logarithm of the number of blocks, a group holds at most 2 * FAN rows, and what is taken
depends on the rows and the seed alone, neither on their order nor on partitions or retries.

Defined results: a null text has size 0, as an empty one; a null source is a source of its own, the last; null ids and
repeated rows are documents of their own; a source without words has target 0 and nothing is taken; an empty table gives no
rows; extra columns are passed over.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitwright.llm.common import BROADCAST_BYTES, cut
from pitwright.llm.sharding import _dealt, _running

WEIGHTS, MOST = (5, 2, 1), 3
ROWS, FAN = 1024, 512
WORD = r"[^ \t\n\x0B\f\r]++"
#: Probabilities nearer to 0 or 1 are taken for 0 or 1.
NEAR = 1e-12


def targets(rows: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size and target of each source. rows: source and size (long) of documents."""
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("last", F.col("source").isNull()).withColumn("one", F.lit(1).cast("long"))
    order = ["last", "source"]
    place = (F.col("place") - 1) % len(weights) + 1
    sources = cut(_running(_dealt(sums, order), order, {"place": "one"}).select("source", "source_size", F.element_at(F.lit(list(weights)), place.cast("int")).cast("long").alias("weight")), "sources")
    total, share = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    level, stopped, full = (total or 0) / (share or 1), -1, F.lit(False)
    above, left, of = 0, total or 0, share or 1
    while stopped != above:  # each round stops further sources, so the level that the others reach rises
        full, stopped = F.col("source_size") * most < F.col("weight") * level, above
        above, left, of = sources.agg(F.count_if(full), F.lit(total or 0).cast("long") - F.sum(F.when(full, F.col("source_size") * most).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("weight")))).first()
        left, of = left or 0, of or 1
        level = left / of
    reached = (F.lit(left).cast("long") * F.col("weight")).cast("double") / F.lit(of)
    return sources.select("source", "source_size", F.when(full, (F.col("source_size") * most).cast("double")).otherwise(reached).alias("target"))


def fly(sizes: list[int], p: list[float], rng: random.Random) -> list[float]:
    """p after a flight: sum(p) and sum(size * p) are kept, and at most two values, of different sizes, lie between 0 and 1."""
    p, held = list(p), []
    for k, x in enumerate(p):
        if not NEAR < x < 1 - NEAR:
            p[k] = float(round(x))
            continue
        held.append(k)
        while len(held) > 1:
            pair = next(((i, j) for at, i in enumerate(held) for j in held[at + 1 :] if sizes[i] == sizes[j]), None)
            if pair:
                way = [(pair[0], 1), (pair[1], -1)]
            elif len(held) == 3:
                i, j, m = held
                way = [(i, sizes[m] - sizes[j]), (j, sizes[i] - sizes[m]), (m, sizes[j] - sizes[i])]
            else:
                break
            up = min((1 - p[i]) / u if u > 0 else p[i] / -u for i, u in way)
            down = min(p[i] / u if u > 0 else (1 - p[i]) / -u for i, u in way)
            step = up if rng.random() * (up + down) < down else -down
            for i, u in way:
                p[i] = min(1.0, max(0.0, p[i] + step * u))
            for i, _ in way:
                if not NEAR < p[i] < 1 - NEAR:
                    p[i] = float(round(p[i]))
                    held.remove(i)
    return p


def land(sizes: list[int], p: list[float]) -> list[float]:
    """p after a flight, with the values between 0 and 1 set to 0 or 1 so that the sum of sizes, then the count, stays nearest."""
    open_ = [k for k, x in enumerate(p) if 0 < x < 1]
    words, count = sum(sizes[k] * p[k] for k in open_), sum(p[k] for k in open_)
    tried = ([(bits >> at) & 1 for at in range(len(open_))] for bits in range(1 << len(open_)))
    best = min(tried, key=lambda x: (abs(sum(sizes[k] for k, on in zip(open_, x, strict=True) if on) - words), abs(sum(x) - count), x))
    p = list(p)
    for k, on in zip(open_, best, strict=True):
        p[k] = float(on)
    return p


def _flight(units: DataFrame, group: list[str], seed: int, last: bool) -> DataFrame:
    """units (source, size, k1, k2, p, ...) with p after a flight of each source in each group."""

    def flown(table: pa.Table) -> pa.Table:
        table = table.sort_by([("source", "ascending"), ("k1", "ascending"), ("k2", "ascending")])
        sources, sizes, p, keys = (table.column(c).to_pylist() for c in ("source", "size", "p", "k1"))
        out: list[float] = []
        while len(out) < len(p):
            a = b = len(out)
            while b < len(p) and sources[b] == sources[a]:
                b += 1
            done = fly(sizes[a:b], p[a:b], random.Random(f"{seed} {keys[a]} {b - a}"))
            out += land(sizes[a:b], done) if last else done
        return table.set_column(table.column_names.index("p"), "p", pa.array(out, pa.float64()))

    return units.groupBy(*group).applyInArrow(flown, units.schema)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: int = 42) -> DataFrame:
    """For every row its id, source, size, source_size, target, copies and taken (size times copies)."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"))
    rows = cut(rows.groupBy("id", "source", "size").agg(F.count("*").alias("n")), "sized")
    aims = targets(rows.select("source", (F.col("size") * F.col("n")).alias("size")), weights, most)
    held = aims.agg(F.sum(F.coalesce(F.octet_length("source"), F.lit(0)) + 64)).first()[0] or 0
    aims = (F.broadcast(aims) if held <= BROADCAST_BYTES else aims).withColumnRenamed("source", "aim")
    per = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    key = [F.xxhash64(F.lit(k), F.coalesce(F.col("id").cast("string"), F.lit("-")), F.coalesce("source", F.lit("-")), F.col("size"), F.col("source").isNull()) for k in (1, 2)]
    blocks = max(1, -(-rows.count() // ROWS))
    units = rows.join(aims, F.col("source").eqNullSafe(F.col("aim")), "left").drop("aim").withColumn("per", per).withColumn("base", F.floor("per")).withColumn("more", F.col("n") * (F.col("per") - F.col("base")))
    units = units.withColumn("sure", F.floor("more")).withColumn("p", F.col("more") - F.floor("more")).withColumn("k1", key[0]).withColumn("k2", key[1])
    units = units.select("id", "source", "size", "n", "source_size", "target", "base", "sure", "p", "k1", "k2", F.pmod("k1", F.lit(blocks)).alias("block"))
    out, left = None, cut(_flight(units, ["block"], seed, False), "flown")
    while True:
        decided = left.where("p = 0 or p = 1").drop("block")
        out = decided if out is None else out.unionAll(decided)
        if blocks == 0:
            break
        last = blocks <= FAN
        left = left.where("p > 0 and p < 1").withColumn("block", F.expr(f"block div {FAN}"))
        left = cut(_flight(left, ["source", "block"], seed, last), "flown")
        blocks = 0 if last else -(-blocks // FAN)
    copies = F.col("base") + F.when(F.col("nth") <= F.col("sure") + F.col("p"), 1).otherwise(0)
    each = out.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).withColumn("copies", copies.cast("long"))
    return each.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))
