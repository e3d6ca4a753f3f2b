"""The trie of conversations by their first turns, with totals of every subtree, by depth-band rollup.

A node is a distinct sequence of the first d turns (role, text) of some conversation. Nodes are told apart by depth and a
128-bit key: the exclusive or of hashes of (place, role, text) of its turns. So keys are running totals, which are made in
ranges of (conversation, place) with what the ranges before have carried over; no task holds a conversation, however long.

Totals of subtrees go up in bands of BAND depths. A node sends its values to its ancestors within its band alone, which are
read from the conversation it is the first of. The nodes between two bands, with the totals of the band below them, are then
a trie of their own, a BAND-th as deep, which is rolled up in the same way; its completed totals are sent once through the
band above. So rounds are the logarithm of the depth, and a node is never laid out more than BAND times (BAND + 1 with its
conversation's line). All sums are pre-aggregated, so an ancestor of a third of all nodes is no hot key.

The hash over the conversations that end at a node reads their ids in order, as any hash does: ranges of (node, id) join
their ids into texts of CHUNK ids, and a node's texts are hashed one after the other, so what meets in a task is bytes of
ids, as they stream, and not rows.

Defined results: null turns come first, equal turns are ordered by hashes of role and text, so repeated rows are turns of
their own; null roles and texts count as empty; rows without a conversation are left out; a table without rows has no nodes;
extra columns are passed over; conversations without turns end at the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from operator import add, xor

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitwright.llm.common import cut

BAND, CHUNK = 16, 4096
NODE = ["depth", "a1", "a2"]


def running(df: DataFrame, key: str, order: list[Column], out: dict[str, tuple[str, str]]) -> DataFrame:
    """df with running totals along the order within each key. out: name -> ("sum" or "bit_xor", column), up to and with the row.

    Rows lie in ranges of key and order; equal rows are divided too. A range hands on what its last key has, a row for each."""
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = df.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(parts, F.col(key), *order, F.col("__tie"))
    placed = cut(dealt.drop("__tie").withColumn("__range", F.spark_partition_id()), "ranges")
    spans = {r[0]: r for r in placed.groupBy("__range").agg(F.min(key), F.max(key)).collect()}
    if not spans:
        return placed.select(*df.columns, *(F.lit(0).cast("long").alias(n) for n in out))
    edges = F.broadcast(df.sparkSession.createDataFrame([tuple(r) for r in spans.values()], f"__range int, __low {df.schema[key].dataType.simpleString()}, __high {df.schema[key].dataType.simpleString()}"))
    sides = [F.expr(f"{how}(case when `{key}` = {side} then `{c}` end)").alias(f"{n}{side}") for n, (how, c) in out.items() for side in ("__low", "__high")]
    of = {r["__range"]: r for r in placed.join(edges, "__range").groupBy("__range").agg(*sides).collect()}
    offsets, last, state = [], None, {}
    for k in sorted(spans):
        _, low, high = spans[k]
        state = state if low == last else dict.fromkeys(out, 0)
        offsets.append((k, low, *state.values()))
        both = {"sum": add, "bit_xor": xor}
        state = {n: both[how](state[n] if low == high else 0, of[k][f"{n}__high"]) for n, (how, _) in out.items()}
        last = high
    before = F.broadcast(df.sparkSession.createDataFrame(offsets, f"__range int, __low {df.schema[key].dataType.simpleString()}, " + ", ".join(f"`__{n}` long" for n in out)))
    w = Window.partitionBy("__range", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = {n: F.when(F.col(key) == F.col("__low"), F.col(f"__{n}")).otherwise(F.lit(0).cast("long")) for n in out}
    total = {n: F.expr(f"{how}(`{c}`)").over(w) for n, (how, c) in out.items()}
    return placed.join(before, "__range").select(*df.columns, *((total[n] + carried[n] if how == "sum" else total[n].bitwiseXOR(carried[n])).alias(n) for n, (how, _) in out.items()))


def ordered(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, place (1, 2, ...), t1 and t2 (hashes of role and text) and bytes of every turn."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    hashes = [F.xxhash64(F.lit(k), role, text).alias(f"t{k}") for k in (1, 2)]
    rows = turns.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), *hashes, F.octet_length(text).cast("long").alias("bytes"), F.lit(1).cast("long").alias("one"))
    placed = running(rows, "conv", [F.col("turn").asc_nulls_first(), F.col("t1").asc(), F.col("t2").asc()], {"place": ("sum", "one")})
    return cut(placed.select("conv", "place", "t1", "t2", "bytes"), "ordered")


def _lines(prefixes: DataFrame, unit: int) -> DataFrame:
    """conv, band and line: the nodes of conv at the depths of a band (every unit-th), from its top to its bottom."""
    at = prefixes.where(F.col("depth") % unit == 0).select("conv", F.expr(f"depth div {unit}").alias("at"), "a1", "a2")
    bands = F.when(F.col("at") % BAND == 0, F.array(F.expr(f"(at - 1) div {BAND}"), F.expr(f"at div {BAND}"))).otherwise(F.array(F.expr(f"(at - 1) div {BAND}")))
    lines = at.select("conv", "at", "a1", "a2", F.explode(bands).alias("band")).groupBy("conv", "band").agg(F.sort_array(F.collect_list(F.struct("at", "a1", "a2"))).alias("line"))
    root = F.expr("array(named_struct('at', 0L, 'a1', 0L, 'a2', 0L))")
    return lines.withColumn("line", F.when(F.col("band") == 0, F.concat(root, "line")).otherwise(F.col("line")))


def _up(nodes: DataFrame, lines: DataFrame, values: list[str], kids: bool = False) -> DataFrame:
    """For each node the sums of values over the nodes below it in its band. nodes: conv, at, values."""
    placed = nodes.where("at > 0").withColumn("band", F.expr(f"(at - 1) div {BAND}")).join(lines, ["conv", "band"])
    above = placed.select("at", *values, F.explode(F.filter("line", lambda x: x["at"] < F.col("at"))).alias("to"))
    sums = [F.sum(v).alias(v) for v in values] + ([F.count_if(F.col("to.at") == F.col("at") - 1).alias("n_children")] if kids else [])
    return above.groupBy(F.col("to.at").alias("at"), F.col("to.a1").alias("a1"), F.col("to.a2").alias("a2")).agg(*sums)


def _below(nodes: DataFrame, prefixes: DataFrame, values: list[str], deepest: int, unit: int = 1) -> DataFrame:
    """at, a1, a2 and the sums of values over all nodes below, where there are any. nodes: conv, at, a1, a2, values, `deepest` units deep."""
    lines = cut(_lines(prefixes, unit), "lines") if deepest > BAND else _lines(prefixes, unit)
    band = _up(nodes, lines, values, kids=unit == 1)
    if deepest <= BAND:
        return band
    band = cut(band, "band")
    # the nodes between bands, with the totals of the bands that they are tops of
    tops = nodes.where(F.col("at") % BAND == 0).select("conv", "at", "a1", "a2").join(band, ["at", "a1", "a2"]).select("conv", F.expr(f"at div {BAND}").alias("at"), "a1", "a2", *values)
    tops = cut(tops, "tops")
    far = _below(tops, prefixes, values, deepest // BAND, unit * BAND)
    total = [(F.col(v) + F.coalesce(F.col(f"far_{v}"), F.lit(0))).alias(v) for v in values]
    whole = tops.join(far.select("at", "a1", "a2", *(F.col(v).alias(f"far_{v}") for v in values)), ["at", "a1", "a2"], "left").select("conv", (F.col("at") * BAND).alias("at"), *total)
    sent = _up(whole, lines, values).select("at", "a1", "a2", *(F.col(v).alias(f"far_{v}") for v in values))
    rest = [c for c in band.columns if c not in ("at", "a1", "a2", *values)]
    return band.join(sent, ["at", "a1", "a2"], "left").select("at", "a1", "a2", *total, *rest)


def _ends(ends: DataFrame) -> DataFrame:
    """SHA-256 over the ids, ascending and joined by commas, of the conversations that end at each node. ends: depth, a1, a2, conv."""
    texts = "depth long, a1 long, a2 long, first long, ids binary"

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, first, ids = None, None, []
        for batch in batches:
            rows = []
            for *key, conv in zip(*(batch.column(c).to_pylist() for c in (*NODE, "conv")), strict=True):
                if key != node or len(ids) == CHUNK:
                    if ids:
                        rows.append((*node, first, ",".join(ids).encode()))
                    node, first, ids = key, conv, []
                ids.append(str(conv))
            yield _batch(rows, [*NODE, "first", "ids"], [pa.int64()] * 4 + [pa.binary()])
        if ids:
            yield _batch([(*node, first, ",".join(ids).encode())], [*NODE, "first", "ids"], [pa.int64()] * 4 + [pa.binary()])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        for batch in batches:
            rows = []
            for *key, text in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids")), strict=True):
                if key == node:
                    sha.update(b",")
                else:
                    if node:
                        rows.append((*node, sha.hexdigest()))
                    node, sha = key, hashlib.sha256()
                sha.update(text)
            yield _batch(rows, [*NODE, "ends_sha256"], [pa.int64()] * 3 + [pa.string()])
        if node:
            yield _batch([(*node, sha.hexdigest())], [*NODE, "ends_sha256"], [pa.int64()] * 3 + [pa.string()])

    parts = max(1, int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = [*NODE, "conv"]
    chunks = ends.select(*(F.col(c).cast("long") for c in order)).repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(joined, texts)
    return chunks.repartition(parts, *NODE).sortWithinPartitions(*NODE, "first").mapInArrow(hashed, "depth long, a1 long, a2 long, ends_sha256 string")


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of each node.

    turns: conv, place (1, 2, ... without gaps), t1, t2, bytes and last (whether no turn follows), as of ordered();
    convs: conv and n_turns of every conversation."""
    turns = turns.select("conv", F.col("place").alias("depth"), "bytes", "last", *(F.xxhash64(F.lit(k), "place", "t1", "t2").alias(f"p{k}") for k in (1, 2)))
    keyed = running(turns, "conv", [F.col("depth").asc()], {"a1": ("bit_xor", "p1"), "a2": ("bit_xor", "p2")})
    prefixes = cut(keyed, "prefixes")  # the key without the last turn is the parent's
    parent = [F.min(F.col(f"a{k}").bitwiseXOR(F.col(f"p{k}"))).alias(f"b{k}") for k in (1, 2)]
    found = prefixes.groupBy(*NODE).agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.count_if("last").alias("n_ends"), F.max("bytes").alias("bytes"), *parent)
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.count_if(F.col("n_turns") == 0).alias("n_ends")).where("n_convs > 0").select(*(zero.alias(c) for c in NODE), "conv", "n_convs", "n_ends", *(zero.alias(c) for c in ("bytes", "b1", "b2")))
    leaf = (F.col("n_ends") == F.col("n_convs")).cast("long")
    nodes = cut(found.unionByName(root).select(*NODE, "conv", "n_convs", "b1", "b2", leaf.alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens")), "nodes")
    values = ["n_leaves", "saved_tokens"]
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    below = _below(nodes.select("conv", F.col("depth").alias("at"), "a1", "a2", *values), prefixes, values, deepest).withColumnRenamed("at", "depth")
    below = below.select(*NODE, "n_children", *(F.col(v).alias(f"far_{v}") for v in values))
    ends = _ends(prefixes.where("last").select(*NODE, "conv").unionByName(convs.where("n_turns = 0").select(*(zero.alias(c) for c in NODE), "conv")))
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a1").alias("b1"), F.col("a2").alias("b2"), F.col("conv").alias("parent_conv_id"))
    none = hashlib.sha256().hexdigest()
    return (
        nodes.join(below, NODE, "left")
        .join(ends, NODE, "left")
        .join(above.where("depth > 0"), ["depth", "b1", "b2"], "left")
        .select(
            F.col("conv").alias("conv_id"),
            "depth",
            "parent_conv_id",
            "n_convs",
            F.coalesce("n_children", zero).alias("n_children"),
            *((F.col(v) + F.coalesce(F.col(f"far_{v}"), zero)).alias(v) for v in values),
            F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
        )
    )


def branched(turns: DataFrame, group: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """(turns, convs) for trie(): each conversation c begins with the first h turns of c - c % group, h = crc32(c) % heads, and goes
    on with its own turns after its first h. turns: as of ordered()."""
    counts = turns.groupBy("conv").agg(F.count("*").alias("n"))
    own = counts.select("conv", "n", (F.crc32(F.col("conv").cast("string").cast("binary")) % heads).alias("h"), (F.col("conv") - F.col("conv") % group).alias("from"))
    sizes = counts.select(F.col("conv").alias("from"), F.col("n").alias("n_from"))
    lead = F.least("h", F.coalesce("n_from", F.lit(0)))
    convs = own.join(sizes, "from", "left").withColumn("lead", lead).withColumn("n_turns", F.col("lead") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    convs = cut(convs, "convs")
    first = turns.where(F.col("place") < heads).withColumnRenamed("conv", "from")
    columns = ["conv", "place", "t1", "t2", "bytes", "last"]
    led = convs.join(first, "from").where("place <= lead").withColumn("last", F.expr("place = n_turns")).select(*columns)
    follow = turns.join(convs.select("conv", "h", "lead", "n"), "conv").where("place > h").withColumn("last", F.expr("place = n")).withColumn("place", F.expr("place - h + lead")).select(*columns)
    return led.unionByName(follow), convs.select("conv", "n_turns")
