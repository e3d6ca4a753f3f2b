"""Ranks, running sums and quantiles over all rows or within groups, without a window that holds a whole group.

What is ordered lies in ranges of (group, value); a range is one task's, a group may lie in many. Sums of the ranges before come
from a row for each range on the driver."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitwright.sources.files import dealt, written


def global_rank(df: DataFrame, value: str, out: str, *tie: Column, descending: bool = False, rows: int = 1_000_000) -> DataFrame:
    """df with out: 1, 2, ... in order of value (NULL last), then tie.

    The rows lie in ranges of about `rows` in that order, which divide equal values too if tie tells them apart; ranks within a range start
    where the ranges before it end, which takes a row for each range on the driver. Of ties without a tie breaker the order is arbitrary.
    """
    x = F.col(value).cast("double")
    order = [F.col("__x").asc_nulls_last(), *tie]
    n = max(1, -(-df.count() // rows))
    placed = written(df.withColumn("__x", -x if descending else x).repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id()))
    counts = {r[0]: r[1] for r in placed.groupBy("__range").count().collect()}
    before, start = [], 0
    for k in sorted(counts):
        before.append((k, start))
        start += counts[k]
    offsets = df.sparkSession.createDataFrame(before, "__range int, __before long")
    w = Window.partitionBy("__range").orderBy(*order)
    return placed.join(F.broadcast(offsets), "__range").withColumn(out, F.row_number().over(w) + F.col("__before")).drop("__x", "__range", "__before")


def running_sum(df: DataFrame, group: str, order: list[str], value: str, out: str, every: str, rows: int = 1_000_000) -> DataFrame:
    """df with out: the sum of value (a whole number) along the order within the group, up to and with the row; and with every: that of the
    whole group. group holds no NULL. Within a range rows lie by group, in parts of counted rows; sums of a group that goes on in
    other ranges are known from their ends."""
    n = df.count()
    placed = written(df.repartitionByRange(max(1, -(-n // rows)), group, *order).withColumn("__range", F.spark_partition_id()))
    of_kind = df.schema[group].dataType.simpleString()
    # summed by group first, as the least and greatest text are found by a sort
    sums = placed.groupBy("__range", group).agg(F.sum(value).alias("n")).groupBy("__range").agg(*(how(F.struct(F.col(group).alias("g"), "n")).alias(k) for k, how in (("low", F.min), ("high", F.max))))
    ends = sums.select("__range", *(F.col(f"{k}.{x}").alias(to) for k in ("low", "high") for x, to in (("g", k), ("n", f"of_{k}")))).collect()
    before, last, carried, whole = [], None, 0, Counter()
    for r in sorted(ends, key=lambda r: r["__range"]):
        carried = carried if r["low"] == last else 0
        before.append((r["__range"], r["low"], carried, r["high"]))
        last, carried = r["high"], (r["of_high"] or 0) + (carried if r["low"] == r["high"] else 0)
        whole.update({r["low"]: r["of_low"] or 0} | {r["high"]: r["of_high"] or 0})  # once where both are the same group
    offsets = df.sparkSession.createDataFrame([(*b, whole[b[1]], whole[b[3]]) for b in before], f"__range int, __low {of_kind}, __before long, __high {of_kind}, __low_all long, __high_all long")
    w = Window.partitionBy("__range", group).orderBy(*order)
    low, high = (F.col(group) == F.col(k) for k in ("__low", "__high"))
    upto = F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.when(low, F.col("__before")).otherwise(0)
    total = F.when(low, F.col("__low_all")).when(high, F.col("__high_all")).otherwise(F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return dealt(placed, n, "__range", group).join(F.broadcast(offsets), "__range").withColumns({out: upto, every: total}).drop("__range", *offsets.columns[1:])


def values_in_order(df: DataFrame, keys: list[str], x: str, rows: int = 1_000_000) -> DataFrame:
    """keys, x, __n (rows of the group that have it), __upto (with all smaller values) and __all, for each distinct value of each group."""
    counts = written(df.where(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count("*").alias("__n")))
    return running_sum(counts.withColumn("__g", F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})), "__g", [x], "__n", "__upto", "__all", rows)


def quantiles(df: DataFrame, keys: list[str], x: str, shares: dict[str, float], rows: int = 1_000_000) -> DataFrame:
    """keys and, for each name of shares, the exact quantile of x with linear interpolation. A group may hold any share of the rows: what
    is asked for are two places in its order, which are found among counts of its distinct values."""
    v = values_in_order(df, keys, x, rows)
    picked = []
    for k, q in enumerate(shares.values()):
        at = (F.col("__all") - 1) * F.lit(float(q))
        for side, place in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            picked.append(F.max(F.when((place >= F.col("__upto") - F.col("__n")) & (place < F.col("__upto")), F.col(x).cast("double"))).alias(f"__{side}{k}"))
        picked.append(F.max(at - F.floor(at)).alias(f"__part{k}"))
    found = v.groupBy(*keys, "__g").agg(*picked)
    return found.select(*keys, *((F.col(f"__lo{k}") + (F.col(f"__hi{k}") - F.col(f"__lo{k}")) * F.col(f"__part{k}")).alias(name) for k, name in enumerate(shares)))
