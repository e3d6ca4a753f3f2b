"""Checks of tables and plans as counts of violations, so that they run where the data lies; a sound table gives zeros."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F


def _counts(df: DataFrame, **rules: Column) -> DataFrame:
    """(rule, violations) of one pass over df."""
    wide = df.agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in rules.items()))
    return wide.select(F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), F.col(k).alias("violations")) for k in rules))).alias("x")).select("x.*")


def unique_columns(df: DataFrame) -> DataFrame:
    """Q11: df itself; an error if two of its columns have one name."""
    if twice := sorted({c for c in df.columns if df.columns.count(c) > 1}):
        raise ValueError(f"columns of the same name: {twice}")
    return df


def pit_violations(df: DataFrame, as_of: Column) -> DataFrame:
    """Q1: rows that weren't known yet as of a day, were known before they happened, or have no day on which they became known."""
    known = F.col("knowledge_date")
    return _counts(df, unknown_yet=known > as_of, before_event=known < F.col("event_date"), undated=known.isNull())


def universe_violations(members: DataFrame, securities: DataFrame, months: DataFrame) -> DataFrame:
    """Q2: members before their listing, after their delisting, and securities that should be members and aren't. members: month, code;
    months: a short list."""
    a = members.withColumn("__in", F.lit(True)).join(securities.select("code", "listing_date", "delisting_date").crossJoin(F.broadcast(months.select("month"))), ["code", "month"], "right")
    m, listed, left = F.col("month"), F.col("listing_date"), F.col("delisting_date")
    there, due = F.col("__in").isNotNull(), (listed <= m) & (left.isNull() | (left > m))
    return _counts(a, not_listed=there & (listed > m), gone=there & (left <= m), missing=~there & due)


def mapping_violations(joined: DataFrame, day: str, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """Q3: rows of a join that lie outside of the interval in which their mapping is valid."""
    return _counts(joined, too_early=F.col(day) < F.col(start), too_late=F.col(day) > F.col(end))


def cell_violations(df: DataFrame, z: str, rank: str, cell: str, within: float = 0.15, least: int = 8) -> DataFrame:
    """Q4: cells whose mean z isn't near 0, ranks outside of (0, 1], and values in cells that are too small."""
    n = df.groupBy(cell).agg(F.avg(z).alias("__mean"), F.count("*").alias("__n"), F.count(z).alias("__z"), F.count_if((F.col(rank) <= 0) | (F.col(rank) > 1)).alias("__bad"))
    wide = n.agg(F.count_if(F.abs("__mean") > within).alias("mean"), F.coalesce(F.sum("__bad"), F.lit(0)).alias("rank"), F.count_if((F.col("__n") < least) & (F.col("__z") > 0)).alias("small"))
    return wide.select(F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), F.col(k).alias("violations")) for k in ("mean", "rank", "small")))).alias("x")).select("x.*")


def veto_violations(df: DataFrame, rules: list[str], product: str = "VETO") -> DataFrame:
    """Q5: vetoes that are neither 0 nor 1, and products that aren't those of their rules."""
    values = [F.col(r) for r in rules]
    odd = functools.reduce(lambda a, b: a | b, (v.isNull() | ~v.isin(0, 1) for v in values))
    return _counts(df, not_binary=odd, not_product=F.col(product) != functools.reduce(lambda a, b: a * b, values))


def order_violations(df: DataFrame, step, keys: list[str], column: str, parts: int = 7, digits: int = 9) -> DataFrame:
    """Q6: rows for which a step gives another value once its input is dealt and ordered anew. Values are equal if they lie within half
    a unit of the last of so many digits: sums in another order differ in their last bits, which rounding both would now and then show."""
    a, b = (step(x).select(*keys, column) for x in (df, df.repartition(parts, F.xxhash64(*keys)).sortWithinPartitions(F.desc(keys[0]))))
    near = F.abs(F.col(column) - F.col("__b")) <= 0.5 * 10.0**-digits
    return _counts(a.join(b.withColumnRenamed(column, "__b"), keys), differs=~(F.col(column).eqNullSafe(F.col("__b")) | F.coalesce(near, F.lit(False))))


def weight_violations(df: DataFrame, keys: list[str], w: str, cap: Column) -> DataFrame:
    """Q7: weights below 0 or over their cap, and groups that weigh more than 1."""
    total = F.sum(w).over(Window.partitionBy(*keys))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(w)) == 1
    return _counts(df.withColumns({"__sum": total, "__first": first}), negative=F.col(w) < 0, over_cap=F.col(w) > cap + 1e-9, over_one=F.col("__first") & (F.col("__sum") > 1 + 1e-9))


def rank_violations(df: DataFrame, group: str, signal: str, rank: str) -> DataFrame:
    """Q9: rows whose signal is above that of the row before (in order of rank) but whose rank isn't, or the other way round."""
    w = Window.partitionBy(group).orderBy(rank, signal)
    a = df.where(F.col(signal).isNotNull() & F.col(rank).isNotNull()).withColumns({"__s": F.lag(signal).over(w), "__r": F.lag(rank).over(w)})
    return _counts(a, inverted=(F.col(signal) < F.col("__s")) & (F.col(rank) > F.col("__r")), split_tie=(F.col(signal) == F.col("__s")) & (F.col(rank) != F.col("__r")))


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """Q10: df, and what will be known of it once it is used: rows, and rows without the days of a point-in-time table."""
    seen = Observation(name)
    dates = [c for c in ("event_date", "knowledge_date") if c in df.columns]
    return df.observe(seen, F.count(F.lit(1)).alias("n_rows"), *(F.count_if(F.col(c).isNull()).alias(f"no_{c}") for c in dates)), seen


def bounded_days(df: DataFrame, day: str, first: str, horizon: str, ahead: int = 400) -> tuple[DataFrame, DataFrame]:
    """(rows whose day is from `first` to `ahead` days after the horizon, one row with how many there were and how many went)."""
    ok = F.coalesce(F.col(day).between(F.lit(first).cast("date"), F.date_add(F.lit(horizon).cast("date"), ahead)), F.lit(False))
    return df.where(ok), df.agg(F.count("*").alias("n"), F.count_if(~ok).alias("dropped"))


def fired_products(df: DataFrame, products: list[str], above: float = 1.0) -> DataFrame:
    """(product, n, mean, fired, share): values that are there, their mean, and those above `above`, as a share of all rows."""
    wide = df.agg(F.count("*").alias("rows"), *(e for c in products for e in (F.count(c).alias(f"n_{c}"), F.avg(c).alias(f"m_{c}"), F.count_if(F.coalesce(F.col(c) > above, F.lit(False))).alias(f"f_{c}"))))
    parts = (F.struct(F.lit(c).alias("product"), F.col(f"n_{c}").alias("n"), F.col(f"m_{c}").alias("mean"), F.col(f"f_{c}").alias("fired"), (F.col(f"f_{c}") / F.greatest("rows", F.lit(1))).alias("share")) for c in products)
    return wide.select(F.explode(F.array(*parts)).alias("x")).select("x.*")


def state_mix(df: DataFrame, state: str = "D_state") -> DataFrame:
    """(state, n, share): how many rows are in each state, and their share of all rows."""
    counts = df.groupBy(F.col(state).alias("state")).agg(F.count("*").alias("n"))  # a row for each state
    return counts.crossJoin(F.broadcast(df.agg(F.count("*").alias("__all")))).select("state", "n", (F.col("n") / F.greatest("__all", F.lit(1))).alias("share"))


def merge_violations(merged: DataFrame, again: DataFrame, key: str) -> DataFrame:
    """Q8: keys of a merge that merging again loses, adds or changes, and keys that stand in it more than once."""
    columns = [c for c in merged.columns if c != key]
    hashed = lambda df, name: df.groupBy(key).agg(F.count("*").alias(f"{name}_n"), F.min(F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("\1")) for c in columns))).alias(name))
    both = hashed(merged, "a").join(hashed(again, "b"), key, "full")
    a, b = F.col("a"), F.col("b")
    return _counts(both, lost=b.isNull(), added=a.isNull(), changed=a.isNotNull() & b.isNotNull() & (a != b), twice=F.greatest("a_n", "b_n") > 1)


def axis_coverage(df: DataFrame, axes: list[str], ranks: list[str]) -> DataFrame:
    """(axis, coverage, upper): the share of rows that have an axis, and that rank at a half or above."""
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    wide = df.agg(*(e for a, r in zip(axes, ranks, strict=True) for e in (share(F.col(a).isNotNull()).alias(f"c_{a}"), share(F.col(r) >= 0.5).alias(f"u_{a}"))))
    return wide.select(F.explode(F.array(*(F.struct(F.lit(a).alias("axis"), F.col(f"c_{a}").alias("coverage"), F.col(f"u_{a}").alias("upper")) for a in axes))).alias("x")).select("x.*")
