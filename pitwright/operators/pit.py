"""Point-in-time tables: when something happened, when it became knowable, and joins that never look ahead."""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitwright.sources.files import dealt, written

#: Up to so many keys with many rows are sent to all tasks.
HOT_KEYS = 100_000


def pit_frame(df: DataFrame, event: Column, known: Column, source: str) -> DataFrame:
    """df with event_date, knowledge_date (not before the event; rows without one go) and _src."""
    out = df.withColumn("event_date", event.cast("date")).withColumn("knowledge_date", F.greatest(known.cast("date"), F.col("event_date")))
    return out.where(known.isNotNull()).withColumn("_src", F.lit(source))


@dataclass
class PitCatalog:
    """Tables by name, with the columns that tell their rows apart; only those with both dates are taken, and reads are as of a day."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    keys: dict[str, list[str]] = field(default_factory=dict)

    def register(self, name: str, df: DataFrame, keys: list[str] | None = None) -> None:
        if missing := {"event_date", "knowledge_date", *(keys or [])} - set(df.columns):
            raise KeyError(f"{name} lacks {sorted(missing)}")
        if len(set(df.columns)) < len(df.columns):
            raise ValueError(f"{name} has columns of the same name")
        self.tables[name], self.keys[name] = df, keys or []

    def as_of(self, name: str, day: str) -> DataFrame:
        return self.tables[name].where(F.col("knowledge_date") <= F.lit(day).cast("date"))

    def latest(self, name: str, day: str) -> DataFrame:
        """Of each key the row that was known last as of a day."""
        return latest(self.as_of(name, day), self.keys[name], F.desc("knowledge_date"), F.desc("event_date"))

    def report(self) -> DataFrame:
        """A row for each table: its keys, number of rows and of keys, and the days its rows became known."""
        parts = [
            df.agg(
                F.lit(n).alias("name"), F.lit(",".join(self.keys[n])).alias("keys"), F.count("*").alias("n_rows"),
                (F.countDistinct(F.struct(*self.keys[n])) if self.keys[n] else F.lit(None).cast("long")).alias("n_keys"), F.min("knowledge_date").alias("first_known"), F.max("knowledge_date").alias("last_known"),
            )
            for n, df in self.tables.items()
        ]
        return functools.reduce(DataFrame.unionAll, parts)


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def asof_join(left: DataFrame, right: DataFrame, by: str, left_time: str, right_time: str, columns: list[str], tie: list[str], tolerance_days: int | None = None, rows: int = 1_000_000) -> DataFrame:
    """left with the columns of the newest right row of its key at or before its time. All left rows stay.

    One shuffle by key: both sides are laid in one order of time, and the last right row is carried forward. Rows of the
    right without a key are of no use; those of the left get NULLs.

    Both sides are written once and lie in parts of counted rows; keys are counted there. Those with more than `rows` rows of both sides
    are laid in ranges of (key, time) of about so many rows, which may lie in different tasks, and the last right row of the ranges before is carried into each, from a table with one row
    for each key and range.
    """
    names = left.columns
    value = F.struct(F.col(right_time).alias("__t"), *columns)
    known = right.where(F.col(by).isNotNull())
    r = known.select(F.col(by).alias("__by"), F.col(right_time).alias("__at"), F.lit(0).alias("__side"), F.struct(*tie).alias("__tie"), value.alias("__v"), F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("__l"))
    tie_type, v_type = r.schema["__tie"].dataType, r.schema["__v"].dataType
    lhs = left.select(F.col(by).alias("__by"), F.col(left_time).alias("__at"), F.lit(1).alias("__side"), F.lit(None).cast(tie_type).alias("__tie"), F.lit(None).cast(v_type).alias("__v"), F.struct(*names).alias("__l"))
    both = written(r.unionByName(lhs))
    n = both.count()
    hot = written(both.where("__by is not null").groupBy("__by").agg(F.count("*").alias("__n")).where(F.col("__n") > rows))
    n_hot, in_hot = hot.agg(F.count("*"), F.coalesce(F.sum("__n"), F.lit(0))).first()
    # rows without a key never match: they needn't meet in one task
    apart = F.when(F.col("__by").isNull(), F.xxhash64("__l")).otherwise(0).alias("__apart")
    order = ["__at", "__side", "__tie"]
    carried = lambda *keys: F.last("__v", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    whole = lambda a: dealt(a.select("*", apart), n, "__by", "__apart").withColumn("__v", carried("__by", "__apart"))
    if not n_hot:
        out = whole(both).where("__side = 1").select("__at", "__v", "__l")
    else:
        few = F.broadcast(hot.select("__by")) if n_hot <= HOT_KEYS else hot.select("__by")
        cold = whole(both.join(few, "__by", "left_anti")).where("__side = 1").select("__at", "__v", "__l")
        spread = both.join(few, "__by", "left_semi").withColumn("__id", F.monotonically_increasing_id())
        placed = written(spread.repartitionByRange(-(-in_hot // rows), "__by", *order, "__id").drop("__id").withColumn("__range", F.spark_partition_id()))
        own = F.col("__side") == 0
        newest = placed.where(own).groupBy("__by", "__range").agg(F.max_by("__v", F.struct("__at", "__tie")).alias("__end"))
        ends = placed.select("__by", "__range").distinct().join(newest, ["__by", "__range"], "left")
        earlier = F.last("__end", ignorenulls=True).over(Window.partitionBy("__by").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
        before = ends.select("__by", "__range", earlier.alias("__before"))
        warm = dealt(placed, in_hot, "__by", "__range").withColumn("__v", carried("__by", "__range")).where("__side = 1").join(F.broadcast(before), ["__by", "__range"], "left")  # two rows for each range at most
        out = cold.unionByName(warm.select("__at", F.coalesce("__v", "__before").alias("__v"), "__l"))
    fresh = F.lit(True) if tolerance_days is None else F.datediff("__at", F.col("__v.__t")) <= tolerance_days
    return out.select("__l.*", *(F.when(fresh, F.col(f"__v.{c}")).alias(c) for c in columns))


def valid_interval_join(facts: DataFrame, mapping: DataFrame, key: str, day: str, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """Inner join on key where day lies in the closed interval; NULL is open.

    Intervals are dealt to the years of theirs that facts have, and rows meet by key and year, so the facts of one key are
    divided by year and don't meet intervals of other years."""
    d, names = F.col(day), [key, *(c for c in facts.columns if c != key), *(c for c in mapping.columns if c != key)]
    first, last = facts.agg(F.year(F.min(day)), F.year(F.max(day))).first()
    first, last = first or 0, last or 0
    low, high = F.greatest(F.coalesce(F.year(start), F.lit(first)), F.lit(first)), F.least(F.coalesce(F.year(end), F.lit(last)), F.lit(last))
    dealt = mapping.where(low <= high).withColumn("__year", F.explode(F.sequence(low, high)))
    met = facts.withColumn("__year", F.year(d)).join(dealt, [key, "__year"])
    return met.where((F.col(start).isNull() | (d >= F.col(start))) & (F.col(end).isNull() | (d <= F.col(end)))).select(*names)


def policy_calendar(windows: DataFrame, horizon: DataFrame) -> DataFrame:
    """The distinct windows of all packs, open ends closed at the horizon (one row, column month). windows: columns start and end."""
    closed = windows.distinct().crossJoin(F.broadcast(horizon.select(F.col("month").alias("__last"))))
    return closed.withColumn("end", F.coalesce("end", "__last")).drop("__last")


def mask_windows(months: DataFrame, windows: DataFrame, halo: int = 6) -> DataFrame:
    """month and masked: within halo months of the start of any window, or of the end of a closed one."""
    # each edge of a window is dealt to the calendar months of its halo
    around = lambda d: F.struct(F.add_months(d, -halo).alias("low"), F.add_months(d, halo).alias("high"))
    edges = windows.select(F.explode(F.array(around("start"), around("end"))).alias("x")).select("x.*").where("low is not null").distinct()
    dealt = edges.withColumn("__month", F.explode(F.sequence(F.trunc("low", "month"), F.trunc("high", "month"), F.expr("interval 1 month"))))
    hit = months.withColumn("__month", F.trunc("month", "month")).join(dealt, "__month").where(F.col("month").between(F.col("low"), F.col("high"))).select("month").distinct().withColumn("__hit", F.lit(1))
    return months.join(hit, "month", "left").select("month", F.coalesce("__hit", F.lit(0)).alias("masked"))
