"""Which securities existed on a day, without survivorship: delisted ones stay until they left."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitwright.operators import pit


def month_grid(spark, first: str, last: str) -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("interval 1 month"))).alias("d")).select(F.last_day("d").alias("month"))


def members(months: DataFrame, securities: DataFrame, seasoned: str | None = None) -> DataFrame:
    """(month, code) listed on or before the month's end and not delisted by then; securities: code, listing_date, delisting_date, of
    which an unknown one doesn't count against the security, unless both are.

    A range join by equality: a security is dealt to the years of its life within those of the months, and meets the months of
    each year."""
    first, last = months.agg(F.year(F.min("month")), F.year(F.max("month"))).first()
    if first is None:
        return securities.select(F.lit(None).cast("date").alias("month"), "code").where(F.lit(False))
    m, listed, left = F.col("month"), F.col("listing_date"), F.col("delisting_date")
    on = (listed.isNull() | (listed <= m)) & (left.isNull() | (left > m))
    if seasoned:
        on = on & (F.col(seasoned).isNull() | (F.col(seasoned) <= m))
    start, end = F.greatest(F.coalesce(F.year(listed), F.lit(first)), F.lit(first)), F.least(F.coalesce(F.year(left), F.lit(last)), F.lit(last))
    dealt = securities.where(listed.isNotNull() | left.isNotNull()).where(start <= end).withColumn("__year", F.explode(F.sequence(start, end)))
    return dealt.join(months.withColumn("__year", F.year("month")), "__year").where(on).select("month", "code")


def snapshot_members(months: DataFrame, snapshots: DataFrame, days: int = 100) -> DataFrame:
    """(month, code) of the newest snapshot at or before each month's end, if it is at most so many days old. snapshots: code,
    snap_date. A snapshot day is dealt to the months in which it can be the newest."""
    near = F.sequence(F.trunc("snap_date", "month"), F.trunc(F.date_add("snap_date", days), "month"), F.expr("interval 1 month"))
    dates = snapshots.select("snap_date").where("snap_date is not null").distinct().withColumn("__month", F.explode(near))
    newest = dates.join(months.select("month", F.trunc("month", "month").alias("__month")), "__month").where((F.col("snap_date") <= F.col("month")) & (F.datediff("month", "snap_date") <= days))
    newest = newest.groupBy("month").agg(F.max("snap_date").alias("snap_date"))  # a row for each month
    return snapshots.join(F.broadcast(newest), "snap_date").select("month", "code")


def universe(months: DataFrame, securities: DataFrame, snapshots: DataFrame | None = None, seasoned: DataFrame | None = None, days: int = 100) -> DataFrame:
    """(month, code): members by their dates, and those of the newest snapshot, which adds but never takes; without those that have
    left by the month's end or, where seasoned (code, seasoned) is given, aren't seasoned yet."""
    a = members(months, securities)
    if snapshots is not None:
        a = a.unionByName(snapshot_members(months, snapshots, days)).distinct()
    s = securities.select("code", "delisting_date")
    s = s.withColumn("seasoned", F.lit(None).cast("date")) if seasoned is None else s.join(seasoned.select("code", "seasoned"), "code", "left")
    gone = F.coalesce(F.col("delisting_date") <= F.col("month"), F.lit(False)) | F.coalesce(F.col("seasoned") > F.col("month"), F.lit(False))
    return a.join(s, "code", "left").where(~gone).select("month", "code")


def with_columns(df: DataFrame, contract: dict[str, str]) -> DataFrame:
    """df with all columns of a contract (name to type); those that it lacks are NULL."""
    return df.withColumns({c: F.lit(None).cast(kind) for c, kind in contract.items() if c not in df.columns})


def base_panel(members: DataFrame, prices: DataFrame) -> DataFrame:
    """Every member of every month with its prices, NULL where it has none."""
    return members.join(prices, ["code", "month"], "left")


def labelled(panel: DataFrame, securities: DataFrame, label: str, dated: DataFrame | None = None) -> DataFrame:
    """panel with label as it was in the row's month, and the current one where that isn't known.

    securities: code (a row for each) and label. dated: code, valid_from, valid_to (closed, NULL is open) and label; of several that hold,
    the one that began last, then the last in order. Without dated rows the current label stands for all months."""
    now = panel.join(securities.select("code", F.col(label).alias("__now")), "code", "left")
    if dated is None:
        return now.withColumnRenamed("__now", label)
    held = pit.valid_interval_join(panel.select("code", "month").distinct(), dated.where(F.col(label).isNotNull()).select("code", "valid_from", "valid_to", label), "code", "month")
    began = F.coalesce("valid_from", F.lit("0001-01-01").cast("date"))
    then = held.groupBy("code", "month").agg(F.max(F.struct(began, F.col(label)))[label].alias("__then"))
    return now.join(then, ["code", "month"], "left").withColumn(label, F.coalesce("__then", "__now")).drop("__then", "__now")


def seasoning(securities: DataFrame, calendar: DataFrame, days: int = 250) -> DataFrame:
    """code and seasoned: the trading day `days` after the first one at or after listing (listing + 365 before the calendar begins,
    2100-01-01 beyond its end). calendar: column day, one row for each trading day, a short list: each day is laid out for the days
    since the one before, so that a listing day finds its trading day by equality."""
    w = Window.orderBy("day")
    c = calendar.select("day", F.row_number().over(w).alias("rn"), F.lag("day").over(w).alias("before"))
    at = c.select("rn", F.explode(F.sequence(F.coalesce(F.date_add("before", 1), F.col("day")), F.col("day"))).alias("listing_date"))
    ends = calendar.select(F.min("day").alias("__first"))
    out = securities.join(F.broadcast(at), "listing_date", "left").join(F.broadcast(c.select((F.col("rn") - days).alias("rn"), F.col("day").alias("__day"))), "rn", "left").crossJoin(F.broadcast(ends))
    late = F.coalesce("__day", F.lit("2100-01-01").cast("date"))
    return out.where(F.col("listing_date").isNotNull()).select("code", F.when(F.col("listing_date") < F.col("__first"), F.date_add("listing_date", 365)).otherwise(late).alias("seasoned"))


def funnel(df: DataFrame, gates: dict[str, str], keys: list[str] | None = None) -> DataFrame:
    """(place, gate, mean, least, most, kept): how many rows of a month pass each gate and all before it; kept: the mean against the gate before.

    gates: name to a boolean SQL expression, in order.
    """
    flags, upto = [], F.lit(True)
    for name, rule in gates.items():
        upto = upto & F.coalesce(F.expr(rule), F.lit(False))
        flags.append(F.sum(upto.cast("long")).alias(name))
    m = df.groupBy("month").agg(*flags)
    rows = F.explode(F.array(*(F.struct(F.lit(k + 1).alias("place"), F.lit(g).alias("gate"), F.col(g).alias("n")) for k, g in enumerate(gates)))).alias("x")
    a = m.select(rows).select("x.*").groupBy("place", "gate").agg(F.avg("n").alias("mean"), F.min("n").alias("least"), F.max("n").alias("most"))
    before = F.lag("mean").over(Window.orderBy("place"))  # a row for each gate
    return a.withColumn("kept", F.when(before > 0, F.col("mean") / before))


def whole_snapshots(snapshots: DataFrame, day: str = "snap_date", least: float = 0.8) -> DataFrame:
    """snapshots without those days that hold fewer rows than this share of the median day."""
    sizes = snapshots.groupBy(day).agg(F.count("*").alias("__n"))  # a row for each day
    keep = sizes.withColumn("__mid", F.median("__n").over(Window.partitionBy())).where(F.col("__n") >= least * F.col("__mid")).select(day)
    return snapshots.join(F.broadcast(keep), day, "left_semi")


def inferred_delistings(snapshots: DataFrame, listed: DataFrame, days: int = 200) -> DataFrame:
    """(code, delisting_date): the end of the month after a code was last seen, if that is over `days` before the last snapshot, the
    market it was last seen in is covered to the end, and it isn't listed now. snapshots: code, market, snap_date."""
    seen = snapshots.groupBy("code").agg(F.max("snap_date").alias("last"), F.max_by("market", F.struct("snap_date", "market")).alias("market"))
    markets = snapshots.groupBy("market").agg(F.max("snap_date").alias("covered"))  # a row for each market
    covered = markets.withColumn("end", F.max("covered").over(Window.partitionBy())).where(F.col("covered") >= F.date_sub("end", days)).select("market", "end")
    gone = seen.join(F.broadcast(covered), "market").where(F.col("last") < F.date_sub("end", days)).join(listed.select("code").distinct(), "code", "left_anti")
    return gone.select("code", F.last_day(F.date_add("last", 1)).alias("delisting_date"))


def master(sources: DataFrame, conflict_days: int = 5) -> DataFrame:
    """One row for each code: name, market and industry of the first source that has them, the first and last listing day, the last delisting
    day, the sources, and whether listing days differ by more than conflict_days. sources: priority, source, code, name, market,
    industry, listing_date, delisting_date."""
    first = lambda c: F.min_by(c, F.when(F.trim(c) != "", F.col("priority"))).alias(c)
    conflict = F.coalesce(F.datediff(F.max("listing_date"), F.min("listing_date")) > conflict_days, F.lit(False))
    return sources.groupBy("code").agg(first("name"), first("market"), first("industry"), F.min("listing_date").alias("listing_date"), F.max("delisting_date").alias("delisting_date"), F.array_join(F.array_sort(F.collect_set("source")), "+").alias("sources"), conflict.alias("conflict"))
