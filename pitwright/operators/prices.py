"""From daily prices to a panel of months: what could be traded at, and what it returned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitwright.functions.exprs import safe_div
from pitwright.operators.tswin import along, rolling


def daily_features(daily: DataFrame) -> DataFrame:
    """daily with adv20 (mean amount of 20 rows, 10 at least), ret1d, and the next row's day and opening price."""
    w = along(time="day")
    return daily.withColumns(
        {
            "adv20": rolling("amount", F.avg, w, 20, 10),
            "ret1d": safe_div(F.col("close_px"), F.lag("close_px").over(w)) - 1,
            "next_open": F.lead("open_px").over(w),
            "next_day": F.lead("day").over(w),
        }
    )


def next_month_only(c: str, month: str = "month", by: str = "code") -> Column:
    """c of the code's next row, if that is the very next month."""
    w = Window.partitionBy(by).orderBy(month)
    return F.when(F.lead(month).over(w) == F.last_day(F.add_months(month, 1)), F.lead(c).over(w))


def month_panel(daily: DataFrame, gap: int = 10) -> DataFrame:
    """(code, month, signal_day, close, adv20, exec_px, fwd_ret): the last row of each month; it is traded at the next row's opening
    price, if that comes within `gap` days, else at its own close; the return runs from there to the next month's, and is NULL
    where the next month has no row. One shuffle by code. daily: code, day, open_px, close_px, amount."""
    last = daily_features(daily).groupBy("code", F.last_day("day").alias("month")).agg(F.max_by(F.struct("day", "close_px", "adv20", "next_open", "next_day"), "day").alias("x"))
    a = last.select("code", "month", "x.*")
    a = a.withColumn("exec_px", F.coalesce(F.when(F.datediff("next_day", "day") <= gap, F.col("next_open")), F.col("close_px")))
    return a.select("code", "month", F.col("day").alias("signal_day"), F.col("close_px").alias("close"), "adv20", "exec_px", (safe_div(next_month_only("exec_px"), F.col("exec_px")) - 1).alias("fwd_ret"))


def benchmark(index: DataFrame) -> DataFrame:
    """(month, ret): change of an index's last close against the month before. index: day, close."""
    m = index.groupBy(F.last_day("day").alias("month")).agg(F.max_by("close", "day").alias("close"))
    return m.select("month", (safe_div(F.col("close"), F.lag("close").over(Window.orderBy("month"))) - 1).alias("ret"))  # a row for each month
