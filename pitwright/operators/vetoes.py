"""Vetoes: binary rules on rows of a panel, multiplied into one. Missing inputs pass, but for liquidity, where they fail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitwright.functions.exprs import safe_div
from pitwright.operators.ranks import quantiles
from pitwright.operators.tswin import along

#: Fixed value: the least average value traded a day.
LEAST_ADV = 3e8
RULES = tuple(f"V{k}" for k in range(1, 9))


def _unless(bad: Column) -> Column:
    return F.when(F.coalesce(bad, F.lit(False)), 0).otherwise(1)


def vetoes(df: DataFrame, least_adv: float = LEAST_ADV, administrative: DataFrame | None = None) -> DataFrame:
    """df with V1 to V8 and their product VETO; columns that df lacks count as missing.

    One shuffle by code for the changes over time; the quantile of a month is two places in the order of its values, so a month may hold
    most rows. administrative: codes, a short list.
    """
    names, wanted = df.columns, ("revenue_ttm", "inventory", "receivable", "bad_3q", "dilution", "equity", "adv20", "close", "sim_risk_pct", "n1", "d_eff_tax")
    absent = [c for c in wanted if c not in names]
    a = df.select("*", *(F.lit(None).cast("double").alias(c) for c in absent))
    w = along()
    change = {c: F.col(c) - F.lag(c, 12).over(w) for c in ("revenue_ttm", "inventory", "receivable")}
    a = a.select("*", *(e.alias(f"__d_{c}") for c, e in change.items()), F.sum("dilution").over(w.rowsBetween(-2, 0)).alias("__issues"))
    if "n1" in absent:
        a = a.withColumn("__n1_high", F.lit(None).cast("double"))
    else:
        high = quantiles(df.select("month", "n1"), ["month"], "n1", {"__n1_high": 0.9})
        a = a.join(F.broadcast(high), "month", "left")  # a row for each month
    stock = F.coalesce("__d_inventory", F.lit(0.0)) + F.coalesce("__d_receivable", F.lit(0.0))
    listed = F.lit(False)
    if administrative is not None:
        a = a.join(F.broadcast(administrative.select("code").distinct().withColumn("__listed", F.lit(True))), "code", "left")
        listed = F.col("__listed")
    a = a.select(
        *names,
        _unless((F.col("__d_revenue_ttm") > 0) & (safe_div(stock, F.col("__d_revenue_ttm")) > 1.5)).alias("V1"),
        _unless(F.col("bad_3q") >= 1).alias("V2"),
        _unless(F.col("__issues") > 0).alias("V3"),
        F.lit(1).alias("V4"),  # takes one pack's axis away: see pack_gate
        _unless(F.coalesce(F.col("equity") <= 0, F.lit(False)) | F.coalesce(listed, F.lit(False))).alias("V5"),
        F.when((F.col("adv20") >= least_adv) & (F.col("close") > 0), 1).otherwise(0).alias("V6"),
        _unless(F.col("sim_risk_pct") < 0.05).alias("V7"),
        _unless((F.col("n1") > F.col("__n1_high")) & (F.col("d_eff_tax") < -0.03)).alias("V8"),
    )
    product = F.lit(1)
    for rule in RULES:
        product = product * F.col(rule)
    return a.withColumn("VETO", product)


def pack_gate(axis: str, theta: str, least: float = 0.5) -> Column:
    """V4: a pack's axis, NULL where its link to the firm is unknown or weak; the row itself stays."""
    return F.when(F.col(theta) >= least, F.col(axis))


def fired(df: DataFrame) -> DataFrame:
    """(rule, n, share) of the rows that each rule vetoes."""
    wide = df.agg(F.count("*").alias("all"), *(F.sum((F.col(v) == 0).cast("long")).alias(v) for v in RULES))
    rows = F.explode(F.array(*(F.struct(F.lit(v).alias("rule"), F.coalesce(v, F.lit(0)).alias("n")) for v in RULES))).alias("x")
    return wide.select("all", rows).select("x.rule", "x.n", safe_div(F.col("x.n"), F.col("all")).alias("share"))
