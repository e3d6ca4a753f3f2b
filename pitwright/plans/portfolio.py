"""Picks, weights and the month-by-month fold of many portfolio arms."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitwright.functions.exprs import impact, sales_tax
from pitwright.operators import draws as keyed
from pitwright.operators import ranks, tswin
from pitwright.sources.files import written


def flagged(df: DataFrame, arm: list[str], signal: str, share: float = 0.05, low: int = 5, high: int = 25) -> DataFrame:
    """df with place and picked 0/1: the best k rows of each arm and month, k a share of the eligible rows between low and high; ties by
    code, rows without a signal last and never picked."""
    keys = [*arm, "month"]
    n = F.count(signal).over(Window.partitionBy(*keys))
    k = F.greatest(F.lit(low), F.least(F.lit(high), F.bround(n * share).cast("int")))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(signal).desc_nulls_last(), "code"))
    a = df.withColumn("__k", k).withColumn("place", place)
    return a.withColumn("picked", (F.col(signal).isNotNull() & (F.col("place") <= F.col("__k"))).cast("int")).drop("__k")


def eligible(df: DataFrame, signal: str, price: str = "exec_px") -> DataFrame:
    """The rows that may be picked: no veto, over the floor, with a signal and a price to trade at."""
    return df.where((F.col("VETO") == 1) & (F.col("FLOOR") == 1) & F.col(signal).isNotNull() & F.col(price).isNotNull())


def picks(df: DataFrame, arm: list[str], signal: str, share: float = 0.05, low: int = 5, high: int = 25) -> DataFrame:
    return flagged(df.where(F.col(signal).isNotNull()), arm, signal, share, low, high).where("picked = 1").drop("picked")


def latest_card(panel: DataFrame, signal: str, evidence: list[str], n: int = 5) -> DataFrame:
    """(month, code, place, signal, evidence): the best n rows of the newest month, with the columns that speak for them as a struct."""
    newest = panel.agg(F.max("month").alias("month"))
    top = panel.join(F.broadcast(newest), "month").select("month", "code", F.col(signal).alias("signal"), F.struct(*evidence).alias("evidence")).orderBy(F.col("signal").desc_nulls_last(), "code").limit(n)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.col("signal").desc_nulls_last(), "code")))  # n rows


# Fixed values of a small account: its size, the largest share of a name, the part of a day's trade taken, the least cap, commission.
ACCOUNT, CAP, TAKEN, LEAST_CAP, COMMISSION = 30_000_000, 0.12, 0.10, 0.01, 1.5e-4


def raw_weights(df: DataFrame, keys: list[str], signal: str) -> DataFrame:
    """df with raw: shares of each group before caps, by distance above the median, the sharper the wider signals are spread."""
    w = Window.partitionBy(*keys)
    a = df.withColumn("__s", F.coalesce(F.col(signal), F.lit(0.0)))
    a = a.withColumn("__d", F.col("__s") - F.median("__s").over(w)).withColumn("__spread", F.avg(F.abs("__d")).over(w))
    p = F.pow(F.greatest(F.col("__d"), F.lit(0.0)) + 1e-9, F.least(F.lit(2.0), 0.5 + 8 * F.col("__spread")))
    a = a.withColumn("__p", F.when(F.col("__spread") < 1e-6, 1.0).otherwise(p))
    return a.withColumn("raw", F.col("__p") / F.sum("__p").over(w)).drop("__s", "__d", "__spread", "__p")


def _known(c: Column) -> Column:
    """NaN as NULL."""
    return F.when(~F.isnan(c), c)


def candidates(panel: DataFrame, arm: str = "arm", hold: int = 24) -> DataFrame:
    """The rows of panel that its fold can look at, with __i, the number of the arm's month: those of codes picked in the month or in the
    hold + 1 months before. What is held was picked at most hold months ago, and is sold a month later at most, so an arm has no more
    than hold + 2 months' picks in a month, however many codes there are."""
    months = panel.select(arm, "month").distinct().withColumn("__i", F.row_number().over(Window.partitionBy(arm).orderBy("month")))
    lately = F.max((F.col("picked") == 1).cast("int")).over(Window.partitionBy(arm, "code").orderBy("__i").rangeBetween(-hold - 1, 0))
    return panel.join(months, [arm, "month"]).withColumn("__lately", lately).where("__lately = 1").drop("__lately")


def members(near: DataFrame, arm: str = "arm", hold: int = 24, most: int = 25) -> DataFrame:
    """(arm, __i, code, age): what each arm holds in each month, and the months it has been held before; near: candidates().

    The one step that runs from month to month. An arm's months are an array, each with its candidates in the order in which they would be
    taken, and the state handed on is what is held: `most` codes with their ages. A month without candidates empties it."""
    kind = near.schema["code"].dataType.simpleString()
    signal = F.col("signal").cast("double")
    name = F.struct(signal.isNull().alias("none"), (-F.coalesce(signal, F.lit(0.0))).alias("low"), "code", (F.coalesce("picked", F.lit(0)) == 1).alias("picked"), (F.coalesce(F.col("exits").cast("int"), F.lit(1)) == 0).alias("stays"))
    months = near.groupBy(arm, "__i").agg(F.array_sort(F.collect_list(name)).alias("names"))
    arms = months.groupBy(arm).agg(F.array_sort(F.collect_list(F.struct("__i", "names"))).alias("months"))
    nothing = F.expr(f"cast(map() as map<{kind}, int>)")
    start = F.struct(F.lit(0).alias("at"), nothing.alias("held"), F.expr(f"cast(array() as array<struct<i: int, held: map<{kind}, int>>>)").alias("past"))

    def step(state: Column, month: Column) -> Column:
        held = F.when(month["__i"] == state["at"] + 1, state["held"]).otherwise(nothing)
        age = lambda c: F.try_element_at(held, c["code"])
        may = F.filter(month["names"], lambda c: c["picked"] | (c["stays"] & F.coalesce(age(c) < hold, F.lit(False))))
        now = F.map_from_entries(F.transform(F.slice(may, 1, most), lambda c: F.struct(c["code"], F.coalesce(age(c) + 1, F.lit(0)))))
        past = F.concat(state["past"], F.array(F.struct(state["at"].alias("i"), state["held"].alias("held"))))
        return F.struct(month["__i"].alias("at"), now.alias("held"), past.alias("past"))

    whole = lambda s: F.concat(s["past"], F.array(F.struct(s["at"].alias("i"), s["held"].alias("held"))))
    out = arms.select(arm, F.explode(F.aggregate("months", start, step, whole)).alias("x"))
    return out.select(arm, F.col("x.i").alias("__i"), F.explode("x.held").alias("code", "age"))


def backtest(panel: DataFrame, arm: str = "arm", account: float = ACCOUNT, hold: int = 24, most: int = 25) -> DataFrame:
    """(arm, month, names, turnover, cost, ret_gross, ret): held names stay until they exit, age out or rank too low; new picks join.

    panel: arm, month, code (a row for each), signal, picked 0/1, exits 0/1 (missing: it exits), adv, fwd_ret and, if known,
    delisting_date. A missing return counts as 0, and as -1 in the month of a delisting. Only what is held runs from month to month
    (members), over rows whose number in an arm's month is bounded; weights, trades and returns are spread over arms and months."""
    number = lambda c: _known(F.col(c).cast("double")).alias(c)
    gone = F.col("delisting_date").cast("date") if "delisting_date" in panel.columns else F.lit(None).cast("date")
    # written once: months, candidates and what is held all read it
    rows = written(panel.select(arm, F.col("month").cast("date").alias("month"), "code", number("signal"), "picked", "exits", number("adv"), number("fwd_ret"), gone.alias("delisting_date")))
    near = candidates(rows, arm, hold)
    held = near.join(members(near, arm, hold, most), [arm, "__i", "code"])
    w = capped_weights(held, [arm, "__i"], "signal", "adv", account).select(arm, "__i", "code", "w")
    both = written(near.join(w, [arm, "__i", "code"], "left").select(arm, "month", "code", "w", "adv", "fwd_ret", "delisting_date"))
    months = rows.select(arm, "month").distinct()
    costs = trade_costs(both.withColumn("w", F.coalesce("w", F.lit(0.0))), months, [arm], account)
    end = F.last_day(F.when(F.col("month") == F.last_day("month"), F.date_add("month", 1)).otherwise(F.col("month")))
    lost = (F.col("delisting_date") > F.col("month")) & (F.col("delisting_date") <= end)
    ret = F.coalesce("fwd_ret", F.when(lost, F.lit(-1.0)), F.lit(0.0))
    earned = both.where("w is not null").groupBy(arm, "month").agg(F.count("*").alias("names"), F.sum(F.col("w") * ret).alias("ret_gross"))
    out = months.join(earned, [arm, "month"], "left").join(costs, [arm, "month"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return out.select(arm, "month", F.coalesce("names", F.lit(0)).cast("long").alias("names"), zero("turnover"), zero("cost"), zero("ret_gross")).withColumn("ret", F.col("ret_gross") - F.col("cost"))


def statistics(returns: DataFrame, arm: str, r: str, time: str = "month", per_year: int = 12, riskless: float = 0.0) -> DataFrame:
    """A row for each arm: n, cagr, vol, sharpe and sortino (over the riskless rate), mdd, calmar, hit_rate, mean, t (Newey-West), underwater
    (months), total; and the means of names, turnover and cost where returns has them. A missing return counts as 0."""
    a = returns.withColumn("__r", F.coalesce(r, F.lit(0.0)))
    down = tswin.drawdown(a, "__r", [arm], time)
    x = F.col("__r")
    n, growth = F.count("*"), tswin.growth(x)
    cagr = F.pow(growth, per_year / n) - 1
    low = F.stddev_samp(F.when(x < 0, x)) * per_year**0.5
    means = [F.avg(c).alias(c) for c in ("names", "turnover", "cost") if c in returns.columns]
    s = down.groupBy(arm).agg(n.alias("n"), cagr.alias("cagr"), (F.stddev_samp(x) * per_year**0.5).alias("vol"), low.alias("__low"), F.min("drawdown").alias("mdd"), F.avg((x > 0).cast("double")).alias("hit_rate"), F.avg(x).alias("mean"), (growth - 1).alias("total"), *means)
    s = s.join(tswin.hac_t(a, "__r", [arm], time).select(arm, "t"), arm).join(tswin.underwater(down, [arm], time), arm)
    over = F.col("cagr") - riskless
    ratios = {"sharpe": F.when(F.col("vol") > 0, over / F.col("vol")), "sortino": F.when(F.col("__low") > 0, over / F.col("__low")), "calmar": F.when(F.col("mdd") < 0, F.col("cagr") / F.abs("mdd"))}
    return s.withColumns(ratios).drop("__low")


def yearly(returns: DataFrame, r: str, keys: list[str], time: str = "month", names: str | None = None) -> DataFrame:
    """keys, year, months, ret (a missing return counts as 0), mean, hit_rate (share of months above 0) and the mean number of names."""
    x = F.col(r)
    held = [F.avg(names).alias("names")] if names else []
    return returns.groupBy(*keys, F.year(time).cast("long").alias("year")).agg(F.count("*").alias("months"), (tswin.growth(F.coalesce(x, F.lit(0.0))) - 1).alias("ret"), F.avg(x).alias("mean"), F.avg(F.coalesce((x > 0).cast("double"), F.lit(0.0))).alias("hit_rate"), *held)


def held_returns(weights: DataFrame, returns: DataFrame, securities: DataFrame) -> DataFrame:
    """weights (arm, month, code, w) with ret: of a name without return 0, but -1 in the month after which it is gone; returns: code, month,
    fwd_ret; securities: code, delisting_date."""
    a = weights.join(returns.select("code", "month", "fwd_ret"), ["code", "month"], "left").join(securities.select("code", "delisting_date"), "code", "left")
    gone = (F.col("delisting_date") > F.col("month")) & (F.col("delisting_date") <= F.last_day(F.add_months(F.trunc("month", "month"), 1)))
    return a.withColumn("ret", F.coalesce("fwd_ret", F.when(gone, F.lit(-1.0)), F.lit(0.0))).drop("fwd_ret", "delisting_date")


def tail_contribution(held: DataFrame, code: str, w: str, r: str, shares: tuple[float, ...] = (0.01, 0.05, 0.10)) -> DataFrame:
    """(top, names, part, rest): what the best share of names gave in all, and what the others did. Names are ranked by ranges."""
    c = held.groupBy(code).agg(F.sum(F.col(w) * F.col(r)).alias("__s"))
    ranked = ranks.global_rank(c, "__s", "__k", F.col(code), descending=True)
    total = c.agg(F.count("*").alias("__n"))
    tops = F.explode(F.array(*(F.struct(F.lit(q).alias("top"), F.greatest(F.lit(1), F.bround(F.col("__n") * q)).cast("long").alias("names")) for q in shares))).alias("x")
    a = ranked.crossJoin(F.broadcast(total.select(tops).select("x.*")))  # a few shares
    part = lambda on: F.sum(F.when(on, F.col("__s")).otherwise(0.0))
    return a.groupBy("top", "names").agg(part(F.col("__k") <= F.col("names")).alias("part"), part(F.col("__k") > F.col("names")).alias("rest"))


def capped_weights(df: DataFrame, keys: list[str], signal: str, adv: str, account: float = 30_000_000) -> DataFrame:
    """df with w: raw_weights under the caps of size and liquidity; what the caps leave is dealt again among the others, the rest is cash.

    In closed form: names are capped in order of raw / cap, most excessive first; the first k are capped for the least k at which
    none of the others, sharing what is left by raw, goes over its cap. A group is the names of one portfolio.
    """
    liquid = F.coalesce(F.col(adv), F.lit(0.0))
    cap = F.least(F.lit(CAP), F.when(liquid > 0, F.greatest(TAKEN * liquid / account, F.lit(LEAST_CAP))).otherwise(CAP))
    a = raw_weights(df, keys, signal).withColumn("__cap", cap).withColumn("__x", F.col("raw") / F.col("__cap"))
    w = Window.partitionBy(*keys).orderBy(F.desc("__x"), F.desc("raw"), "code")
    before, rest = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(0, Window.unboundedFollowing)
    used, raw_left = F.coalesce(F.sum("__cap").over(before), F.lit(0.0)), F.sum("raw").over(rest)
    share = F.greatest(1 - used, F.lit(0.0)) / raw_left
    a = a.withColumn("__share", share).withColumn("__fits", F.col("raw") * F.col("__share") <= F.col("__cap"))
    level = F.first(F.when(F.col("__fits"), F.col("__share")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    a = a.withColumn("__level", level).withColumn("w", F.when(F.col("__level").isNull(), F.col("__cap")).otherwise(F.least(F.col("__cap"), F.col("raw") * F.col("__level"))))
    return a.drop("__cap", "__x", "__share", "__fits", "__level")


def trade_costs(weights: DataFrame, months: DataFrame, keys: list[str], account: float = 30_000_000) -> DataFrame:
    """keys, month, turnover and cost: of each change of weight against the month before commission, square-root impact, and the tax of
    the day on sales. weights: keys, month, code, w, adv; a row with weight 0 gives the adv of what is sold. months: the months of the
    plan, a short list, or keys and months if each has its own."""
    own = [k for k in keys if k in months.columns]
    at = months.select(*own, "month", F.row_number().over(Window.partitionBy(*own).orderBy("month")).alias("__i"))
    at = at if own else F.broadcast(at)
    here = weights.join(at, [*own, "month"]).select(*keys, "code", "__i", "w", "adv")
    sold = here.where("w <> 0").select(*keys, "code", (F.col("__i") + 1).alias("__i"), (-F.col("w")).alias("w"), F.lit(None).cast("double").alias("adv"))
    net = here.unionAll(sold).groupBy(*keys, "__i", "code").agg(F.sum("w").alias("d"), F.max("adv").alias("adv")).join(at, [*own, "__i"])
    rate = COMMISSION + impact(F.col("d") * account, F.col("adv")) + F.when(F.col("d") < 0, sales_tax(F.col("month"))).otherwise(0.0)
    return net.groupBy(*keys, "month").agg(F.sum(F.abs("d")).alias("turnover"), F.sum(F.abs("d") * rate).alias("cost"))


def against_benchmark(returns: DataFrame, index: DataFrame, arm: str = "arm", r: str = "ret") -> DataFrame:
    """(arm, months, total, index_total, excess_mean, t): over the months that both have. index: month, ret."""
    both = returns.select(arm, "month", F.col(r).alias("__r")).join(F.broadcast(index.select("month", F.col("ret").alias("__i"))), "month").where("__r is not null and __i is not null").withColumn("__x", F.col("__r") - F.col("__i"))
    total = lambda c: tswin.growth(F.col(c)) - 1
    s = both.groupBy(arm).agg(F.count("*").alias("months"), total("__r").alias("total"), total("__i").alias("index_total"), F.avg("__x").alias("excess_mean"))
    return s.join(tswin.hac_t(both, "__x", [arm], "month").select(arm, "t"), arm)


def placebo(panel: DataFrame, draws: int, k: int, seed: str = "s") -> DataFrame:
    """(draw, mean_ret): k rows of each month without replacement, by order of a keyed hash; panel: month, code, fwd_ret.

    Where a month has n rows, the k smallest hashes lie below about k / n of their range; what is above a threshold some
    deviations higher is left out as it is made, by the beginning of the hash (draws.below), so few rows more than are drawn are shuffled.
    Draws that the threshold leaves short are drawn again from the whole month."""
    rows = written(panel.select("month", "code", "fwd_ret"))
    sizes = rows.groupBy("month").agg(F.count("*").alias("__n"))  # a row for each month
    part = F.least(F.lit(1.0), F.lit(k + 8 * k**0.5 + 16) / F.col("__n"))
    bound = F.when(part < 1, F.floor(part * 2**32)).otherwise(2**32)
    key = F.md5(F.concat_ws("|", F.lit(seed), "draw", "month", "code"))

    def drawn(spread: DataFrame) -> DataFrame:
        w = Window.partitionBy("draw", "month").orderBy("__h")
        return spread.withColumn("__place", F.row_number().over(w)).where(F.col("__place") <= k).select("draw", "month", "fwd_ret")

    tail = F.concat_ws("", *(F.concat(F.lit("|"), F.col(c).cast("string")) for c in ("month", "code")))
    bounded = rows.join(F.broadcast(sizes.select("month", bound.alias("__bound"))), "month").withColumn("__tail", tail)
    first = written(drawn(keyed.below(bounded, draws, seed, "__tail", "__bound", rows.count()).withColumn("__h", key)))
    every = sizes.select("month", "__n", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    found = first.groupBy("draw", "month").agg(F.count("*").alias("__found"))
    short = written(every.join(found, ["draw", "month"], "left").where(F.coalesce("__found", F.lit(0)) < F.least(F.col("__n"), F.lit(k))).select("draw", "month"))
    if short.count():
        again = drawn(rows.join(short, "month").withColumn("__h", key))
        first = first.join(short, ["draw", "month"], "left_anti").unionByName(again)
    return first.groupBy("draw").agg(F.avg("fwd_ret").alias("mean_ret"))


def bh_fdr(df: DataFrame, p: str, q: float = 0.05) -> DataFrame:
    """df with passed: Benjamini-Hochberg, over any number of tests: ranks by ranges, and one row with the last that passes."""
    a = ranks.global_rank(df, p, "__k")
    m = df.where(F.col(p).isNotNull()).count()
    top = a.agg(F.max(F.when(F.col(p) <= q * F.col("__k") / F.lit(max(1, m)), F.col(p))).alias("__top"))
    return a.crossJoin(F.broadcast(top)).withColumn("passed", F.coalesce(F.col(p) <= F.col("__top"), F.lit(False))).drop("__k", "__top")


def with_pack(panel: DataFrame, packs: Iterator) -> DataFrame:
    """Feature packs are functions of the panel, applied one after the other."""
    for pack in packs:
        panel = panel.transform(pack)
    return panel
