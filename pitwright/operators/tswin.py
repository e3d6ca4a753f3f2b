"""Windows along time within a code. Offsets count rows, not months."""

from __future__ import annotations

from bisect import insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitwright.functions.exprs import safe_div
from pitwright.sources.files import written


def along(code: str = "code", time: str = "month"):
    return Window.partitionBy(code).orderBy(time)


def rolling(c: str, agg, w, rows: int, least: int) -> Column:
    """agg over the last rows, NULL where fewer than least values are there."""
    f = w.rowsBetween(-(rows - 1), 0)
    return F.when(F.count(c).over(f) >= least, agg(c).over(f))


def slope(c: str, row: str, w, rows: int = 12, least: int = 6) -> Column:
    """Least-squares slope over the last rows, NULL if any of them lacks a value."""
    f = w.rowsBetween(-(rows - 1), 0)
    return F.when((F.count(c).over(f) == F.count("*").over(f)) & (F.count(c).over(f) >= least), F.regr_slope(c, row).over(f))


def ffill(c: str, w, limit: int) -> Column:
    return F.last(c, ignorenulls=True).over(w.rowsBetween(-limit, 0))


def streak(flag: Column, w, rows: int = 3) -> Column:
    f = w.rowsBetween(-(rows - 1), 0)
    return F.when(F.count(flag).over(f) == rows, F.min(flag).over(f))


def quarterly(df: DataFrame, value: str, out: str, keys: list[str], year: str, quarter: str) -> DataFrame:
    """Cumulative values of a year to those of a quarter; NULL where the quarter before is missing."""
    w = Window.partitionBy(*keys, year).orderBy(quarter)
    q = F.col(quarter)
    return df.withColumn(out, F.when(q == 1, F.col(value)).when(F.lag(q).over(w) == q - 1, F.col(value) - F.lag(value).over(w)))


def ols_residual(df: DataFrame, y: str, q: str, t: str, w, rows: int = 36, ridge: float = 1e-8) -> DataFrame:
    """df with resid: of y on (1, ln q, t) over the last rows, at the last one; NULL unless all rows have both.

    Ridge times max(1, trace / 3) is added to the diagonal of the normal equations. They are solved about the means, with what the ridge of
    the intercept leaves of these: products of uncentred sums would lose as many digits as the means are larger than the deviations.
    """
    f = w.rowsBetween(-(rows - 1), 0)
    a = df.withColumn("__x", F.when(F.col(q) > 0, F.log(F.col(q)))).withColumn("__ok", (F.col(y).isNotNull() & F.col("__x").isNotNull()).cast("int"))
    v = {"x": F.col("__x"), "t": F.col(t).cast("double"), "y": F.col(y)}
    sums = {"n": F.sum(F.lit(1.0)), "xx": F.sum(v["x"] * v["x"]), "tt": F.sum(v["t"] * v["t"])} | {f"m{k}": F.avg(e) for k, e in v.items()}
    sums |= {f"c{i}{j}": F.covar_pop(v[i], v[j]) for i, j in ("xx", "xt", "tt", "xy", "ty")}
    a = a.select("*", *(e.over(f).alias(f"__s_{k}") for k, e in sums.items()), F.sum("__ok").over(f).alias("__full"))
    s = {k: F.col(f"__s_{k}") for k in sums}
    a = a.withColumn("__r", F.lit(ridge) * F.greatest(F.lit(1.0), F.abs(s["n"] + s["xx"] + s["tt"]) / 3))
    left = F.col("__r") / (s["n"] + F.col("__r"))
    c = {i + j: s["n"] * (s[f"c{i}{j}"] + s[f"m{i}"] * s[f"m{j}"] * left) + (F.col("__r") if i == j else 0.0) for i, j in ("xx", "xt", "tt", "xy", "ty")}
    d = c["xx"] * c["tt"] - c["xt"] * c["xt"]
    a = a.withColumns({"__b": (c["xy"] * c["tt"] - c["ty"] * c["xt"]) / d, "__c": (c["ty"] * c["xx"] - c["xy"] * c["xt"]) / d})
    off = lambda x, t, y: y - F.col("__b") * x - F.col("__c") * t
    resid = off(*(v[k] - s[f"m{k}"] for k in "xty")) + off(*(s[f"m{k}"] for k in "xty")) * left
    return a.withColumn("resid", F.when(F.col("__full") == rows, resid)).drop("__x", "__ok", "__r", "__full", "__b", "__c", *(f"__s_{k}" for k in sums))


#: Children of a node in the tree over ranges of numbers.
FAN = 16


def _ranges_at(asking: DataFrame, sums: DataFrame, n: int) -> DataFrame:
    """asking (__s, __block, __side, __rank) with __bucket, the range of numbers that holds that rank among the earlier blocks, and __below,
    how many of their numbers lie in lower ranges. sums: __s, __bucket, __block, __k; n ranges.

    The way down a tree over the ranges, a level a step: at each node the counts of its children up to the block are running sums
    along the blocks, so a step costs the counts of a level and FAN rows for each question."""
    levels = 1
    while FAN**levels < n:
        levels += 1
    at = asking.withColumn("__node", F.lit(0).cast("long")).withColumn("__below", F.lit(0).cast("long"))
    for level in reversed(range(levels)):
        counts = sums.groupBy("__s", F.expr(f"__bucket div {FAN**level}").alias("__node"), "__block").agg(F.sum("__k").alias("__k"))
        children = at.select("*", F.explode(F.sequence(F.lit(0), F.lit(FAN - 1))).alias("__child")).withColumn("__node", F.col("__node") * FAN + F.col("__child"))
        both = children.withColumn("__k", F.lit(0).cast("long")).unionByName(counts, allowMissingColumns=True)
        along_blocks = Window.partitionBy("__s", "__node").orderBy("__block", F.col("__side").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        held = both.withColumn("__held", F.sum("__k").over(along_blocks)).where("__side is not null")
        upto = Window.partitionBy("__s", "__block", "__side").orderBy("__node").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        held = held.withColumn("__end", F.col("__below") + F.sum("__held").over(upto))
        held = held.where((F.col("__end") - F.col("__held") <= F.col("__rank")) & (F.col("__rank") < F.col("__end")))
        at = written(held.select("__s", "__block", "__side", "__rank", "__node", (F.col("__end") - F.col("__held")).alias("__below")))
    return at.withColumnRenamed("__node", "__bucket")


def _median_history(placed: DataFrame, n: int) -> DataFrame:
    """(__s, __block, __n, __lo, __x, __k): of the __n numbers in earlier blocks of a section those that can still become a median within the
    block, as runs of equal numbers; __lo lie before them. placed: __s, __block, __x, in n blocks."""
    numbers = placed.groupBy("__s", "__block", "__x").agg(F.count("__x").alias("__k"))
    numbers = written(numbers.where("__x is not null").repartitionByRange(n, "__s", "__x").withColumn("__bucket", F.spark_partition_id()))
    in_order = Window.partitionBy("__s").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    asking = placed.groupBy("__s", "__block").agg(F.count("__x").alias("__m")).withColumn("__n", F.sum("__m").over(in_order)).where("__n > 0")
    # each number of the block moves the middle by half a place at most
    asking = asking.select("__s", "__block", "__n", F.greatest(F.lit(0), F.floor((F.col("__n") - F.col("__m") - 1) / 2)).alias("__lo"), F.least(F.col("__n") - 1, F.floor((F.col("__n") + F.col("__m")) / 2)).alias("__hi"))
    asking = written(asking)
    sides = asking.select("__s", "__block", F.explode(F.array(*(F.struct(F.lit(k).alias("__side"), F.col(k).alias("__rank")) for k in ("__lo", "__hi")))).alias("__a")).select("__s", "__block", "__a.*")
    found = _ranges_at(sides, numbers.groupBy("__s", "__bucket", "__block").agg(F.sum("__k").alias("__k")), n)
    low = found.where("__side = '__lo'").select("__s", "__block", F.col("__bucket").alias("__first"), "__below")
    high = found.where("__side = '__hi'").select("__s", "__block", F.col("__bucket").alias("__last"))
    wanted = asking.join(low, ["__s", "__block"]).join(high, ["__s", "__block"]).withColumnRenamed("__block", "__of").withColumn("__bucket", F.explode(F.sequence("__first", "__last")))
    met = numbers.join(wanted, ["__s", "__bucket"]).where("__block < __of").groupBy("__s", "__of", "__n", "__lo", "__hi", "__below", "__x").agg(F.sum("__k").alias("__k"))
    upto = Window.partitionBy("__s", "__of").orderBy("__x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.col("__below") + F.sum("__k").over(upto)
    taken = F.least(end, F.col("__hi") + 1) - F.greatest(end - F.col("__k"), F.col("__lo"))
    return met.select("__s", F.col("__of").alias("__block"), "__n", "__lo", "__x", taken.alias("__k")).where("__k > 0")


def expanding_median(df: DataFrame, x: str, section: str | None, order: list[str], out: str = "lagged_median", least: int = 30, lagged: bool = True, rows: int = 50_000) -> DataFrame:
    """df with the median of all earlier rows of the section (None: of all rows), if there are enough; lagged=False: up to and with the
    row itself. order must tell rows apart.

    The rows lie in the order of section and time in blocks of about `rows`, which divide long sections. What came before a block
    can give it only numbers near its middle, about as many as the block has rows; they are found by going down a tree over ranges of
    numbers, for all blocks at once, so no task holds a section, and work is the rows times the logarithm of the blocks. Only
    sections that lie in several blocks are looked at, at most one for each border between blocks.
    """
    names, schema = df.columns, T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])
    df = written(df)
    n = max(1, -(-df.count() // rows))
    s = F.to_json(F.struct(section)) if section else F.lit("")
    base = df.withColumns({"__s": s, "__x": F.col(x).cast("double")})
    placed = base.repartitionByRange(n, "__s", *order).withColumn("__block", F.spark_partition_id())

    def medians(block: pa.Table, history: pa.Table | None = None) -> pa.Table:
        block = block.sort_by([(c, "ascending") for c in order])
        seen: list[float] = []
        before = hidden = 0
        if history is not None and len(history):
            history = history.sort_by("__x")
            before, hidden = history["__n"][0].as_py(), history["__lo"][0].as_py()
            seen = [v for v, k in zip(history["__x"].to_pylist(), history["__k"].to_pylist(), strict=True) for _ in range(k)]
        found: list[float | None] = []
        for v in block["__x"].to_pylist():
            if not lagged and v is not None:
                insort(seen, v)
                before += 1
            found.append((seen[(before - 1) // 2 - hidden] + seen[before // 2 - hidden]) / 2 if before >= max(1, least) else None)
            if lagged and v is not None:
                insort(seen, v)
                before += 1
        return block.select(names).append_column(out, pa.array(found, pa.float64()))

    if n == 1:  # nothing lies before the only block
        return placed.groupBy("__s", "__block").applyInArrow(lambda block: medians(block), schema)
    placed = written(placed)
    across = placed.groupBy("__s").agg(F.min("__block").alias("__a"), F.max("__block").alias("__b")).where("__a < __b").select("__s")
    history = _median_history(written(placed.join(across, "__s", "left_semi").select("__s", "__block", "__x")), n)
    return placed.groupBy("__s", "__block").cogroup(history.groupBy("__s", "__block")).applyInArrow(medians, schema)


def momentum(c: str, w, rows: int = 12) -> Column:
    """Change against so many rows before, as a share; NULL where that was 0."""
    return safe_div(F.col(c), F.lag(c, rows).over(w)) - 1


def underwater(df: DataFrame, keys: list[str], time: str, at: float = -1e-9) -> DataFrame:
    """keys and the longest run of rows whose column drawdown is below `at`."""
    w = Window.partitionBy(*keys).orderBy(time)
    low = F.col("drawdown") < at
    runs = df.withColumn("__run", F.sum((~low).cast("int")).over(w)).where(low).groupBy(*keys, "__run").agg(F.count("*").alias("__n"))
    longest = runs.groupBy(*keys).agg(F.max("__n").alias("underwater"))
    return df.select(*keys).distinct().join(longest, keys, "left").withColumn("underwater", F.coalesce("underwater", F.lit(0).cast("long")))


def growth(r: Column, w=None) -> Column:
    """The product of 1 + r, as an aggregate or over a window: sums of logarithms, with zeros and signs counted apart, so that parts can
    be merged and a total loss makes it 0. NULLs are passed over; of NULLs alone it is NULL."""
    f = 1 + r
    over = (lambda e: e) if w is None else (lambda e: e.over(w))
    logs, lost, minus = over(F.sum(F.when(f != 0, F.log(F.abs(f))))), over(F.count_if(f == 0)), over(F.count_if(f < 0))
    return F.when(lost > 0, 0.0).otherwise(F.exp(logs) * F.when(minus % 2 == 1, -1).otherwise(1))


def drawdown(df: DataFrame, r: str, keys: list[str], time: str) -> DataFrame:
    """df with wealth, peak and drawdown."""
    w = Window.partitionBy(*keys).orderBy(time).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    a = df.withColumn("wealth", growth(F.col(r), w))
    a = a.withColumn("peak", F.greatest(F.lit(1.0), F.max("wealth").over(w)))
    return a.withColumn("drawdown", F.col("wealth") / F.col("peak") - 1)


def hac_lags(n: Column) -> Column:
    return F.floor(4 * F.pow(n / 100, F.lit(2 / 9)))


def hac_t(df: DataFrame, x: str, keys: list[str], time: str, least: int = 12, most: int | None = None) -> DataFrame:
    """keys, n and t: Newey-West t of the mean with Bartlett weights over floor(4 (n / 100) ^ (2/9)) lags. most: lags that are laid out;
    by default as many as the largest key needs, which is counted first (12 up to 14,000 rows, 31 for a million)."""
    w, o = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(time)
    there = df.where(F.col(x).isNotNull())
    if most is None:
        most = int(there.groupBy(*keys).count().agg(F.coalesce(F.max(hac_lags(F.col("count"))), F.lit(0))).first()[0])
    a = there.withColumn("__e", F.col(x) - F.avg(x).over(w)).withColumn("__L", hac_lags(F.count("*").over(w)))
    g = a.select("*", *(F.lag("__e", k).over(o).alias(f"__l{k}") for k in range(1, most + 1)))
    s = F.sum(F.col("__e") * F.col("__e"))
    for k in range(1, most + 1):
        share = F.greatest(1 - k / (F.col("__L") + 1), F.lit(0.0))
        s = s + 2 * F.coalesce(F.sum(share * F.col("__e") * F.col(f"__l{k}")), F.lit(0.0))
    n = F.count("*")
    return g.groupBy(*keys).agg(n.alias("n"), F.when((n >= least) & (s > 0), F.avg(x) / F.sqrt(s / n / n)).alias("t"))
