"""Statistics within cells of a cross-section, and the ladder of coarser cells behind them.

Means and deviations are aggregates that are joined back, so a cell may hold any share of the rows. Ranks are windows within
cells; cells of more than `rows` rows are ranked by ranges of (cell, value) instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitwright.operators import ranks
from pitwright.sources.files import written

#: Up to so many bytes of counted statistics are sent to all tasks.
CELL_BYTES = 32 << 20


def _small(df: DataFrame, width: int) -> DataFrame:
    """A written table, marked for sending if it is small enough."""
    return F.broadcast(df) if df.count() * width <= CELL_BYTES else df


def _by_cell(df: DataFrame, cells: list[str], values: list[list[str]]) -> DataFrame:
    """A row (level, cell, v0, v1, ...) for each row and level; values: for each level its columns."""
    each = [F.struct(F.lit(k).alias("level"), F.col(c).cast("string").alias("cell"), *(F.col(v).cast("double").alias(f"v{i}") for i, v in enumerate(vs))) for k, (c, vs) in enumerate(zip(cells, values, strict=True))]
    return df.select(F.explode(F.array(*each)).alias("r")).select("r.*")


def zscores(df: DataFrame, features: dict[str, str], cells: list[str], min_n: int = 8, k: float = 2.0) -> DataFrame:
    """df with, for each out: column of features, its winsorised z-score (clipped at k population deviations, then standardised) in the
    first of the cells, from fine to coarse, that has min_n values.

    Two aggregations for all features and all levels; rows move only if the statistics are too many to be sent to them."""
    base, n = written(df), len(features)
    xs = list(features.values())
    stats = written(_by_cell(base, cells, [xs] * len(cells)).groupBy("level", "cell").agg(*(e for i in range(n) for e in (F.avg(f"v{i}").alias(f"m{i}"), F.stddev_pop(f"v{i}").alias(f"s{i}"), F.count(f"v{i}").alias(f"n{i}")))))

    def beside(a: DataFrame, table: DataFrame, what: str, columns: list[str]) -> DataFrame:
        for level, c in enumerate(cells):
            t = table.where(F.col("level") == level).select(F.col("cell").alias(f"__of{level}"), *(F.col(x).alias(f"__{what}{level}_{x}") for x in columns))
            a = a.join(_small(t, 64 + 8 * len(columns)), F.col(c).cast("string").eqNullSafe(F.col(f"__of{level}")), "left").drop(f"__of{level}")
        return a

    a = beside(base, stats, "a", [f"{x}{i}" for i in range(n) for x in "msn"])
    clip = lambda level, i, x: F.when(F.col(x).isNotNull(), F.least(F.greatest(F.col(x), F.col(f"__a{level}_m{i}") - k * F.col(f"__a{level}_s{i}")), F.col(f"__a{level}_m{i}") + k * F.col(f"__a{level}_s{i}")))
    a = a.withColumns({f"__c{level}_{i}": clip(level, i, x) for level in range(len(cells)) for i, x in enumerate(xs)})
    again = written(_by_cell(a, cells, [[f"__c{level}_{i}" for i in range(n)] for level in range(len(cells))]).groupBy("level", "cell").agg(*(e for i in range(n) for e in (F.avg(f"v{i}").alias(f"m{i}"), F.stddev_pop(f"v{i}").alias(f"s{i}")))))
    a = beside(a, again, "b", [f"{x}{i}" for i in range(n) for x in "ms"])

    def z(level: int, i: int) -> Column:
        c, m, s = F.col(f"__c{level}_{i}"), F.col(f"__b{level}_m{i}"), F.col(f"__b{level}_s{i}")
        return F.when(F.col(f"__a{level}_n{i}") >= min_n, F.when(c.isNotNull(), F.when(s > 1e-12, (c - m) / s).otherwise(0.0)))

    made = [F.coalesce(*(z(level, i) for level in range(len(cells)))).alias(out) for i, out in enumerate(features)]
    return a.select(*(c for c in df.columns if c not in features), *made)


def zscore(df: DataFrame, x: str, cell: str, out: str, min_n: int = 8, k: float = 2.0) -> DataFrame:
    """Winsorised z-score of one column in one cell."""
    return zscores(df, {out: x}, [cell], min_n, k)


def _window_rank(df: DataFrame, x: str, cell: str, out: str, min_n: int) -> DataFrame:
    w = Window.partitionBy(cell)
    o = w.orderBy(F.col(x).asc_nulls_last())
    # equal values stand in one peer group: its first place and its last
    r = (F.rank().over(o) + F.count(x).over(o.rangeBetween(Window.unboundedPreceding, Window.currentRow))) / 2
    n = F.count(x).over(w)
    return df.withColumn(out, F.when(F.col(x).isNotNull() & (n >= min_n), r / n))


def _range_rank(df: DataFrame, x: str, cell: str, out: str, min_n: int, rows: int) -> DataFrame:
    v = ranks.values_in_order(df.select(F.col(cell).alias("__c"), F.col(x).alias("__x")), ["__c"], "__x", rows)
    rank = F.when(F.col("__all") >= min_n, (F.col("__upto") - (F.col("__n") - 1) / 2) / F.col("__all"))
    v = v.select("__c", "__x", rank.alias(out))
    return df.join(v, F.col(cell).eqNullSafe(F.col("__c")) & (F.col(x) == F.col("__x")), "left").drop("__c", "__x")


def rank_pcts(df: DataFrame, features: dict[str, str], cells: list[str], min_n: int = 8, rows: int = 1_000_000) -> DataFrame:
    """df with, for each out: column of features, its average rank over the count, in (0, 1], in the first of the cells, from fine to
    coarse, that has min_n values. Cells of more than `rows` rows are ranked by ranges, the others by one window a level."""
    a, names = written(df), df.columns
    sizes = written(_by_cell(a, cells, [[]] * len(cells)).groupBy("level", "cell").agg(F.count("*").alias("n")).where(F.col("n") > rows))
    hot = {r[0] for r in sizes.select("level").distinct().collect()}  # at most as many as levels
    made = {}
    for level, c in enumerate(cells):
        parts = [(a, _window_rank, ())]
        if level in hot:
            large = _small(sizes.where(F.col("level") == level).select(F.col("cell").alias("__hot")), 64)
            on = F.col(c).cast("string").eqNullSafe(F.col("__hot"))
            parts = [(a.join(large, on, "left_anti"), _window_rank, ()), (a.join(large, on, "left_semi"), _range_rank, (rows,))]
        done = []
        for part, how, more in parts:
            for i, x in enumerate(features.values()):
                part = how(part, x, c, f"__r{level}_{i}", min_n, *more)
            done.append(part)
        a = done[0] if len(done) == 1 else done[0].unionByName(done[1])
        made |= {(level, i): F.col(f"__r{level}_{i}") for i in range(len(features))}
    return a.select(*(c for c in names if c not in features), *(F.coalesce(*(made[level, i] for level in range(len(cells)))).alias(out) for i, out in enumerate(features)))


def rank_pct(df: DataFrame, x: str, cell: str, out: str, min_n: int = 8, rows: int = 1_000_000) -> DataFrame:
    """Average rank over count of one column in one cell."""
    return rank_pcts(df, {out: x}, [cell], min_n, rows)


#: What standardises all features in all cells at once, by what does it for one.
TOGETHER = {zscore: zscores, rank_pct: rank_pcts}


def ladder(df: DataFrame, x: str, cells: list[str], out: str, how=zscore, **options) -> DataFrame:
    """The first of the cells, from fine to coarse, that gives a value."""
    return TOGETHER[how](df, {out: x}, cells, **options)


def cells(df: DataFrame, month: str, industry: str, bucket: str, min_n: int = 8) -> DataFrame:
    """cell, cell_l2 and cell_l3; cells that are too small take the next coarser label, in two rounds."""
    ym = F.date_format(month, "yyyyMM")
    a = df.withColumn("cell_l3", ym).withColumn("cell_l2", F.concat_ws("|", ym, F.col(industry))).withColumn("cell", F.concat_ws("|", ym, F.col(industry), F.col(bucket)))
    # what a cell becomes depends on the counts of the finest ones alone
    t = a.groupBy("cell", "cell_l2", "cell_l3").agg(F.count("*").alias("__n"))
    t = t.withColumn("__to", F.when(F.sum("__n").over(Window.partitionBy("cell")) < min_n, F.col("cell_l2")).otherwise(F.col("cell")))
    t = t.withColumn("__to", F.when(F.sum("__n").over(Window.partitionBy("__to")) < min_n, F.col("cell_l3")).otherwise(F.col("__to")))
    labels = _small(written(t.select(*(F.col(c).alias(f"__{c}") for c in ("cell", "cell_l2", "cell_l3")), "__to")), 96)
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in ("cell", "cell_l2", "cell_l3")]
    return a.join(labels, same, "left").withColumn("cell", F.col("__to")).drop("__to", "__cell", "__cell_l2", "__cell_l3")


def floor_gate(*ranks: Column, least: int = 2) -> Column:
    """1 if no axis ranks below a half and enough rank at or above it; missing axes count as neither."""
    ok = sum((F.coalesce((r >= 0.5).cast("int"), F.lit(0)) for r in ranks), F.lit(0))
    bad = sum((F.coalesce((r < 0.5).cast("int"), F.lit(0)) for r in ranks), F.lit(0))
    return ((bad == 0) & (ok >= least)).cast("int")


def corr_pairs(df: DataFrame, columns: list[str], least: int = 200) -> DataFrame:
    """(a, b, rho, n) of each pair, over rows that have both."""
    pairs = [(a, b) for k, a in enumerate(columns) for b in columns[k + 1 :]]
    wide = df.agg(*(e for a, b in pairs for e in (F.corr(a, b).alias(f"r_{a}_{b}"), F.sum((F.col(a).isNotNull() & F.col(b).isNotNull()).cast("long")).alias(f"n_{a}_{b}"))))
    rows = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.when(F.col(f"n_{a}_{b}") >= least, F.col(f"r_{a}_{b}")).alias("rho"), F.col(f"n_{a}_{b}").alias("n")) for a, b in pairs)))
    return wide.select(rows.alias("r")).select("r.*")
