"""Incremental tables, merges with lineage, and matching of names."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitwright.functions.exprs import norm_text, similarity
from pitwright.operators.names import edit_pairs
from pitwright.operators.pit import latest


def upsert(old: DataFrame, new: DataFrame, keys: list[str], tie: list[str]) -> DataFrame:
    """New rows replace old ones of the same key; columns of either side stay."""
    both = old.withColumn("__batch", F.lit(0)).unionByName(new.withColumn("__batch", F.lit(1)), allowMissingColumns=True)
    return latest(both, keys, F.desc("__batch"), *(F.desc(c) for c in tie)).drop("__batch")


def compact(sources: list[DataFrame], uid: str, order: str, tie: list[str]) -> DataFrame:
    """All sources by name, of each uid the row that was collected last; a row without uid gets a hash of its columns as one."""
    both = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)
    rest = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in sorted(both.columns) if c != uid]
    named = F.coalesce(F.nullif(F.trim(F.col(uid).cast("string")), F.lit("")), F.sha1(F.concat_ws("\x1f", *rest)))
    return latest(both.withColumn(uid, named), [uid], F.col(order).desc_nulls_last(), *(F.col(c).desc_nulls_last() for c in tie))


def source_priority(df: DataFrame, key: str, priority: str) -> DataFrame:
    """Only rows of the first source that has a key."""
    return df.withColumn("__p", F.min(priority).over(Window.partitionBy(key))).where(F.col("__p") == F.col(priority)).drop("__p")


def with_amount(prices: DataFrame) -> DataFrame:
    """prices with amount; where a source lacks it, close times volume."""
    amount = F.col("amount") if "amount" in prices.columns else F.lit(None).cast("double")
    return prices.withColumn("amount", F.coalesce(amount, F.col("close") * F.col("volume")))


def filled(old: DataFrame, new: DataFrame, key: str, value: str, tie: list[str]) -> tuple[DataFrame, DataFrame]:
    """(old with the new values where these aren't blank, the rows in which both have one and differ: key, old, new). Of several new
    rows of a key the first by tie counts, so that none of the old rows is doubled."""
    there = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    first = latest(new.where(there(value).isNotNull()), [key], *map(F.col, tie)).select(F.col(key).alias("__k"), F.col(value).alias("__new"))
    a = old.join(first, F.col(key) == F.col("__k"), "left")
    log = a.where(there(value).isNotNull() & F.col("__new").isNotNull() & (there(value) != there("__new"))).select(key, F.col(value).alias("old"), F.col("__new").alias("new"))
    kept = [F.coalesce("__new", F.col(value)).alias(c) if c == value else F.col(c) for c in old.columns]
    return a.select(*kept), log


def pending(wanted: DataFrame, held: DataFrame, keys: list[str], year: str, priority: str) -> DataFrame:
    """wanted without what is held, with place: the newest year first, then by priority, then by key. A list of work, which is ordered
    within a year (years are few), and counted over years."""
    left = wanted.join(held.select(*keys).distinct(), keys, "left_anti")
    sizes = left.groupBy(year).count()
    before = F.coalesce(F.sum("count").over(Window.orderBy(F.desc(year)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each year
    a = left.join(F.broadcast(sizes.select(year, before.alias("__before"))), year)
    w = Window.partitionBy(year).orderBy(F.col(priority).asc_nulls_last(), *keys)
    return a.withColumn("place", F.row_number().over(w) + F.col("__before")).drop("__before")


def tier_merge(best: DataFrame, rest: DataFrame, keys: list[str]) -> DataFrame:
    return best.unionByName(rest.join(best.select(*keys).distinct(), keys, "left_anti"))


def coverage_gaps(held: DataFrame, wanted: DataFrame, key: str, day: str, start: str, end: str, failures: DataFrame | None = None, run_date: str | None = None, wait: int = 30) -> DataFrame:
    """(key, from_day, reason): full, backward (held from over 10 days after start) or forward (held until over 5 days before end).

    failures (key, requested_from, attempted_at): a request that failed less than `wait` days before run_date isn't made again,
    unless it would begin earlier now.
    """
    c = held.groupBy(key).agg(F.min(day).alias("lo"), F.max(day).alias("hi"))
    a = wanted.join(c, key, "left")
    s, e = F.lit(start).cast("date"), F.lit(end).cast("date")
    reason = F.when(F.col("lo").isNull(), "full").when(F.col("lo") > F.date_add(s, 10), "backward").when(F.col("hi") < F.date_sub(e, 5), "forward")
    gaps = a.select(key, F.when(reason == "forward", F.date_add("hi", 1)).otherwise(s).alias("from_day"), reason.alias("reason")).where("reason is not null")
    if failures is None:
        return gaps
    fresh = failures.where(F.datediff(F.lit(run_date).cast("date"), "attempted_at") < wait).groupBy(key).agg(F.min("requested_from").alias("__asked"))
    return gaps.join(fresh, key, "left").where(F.col("__asked").isNull() | (F.col("from_day") < F.col("__asked"))).drop("__asked")


def set_coverage(df: DataFrame, group: str, kind: str, required: list[str] | None = None) -> DataFrame:
    """(group, missing): missing is the number of required kinds that the group lacks; required: by default all kinds of df."""
    if required is not None:
        need = F.array(*(F.lit(x) for x in required))
        return df.groupBy(group).agg(F.size(F.array_except(need, F.collect_set(kind))).alias("missing"))
    pairs = df.select(group, kind).distinct()
    return pairs.groupBy(group).agg(F.count(kind).alias("__n")).crossJoin(F.broadcast(df.agg(F.count_distinct(kind).alias("__all")))).select(group, (F.col("__all") - F.col("__n")).alias("missing"))


#: What stands for a missing value in a text column.
MISSING = ("", "nan", "none", "<na>")


def _there(c: Column) -> Column:
    return F.when(~F.lower(F.trim(c)).isin(*MISSING), F.trim(c))


def union_atoms(c: Column, separator: str = "+") -> Column:
    """Aggregate: the sorted set of all parts of separator-joined strings, joined again."""
    parts = F.filter(F.transform(F.flatten(F.collect_set(F.split(c, rf"\{separator}"))), _there), lambda x: x.isNotNull())
    return F.array_join(F.array_sort(F.array_distinct(parts)), separator)


def dedup_key(day: Column, broker: Column, code: Column, title: Column) -> Column:
    """One report in several sources: the same day, house, security and first 40 characters of the title."""
    return F.sha1(F.concat_ws("\x1f", F.date_format(day, "yyyyMMdd"), broker, F.coalesce(code, F.lit("")), F.substring(norm_text(title), 1, 40)).cast("binary"))


def ledger_merge(df: DataFrame, key: str, atoms: dict[str, str] | None = None, least: list[str] | None = None, words: list[str] | None = None, longest: str = "title", largest: list[str] | None = None) -> DataFrame:
    """One row for each key; merging its result with rows that it is made of changes nothing.

    atoms: columns of separator-joined parts, which are united; least: the smallest value (uid and pub_date always); words: the
    smallest text that isn't missing; longest: the longest text, of equal ones the smallest; largest: the largest value.
    """
    a = {"source": "+"} if atoms is None else atoms
    long = F.min(F.when(F.col(longest).isNotNull(), F.struct((-F.length(longest)).alias("n"), F.col(longest)))).getField(longest)
    made = [F.min(c).alias(c) for c in dict.fromkeys(["uid", "pub_date", *(least or [])])]
    made += [union_atoms(F.col(c), sep).alias(c) for c, sep in a.items()] + [F.min(_there(F.col(c))).alias(c) for c in words or []]
    return df.groupBy(key).agg(*made, long.alias(longest), *(F.max(c).alias(c) for c in (["target"] if largest is None else largest)))


def rolled_up(df: DataFrame, groups: DataFrame, fine: str, wide: str, keys: list[str], other: str = "other"):
    """df grouped by keys and by the wider group of each fine one, `other` where the map (a short list: fine, wide) has none; the result
    takes agg()."""
    named = df.join(F.broadcast(groups.select(F.col(fine).alias("__fine"), F.col(wide).alias("__wide"))), F.col(fine) == F.col("__fine"), "left")
    return named.groupBy(*keys, F.coalesce("__wide", F.lit(other)).alias(fine))


# Labels of rows that sum up others.
SUBTOTALS = ("합계", "계", "소계", "총계")


def without_subtotals(df: DataFrame, label: str) -> DataFrame:
    return df.where(~F.coalesce(F.regexp_replace(label, r"\s", "").isin(*SUBTOTALS), F.lit(False)))


def _shortened(a: Column) -> Column:
    """All strings of an array, and all that lack one letter of them."""
    less = F.flatten(F.transform(a, lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda k: F.concat(F.substring(x, F.lit(1), k - 1), F.substring(x, k + 1, F.length(x))))))
    return F.array_distinct(F.concat(a, less))


def fuzzy_match(left: DataFrame, right: DataFrame, name: str, code: str, block: int = 2, least: float = 92) -> DataFrame:
    """(name, code, score): the best right name, if it is close enough, among those with the same first `block` letters (0: all).

    Two names that are so close differ by at most as many edits as the longer one allows; within one or two of them they share
    what is left after so many letters are taken out of each. Names meet at such a rest (hashed), so a beginning that all
    names have makes no pairs; longer names, which allow more edits, meet at one of their rarest trigrams.
    """
    share = least / 100
    allowed = lambda x: F.floor((1 - share) * F.floor(F.length(x) / share) + 1e-9).cast("int")

    def keyed(df: DataFrame, x: str) -> DataFrame:
        one, two = _shortened(F.array(x)), _shortened(_shortened(F.array(x)))
        n = allowed(F.col(x))
        return df.withColumn("__rests", F.when(n == 0, F.array(x)).when(n == 1, one).when(n == 2, two)).withColumn("__long", n > 1)

    lhs, rhs = keyed(left.select(name).distinct(), name), keyed(right.select(F.col(name).alias("__r"), code), "__r")
    hashed = lambda df, x: df.where("__rests is not null").select(*x, F.explode("__rests").alias("__rest")).select(*x, F.xxhash64("__rest").alias("__h"))
    near = hashed(lhs, [name]).join(hashed(rhs, ["__r", code]), "__h").select(name, "__r", code)
    # a name that allows three edits or more may be close to one that allows two
    wide = edit_pairs(lhs.where("__long"), rhs.where("__long"), name, "__r", allowed).where(F.least(F.length(name), F.length("__r")) >= share * F.greatest(F.length(name), F.length("__r")))
    pairs = near.unionAll(wide.join(rhs.select("__r", code), "__r").select(name, "__r", code)).distinct()
    if block:
        pairs = pairs.where(F.substring(name, 1, block) == F.substring("__r", 1, block))
    scored = pairs.withColumn("score", similarity(F.col(name), F.col("__r"))).where(F.col("score") >= least)
    return latest(scored, [name], F.desc("score"), F.asc(code)).select(name, code, "score")
