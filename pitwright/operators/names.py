"""Names that are nearly equal: the ratio of token sets, and exact similarity joins without blocks.

A join lays only those names side by side that share something rare. Two names within d edits (letters put in, taken out or
replaced) lack at most 3 d of each other's trigrams, so of the 3 d + 1 rarest trigrams of each, in one order for all names,
they share one (prefix filter). Trigrams are counted (the second "ana" of "banana" is its own) and, for token sets, taken within
tokens, so that the order of tokens doesn't matter. What many names have, a common beginning or a legal form, is rare in no
name that has anything else.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitwright.operators.pit import latest
from pitwright.sources.files import written

#: Up to so many bytes of counted grams are sent to all tasks.
GRAM_BYTES = 32 << 20


def tokens(name: Column) -> Column:
    """The distinct words of a name in order."""
    return F.array_sort(F.array_distinct(F.array_remove(F.split(F.trim(name), r"\s+"), "")))


def common_length(x: Column, y: Column) -> Column:
    """The length of the longest common subsequence of two strings, a row of the table at a time as bits of a number."""

    @F.pandas_udf("int")
    def common(xs: pd.Series, ys: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(xs, ys, strict=True):
            places: dict[str, int] = {}
            for k, letter in enumerate(b or ""):
                places[letter] = places.get(letter, 0) | 1 << k
            row = full = (1 << len(b or "")) - 1
            for letter in a or "":
                same = row & places.get(letter, 0)
                row = ((row + same) | (row - same)) & full
            out.append((full ^ row).bit_count())
        return pd.Series(out, dtype="int32")

    return common(x, y)


def token_set_ratio(df: DataFrame, a: str, b: str, out: str, least: float = 0) -> DataFrame:
    """df with out: how alike two names are as sets of words, 0 to 100; NULL below `least`, where the costly part is left out.

    The words that both have stand first; compared are these alone, with the rest of a, and with the rest of b, by the share of
    letters that must be put in or taken out, and the best of the three counts. A name whose words are all in the other has 100."""
    joined = lambda x: F.array_join(x, " ")
    c = df.withColumn("__ta", tokens(F.col(a))).withColumn("__tb", tokens(F.col(b)))
    c = c.select(*df.columns, joined(F.array_intersect("__ta", "__tb")).alias("__s"), joined(F.array_except("__ta", "__tb")).alias("__x"), joined(F.array_except("__tb", "__ta")).alias("__y"))
    n = {k: F.length(f"__{k}") for k in "sxy"}
    gap = F.when((n["s"] > 0) & (n["x"] > 0), 1).otherwise(0), F.when((n["s"] > 0) & (n["y"] > 0), 1).otherwise(0)
    ratio = lambda far, both: F.when(both > 0, 100 * (1 - far / both)).otherwise(0.0)
    to_a, to_b = ratio(gap[0] + n["x"], 2 * n["s"] + gap[0] + n["x"]), ratio(gap[1] + n["y"], 2 * n["s"] + gap[1] + n["y"])
    parts = F.when(n["s"] > 0, F.greatest(to_a, to_b)).otherwise(0.0)
    total = 2 * n["s"] + gap[0] + gap[1] + n["x"] + n["y"]
    could = ratio(F.abs(n["x"] - n["y"]), total)
    tried = (could >= least - 1e-9) & (parts < 100)
    c = c.withColumn("__common", common_length(F.when(tried, F.col("__x")), F.when(tried, F.col("__y"))))
    whole = F.when(tried, ratio(n["x"] + n["y"] - 2 * F.coalesce("__common", F.lit(0)), total)).otherwise(0.0)
    score = F.greatest(parts, whole)
    return c.withColumn("__score", score).select(*df.columns, F.when(F.col("__score") >= least - 1e-9, F.col("__score")).alias(out))


def with_grams(df: DataFrame, x: str, words: bool = False) -> DataFrame:
    """df with __grams: the counted trigrams of a string with a mark at each end, or (words) of an array's words, each so marked."""
    marked = lambda t: F.concat(F.lit("\2"), t, F.lit("\3"))
    cut = lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))), lambda k: F.substring(marked(t), k, F.lit(3)))
    raw = df.withColumn("__raw", F.flatten(F.transform(x, cut)) if words else cut(F.col(x)))
    counted = F.expr("transform(__raw, (g, k) -> concat(g, size(filter(slice(__raw, 1, k + 1), other -> other = g))))")
    return raw.withColumn("__grams", counted).drop("__raw")


def _rarest(df: DataFrame, counts: DataFrame, name: str, keep: str) -> DataFrame:
    """(name, __g) for the `keep` rarest of the array column __grams; counts: __g and __df."""
    each = df.select(name, keep, F.explode("__grams").alias("__g")).join(counts, "__g")
    ranked = each.groupBy(name, keep).agg(F.sort_array(F.collect_list(F.struct("__df", "__g"))).alias("__o"))  # as many as the name has letters
    return ranked.select(name, F.explode(F.slice("__o", F.lit(1), F.col(keep).cast("int"))).alias("__o")).select(name, F.col("__o.__g").alias("__g"))


def _counts(*sides: DataFrame) -> DataFrame:
    every = sides[0].select(F.explode("__grams").alias("__g"))
    for s in sides[1:]:
        every = every.unionAll(s.select(F.explode("__grams").alias("__g")))
    counts = every.groupBy("__g").agg(F.count("*").alias("__df"))
    held = counts.agg(F.sum(F.octet_length("__g") + 24)).first()[0] or 0
    return F.broadcast(counts) if held <= GRAM_BYTES else counts


def gram_pairs(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct (a, b) that share one of their rarest grams. left: a, __grams, __edits (how many it allows); right: b likewise."""
    counts = _counts(left, right)
    lhs, rhs = (s.select(x, "__grams", (3 * F.col("__edits") + 1).alias("__keep")) for s, x in ((left, a), (right, b)))
    return _rarest(lhs, counts, a, "__keep").join(_rarest(rhs, counts, b, "__keep"), "__g").select(a, b).distinct()


def letter_bits(x: Column) -> Column:
    """The letters of a string, counted (the second a is its own), as bits of a number: a letter put in or taken out turns one of them."""
    letters = F.split(x, "")
    bit = lambda c, k: F.pmod(F.xxhash64(c, F.size(F.filter(F.slice(letters, F.lit(1), k + 1), lambda other: other == c))), F.lit(64)).cast("int")
    return F.aggregate(F.transform(letters, bit), F.lit(0).cast("long"), lambda bits, k: bits.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), k)))


def close_pairs(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct (a, b) that share one of as many of their rarest grams as the left name's edits can destroy, and one more, and that lie so
    near in length and letters. left: a, __grams, __edits (letters put in or taken out), __n (length), __bits, __share (edits as a share
    of both lengths); right: b, likewise without __share.

    Names meet by gram, edits that the left one allows (a right name lies under each number that occurs) and a bin of lengths."""
    counts = _counts(left, right)
    allowed = sorted(r[0] for r in left.select("__edits").distinct().collect())  # at most as many as the longest name has letters

    def ordered(df: DataFrame, x: str, *columns: str) -> DataFrame:
        each = df.select(x, "__edits", *columns, F.explode("__grams").alias("__g")).join(counts, "__g")
        o = each.groupBy(x, "__edits", *columns).agg(F.sort_array(F.collect_list(F.struct("__df", "__g"))).alias("__o"))  # as many as the name has letters
        return o.select(x, "__edits", *columns, F.posexplode(F.slice("__o", F.lit(1), 3 * F.col("__edits") + 1)).alias("__place", "__w")).withColumn("__g", F.col("__w.__g")).drop("__w")

    bins = F.sequence(F.floor((F.col("__n") - F.col("__edits")) / (F.col("__edits") + 1)), F.floor((F.col("__n") + F.col("__edits")) / (F.col("__edits") + 1)))
    lhs = ordered(left, a, "__n", "__bits", "__share").select(a, "__share", F.col("__n").alias("__na"), F.col("__bits").alias("__bits_a"), "__g", F.col("__edits").alias("__level"), F.explode(bins).alias("__bin"))
    levels = F.filter(F.array(*map(F.lit, allowed)).cast("array<int>"), lambda e: F.col("__place") <= 3 * e)
    rhs = ordered(right, b, "__n", "__bits").select(b, "__n", "__bits", "__g", F.explode(levels).alias("__level")).withColumn("__bin", F.floor(F.col("__n") / (F.col("__level") + 1)))
    met = lhs.join(rhs, ["__g", "__level", "__bin"])
    most = F.col("__share") * (F.col("__na") + F.col("__n")) + 1e-9
    return met.where((F.abs(F.col("__na") - F.col("__n")) <= most) & (F.bit_count(F.col("__bits").bitwiseXOR(F.col("__bits_a"))) <= most)).select(a, b).distinct()


def edit_pairs(left: DataFrame, right: DataFrame, a: str, b: str, allowed) -> DataFrame:
    """(a, b) for all distinct names that can be within the edits that both allow, and few others. allowed: column -> its edits."""
    keyed = lambda df, x: with_grams(df.select(x).distinct(), x).withColumn("__edits", allowed(F.col(x)))
    return gram_pairs(keyed(left, a), keyed(right, b), a, b)


def _dealt(df: DataFrame, *by: str) -> DataFrame:
    """df in as many parts as the session has for a shuffle: names are few bytes and much work."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def token_set_matches(left: DataFrame, right: DataFrame, name: str, code: str, least: float = 92) -> DataFrame:
    """(name, code, score): of each left name the right name with the highest ratio of token sets, if it reaches `least`; of equal
    ones the smallest code. Exact: no pair is passed over.

    A pair can reach it in two ways. Either nearly all letters of one name stand in words that the other has too; then the other
    has one of the rarest words that the one can't do without. Or few letters differ; then they share rare trigrams. The words come
    first: what they find bounds the edits by which another name may still be as good, and names with a full score are done. Where
    half of a name's letters or more are common words and its best partner is poor, the pairs that are looked at still grow with the
    square of such names of one length; those whose letters differ too often are left out before they are moved or scored."""
    share = 1 - least / 100

    def keyed(df: DataFrame, x: str) -> DataFrame:
        t = _dealt(df, x).withColumn("__t", tokens(F.col(x))).where(F.size("__t") > 0).withColumn("__n", F.length(F.array_join("__t", " ")))
        # what a name may lack: 1 + missing <= share * (2 * common + 1 + missing) with common + 1 + missing = n, or nothing at all
        most = F.greatest(F.lit(0), F.floor((share * (2 * F.col("__n") - 1) - 1) / (1 + share) + 1e-9))
        return written(with_grams(t, "__t", words=True).withColumn("__most", most).withColumn("__bits", letter_bits(F.array_join("__t", " "))))

    # dist <= share * (n + m) and m <= n + dist bound the edits by n alone
    edits = lambda part: F.floor(2 * part * F.col("__n") / (1 - part) + 1e-9).cast("int")
    a = keyed(left.select(F.col(name).alias("__a")).distinct(), "__a")
    b = keyed(right.groupBy(F.col(name).alias("__b")).agg(F.min(code).alias(code)), "__b")
    words = lambda df, x: df.select(x, F.explode("__t").alias("__g"))
    sides = words(a, "__a").withColumn("__left", F.lit(1)).unionAll(words(b, "__b").withColumn("__left", F.lit(0)))
    every = sides.groupBy("__g").agg(F.count("*").alias("__df"), (F.max("__left") == 1).alias("__in_a"), (F.min("__left") == 0).alias("__in_b"))
    held = every.agg(F.sum(F.octet_length("__g") + 24)).first()[0] or 0
    every = F.broadcast(every) if held <= GRAM_BYTES else every

    def needed(df: DataFrame, x: str, there: str) -> DataFrame:
        """The rarest words of a name, of which the other must have one; those that no name of the other side has are lacked anyway."""
        o = df.select(x, "__most", F.explode("__t").alias("__g")).join(every, "__g").groupBy(x, "__most").agg(F.sort_array(F.collect_list(F.struct(there, "__df", "__g"))).alias("__o"))
        before = "aggregate(slice(__o, 1, k), 0, (n, w) -> n + length(w.__g))"
        return o.select(x, F.explode(F.expr(f"filter(__o, (w, k) -> w.{there} and {before} <= __most)")).alias("__w")).select(x, F.col("__w.__g").alias("__g"))

    def scored(pairs: DataFrame) -> DataFrame:
        return token_set_ratio(written(_dealt(pairs.join(b.select("__b", code), "__b"), "__a", "__b")), "__a", "__b", "score", least).where("score is not null")

    one = needed(a, "__a", "__in_b").join(words(b, "__b"), "__g").select("__a", "__b")
    other = words(a, "__a").join(needed(b, "__b", "__in_a"), "__g").select("__a", "__b")
    by_words = written(latest(scored(one.unionAll(other).distinct()), ["__a"], F.desc("score"), F.asc(code)).select("__a", code, "score"))
    open_ = a.join(by_words.select("__a", "score"), "__a", "left").where(F.coalesce("score", F.lit(0.0)) < 100 - 1e-9).withColumn("__share", 1 - F.greatest(F.coalesce("score", F.lit(0.0)), F.lit(float(least))) / 100)
    near = close_pairs(open_.withColumn("__edits", edits(F.col("__share"))), b.withColumn("__edits", edits(F.lit(share))), "__a", "__b")
    every_score = by_words.unionByName(scored(near).select("__a", code, "score"))
    return latest(every_score, ["__a"], F.desc("score"), F.asc(code)).select(F.col("__a").alias(name), code, "score")
