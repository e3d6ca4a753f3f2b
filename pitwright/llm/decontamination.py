"""Benchmark decontamination by spaced seeds, with DataFrame functions only.

Masks fix some of the word positions of a span and ignore the others, so a substituted word destroys only the seeds that
fix its position. Each position of each training text is hashed under each mask and joined to the hashes of the
benchmark; around a hit both texts are laid side by side on the hit's diagonal, and the item is found there if in some
window of WINDOW words (or in the whole item, if it is shorter) at least SIMILARITY of the words agree.

The masks lose nothing: of n >= 5 words of which at most a fifth differ, cut into n / 5 runs of five, a run with one word
that differs keeps a seed, as for each place some mask fixes the four others, and for each further one that differs another
run has none and keeps five. So each diagonal to be found has n / 5 seeds or more (n: the item's words, 20 at most), and
those with fewer are passed over unread. Items of up to three words, in which none may differ, have one seed, of all their
words. In scripts without spaces each character is a word.

Seeds and texts of the benchmark, and the diagonals that are left, are each counted before they are joined: up to
BROADCAST_BYTES of them are broadcast, so that no text is shuffled; more are joined by shuffling hashes, or texts by row.

Defined results: null and empty texts have no seeds and no hits; a benchmark item without words is not
looked for; equal rows of training texts are found alike; equal items are found
under each of their ids. Extra columns are passed over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitwright.llm.common import BROADCAST_BYTES, cut, positional, row_key
from pitwright.llm.quality import shifted

#: Fixed positions are 1; each four of five words, those without the first or the last one being the same.
MASKS = ("1111", "10111", "11011", "11101")
#: Whole items of fewer words than the shortest mask.
SHORT = ("1", "11", "111")
UNSPACED = r"([\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}])"
WINDOW, SIMILARITY = 20, 0.8
#: Bytes that a row of seeds or of diagonals takes where it is broadcast, at most.
ROW_BYTES = 96


def words_of(text: Column) -> Column:
    lowered = F.lower(F.coalesce(text, F.lit("")))
    apart = F.when(lowered.rlike(UNSPACED), F.regexp_replace(lowered, UNSPACED, " $1 ")).otherwise(lowered)
    return F.array_remove(F.split(apart, r"[^\p{L}\p{N}]+"), "")


def seeds(rows: DataFrame, masks: tuple[str, ...], keys: list[str]) -> DataFrame:
    """keys, pos and seed: a row for each position and mask of rows' column words."""
    span = max(map(len, masks))
    at = F.arrays_zip(*(c.alias(f"w{j}") for j, c in enumerate(shifted(F.col("words"), span))))
    spread = rows.select(*keys, F.posexplode(at).alias("pos", "at"))
    hashes = [F.when(F.col(f"at.w{len(m) - 1}").isNotNull(), F.xxhash64(F.lit(m), *(F.col(f"at.w{j}") for j, bit in enumerate(m) if bit == "1"))) for m in masks]
    return spread.select(*keys, "pos", F.explode(F.array(*hashes)).alias("seed")).where("seed is not null")


def overlap(words: Column, item: Column, shift: Column) -> dict[str, Column]:
    """How the item agrees with the words that it lies beside when its first word is at place `shift`: n_matched in all,
    and best, the largest number of matches in a window, as a share of the window."""
    start = F.greatest(shift, F.lit(0))
    n = F.greatest(F.least(F.size(item) - (start - shift), F.size(words) - start), F.lit(0))
    same = F.zip_with(F.slice(words, start + 1, n), F.slice(item, start - shift + 1, n), lambda x, y: (x == y).cast("int"))
    width = F.least(F.lit(WINDOW), F.size(item))
    total = F.aggregate(same, F.lit(0), lambda x, y: x + y)
    # sums of all windows: a running queue of the last `width` outcomes, in one pass
    gain = F.zip_with(same, F.concat(F.array_repeat(F.lit(0), width), same), lambda x, y: F.coalesce(x, F.lit(0)) - F.coalesce(y, F.lit(0)))
    zero = F.struct(F.lit(0).alias("run"), F.lit(0).alias("top"))
    best = F.aggregate(gain, zero, lambda s, g: F.struct((s["run"] + g).alias("run"), F.greatest(s["top"], s["run"] + g).alias("top")), lambda s: s["top"])
    return {"n_matched": total, "width": width, "best": best}


def _verified(hits: DataFrame, keys: list[str]) -> DataFrame:
    cols = overlap(F.col("words"), F.col("item_words"), F.col("shift"))
    a = hits.select(*keys, "item_id", "shift", cols["n_matched"].alias("n_matched"), cols["width"].alias("width"), cols["best"].alias("best")).where(F.col("best") >= SIMILARITY * F.col("width"))
    top = F.max(F.struct((F.col("best") / F.col("width")).alias("similarity"), F.col("n_matched"), (-F.col("shift")).alias("back"))).alias("top")
    return a.groupBy(*keys, "item_id").agg(top).select(*keys, "item_id", F.col("top.n_matched").cast("long").alias("n_matched"), F.col("top.similarity").alias("similarity"), (-F.col("top.back")).cast("long").alias("first_word"))


def seeds_needed(words: Column) -> Column:
    """So many seeds has each diagonal on which an item of these words is to be found, at least."""
    return F.greatest(F.floor(F.least(F.size(words), F.lit(WINDOW)) / 5), F.lit(1)).cast("int")


def find(docs: DataFrame, benchmark: DataFrame, keys: list[str], text_col: str = "text", item_id: str = "item_id", item_text: str = "text", masks: tuple[str, ...] = MASKS, limit: int = BROADCAST_BYTES) -> DataFrame:
    """keys, item_id, n_matched, similarity (of the best window) and first_word (the word of the text beside the item's first
    word; below 0 if the text begins within the item): a row for each text and item found in it."""
    items = benchmark.select(F.col(item_id).alias("item_id"), words_of(F.col(item_text)).alias("item_words"))
    worded = items.withColumnRenamed("item_words", "words").withColumn("needed", seeds_needed(F.col("words")))
    own = seeds(worded, masks, ["item_id", "needed"])
    size = F.coalesce(F.sum(F.octet_length(F.array_join("item_words", " ")) + 16 * F.size("item_words") + ROW_BYTES), F.lit(0))
    item_bytes, lengths = items.agg(size, F.collect_set(F.when(F.size("item_words").between(1, len(SHORT)), F.size("item_words")))).first()
    short = tuple(m for m in SHORT if len(m) in lengths)
    for m in short:
        own = own.unionAll(seeds(worded.where(F.size("words") == len(m)), (m,), ["item_id", "needed"]))
    own = cut(own.select("item_id", "needed", F.col("pos").alias("ipos"), "seed"), "seeds")
    # the row's own hash finds its text again: a row may lack an id, or share it
    k1, k2 = (k.alias(f"__row{i}") for i, k in enumerate(row_key(docs)))
    rows = docs.select(k1, k2, words_of(F.col(text_col)).alias("words"))
    hits = seeds(rows, masks + short, ["__row0", "__row1"]).join(F.broadcast(own) if own.count() * ROW_BYTES <= limit else own, "seed")
    diagonals = hits.groupBy("__row0", "__row1", "item_id", "needed", (F.col("pos") - F.col("ipos")).alias("shift")).count()
    places = cut(diagonals.where(F.col("count") >= F.col("needed")).select("__row0", "__row1", "item_id", "shift"), "hits")
    texts = docs.select(*keys, k1, k2, F.col(text_col).alias("__text"))
    laid = texts.join(F.broadcast(places) if places.count() * ROW_BYTES <= limit else places, ["__row0", "__row1"])
    placed = laid.join(F.broadcast(items) if item_bytes <= limit else items, "item_id")
    return _verified(placed.select("*", words_of(F.col("__text")).alias("words")), keys)


def without(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of docs in whose text no benchmark item is found."""
    columns = docs.columns
    docs, at = positional(docs)
    k1, k2 = row_key(docs)
    keyed = docs.select("*", k1, k2)
    found = cut(find(keyed, benchmark, ["__k1", "__k2"], at[text_col], **options).select("__k1", "__k2").distinct(), "contaminated")
    return keyed.join(found, ["__k1", "__k2"], "left_anti").drop("__k1", "__k2").toDF(*columns)
