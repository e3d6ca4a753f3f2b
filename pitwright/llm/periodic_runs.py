"""Runs of repeated words, found online by catchers over blocks whose lengths are powers of two.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) that no neighbouring word
extends; it holds a square, two equal neighbouring stretches of q words. Words come one at a time. When word m completes a
block of 2^k words that starts at a multiple of 2^k, the block gets a catcher; equal blocks share a name, which is the pair
of its halves' names. A square with period q from 2^(k+1) - 1 to 2^(k+2) - 2 holds such a block in its first half, so the
catchers of level k watch just these periods: as a word comes, the names of the last 1, 2, 4, ... words are looked up, as
long as a catcher has such a name, and where a catcher of that name stands q words back, the two copies are compared
backwards from there. What is equal further back says which word can complete the square; when that word has come, the
comparison goes on, and a square is reported or the pair given up. A reported square grows with each word until one
differs; all squares of one stretch and period so merge into one run.

A word asks for as many names as its longest suffix that some block has had, mostly one or two; at most about five
catchers of a level are near enough; the runs that are growing at one word are few, as their periods grow geometrically.
Pairs inside a growing run whose period divides theirs are passed over: the stretch isn't primitive there.

All state is one document's, so nothing is shuffled, and a task that is lost is run again on its rows.

Defined results: a null or empty text has no words and no runs, and its collapsed text is empty; a null id is handed on;
repeated rows give equal rows; a very long text is one document's state, some hundred bytes a word at worst; an empty table
gives no rows; extra columns are passed over.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_LENGTH, MIN_EXPONENT = 6, 4
SCHEMA = "runs array<struct<start:long,length:long,period:long>>, n_words long, collapsed string"


def _equal_back(ids: list[int], i: int, j: int) -> int:
    """How many words before i equal those before j > i, one by one."""
    n, step = 0, 1
    while n + step <= i and ids[i - n - step : i - n] == ids[j - n - step : j - n]:
        n, step = n + step, 2 * step
    while step:
        if n + step <= i and ids[i - n - step : i - n] == ids[j - n - step : j - n]:
            n += step
        step //= 2
    return n


class Catchers:
    """The state of one text: append its words' ids in order, then finish; `runs` then holds (start, length, period) of all
    runs with two periods at least."""

    def __init__(self) -> None:
        self.ids: list[int] = []
        self.names: list[dict[int, int]] = [{}]  # by level: halves' names -> name of a block, which is the first word of the first such block
        self.blocks: list[list[int]] = [[]]  # by level: the names of the blocks in order
        self.suffix: list[dict[int, int]] = [{}]  # by level: last word -> name of the 2^k words up to it, where these are no block
        self.again: list[dict[int, list[int]]] = [{}]  # by level and name: where the last catchers after the first stand
        self.growing: dict[int, int] = {}  # period -> first word of a run that this word continues
        self.awaited: dict[int, int] = {}  # period -> word that can complete its square
        self.due: dict[int, list[int]] = defaultdict(list)
        self.closed: dict[tuple[int, int], int] = {}

    def _close(self, period: int, end: int) -> None:
        start = self.growing.pop(period)
        known = self.closed.get((start, end))
        self.closed[start, end] = period if known is None else min(period, known)

    def _compare(self, m: int, q: int, least: int) -> None:
        """The words up to m against those q before: a square, a word to wait for, or less than `least` equal words."""
        n = _equal_back(self.ids, m + 1 - q, m + 1)
        if n >= q:
            self.growing[q] = m + 1 - q - n
        elif n >= least:
            self.awaited[q] = m + q - n
            self.due[m + q - n].append(q)

    def _catch(self, m: int, start: int, q: int, size: int) -> None:
        """A catcher of `size` words at start, a copy of it q words on that ends with word m."""
        if q in self.growing or q in self.awaited or any(q % p == 0 and first <= start for p, first in self.growing.items()):
            return
        self._compare(m, q, size)

    def extend(self, words: list[int]) -> None:
        ids, names, blocks, suffix, again, growing, due = self.ids, self.names, self.blocks, self.suffix, self.again, self.growing, self.due
        before = older = ids[-1] if ids else -1
        if len(ids) > 1:
            older = ids[-2]
        for m, word in enumerate(words, len(ids)):
            ids.append(word)
            if growing:
                for q in [q for q in growing if word != ids[m - q]]:
                    self._close(q, m)
            if due and m in due:
                for q in due.pop(m):
                    del self.awaited[q]
                    self._compare(m, q, 1 << ((q + 1).bit_length() - 2))
            if before == word:
                self._catch(m, m - 1, 1, 1)
            if older == word and m > 1:
                self._catch(m, m - 2, 2, 1)
            last, name, older, before, k, size, start = before, word, before, word, 1, 2, m - 1
            while start >= 0:
                if k == len(names):
                    names.append({})
                    blocks.append([])
                    suffix.append({})
                    again.append({})
                pair = last << 32 | name
                if start & (size - 1):
                    name = names[k].get(pair)
                    if name is None:
                        break
                    suffix[k][m] = name
                    last = suffix[k].get(m - size)
                else:
                    name = names[k].setdefault(pair, start)
                    row = blocks[k]
                    last = row[-1] if row else None
                    row.append(name)
                    if name == start:  # the first such block; only as the second half of a larger one it goes on
                        if not start & size:
                            break
                        k, size, start = k + 1, 2 * size, start - size
                        continue
                    again[k].setdefault(name, []).append(start)
                if start - name <= 4 * size - 2:
                    near = [name, *again[k].get(name, ())]
                else:
                    near = again[k].get(name, ())
                for s in near:
                    if 2 * size - 1 <= start - s <= 4 * size - 2:
                        self._catch(m, s, start - s, size)
                if len(near) > 8:
                    del again[k][name][:-5]
                if last is None:
                    break
                k, size, start = k + 1, 2 * size, start - size

    def finish(self) -> list[tuple[int, int, int]]:
        for q in list(self.growing):
            self._close(q, len(self.ids))
        return sorted((start, end - start, q) for (start, end), q in self.closed.items())


def word_runs(words: list[bytes], min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of at least min_length words and min_exponent (2 or more) periods, in order."""
    known: dict[bytes, int] = {}
    caught = Catchers()
    caught.extend([known.setdefault(w, len(known)) for w in words])
    return [r for r in caught.finish() if r[1] >= max(min_length, min_exponent * r[2])]


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run holds after its first period, joined by blanks."""
    if not runs:
        return b" ".join(words)
    keep = bytearray(b"\1") * len(words)
    for start, length, period in runs:
        keep[start + period : start + length] = bytes(length - period)
    return b" ".join([w for w, k in zip(words, keep, strict=True) if k])


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """For every row its id, runs (array of start, length, period in order), n_words and collapsed, the text without repetitions."""
    kind = docs.schema[id_col].dataType.simpleString()

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text in b["text"]:
                words = bytes(text).split() if text is not None else []  # at the six ASCII blanks, as bytes are split
                runs = word_runs(words, min_length, min_exponent)
                rows.append(([{"start": s, "length": n, "period": q} for s, n, q in runs], len(words), collapse(words, runs).decode("utf-8", "replace")))
            out = pd.DataFrame(rows, columns=["runs", "n_words", "collapsed"])
            out.insert(0, "id", b["id"].to_numpy())
            yield out

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInPandas(found, f"id string, {SCHEMA}").withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)
