"""Draws by a keyed hash: which rows have an MD5 that begins below a bound, for many keys at once.

A row's hash under each of many keys is most of the work of a test with random draws, and one call a hash is most of that; here MD5 is
taken in numpy, step by step over a table of keys and rows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hashes that a task takes, about, and those that are taken together: their tables stay in the cache.
A_TASK, TOGETHER = 20_000_000, 1 << 15

_SHIFTS = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_PLACES = [*range(16), *((5 * i + 1) % 16 for i in range(16)), *((3 * i + 5) % 16 for i in range(16)), *(7 * i % 16 for i in range(16))]
_START = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]


def md5_begins(words: list[np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The first 32 bits of the MD5 of messages of one block: a number in the order of the hash's text. words: the 16 words of the padded
    messages, of a shape that spreads to `shape`."""
    a, b, c, d = (np.full(shape, x) for x in _START)
    t = np.empty(shape, dtype=np.uint32)
    for i in range(61):  # the last three steps make other words
        if i < 16:
            np.bitwise_xor(c, d, out=t)
            t &= b
            t ^= d
        elif i < 32:
            np.bitwise_xor(b, c, out=t)
            t &= d
            t ^= c
        elif i < 48:
            np.bitwise_xor(b, c, out=t)
            t ^= d
        else:
            np.invert(d, out=t)
            t |= b
            t ^= c
        t += a
        t += words[_PLACES[i]] + _SINES[i]
        np.right_shift(t, np.uint32(32 - _SHIFTS[i]), out=a)
        t <<= np.uint32(_SHIFTS[i])
        t |= a
        t += b
        a, b, c, d, t = d, t, b, c, a
    return (b + _START[0]).byteswap()


def row_words(tails: np.ndarray, at: int) -> list[np.ndarray]:
    """The 16 words of padded messages that have these bytes from place `at` on and zeros before, each (1, rows), or (1, 1) if all are equal."""
    own, end = np.zeros((len(tails), 64), dtype=np.uint8), at + tails.shape[1]
    own[:, at:end] = tails
    own[:, end] = 0x80
    own[:, 56:58] = (8 * end & 255, 8 * end >> 8)
    return [np.ascontiguousarray(c[:1] if (c == c[0]).all() else c)[None, :] for c in own.view("<u4").T]


def key_words(prefixes: list[bytes]) -> np.ndarray:
    """(prefixes, 16): the words of messages that begin with these bytes and go on with zeros."""
    return np.frombuffer(b"".join(x.ljust(64, b"\0") for x in prefixes), dtype="<u4").reshape(-1, 16)


def below(df: DataFrame, draws: int, seed: str, tail: str, bound: str, n: int) -> DataFrame:
    """df without tail and bound, with draw (0 to draws - 1): each row under the draws for which the MD5 of seed|draw and tail may begin at
    or below bound, as a number of 32 bits. Where seed, draw and tail are more than a block holds, all draws. n: the rows of df."""
    rest = [c for c in df.columns if c not in (tail, bound)]
    schema = df.select(F.lit(0).alias("draw"), *rest).schema
    keys = [f"{seed}|{k}".encode() for k in range(draws)]
    # where keys are of one length, the words of a row are the same under all
    by_length = [(np.flatnonzero([len(x) == m for x in keys]), m) for m in sorted({len(x) for x in keys})]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [x.encode() for x in b[tail].to_pylist()]
            most, lengths = b[bound].to_numpy(zero_copy_only=False), np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
            for length in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == length)
                for some in np.split(at, range(TOGETHER, len(at), TOGETHER)):
                    tails = np.frombuffer(b"".join(texts[i] for i in some), dtype=np.uint8).reshape(len(some), length)
                    for group, m in by_length:
                        step, found, fits = max(1, TOGETHER // len(some)), [], m + length <= 55
                        rows, used = row_words(tails, m) if fits else None, -(-m // 4)
                        for own in np.split(group, range(step, len(group), step)):
                            shape = (len(own), len(some))
                            if fits:
                                key = key_words([keys[k] for k in own])
                                hit = md5_begins([w | key[:, j, None] if j < used else w for j, w in enumerate(rows)], shape) <= most[some][None, :]
                            else:
                                hit = np.ones(shape, dtype=bool)
                            k, i = np.nonzero(hit)
                            found.append((own[k], some[i]))
                        draw, row = (np.concatenate(x) for x in zip(*found, strict=True))
                        for s in range(0, len(row), 1 << 16):
                            taken = b.select(rest).take(pa.array(row[s : s + (1 << 16)]))
                            yield pa.RecordBatch.from_arrays([pa.array(draw[s : s + (1 << 16)], pa.int32()), *taken.columns], names=schema.names)

    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-n * draws // A_TASK))
    return df.repartition(parts, *rest).mapInArrow(spread, schema)
