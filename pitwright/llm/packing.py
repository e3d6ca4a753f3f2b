"""Packing documents into windows of a fixed number of tokens by the online sum-of-squares rule.

A document's tokens are its ids and an end id. Full windows are cut off its front; the rest, of size s, is placed so that
the sum over levels of the squared number of partially filled windows at that level becomes least: with n[h] windows
filled to h, moving one from h to h + s changes the sum by 2 * (n[h + s] - n[h]) + 2, a new one to s by 2 * n[s] + 1, and one
that becomes full by 1 - 2 * n[h]. The
level array holds the open windows of a task, at most one document rest for each piece; a window is written when it is
full. At the end of a task's rows the level array is emptied from both ends: the emptiest windows are dissolved, and their
pieces are cut to fill up the fullest ones, so that what moves is no more than what the open windows lack; the last rest is
cut into windows whose lengths are powers of two, which need no padding.

Rows are packed where they lie: tasks don't exchange documents, and the window ids of a task begin with its number.

Defined results: a null text counts as empty; an empty text is one end token; equal rows are packed one by one; a very
long text is cut into as many windows as it fills, long white space too; ids of rows are numbers (a text id is an error); an
empty table has no pieces; extra columns are passed over. Which
window a document is in depends on the order of rows; that every token is in one piece doesn't.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH, END = 1024, 0
TOKENIZER = "byte_bpe_50k"
#: Runs of white space of so many characters are cut out before words are searched for.
BLANK = 50_000
LONG_BLANK = re.compile(rf"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{{{BLANK},}}")
COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


class Packer:
    """The windows of one task. A piece is (document, start, ids, tokens of the document)."""

    def __init__(self, length: int, first: int) -> None:
        self.length, self.next = length, first
        self.open: dict[int, list[list]] = defaultdict(list)  # level -> windows, each a list of pieces
        self.counts = np.zeros(length + 1, dtype=np.int64)
        self.rows: list[tuple] = []

    def close(self, pieces: list) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next, at))
            at += len(ids)
        self.next += 1

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        total, full = len(ids), len(ids) // self.length * self.length
        for at in range(0, full, self.length):
            self.close([(doc, at, ids[at : at + self.length], total)])
        if full < total:
            self.place((doc, full, ids[full:], total))

    def place(self, piece: tuple) -> None:
        s, n = len(piece[2]), self.counts
        gains = 2 * n[s:] + 2  # at h: by the window that comes to h + s
        gains[0] -= 1  # a new window leaves no level
        gains[-1] = 1  # a full one comes to none
        gains[1:] -= 2 * n[1 : self.length - s + 1]
        # at level 0 a window can always be opened; others must have one
        cost = np.where(n[: self.length - s + 1] > 0, gains, np.iinfo(np.int64).max)
        cost[0] = gains[0]
        h = int(len(cost) - 1 - np.argmin(cost[::-1]))  # of equal costs the fullest
        pieces = self.open[h].pop() if h else []
        n[h] -= h > 0
        pieces.append(piece)
        if h + s == self.length:
            self.close(pieces)
        else:
            self.open[h + s].append(pieces)
            n[h + s] += 1

    def finish(self) -> None:
        """Close what is open: the emptiest windows are dissolved, and their pieces cut to fill up the fullest ones, which keep
        what they hold. Only the rest of the last one is laid into windows of powers of two."""
        windows = [(h, pieces) for h in sorted(self.open) for pieces in self.open[h]]
        left: list[tuple] = []
        while windows and (len(windows) > 1 or left):
            if not left:
                left = windows.pop(0)[1]
            room = self.length - windows[-1][0]
            doc, start, ids, total = left.pop(0)
            if len(ids) > room:
                left.insert(0, (doc, start + room, ids[room:], total))
            filled, pieces = windows[-1][0] + min(room, len(ids)), [*windows[-1][1], (doc, start, ids[:room], total)]
            if filled == self.length:
                windows.pop()
                self.close(pieces)
            else:
                windows[-1] = (filled, pieces)
        left = left or [p for _, pieces in windows for p in pieces]
        size = sum(len(p[2]) for p in left)
        while size:
            room, window = self._room(size), []
            size -= room
            while room:
                doc, start, ids, total = left.pop(0)
                window.append((doc, start, ids[:room], total))
                if len(ids) > room:
                    left.insert(0, (doc, start + room, ids[room:], total))
                room -= len(window[-1][2])
            self.close(window)
        self.open.clear()
        self.counts[:] = 0

    def _room(self, left: int) -> int:
        return self.length if left >= self.length else 1 << (max(1, left).bit_length() - 1)


def encoder(folder_path: str):
    """ids of a text, as the byte-level tokenizer of that vocabulary gives them; its ranks are the same vocabulary's ids,
    and merge several times as fast."""
    import public_tokenizers
    import tiktoken

    with open(folder_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    special = "<|endoftext|>"
    coding = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={special: len(ranks)})
    plain = lambda text: coding.encode(text, allowed_special="all") if special in text else coding.encode_ordinary(text)

    def ids(text: str) -> np.ndarray:
        found, at = [], 0
        # a run of white space is one word of the pattern, but for a last character before other text; the pattern's own search
        # gives up on very long ones
        for run in LONG_BLANK.finditer(text) if len(text) >= BLANK else ():
            end = run.end() if run.end() == len(text) or text.startswith(special, run.end()) else run.end() - 1
            found += [*plain(text[at : run.start()]), *coding._encode_single_piece(text[run.start() : end])]
            at = end
        return np.asarray([*found, *plain(text[at:])] if at else plain(text), dtype="<u4")

    return ids


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end: int = END, vocabulary: str | None = None) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    vocabulary: a file of token ranks on every executor; by default the public one of TOKENIZER.
    """

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import public_tokenizers
        from pyspark import TaskContext

        encode = encoder(vocabulary or str(public_tokenizers.path(f"{TOKENIZER}.tiktoken")))
        packer = Packer(length, TaskContext.get().partitionId() << 40)
        stop = np.array([end], dtype="<u4")

        def rows() -> pd.DataFrame:
            out = pd.DataFrame(packer.rows, columns=COLUMNS)
            packer.rows = []
            return out.astype({"doc_id": object})

        for b in batches:
            for doc, text in zip(b["id"], b["text"], strict=True):
                packer.add(doc, np.concatenate([encode(text or ""), stop]))
            yield rows()
        packer.finish()
        yield rows()

    rows = docs.select(F.col(id_col).cast("decimal(20,0)").alias("id"), F.col(text_col).alias("text"))
    schema = "doc_id decimal(20,0), start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return rows.mapInPandas(packed, schema).withColumn("doc_id", F.col("doc_id").cast("long")).withColumnRenamed("doc_id", id_col)
