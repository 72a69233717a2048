"""Packing token sequences by minimum bin slack.

Each document is its ids and an end id. Whole windows of a long document are sequences of their own; what remains of
each document goes to a pool of lengths. For each window a subset-sum dynamic program over the multiset of lengths,
whose states are the bits of one integer, finds the sum closest to the capacity; walking back gives how many pieces
of each length to take. Slack that no multiset can fill is filled with the head of the largest piece left. The
pool's end is cut at powers of two, which need no padding.

Work is by input partition and in blocks of bounded tokens; there is no shuffle. A sequence's number is made of its
partition's number and a counter, so a task run again gives the same rows.

Defined results: a null or empty text is its end id alone; repeated rows are packed as rows of their own; an empty
table gives no rows; long texts are cut; further columns of the caller are not read, so names cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common
from .word_tokens import ROWS, WordTokens

#: Tokens in the pool at which windows are filled, and down to which.
POOL_HIGH, POOL_LOW = 1 << 21, 1 << 20
SCHEMA = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens")]
)


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths, at most counts of each, whose sum is closest to capacity from below. The program
    stops at the first length, from the largest down, with which the capacity is met."""
    full, mask = 1 << capacity, (1 << (capacity + 1)) - 1
    reach, steps = 1, []
    for length in sorted(counts, reverse=True):
        left, bundle = min(counts[length], capacity // length), 1
        while left:
            n = min(bundle, left)
            steps.append((length, n, reach))
            reach |= (reach << (length * n)) & mask
            left, bundle = left - n, bundle * 2
            if reach & full:
                left = 0
        if reach & full:
            break
    at, taken = reach.bit_length() - 1, {}
    for length, n, before in reversed(steps):
        if not before >> at & 1:
            at -= length * n
            taken[length] = taken.get(length, 0) + n
    return taken


class Packer:
    """Takes documents, gives pieces (doc, start, length, sequence, offset) through take()."""

    def __init__(self, capacity: int):
        self.capacity, self.sequences, self.total = capacity, 0, 0
        self.pool: dict[int, list[tuple[int, int]]] = {}  # length -> (document, start), last in first out
        self.out: list[tuple[int, int, int, int, int, int]] = []

    def add(self, doc: int, tokens: int) -> None:
        whole = tokens // self.capacity
        for i in range(whole):
            self._emit([(doc, i * self.capacity, self.capacity)])
        if rest := tokens - whole * self.capacity:
            self._put(doc, whole * self.capacity, rest)

    def _put(self, doc: int, start: int, length: int) -> None:
        self.pool.setdefault(length, []).append((doc, start))
        self.total += length

    def _pop(self, length: int) -> tuple[int, int, int]:
        doc, start = (rows := self.pool[length]).pop()
        if not rows:
            del self.pool[length]
        self.total -= length
        return doc, start, length

    def _emit(self, pieces: list[tuple[int, int, int]]) -> None:
        at, size = 0, sum(p[2] for p in pieces)
        for doc, start, length in pieces:
            self.out.append((doc, start, length, self.sequences, at, size))
            at += length
        self.sequences += 1

    def window(self, capacity: int) -> None:
        """Fill one sequence of exactly capacity tokens; the pool holds as many."""
        taken = fill({k: len(v) for k, v in self.pool.items() if k <= capacity}, capacity)
        pieces = [self._pop(length) for length, n in taken.items() for _ in range(n)]
        slack = capacity - sum(p[2] for p in pieces)
        while slack:
            doc, start, length = self._pop(max(self.pool))
            pieces.append((doc, start, min(length, slack)))
            if length > slack:
                self._put(doc, start + slack, length - slack)
            slack -= min(length, slack)
        self._emit(pieces)

    def drain(self, low: int) -> None:
        while self.total >= max(low, self.capacity):
            self.window(self.capacity)

    def finish(self) -> None:
        """Whole windows, then sequences whose sizes are falling powers of two."""
        self.drain(0)
        while self.total:
            self.window(1 << (self.total.bit_length() - 1))


def pack(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = 4096, end_id: int = 2) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, packer, first = WordTokens.of(path), Packer(capacity), TaskContext.get().partitionId() << 40
        held: dict[int, tuple[int, bytes, int]] = {}  # document's number here -> its id, its ids, its tokens not yet out
        end, number = np.array([end_id], "<u4").tobytes(), 0

        def rows() -> pa.RecordBatch:
            out = []
            for doc, start, length, sequence, offset, size in packer.out:
                name, data, left = held[doc]
                out.append((name, start, length, zlib.crc32(data[4 * start : 4 * (start + length)]), len(data) // 4, first + sequence, offset, size))
                if left == length:
                    del held[doc]
                else:
                    held[doc] = name, data, left - length
            packer.out = []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [()] * 8)], names=SCHEMA.names)

        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                for name, ids in zip(b.column(doc_id).to_pylist(), tokens.encode(b.column(text))):
                    held[number] = name, ids + end, len(ids) // 4 + 1
                    packer.add(number, len(ids) // 4 + 1)
                    number += 1
                    if packer.total > POOL_HIGH:
                        packer.drain(POOL_LOW)
                yield rows()
        packer.finish()
        yield rows()

    return df.select(doc_id, text).mapInArrow(run, SCHEMA)


def op1_packing(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    import public_tokenizers

    common.ship(spark)
    return pack(common.table(spark, sf_dir, "documents"), path or public_tokenizers.path("word_bpe_49k.json"))
