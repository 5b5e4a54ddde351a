"""Numpy views of Arrow text batches, shared by the operators of this folder.

A *block* is the UTF-8 bytes of some whole texts, one after the other, with
their offsets. Work on a block is vectorised over all its texts at once, so
memory is about a hundred bytes per byte of the block: ``BLOCK_BYTES`` or the
longest single text, whichever is larger.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

BLOCK_BYTES = 1 << 18
BATCH_ROWS = 500
SPACES = b" \t\n\x0b\x0c\r"

_BASE = 0x9E3779B97F4A7C15 | 5  # odd, so it has an inverse modulo 2^64
_INVERSE = pow(_BASE, -1, 1 << 64)
_LETTER = np.random.default_rng(20240229).integers(0, 1 << 64, 256, dtype=np.uint64) | np.uint64(1)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Block(NamedTuple):
    first: int  # row of the batch at which the block starts
    data: np.ndarray  # uint8
    off: np.ndarray  # int64, one more than there are texts

    @property
    def rows(self) -> int:
        return len(self.off) - 1

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sum of one value per byte, for each text."""
        total = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.off[1:]] - total[self.off[:-1]]


def small_batches(spark: SparkSession) -> None:
    """Bound the rows Spark hands to Python at once: texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + n + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        to = min(to, n)
        yield Block(at, data[off[at]:off[to]], off[at:to + 1] - off[at])
        at = to


@lru_cache(maxsize=8)
def _powers_of(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(size: int, inverse: bool = False) -> np.ndarray:
    size = max(1 << 16, 1 << max(0, size - 1).bit_length())
    return _powers_of(_INVERSE if inverse else _BASE, size)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit over the word (xor-shift, multiply)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


class Hasher:
    """Hashes of any substrings of a block, from one prefix sum."""

    def __init__(self, data: np.ndarray, salt: int = 0) -> None:
        n = len(data)
        letters = mix(_LETTER + np.uint64(salt)) if salt else _LETTER
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(letters[data] * powers(n + 1)[:n], out=self.sums[1:])
        self.back = powers(n + 1, True)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start]
                   + (end - start).astype(np.uint64))


class Words(NamedTuple):
    start: np.ndarray  # byte positions in the block
    end: np.ndarray
    text: np.ndarray  # index of the text each word is in
    first: np.ndarray  # index of the first word of each text, one more than texts

    def windows(self, n: int) -> np.ndarray:
        """Indexes of the words at which n words of one text start."""
        at = np.arange(max(0, len(self.start) - n + 1))
        return at[self.text[at] == self.text[at + n - 1]] if len(at) else at


def find_words(block: Block, space: np.ndarray = IS_SPACE) -> Words:
    """Maximal runs of bytes that are not in ``space``, never across texts."""
    word = ~space[block.data]
    n = len(word)
    edge = np.zeros(n + 1, bool)
    edge[block.off] = True
    before = np.zeros(n + 1, bool)
    before[1:] = word
    now = np.zeros(n + 1, bool)
    now[:n] = word
    start = np.flatnonzero(now & (~before | edge))
    end = np.flatnonzero(before & (~now | edge))
    text = np.searchsorted(block.off, start, "right") - 1
    return Words(start, end, text, np.searchsorted(start, block.off))


def window_hashes(words: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Rolling hash of the n word hashes from each index in ``at``."""
    total = np.zeros(len(at), np.uint64)
    for j in range(n):
        total = total * np.uint64(_BASE) + words[at + j]
    return mix(total)


def strings(values) -> pa.Array:
    return pa.array(values, pa.string())
