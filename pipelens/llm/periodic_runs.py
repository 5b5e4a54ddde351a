"""Periodic run detection by internal pattern matching (operator 11).

A run is a stretch of consecutive words of one text with smallest period q
(words q apart are equal) and length >= max(24, 3q) that no neighbouring word
extends. All runs of a text are found, and the text is collapsed: of each run
the first q words stay.

Method. Words become numbers, distinct for each text of a block. Prefix doubling
gives, for every level k, the rank of the 2^k words from each place, and at its
end the suffix array; equal ranks are a range of that array. A run of period
q >= 8 holds a dyadic block (2^k words from a multiple of 2^k, 2^k <= q < 2^(k+1))
whose copy one period on starts in the window of distances [2^k, 2^(k+1)]; for
q < 8 a block of eight words and the distances [1, 8] do. A wavelet tree over the
suffix array answers, by range successor, where a block occurs in its window.
At most two places are candidates themselves. More of them are a progression,
whose difference d is the block's own period; then both the block and the first
place lie in stretches of period d, and the distance of their starts or of their
ends is the candidate. Every candidate is extended both ways by the rank tables
(exactly, by descending levels) and kept if it is long enough; of equal stretches
the smallest period stays. Texts without a repeated window of eight words have no
run and skip all this.

One ``mapInArrow`` without a shuffle. Words are compared by 64-bit hashes; memory
is about two hundred bytes per byte of a block or of the longest single text.

Defined results: a null or empty text has no words, no runs and an empty
collapsed text; rows are judged alone, so repeated rows and rows with equal or
null ids each give a row; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipelens.llm import blocks as B

#: Least length of a run in words and in periods; first level of the blocks:
#: 2^3 words and the largest short period fit into 24 wherever the run starts.
LEAST, TIMES, FIRST_LEVEL = 24, 3, 3

SCHEMA = ("doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, "
          "collapsed string")
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class WaveletTree:
    """A wavelet tree (as a matrix: one stable split by bit and level) over
    numbers below its length; all queries are vectors of queries."""

    def __init__(self, values: np.ndarray) -> None:
        self.bits = max(1, len(values).bit_length())
        self.zeros = []
        for b in reversed(range(self.bits)):
            zero = (values >> b) & 1 == 0
            self.zeros.append(np.concatenate([[0], np.cumsum(zero)]))
            values = np.concatenate([values[zero], values[~zero]])

    def less(self, left: np.ndarray, right: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many of the numbers at [left, right) are below x."""
        count, above = np.zeros(len(x), np.int64), x >= 1 << self.bits
        all_of = right - left
        for b, z in zip(reversed(range(self.bits)), self.zeros, strict=True):
            one, zl, zr = (x >> b) & 1 == 1, z[left], z[right]
            count += np.where(one, zr - zl, 0)
            left = np.where(one, left - zl + z[-1], zl)
            right = np.where(one, right - zr + z[-1], zr)
        return np.where(above, all_of, count)

    def nth(self, left: np.ndarray, right: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The number at [left, right) that has n smaller ones there."""
        value = np.zeros(len(n), np.int64)
        for b, z in zip(reversed(range(self.bits)), self.zeros, strict=True):
            zl, zr = z[left], z[right]
            one = n >= zr - zl
            value |= one.astype(np.int64) << b
            n = np.where(one, n - (zr - zl), n)
            left = np.where(one, left - zl + z[-1], zl)
            right = np.where(one, right - zr + z[-1], zr)
        return value

    def between(self, left, right, low, high):
        """Range successors: how many of the numbers at [left, right) lie in
        [low, high], the first two of them and the last (0 where there is none)."""
        before = self.less(left, right, low)
        count = self.less(left, right, high + 1) - before
        out = [np.zeros(len(left), np.int64) for _ in range(3)]
        for k, (nth, least) in enumerate(((before, 1), (before + 1, 2), (before + count - 1, 1))):
            has = np.flatnonzero(count >= least)
            out[k][has] = self.nth(left[has], right[has], nth[has])
        return count, *out


class Ranks:
    """Rank of the 2^k symbols from each place, for every level k at which two
    places are equal, and the suffix array."""

    def __init__(self, symbols: np.ndarray) -> None:
        n = len(symbols)
        self.size, self.levels, self.counts = n, [], []
        key = symbols.astype(np.int64)
        while True:
            _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
            rank = (np.cumsum(counts) - counts)[inverse]
            if len(counts) == n:
                break
            self.levels.append(rank)
            self.counts.append(counts[inverse])
            step = 1 << (len(self.levels) - 1)
            follow = np.full(n, -1, np.int64)
            follow[:max(0, n - step)] = rank[step:]
            key = rank * (n + 1) + follow + 1
        self.suffixes = np.empty(n, np.int64)
        self.suffixes[rank] = np.arange(n)

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Longest common extension to the right of the places a < b."""
        begin = b
        for k in reversed(range(len(self.levels))):
            rank, last = self.levels[k], self.size - 1
            same = (b + (1 << k) <= self.size) & (rank[np.minimum(a, last)] == rank[np.minimum(b, last)])
            a, b = a + (same << k), b + (same << k)
        return b - begin

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Longest common extension to the left, places a < b excluded."""
        begin = b
        for k in reversed(range(len(self.levels))):
            rank, at = self.levels[k], a - (1 << k)
            same = (at >= 0) & (rank[np.maximum(at, 0)] == rank[np.maximum(b - (1 << k), 0)])
            a, b = a - (same << k), b - (same << k)
        return begin - b


def candidates(ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) pairs, among them one of every run."""
    tree = WaveletTree(ranks.suffixes)
    places, periods = [], []

    def add(at, period, which):
        places.append(at[which])
        periods.append(period[which])

    for k in range(FIRST_LEVEL, len(ranks.levels)):
        m = 1 << k
        at = np.arange(0, ranks.size - m + 1, m)
        at = at[ranks.counts[k][at] > 1]
        left = ranks.levels[k][at]
        right = left + ranks.counts[k][at]
        if k == FIRST_LEVEL:
            count, first, _, _ = tree.between(left, right, at + 1, at + m)
            add(at, first - at, count > 0)
        count, first, second, last = tree.between(left, right, at + m, at + 2 * m)
        add(at, first - at, count > 0)
        add(at, last - at, count > 1)
        more = np.flatnonzero(count > 2)
        at, first, step = at[more], first[more], (second - first)[more]
        ends = first + ranks.forward(first, first + step) - at - ranks.forward(at, at + step)
        starts = first - ranks.backward(first, first + step) - at + ranks.backward(at, at + step)
        for period in (ends, starts):
            add(at, period, (period >= m) & (period <= 2 * m) & (at + period < ranks.size))
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(places), np.concatenate(periods)


def runs_of(symbols: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs, by start and then by period."""
    ranks = Ranks(symbols)
    at, q = candidates(ranks)
    start = at - ranks.backward(at, at + q)
    end = at + q + ranks.forward(at, at + q)
    long = end - start >= np.maximum(least, TIMES * q)
    start, end, q = start[long], end[long], q[long]
    order = np.lexsort((q, end, start))
    start, end, q = start[order], end[order], q[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, q = start[new], end[new], q[new]
    order = np.lexsort((q, start))
    return start[order], end[order], q[order]


def _repeated(keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    out = np.zeros(len(keys), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def scan_block(block: B.Block, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]:
    """Words, run offsets, runs and collapsed texts of a block's texts."""
    words = B.find_words(block)
    own = B.Hasher(block.data)(words.start, words.end)
    own = own + B.mix(words.text.astype(np.uint64) + np.uint64(1))
    window = 1 << FIRST_LEVEL
    at = words.windows(window)
    at = at[_repeated(B.window_hashes(own, at, window))]
    taken = np.zeros(block.rows, bool)
    taken[words.text[at]] = True
    places = np.flatnonzero(taken[words.text])
    start = end = period = np.zeros(0, np.int64)
    if len(places):
        start, end, period = runs_of(np.unique(own[places], return_inverse=True)[1], least)
        # runs lie in one text, whose words stand together
        start, length = places[start], end - start
    else:
        length = end
    dropped = np.zeros(len(own) + 1, np.int64)
    np.add.at(dropped, start + period, 1)
    np.add.at(dropped, start + length, -1)
    kept = np.flatnonzero(np.cumsum(dropped[:-1]) == 0)
    text = words.text[start]
    runs = pa.StructArray.from_arrays(
        [pa.array(start - words.first[text]), pa.array(length), pa.array(period)], fields=list(_RUN))
    offsets = np.searchsorted(text, np.arange(block.rows + 1)).astype(np.int32)
    return np.diff(words.first), offsets, runs, _joined(block, words, kept)


def _joined(block: B.Block, words: B.Words, kept: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space."""
    size = words.end[kept] - words.start[kept] + 1
    after = np.cumsum(size)
    total = int(after[-1]) if len(after) else 0
    at = np.arange(total) + np.repeat(words.start[kept] - (after - size), size)
    data = block.data[np.minimum(at, max(0, len(block.data) - 1))] if total else np.zeros(0, np.uint8)
    data[after - 1] = 32
    # one space less after the last word of each text
    last = np.zeros(len(kept), bool)
    if len(kept):
        last[:-1] = words.text[kept[1:]] != words.text[kept[:-1]]
        last[-1] = True
        data = np.delete(data, after[last] - 1)
    sizes = np.bincount(words.text[kept], size - last, block.rows).astype(np.int64)
    off = np.zeros(block.rows + 1, np.int64)
    np.cumsum(sizes, out=off[1:])
    return pa.LargeStringArray.from_buffers(block.rows, pa.py_buffer(off), pa.py_buffer(data)).cast(pa.string())


def periodic_runs(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: words, all runs by start and then period, and the
    collapsed text. ``least`` is the least length of a run, 24 or more."""
    if least < LEAST:
        raise ValueError(f"runs under {LEAST} words are not searched for")
    B.small_batches(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in B.text_blocks(batch.column(1)):
                n_words, offsets, runs, collapsed = scan_block(block, least)
                ids = batch.column(0).slice(block.first, block.rows)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(n_words, pa.int64()), pa.ListArray.from_arrays(offsets, runs), collapsed],
                    ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")
                       .alias("text")).mapInArrow(scan, SCHEMA)


def with_planted_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) where a tenth of the documents, chosen by the id's crc32 h,
    repeat themselves: with g = floor(h / 10), word i >= a = g % n is the word
    a + (i - a) % p, p = 1 + floor((n - a) / (3 + g % 8)). Others, and those
    without an id, stay as they are."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    chosen = F.coalesce((h % 10 == 0) & F.col(text_col).isNotNull(), F.lit(False))
    g = F.floor(h / 10).cast("long")

    def repeated(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = F.try_mod(g, n)
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        return F.struct(w.alias("w"), a.cast("int").alias("a"), p.cast("int").alias("p"))

    def joined(x: Column) -> Column:
        return F.array_join(F.transform(x["w"], lambda word, i: F.when(i < x["a"], word).otherwise(
            F.get(x["w"], x["a"] + (i - x["a"]) % x["p"]))), " ")

    # lambdas bind the words once; a plain expression would split the text per use
    words = F.array(F.regexp_extract_all(F.col(text_col), F.lit(r"([^\x20\x09-\x0D]+)")))
    planted = F.transform(F.transform(words, repeated), joined)[0]
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.when(chosen, planted).otherwise(F.col(text_col)).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """The run with the greatest exact length / period, and digests of all runs
    and of the collapsed text."""
    def better(x: Column, y: Column) -> Column:
        mine, other = x["length"] * y["period"], y["length"] * x["period"]
        before = (x["start"] < y["start"]) | ((x["start"] == y["start"]) & (x["period"] < y["period"]))
        return F.when(y["start"].isNull() | (mine > other) | ((mine == other) & before), x).otherwise(y)

    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    line = F.concat(F.array_join(F.transform("runs", lambda r: F.concat_ws(
        ",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n"),
        F.when(F.size("runs") > 0, F.lit("\n")).otherwise(""))
    best = F.reduce("runs", none, lambda y, x: better(x, y))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"),
        F.sha2(line, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    ).select("doc_id", "n_runs", "best.start", "best.length", "best.period",
             F.expr("1000 * best.length div best.period").alias("exponent_milli"),
             "runs_sha256", "collapsed_sha256", "n_words")
