"""Suffix-array dedup: removal of repeated long substrings (operator 8).

Every byte is removed that lies in a string of ``LENGTH`` bytes which starts
somewhere else as well, in any document. Suffixes are compared by column-wise
multi-document construction of the Burrows-Wheeler transform.

1. Alignment. A window of ``LENGTH`` bytes is given to its *anchor*, the
   leftmost of its 32-byte grams with the smallest hash: equal windows have
   equal anchors at equal places. Windows of one anchor follow one another and
   make a segment. Tasks send (anchor, segment hash) to the anchor's shard. An
   anchor seen once holds no repeats; equal segments are repeated as a whole.
   What is left are anchors with different segments, which may agree in part.
2. Construction. The segments of such anchors, as documents aligned at the
   anchor, go to the anchor's shard. A suffix can only equal suffixes of its
   own column, so the transform is kept by column: each round inserts one
   symbol per document, the column before, re-sorts the suffixes stably by it
   and updates the common prefixes of neighbours, which are one more than the
   least common prefix between their old places. Columns lie in a sequential
   external file that is read once; in memory are one column, the order and
   the common prefixes. A window whose suffix shares ``LENGTH`` bytes with a
   neighbour is repeated.
3. An anchor with more than ``HOT`` different segments (the edge of a passage
   that very many documents hold) is not put into one task: its windows are
   counted by their hashes, with map-side combination.
4. The spans of a document are joined to its text and cut out.

Shards are as many as ``spark.sql.shuffle.partitions``.

Defined results: a null text is empty; texts shorter than ``LENGTH`` bytes are
untouched; rows of equal id and text are separate documents that repeat each
other, each given; ids may be null or repeated; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipelens.llm import blocks as B
from pipelens.session import scratch_path

LENGTH, GRAM, HOT = 200, 32, 4096
#: Segments and documents that a task holds before it sends them on.
HOLD, HOLD_DOCS = 1 << 20, 60_000
_POSITION = np.uint64(0xFFFFFFFF)
# What a shard says of a segment.
ALONE, WHOLE, PART, WITNESS, HOT_PART, HOT_WITNESS = range(6)

_SENT = "shard int, flush long, number binary, anchor binary, segment binary, docs binary, spans binary"
_FOUND = "key long, check long, spans binary, asks binary"
_SEGMENT = "anchor long, key long, check long, start long, windows long, offset long, role long, bytes binary"
_SPAN = "key long, check long, start long, stop long"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    columns = list(zip(*rows, strict=True)) or [()] * len(schema.split(", "))
    parts = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, parts, strict=True)],
                                      [n for n, _ in parts])


def _bytes(values: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _values(held: bytes, width: int) -> np.ndarray:
    narrow = np.frombuffer(held, np.uint8).reshape(-1, width)
    out = np.zeros((len(narrow), 8), np.uint8)
    out[:, :width] = narrow
    return out.reshape(-1).view("<u8")


def segments(block: B.Block, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Anchor and segment hashes, text, start in it, number of windows, and the
    anchor's offset from the start, for all segments of a block."""
    none = np.zeros(0, np.int64)
    n, reach = len(block.data), length - gram + 1
    if n < length:
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none, none
    hasher = B.Hasher(block.data)
    at = np.arange(n - gram + 1)
    grams = hasher(at, at + gram)
    ranked = (grams & ~_POSITION) | at.astype(np.uint64)
    pad = -len(ranked) % reach
    rows = np.append(ranked, np.full(pad, ~np.uint64(0))).reshape(-1, reach)
    before = np.minimum.accumulate(rows, 1).reshape(-1)
    after = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].reshape(-1)
    least = (np.minimum(after[:n - length + 1], before[reach - 1:n - gram + 1]) & _POSITION).astype(np.int64)
    # windows that lie in one text
    text = np.repeat(np.arange(block.rows), np.diff(block.off))
    start = np.flatnonzero(text[:n - length + 1] == text[length - 1:])
    if not len(start):
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none, none
    least, own = least[start], text[start]
    first = np.flatnonzero(np.append(True, (least[1:] != least[:-1]) | (own[1:] != own[:-1])))
    windows = np.diff(np.append(first, len(start)))
    start, least, own = start[first], least[first], own[first]
    held = hasher(start, start + windows - 1 + length) + (least - start).astype(np.uint64)
    # anchors have small hashes: mixed, they fall on all shards alike
    return B.mix(grams[least]), B.mix(held), own, start - block.off[own], windows, least - start


def merged(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by the spans."""
    if not len(start):
        return start, stop
    order = np.argsort(start, kind="stable")
    start, stop = start[order], np.maximum.accumulate(stop[order])
    new = np.append(True, start[1:] > stop[:-1])
    return start[new], np.append(stop[:-1][new[1:]], stop[-1])


def _shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _aligned(docs: DataFrame, length: int, hot: int, shards: int) -> DataFrame:
    """Step 1: for each document with repeats, its whole spans and the segments
    that need a comparison."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flush = TaskContext.get().partitionId() << 24
        held: list[tuple] = []
        docs_held = size = 0

        def rows() -> list[tuple]:
            base = np.cumsum([0, *(len(h[0]) for h in held)])
            ids = np.concatenate([h[0] for h in held])
            anchor, segment, own, start, windows, offset = (
                np.concatenate([h[1][i] + (b if i == 2 else 0) for h, b in zip(held, base, strict=False)])
                for i in range(6))
            spans = np.stack([own, start, windows, offset], 1).astype("<u4")
            order = np.argsort(anchor, kind="stable")
            cuts = np.searchsorted(_shard(anchor[order], shards), np.arange(shards + 1))
            out = []
            for s in np.flatnonzero(np.diff(cuts)):
                part = order[cuts[s]:cuts[s + 1]]
                out.append((int(s), flush, _bytes(part, 4), _bytes(anchor[part], 5), _bytes(segment[part], 6), None, None))
            return [*out, (flush % shards, flush, None, None, None, ids.tobytes(), spans.tobytes())]

        for batch in batches:
            ids = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], 1)
            for block in B.text_blocks(batch.column(2)):
                held.append((ids[block.first:block.first + block.rows], segments(block, length)))
                docs_held, size = docs_held + block.rows, size + len(held[-1][1][0])
                if size >= HOLD or docs_held + B.BATCH_ROWS > HOLD_DOCS:
                    yield _batch(rows(), _SENT)
                    flush, held, docs_held, size = flush + 1, [], 0, 0
        if held:
            yield _batch(rows(), _SENT)

    def share(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """Which segments are repeated, and which could be in part."""
        known = pa.compute.is_valid(table["docs"])
        passed, table = table.filter(known), table.filter(pa.compute.invert(known))
        if not len(table):
            return passed
        flush = np.repeat(table["flush"].to_numpy(), [len(x.as_buffer()) // 4 for c in table["number"].chunks for x in c])
        number, anchor, segment = (np.concatenate([_values(x.as_buffer(), w) for c in table[n].chunks for x in c])
                                   for n, w in (("number", 4), ("anchor", 5), ("segment", 6)))
        order = np.lexsort((number, flush, segment, anchor))
        a, g = anchor[order], segment[order]
        new_anchor = np.append(True, a[1:] != a[:-1])
        new_segment = new_anchor | np.append(True, g[1:] != g[:-1])
        of_anchor, of_segment = np.cumsum(new_anchor) - 1, np.cumsum(new_segment) - 1
        equal = np.bincount(of_segment)[of_segment]
        kinds = np.bincount(of_anchor[new_segment])[of_anchor]
        said = np.full(len(a), ALONE)
        said[equal > 1] = WHOLE
        said[(equal == 1) & (kinds > 1)] = PART
        # one of equal segments stands by for comparison; it is whole as well
        witness = new_segment & (equal > 1) & (kinds > 1)
        said[(said == PART) & (kinds > hot)] = HOT_PART
        out = []
        for extra, chosen in ((None, said != ALONE), (WITNESS, witness)):
            told = said[chosen] if extra is None else np.where(kinds[chosen] > hot, HOT_WITNESS, extra)
            where = order[chosen]
            if not len(where):
                continue
            by_flush = np.argsort(flush[where], kind="stable")
            where, told = where[by_flush], told[by_flush]
            flushes, first = np.unique(flush[where], return_index=True)
            for f, i, j in zip(flushes, first, np.append(first[1:], len(where)), strict=True):
                out.append((key[0].as_py(), int(f), _bytes(number[where[i:j]], 4), _bytes(anchor[where[i:j]], 5),
                            _bytes(told[i:j], 1), None, None))
        return pa.concat_tables([passed, pa.Table.from_batches([_batch(out, _SENT)])])

    def gather(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """One row per document of a stretch of input that has something."""
        parts, ids, spans = [], None, None
        for row in table.to_pylist():
            if row["docs"] is not None:
                ids = np.frombuffer(row["docs"], np.int64).reshape(-1, 2)
                spans = np.frombuffer(row["spans"], "<u4").reshape(-1, 4).astype(np.int64)
            else:
                parts.append((_values(row["number"], 4).astype(np.int64),
                              (_values(row["anchor"], 5) | np.uint64(row["shard"] << 40)).astype(np.int64),
                              _values(row["segment"], 1).astype(np.int64)))
        if not parts:
            return pa.Table.from_batches([_batch([], _FOUND)])
        number, anchor, told = (np.concatenate(x) for x in zip(*parts, strict=True))
        own, start, windows, offset = spans[number].T
        order = np.argsort(own, kind="stable")
        cuts = np.searchsorted(own[order], np.arange(len(ids) + 1))
        out = []
        for d in np.flatnonzero(np.diff(cuts)):
            mine = order[cuts[d]:cuts[d + 1]]
            whole = mine[told[mine] == WHOLE]
            a, b = merged(start[whole], start[whole] + windows[whole] - 1 + length)
            ask = mine[told[mine] > WHOLE]
            out.append((int(ids[d, 0]), int(ids[d, 1]), np.stack([a, b], 1).tobytes(),
                        np.stack([anchor[ask], start[ask], windows[ask], offset[ask], told[ask]], 1).tobytes()
                        if len(ask) else None))
        return pa.Table.from_batches([_batch(out, _FOUND)])

    return (docs.mapInArrow(send, _SENT).groupBy("shard").applyInArrow(share, _SENT)
            .groupBy("flush").applyInArrow(gather, _FOUND))


def _with_bytes(length: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, check, text, asks in zip(*(batch.column(i) for i in range(4)), strict=True):
                held = text.as_buffer().to_pybytes() if text.is_valid else b""
                for anchor, start, windows, offset, role in np.frombuffer(asks.as_buffer(), np.int64).reshape(-1, 5).tolist():
                    out.append((anchor, key.as_py(), check.as_py(), start, windows, offset, role,
                                held[start:start + windows - 1 + length]))
            yield _batch(out, _SEGMENT)

    return cut


def repeated_windows(group: np.ndarray, held: list[bytes], offset: np.ndarray, windows: np.ndarray,
                     length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(document, window) of all windows that occur in another document of the
    same group. ``offset`` is where the common anchor stands in each document;
    the column of a byte is its place relative to the anchor."""
    n = len(held)
    size = np.array([len(x) for x in held])
    low, high = -int(offset.max()), int((size - offset).max())
    with tempfile.TemporaryFile() as columns:
        # the columns, last first, one after the other; 0 stands for no symbol
        flat = np.frombuffer(b"".join(held), np.uint8)
        begin = np.cumsum(size) - size
        for c in range(high - 1, low - 1, -1):
            at = offset + c
            there = (at >= 0) & (at < size)
            column = np.zeros(n, "<u2")
            column[there] = flat[begin[there] + at[there]].astype("<u2") + 1
            columns.write(column.tobytes())
        columns.seek(0)
        order = np.argsort(group, kind="stable")
        common = np.zeros(n + 1, np.int64)  # with the suffix before, in the order
        docs, which = [], []
        for c in range(high - 1, low - 1, -1):
            symbol = np.frombuffer(columns.read(2 * n), "<u2")[order]
            # the round: suffixes get one symbol longer and are sorted by it
            rank = np.lexsort((symbol, group[order]))
            same = np.append(False, (symbol[rank][1:] == symbol[rank][:-1]) & (symbol[rank][1:] > 0)
                             & (group[order][rank][1:] == group[order][rank][:-1]))
            second = np.flatnonzero(same)
            ends = np.empty(2 * len(second), np.int64)
            ends[::2], ends[1::2] = rank[second - 1] + 1, rank[second] + 1
            after = np.zeros(n + 1, np.int64)
            if len(second):
                after[second] = 1 + np.minimum.reduceat(common, ends)[::2]
            order, common = order[rank], np.minimum(after, length)
            found = order[np.maximum(common[:-1], common[1:]) >= length]
            window = c + offset[found]
            fine = (window >= 0) & (window < windows[found])
            docs.append(found[fine])
            which.append(window[fine])
    return np.concatenate(docs), np.concatenate(which)


def _construct(length: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """Step 2 for the anchors of a shard."""
        anchor, start, windows, offset, role = (
            table[c].to_numpy() for c in ("anchor", "start", "windows", "offset", "role"))
        held = [x.as_buffer().to_pybytes() for c in table["bytes"].chunks for x in c]
        doc, window = repeated_windows(anchor, held, offset, windows, length)
        asked = role[doc] == PART
        doc, window = doc[asked], window[asked]
        order = np.lexsort((window, doc))
        doc, window = doc[order], window[order]
        new = np.append(True, (doc[1:] != doc[:-1]) | (window[1:] != window[:-1] + 1)) if len(doc) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(doc))[:len(first)] - 1
        at = doc[first]
        return pa.table({"key": table["key"].to_numpy()[at], "check": table["check"].to_numpy()[at],
                         "start": start[at] + window[first], "stop": start[at] + window[last] + length})

    return run


def _hot_windows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Step 3: two hashes of every window of the segments of hot anchors."""
        for batch in batches:
            windows = batch.column("windows").to_numpy()
            if not len(windows):
                continue
            data = np.frombuffer(b"".join(x.as_py() for x in batch.column("bytes")), np.uint8)
            begin = np.cumsum(windows + length - 1) - (windows + length - 1)
            row = np.repeat(np.arange(len(windows)), windows)
            window = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
            at = begin[row] + window
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(B.Hasher(data, salt)(at, at + length).view(np.int64)) for salt in (0, 1)),
                 *(pa.array(batch.column(c).to_numpy()[row]) for c in ("key", "check", "role")),
                 pa.array(batch.column("start").to_numpy()[row] + window)],
                ["one", "two", "key", "check", "role", "start"])

    return run


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc, text, spans in zip(*(batch.column(i) for i in range(3)), strict=True):
            held = text.as_buffer().to_pybytes() if text.is_valid else b""
            runs = [np.frombuffer(x.as_buffer(), np.int64).reshape(-1, 2) for x in spans] if spans.is_valid else []
            runs = np.concatenate(runs) if runs else np.zeros((0, 2), np.int64)
            start, stop = merged(runs[:, 0], runs[:, 1])
            digest, at = hashlib.sha256(), 0
            for i, j in zip(start.tolist(), stop.tolist(), strict=True):
                digest.update(held[at:i])
                at = j
            digest.update(held[at:])
            out.append((doc.as_py(), len(held), int((stop - start).sum()), len(start), digest.hexdigest()))
        columns = list(zip(*out, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.string())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, length: int = LENGTH, hot: int = HOT, shards: int | None = None,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its size, what is removed, and a digest of the rest."""
    spark = docs.sparkSession
    B.small_batches(spark)
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, "substrings")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"),
                       F.xxhash64(F.col(id_col).cast("long"), text).alias("key"),
                       F.xxhash64(text, F.lit("check")).alias("check"))
    _aligned(docs.select("key", "check", "text"), length, hot, shards).write.parquet(f"{path}-found")
    found = spark.read.parquet(f"{path}-found")
    # equal rows ask the same: one of them is enough
    asks = found.where("asks is not null").groupBy("key", "check").agg(F.max("asks").alias("asks"))
    (docs.join(asks, ["key", "check"]).dropDuplicates(["key", "check"])
     .select("key", "check", "text", "asks").mapInArrow(_with_bytes(length), _SEGMENT)
     .write.parquet(f"{path}-segments"))
    cut = spark.read.parquet(f"{path}-segments")
    built = (cut.where(F.col("role") < HOT_PART).groupBy(F.pmod("anchor", F.lit(shards)).alias("shard"))
             .applyInArrow(_construct(length), _SPAN))
    windows = cut.where(F.col("role") >= HOT_PART).mapInArrow(
        _hot_windows(length), "one long, two long, key long, check long, role long, start long")
    often = windows.groupBy("one", "two").agg(F.count("*").alias("n")).where("n > 1")
    counted = (windows.where(F.col("role") == HOT_PART).join(often, ["one", "two"])
               .select("key", "check", "start", (F.col("start") + length).alias("stop")))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair = np.stack([batch.column(2).to_numpy(), batch.column(3).to_numpy()], 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([p.tobytes() for p in pair], pa.binary())],
                ["key", "check", "spans"])

    part = built.unionByName(counted).mapInArrow(pack, "key long, check long, spans binary")
    spans = (found.where(F.octet_length("spans") > 0).select("key", "check", "spans").unionByName(part)
             .groupBy("key", "check").agg(F.collect_set("spans").alias("spans")))
    return (docs.join(spans, ["key", "check"], "left").select("doc_id", "text", "spans")
            .mapInArrow(_removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))
