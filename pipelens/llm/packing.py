"""Sum-of-squares online packing (operator 3).

Every document becomes token ids plus one end id and is cut into full windows
and one remainder. A remainder goes online to the fill level that makes the sum
over levels of (number of partly filled windows at that level)^2 smallest; the
counts stand in an array indexed by level, so a placement is one vector
expression over ``window`` levels.

Each Spark partition packs its own documents, without a shuffle, and one level
array serves it from its first document to its last. At most ``max_open``
windows are partly filled at a time. With that many open, a remainder goes into
one of them by the same rule; where none has room it is cut: its first part
completes a window of the most crowded level within its reach, the rest is
placed like any remainder. What is open when the partition ends is cut anew
into full windows and, last, powers of two, which need no padding. So memory is
bounded by ``max_open * window`` ids and one document, and a lost task is simply
run again: its result depends on its input rows alone.

``closed_by`` tells what filled a piece's sequence: ``document`` (a full window
of one document), ``level`` (placements by the level array) or ``end``.

Ids are those of ``tokenizers`` with ``add_special_tokens=False`` (see
``byte_bpe``). Defined results: a null or empty text is the
end id alone; equal rows are packed one by one; an added token of the file that
stands in a text becomes its id; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipelens.llm import blocks as B
from pipelens.llm.byte_bpe import byte_bpe

WINDOW, END_ID, MAX_OPEN = 2048, 1, 64

NEVER = 1 << 40

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long, closed_by string")


class Piece(NamedTuple):
    doc: int | None
    start: int
    ids: np.ndarray
    doc_tokens: int


class SumOfSquares:
    """Packs pieces of one partition; ``put`` and ``close`` give finished rows."""

    def __init__(self, window: int, max_open: int, first_sequence: int) -> None:
        self.window, self.max_open, self.next = window, max_open, first_sequence
        self.levels = np.zeros(window + 1, np.int64)  # partly filled windows at each level
        self.held: dict[int, list[list[Piece]]] = {}  # level -> contents of its windows
        self.open = 0

    def put(self, doc: int | None, ids: np.ndarray) -> Iterator[tuple]:
        size, w = len(ids), self.window
        whole = size - size % w
        for at in range(0, whole, w):
            yield from self._finish([Piece(doc, at, ids[at:at + w], size)], "document")
        if whole < size:
            yield from self._place(Piece(doc, whole, ids[whole:], size))

    def _place(self, piece: Piece) -> Iterator[tuple]:
        level = self._level(len(piece.ids))
        if level is None:
            # the most crowded level in reach, the fullest of equals: least is cut off
            reach = self.levels[:self.window - len(piece.ids):-1]
            level = self.window - int(np.argmax(reach))
            part = self.window - level
            yield from self._add(level, piece._replace(ids=piece.ids[:part]))
            piece = piece._replace(start=piece.start + part, ids=piece.ids[part:])
            level = self._level(len(piece.ids))  # a window was closed: a new one may open
        yield from self._add(level, piece)

    def _level(self, s: int) -> int | None:
        """The level whose choice makes the sum of squares smallest; 0 is a new
        window, None means that no window has room and none may be opened."""
        w, n = self.window, self.levels
        # growth of the sum of squares when a window rises from level h to h + s
        growth = np.where(n[1:w - s + 1] > 0, 2 * (n[s + 1:w + 1] - n[1:w - s + 1]) + 2, NEVER)
        if len(growth) and n[w - s] > 0:  # a full window leaves the counts
            growth[-1] = 1 - 2 * n[w - s]
        best = len(growth) - int(np.argmin(growth[::-1])) if len(growth) else 0
        least = growth[best - 1] if best else NEVER
        if self.open < self.max_open and least > 2 * n[s] + 1:
            return 0
        return best if least < NEVER else None

    def _add(self, level: int, piece: Piece) -> Iterator[tuple]:
        held: list[Piece] = []
        if level:
            held = self.held[level].pop()
            self.levels[level] -= 1
            self.open -= 1
        held.append(piece)
        level += len(piece.ids)
        if level == self.window:
            yield from self._finish(held, "level")
        else:
            self.levels[level] += 1
            self.held.setdefault(level, []).append(held)
            self.open += 1

    def close(self) -> Iterator[tuple]:
        """Cut what is open into full windows, then into powers of two."""
        pieces = [p for level in sorted(self.held, reverse=True) for held in self.held[level] for p in held]
        self.held, self.open = {}, 0
        self.levels[:] = 0
        left = sum(len(p.ids) for p in pieces)
        room, held = self._next_size(left), []
        for p in pieces:
            while len(p.ids):
                take = min(room, len(p.ids))
                held.append(p._replace(ids=p.ids[:take]))
                p = p._replace(start=p.start + take, ids=p.ids[take:])
                left, room = left - take, room - take
                if not room:
                    yield from self._finish(held, "end")
                    room, held = self._next_size(left), []

    def _next_size(self, left: int) -> int:
        return self.window if left >= self.window else 1 << max(0, left.bit_length() - 1)

    def _finish(self, held: list[Piece], by: str) -> Iterator[tuple]:
        offset, sequence = 0, self.next
        self.next += 1
        for p in held:
            yield (p.doc, p.start, len(p.ids), zlib.crc32(p.ids.astype("<u4").tobytes()), p.doc_tokens,
                   sequence, offset, by)
            offset += len(p.ids)


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW, end_id: int = END_ID,
         max_open: int = MAX_OPEN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: where its ids stand in the document and in the packed
    sequence. ``vocabulary`` is a byte-level BPE file that every worker has."""
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    B.small_batches(docs.sparkSession)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # 2^40 sequences for each partition
        packer = SumOfSquares(window, max_open, TaskContext.get().partitionId() << 40)
        encode = byte_bpe(vocabulary, added=True).encode
        names = [c.split()[0] for c in SCHEMA.split(", ")]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [()] * len(names)
            kinds = [pa.int64()] * (len(names) - 1) + [pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id))
                rows += packer.put(doc, ids)
            yield batch_of(rows)
        yield batch_of(list(packer.close()))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")
                       .alias("text")).mapInArrow(rows_of, SCHEMA)
