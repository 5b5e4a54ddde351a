"""Quality rules by repetition coverage (operator 7).

For several n, rolling hashes of the n-word windows of a text tell which
windows occur twice or more in it; the measure is the share of the text's word
characters that lie inside such windows. The same is done for whole lines. A
text fails when a share exceeds the limit for its n; windows count only beyond
``ALLOWANCE`` characters, so that one line standing twice does not fail a short text.

The scan is one ``mapInArrow`` without a shuffle. A longer window can only be
repeated where the shorter one at its place is, so each n looks at the places
that the n before left over.

Defined results: a null text is empty; an empty text has zeros everywhere and
fails the base rule (under 10 words); rows are judged alone, so repeated rows
and ties give equal results; other columns of the input are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipelens.llm import blocks as B

#: Largest accepted share of word characters inside repeated n-word windows:
#: below the base rule's share of words, and lower for longer windows.
LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Word characters in repeated windows that no text fails for: a line
#: of some 120 characters standing twice.
ALLOWANCE = 240
#: Largest accepted share of repeated lines, and of word characters in them.
LINE_LIMIT, LINE_CHAR_LIMIT = 0.40, 0.30
MIN_WORDS, BASE_WINDOW, BASE_PERCENT = 10, 5, 20

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
#: Bytes that start a code point.
_POINT = (np.arange(256) & 0xC0) != 0x80

SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
          "n_repeat_words long, base_failed boolean, kept boolean, worst_window int, "
          "window_share double, line_share double")


def _twice(keys: np.ndarray) -> np.ndarray:
    """For each key, whether it occurs more than once."""
    order = np.argsort(keys)
    ordered = keys[order]
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = ordered[1:] == ordered[:-1]
    out = np.empty(len(keys), bool)
    out[order] = same[1:] | same[:-1]
    return out


def _later(keys: np.ndarray) -> np.ndarray:
    """For each key, whether an equal one stands before it."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    out = np.zeros(len(keys), bool)
    out[order[1:]] = ordered[1:] == ordered[:-1]
    return out


def _covered(at: np.ndarray, n: int, size: int) -> np.ndarray:
    """Words inside the n-word windows that start at ``at``."""
    steps = np.zeros(size + 1, np.int32)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + n, -1)
    return np.cumsum(steps[:-1]) > 0


def measure(block: B.Block, limits: dict[int, float], allowance: int = ALLOWANCE) -> dict[str, np.ndarray]:
    words, rows = B.find_words(block), block.rows
    hasher = B.Hasher(block.data)
    own = hasher(words.start, words.end)
    salt = B.mix(words.text.astype(np.uint64) + np.uint64(1))
    point = _POINT[block.data]
    points = np.zeros(len(block.data) + 1, np.int64)
    np.cumsum(point, out=points[1:])
    chars = points[words.end] - points[words.start]

    def per_text(index, weights=None):
        return np.bincount(index, weights, rows)[:rows]

    total = per_text(words.text, chars)
    worst_share, worst, failed = np.zeros(rows), np.zeros(rows, np.int32), np.zeros(rows, bool)
    repeat_words = np.zeros(rows, np.int64)
    at = words.windows(min([BASE_WINDOW, *limits]))
    for n in sorted({BASE_WINDOW, *limits}):
        at = at[at + n <= len(words.start)]
        at = at[words.text[at] == words.text[at + n - 1]]
        at = at[_twice(B.window_hashes(own, at, n) + salt[at])]
        if not len(at) and n >= BASE_WINDOW:
            break
        cover = _covered(at, n, len(words.start))
        if n == BASE_WINDOW:
            repeat_words = per_text(words.text[cover]).astype(np.int64)
        if n in limits:
            inside = per_text(words.text[cover], chars[cover])
            share = inside / np.maximum(total, 1)
            failed |= (share > limits[n]) & (inside > allowance)
            more = share > worst_share
            worst_share[more], worst[more] = share[more], n

    newline = np.flatnonzero(block.data == 10)
    begin = np.union1d(block.off[:-1][np.diff(block.off) > 0], newline + 1)
    begin = begin[begin < len(block.data)]
    line_of = np.searchsorted(block.off, begin, "right") - 1
    stop = np.minimum(block.off[line_of + 1], np.append(begin[1:], len(block.data)))
    ends_in_newline = (stop > begin) & (block.data[stop - 1] == 10) if len(begin) else np.zeros(0, bool)
    stop = stop - ends_in_newline
    held = np.searchsorted(words.start, begin), np.searchsorted(words.start, stop)
    full = held[1] > held[0]
    begin, stop, line_of = begin[full], stop[full], line_of[full]
    again = _later(hasher(begin, stop) + B.mix(line_of.astype(np.uint64) + np.uint64(1)))
    n_lines, dup_lines = per_text(line_of), per_text(line_of[again])
    cum = np.concatenate([[0], np.cumsum(chars)])
    in_line = cum[held[1][full]] - cum[held[0][full]]
    line_share = dup_lines / np.maximum(n_lines, 1)
    failed |= (line_share > LINE_LIMIT)
    failed |= per_text(line_of[again], in_line[again]) / np.maximum(total, 1) > LINE_CHAR_LIMIT

    n_words = per_text(words.text).astype(np.int64)
    base = (n_words < MIN_WORDS) | (100 * repeat_words > BASE_PERCENT * n_words)
    return {"n_words": n_words, "word_chars": total.astype(np.int64),
            "n_symbols": block.per_text(_SYMBOL[block.data]),
            "n_dup_lines": dup_lines.astype(np.int64), "n_repeat_words": repeat_words,
            "base_failed": base, "kept": ~base & ~failed, "worst_window": worst,
            "window_share": worst_share, "line_share": line_share}


def repetition_rules(docs: DataFrame, limits: dict[int, float] | None = None,
                     id_col: str = "doc_id", text_col: str = "text", allowance: int | None = None) -> DataFrame:
    """One row per document with the base counts, the verdict, and the largest
    window share with its n. Limits of the caller's own hold from the first
    character unless an ``allowance`` is given."""
    if allowance is None:
        allowance = ALLOWANCE if limits is None else 0
    limits = dict(LIMITS if limits is None else limits)
    B.small_batches(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in B.text_blocks(batch.column(1)):
                out = measure(block, limits, allowance)
                ids = batch.column(0).slice(block.first, block.rows)
                yield pa.RecordBatch.from_arrays(
                    [ids, *(pa.array(v) for v in out.values())], ["doc_id", *out])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")
                       .alias("text")).mapInArrow(scan, SCHEMA)
