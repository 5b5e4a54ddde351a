"""Cross-tokenizer alignment (operator 13).

Every text is encoded twice, by a byte-level BPE (A, with a space before the
text) and by a sentence-piece model (B, which adds that space). Where tokens of
both end at the same byte, the two are linked and a group of tokens is closed.

The scan works on Arrow columns of many texts at once: token lists are flattened
with the index of their parent text; token lengths are summed up within each
text, which gives (text, end) keys; an Acero hash join of both sides on these
keys gives the links; ``Table.group_by`` counts each id pair in its text. These
partial counts are written with the document rows, and Spark merges them: pair
totals over the corpus, the highest total of each B id, and per document the sum
of its links' totals and how many links have the highest one.

A pair can only be linked if the bytes of one token end with those of the other,
as both end at the same byte. So the table of totals has no more rows than the
vocabularies' tokens have endings (about 500,000 for those used here), whatever
the corpus, and is broadcast. Every other step is one pass or a combined sum per
pair or document row.

Defined results: texts that are null, empty, or not given back byte by byte by
both vocabularies have no tokens and zeros everywhere; repeated rows, and rows
with equal or null ids, each give a row and each count; other columns are
ignored; an empty table gives an empty result. Strings of special tokens in a
text are plain text.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pipelens.llm import blocks as B
from pipelens.llm.byte_bpe import byte_bpe
from pipelens.session import scratch_path

SCHEMA = ("row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
          "groups string, pairs array<long>, counts array<long>")
_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
#: Separators after a token: inside a side, between sides, between groups, at the end.
_SEPARATORS = [",", "|", ";", ""]
_PLACE = 40  # bits of a key for the end within a text; pairs hold the A id above 32 bits


class Vocabularies(NamedTuple):
    encode_a: object
    encode_b: object
    bytes_a: pa.Array
    bytes_b: pa.Array
    numbers: pa.Array  # every id with each separator


@lru_cache(maxsize=2)
def vocabularies(path_a: str, path_b: str) -> Vocabularies:
    a = byte_bpe(path_a, added=False)
    b = sentencepiece.SentencePieceProcessor(model_file=path_b)
    pieces = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
              for i in range(b.get_piece_size())]
    bytes_a = a.token_bytes()
    numbers = [f"{i}{s}" for i in range(max(len(bytes_a), len(pieces))) for s in _SEPARATORS]
    return Vocabularies(a.encode, b, pa.array(bytes_a, pa.large_binary()), pa.array(pieces, pa.large_binary()),
                        pa.array(numbers, pa.large_string()))


class Side(NamedTuple):
    ids: pa.Array  # of all tokens
    parent: np.ndarray  # their texts
    end: np.ndarray  # where they end in their text, in bytes

    @property
    def key(self) -> np.ndarray:
        return (self.parent << _PLACE) + self.end


def _lists(ids: list) -> pa.ListArray:
    offsets = np.zeros(len(ids) + 1, np.int32)
    np.cumsum([len(x) for x in ids], out=offsets[1:])
    flat = np.concatenate([np.asarray(x, np.int32) for x in ids]) if ids else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(flat))


def _side(lists: pa.ListArray, token_bytes: pa.Array) -> tuple[Side, np.ndarray, memoryview]:
    """Tokens with their ends; the bytes all tokens make, with texts' offsets."""
    ids, parent = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy().astype(np.int64)
    made = pc.take(token_bytes, ids)
    total = np.concatenate([[0], pc.cumulative_sum(pc.binary_length(made)).to_numpy()]) if len(ids) else np.zeros(1, np.int64)
    offsets = total[np.asarray(lists.offsets)]  # before each text's first token
    end = total[1:] - offsets[parent]
    return Side(ids, parent, end), offsets, memoryview(made.buffers()[2] or b"").cast("B")


def _group_text(a: Side, b: Side, ends: np.ndarray, voc: Vocabularies, rows: int) -> tuple[np.ndarray, memoryview]:
    """`a1,a2|b1;a3|b2,b3` of every text, from the keys of its groups' ends."""
    in_a, in_b = np.searchsorted(ends, a.key), np.searchsorted(ends, b.key)
    n_a, n_b = np.bincount(in_a, minlength=len(ends)), np.bincount(in_b, minlength=len(ends))
    first = np.cumsum(n_a + n_b) - n_a - n_b
    at_a = first[in_a] + np.arange(len(in_a)) - (np.cumsum(n_a) - n_a)[in_a]
    at_b = (first + n_a)[in_b] + np.arange(len(in_b)) - (np.cumsum(n_b) - n_b)[in_b]
    code = np.zeros(len(in_a) + len(in_b), np.int64)
    code[at_a], code[at_b] = a.ids.to_numpy() * len(_SEPARATORS), b.ids.to_numpy() * len(_SEPARATORS)
    text = ends >> _PLACE
    last = np.append(text[1:] != text[:-1], True) if len(ends) else np.zeros(0, bool)
    code[first + n_a - 1] += 1
    code[first + n_a + n_b - 1] += np.where(last, 3, 2)
    made = pc.take(voc.numbers, pa.array(code))
    offsets = np.frombuffer(made.buffers()[1], np.int64)[:len(code) + 1]
    tokens = np.concatenate([[0], np.cumsum(np.bincount(a.parent, minlength=rows) + np.bincount(b.parent, minlength=rows))])
    return offsets[tokens], memoryview(made.buffers()[2] or b"").cast("B")


def align_block(texts: list[str | None], voc: Vocabularies, with_groups: bool) -> list[pa.Array]:
    """All columns but the row number and the id."""
    rows = len(texts)
    ids_a = [voc.encode_a(f" {t}") if t else () for t in texts]
    ids_b = voc.encode_b.encode([t or "" for t in texts], num_threads=1)
    (_, off_a, made_a), (_, off_b, made_b) = (_side(_lists(x), y) for x, y in ((ids_a, voc.bytes_a), (ids_b, voc.bytes_b)))
    for k, text in enumerate(texts):
        own = f" {text}".encode() if text else b""
        if not (made_a[off_a[k]:off_a[k + 1]] == own and made_b[off_b[k]:off_b[k + 1]] == own):
            ids_a[k] = ids_b[k] = ()
    (a, _, _), (b, _, _) = (_side(_lists(x), y) for x, y in ((ids_a, voc.bytes_a), (ids_b, voc.bytes_b)))
    links = pa.table({"key": a.key, "a": a.ids}).join(
        pa.table({"key": b.key, "b": b.ids}), "key", join_type="inner", use_threads=False)
    keys = links.column("key").to_numpy()
    ends = np.unique(keys)
    pair = (links.column("a").to_numpy().astype(np.int64) << 32) + links.column("b").to_numpy()
    counted = pa.table({"text": keys >> _PLACE, "pair": pair, "n": np.ones(len(pair), np.int64)}).group_by(
        ["text", "pair"], use_threads=False).aggregate([("n", "sum")]).sort_by([("text", "ascending"), ("pair", "ascending")])
    offsets = np.searchsorted(counted.column("text").to_numpy(), np.arange(rows + 1)).astype(np.int32)
    at, made = _group_text(a, b, ends, voc, rows)
    digests = [hashlib.sha256(made[i:j]).hexdigest() if j > i else "" for i, j in zip(at[:-1], at[1:], strict=True)]
    groups = [str(made[i:j], "ascii") for i, j in zip(at[:-1], at[1:], strict=True)] if with_groups else [None] * rows
    counts = [np.bincount(x, minlength=rows).astype(np.int64) for x in (a.parent, b.parent, ends >> _PLACE, keys >> _PLACE)]
    lists = [pa.ListArray.from_arrays(offsets, counted.column(c).combine_chunks()) for c in ("pair", "n_sum")]
    return [*map(pa.array, counts), pa.array(digests, pa.string()), pa.array(groups, pa.string()), *lists]


def aligned_rows(docs: DataFrame, path_a: str, path_b: str, with_groups: bool = False, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per document with a number of its own, its counts and groups, and
    how often each pair is linked in it. ``groups`` is filled on demand."""
    B.small_batches(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, row = vocabularies(path_a, path_b), TaskContext.get().partitionId() << _PLACE
        for batch in batches:
            for block in B.text_blocks(batch.column(1)):
                ids, texts = (batch.column(c).slice(block.first, block.rows) for c in (0, 1))
                numbers = np.arange(row, row + block.rows)
                row += block.rows
                yield pa.RecordBatch.from_arrays([pa.array(numbers), ids, *align_block(texts.to_pylist(), voc, with_groups)], _COLUMNS)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")
                       .alias("text")).mapInArrow(scan, SCHEMA)


def pair_totals(rows: DataFrame) -> DataFrame:
    """(pair, total, best): links of each id pair in all rows, and whether no
    pair with the same B id has more."""
    totals = rows.select(F.inline(F.arrays_zip("pairs", "counts"))).groupBy(F.col("pairs").alias("pair")).agg(
        F.sum("counts").alias("total"))
    of_b = Window.partitionBy(F.expr("pair & 4294967295"))
    return totals.select("pair", "total", (F.col("total") == F.max("total").over(of_b)).alias("best"))


def align(docs: DataFrame, path_a: str, path_b: str, with_groups: bool = False, id_col: str = "doc_id",
          text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, pairs): counts, groups and corpus-wide link counts of every
    document row; and the id pairs (a, b, total, best)."""
    spark = docs.sparkSession
    root = scratch_path(spark, "alignment")
    aligned_rows(docs, path_a, path_b, with_groups, id_col, text_col).write.option("compression", "zstd").parquet(os.path.join(root, "rows"))
    rows = spark.read.parquet(os.path.join(root, "rows"))
    pair_totals(rows).write.parquet(os.path.join(root, "totals"))
    totals = spark.read.parquet(os.path.join(root, "totals"))
    sums = (rows.select("row", F.inline(F.arrays_zip("pairs", "counts")))
            .join(F.broadcast(totals), F.col("pairs") == F.col("pair"))
            .groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("counts"))).alias("n_best"),
                                F.sum(F.col("counts") * F.col("total")).alias("count_sum")))
    documents = rows.join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256", "groups")
    pairs = totals.select(F.shiftright("pair", 32).cast("int").alias("a"), F.expr("cast(pair & 4294967295 as int)").alias("b"),
                          "total", "best")
    return documents, pairs
