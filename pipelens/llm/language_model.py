"""Language-model scoring (operator 10): an interpolated modified Kneser-Ney
bigram model, counted in Spark, kept as sorted hash arrays that workers
memory-map to score whole texts.

1. Words. Tasks send (word, count) of their training texts to the word's shard;
   a shard keeps its sorted words and counts. Words over a quarter of a shard's
   mean share are *hot*; at most ``4 * shards`` words can be.
2. Bigrams. Tasks send (context, word, count) to the context's shard, those of
   a hot context to the shard of the pair, so no context fills one task. A
   shard keeps its sorted pair hashes and counts and sends on, per word, in how
   many contexts it stands, and per context, how many words follow it once,
   twice, or more often.
3. Word shards add these up beside their counts.
4. Scoring reads the documents again, without a shuffle: distinct words and
   pairs of a stretch of text are looked up in shard order, so each mapped
   file is read forwards.

Shards are as many as ``spark.sql.shuffle.partitions``; what tasks send and the
arrays grow with the training text. Only sums and the hot words reach the
driver. Words are 64-bit hashes in counts and 48-bit ones in pairs.

Defined results: a null text is empty and scores its end alone; a null id is
held out; without training text every token has probability 1 over the number
of known tokens plus one; equal rows score alike and each row counts; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipelens.llm import arrays
from pipelens.llm import blocks as B
from pipelens.llm.discounts import discounts, taken
from pipelens.session import scratch_path

START, END = np.uint64(1 << 20), np.uint64(2 << 20)
HELD_OUT = 10
#: Tokens looked up together; distinct n-grams that a task holds before it sends them on.
STRETCH, HOLD = 1 << 19, 2 << 20
_PAIR = np.uint64(0x9FB21C651E98DF25)

SCHEMA = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
          "base_score double, score double, perplexity double")


def held_out(ident: Column) -> Column:
    return F.coalesce(F.crc32(ident.cast("string")), F.lit(0)) % HELD_OUT == 0


def _tokens(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, token hashes, first token of each text and one past the
    last) of blocks of texts; every text ends in END."""
    for block in B.text_blocks(column):
        block = block._replace(data=B.LOWER[block.data])
        words = B.find_words(block)
        own = B.Hasher(block.data)(words.start, words.end)
        ends = words.first[1:] + np.arange(block.rows)
        tokens = np.empty(len(own) + block.rows, np.uint64)
        is_end = np.zeros(len(tokens), bool)
        is_end[ends] = True
        tokens[is_end], tokens[~is_end] = END, own
        yield block.first, tokens, np.append(0, ends + 1)


def _contexts(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[first[:-1]] = START
    return before


def _short(words: np.ndarray) -> np.ndarray:
    return words >> np.uint64(16)


def _pairs(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return B.mix(_short(context) * _PAIR + _short(word))


def _shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int32)


def _pack(values: np.ndarray, width: int) -> bytes:
    """The lowest ``width`` bytes of each value."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _unpack(held: bytes, width: int) -> np.ndarray:
    narrow = np.frombuffer(held, np.uint8).reshape(-1, width)
    out = np.zeros((len(narrow), 8), np.uint8)
    out[:, :width] = narrow
    return out.reshape(-1).view("<u8")


def _sent(shard: np.ndarray, shards: int, *columns: tuple[np.ndarray, int]) -> pa.RecordBatch:
    """One row for each shard that has values; values keep their order."""
    order = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(shards + 1))
    full = np.flatnonzero(np.diff(cuts))
    packed = [pa.array([_pack(values[order[cuts[s]:cuts[s + 1]]], width) for s in full], pa.binary())
              for values, width in columns]
    return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), *packed],
                                      ["shard", *(f"c{i}" for i in range(len(columns)))])


def _joined(table: pa.Table, name: str, width: int) -> np.ndarray:
    parts = [_unpack(x.as_buffer(), width) for x in table[name].combine_chunks() if x.is_valid]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


class Model(NamedTuple):
    """What a worker needs beside the arrays in ``root``."""

    root: str
    shards: int
    tokens: int
    words: int
    texts: int
    hot: np.ndarray
    pair_types: int
    pair_discounts: np.ndarray
    word_discounts: np.ndarray
    word_left: float  # mass the word level leaves to the uniform one

    def pair_shard(self, context: np.ndarray, pair: np.ndarray) -> np.ndarray:
        return _pair_shard(context, pair, self.hot, self.shards)

    def score(self, tokens: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each token, its training count and its log10 probability."""
        words, inverse = np.unique(np.concatenate([tokens, context]), return_inverse=True)
        stats = {n: np.zeros(len(words), np.int64) for n in ("count", "contexts", "once", "twice", "more")}
        cuts = np.searchsorted(_shard(words, self.shards), np.arange(self.shards + 1))
        for s in range(self.shards):
            part = slice(cuts[s], cuts[s + 1])
            if cuts[s] == cuts[s + 1]:
                continue
            at, there = arrays.find(arrays.load(self.root, f"words-{s}", "<u8"), words[part])
            if there.any():
                stats["count"][part][there] = arrays.load(self.root, f"counts-{s}", "<i8")[at[there]]
            at, there = arrays.find(arrays.load(self.root, f"short-{s}", "<u8"), _short(words[part]))
            if there.any():
                held = arrays.load(self.root, f"stats-{s}", "<i8").reshape(-1, 4)[at[there]]
                for column, n in enumerate(("contexts", "once", "twice", "more")):
                    stats[n][part][there] = held[:, column]
        stats["count"][words == START] = self.texts
        stats["count"][words == END] = self.texts
        of_word, of_context = inverse[:len(tokens)], inverse[len(tokens):]

        low = self.word_left / (self.words + 1.0)
        low = low + np.maximum(taken(stats["contexts"], self.word_discounts), 0) / max(self.pair_types, 1)
        total = np.maximum(stats["count"], 1)
        d = self.pair_discounts
        left = (d[1] * stats["once"] + d[2] * stats["twice"] + d[3] * stats["more"]) / total
        left[stats["once"] + stats["twice"] + stats["more"] == 0] = 1.0

        pair, first, same = np.unique(_pairs(context, tokens), return_index=True, return_inverse=True)
        shard = self.pair_shard(context[first], pair)
        seen = np.zeros(len(pair), np.int64)
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(self.shards + 1))
        for s in np.flatnonzero(np.diff(cuts)):
            part = order[cuts[s]:cuts[s + 1]]
            at, there = arrays.find(arrays.load(self.root, f"pairs-{s}", "<u8"), pair[part])
            if there.any():
                seen[part[there]] = arrays.load(self.root, f"times-{s}", "<u4")[at[there]]
        direct = np.maximum(taken(seen, d), 0)[same] / total[of_context]
        return stats["count"][of_word], np.log10(direct + left[of_context] * low[of_word])


def _pair_shard(context: np.ndarray, pair: np.ndarray, hot: np.ndarray, shards: int) -> np.ndarray:
    return _shard(np.where(np.isin(context, hot), pair, context), shards)


def train(texts: DataFrame, shards: int | None = None, text_col: str = "text") -> Model:
    """Count the texts and lay down the arrays."""
    spark = texts.sparkSession
    B.small_batches(spark)
    root = scratch_path(spark, "language-model")
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = texts.select(F.col(text_col).cast("string").alias("text"))

    def held(batches: Iterator[pa.RecordBatch], gather, hold: int) -> Iterator[tuple[np.ndarray, ...]]:
        """Distinct keys and counts of many blocks, as soon as there are enough."""
        parts: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            for _, tokens, first in _tokens(batch.column(0)):
                parts.append(gather(tokens, first))
                size += len(parts[-1][0])
                if size >= hold:
                    yield parts
                    parts, size = [], 0
        if parts:
            yield parts

    def send_words(batches):
        def gather(tokens, first):
            return np.unique(tokens[tokens != END], return_counts=True)

        for parts in held(batches, gather, HOLD):
            words, counts = arrays.summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            yield _sent(_shard(words, shards), shards, (words, 8), (counts, 5))

    def keep_words(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        s = key[0].as_py()
        words, counts = arrays.summed(_joined(table, "c0", 8), _joined(table, "c1", 5).astype(np.int64))
        arrays.save(root, f"words-{s}", words)
        arrays.save(root, f"counts-{s}", counts)
        top = np.argsort(-counts, kind="stable")[:4 * shards]
        return pa.table({"n": [int(counts.sum())], "v": [len(words)],
                         "top": pa.array([words[top].view(np.int64)], pa.list_(pa.int64())),
                         "times": pa.array([counts[top]], pa.list_(pa.int64()))})

    path = f"{root}-words"
    (texts.mapInArrow(send_words, "shard int, c0 binary, c1 binary").groupBy("shard")
     .applyInArrow(keep_words, "n long, v long, top array<long>, times array<long>").write.parquet(path))
    told = spark.read.parquet(path)
    n, v = told.agg(F.sum("n"), F.sum("v")).first()
    n, v = n or 0, v or 0
    hot = [r[0] for r in told.select(F.explode(F.arrays_zip("top", "times")).alias("x"))
           .where(F.col("x.times") * 4 * shards > n).select("x.top").collect()]
    hot = np.array(hot, np.int64).view(np.uint64)
    # every text starts with START, the most common context
    hot = np.append(hot, START)

    def send_pairs(batches):
        def gather(tokens, first):
            context = _contexts(tokens, first)
            pair, at, counts = np.unique(_pairs(context, tokens), return_index=True, return_counts=True)
            return pair, _short(context[at]), _short(tokens[at]), counts, np.isin(context[at], hot)

        for parts in held(batches, gather, HOLD):
            pair, context, word, counts, is_hot = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(pair, kind="stable")
            pair, counts = pair[order], counts[order]
            first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
            counts = np.add.reduceat(counts, first)
            pair, context, word, is_hot = pair[first], context[order[first]], word[order[first]], is_hot[order[first]]
            # counts travel in a byte: larger ones as several rows
            while True:
                now = np.minimum(counts, 255)
                yield from _pair_rows(pair, context, word, is_hot, now, shards)
                more = counts > 255
                if not more.any():
                    break
                counts, pair, context, word, is_hot = (x[more] for x in (counts - 255, pair, context, word, is_hot))

    def keep_pairs(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        s = key[0].as_py()
        runs = _joined(table, "c1", 4).astype(np.int64)
        context = np.repeat(_joined(table, "c0", 6), runs)
        word, counts = _joined(table, "c2", 6), _joined(table, "c3", 1).astype(np.int64)
        pair = B.mix(context * _PAIR + word)
        order = np.argsort(pair, kind="stable")
        pair = pair[order]
        first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else np.zeros(0, np.int64)
        counts = np.add.reduceat(counts[order], first) if len(first) else counts
        arrays.save(root, f"pairs-{s}", pair[first])
        arrays.save(root, f"times-{s}", counts.astype("<u4"))
        context, word = context[order[first]], word[order[first]]
        ones = np.ones(len(word), np.int64)
        word, stands = arrays.summed(word, ones)
        context, once, twice, more = arrays.summed(
            context, *((x).astype(np.int64) for x in (counts == 1, counts == 2, counts > 2)))
        seen = np.bincount(np.minimum(counts, 5), minlength=6)[1:5]
        zero = np.zeros
        out = _sent(_shard(np.concatenate([word, context]) << np.uint64(16), shards), shards,
                    (np.concatenate([word, context]), 6),
                    (np.concatenate([stands, zero(len(context), np.int64)]), 4),
                    *((np.concatenate([zero(len(word), np.int64), x]), 4) for x in (once, twice, more)))
        out = pa.Table.from_batches([out])
        told = pa.table({"shard": pa.array([s], pa.int32()), **{f"c{i}": pa.array([None], pa.binary()) for i in range(5)},
                         "told": pa.array([[len(counts), *seen.tolist()]], pa.list_(pa.int64()))})
        empty = pa.nulls(len(out), pa.list_(pa.int64()))
        return pa.concat_tables([out.append_column("told", empty), told])

    def keep_stats(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        s = key[0].as_py()
        short, *stats = arrays.summed(_joined(table, "c0", 6),
                                      *(_joined(table, f"c{i}", 4).astype(np.int64) for i in range(1, 5)))
        arrays.save(root, f"short-{s}", short)
        arrays.save(root, f"stats-{s}", np.stack(stats, 1).astype("<i8"))
        seen = np.bincount(np.minimum(stats[0], 5), minlength=6)
        told = np.zeros(5, np.int64)
        for x in table["told"].combine_chunks():
            if x.is_valid:
                told += np.array(x.as_py(), np.int64)
        return pa.table({"told": pa.array([told], pa.list_(pa.int64())),
                         "seen": pa.array([[int((stats[0] > 0).sum()), *seen[1:5].tolist(), int((stats[0] > 2).sum())]],
                                          pa.list_(pa.int64()))})

    path = f"{root}-pairs"
    columns = ", ".join(f"c{i} binary" for i in range(5))
    (texts.mapInArrow(send_pairs, "shard int, c0 binary, c1 binary, c2 binary, c3 binary")
     .groupBy("shard").applyInArrow(keep_pairs, f"shard int, {columns}, told array<long>")
     .groupBy("shard").applyInArrow(keep_stats, "told array<long>, seen array<long>").write.parquet(path))
    sums = spark.read.parquet(path).agg(*(F.sum(F.col("told")[i]) for i in range(5)),
                                        *(F.sum(F.col("seen")[i]) for i in range(6))).first()
    types, *pair_seen, known, n1, n2, n3, n4, over = (x or 0 for x in sums)
    texts_seen = texts.count() if known else 0
    by = discounts(n1, n2, n3, n4)
    left = (by[1] * n1 + by[2] * n2 + by[3] * over) / types if types else 1.0
    return Model(root, shards, n + texts_seen, v + bool(texts_seen), texts_seen, hot, types,
                 discounts(*pair_seen), by, left)


def _pair_rows(pair, context, word, is_hot, counts, shards: int) -> Iterator[pa.RecordBatch]:
    shard = _shard(np.where(is_hot, pair, context << np.uint64(16)), shards)
    order = np.lexsort((context, shard))
    shard, context, word, counts = shard[order], context[order], word[order], counts[order]
    cuts = np.searchsorted(shard, np.arange(shards + 1))
    full, packed = np.flatnonzero(np.diff(cuts)), [[], [], [], []]
    for s in full:
        part = slice(cuts[s], cuts[s + 1])
        own = context[part]
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        for held, (values, width) in zip(packed, ((own[first], 6), (np.diff(np.append(first, len(own))), 4),
                                                  (word[part], 6), (counts[part], 1)), strict=True):
            held.append(_pack(values, width))
    yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), *(pa.array(x, pa.binary()) for x in packed)],
                                     ["shard", "c0", "c1", "c2", "c3"])


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its token counts, base score and model score."""
    B.small_batches(docs.sparkSession)
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, out, held, size = [], [], [], 0

        def flush() -> pa.RecordBatch:
            tokens = np.concatenate([t for t, _ in held])
            first = np.cumsum(np.concatenate([[0], *(np.diff(f) for _, f in held)]))
            counts, logs = model.score(tokens, _contexts(tokens, first))
            base = np.log10((counts + 0.1) / (model.tokens + 0.1 * (model.words + 1)))
            n = np.diff(first)
            score = np.add.reduceat(logs, first[:-1])
            return pa.RecordBatch.from_arrays(
                [pa.array([x for i, _ in ids for x in i], pa.int64()), pa.array([x for _, h in ids for x in h], pa.bool_()),
                 pa.array(n), pa.array(np.add.reduceat((counts > 0).astype(np.int64), first[:-1])),
                 pa.array(np.full(len(n), model.tokens, np.int64)),
                 pa.array(np.add.reduceat(base, first[:-1])), pa.array(score), pa.array(10.0 ** (-score / n))], names)

        for batch in batches:
            ident, out_of = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for row, tokens, first in _tokens(batch.column(1)):
                rows = len(first) - 1
                ids.append((ident[row:row + rows], out_of[row:row + rows]))
                held.append((tokens, first))
                size += len(tokens)
                if size >= STRETCH:
                    yield flush()
                    ids, held, size = [], [], 0
        if held:
            yield flush()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       held_out(F.col(id_col)).alias("held_out")).mapInArrow(scores, SCHEMA)


def language_model_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on the documents that are not held out, score all of them."""
    model = train(docs.where(~held_out(F.col(id_col))), text_col=text_col)
    return score_documents(docs, model, id_col, text_col)
