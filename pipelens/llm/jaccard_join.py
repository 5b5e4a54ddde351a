"""N-gram Jaccard join by T-occurrence search (operator 9).

Two documents link when 100 * |A and B| >= 75 * |A or B| over their sets of
distinct word shingles, that is when they share at least T = 3/7 (|A| + |B|)
of them. All links between different sets that matter for the components are
found exactly.

1. Postings. Tasks turn texts into sets of shingle hashes and send (shingle,
   document) to the shingle's shard, packed, one document per distinct set and
   stretch of input. A shard knows in how many documents each shingle stands
   and sends back what stands in more than one.
2. Survivors. Ordered from rare to frequent, a document's first |A|/4 + 1
   shingles must hold one it shares with any partner. Documents whose shingles
   found nowhere else fill that prefix have no partner; the others keep their
   shared shingles and the rest of the prefix.
3. Heads. Documents with a common prefix shingle are first paired with the
   smallest of the list only, linear in the list. Verified pairs give a first
   set of components.
4. Blocks. A list that still spans several components is cut into blocks of
   members, its largest component apart from the others. Lists of the same
   members are searched once. Members whose size and place in the order leave
   them a partner in another component go to the pair of blocks with their sets. A task emits a spanning forest of the links
   it finds, never pairs, so what leaves it is no more than what came in.
5. T-occurrence. A block of documents is a set of inverted lists. Following
   DivideSkip a query sets the longest lists aside, merges the short ones into
   counts, and probes the long lists by binary search for the documents whose
   count can still reach T.

Sizes and remaining shingles bound the overlap and drop hopeless heads early.
Shards are as many as ``spark.sql.shuffle.partitions``.

Defined results: a null, empty or blank text has an empty set, size 0, and is
its own component; with fewer words than a shingle has, the whole sequence is
the one shingle; rows of equal sets are one class and take the smallest id of
its component; rows of one id and different texts are one node; a row with a
null id takes part in nothing and keeps a null component; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipelens.llm import blocks as B
from pipelens.llm.components import components
from pipelens.session import scratch_path

SHINGLE = 5
#: Postings and documents that a task holds before it sends them on.
HOLD, HOLD_DOCS = 2 << 20, 60_000
#: Members of one list, or partners of one document, in a block, and the
#: shingles of a list's block.
BLOCK, BLOCK_SHINGLES = 1024, 4 << 20
_SECOND = np.uint64(0xA24BAED4963EE407)


def shingle_sets(block: B.Block, shingle: int, salt: int) -> tuple[np.ndarray, ...]:
    """(text, hash) of the distinct shingles in order, set sizes, and two
    fingerprints of each set."""
    block = block._replace(data=B.LOWER[block.data])
    words = B.find_words(block)
    own = B.Hasher(block.data, salt)(words.start, words.end)
    at = words.windows(shingle)
    text, hashes = words.text[at], B.window_hashes(own, at, shingle)
    n_words = np.diff(words.first)
    for n in range(1, shingle):
        few = np.flatnonzero(n_words == n)
        text = np.append(text, few)
        hashes = np.append(hashes, B.mix(B.window_hashes(own, words.first[few], n) + np.uint64(n)))
    order = np.lexsort((hashes, text))
    text, hashes = text[order], hashes[order]
    if len(text):
        new = np.append(True, (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1]))
        text, hashes = text[new], hashes[new]
    sizes = np.bincount(text, minlength=block.rows)
    prints = []
    for spread in (B.mix(hashes), B.mix(hashes + _SECOND)):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(spread, dtype=np.uint64)])
        ends = np.cumsum(sizes)
        prints.append(B.mix(sums[ends] - sums[ends - sizes] + sizes.astype(np.uint64)))
    return text, hashes, sizes, *prints


def _bytes(values: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _values(held: pa.Scalar, width: int) -> np.ndarray:
    narrow = np.frombuffer(held.as_buffer(), np.uint8).reshape(-1, width)
    out = np.zeros((len(narrow), 8), np.uint8)
    out[:, :width] = narrow
    return out.reshape(-1).view("<u8")


def _shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


_SENT = "shard int, flush long, tokens binary, docs binary, n_docs binary, ids binary, sets binary, checks binary, sizes binary, nulls binary"
_NAMES = [c.split()[0] for c in _SENT.split(", ")]
_BACK = _SENT.replace("n_docs", "times")
_DOC = ("doc_id long, cls long, check long, n_shingles long, flush long, prefix binary, shared binary")


def _row(**held) -> dict:
    return {n: held.get(n) for n in _NAMES}


def _batch(rows: list[dict], schema: str) -> pa.RecordBatch:
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays(
        [pa.array([r.get(n) for r in rows], kinds[c.split()[1]]) for n, c in zip(names, schema.split(", "), strict=True)],
        names)


def _survivors(docs: DataFrame, shingle: int, salt: int, shards: int) -> DataFrame:
    """Steps 1 and 2: a row per document, with prefix and shared shingles where
    it can have partners. A shingle's rank in its document's order from rare to
    frequent is its place in ``shared``."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flush = TaskContext.get().partitionId() << 24
        held: list[tuple] = []
        docs_held = size = 0

        def rows() -> list[dict]:
            base = np.cumsum([0, *(len(h[0]) for h in held)])
            ids = [x for h in held for x in h[0]]
            text = np.concatenate([h[1] + b for h, b in zip(held, base, strict=False)])
            hashes, sizes, sets, checks = (np.concatenate([h[i] for h in held]) for i in range(2, 6))
            named = np.flatnonzero([i is not None for i in ids])
            once = np.zeros(len(ids), bool)
            once[named[np.unique(sets[named], return_index=True)[1]]] = True
            own = once[text]
            text, hashes = text[own], hashes[own]
            order = np.argsort(hashes, kind="stable")
            text, hashes = text[order], hashes[order]
            cuts = np.searchsorted(_shard(hashes, shards), np.arange(shards + 1))
            out = [_row(shard=int(s), flush=flush, tokens=_bytes(hashes[cuts[s]:cuts[s + 1]], 5),
                        docs=_bytes(text[cuts[s]:cuts[s + 1]], 2)) for s in np.flatnonzero(np.diff(cuts))]
            return [*out, _row(shard=flush % shards, flush=flush, sets=sets.tobytes(), checks=checks.tobytes(),
                               ids=np.array([i or 0 for i in ids], np.int64).tobytes(),
                               nulls=np.array([i is None for i in ids], bool).tobytes(),
                               sizes=sizes.astype("<i8").tobytes())]

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for block in B.text_blocks(batch.column(1)):
                text, hashes, sizes, one, two = shingle_sets(block, shingle, salt)
                held.append((ids[block.first:block.first + block.rows], text, hashes, sizes, one, two))
                docs_held, size = docs_held + block.rows, size + len(text)
                if size >= HOLD or docs_held + B.BATCH_ROWS > HOLD_DOCS:
                    yield _batch(rows(), _SENT)
                    flush, held, docs_held, size = flush + 1, [], 0, 0
        if held:
            yield _batch(rows(), _SENT)

    def share(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """What of a shard's shingles stands in more than one document."""
        passed = table.filter(pa.compute.is_null(table["tokens"])).rename_columns(
            ["times" if n == "n_docs" else n for n in table.column_names])
        table = table.filter(pa.compute.is_valid(table["tokens"]))
        parts = [_values(x, 5) for c in table["tokens"].chunks for x in c]
        if not parts:
            return passed
        tokens = np.concatenate(parts)
        order = np.argsort(tokens, kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(tokens[order]) != 0))
        runs = np.diff(np.append(first, len(tokens)))
        times = np.empty(len(tokens), np.int64)
        times[order] = np.repeat(runs, runs)
        rows, at = [], 0
        docs = [_values(x, 2) for c in table["docs"].chunks for x in c]
        for flush, own, doc in zip(table["flush"].to_pylist(), parts, docs, strict=True):
            common = times[at:at + len(own)] > 1
            if common.any():
                rows.append(_row(shard=key[0].as_py(), flush=flush, tokens=_bytes(own[common], 5),
                                 docs=_bytes(doc[common], 2))
                            | {"times": _bytes(np.minimum(times[at:at + len(own)][common], 65_535), 2)})
            at += len(own)
        return pa.concat_tables([passed, pa.Table.from_batches([_batch(rows, _BACK)])])

    def gather(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """One row per document of a stretch of input."""
        flush, known, parts = key[0].as_py(), None, []
        for row in table.select([n for n in table.column_names if n != "flush"]).to_pylist():
            if row["tokens"] is None:
                known = row
            else:
                low, doc, times = (_values(pa.scalar(row[n], pa.binary()), w)
                                   for n, w in (("tokens", 5), ("docs", 2), ("times", 2)))
                parts.append((low | np.uint64(row["shard"] << 40), doc.astype(np.int64), times))
        ids, sizes = np.frombuffer(known["ids"], np.int64), np.frombuffer(known["sizes"], np.int64)
        nulls = np.frombuffer(known["nulls"], bool)
        prefix, shared = [None] * len(ids), [None] * len(ids)
        if parts:
            tokens, doc, times = (np.concatenate(x) for x in zip(*parts, strict=True))
            held = np.bincount(doc, minlength=len(ids))
            slots = sizes // 4 + 1 - (sizes - held)
            own = slots[doc] > 0
            tokens, doc, times = tokens[own], doc[own], times[own]
            order = np.lexsort((tokens, times, doc))
            tokens, doc = tokens[order], doc[order]
            cuts = np.searchsorted(doc, np.arange(len(ids) + 1))
            for d in np.flatnonzero(np.diff(cuts)):
                mine = tokens[cuts[d]:cuts[d + 1]]
                prefix[d], shared[d] = mine[:slots[d]].tobytes(), mine.tobytes()
        return pa.table({"doc_id": pa.array(ids, pa.int64(), mask=nulls),
                         "cls": np.frombuffer(known["sets"], np.int64), "check": np.frombuffer(known["checks"], np.int64),
                         "n_shingles": sizes, "flush": np.full(len(ids), flush),
                         "prefix": pa.array(prefix, pa.binary()), "shared": pa.array(shared, pa.binary())})

    return (docs.mapInArrow(send, _SENT).groupBy("shard").applyInArrow(share, _BACK)
            .groupBy("flush").applyInArrow(gather, _DOC))


class InvertedLists:
    """The inverted lists of some records, each a set of distinct shingles."""

    def __init__(self, records: list[np.ndarray], sizes: np.ndarray) -> None:
        self.sizes = sizes
        number = np.repeat(np.arange(len(records)), [len(r) for r in records])
        tokens = np.concatenate(records)
        order = np.lexsort((number, tokens))
        tokens = tokens[order]
        first = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1])[:len(tokens)])
        self.tokens, self.cuts = tokens[first], np.append(first, len(tokens))
        self.held = number[order]
        # (list, record) as one ascending number, for probes of many lists at once
        self.entries = np.repeat(np.arange(len(first)), np.diff(self.cuts)) * len(records) + self.held

    def search(self, query: np.ndarray, size: int, open_to: np.ndarray) -> np.ndarray:
        """The records of ``open_to`` (flags) that share at least
        3/7 (size + their size) shingles with the query."""
        at = np.searchsorted(self.tokens, query)
        at[at == len(self.tokens)] = 0
        at = at[self.tokens[at] == query] if len(self.tokens) else at[:0]
        # a partner has at least 3/4 of the query's size, so T is at least this
        least = -(-3 * (size + -(-3 * size // 4)) // 7)
        if len(at) < least:
            return at[:0]
        length = self.cuts[at + 1] - self.cuts[at]
        # lists set aside: as many as the lowest T leaves room for, the longest
        # first, fewer when the longest is long (a probe costs its logarithm)
        aside = min(int(least / (0.01 * np.log2(max(2, int(length.max()))) + 1)), least - 1)
        by_length = np.argsort(length, kind="stable")
        short, long = at[by_length[:len(at) - aside]], at[by_length[len(at) - aside:]]
        length = self.cuts[short + 1] - self.cuts[short]
        merged = np.repeat(self.cuts[short + 1] - np.cumsum(length), length) + np.arange(length.sum())
        found = np.bincount(self.held[merged], minlength=len(self.sizes))
        need = -(-3 * (size + self.sizes) // 7)
        alive = np.flatnonzero((found >= need - len(long)) & (4 * self.sizes >= 3 * size) & open_to)
        if len(alive) and len(long):
            probe = long[:, None] * len(self.sizes) + alive
            place = np.minimum(np.searchsorted(self.entries, probe), len(self.entries) - 1)
            found[alive] += (self.entries[place] == probe).sum(0)
        return alive[found[alive] >= need[alive]]


def divide_skip(query: np.ndarray, query_size: int, records: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
    """Which records share at least 3/7 (query_size + size) shingles with the
    query. ``records`` hold distinct shingles."""
    linked = np.zeros(len(records), bool)
    linked[InvertedLists(records, sizes).search(query, query_size, ~linked)] = True
    return linked


def spanning_links(sets: list[np.ndarray], sizes: np.ndarray, part: np.ndarray, second: np.ndarray) -> list[tuple]:
    """Links (query, partner) that join the components ``part`` of these
    documents as all links between the blocks ``~second`` and ``second`` do, or
    all links among them when ``second`` has none; one for each union."""
    label = np.unique(part, return_inverse=True)[1]
    alone = not second.any()
    partners = np.arange(len(sets)) if alone else np.flatnonzero(second)
    lists = InvertedLists([sets[i] for i in partners], sizes[partners])
    links = []
    for q in np.arange(len(sets)) if alone else np.flatnonzero(~second):
        open_to = label[partners] != label[q]
        if alone:
            open_to[:q + 1] = False
        if not open_to.any():
            continue
        for p in partners[lists.search(sets[q], int(sizes[q]), open_to)]:
            if label[p] != label[q]:
                links.append((q, p))
                label[label == label[p]] = label[q]
    return links


def _search(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Step 5 for one document (the row with ``asks``) and a block of partners."""
    rows = table.combine_chunks()
    asks = rows["asks"].to_numpy()
    sets = [np.frombuffer(x.as_buffer(), "<u8") for c in rows["shared"].chunks for x in c]
    sizes, cls = rows["n"].to_numpy(), rows["cls"].to_numpy()
    one, others = int(np.flatnonzero(asks)[0]), np.flatnonzero(~asks)
    linked = others[divide_skip(sets[one], int(sizes[one]), [sets[i] for i in others], sizes[others])]
    return pa.table({"a": np.full(len(linked), cls[one]), "b": cls[linked]})


def _written(rows: DataFrame, name: str) -> DataFrame:
    path = scratch_path(rows.sparkSession, f"jaccard-{name}")
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The links (a, b) among candidate ``pairs(a, b)`` of classes."""
    blocks = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    split = _written(pairs.join(blocks, "a").select(
        "a", "b", F.pmod(F.xxhash64("b"), F.col("blocks")).alias("salt")), "split")
    partners = split.join(sets, split.b == sets.cls).select("a", "salt", F.lit(False).alias("asks"), "cls", "n", "shared")
    asking = split.select("a", "salt").distinct().join(sets, F.col("a") == sets.cls).select(
        "a", "salt", F.lit(True).alias("asks"), "cls", "n", "shared")
    return partners.unionByName(asking).groupBy("a", "salt").applyInArrow(_search, "a long, b long")


def _fits(one, other):
    """Bounds that a linked pair meets at its first common shingle."""
    n, m = F.col(f"{one}n"), F.col(f"{other}n")
    return ((4 * F.least(n, m) >= 3 * F.greatest(n, m))
            & (7 * F.least(F.col(f"{one}rest"), F.col(f"{other}rest")) >= 3 * (n + m)))


_BLOCK_PAIR = ["token", "one", "other"]
_MEMBER = "cls long, n long, rest long, part long, token long, block int, one int, other int"


def _by_block_pair(rows: DataFrame, search, schema: str) -> DataFrame:
    """``search`` of the members of every pair of blocks."""
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the last pair of blocks seen
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in _BLOCK_PAIR], 1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for at, to in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                if held and tuple(keys[at]) != last:
                    yield from search(pa.Table.from_batches(held).combine_chunks())
                    held = []
                held.append(batch.slice(at, to - at))
                last = tuple(keys[at])
        if held:
            yield from search(pa.Table.from_batches(held).combine_chunks())

    return rows.repartition(*_BLOCK_PAIR).sortWithinPartitions(*_BLOCK_PAIR).mapInArrow(stream, schema)


def _hopeful(rows: pa.Table) -> list[pa.RecordBatch]:
    """The members whose size and place leave them a partner in another
    component, if this is the first shingle in common."""
    n, rest, part, block = (rows[c].to_numpy() for c in ("n", "rest", "part", "block"))
    left = np.flatnonzero(block == rows["one"][0].as_py())
    right = np.flatnonzero(block == rows["other"][0].as_py())
    a, b = n[left][:, None], n[right]
    fine = (part[left][:, None] != part[right]) & (4 * np.minimum(a, b) >= 3 * np.maximum(a, b))
    fine &= 7 * np.minimum(rest[left][:, None], rest[right]) >= 3 * (a + b)
    some = np.zeros(len(n), bool)
    some[left[fine.any(1)]] = some[right[fine.any(0)]] = True
    return rows.filter(pa.array(some)).to_batches() if some.any() else []


def _forest(rows: pa.Table) -> list[pa.RecordBatch]:
    """Step 5 for a pair of blocks."""
    cls, n, part, block = (rows[c].to_numpy() for c in ("cls", "n", "part", "block"))
    sets = [np.frombuffer(x.as_buffer(), "<u8") for x in rows["shared"]]
    links = np.array(spanning_links(sets, n, part, block != rows["one"][0].as_py()), np.int64).reshape(-1, 2)
    return [pa.RecordBatch.from_arrays([pa.array(cls[links[:, 0]]), pa.array(cls[links[:, 1]])], ["a", "b"])]


def _across(lists: DataFrame, parts: DataFrame, sets: DataFrame) -> DataFrame:
    """Verified links (a, b) that join what ``parts`` leaves apart."""
    placed = _written(lists.join(parts.withColumnRenamed("id", "cls"), "cls", "left").select(
        "token", "cls", "n", "rest", F.coalesce("component", "cls").alias("part")), "placed")
    members = placed.groupBy("token", "part").agg(
        F.count("*").alias("c"), F.sum("n").alias("n"), F.sum("rest").alias("rest"), F.bit_xor(F.xxhash64("cls")).alias("x"),
        F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("y"))
    spans = members.groupBy("token").agg(
        F.sum("c").alias("k"), F.sum("n").alias("n"), F.sum("rest").alias("rest"), F.max(F.struct("c", "part", "n")).alias("most"),
        F.count("*").alias("parts"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")).where("parts > 1")
    # of lists with the same members, that of their rarest shingle stays: most of
    # their shingles are still to come there, so the bounds of all pairs hold
    spans = spans.groupBy("k", "n", "x", "y").agg(F.max(F.struct("rest", "token", "most")).alias("l"))

    def blocks(rows, shingles):
        return F.greatest(F.ceil(rows / BLOCK), F.ceil(shingles / BLOCK_SHINGLES)).cast("int")

    spans = spans.select("l.token", F.col("l.most.part").alias("largest"),
                         blocks(F.col("l.most.c"), F.col("l.most.n")).alias("inner"),
                         blocks(F.col("k") - F.col("l.most.c"), F.col("n") - F.col("l.most.n")).alias("outer"))
    # the largest component's blocks come first and do not meet each other
    inside = F.col("part") == F.col("largest")
    with_all = F.sequence(F.lit(0), F.col("inner") + F.col("outer") - 1)
    with_outer = F.sequence(F.col("inner"), F.col("inner") + F.col("outer") - 1)
    own = F.xxhash64("cls")
    met = (placed.join(spans, "token")
           .withColumn("block", F.when(inside, F.pmod(own, "inner")).otherwise(F.col("inner") + F.pmod(own, "outer")).cast("int"))
           .withColumn("with", F.explode(F.when(inside, with_outer).otherwise(with_all)))
           .select("cls", "n", "rest", "part", "token", "block", F.least("block", "with").cast("int").alias("one"),
                   F.greatest("block", "with").cast("int").alias("other")))
    hopeful = _written(_by_block_pair(met, _hopeful, _MEMBER), "hopeful")
    return _by_block_pair(hopeful.join(sets.select("cls", "shared"), "cls"), _forest, "a long, b long")


def similar(docs: DataFrame, shingle: int = SHINGLE, shards: int | None = None, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """One row per document: its set size and its component."""
    spark = docs.sparkSession
    B.small_batches(spark)
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    for salt in count():  # a second fingerprint tells whether two sets took one
        rows = _written(_survivors(docs, shingle, salt, shards), "documents")
        classes = _written(rows.where("n_shingles > 0 and doc_id is not null").groupBy("cls").agg(
            F.min("doc_id").alias("rep"), F.min(F.when(F.col("prefix").isNotNull(), F.col("flush"))).alias("flush"),
            (F.min("check") != F.max("check")).alias("clash")), "classes")
        if not classes.where("clash").limit(1).count():
            break
    # one document stands for each class that can have partners
    alive = classes.where("flush is not null").select("cls", "flush")
    sets = _written(rows.where("prefix is not null").join(alive, ["cls", "flush"], "left_semi")
                   .select("cls", F.col("n_shingles").alias("n"), "prefix", "shared"), "sets")

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefix = [np.frombuffer(x.as_buffer(), "<i8") for x in batch.column("prefix")]
            k = np.array([len(p) for p in prefix], np.int64)
            if not k.sum():
                continue
            at = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            shared = np.repeat(batch.column("held").to_numpy() // 8, k)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(prefix)), *(pa.array(np.repeat(batch.column(c).to_numpy(), k)) for c in ("cls", "n")),
                 pa.array(shared - at)], ["token", "cls", "n", "rest"])

    postings = (sets.select("cls", "n", "prefix", F.octet_length("shared").cast("long").alias("held"))
                .mapInArrow(explode, "token long, cls long, n long, rest long"))
    heads = postings.groupBy("token").agg(F.min(F.struct("cls", "n", "rest")).alias("h"), F.count("*").alias("k")).where("k > 1")
    lists = _written(postings.join(heads, "token").select(
        "token", "cls", "n", "rest", "k", F.col("h.cls").alias("hcls"), F.col("h.n").alias("hn"),
        F.col("h.rest").alias("hrest")), "lists")
    sets = sets.select("cls", "n", "shared")
    pairs = _written(lists.where(F.col("cls") != F.col("hcls")).where(_fits("", "h")).select(
        F.least("hcls", "cls").alias("a"), F.greatest("hcls", "cls").alias("b")).distinct(), "heads")
    links = [_written(_verified(pairs, sets), "links")]
    parts = _written(components(links[0]), "parts")
    links.append(_written(_across(lists, parts, sets), "links"))
    links = reduce(DataFrame.unionByName, links)
    # ids that hold several texts join the classes of these
    held = rows.where("n_shingles > 0 and doc_id is not null").select("cls", "doc_id")
    several = held.join(classes, "cls").where("doc_id != rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    named = links.join(classes.select(F.col("cls").alias("a"), F.col("rep").alias("ra")), "a").join(
        classes.select(F.col("cls").alias("b"), F.col("rep").alias("rb")), "b").select(
        F.col("ra").alias("a"), F.col("rb").alias("b"))
    group = components(named.unionByName(several))
    return rows.select("doc_id", "n_shingles").join(group.withColumnRenamed("id", "doc_id"), "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents whose id is their component's smallest, with all columns; of
    rows that repeat that id, the one with the smallest text, and among equal
    texts the smallest of their other columns as JSON. Rows with a null id stay."""
    found = similar(docs, id_col=id_col, text_col=text_col)
    drop = found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(id_col)).distinct()
    again = found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(id_col))
    kept = docs.join(drop, id_col, "left_anti")
    order = F.struct(F.col(text_col).alias("a"), F.to_json(F.struct(*docs.columns)).alias("b"))
    chosen = (kept.join(again, id_col, "left_semi").groupBy(id_col)
              .agg(F.min_by(F.struct(*docs.columns), order).alias("row")).select("row.*"))
    return kept.join(again, id_col, "left_anti").unionByName(chosen)
