"""Language model, classifier, mixing, packing and the pipeline."""

import math
import os
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import LOWER, words
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from pipelens.llm import language_model, mixing, packing, quality, queries, secrets
from pipelens.llm.byte_bpe import byte_bpe
from pipelens.session import scratch_path
from pipelens.llm.discounts import discounts

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


# --- language model -------------------------------------------------------

def plain_scores(rows):
    tokens = [[*words((t or "").translate(LOWER)), "</s>"] for _, t in rows]
    out = [zlib.crc32(str(i).encode()) % 10 == 0 if i is not None else True for i, _ in rows]
    one, two = Counter(), Counter()
    for t, held in zip(tokens, out, strict=True):
        if not held:
            one.update(t)
            two.update(zip(["<s>", *t[:-1]], t, strict=True))
    n, v, types = sum(one.values()), len(one), len(two)
    stands, follow = Counter(w for _, w in two), defaultdict(list)
    for (h, _), c in two.items():
        follow[h].append(c)
    by_two = discounts(*(sum(c == k for c in two.values()) for k in (1, 2, 3, 4)))
    by_one = discounts(*(sum(c == k for c in stands.values()) for k in (1, 2, 3, 4)))
    left = sum(by_one[min(c, 3)] for c in stands.values()) / types if types else 1.0
    found = []
    for (i, _), t, held in zip(rows, tokens, out, strict=True):
        score = base = 0.0
        for h, w in zip(["<s>", *t[:-1]], t, strict=True):
            p = left / (v + 1) + (max(stands[w] - by_one[min(stands[w], 3)], 0) / types if types else 0)
            if h in follow:
                total, c = sum(follow[h]), two[h, w]
                p = max(c - by_two[min(c, 3)], 0) / total + sum(by_two[min(x, 3)] for x in follow[h]) / total * p
            score += math.log10(p)
            base += math.log10((one[w] + 0.1) / (n + 0.1 * (v + 1)))
        found.append((i, held, len(t), sum(w in one for w in t), n, base, score))
    return found


def check_scores(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((tuple(r)[:7] for r in language_model.language_model_scores(docs).collect()), key=repr)
    want = sorted(plain_scores(rows), key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9, atol=1e-9)


def test_language_model(documents, awkward):
    check_scores(documents)
    check_scores(awkward)


def test_language_model_without_training_text(awkward, no_documents):
    check_scores(awkward.where("doc_id is null"))
    assert language_model.language_model_scores(no_documents).count() == 0


def test_language_model_small_holds_and_hot_contexts(documents, monkeypatch):
    """Many packets, more shards than words per shard, counts over a byte."""
    monkeypatch.setattr(language_model, "HOLD", 2000)
    monkeypatch.setattr(language_model, "STRETCH", 500)
    docs = documents.limit(40).withColumn("text", F.concat("text", F.lit(" of the" * 300)))
    model = language_model.train(docs.where(~language_model.held_out(F.col("doc_id"))), shards=17)
    assert len(model.hot) > 1
    got = {r.doc_id: r.score for r in language_model.score_documents(docs, model).collect()}
    want = {x[0]: x[6] for x in plain_scores([(r.doc_id, r.text) for r in docs.collect()])}
    assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], rel_tol=1e-9) for i in want)


def test_discounts():
    d = discounts(100, 40, 20, 10)
    y = 100 / 180
    assert np.allclose(d, [0, 1 - 2 * y * 0.4, 2 - 3 * y * 0.5, 3 - 4 * y * 0.5])
    assert discounts(5, 0, 1, 1).tolist() == [0, 0.5, 1, 1.5]


# --- quality classifier ---------------------------------------------------

def test_byte_model_sums_to_one(spark, documents):
    labels = documents.select("doc_id", F.lit(1).alias("quality"))
    model = quality.train(documents, labels)
    context = int.from_bytes(b"the ", "big")
    for known in (context, int.from_bytes(b"\x02\x02\x02\x02", "big"), int.from_bytes(b"zq\xf0\x01", "big")):
        p = 10.0 ** model.log10(np.array([known << 8 | b for b in range(256)]))
        assert abs(p.sum() + 1 / 257 * 0 - 1) < 0.01


def test_quality_held_out_accuracy(spark):
    """Labels that the classifier doesn't see tell clean from junk."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    seen = labels.where(F.pmod(F.xxhash64("doc_id", F.lit("test")), F.lit(3)) > 0)
    got = quality.verdicts(docs, seen).join(labels.join(seen.select("doc_id"), "doc_id", "left_anti"), "doc_id")
    share = {r.quality: r.k for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert share[1] >= 0.97 and share[0] <= 0.2


def test_quality_awkward_rows(spark, awkward, no_documents):
    labels = spark.createDataFrame([(10, 1, 0), (11, 1, 0), (10, 0, 0), (None, 1, 0), (13, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    assert sorted(r._id for r in quality.trusted_ids(labels).collect()) == [11, 13]
    for docs in (awkward, no_documents):
        for given_labels in (labels, labels.where("false")):
            got = quality.classify(docs, given_labels)
            assert got.count() == docs.count()
            assert set(got.columns) == set(docs.columns) | {"smoothed", "threshold", "kept"}
            if given_labels.count() == 0:
                assert got.where("not kept").count() == 0


def test_quality_limits_of_scarce_languages(spark):
    """Unlabelled languages are kept, few unseen trusted documents widen the
    limit, and from the stated number on it is their quantile."""
    ids = spark.range(4000).select(F.col("id").alias("doc_id"), quality._trains("id").alias("t")).collect()
    unseen, seen = ([r.doc_id for r in ids if r.t == t] for t in (False, True))
    rows, trusted = [], []

    def add(lang, doc, perplexity, label=True):
        rows.append((doc, lang, float(perplexity), 1000))
        if label:
            trusted.append((doc, 1))

    for i in range(quality.MIN_UNSEEN):
        add("much", unseen.pop(), 4 + i % 10 / 100)
    for i in range(3):
        add(None, unseen.pop(), 6 + i / 100)
    add("unseen", unseen.pop(), 7)  # labelled, but not in the training half
    for lang in ("much", None, "trained"):
        add(lang, seen.pop(), 4)
    for lang, perplexity in (("much", 6), (None, 6.6), (None, 30), ("unseen", 30), ("new", 30), ("trained", 30)):
        add(lang, 5000 + len(rows), perplexity, False)
    scored = spark.createDataFrame(rows, "doc_id long, lang string, perplexity double, n_bytes long")
    labels = spark.createDataFrame(trusted, "doc_id long, quality int")
    got = quality.judged(scored, labels).where("doc_id >= 5000").orderBy("doc_id").collect()
    assert [r.kept for r in got] == [False, True, False, True, True, True]
    assert abs(got[0].threshold - 4.09 * quality.MARGIN) < 0.05
    assert 1.4 * 6 < got[1].threshold < 1.6 * 7.5 and [r.threshold for r in got[3:]] == [None] * 3


# --- mixing ---------------------------------------------------------------

def test_mix_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(queries.SQL["op6_poisson_mix"]).df().sort_values("shuffle_key")
    got = queries.op6_poisson_mix(spark, sf).toPandas().sort_values("shuffle_key")
    assert want[got.columns].values.tolist() == got.values.tolist()


def test_mix_follows_poisson(spark):
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit("abcd").alias("text"),
                                      F.when(F.col("id") < 30_000, "big").otherwise("small").alias("source"))
    got = mixing.poisson_mix(docs, {"big": 1.0, "small": 2.0})
    shares = {r.source: r.n for r in got.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert abs(shares["big"] - 40_000 / 3) < 500 and abs(shares["small"] - 80_000 / 3) < 700
    times = got.where("source = 'small'").groupBy("doc_id").count().groupBy("count").agg(F.count("*").alias("n")).collect()
    rate = 8 / 3
    for r in times:
        p = math.exp(-rate) * rate ** r["count"] / math.factorial(r["count"])
        assert abs(r.n - 10_000 * p) < 5 * math.sqrt(10_000 * p) + 5
    high = mixing.poisson_mix(docs.where("doc_id >= 39900"), epochs=300.0).groupBy("doc_id").count()
    assert abs(high.agg(F.avg("count")).first()[0] - 300) < 10  # several parts of a rate


def test_mix_awkward_rows(awkward, no_documents, monkeypatch):
    key = ["doc_id", "copy", "shuffle_key", "source"]
    usual = sorted(map(repr, mixing.poisson_mix(awkward, epochs=3.0).select(*key).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)  # the salted join gives the same
    assert usual == sorted(map(repr, mixing.poisson_mix(awkward, epochs=3.0).select(*key).collect()))
    assert mixing.poisson_mix(no_documents).count() == 0
    again = mixing.poisson_mix(awkward, epochs=3.0).where("doc_id = 10").groupBy("copy").count().collect()
    assert {r["count"] for r in again} <= {3}  # three equal rows are repeated alike


# --- packing --------------------------------------------------------------

@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200))
def test_encoder_equals_tokenizers(text):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    assert byte_bpe(VOCABULARY).encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|endof", "text|>", " ", "  ", "\n", "a", "don't", "é", "日", "12"]),
                max_size=12).map("".join))
def test_encoder_equals_tokenizers_by_default(text):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    assert byte_bpe(VOCABULARY).encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_packing_of_very_long_runs(spark):
    texts = [" " * 1_000_000, "\n" * 1_000_000, "a" * 1_000_000]
    tokenizer = Tokenizer.from_file(VOCABULARY)
    pieces = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), VOCABULARY).collect()
    for doc, text in enumerate(texts):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4")
        own = sorted((p for p in pieces if p.doc_id == doc), key=lambda p: p.start)
        assert [p.ids_crc32 for p in own] == [zlib.crc32(ids[p.start:p.start + p.length].tobytes()) for p in own]
        assert sum(p.length for p in own) == len(ids)


def test_packing_added_tokens(spark):
    text = "one <|endoftext|>  two<|endoftext|>"
    ids = Tokenizer.from_file(VOCABULARY).encode(text, add_special_tokens=False).ids
    assert ids.count(50256) == 2
    pieces = packing.pack(spark.createDataFrame([(1, text)], "doc_id long, text string"), VOCABULARY).collect()
    pieces.sort(key=lambda p: p.start)
    ids = np.array([*ids, 1], "<u4")
    assert [(p.doc_tokens, p.ids_crc32) for p in pieces] == [
        (len(ids), zlib.crc32(ids[p.start:p.start + p.length].tobytes())) for p in pieces]
    assert sum(p.length for p in pieces) == len(ids)


def check_packing(docs, **options):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    texts = Counter((r.doc_id, r.text or "") for r in docs.collect())
    pieces = packing.pack(docs, VOCABULARY, **options).toPandas()
    window = options.get("window", packing.WINDOW)
    wanted = Counter()
    for (doc, text), times in texts.items():
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4")
        own = pieces[pieces.doc_id.isna() if doc is None else pieces.doc_id == doc]
        wanted[doc] += times * len(ids)
        for p in own.itertuples():
            if p.doc_tokens == len(ids):
                assert p.ids_crc32 == zlib.crc32(ids[p.start:p.start + p.length].tobytes())
    assert int(pieces.length.sum()) == sum(wanted.values())
    for _, s in pieces.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == (s.length.cumsum() - s.length).tolist()
        total = int(s.length.sum())
        assert total == window or total & (total - 1) == 0 and total < window
    return pieces


def test_packing(documents, awkward, no_documents):
    pieces = check_packing(documents)
    parts = pieces.sort_values("start").groupby("doc_id")
    assert (parts.length.sum() == parts.doc_tokens.first()).all()
    assert all((p.start == p.length.cumsum() - p.length).all() for _, p in parts)
    check_packing(awkward)
    check_packing(documents.limit(60), window=64, max_open=4)
    assert packing.pack(no_documents, VOCABULARY).count() == 0


def test_sum_of_squares_takes_the_smallest_growth():
    packer = packing.SumOfSquares(16, 1000, 0)
    rng = np.random.default_rng(0)
    for doc, size in enumerate(rng.integers(1, 16, 400)):
        before = packer.levels.copy()
        partly = lambda n: int((n[1:16] ** 2).sum())
        choices = []
        for h in range(16):
            if h + size <= 16 and (h == 0 or before[h]):
                after = before.copy()
                after[h] -= h > 0
                after[h + size] += h + size < 16
                choices.append(partly(after))
        list(packer.put(doc, np.zeros(size, np.uint32)))
        assert partly(packer.levels) == min(choices)
        assert packer.open == packer.levels.sum()


def test_sum_of_squares_with_few_open_windows():
    """The level array runs to the end; every id is placed once, in bounded space."""
    rng = np.random.default_rng(1)
    for sizes in (rng.integers(1, 16, 2000), np.full(500, 11), np.full(50, 1), [], [16, 32, 47]):
        packer, rows = packing.SumOfSquares(16, 8, 0), []
        for doc, size in enumerate(sizes):
            rows += packer.put(doc, np.arange(size, dtype=np.uint32))
            assert packer.open == packer.levels.sum() <= 8
        rows += packer.close()
        found = pd.DataFrame(rows, columns=[c.split()[0] for c in packing.SCHEMA.split(", ")])
        for doc, own in found.sort_values("start").groupby("doc_id"):
            assert own.length.sum() == sizes[doc] and (own.start == own.length.cumsum() - own.length).all()
        filled = found.groupby("sequence_id").agg(total=("length", "sum"), by=("closed_by", "first"))
        assert (filled.total[filled.by != "end"] == 16).all()
        assert ((filled.total & (filled.total - 1)) == 0).all()
        assert (filled.by == "end").sum() <= 8 + 4


def test_sum_of_squares_carries_the_packing(spark):
    """At least 80 % of the shared sequences of eight partitions come from the level array."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").repartition(8, "doc_id")
    shared = packing.pack(docs, VOCABULARY).where("closed_by <> 'document'").groupBy("closed_by").agg(
        F.countDistinct("sequence_id").alias("n"))
    n = {r.closed_by: r.n for r in shared.collect()}
    print("closed by", n)
    assert n["level"] >= 0.8 * sum(n.values())


# --- the pipeline ---------------------------------------------------------

def test_pipeline_stages(spark, tmp_path):
    """Each stage, on what the one before kept, against a plain version."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(os.path.join(tmp_path, str(k)))
        after = spark.read.parquet(os.path.join(tmp_path, str(k)))
        if k < 4:
            assert after.columns == docs.columns
        kept.append((docs, after))
        docs = after
    # 1: rows are unchanged, and trusted documents stay
    before, after = kept[0]
    assert after.exceptAll(before).count() == 0
    good = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").select("doc_id")
    assert good.join(before, "doc_id", "left_semi").count() - good.join(after, "doc_id", "left_semi").count() <= 1
    # 2: the smallest id of each group of brute-force links
    from test_duplicates import plain_jaccard
    before, after = kept[1]
    parts = plain_jaccard([(r.doc_id, r.text) for r in before.collect()])
    assert sorted(r.doc_id for r in after.collect()) == sorted(i for i, c in parts.items() if i == c)
    # 3: texts lose exactly the spans
    before, after = kept[2]
    got = {r.doc_id: (r.text, r.n_chars) for r in after.collect()}
    for r in before.collect():
        text = secrets.redact(r.text, secrets.scan_text(r.text))
        assert got[r.doc_id] == (text, len(text)) and secrets.scan_text(text) == []
    # 4: every row is one of those before, as often as its count says
    before, after = kept[3]
    counts = {r.doc_id: r.n for r in mixing.poisson_mix(before).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert {r.doc_id: r["count"] for r in after.groupBy("doc_id").count().collect()} == counts
    # 5: all tokens of all rows
    before, after = kept[4]
    tokenizer = Tokenizer.from_file(VOCABULARY)
    tokens = sum(len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in before.collect())
    assert after.agg(F.sum("length")).first()[0] == tokens


EXTRA = ["n_bytes", "perplexity", "kept", "_limit", "_mean", "_source", "_rate", "_cdf", "_count", "copy", "shuffle_key", "_rest", "h"]


def test_pipeline_stages_leave_other_columns_alone(spark, documents):
    """Columns named like those the stages work with, null ids and empty texts."""
    import corpus_pipeline
    values = [F.concat(F.lit(f"{c}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in EXTRA]
    odd = spark.createDataFrame([(None, None, None, None, None), (5000, "", "en", "s", 0), (5001, None, None, None, 0)], documents.schema)
    docs = documents.limit(80).unionByName(odd).select("*", *values)
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.columns == columns
        path = scratch_path(spark, "stage")
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
    rows = docs.collect()
    assert rows
    assert all(r[c] == f"{c}-{'none' if r.doc_id is None else r.doc_id}" for r in rows for c in EXTRA)
    empty = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "/root/testdata/sf0.001").count() == 0


def test_every_query_is_registered():
    import __spark_entry__
    names = set(__spark_entry__.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{k}" for k in range(1, 14)}
    assert "pipeline" in names


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql_twins(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(queries.SQL[name]).df()
    got = queries.REGISTRY[name](spark, sf).toPandas()
    assert sorted(got.columns) == sorted(want.columns)

    def plain(v):
        return None if pd.isna(v) else float(v) if isinstance(v, (int, float, np.number)) else v

    rows = [sorted(repr([plain(v) for v in row]) for row in f[sorted(got.columns)].values.tolist()) for f in (got, want)]
    assert rows[0] == rows[1]
