"""Near-duplicate and repeated-substring operators against brute force."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from llm_cases import LOWER, words
from pyspark.sql import functions as F

from pipelens.llm import blocks, components, embeddings, jaccard_join, substrings


def smallest_linked(nodes, links):
    """Smallest node reachable from each."""
    at = {n: n for n in nodes}

    def top(n):
        while at[n] != n:
            n = at[n]
        return n

    for a, b in links:
        a, b = top(a), top(b)
        at[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(3)
    chain = [(i, i + 1) for i in range(1000, 1400)]
    star = [(5, i) for i in range(2000, 2300)]
    loose = [tuple(map(int, x)) for x in rng.integers(0, 900, (400, 2))]
    links = chain + star + loose + [(7, 7), (5, 2001)]
    frame = spark.createDataFrame(links, "a long, b long")
    got = {r.id: r.component for r in components.components(frame).collect()}
    want = smallest_linked({x for link in links for x in link}, links)
    assert got == {k: v for k, v in want.items() if any(k in link and link[0] != link[1] for link in links)}
    assert components.components(frame.where("false")).count() == 0


# --- embeddings -----------------------------------------------------------

def plain_links(rows):
    fine = {}
    for i, v in rows:
        if i is not None and v and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0):
            fine.setdefault(i, set()).add(tuple(v))
    links = set()
    flat = [(i, np.array(v) / np.abs(v).max()) for i, vs in fine.items() for v in vs]
    for i, v in flat:
        for j, w in flat:
            if i < j and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.95:
                links.add((i, j))
    return links


@pytest.mark.parametrize("block", [1024, 3])
def test_near_vectors(spark, block):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 24))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(100 + i, (base[i] + rng.normal(size=24) * 0.1).tolist()) for i in range(40)]
    rows += [(200 + i, (base[0] + rng.normal(size=24) * 0.12).tolist()) for i in range(25)]
    rows += [(300, base[3].tolist()), (301, (base[3] * 1e200).tolist()), (302, (base[3] * 1e-200).tolist()),
             (303, [0.0] * 24), (304, None), (305, [float("nan")] * 24), (306, [None] + [1.0] * 23), (307, []),
             (308, [1.0]), (309, [2.0]), (310, [float("inf"), 1.0]), (None, base[3].tolist()), (300, base[3].tolist())]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("keys", F.lit("clash"))
    got = {r.vec_id: r for r in embeddings.near_vectors(frame, block=block).collect()}
    links = plain_links(rows)
    ids = {i for i, _ in rows if i is not None}
    count = defaultdict(int)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    parts = smallest_linked(ids, links)
    found = {i: (got[i].n_links, got[i].component_id, got[i].kept) for i in ids}
    assert found == {i: (count[i], parts[i], parts[i] == i) for i in ids}
    assert got[None].n_links == 0
    assert embeddings.near_vectors(frame.where("false")).count() == 0


@pytest.mark.parametrize("size", [16, 64, 300])
def test_near_vectors_recall_on_planted_vectors(spark, size):
    """Near copies at cosines around the limit, and one large group of them."""
    rng = np.random.default_rng(size)
    base = rng.normal(size=(500, size))
    near = base[:300] + rng.normal(size=(300, size)) * rng.uniform(0.05, 0.4, (300, 1))
    group = base[0] + rng.normal(size=(400, size)) * 0.1
    x = np.concatenate([base, near, group])
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    true = int(((x @ x.T >= 0.95).sum() - len(x)) // 2)
    found = embeddings.near_vectors(frame).agg(F.sum("n_links")).first()[0] // 2
    assert true > 50_000 and 0.99 * true <= found <= true


# --- n-gram Jaccard join --------------------------------------------------

def shingles(text):
    own = words((text or "").translate(LOWER))
    return {tuple(own[i:i + 5]) for i in range(max(1, len(own) - 4))} if own else set()


def plain_jaccard(rows):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    links = [(i, j) for k, (i, a) in enumerate(sets) for j, b in sets[:k]
             if a and b and 100 * len(a & b) >= 75 * len(a | b)]
    return smallest_linked({i for i, _ in sets}, links)


def check_jaccard(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((tuple(r) for r in jaccard_join.similar(docs).collect()), key=repr)
    parts = plain_jaccard(rows)
    assert got == sorted(((i, len(shingles(t)), parts.get(i)) for i, t in rows), key=repr)


def test_jaccard_join(documents, awkward, no_documents):
    check_jaccard(documents)
    check_jaccard(awkward)
    check_jaccard(no_documents)


@pytest.mark.parametrize("block", [1024, 4])
def test_jaccard_groups_and_edges(spark, monkeypatch, block):
    """Chains at the limit, a large group of near copies, and a passage that
    unlike documents share."""
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rng = np.random.default_rng(2)
    fresh = iter(range(10**6))
    new = lambda n: [f"n{next(fresh)}" for _ in range(n)]
    base, passage = new(60), new(40)
    texts = [base]
    for _ in range(40):  # near copies, some too far from the first
        copy = list(texts[rng.integers(len(texts))])
        at = int(rng.integers(0, len(copy) - 8))
        copy[at:at + int(rng.integers(1, 8))] = new(int(rng.integers(1, 8)))
        texts.append(copy)
    texts += [new(6) + passage + new(6) for _ in range(20)] + [passage + new(k) for k in range(1, 9)]
    texts += [texts[5], texts[5], new(3), passage[:4], passage[:4]]
    rows = [(1000 - k, " ".join(t)) for k, t in enumerate(texts)]
    check_jaccard(spark.createDataFrame(rows, "doc_id long, text string"))


def test_jaccard_null_id_before_equal_text(spark):
    """A row without an id does not stand for the rows of its text that follow."""
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text), (7, text), (3, text + " more"), (None, "alone it stands here, a text"), (None, text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    check_jaccard(docs)
    assert {r.doc_id: r.component_id for r in jaccard_join.similar(docs).collect()} == {None: None, 7: 3, 3: 3}
    check_jaccard(docs.where("doc_id is null"))


def test_divide_skip_equals_counting():
    rng = np.random.default_rng(4)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        query = rng.choice(100, n, replace=False).astype("<u8")
        records = [rng.choice(100, int(rng.integers(1, 60)), replace=False).astype("<u8") for _ in range(30)]
        records += [np.unique(np.append(query[1:], 200)).astype("<u8"), query]
        sizes = np.array([len(r) for r in records])
        got = jaccard_join.divide_skip(query, n, records, sizes)
        want = [7 * len(set(r) & set(query)) >= 3 * (len(r) + n) for r in records]
        assert got.tolist() == want


def test_one_of_each(awkward):
    kept = jaccard_join.one_of_each(awkward)
    parts = plain_jaccard([(r.doc_id, r.text) for r in awkward.collect()])
    assert kept.columns == awkward.columns
    got = sorted((r.doc_id for r in kept.collect()), key=repr)
    assert got == sorted([*{i for i, c in parts.items() if i == c}, None], key=repr)


def test_one_of_each_of_a_repeated_id(spark):
    """Of rows with one id, the smallest text; repeated rows once."""
    rows = [(1, "b b b b b b", "x"), (1, "a a a a a a", "z"), (1, "a a a a a a", "y"), (2, "c", "q"), (2, "c", "q"), (3, "b b b b b b", "r"), (4, None, None), (4, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, other string")
    got = sorted(tuple(r) for r in jaccard_join.one_of_each(frame).collect())
    assert got == [(1, "a a a a a a", "y"), (2, "c", "q"), (4, None, None)]


# --- repeated substrings --------------------------------------------------

def plain_removal(texts, length=200):
    held = [(t or "").encode() for t in texts]
    seen = defaultdict(int)
    for h in held:
        for i in range(len(h) - length + 1):
            seen[h[i:i + length]] += 1
    out = []
    for h in held:
        gone = np.zeros(len(h) + 1, bool)
        for i in range(len(h) - length + 1):
            if seen[h[i:i + length]] > 1:
                gone[i:i + length] = True
        gone = gone[:len(h)]
        runs = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        rest = np.frombuffer(h, np.uint8)[~gone].tobytes()
        out.append((len(h), int(gone.sum()), runs, hashlib.sha256(rest).hexdigest()))
    return out


def check_removal(docs, **options):
    rows = docs.collect()
    got = sorted((tuple(r) for r in substrings.remove_repeats(docs, **options).collect()), key=repr)
    want = [(r.doc_id, *x) for r, x in zip(rows, plain_removal([r.text for r in rows]), strict=True)]
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("hot", [substrings.HOT, 2])
def test_repeated_substrings(spark, awkward, no_documents, hot):
    short = awkward.withColumn("text", F.substring("text", 1, 5000))
    check_removal(short, hot=hot)
    check_removal(no_documents, hot=hot)
    rng = np.random.default_rng(6)
    word = lambda n: "".join(rng.choice(list("abcde é"), n))
    passage = word(450)
    texts = [word(300) + passage[a:b] + word(int(rng.integers(0, 300)))
             for a, b in rng.integers(0, 450, (60, 2)) if a < b]
    texts += [passage, passage[:199], passage[:200], passage[100:] + passage, "q" * 640]
    check_removal(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), hot=hot)


def test_repeated_substrings_of_given_table(documents):
    check_removal(documents.where("doc_id < 60"))


def test_merged_spans():
    start, stop = substrings.merged(np.array([5, 0, 9, 30]), np.array([8, 6, 12, 31]))
    assert (start.tolist(), stop.tolist()) == ([0, 9, 30], [8, 12, 31])


def test_blocks_split_between_texts():
    import pyarrow as pa
    texts = ["ab", None, "", "c" * 50, "de f"]
    for limit in (1, 3, 1000):
        got = []
        for block in blocks.text_blocks(pa.array(texts), limit):
            found = blocks.find_words(block)
            got += [(block.first + t, bytes(block.data[a:b])) for t, a, b in zip(found.text, found.start, found.end, strict=True)]
        assert got == [(0, b"ab"), (3, b"c" * 50), (4, b"de"), (4, b"f")]
