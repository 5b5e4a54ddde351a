"""Operator 11 against a brute-force search over all periods."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import words

from pipelens.llm import periodic_runs, queries


def brute_runs(seq):
    found = {}
    n = len(seq)
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if seq[i] != seq[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and seq[j] == seq[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e, q) for (s, e), q in found.items())


def found_runs(seq):
    symbols = np.unique(np.array(seq), return_inverse=True)[1]
    return [tuple(int(v) for v in r) for r in sorted(zip(*periodic_runs.runs_of(symbols), strict=True))]


def made(rng):
    """Nested repeats with errors, the hard case of blocks that repeat themselves."""
    seq = [rng.randrange(2) for _ in range(rng.randrange(1, 6))]
    while len(seq) < 40 or rng.random() < 0.5:
        part = seq[:rng.randrange(1, 30)]
        seq = seq + part * rng.randrange(1, 9) if rng.random() < 0.5 else part * rng.randrange(1, 9) + seq
        if rng.random() < 0.4:
            seq[rng.randrange(len(seq))] = rng.randrange(3)
        if rng.random() < 0.3:
            cut = rng.randrange(len(seq))
            seq = seq[cut:] + seq[:cut]
        if len(seq) > 400:
            break
    return seq


def test_runs_equal_brute_force_on_nested_repeats():
    rng = random.Random(11)
    some = 0
    for _ in range(1500):
        seq = made(rng)
        expected = brute_runs(seq)
        assert found_runs(seq) == sorted(expected), seq
        some += len(expected)
    assert some > 1000


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 1), min_size=1, max_size=6), st.lists(st.integers(0, 1), max_size=6),
       st.integers(1, 40), st.integers(1, 12))
def test_runs_of_two_level_repeats(a, b, inner, outer):
    seq = [3] + (a * inner + b) * outer + [4] + a * 30
    assert found_runs(seq) == brute_runs(seq)


def test_long_periods_and_all_equal():
    rng = random.Random(3)
    for p in (7, 8, 9, 15, 16, 17, 63, 64, 65, 100):
        root = [rng.randrange(1000) for _ in range(p)]
        for copies in (2, 3, 4, 11):
            seq = [5000] * 3 + root * copies + root[:p // 2] + [6000]
            assert found_runs(seq) == brute_runs(seq)
    assert found_runs([1] * 5000) == [(0, 5000, 1)]
    assert found_runs([1] * 23) == []


def test_range_successors():
    rng = np.random.default_rng(4)
    values = rng.permutation(200)
    tree = periodic_runs.WaveletTree(values)
    for _ in range(300):
        left, right = sorted(rng.integers(0, 201, 2))
        low, high = sorted(rng.integers(0, 260, 2))
        inside = sorted(v for v in values[left:right] if low <= v <= high)
        count, first, second, last = (int(x[0]) for x in tree.between(*(np.array([v]) for v in (left, right, low, high))))
        assert count == len(inside)
        if inside:
            assert (first, last) == (inside[0], inside[-1])
        if len(inside) > 1:
            assert second == inside[1]


def expected_row(doc_id, text):
    w = words(text)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(w), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = sorted(((s, e - s, q) for s, e, q in brute_runs(w)), key=lambda r: (r[0], r[2]))
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(x for i, x in enumerate(w) if i not in dropped)
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def digest(frame):
    found = periodic_runs.periodic_runs(periodic_runs.with_planted_repeats(frame))
    return periodic_runs.run_digests(found).drop("n_words")


def in_order(rows):
    return sorted(map(tuple, rows), key=str)


def short(frame):
    """The awkward rows, the long text cut so that brute force can follow."""
    from pyspark.sql import functions as F
    return frame.withColumn("text", F.when(F.length("text") > 20_000, F.substring("text", 1, 9_000)).otherwise(F.col("text")))


def test_digests_of_awkward_texts(spark, awkward):
    rows = short(awkward)
    expected = [expected_row(r.doc_id, r.text) for r in rows.collect()]
    assert in_order(digest(rows).collect()) == in_order(expected)
    assert any(r[1] for r in expected)


def test_planted_repeats(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(40)) for _ in range(rng.randrange(0, 300))) for _ in range(400)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    expected = [expected_row(i, t) for i, t in enumerate(texts)]
    assert in_order(digest(frame).collect()) == in_order(expected)
    assert sum(bool(r[1]) for r in expected) > 20


def test_empty_table_and_whole_long_text(spark, no_documents):
    assert digest(no_documents).count() == 0
    text = "start " + "one two three " * 60_000 + "end"
    frame = spark.createDataFrame([(1, text), (2, "x " * 70_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in periodic_runs.periodic_runs(frame).collect()}
    assert [tuple(r) for r in got[1].runs] == [(1, 180_000, 3)]
    assert got[1].collapsed == "start one two three end"
    assert (got[2].collapsed, got[2].n_words) == ("x", 70_000)


@pytest.mark.parametrize("name", ["doc_id", "text"])
def test_columns_with_clashing_names(spark, name):
    rows = spark.createDataFrame([(1, "a b c", "d", 2, "e")], "key long, body string, runs string, n_words int, " + name + " string")
    got = periodic_runs.periodic_runs(rows, id_col="key", text_col="body").collect()
    assert [tuple(got[0])] == [(1, 3, [], "a b c")]


def test_given_documents(spark):
    table = queries.table(spark, "/root/testdata/sf0.001", "documents")
    got = queries.op11_periodic_runs(spark, "/root/testdata/sf0.001").drop("n_words").collect()
    rows = [r for r in table.collect() if len(words(r.text)) < 1500]
    small = {r.doc_id for r in rows}
    assert in_order(r for r in got if r.doc_id in small) == in_order(expected_row(r.doc_id, r.text) for r in rows)
    assert len(got) == table.count()
