"""Operator 13 against a plain token-by-token version."""

import bisect
import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from pipelens.llm import byte_bpe, queries, token_alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
EXTRA = ["<|endoftext|> in a text", "x<|endoftext|><s></s><unk><0x41>", "▁ stands here", "two  spaces\tand\ttabs \n\n lines ", " lead",
         "😀😀 日本語テキスト über naïve", "\x00\x01", "ﬁne ﬂat", "é e", " " * 3000 + "x", "　wide", "a" * 5000, "1234567 89,01.5"]


@pytest.fixture(scope="module")
def plain():
    """id, text -> ids of both sides with the ends of their tokens, or nothing."""
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(c): c for c in visible}
    byte_of |= {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in visible)}

    def of_b(i):
        return bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    def tokens(text):
        if not text:
            return [], []
        sides = [[(i, bytes(byte_of[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids],
                 [(i, of_b(i)) for i in b.encode(text)]]
        whole = (" " + text).encode()
        return sides if all(b"".join(t for _, t in s) == whole for s in sides) else ([], [])
    return tokens


def plain_rows(rows, tokens):
    aligned = []
    for doc_id, text in rows:
        a, b = tokens(text)
        ends = []
        for side in (a, b):
            at, out = 0, []
            for i, t in side:
                at += len(t)
                out.append((at, i))
            ends.append(out)
        at = dict_of(ends[1])
        links = [(x, y) for e, x in ends[0] for y in at.get(e, [])]
        common = sorted({e for e, _ in ends[0]} & {e for e, _ in ends[1]})
        members = [([], []) for _ in common]
        for k, side in enumerate(ends):
            for e, i in side:
                members[bisect.bisect_left(common, e)][k].append(str(i))
        groups = ["|".join(map(",".join, m)) for m in members]
        aligned.append((doc_id, len(a), len(b), links, ";".join(groups), len(groups)))
    total = Counter(link for row in aligned for link in row[3])
    best = Counter()
    for (_, y), n in total.items():
        best[y] = max(best[y], n)
    return [(d, n_a, n_b, n, len(links), sum(total[k] == best[k[1]] for k in links), sum(total[k] for k in links),
             hashlib.sha256(groups.encode()).hexdigest() if groups else "", groups or "") for d, n_a, n_b, links, groups, n in aligned]


def dict_of(ends):
    out = {}
    for e, i in ends:
        out.setdefault(e, []).append(i)
    return out


def in_order(rows):
    return sorted(map(tuple, rows), key=str)


def test_equal_to_plain_version(spark, awkward, plain):
    base = [(r.doc_id, (r.text or "")[:3000] if r.text is not None else None) for r in awkward.collect()]
    rows = base + [(200 + i, t) for i, t in enumerate(EXTRA)] + [(200, EXTRA[0]), (None, EXTRA[3])]
    frame = spark.createDataFrame([(*r, "g", 3) for r in rows], "doc_id long, text string, groups string, row int").repartition(5)
    documents, pairs = token_alignment.align(frame, A, B, with_groups=True)
    expected = plain_rows(rows, plain)
    assert in_order(documents.collect()) == in_order(expected)
    assert any(r[1] == 0 and t for r, (_, t) in zip(expected, rows, strict=True))
    assert sum(r.total for r in pairs.collect()) == sum(r[4] for r in expected)
    assert documents.count() == len(rows)


def test_given_documents(spark, plain):
    got = queries.op13_token_alignment(spark, "/root/testdata/sf0.001")
    rows = [(r.doc_id, r.text) for r in queries.table(spark, "/root/testdata/sf0.001", "documents").collect()]
    assert in_order(got.collect()) == in_order(r[:-1] for r in plain_rows(rows, plain))


def test_linked_pairs_end_alike(spark, documents):
    """The proof of the table's bound: one token's bytes end with the other's."""
    voc = token_alignment.vocabularies(A, B)
    _, pairs = token_alignment.align(documents, A, B)
    a, b = voc.bytes_a.to_pylist(), voc.bytes_b.to_pylist()
    rows = pairs.collect()
    assert rows
    assert all(a[r.a].endswith(b[r.b]) or b[r.b].endswith(a[r.a]) for r in rows)


def test_empty_table(spark, no_documents):
    documents, pairs = token_alignment.align(no_documents, A, B)
    assert (documents.count(), pairs.count()) == (0, 0)


@pytest.mark.parametrize("added", [True, False])
def test_ids_of_texts_the_fast_library_refuses(added):
    exact = Tokenizer.from_file(A)
    exact.encode_special_tokens = not added
    encoder = byte_bpe.byte_bpe(A, added)
    for text in [" " * 1_000_000, "\n" * 1_000_000, "a" * 1_000_000, "x" + " " * 400_000 + "<|endoftext|>", "", *EXTRA]:
        assert list(encoder.encode(text)) == exact.encode(text, add_special_tokens=False).ids
