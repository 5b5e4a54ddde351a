"""Secret scans by assignment-aware lexing (operator 4).

Three fixed patterns give the base spans. The lexer (``assignments``) then reads
each text as source or configuration into name-literal pairs. Sensitivity goes
from the names back through constants, however long the chain and whichever is
written first, each assignment once, with the heaviest name that reaches it.
The literals of an assignment, joined, are scored by that name's weight, their
length, their character mix and entropy. Under a weak name (``key``,
``session``) only a long literal that looks random reaches ``threshold``; words
with spaces count as a passphrase under a strong name, or by a random-looking
word; arguments of a call count where they look random. Literals that reach
``threshold``, each part of a joined one, become spans of kind ``literal``, as do
passwords in addresses (``scheme://user:password@host``).

One ``mapInArrow`` without a shuffle; a text is lexed only where it has an
assignment sign. Spans count code points, ends exclusive.

Defined results: a null text is empty and has no span; an empty table gives an
empty result; equal texts give equal rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipelens.llm import blocks as B
from pipelens.llm.assignments import Constants, Part, assignments

# Base kinds in their order, with their patterns and least sizes.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "literal")

#: Weight of a name part, plurals too; a name scores as its heaviest part.
NAME_WEIGHT = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 1.0, "secret": 1.0, "apikey": 1.0,
    "privatekey": 1.0, "accesskey": 1.0, "credential": 0.9, "credentials": 0.9, "token": 0.9,
    "bearer": 0.9, "auth": 0.7, "authorization": 0.8, "signature": 0.6, "salt": 0.6, "cookie": 0.6,
    "session": 0.5, "key": 0.5, "pin": 0.5, "cert": 0.5,
}
THRESHOLD = 0.8
#: Bits (length times entropy) from which a literal's length makes up for a
#: lacking character class, and how many more do so wholly.
LONG_BITS, MORE_BITS = 24.0, 24.0
#: A random-looking literal: least length, bits, and share of places where
#: letters and digits, or lower and upper case, take turns. It closes this part
#: of what its score lacks to 1.
RANDOM_LENGTH, RANDOM_BITS, RANDOM_TURNS, RANDOM_PART = 12, 40.0, 0.2, 0.7
#: A passphrase has so many different words of so many characters, none of them
#: common in sentences, and a name of at least this weight.
PHRASE_WORDS, PHRASE_LETTERS, PHRASE_WEIGHT = 4, 3, 0.9
_SENTENCE = frozenset("the and for with your you our are was this that has not from please enter must can will".split())
URL_PASSWORD = re.compile(r"""://[^\s:/@"'<>]*+:(?P<password>[^\s/@"'<>]++)@""")
_SIGN = re.compile(r"[:=>]")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_FILE = re.compile(r"[^/]*(?:/[^/]*)+\.[A-Za-z][A-Za-z0-9]{1,4}\Z")
_ATTRIBUTE = re.compile(r"[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+\Z")
_PLACEHOLDER = re.compile(r"(?i)\A(?:x+|\*+|\.+|none|null|true|false|todo|changeme|example|\[SECRET\]|\$\{.*|<.*|%.*%)\Z")

SCHEMA = ("doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, "
          "spans string, n_literal long, top_score double")


class Span(NamedTuple):
    start: int
    kind: int
    end: int
    score: float


def base_spans(text: str) -> list[Span]:
    """The three base kinds, leftmost and not overlapping within a kind."""
    found = [Span(m.start(), 0, m.end(), 1.0) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [Span(m.start(), 1, m.end(), 1.0) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [Span(m.start(), 2, m.end(), 1.0) for m in HEX.finditer(text)]
    return sorted(found)


def name_weight(name: str) -> float:
    parts = [p.lower() for p in _PARTS.findall(name)]
    pairs = [a + b for a, b in zip(parts, parts[1:], strict=False)]
    return max((NAME_WEIGHT.get(p, 0.0) or NAME_WEIGHT.get(p.removesuffix("s"), 0.0) for p in parts + pairs), default=0.0)


def _entropy(value: str) -> float:
    return -sum(c / len(value) * math.log2(c / len(value)) for c in Counter(value).values())


def looks_random(value: str) -> bool:
    """Whether a long literal mixes letters and digits as generated keys do,
    unlike identifiers, file paths and dates; a path does where a part does."""
    if "/" in value and _FILE.match(value):
        return any(looks_random(p) for p in re.split(r"[/.]", value))
    if len(value) < RANDOM_LENGTH or not any(c.isdigit() for c in value) or not any(c.isalpha() for c in value):
        return False
    turns = sum(a.isalnum() and b.isalnum() and (a.isdigit() != b.isdigit() or a.islower() and b.isupper())
                for a, b in zip(value, value[1:], strict=False))
    return turns >= RANDOM_TURNS * (len(value) - 1) and len(value) * _entropy(value) >= RANDOM_BITS


def _is_passphrase(words: list[str]) -> bool:
    return (len(words) >= PHRASE_WORDS and len({w.lower() for w in words}) == len(words)
            and all(len(w) >= PHRASE_LETTERS and w.lower() not in _SENTENCE for w in words))


def literal_score(value: str, weight: float) -> float:
    """Name weight, times how far the literal looks like a credential, raised
    where it looks random."""
    if len(value) < 8 or _PLACEHOLDER.match(value):
        return 0.0
    entropy = _entropy(value)
    if " " in value:
        words = value.split()
        phrase = weight * min(1.0, entropy / 3.0) if weight >= PHRASE_WEIGHT and _is_passphrase(words) else 0.0
        return max([phrase, *(literal_score(w, weight) for w in words if looks_random(w))])
    classes = sum((any(c.islower() for c in value), any(c.isupper() for c in value),
                   any(c.isdigit() for c in value), any(not c.isalnum() for c in value)))
    long = min(1.0, max(0.0, (len(value) * entropy - LONG_BITS) / MORE_BITS))
    score = weight * min(1.0, entropy / 3.0) * min(1.0, 0.5 + 0.25 * (classes + long))
    return score + (1.0 - score) * RANDOM_PART if looks_random(value) else score


def literal_spans(text: str, threshold: float = THRESHOLD) -> list[Span]:
    """Literals whose target names, followed through constants, are sensitive."""
    if not _SIGN.search(text):
        return []
    spans: dict[tuple[int, int], float] = {}

    def keep(parts: list[Part], weight: float) -> None:
        score = literal_score("".join(p.value for p in parts), weight)
        if score >= threshold:
            for p in parts:
                if p.end > p.start:
                    spans[p.start, p.end] = max(score, spans.get((p.start, p.end), 0.0))

    found = assignments(text)
    constants = Constants(found)
    weights = [max(map(name_weight, a.names)) for a in found]
    reached: set[int] = set()
    for first in sorted((i for i, w in enumerate(weights) if w), key=lambda i: -weights[i]):
        weight, ways = weights[first], [first]
        while ways:
            if (i := ways.pop()) in reached:
                continue
            reached.add(i)
            own = []
            for part in found[i].parts:
                k = constants.of(part.ref, i)
                if k is not None:
                    ways.append(k)
                    if len(found[k].parts) == 1 and constants.of(found[k].parts[0].ref, k) is None:
                        own.append(found[k].parts[0])  # a constant inside a joined value
                elif part.quoted or len(found[i].parts) == 1 and part.ref != found[i].names[0] and (
                        looks_random(part.value) or not _ATTRIBUTE.match(part.value)):
                    own.append(part)
            if not found[i].argument or any(looks_random(p.value) for p in own):
                keep(own, weight)
    for m in URL_PASSWORD.finditer(text):
        keep([Part(*m.span("password"), m["password"], None, True)], 1.0)
    return sorted(Span(start, KINDS.index("literal"), end, score) for (start, end), score in spans.items())


def scan_text(text: str, threshold: float = THRESHOLD) -> list[Span]:
    return sorted(base_spans(text) + literal_spans(text, threshold))


def write(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[s.kind]}:{s.start}:{s.end}" for s in spans)


def redact(text: str, spans: list[Span], mark: str = "[SECRET]") -> str:
    """The text with every run of overlapping spans replaced by ``mark``."""
    out, at, until = [], 0, -1
    for s in sorted(spans):
        if s.start >= until:
            out += [text[at:s.start] if at <= s.start else "", mark]
        until = max(until, s.end)
        at = until
    return "".join([*out, text[at:]])


def secret_scan(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """One row per document: counts, digest of the base spans, all spans."""
    B.small_batches(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                base = base_spans(text := text.as_py() or "")
                more = literal_spans(text, threshold)
                kinds = Counter(s.kind for s in base)
                rows.append((kinds[0], kinds[1], kinds[2],
                             hashlib.sha256(write(base).encode()).hexdigest(),
                             write(sorted(base + more)), len(more),
                             max((s.score for s in base + more), default=0.0)))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_literal", "top_score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")
                       .alias("text")).mapInArrow(scan, SCHEMA)


def redact_documents(docs: DataFrame, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The same rows and columns, with secrets in the text replaced; a null
    text stays null."""
    B.small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else redact(t, scan_text(t, threshold)) for t in batch.column(at).to_pylist()]
            columns = batch.columns
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(clean, docs.schema)
