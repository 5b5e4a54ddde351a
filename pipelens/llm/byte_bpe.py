"""Byte-level BPE ids of a ``tokenizers`` JSON file.

``tiktoken`` gives the same ids several times faster, as the ids of the file are
in merge order and so serve as ranks. Its pattern engine gives up on some texts
(very long runs of white space); those are encoded by ``tokenizers`` itself.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import tiktoken
from tokenizers import Tokenizer

# Fixed value: the published splitting pattern of byte-level BPE vocabularies.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class ByteBpe:
    """``added``: strings of added tokens in a text become their ids; else they
    are plain text."""

    def __init__(self, path: str, added: bool) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        listed = model["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in listed):
            raise ValueError("added tokens must match as they stand")
        self.special = {t["content"]: t["id"] for t in listed}
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in plain}
        byte_of |= {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
        self.ranks = {bytes(byte_of[c] for c in token): rank
                      for token, rank in model["model"]["vocab"].items() if token not in self.special}
        self.path, self.allowed = path, set(self.special) if added else set()
        self.fast = tiktoken.Encoding("documents", pat_str=SPLIT, mergeable_ranks=self.ranks, special_tokens=self.special)
        self.exact: Tokenizer | None = None

    def encode(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, allowed_special=self.allowed, disallowed_special=())
        except ValueError:
            return np.array(self._exact().encode(text, add_special_tokens=False).ids, np.uint32)

    def _exact(self) -> Tokenizer:
        if self.exact is None:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            self.exact = Tokenizer.from_file(self.path)
            self.exact.encode_special_tokens = not self.allowed
        return self.exact

    def token_bytes(self) -> list[bytes]:
        """Bytes of every id; those of an added token are its string's."""
        own = {i: token for token, i in self.ranks.items()} | {i: s.encode() for s, i in self.special.items()}
        return [own.get(i, b"") for i in range(max(own) + 1)]


@lru_cache(maxsize=4)
def byte_bpe(path: str, added: bool = True) -> ByteBpe:
    """The encoder of a file, made once in each worker."""
    return ByteBpe(path, added)
