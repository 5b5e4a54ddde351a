"""Texts with awkward cases, and plain helpers for the tests of this folder."""

import random
import re

SPACE = r"[^\x20\x09-\x0D]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(SPACE, text or "")


def awkward_texts():
    rng = random.Random(5)
    vocabulary = ["alpha", "beta", "Gamma", "delta", "über", "ñu", "x", "l'eau", "ß", "日本"]
    long = " ".join(rng.choice(vocabulary) + str(rng.randrange(400)) for _ in range(30_000))
    passage = " ".join(f"shared{i}" for i in range(60))
    return [
        None, "", " ", "\n\t ", "one", "one two", "One  two", "a b c d", "a b c d e", "A b\u000bc\u000cd e",
        long, long[:1000] + "!" + long[1000:], passage, "start " + passage, passage + "\nend of it all, really",
        "same words again " * 40, "z" * 1500, "ab" * 700, "é" * 300, "a b c d",
        "line\nline\nline\nother\n\n\nline", "Licensed under CC BY-NC 4.0.\nAll rights reserved.",
        "under the General-Public license and CC by cc BY", "reserved", "İ K KELVIN",
    ]
