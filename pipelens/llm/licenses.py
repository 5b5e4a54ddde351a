"""License scans by diagonal voting (operator 1), DataFrame functions only.

Every word bigram of every text is hashed and joined to the positions of the
same bigram in short license templates. A hit votes for the diagonal ``text
position - template position``: hits of one copy of a template share it. Votes
are summed per (document, template, diagonal); neighbouring diagonals, which a
few inserted or dropped words produce, are merged into one span; a span counts
when its votes cover enough of the template and it is not longer than the
template allows.

The template table is a constant of this module (about 200 rows), so the join
is a broadcast hash join inside the scan and only hits are shuffled, once, by
document. A row per document, voting for a template of its own, carries the
word count through the same shuffle, so texts are read once.

Defined results: a null text is empty; an empty text has no words and score 0;
rows equal in id and text are one document and give one row; other columns are
ignored; an empty table gives an empty result; places of ties are all counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Base phrases with their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Opening words of well-known public license notices, lower case.
TEMPLATES = {
    "apache-2.0": ["licensed under the apache license version 2 0"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted"],
    "cc-by-nc": ["licensed under cc by nc 4 0", "creative commons attribution noncommercial"],
    "cc-by-sa": ["licensed under cc by sa 4 0", "creative commons attribution sharealike"],
    "cc0": ["cc0 1 0 universal public domain dedication"],
    "gpl-3.0": ["licensed under the gnu general public license version 3",
                "free software you can redistribute it and or modify it under the terms of the gnu general public license"],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee"],
    "lgpl": ["gnu lesser general public license"],
    "mit": ["released under the mit license",
            "permission is hereby granted free of charge to any person obtaining a copy of this software"],
    "mpl-2.0": ["this source code form is subject to the terms of the mozilla public license"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
}
# Fixed value: a word is a run of ASCII letters and digits and of anything beyond ASCII.
WORD = r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Diagonals this close belong to one copy; least share of a template's bigrams
#: voted for; longest span as a multiple of the template.
NEIGHBOURS, COVERAGE, STRETCH = 3, 0.75, 1.5


def template_rows(templates: dict[str, list[str]]) -> list[tuple[int, str, bool, int, int, str]]:
    """(template, label, base, bigrams, position, bigram)"""
    listed = [(label, phrase, True) for phrase, label in BASE_PHRASES.items()]
    listed += [(label, text, False) for label, texts in templates.items() for text in texts]
    rows = []
    for k, (label, text, base) in enumerate(listed):
        words = text.split()
        grams = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
        rows += [(k, label, base, len(grams), i, g) for i, g in enumerate(grams)]
    return rows


def license_scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per document: word and base counts, labels, the best coverage."""
    spark = docs.sparkSession
    rows = template_rows(TEMPLATES if templates is None else templates)
    table = spark.createDataFrame(
        [*rows, (-1, "", False, 0, 0, "")],
        "template int, label string, base boolean, grams int, at int, gram string"
    ).withColumn("key", F.xxhash64("gram")).drop("gram")

    def prepared(ws):
        """Word count and bigram hashes; the last entry votes for the template
        of the document itself. ``ws`` is bound once, not expanded per use."""
        grams = F.transform(F.slice(ws, 1, F.greatest(F.size(ws) - 1, F.lit(0))),
                            lambda w, i: F.xxhash64(F.concat_ws(" ", w, F.get(ws, i + 1))))
        return F.struct(F.size(ws).cast("long").alias("n_words"),
                        F.concat(grams, F.array(F.xxhash64(F.lit("")))).alias("_keys"))

    words = F.regexp_extract_all(F.translate("_text", UPPER, LOWER), F.lit(WORD))
    votes = (docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
             .select("doc_id", F.xxhash64("_text").alias("_of"),
                     F.inline(F.transform(F.array(words), prepared)))
             .select("doc_id", "_of", "n_words", F.posexplode("_keys").alias("pos", "key"))
             .join(F.broadcast(table), "key")
             .select("doc_id", "_of", "n_words", "template", "label", "base", "grams", "at",
                     F.col("pos").cast("long").alias("pos"), (F.col("pos") - F.col("at")).cast("long").alias("diagonal"))
             .repartition("doc_id", "_of"))
    document, diagonal = ["doc_id", "_of"], ["doc_id", "_of", "template", "diagonal"]
    lines = votes.groupBy(*diagonal).agg(
        F.first("n_words").alias("n_words"), F.first("label").alias("label"), F.first("base").alias("base"),
        F.first("grams").alias("grams"), F.collect_set("at").alias("voted"),
        F.min("pos").alias("begin"), F.max("pos").alias("last"))
    by_diagonal = Window.partitionBy(*document, "template").orderBy("diagonal")
    apart = (F.col("diagonal") - F.lag("diagonal").over(by_diagonal) > NEIGHBOURS)
    spans = (lines.withColumn("_apart", F.coalesce(apart, F.lit(True)).cast("int"))
             .withColumn("_span", F.sum("_apart").over(by_diagonal))
             .groupBy(*document, "template", "_span")
             .agg(F.first("n_words").alias("n_words"), F.first("label").alias("label"),
                  F.first("base").alias("base"), F.first("grams").alias("grams"),
                  F.size(F.array_distinct(F.flatten(F.collect_list("voted")))).alias("votes"),
                  F.min("begin").alias("begin"), F.max("last").alias("last"),
                  F.sum((F.size("voted") == F.col("grams")).cast("long")).alias("places"),
                  F.min(F.when(F.size("voted") == F.col("grams"), F.col("diagonal"))).alias("first_place"),
                  F.max(F.when(F.size("voted") == F.col("grams"), F.col("diagonal"))).alias("last_place"))
             .withColumn("coverage", F.col("votes") / F.greatest(F.col("grams"), F.lit(1))))
    base = F.col("base") & (F.col("places") > 0)
    found = (~F.col("base") & (F.col("grams") > 0) & (F.col("coverage") >= COVERAGE)
             & (F.col("last") - F.col("begin") + 1 <= STRETCH * F.col("grams")))

    def labels(which):
        return F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("label")))), ",")

    return spans.groupBy(*document).agg(
        F.max(F.when(F.col("template") == -1, F.col("n_words"))).alias("n_words"),
        F.coalesce(F.sum(F.when(base, F.col("places"))), F.lit(0)).cast("long").alias("n_base"),
        F.min(F.when(base, F.col("first_place"))).alias("first_word"),
        F.max(F.when(base, F.col("last_place"))).alias("last_word"),
        labels(base).alias("base_labels"), labels(base | found).alias("labels"),
        F.coalesce(F.max(F.when(base, F.lit(1.0)).when(found, F.col("coverage"))), F.lit(0.0)).alias("score"),
        F.sum((base | found).cast("long")).alias("n_spans"),
    ).drop("_of")
