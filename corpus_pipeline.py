"""Documents to packed training sequences, in five stages.

A stage is a function of (session, documents, data folder) that returns a
DataFrame; ``run`` writes each result as Parquet in the shared folder and reads
it again for the next. All but the last return the columns of ``documents``:
what a stage does not use is set aside, whatever its names, and comes back as it
was.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipelens.llm import jaccard_join, mixing, packing, quality, secrets
from pipelens.llm.columns import set_aside
from pipelens.session import scratch_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the byte model of trusted text finds too unlikely."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    used, back = set_aside(docs, ["doc_id", "lang", "text"])
    return back(quality.classify(used, labels).where("kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest id of each group of similar documents."""
    used, back = set_aside(docs, ["doc_id", "text"])
    return back(jaccard_join.one_of_each(used))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the text; ``n_chars`` follows."""
    size = F.coalesce(F.length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return secrets.redact_documents(docs).withColumn("n_chars", size).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or drop documents to reach the sources' target shares."""
    used, back = set_aside(docs, ["doc_id", "source", "text"])
    return back(mixing.poisson_mix(used))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_sequences),
]

#: SQL cannot express the stages; tests hold ``run`` against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = scratch_path(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{k}")
        docs = spark.read.parquet(f"{root}/{k}")
    return docs
