"""Documents that hold every awkward case, beside a sample of real ones."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from llm_cases import awkward_texts  # noqa: E402


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def awkward(spark):
    """Awkward texts, some rows twice, null ids, and columns with clashing names."""
    texts = awkward_texts()
    rows = [(i, t, None if i % 7 == 0 else "en", f"s{i % 3}" if i % 5 else None, len(t or ""), 1.5, 7)
            for i, t in enumerate(texts)]
    rows += [rows[10], rows[10], rows[4], (100, texts[10], "de", "s1", 0, 0.0, 1), (None, "no id here", "en", "s0", 10, 0.0, 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, "
                                       "perplexity double, copy int")


@pytest.fixture(scope="session")
def no_documents(awkward):
    return awkward.where("false")
