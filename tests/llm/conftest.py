from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, ties, and extra columns with names that the operators use."""
    rng = random.Random(3)
    base = words(rng, 300)
    changed = base.split()
    changed[100] = "other"
    texts = [base, base, " ".join(changed), base + " tail", words(rng, 250), words(rng, 20_000, 5000), "", None, "  \n ", "one", "ONE", "two words", "Ünï çödé wörds hier und dort im Text, 文字 テキスト", None]
    rows = [(i, t, ["en", "de", None][i % 3], ["s0", None, "s1"][i % 3], len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, "no id here at all but words", "en", "s0", 5), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    clash = ("fp", "node", "score", "spans", "bucket", "__text", "topic", "n_words", "kept", "blob", "version", "sig", "key", "th", "nid", "__row", "root", "component_id", "start", "unit")
    return df.withColumns({c: F.lit(1) for c in clash})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")
