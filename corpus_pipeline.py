"""From raw documents to a training mix: language, near duplicates, contamination, personal data, mixture.

Each stage takes (spark, docs, sf_dir) and returns the columns of documents; its result is written as
Parquet and read again as the next stage's docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import decontam, langid, mixing, nearcopies, pii
from siltstone.llm.store import shared_dir

#: More bits a byte than this no text of a learned language takes.
MAX_BITS = 7.0


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter (null and empty ones too), and those that no learned language explains.

    The labels stay as they are, and so do null ids, repeated rows, and columns of any name; long texts are scored whole;
    where no row has a label nothing can be learnt, and no row stays."""
    return langid.keep_known(docs, langid.train(docs), MAX_BITS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, a similarity of 0.8.

    It is the one with the smallest id; null ids stay only where a group has no other; null, empty and blank texts are one
    group; of repeated rows one stays; long texts count whole; columns of any name pass through; no rows give no rows."""
    return nearcopies.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a ten-word window of a benchmark item.

    Null and empty texts are clean; repeated rows stay or go together; long texts are read whole; an empty benchmark drops
    nothing; ids do not matter, and columns of any name pass through."""
    return decontam.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts becomes keyed surrogates; n_chars follows where it is there.

    Every row stays, null and empty texts as they are, repeated rows with equal surrogates; long texts are read whole; ids
    do not matter, and other columns of any name pass through.  The key is the session's setting (see pii.key_of)."""
    out = pii.pseudonymise(docs, pii.key_of(spark))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws documents by probabilities raked to source, language and topic targets.

    Null sources and languages are values of their own; texts without words (null ones too) are drawn like their cell, not
    at all in a cell without any words; rows with one id, null ids among them, share their draw; long texts count whole;
    columns of any name pass through; no rows give no rows."""
    return mixing.sample_unweighted(docs)


STAGES = [
    ("language_id", keep_known_languages),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("pii", replace_personal_data),
    ("mixing", mix_sources),
]

#: Language ID and SimHash cannot be said in SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, in order, each one's result written and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
