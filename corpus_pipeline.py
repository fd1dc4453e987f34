"""Corpus pipeline: documents to sharded training data.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run``
applies them in order to the documents table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clickgap.llm import hilbert, ordinal, poisson, sketch, winnow
from clickgap.llm.common import stage, table
from clickgap.llm.queries import quality_model


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the top grade is below one half go."""
    return ordinal.select(docs, quality_model(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: groups linked by 80 %
    of equal five-word shingles."""
    return sketch.representatives(docs, size=5)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go."""
    return winnow.clean(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources repeated to their target shares, rows in shuffled order."""
    return poisson.mix(docs).select(*docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of the Hilbert curve over lang, source and n_chars: the
    documents with size, text_crc32, shard, slot and curve."""
    return hilbert.document_shards(docs)


STAGES = [
    ("quality classifier", quality),
    ("near-duplicate removal", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("source mixture", mixture),
    ("sharding", sharding),
]

#: a fitted classifier and sketches have no SQL form; tests use brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written to the
    shared folder and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
