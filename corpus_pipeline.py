"""The training-data pipeline: five stages over ``documents``, each over all that the one before it kept.

Every stage is written as Parquet to the shared folder and read again, so a lost executor costs at most
one stage.  All stages but the last keep the columns of their input.

Defined cases
* null and empty texts are documents like others: the quality stage judges them, of equal ones one stays
* null ids: the row goes through every stage; among equal texts and near copies, other ids stay before it
* ties and repeated rows: the smallest id stays, once
* very long texts are read whole by every stage and cut only into token pieces
* an empty table gives an empty result; extra columns are kept until packing, whatever their names
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fitweave.llm import crf, decontam, exact_dedup, packing, simhash
from fitweave.llm.common import documents, materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field does not reject."""
    return crf.keep_good(docs, documents(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of equal texts."""
    return exact_dedup.exact_dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near copies (five-word shingles, Jaccard 0.8 or more)."""
    return simhash.near_dedup(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs."""
    return decontam.decontaminate(docs, documents(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents with their place in a sequence."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("decontamination", benchmark_leaks),
    ("packing", pack),
]

# a trained model, XXH64 fingerprints and a tokenizer have no SQL form; tests hold each stage against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
