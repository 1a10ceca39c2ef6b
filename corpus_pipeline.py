"""A training-data pipeline over ``documents``: five stages, each a table the next one reads.

Toxic documents go, one document of every group of near-duplicates stays, byte strings that an earlier
document has go, and benchmark passages go; what is left is encoded. Each stage works on all that the one
before has kept. All stages but the last return the columns of ``documents``; the last one has an id, the
piece ids and two checks per document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tripleweave.llm import decontaminate, near_copies, pieces, suffix_dedup, toxicity
from tripleweave.llm.queries import MODEL
from tripleweave.session import scratch_path, tune

#: Training, components and the whole-corpus search for repeats have no SQL; tests use brute force.
ORACLE_SQL = None


def keep_harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the toxicity model rejects; it learns from ``labels``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity.reject(docs, labels)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, by SimHash or exact similarity of five-word shingles, the smallest id stays."""
    return near_copies.deduplicate(docs)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut byte strings that a document with a smaller id has."""
    return suffix_dedup.clean(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut benchmark passages; documents that are mostly such passages go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document left."""
    return pieces.encode(docs, MODEL)


STAGES = [
    ("toxicity", keep_harmless),
    ("simhash", keep_one_of_near_duplicates),
    ("suffix_dedup", remove_repeats),
    ("decontamination", remove_benchmark),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tune(spark)
    for _, stage in STAGES:
        path = scratch_path(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
