"""The document pipeline: from raw documents to token ids.

Each stage takes ``(spark, docs, sf_dir)``, works on every row the stage before
kept, and returns a DataFrame; all but the last return the columns of
``documents``. Rows without a ``doc_id`` pass through every stage; null texts
have no language and go in the first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from trialspark.llm.decontaminate import without_leaks
from trialspark.llm.language import keep_identified
from trialspark.llm.minhash import near_duplicates
from trialspark.llm.pieces import encode_documents
from trialspark.llm.queries import let_workers_import
from trialspark.llm.suffix import without_repeats
from trialspark.session import cut_lineage

#: Least share of common rank order where the labelled rows are too few to learn it.
LEAST_SCORE = 0.1


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; texts in others, letter junk and texts without a letter go."""
    return keep_identified(docs, LEAST_SCORE)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8.

    Of rows with the same ``doc_id`` and text one stays.
    """
    gone = near_duplicates(docs).filter("NOT kept").select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti").dropDuplicates(["doc_id", "text"]).select(*docs.columns)


def without_repeated_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 200 bytes that start anywhere else; ``n_chars`` follows."""
    return without_repeats(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each text, and whether decoding them gives it back."""
    return encode_documents(docs)


STAGES = [
    ("language_id", identified),
    ("minhash_near_dedup", without_near_copies),
    ("suffix_array_dedup", without_repeated_bytes),
    ("decontamination", without_benchmark),
    ("sentencepiece", encoded),
]

#: Profiles, trees and pieces are beyond SQL; tests/llm compares the pipeline with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result stored before the next."""
    let_workers_import(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
