"""The registered queries: each operator over its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from trialspark.llm.collocations import collocations
from trialspark.llm.decontaminate import leaks
from trialspark.llm.doubling import doubling_dedup
from trialspark.llm.filter_audit import filter_interactions
from trialspark.llm.fingerprints import fingerprints
from trialspark.llm.language import identify
from trialspark.llm.minhash import near_duplicates
from trialspark.llm.pieces import encode_documents
from trialspark.llm.rules import quality
from trialspark.llm.shards import shard_documents
from trialspark.llm.suffix import suffix_dedup
from trialspark.llm.token_counts import section_tokens
from trialspark.llm.urls import url_verdicts


def let_workers_import(spark: SparkSession) -> None:
    """Let the Python workers of this session import the package from the folder it was imported from.

    Needed where a program finds the package by ``sys.path`` alone; a cluster
    gets it with ``--py-files`` or installs it.
    """
    root, known = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [p for p in known.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        known["PYTHONPATH"] = os.pathsep.join([root, *paths])


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    let_workers_import(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_streaming_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every text, and whether decoding them gives the text back."""
    return encode_documents(_documents(spark, sf_dir).select("doc_id", "text"))


def op2_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components on 3-word shingles at a similarity of 0.85."""
    return near_duplicates(_documents(spark, sf_dir).select("doc_id", "text"), words=3, percent=85)


def op3_isolation_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule counts of every text, and the verdict of the base rules and the forest."""
    return quality(_documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))


def op4_rank_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text, learned from the documents that are not held out."""
    return identify(_documents(spark, sf_dir).select("doc_id", "text", "lang"))


def op5_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes covered by a 200-byte string that also starts elsewhere, removed."""
    return suffix_dedup(_documents(spark, sf_dir).select("doc_id", "text"))


def op6_offset_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text and of each of its lines."""
    return section_tokens(_documents(spark, sf_dir).select("doc_id", "text"))


def op7_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words covered by a 50-word window that also starts in a smaller document, removed."""
    return doubling_dedup(_documents(spark, sf_dir).select("doc_id", "text"))


def op8_redirect_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url, by rule or by its aliases."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return url_verdicts(pages).select("page_id", "host", "path", "rule", "verdict")


def op9_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes."""
    return shard_documents(_documents(spark, sf_dir).select("doc_id", "text"))


def op10_block_max_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that each text holds."""
    return leaks(_documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op11_existential_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from every language in each of their 120 orders."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    return filter_interactions(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"), labels)


def op12_double_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 collocations of every language."""
    return collocations(_documents(spark, sf_dir).select("text", "lang"))


def op13_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness."""
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_streaming_viterbi": op1_streaming_viterbi,
    "op2_chosen_path": op2_chosen_path,
    "op3_isolation_forest": op3_isolation_forest,
    "op4_rank_order": op4_rank_order,
    "op5_suffix_arrays": op5_suffix_arrays,
    "op6_offset_attribution": op6_offset_attribution,
    "op7_doubling": op7_doubling,
    "op8_redirect_equivalence": op8_redirect_equivalence,
    "op9_sampled_splitters": op9_sampled_splitters,
    "op10_block_max_wand": op10_block_max_wand,
    "op11_existential_join": op11_existential_join,
    "op12_double_array": op12_double_array,
    "op13_scaled_sketch": op13_scaled_sketch,
}
