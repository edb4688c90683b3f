"""Corpus pipeline: five stages over documents, each on what its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as
Parquet below the shared checkpoint folder and reads it again as the next one's docs.
Null, empty and very long texts, repeated rows and empty tables behave as the
operators' docstrings define; extra columns of documents pass through.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from netvigil.llm import decontaminate, line_dedup, packing, simhash, toxicity
from netvigil.session import checkpoint_path
from netvigil.sources.tables import read_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity lexicon rejects go."""
    return toxicity.keep_clean(docs, read_table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One line of each component of near-equal lines stays; every document stays."""
    return line_dedup.dedup_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-copies stays."""
    return simhash.near_dedup(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.keep_clean(docs, read_table(spark, sf_dir, "benchmark").select("item_id", "text"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 4096 ids."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("best_fit_packing", pack),
]

#: Learned scores, MinHash and a tokenizer are beyond SQL; tests/llm checks the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents."""
    base = checkpoint_path(spark, f"pipeline-{uuid.uuid4().hex}")
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
