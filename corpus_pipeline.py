"""The training-corpus pipeline: five operators of ``tablelens.llm`` in a row.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet
and read again as the next stage's ``docs``. All but the last return the columns of
``documents``; each works on everything its predecessor kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tablelens.llm.common import query, stable, table
from tablelens.llm.decontaminate import remove_benchmark
from tablelens.llm.quality import fit_lines, keep_good
from tablelens.llm.sentencepiece_sampling import sample_segmentations
from tablelens.llm.simhash import keep_one
from tablelens.llm.toxicity import fit_toxicity, remove_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the class-conditional models score below 0.5."""
    return remove_toxic(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and whose lines are content for the most part."""
    return keep_good(docs, fit_lines(docs, table(spark, sf_dir, "labels")))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of fingerprints within 4 bits (4-word shingles)."""
    return keep_one(docs, shingle=4, max_bits=4)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an occurrence of ten consecutive words of a benchmark item."""
    return remove_benchmark(docs, table(spark, sf_dir, "benchmark"), width=10)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two distinct sampled segmentations of every document."""
    return sample_segmentations(docs, public_tokenizers.path("piece_bpe_32k.model"), k=2)


STAGES = [("toxicity", toxicity), ("quality rules", quality_rules), ("SimHash near-dedup", simhash_near_dedup),
          ("benchmark decontamination", benchmark_decontamination),
          ("SentencePiece encoding and decoding", sentencepiece)]

#: Learned models, 64-bit hashes and sampling have no SQL; tests/llm holds each stage against brute force.
ORACLE_SQL = None


@query("pipeline")
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stable(docs)
    return docs
