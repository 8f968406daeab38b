"""The corpus pipeline: STAGES in order, each written as Parquet and read again by the next.

A stage takes (spark, docs, sf_dir), works on all that its predecessor kept and, but for the last, returns the columns
of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrylight.llm.common import Scratch, documents
from quarrylight.llm.exact_dedup import drop_copies
from quarrylight.llm.near_copies import keep_one_similar
from quarrylight.llm.packing import pack
from quarrylight.llm.quality import keep_good
from quarrylight.llm.suffix_dedup import remove_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of low quality go."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a component of texts linked by a Jaccard similarity of 0.8 over 5-word shingles the one with the least doc_id stays.

    Operator 9's anchors give the closest links; bands of MinHash values give those that fingerprints of 64 bits miss.
    """
    return keep_one_similar(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 400 bytes and more, and passages of over 50 words, that occur twice go from the texts."""
    return remove_repeats(docs, words=51)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 2048: one row a piece."""
    return pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact_dedup),
    ("simhash near-dedup", near_dedup),
    ("suffix-array dedup", repeats),
    ("packing", packing),
]
#: A trained classifier, components and tokens are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; the rows of the last."""
    scratch = Scratch(spark, "pipeline")
    docs, last = documents(spark, sf_dir), None
    for k, (_, stage) in enumerate(STAGES):
        with Scratch.until_used():
            docs = scratch.table(stage(spark, docs, sf_dir), f"stage-{k}")
        if last:
            scratch.drop(last)
        last = f"stage-{k}"
    return docs
