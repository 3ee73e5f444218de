"""A corpus cleaned and packed: quality, near duplicates, repeated passages, sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from provenlake.llm import jaccard_join, packing, quality, suffix_dedup
from provenlake.llm.common import documents, stash, vocabulary


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling keeps; the rejected ones go."""
    return quality.filter_documents(docs, documents(spark, sf_dir, "labels"))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more."""
    return jaccard_join.one_of_each(docs, words=5, per=80)


def fresh_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 100 bytes or more that occur earlier."""
    return suffix_dedup.remove_repeats(docs, length=100)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's tokens in sequences of at most 2,048."""
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), capacity=2048, end_id=0)


STAGES = [
    ("quality", good_documents),
    ("near_duplicates", distinct_documents),
    ("repeats", fresh_text),
    ("packing", sequences),
]

#: SQL expresses none of the classifier, the byte-exact repeats and the tokenizer: see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name)
    return docs
