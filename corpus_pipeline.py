"""The corpus pipeline: quality selection, near-dedup, repeated passages, source mix, packing.

Each stage works on all that the one before kept and returns the columns of documents; the last
returns the packed pieces. Nulls: a null text passes the classifier's score of an empty text, has no
shingles, loses no bytes, has size 0 in the mix and is packed as a lone separator if it is taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import minhash, mixing, packing, quality, suffix_dedup
from tessella.llm.core import materialize
from tessella.llm.queries import table, tokenizer_path


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps, fitted on the labels of the corpus."""
    return quality.select_documents(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return minhash.drop_near_duplicates(docs)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 100 bytes or more that stand earlier in the corpus."""
    return suffix_dedup.remove_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents, each as often as the mix takes it."""
    return mixing.mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their sequence and place."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality classifier", select_quality),
    ("MinHash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", remove_repeated_passages),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: The classifier and the suffix arrays are beyond SQL; tests/llm holds the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of documents after all stages; each stage is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
