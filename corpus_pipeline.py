"""Corpus pipeline: quality rules, near duplicates, personal data, mixing, SentencePiece; each stage on what the last kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from webstrata.llm import jaccard, mix, pieces, pii, quality
from webstrata.session import stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every rule of the threshold table."""
    return quality.keep_clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at Jaccard similarity 0.8 over 5-word shingles: the smallest doc_id."""
    return jaccard.one_of_each(docs, size=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the words that disclose it replaced in every text."""
    return pii.sanitised(docs)


def target_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, repeated as often as it takes them."""
    return mix.repeat_taken(docs)


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces, n-best scores and digests of every document of the mix."""
    return pieces.segmented(docs)


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("target_mix", target_mix), ("piece_encoding", piece_encoding)]

#: Disclosure spans, hashes of shuffled rows and piece lattices are beyond SQL; tests/llm holds the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs)
    return docs
