"""Registry of the training-data queries: ``opN_<name>`` over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from webstrata.llm import debruijn, jaccard, mix, pieces, pii, quality, shards, suffix, topk, warc
from webstrata.session import table

Query = Callable[[SparkSession, str], DataFrame]


def over(name: str, op: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: op(table(spark, sf_dir, name))


def queries() -> dict[str, Query]:
    return {
        "op1_warc_derivatives": over("pages", warc.op1),
        "op2_suffix_array_dedup": over("documents", suffix.op2),
        "op3_pii_disclosure": over("documents", pii.op3),
        "op4_ngram_jaccard_join": over("documents", jaccard.op4),
        "op5_uniform_threshold_topk": over("embeddings", topk.op5),
        "op6_debruijn_dedup": over("documents", debruijn.op6),
        "op7_sentencepiece_nbest": over("documents", pieces.op7),
        "op8_sampled_splitters": over("documents", shards.op8),
        "op9_weighted_fair_mix": over("documents", mix.op9),
        "op10_quality_rules": over("documents", quality.op10),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc_derivatives": warc.oracle(),
        "op4_ngram_jaccard_join": jaccard.oracle(),
        "op5_uniform_threshold_topk": topk.oracle(),
        "op6_debruijn_dedup": debruijn.oracle(),
        "op8_sampled_splitters": shards.oracle(),
        "op9_weighted_fair_mix": mix.oracle(),
        "op10_quality_rules": quality.oracle(),
    }
