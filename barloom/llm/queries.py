"""One query per operator, over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import (
    alignment,
    bpe,
    fingerprints,
    jaccard,
    lines,
    mixing,
    negatives,
    neighbours,
    quality,
    sharding,
    substrings,
    toxicity,
    urls,
)
from barloom.llm.common import prepared
from barloom.llm.sql import SQL

Query = Callable[[SparkSession, str], DataFrame]
RANKS = "byte_bpe_multi_50k.tiktoken"
URL_RULES = (
    ("com/", urls.ALLOW),
    ("example.com/en/", urls.BLOCK),
    ("www.example.com/en/", urls.ALLOW),
    ("net/es/", urls.BLOCK),
    ("net/fr/", urls.BLOCK),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_report(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.window_digests(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_report(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_digests(table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path(RANKS)
    return bpe.digests(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = jaccard.JaccardRule(words=3, percent=90)
    return jaccard.component_report(table(spark, sf_dir, "documents"), rule)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_verdicts(table(spark, sf_dir, "pages"), URL_RULES)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.toxicity_scores(docs, labels)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = alignment.Pair(
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("piece_bpe_32k.model"),
        public_tokenizers.PATTERN,
    )
    return alignment.alignment_report(table(spark, sf_dir, "documents"), pair)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", moved.alias("label"), "embedding")
    return negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)


def op13_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_fingerprints": op2_fingerprints,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_mixing": op4_mixing,
    "op5_sharding": op5_sharding,
    "op6_line_dedup": op6_line_dedup,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_url_filter": op9_url_filter,
    "op10_toxicity": op10_toxicity,
    "op11_alignment": op11_alignment,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_near_vectors": op13_near_vectors,
}

ORACLE: dict[str, str] = SQL
