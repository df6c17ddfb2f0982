"""A training corpus from raw documents, in stages that each read what the one before wrote."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers

from pyspark.sql import DataFrame, SparkSession

from barloom.llm import bpe, common, jaccard, lines, mixing, toxicity
from barloom.llm.queries import RANKS, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def clean_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned lexicon scores as toxic go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in three documents or more stay in one. ``n_chars`` follows the text."""
    common.prepared(spark)
    kept = lines.dedup_lines(docs).drop("n_lines", "n_dropped")
    return common.with_length(kept, docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share 80 % of their runs of five words, directly or over others, the one
    with the smallest id stays."""
    common.prepared(spark)
    return jaccard.keep_one(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat or go as the target weights of their sources ask."""
    common.prepared(spark)
    return mixing.mix_documents(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, as digests."""
    common.prepared(spark)
    return bpe.digests(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", clean_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_stage),
    ("mixing sources to target weights", mix_stage),
    ("byte-level BPE encoding and decoding", token_stage),
]

#: The first stage's lexicon is learned and the last one's ids come from a rank file.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
