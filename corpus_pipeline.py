"""Corpus pipeline over ``documents``; every stage is written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clientele.functions.staging import stage
from clientele.llm import jaccard_join, mixing_tree, quality_subword, sentencepiece_bpe, toxicity_mil
from clientele.llm.queries import table, tokenizer_path

ORACLE_SQL = None                # trained models and tokenizers are not SQL


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without those that the classifier calls toxic; null and empty texts have a score too. Columns stay as they are."""
    model = toxicity_mil.train(docs, table(spark, sf_dir, "labels"))
    return toxicity_mil.keep_clean(docs, model)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier calls good; null and empty texts have a score too. Columns stay as they are."""
    model = quality_subword.train(docs, table(spark, sf_dir, "labels"))
    return quality_subword.keep_good(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, the one with the smallest id; texts without words are no copies of each other."""
    return jaccard_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as the mix uses them, in shards; texts without words are left out."""
    return mixing_tree.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of ids and decoded text per row; a null text counts as empty."""
    return sentencepiece_bpe.digests(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [("toxicity", drop_toxic), ("quality classifier", drop_low_quality), ("n-gram Jaccard join", drop_near_copies),
          ("mixing sources", mix_sources), ("SentencePiece", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage_of in STAGES[:-1]:
        docs = stage(stage_of(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
