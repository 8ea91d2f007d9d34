"""Queries of the corpus operators, by name, and their checking SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (ann_tree, hard_negatives, jaccard_join, mixing_tree, quality_ledger, quality_subword, secret_scan, sentencepiece_bpe, token_counts, toxicity_mil,
               url_filters, warc, whitening)

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@query
def op1_toxicity_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, with the offending sentences."""
    docs = table(spark, sf_dir, "documents")
    return toxicity_mil.score(docs, toxicity_mil.train(docs, table(spark, sf_dir, "labels")))


@query
def op2_ann_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every vector whose id is divisible by 20."""
    return ann_tree.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through the archives and back."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


ORACLES["op3_warc"] = warc.ORACLE


@query
def op4_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements and verdict of every document, by policy v2."""
    rows = quality_ledger.apply_policy(quality_ledger.ledger(table(spark, sf_dir, "documents")), "v2")
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLES["op4_quality_ledger"] = quality_ledger.ORACLE


@query
def op5_quality_subword(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    docs = table(spark, sf_dir, "documents")
    return quality_subword.score(docs, quality_subword.train(docs, table(spark, sf_dir, "labels")))


@query
def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page's URL."""
    return url_filters.judge(table(spark, sf_dir, "pages"), url_filters.rules_table(spark))


ORACLES["op6_url_filters"] = url_filters.ORACLE


@query
def op7_mixing_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    rows, _ = mixing_tree.taken(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", "taken")


@query
def op8_sentencepiece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of ids and decoded text of every document."""
    return sentencepiece_bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


@query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count of every document."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


@query
def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under 5-word shingle similarity of 0.75 and more."""
    return jaccard_join.join(table(spark, sf_dir, "documents"))


ORACLES["op10_jaccard_join"] = jaccard_join.ORACLE


@query
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four whitened components of every vector."""
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten hard negatives for each of five positives of every vector whose id is divisible by 100."""
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors, F.col("vec_id") % 100 == 0, label=moved)


ORACLES["op12_hard_negatives"] = hard_negatives.ORACLE


@query
def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    return secret_scan.scan(table(spark, sf_dir, "documents"))
