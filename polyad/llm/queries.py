"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_cnn, ego_join, html_main, minhash, mixing, ngram_trie, packing, rules, secret_scan, token_counts


def vocabulary(name: str) -> str:
    """Where a public vocabulary file lies on this machine."""
    from public_tokenizers import path

    return str(path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ego_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ego_join.near_duplicates(spark, table(spark, sf_dir, "embeddings"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_cnn.classify(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(spark, table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(spark, table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(spark, table(spark, sf_dir, "pages"))


def op7_ngram_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_trie.score(spark, table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark, table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a cache of its own for each call, so that every text is digested, joined and counted anew."""
    return token_counts.count_tokens(spark, table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_ego_join, op2_quality_classifier, op3_minhash, op4_secret_scan, op5_quality_rules, op6_html_extraction, op7_ngram_trie, op8_best_fit_packing, op9_mixing, op10_token_counts]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_ego_join": ego_join.ORACLE_SQL, "op9_mixing": mixing.ORACLE_SQL}
