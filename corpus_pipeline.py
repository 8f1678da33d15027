"""The corpus pipeline: quality rules, near-duplicates, secrets, mixing, packing.

Every stage takes (spark, docs, sf_dir) and treats all documents its predecessor kept. All but the last
return the columns of documents; the last returns the packed pieces. Nulls, empty texts, repeated rows,
empty tables and further columns are treated as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from polyad.llm import minhash, mixing, packing, rules, secret_scan
from polyad.llm.queries import vocabulary
from polyad.llm.runtime import Scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fixed limits or the learned rules reject go."""
    return rules.keep_good(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the smallest id stays."""
    return minhash.keep_first(spark, docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; the documents stay."""
    return secret_scan.mask_secrets(spark, docs, vocabulary("byte_bpe_50k.tiktoken"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it, which may be never."""
    return mixing.mix_documents(spark, docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in the sequences."""
    return packing.pack(spark, docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_duplicates),
    ("secret scans", secrets),
    ("mixing sources", source_mix),
    ("best-fit packing", packed),
]

#: Learned rules, minima and tokenizers can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each written and read again."""
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.save(docs, f"stage-{i + 1}")
    return docs
