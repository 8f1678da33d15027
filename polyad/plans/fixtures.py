"""Role tables made from the driver's tables, and a closed-form model over one of them."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ngrams, sentences, tokens, usable_texts
from ..operators.assoc import joint_counts
from ..operators.model import Tucker, vocabulary_lists
from ..operators.vocab import MOST_BROADCAST, marginals, ngram_marginals, normalised, vocabulary

ORDER_ROLES = ["returnflag", "priority", "brand"]
MARKET_ROLES = [*ORDER_ROLES, "mktsegment"]
EVENT_ROLES = ["event_type", "user", "hour"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored_bytes(spark: SparkSession, sf_dir: str, name: str) -> int:
    return int(str(table(spark, sf_dir, name)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def sentence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(usable_texts(table(spark, sf_dir, "documents")))


def token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens(sentence_rows(spark, sf_dir)).select("doc_id", "sent_pos", "tokens")


def ngram_roles(n: int) -> list[str]:
    return [f"w{j + 1}" for j in range(n)]


def ngram_rows(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    return ngrams(token_rows(spark, sf_dir), n)


def ngram_counts(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    return ngram_marginals(token_rows(spark, sf_dir), ngram_roles(n))


def order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, orders, part = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    joined = line.select("l_orderkey", "l_partkey", "l_returnflag").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(F.col("l_returnflag").alias("returnflag"), F.col("o_orderpriority").alias("priority"), F.col("p_brand").alias("brand"), "o_custkey")


def market_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("mktsegment"))
    return order_rows(spark, sf_dir).join(customer, F.col("o_custkey") == F.col("c_custkey")).select(*MARKET_ROLES)


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_type", F.col("user_id").cast("string").alias("user"), F.hour("ts").cast("string").alias("hour"))


def closed_factor(size: int, rank: int, salt: int) -> np.ndarray:
    i, r = np.indices((size, rank))
    return ((31 * i + 17 * r + salt) % 97 + 1) / 97


def closed_core(shape: tuple[int, ...]) -> np.ndarray:
    at = np.indices(shape)
    return (reduce(np.add, [w * a for w, a in zip((7, 5, 3, 2), at)]) % 11 + 1) / 11


def order_model(spark: SparkSession, sf_dir: str, k: int = 1000, rank: int = 2) -> tuple[Tucker, DataFrame]:
    """A rank-2 model over the k most frequent tokens of each role of the order rows, and the rows."""
    rows = normalised(order_rows(spark, sf_dir), ORDER_ROLES)
    words = vocabulary_lists(vocabulary(marginals(rows, ORDER_ROLES), ORDER_ROLES, k), ORDER_ROLES)
    return Tucker(closed_core((rank,) * 3), [closed_factor(len(w), rank, m + 1) for m, w in enumerate(words)], words, ORDER_ROLES), rows


def order_cells(spark: SparkSession, sf_dir: str, k: int = 1000) -> DataFrame:
    rows = normalised(order_rows(spark, sf_dir), ORDER_ROLES)
    vocab = vocabulary(marginals(rows, ORDER_ROLES), ORDER_ROLES, k).persist()  # read once for each role
    return joint_counts(rows, vocab, ORDER_ROLES, k).dropna().withColumnRenamed("cnt", "value")


def by_repetition(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows whose doc_id no other row has (or that have none), and the others, if there are any."""
    repeated = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id")
    some = repeated.count()
    near = F.broadcast(repeated) if some <= MOST_BROADCAST else repeated
    return (docs.join(near, "doc_id", "left_anti"), docs.join(near, "doc_id", "left_semi")) if some else (docs, None)


def parsed_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in for a parser: the words of sentences with labels that follow from place and length.

    Sentences are made where their text is read; only those of an id on more than one row are gathered.
    """
    deps = F.array(*map(F.lit, ["nsubj", "dobj", "dative", "obl", "amod", "det"]))

    def word(w: Column, i: Column) -> Column:
        kind = (F.length(w) * 3 + i) % 6
        pos, dep = F.when(F.length(w) % 2 == 0, "VERB").otherwise("NOUN"), F.when(i == 0, "root").otherwise(F.element_at(deps, kind + 1))
        return F.struct(i.alias("i"), w.alias("lemma"), pos.alias("pos"), dep.alias("dep"), F.when((kind == 4) & (i > 0), i - 1).otherwise(0).alias("head"))

    parsed = lambda docs: tokens(sentences(usable_texts(docs))).select("doc_id", "sent_pos", F.transform("tokens", word).alias("words"))
    once, again = by_repetition(table(spark, sf_dir, "documents"))
    if again is None:
        return parsed(once)
    return parsed(once).union(parsed(again).groupBy("doc_id", "sent_pos").agg(F.flatten(F.collect_list("words")).alias("words")))


def frame_elements(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(frame, element, kind) and (frame, element, spans): brands as frames, part types as elements."""
    part = table(spark, sf_dir, "part").select("p_brand", "p_type", "p_size", "p_partkey")
    kinds = F.array(*map(F.lit, ["Core", "Peripheral", "Core-Unexpressed", "Extra-Thematic", "Other"]))
    elements = part.groupBy(F.col("p_brand").alias("frame"), F.col("p_type").alias("element")).agg(F.element_at(kinds, (F.min("p_size") % 5 + 1).cast("int")).alias("kind"))
    spans = F.when(F.col("p_size") > 10, F.array("p_partkey")).otherwise(F.array().cast("array<bigint>"))
    return elements, part.select(F.col("p_brand").alias("frame"), F.col("p_type").alias("element"), spans.alias("spans"))
