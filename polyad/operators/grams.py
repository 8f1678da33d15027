"""Counts of n-grams, and distinct ones of several orders by word codes, from stretches of sentences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ngrams, stretches

#: n-grams that a task holds before it drops repeated ones; words that it encodes at once.
MOST_HELD = 2_000_000
MOST_WORDS = 1_000_000
#: Bytes of stored text whose n-grams meet in one task; as rows of Spark's own tables they are larger.
TASK_BYTES = 8_000_000
ROW_TASK_BYTES = 4_000_000


def distinct(rows: np.ndarray, least: int, count: bool) -> dict[int, int] | np.ndarray:
    """How many distinct n-grams of each order from ``least`` on; or the distinct rows. 0 stands for no word."""
    width, key, out = int(rows.max(initial=0)) + 1, rows[:, 0].astype(np.int64), {}
    for n in range(1, rows.shape[1] + 1):
        if n > 1:  # what has gone before is numbered anew: below 2^31 rows times 2^31 codes
            key = key * width + rows[:, n - 1]
        if count and n > least - 1:
            full = rows[:, n - 1] > 0
            rows, key = rows[full], key[full]
        if n == rows.shape[1]:
            break
        if n > 1:
            found, key = np.unique(key, return_inverse=True)
            out[n] = len(found)
    if not count:
        return rows[np.unique(key, return_index=True)[1]]
    return out | {rows.shape[1]: len(np.unique(key))}


def windows(words: pa.Array, many: np.ndarray, most: int, codes: dict[str, int]) -> np.ndarray:
    """The codes (from 1) of the words at each n-gram's place and after it; 0 past the end of the stretch."""
    lists = pc.split_pattern(words, " ")
    ends = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    own = np.array([codes.setdefault(w, len(codes) + 1) for w in coded.dictionary.to_pylist()], np.int32)
    flat = np.append(own[coded.indices.to_numpy()], np.zeros(most, np.int32))
    start, end = ends[:-1] - ends[0], ends[1:] - ends[0]
    which = np.repeat(np.arange(len(many)), many)
    at = start[which] + np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
    return np.stack([np.where(at + j < end[which], flat[at + j], 0) for j in range(most)], axis=1)


def order_counts(tokens: DataFrame, orders: list[int], stored_bytes: int) -> DataFrame:
    """(n, n_rows, n_distinct) for each order. stored_bytes: of the texts, for the number of tasks.

    An n-gram is the beginning of what stands at its place, so only stretches for the smallest order travel,
    each with the words that the longest order needs, and all orders are counted where they meet.
    """
    least, most = min(orders), max(orders)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[str, int] = {}
        held, size, limit = [], 0, MOST_HELD
        total = dict.fromkeys(orders, 0)
        for batch in batches:
            step = max(1, MOST_WORDS * batch.num_rows // max(1, batch.nbytes))
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                rows = windows(part.column(0), part.column(1).to_numpy(), most, codes)
                for n in orders:
                    total[n] += int(np.count_nonzero(rows[:, n - 1]))
                held.append(rows)
                size += len(rows)
                if size > limit:
                    held = [distinct(np.concatenate(held), least, False)]
                    size = len(held[0])
                    limit = max(MOST_HELD, 2 * size)
        rows = np.concatenate(held) if held else np.zeros((0, most), np.int32)
        found = distinct(rows, least, True)
        yield pa.RecordBatch.from_arrays([pa.array(orders, pa.int32()), pa.array([total[n] for n in orders], pa.int64()), pa.array([found[n] for n in orders], pa.int64())], ["n", "n_rows", "n_distinct"])

    spark = tokens.sparkSession
    tasks = _tasks(spark, stored_bytes, TASK_BYTES)
    moved = stretches(tokens, least, most - least).repartition(tasks, "part").select("words", "many")
    each = moved.mapInArrow(counted, "n int, n_rows long, n_distinct long")
    none = spark.createDataFrame([(n, 0, 0) for n in orders], each.schema)  # where there is no text at all
    return each.union(none).groupBy("n").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_distinct").alias("n_distinct"))


def ngram_counts(tokens: DataFrame, n: int, stored_bytes: int) -> DataFrame:
    """(w1, ..., wn, cnt). stored_bytes: of the texts, for the number of tasks.

    Stretches travel, and n-grams are made and counted where they meet: a part holds all of an n-gram, so
    grouping by part and words needs no shuffle of n-grams.
    """
    moved = stretches(tokens, n).repartition(_tasks(tokens.sparkSession, stored_bytes, ROW_TASK_BYTES), "part")
    words = [f"w{j + 1}" for j in range(n)]
    found = ngrams(moved.select("part", F.split("words", " ").alias("tokens")), n, keep=["part"])
    return found.groupBy("part", *words).agg(F.count(F.lit(1)).alias("cnt")).drop("part")


def _tasks(spark: SparkSession, stored_bytes: int, each: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-stored_bytes // each))
