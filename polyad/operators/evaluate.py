"""Slot prediction: how well a model ranks the token it was not shown."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import MISSING
from .model import BATCH_NUMBERS, EPS, Tucker

KEYS = ("average_rank_score", "average_prob_score", "absolute_rank_score", "absolute_prob_score", "OOV", "OOV_rate", "tilde_excluded_prob_score", "tilde_rate")


#: Rows whose hashes the driver looks at to find how far in the order of hashes a sample reaches at most.
PILOT = 200_000


def sample(tuples: DataFrame, roles: list[str], n: int, seed: int = 42) -> DataFrame:
    """n distinct complete tuples in the order of a seeded hash: the same ones on every run.

    The hash of the n-th tuple among any of the rows is a bound for that among all rows, so only rows below it
    are made distinct; which rows the bound comes from doesn't matter to the result.
    """
    at = F.xxhash64(*roles, F.lit(seed))
    rows = tuples.select(*roles).dropna()
    # a plain limit is taken from the first partitions only
    first = sorted({h for (h,) in rows.select(at).limit(PILOT).collect()}) if n else []
    if 0 < n <= len(first):
        rows = rows.filter(at <= first[n - 1])
    return rows.dropDuplicates().orderBy(at, *roles).limit(n)


def sampled_scan(spark: SparkSession, path: str, roles: list[str], n: int, seed: int = 42, oversample: int = 3, cache: str | None = None) -> DataFrame:
    """n distinct complete tuples of a stored table, read from as few of its blocks as it takes.

    Blocks (of files) come in the order of a seeded hash until they hold ``oversample`` times n rows; where
    these have fewer than n distinct tuples, twice as many rows are read, and so on up to the whole table.
    cache: a folder that keeps samples by roles, n, seed and the state of the files (names, sizes, times).
    """
    source = spark.read.parquet(path)
    meta = source.select("_metadata.file_path", "_metadata.file_block_start", "_metadata.file_size", "_metadata.file_modification_time")
    blocks = meta.groupBy("file_path", "file_block_start", "file_size", "file_modification_time").agg(F.count(F.lit(1)).alias("rows"))
    found = blocks.orderBy(F.xxhash64("file_path", "file_block_start", F.lit(seed)), "file_path", "file_block_start").collect()  # one row a block
    state = hashlib.sha1(repr((roles, n, seed, oversample, sorted((b["file_path"], b["file_size"], str(b["file_modification_time"])) for b in found))).encode()).hexdigest()
    order = [F.xxhash64(*roles, F.lit(seed)), *roles]
    if cache:
        fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{cache}/{state}/_SUCCESS")
        if fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs):
            return spark.read.parquet(f"{cache}/{state}").orderBy(*order)
    wanted = n * oversample
    while True:
        chosen, held = [], 0
        for b in found:
            if held >= wanted:
                break
            chosen.append((b["file_path"], b["file_block_start"]))
            held += b["rows"]
        part = source
        if len(chosen) < len(found):
            files = sorted({f for f, _ in chosen})
            table = spark.createDataFrame(chosen, "_file string, _start long")
            part = source.select(*roles, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start")).filter(F.col("_file").isin(files)).join(F.broadcast(table), ["_file", "_start"], "left_semi")
        rows = part.select(*roles).dropna().dropDuplicates().orderBy(*order).limit(n)
        if len(chosen) == len(found) or rows.count() == n:
            break
        wanted *= 2
    if rows.count() < n:
        raise ValueError(f"{path} has fewer than {n} distinct complete tuples")
    if cache:
        rows.write.mode("overwrite").parquet(f"{cache}/{state}")
        return spark.read.parquet(f"{cache}/{state}").orderBy(*order)
    return rows


def ranked(model: Tucker, tuples: DataFrame, temperature: float = 0.1) -> DataFrame:
    """(role tokens, role, rank, prob) of every known tuple and role.

    rank counts the tokens at least as similar to the prediction as the true one, ties included; prob is the
    true one's share of a softmax of the similarities.
    """
    names = model.roles

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            index = model.indices(b)
            ok = np.flatnonzero((index >= 0).all(1))
            for m, role in enumerate(names):
                f = model.factors[m]
                size = np.maximum(np.linalg.norm(f, axis=1), EPS)
                step = max(1, BATCH_NUMBERS // max(len(f), 1))
                for k in range(0, len(ok), step):
                    rows = ok[k : k + step]
                    i = index[rows]
                    wanted = model.excluded_batch(i, role)
                    cos = np.clip(wanted @ f.T / np.outer(np.maximum(np.linalg.norm(wanted, axis=1), EPS), size), -1, 1)
                    own = cos[np.arange(len(i)), i[:, m]][:, None]
                    e = np.exp((cos - cos.max(1, keepdims=True)) / temperature)
                    prob = e[np.arange(len(i)), i[:, m]] / e.sum(1)
                    taken = b.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([*(taken.column(r) for r in names), pa.array([role] * len(rows)), pa.array(np.maximum((cos >= own).sum(1), 1).astype(np.int64)), pa.array(prob)], names=[*names, "role", "rank", "prob"])

    return tuples.select(*names).mapInArrow(run, ", ".join(f"`{r}` string" for r in names) + ", role string, rank long, prob double")


def metrics(model: Tucker, tuples: DataFrame, temperature: float = 0.1) -> DataFrame:
    """One row of KEYS. Averages are over all tuples, absolute values over the known ones; without any, 0."""
    n = len(model.roles)
    tuples = tuples.select(*model.roles)
    total = tuples.agg(F.count(F.lit(1)).alias("total"))
    own = F.element_at(F.array(*model.roles), F.array_position(F.array(*map(F.lit, model.roles)), F.col("role")).cast("int"))
    sums = ranked(model, tuples, temperature).agg(
        F.coalesce(F.sum(1 / F.col("rank")), F.lit(0.0)).alias("rank_sum"),
        F.coalesce(F.sum("prob"), F.lit(0.0)).alias("prob_sum"),
        F.coalesce(F.sum(F.when(own != MISSING, F.col("prob"))), F.lit(0.0)).alias("shown"),
        F.count_if(own == MISSING).alias("tildes"),
        (F.count(F.lit(1)) / n).alias("known"),
    )
    each = lambda x, by: F.when(F.col(by) > 0, x / F.col(by)).otherwise(F.lit(0.0))
    both = total.crossJoin(sums)  # one row each
    values = {
        "average_rank_score": each(F.col("rank_sum") / n, "total"),
        "average_prob_score": each(F.col("prob_sum") / n, "total"),
        "absolute_rank_score": each(F.col("rank_sum") / n, "known"),
        "absolute_prob_score": each(F.col("prob_sum") / n, "known"),
        "OOV": F.col("total") - F.col("known").cast("long"),
        "OOV_rate": each(F.col("total") - F.col("known"), "total"),
        "tilde_excluded_prob_score": each(F.col("shown") / n, "known"),
        "tilde_rate": each(F.col("tildes") / n, "known"),
    }
    return both.select(*[values[k].alias(k) for k in KEYS])


def evaluate(model: Tucker, tuples: DataFrame, temperature: float = 0.1, keys: tuple[str, ...] | str = "all") -> dict[str, float]:
    row = metrics(model, tuples, temperature).first().asDict()
    wanted = KEYS if keys == "all" else (keys,) if isinstance(keys, str) else tuple(keys)
    if unknown := [k for k in wanted if k not in KEYS]:
        raise ValueError(f"no such scores: {unknown}; there are {KEYS}")
    return {k: row[k] for k in wanted}
