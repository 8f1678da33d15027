"""Nearest rows of a stated set of query vectors, by blocks of matrix products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EPS = 1e-12
#: Vectors in a block; a block and its partner are what a task holds.
BLOCK = 2048


def block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ids, vectors, dim): blocks of unit vectors in bytes."""
    for batch in batches:
        for k in range(0, batch.num_rows, BLOCK):
            part = batch.slice(k, BLOCK)
            sizes = np.array([len(e) for e in part.column(1)])
            for d in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == d)
                v = np.array(part.column(1).take(pa.array(rows)).to_pylist(), float).reshape(len(rows), d)
                v = v / np.maximum(np.linalg.norm(v, axis=1), EPS)[:, None]
                ids = part.column(0).take(pa.array(rows)).to_numpy().astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()]), pa.array([v.tobytes()]), pa.array([d], pa.int32())], names=["ids", "vectors", "dim"])


def nearest(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(id, neighbour, cosine) of the k nearest rows of each query, itself excluded; ties by neighbour.

    queries and rows: (id, vector). Blocks of queries meet blocks of rows; each pair of blocks reports k rows
    a query at most.
    """
    kind = "ids binary, vectors binary, dim int"
    left = queries.toDF("id", "v").dropna().mapInArrow(block_rows, kind)
    right = rows.toDF("id", "v").dropna().mapInArrow(block_rows, kind).toDF("ids2", "vectors2", "dim2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                if r["dim"] != r["dim2"]:
                    continue
                a, b = (np.frombuffer(r[c], np.int64) for c in ("ids", "ids2"))
                cos = np.frombuffer(r["vectors"]).reshape(len(a), -1) @ np.frombuffer(r["vectors2"]).reshape(len(b), -1).T
                cos[a[:, None] == b] = -np.inf
                order = np.lexsort((np.broadcast_to(b, cos.shape), -cos), axis=1)[:, :k]
                best = np.take_along_axis(cos, order, 1)
                i, j = np.nonzero(np.isfinite(best))
                yield pa.RecordBatch.from_arrays([pa.array(a[i]), pa.array(b[order[i, j]]), pa.array(best[i, j])], names=["id", "neighbour", "cosine"])

    # a stated set of queries against all rows: pairs of blocks, never of rows
    found = left.crossJoin(right).mapInArrow(run, "id long, neighbour long, cosine double")
    order = Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour")
    return found.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= k).drop("k")
