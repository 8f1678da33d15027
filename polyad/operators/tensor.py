"""Sparse tensors as coordinate tables, and operators on them as joins and sums."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def coords(n: int) -> list[str]:
    return [f"i{j}" for j in range(n)]


def coalesce_cells(cells: DataFrame, n: int) -> DataFrame:
    """One row for each coordinate, values added."""
    return cells.groupBy(*coords(n)).agg(F.sum("value").alias("value"))


def unfold(cells: DataFrame, n: int, mode: int) -> DataFrame:
    """(row, column, value) of the mode's matrix; column: the other coordinates as an array, no linear index."""
    return cells.select(F.col(f"i{mode}").alias("row"), F.array(*[F.col(c) for j, c in enumerate(coords(n)) if j != mode]).alias("column"), "value")


def fold(matrix: DataFrame, n: int, mode: int) -> DataFrame:
    """Back from an unfolded matrix; equal coordinates are added."""
    others = [j for j in range(n) if j != mode]
    at = {mode: F.col("row"), **{j: F.col("column")[k] for k, j in enumerate(others)}}
    return coalesce_cells(matrix.select(*[at[j].cast("int").alias(f"i{j}") for j in range(n)], "value"), n)


def matrix_table(spark: SparkSession, matrix: np.ndarray) -> DataFrame:
    """(i, r, v) of a dense matrix."""
    i, r = np.indices(matrix.shape)
    rows = zip(i.ravel().tolist(), r.ravel().tolist(), np.asarray(matrix, float).ravel().tolist())
    return spark.createDataFrame(list(rows), "i int, r int, v double")


def mode_product(cells: DataFrame, n: int, mode: int, matrix: DataFrame, transpose: bool = False) -> DataFrame:
    """The tensor times a matrix table (i, r, v) along one mode: sums over i (transpose: over r)."""
    old, new = ("r", "i") if transpose else ("i", "r")
    joined = cells.join(matrix, cells[f"i{mode}"] == matrix[old])
    keys = [F.col(new).alias(f"i{j}") if j == mode else cells[f"i{j}"] for j in range(n)]
    return joined.select(*keys, (F.col("value") * F.col("v")).alias("value")).groupBy(*coords(n)).agg(F.sum("value").alias("value"))


def multi_mode_product(cells: DataFrame, n: int, matrices: dict[int, DataFrame], transpose: bool = False) -> DataFrame:
    return reduce(lambda t, m: mode_product(t, n, m, matrices[m], transpose), sorted(matrices), cells)


def dense_times_sparse(left: DataFrame, matrix: DataFrame) -> DataFrame:
    """(i, r, v) times unfolded (row, column, value): (i, column, value)."""
    joined = left.join(matrix, left["r"] == matrix["row"])
    return joined.groupBy("i", "column").agg(F.sum(F.col("v") * F.col("value")).alias("value"))


def subsample(cells: DataFrame, n: int, share: float, seed: int, iteration: int = 0, exact: bool = False) -> DataFrame:
    """About (exact: just) ``share`` of the cells, values divided by it; the same cells on every run.

    Cells are chosen by a hash of their coordinates, so the choice doesn't depend on partitioning.
    """
    if not 0 < share <= 1:
        raise ValueError("share must be above 0 and at most 1")
    if share == 1:
        return cells
    order = F.xxhash64(*coords(n), F.lit(seed), F.lit(iteration))
    if exact:
        kept = max(1, round(cells.count() * share))
        chosen = cells.orderBy(order, *coords(n)).limit(kept)
    else:
        chosen = cells.filter(F.pmod(order, F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    return chosen.withColumn("value", F.col("value") / share)


def inspect(cells: DataFrame, shape: tuple[int, ...]) -> DataFrame:
    """One row: order, nonzeros, cells (as a double: it may exceed 64 bits), density and bytes as COO."""
    cells_all = float(np.prod(np.array(shape, float)))
    return cells.agg(F.count(F.lit(1)).alias("nnz"), F.min("value").alias("least"), F.max("value").alias("most"), F.sum("value").alias("total")).select(
        F.lit(len(shape)).alias("order"), "nnz", F.lit(cells_all).alias("cells"), (F.col("nnz") / cells_all).alias("density"), (F.col("nnz") * (8 * len(shape) + 4)).alias("coo_bytes"), "least", "most", "total"
    )


def training_cost(divergence: str, dim: int, nnz: int, rank: int = 100) -> float:
    """The published closed-form cost estimate (no unit is stated for it)."""
    if divergence == "fr" and dim <= 4000:
        return dim / 1000
    if divergence == "kl" and dim < 4000:
        return dim / 200
    return rank**1.76 * dim**0.16 * nnz**0.78 * 1e-9 + rank**2.6 * nnz * 1e-10


def ravel(shape: tuple[int, ...], columns: list[Column]) -> Column:
    """One linear index, last mode fastest, as a decimal that holds any shape up to 38 digits."""
    out = columns[0].cast("decimal(38,0)")
    for size, c in zip(shape[1:], columns[1:]):
        out = (out * F.lit(size).cast("decimal(18,0)") + c.cast("decimal(18,0)")).cast("decimal(38,0)")
    return out


def unravel(shape: tuple[int, ...], index: Column) -> list[Column]:
    """The coordinates of a linear index, last mode fastest."""
    out, rest = [], index.cast("decimal(38,0)")
    for size in reversed(shape):
        n = F.lit(size).cast("decimal(18,0)")
        at = F.pmod(rest, n)
        out.append(at.cast("long"))
        rest = ((rest - at) / n).cast("decimal(38,0)")
    return out[::-1]


def to_dense(cells: DataFrame, shape: tuple[int, ...], most: int = 50_000_000) -> np.ndarray:
    """A dense array of a small tensor; a shape of more than ``most`` cells is refused."""
    if np.prod(np.array(shape, float)) > most:
        raise ValueError(f"{shape} has more than {most} cells")
    out = np.zeros(shape)
    table = cells.toPandas()
    np.add.at(out, tuple(table[c].to_numpy(int) for c in coords(len(shape))), table["value"].to_numpy(float))
    return out


def from_dense(spark: SparkSession, array: np.ndarray) -> DataFrame:
    at = np.nonzero(array)
    rows = zip(*[a.tolist() for a in at], array[at].astype(float).tolist())
    return spark.createDataFrame(list(rows), ", ".join(f"{c} int" for c in coords(array.ndim)) + ", value double")
