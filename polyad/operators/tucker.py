"""Non-negative Tucker decomposition by multiplicative updates.

Core and factors are small (ranks by vocabulary) and live on the driver; the nonzeros are a coordinate table.
A job takes one pass over the nonzeros: each partition works on numpy batches and returns partial sums
by blocks of rows, which are added on the executors, so the driver gets one factor's worth of numbers
whatever the number of partitions. Sums over all cells, zeros included, are rank-space algebra.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tensor import coords, subsample
from .vocab import groups

EPS = 1e-12
#: Numbers a batch of cells times the core may take; rows of a factor that one task adds up.
BATCH_NUMBERS, BLOCK_ROWS = 4_000_000, 4096
#: Nonzeros that the driver may be asked to hold.
MOST_LOCAL = 5_000_000


def contract(core: np.ndarray, rows: list[np.ndarray | None]) -> np.ndarray:
    """For each cell the core contracted with its factor rows; a mode of None stays."""
    kept = [m for m, r in enumerate(rows) if r is None]
    used = [m for m, r in enumerate(rows) if r is not None]
    first = used[-1]
    # the last used mode as one matrix product, the others cell by cell from behind
    order = [*kept, *used[:-1], first]
    g = np.transpose(core, order)
    out = (rows[first] @ g.reshape(-1, g.shape[-1]).T).reshape(len(rows[first]), *g.shape[:-1])
    for m in reversed(used[:-1]):
        out = np.einsum("n...r,nr->n...", out, rows[m])
    return out


def batches_of(core: np.ndarray, n_cells: int) -> Iterator[slice]:
    step = max(1, BATCH_NUMBERS // max(core.size, 1))
    for k in range(0, n_cells, step):
        yield slice(k, k + step)


def column_sums(factors: list[np.ndarray]) -> list[np.ndarray]:
    return [f.sum(0) for f in factors]


def grams(factors: list[np.ndarray]) -> list[np.ndarray]:
    return [f.T @ f for f in factors]


def core_with(core: np.ndarray, matrices: dict[int, np.ndarray]) -> np.ndarray:
    """The core times matrices along modes (a vector removes nothing: use row vectors of shape (1, R))."""
    for m, x in matrices.items():
        core = np.moveaxis(np.tensordot(x, core, (1, m)), 0, m)
    return core


def kl_denominator(core: np.ndarray, factors: list[np.ndarray], mode: int) -> np.ndarray:
    """What all reconstructed cells hold of each component of the mode."""
    rest = {m: s[None, :] for m, s in enumerate(column_sums(factors)) if m != mode}
    return np.maximum(core_with(core, rest).ravel(), EPS)


def fr_gram(core: np.ndarray, factors: list[np.ndarray], mode: int) -> np.ndarray:
    rest = {m: g for m, g in enumerate(grams(factors)) if m != mode}
    unfold = lambda x: np.moveaxis(x, mode, 0).reshape(x.shape[mode], -1)
    return np.maximum(unfold(core_with(core, rest)) @ unfold(core).T, EPS)


def total_mass(core: np.ndarray, factors: list[np.ndarray]) -> float:
    """The sum of all reconstructed cells."""
    return float(core_with(core, {m: s[None, :] for m, s in enumerate(column_sums(factors))}).ravel()[0])


def squared_norm(core: np.ndarray, factors: list[np.ndarray]) -> float:
    return float((core * core_with(core, dict(enumerate(grams(factors))))).sum())


def factor_part(index: np.ndarray, x: np.ndarray, core: np.ndarray, factors: list[np.ndarray], mode: int, divergence: str) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the mode that occur, and their numerators."""
    rows, which = np.unique(index[:, mode], return_inverse=True)
    out = np.zeros((len(rows), core.shape[mode]))
    for s in batches_of(core, len(x)):
        z = contract(core, [None if m == mode else f[index[s, m]] for m, f in enumerate(factors)])
        if divergence == "kl":
            r = np.maximum((z * factors[mode][index[s, mode]]).sum(1), EPS)
            z = z * (x[s] / r)[:, None]
        else:
            z = z * x[s][:, None]
        np.add.at(out, which[s], z)
    return rows, out


def core_part(index: np.ndarray, x: np.ndarray, core: np.ndarray, factors: list[np.ndarray], divergence: str) -> np.ndarray:
    out = np.zeros(core.shape)
    for s in batches_of(core, len(x)):
        rows = [f[index[s, m]] for m, f in enumerate(factors)]
        w = x[s]
        if divergence == "kl":
            w = w / np.maximum(contract(core, rows), EPS)
        left = rows[0] * w[:, None]
        for r in rows[1:-1]:
            left = (left[:, :, None] * r[:, None, :]).reshape(len(w), -1)
        out += (left.T @ rows[-1]).reshape(core.shape) if core.ndim > 1 else left.sum(0)
    return out


def error_part(index: np.ndarray, x: np.ndarray, core: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """Sums over nonzeros: x, x*x, x*r, r, x ln(x/r) - x + r."""
    out = np.zeros(5)
    for s in batches_of(core, len(x)):
        r = np.maximum(contract(core, [f[index[s, m]] for m, f in enumerate(factors)]), EPS)
        v = x[s]
        out += [v.sum(), (v * v).sum(), (v * r).sum(), r.sum(), (v * np.log(np.maximum(v, EPS) / r) - v + r).sum()]
    return out


class Cells:
    """The nonzeros (i0, ..., value) on the executors; on the driver only if the caller asks for it.

    on_driver: for tensors that the caller knows to be small (MOST_LOCAL is checked). Both ways run the same
    numpy functions; this one saves jobs where a job costs more than its work.
    """

    def __init__(self, cells: DataFrame, shape: tuple[int, ...], on_driver: bool = False) -> None:
        self.shape, self.n = tuple(shape), len(shape)
        self.frame = cells.select(*coords(self.n), F.col("value").cast("double").alias("value")).persist()
        self.nnz = self.frame.count()
        self.local: tuple[np.ndarray, np.ndarray] | None = None
        if on_driver:
            if self.nnz > MOST_LOCAL:
                raise ValueError(f"{self.nnz} nonzeros are too many for the driver")
            t = self.frame.toPandas().sort_values(coords(self.n))
            self.local = t[coords(self.n)].to_numpy(np.int64), t["value"].to_numpy(float)

    def release(self) -> None:
        self.frame.unpersist()

    def part(self, share: float, seed: int, iteration: int) -> Cells:
        out = object.__new__(Cells)
        out.shape, out.n, out.local = self.shape, self.n, None
        out.frame = subsample(self.frame, self.n, share, seed, iteration)
        if self.local:
            t = out.frame.toPandas().sort_values(coords(self.n))
            out.local = t[coords(self.n)].to_numpy(np.int64), t["value"].to_numpy(float)
        return out

    def sums(self, function: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], width: int) -> tuple[np.ndarray, np.ndarray]:
        """Adds (rows, values of ``width`` columns) over all cells by row."""
        n = self.n
        if self.local:
            return function(*self.local)

        def merged(pieces: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            rows, which = np.unique(np.concatenate([p[0] for p in pieces]), return_inverse=True)
            out = np.zeros((len(rows), width))
            np.add.at(out, which, np.concatenate([p[1] for p in pieces]))
            return rows, out

        def rows_of(rows: np.ndarray, out: np.ndarray) -> Iterator[pa.RecordBatch]:
            block = rows // BLOCK_ROWS
            for b in np.unique(block).tolist():
                at = block == b
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([rows[at].astype(np.int64).tobytes()], pa.binary()), pa.array([np.ascontiguousarray(out[at]).tobytes()], pa.binary())], names=["block", "rows", "sums"])

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pieces = []
            for b in batches:
                if b.num_rows:
                    index = np.stack([b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(n)], 1)
                    pieces.append(function(index, b.column(n).to_numpy(zero_copy_only=False)))
                if len(pieces) > 8:
                    pieces = [merged(pieces)]
            if pieces:
                yield from rows_of(*merged(pieces))

        def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pieces = [(np.frombuffer(r, np.int64), np.frombuffer(s, float).reshape(-1, width)) for b in batches for r, s in zip(b.column("rows").to_pylist(), b.column("sums").to_pylist())]
            if pieces:
                yield from rows_of(*merged(pieces))

        schema = "block long, rows binary, sums binary"
        found = self.frame.mapInArrow(partial, schema).repartition("block").mapInArrow(final, schema).collect()
        pieces = [(np.frombuffer(r["rows"], np.int64), np.frombuffer(r["sums"], float).reshape(-1, width)) for r in found]
        return merged(pieces) if pieces else (np.zeros(0, np.int64), np.zeros((0, width)))


def update_factor(cells: Cells, core: np.ndarray, factors: list[np.ndarray], mode: int, divergence: str) -> np.ndarray:
    """The mode's factor after one multiplicative update."""
    rows, numerator = cells.sums(lambda i, x: factor_part(i, x, core, factors, mode, divergence), core.shape[mode])
    full = np.zeros(factors[mode].shape)
    full[rows] = numerator
    below = kl_denominator(core, factors, mode)[None, :] if divergence == "kl" else np.maximum(factors[mode] @ fr_gram(core, factors, mode), EPS)
    return np.maximum(factors[mode] * full / below, EPS)


def update_core(cells: Cells, core: np.ndarray, factors: list[np.ndarray], divergence: str) -> np.ndarray:
    _, sums = cells.sums(lambda i, x: (np.zeros(1, np.int64), core_part(i, x, core, factors, divergence).reshape(1, -1)), core.size)
    numerator = sums.reshape(core.shape) if len(sums) else np.zeros(core.shape)
    if divergence == "kl":
        below = np.ones(())
        for s in column_sums(factors):
            below = np.multiply.outer(below, s)
        below = np.maximum(below, EPS)
    else:
        below = np.maximum(core_with(core, dict(enumerate(grams(factors)))), EPS)
    return np.maximum(core * numerator / below, EPS)


def relative_error(cells: Cells, core: np.ndarray, factors: list[np.ndarray], divergence: str) -> float:
    """KL: the divergence over all cells by the sum of x. FR: the norm of the difference by that of x."""
    _, sums = cells.sums(lambda i, x: (np.zeros(1, np.int64), error_part(i, x, core, factors)[None, :]), 5)
    if not len(sums):
        return 0.0
    x, xx, xr, r, kl = sums[0].tolist()
    if divergence == "kl":
        return (kl + total_mass(core, factors) - r) / max(x, EPS)
    return float(np.sqrt(max(xx + squared_norm(core, factors) - 2 * xr, 0.0)) / max(np.sqrt(xx), EPS))


def fr_core_and_error(cells: Cells, core: np.ndarray, factors: list[np.ndarray]) -> tuple[np.ndarray, float]:
    """The core after a Frobenius update and the relative error before it, from one pass over the nonzeros."""

    def both(i: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.zeros(1, np.int64), np.concatenate((core_part(i, x, core, factors, "fr").ravel(), error_part(i, x, core, factors)))[None, :]

    _, sums = cells.sums(both, core.size + 5)
    if not len(sums):
        return np.full(core.shape, EPS), 0.0
    numerator, (_, xx, xr, _, _) = sums[0, : core.size].reshape(core.shape), sums[0, core.size :].tolist()
    below = np.maximum(core_with(core, dict(enumerate(grams(factors)))), EPS)
    error = float(np.sqrt(max(xx + squared_norm(core, factors) - 2 * xr, 0.0)) / max(np.sqrt(xx), EPS))
    return np.maximum(core * numerator / below, EPS), error


def reconstructed(core: np.ndarray, factors: list[np.ndarray], skip: int | None = None, most: int = 50_000_000) -> np.ndarray:
    """All cells of a small decomposition (without the skipped factor); more than ``most`` are refused."""
    shape = [r if m == skip else len(f) for m, (f, r) in enumerate(zip(factors, core.shape))]
    if np.prod(np.array(shape, float)) > most:
        raise ValueError(f"{tuple(shape)} has more than {most} cells")
    return core_with(core, {m: f for m, f in enumerate(factors) if m != skip})


def initial(shape: tuple[int, ...], rank: tuple[int, ...], seed: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Uniform numbers: the core first, then the factors."""
    r = np.random.RandomState(seed)
    core = np.maximum(r.random_sample(rank) + 0.01, 1e-30)
    return core, [np.maximum(r.random_sample((s, k)), 1e-30) for s, k in zip(shape, rank)]


def normalised(core: np.ndarray, factors: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Columns of length one; their lengths go to the core."""
    out = []
    for m, f in enumerate(factors):
        scale = np.linalg.norm(f, axis=0)
        scale = np.where(scale == 0, 1.0, scale)
        out.append(f / scale)
        core = np.moveaxis(np.moveaxis(core, m, -1) * scale, -1, m)
    return core, out


def log_step(iteration: int, log_every: int, check_every: int) -> bool:
    return any(k > 0 and (iteration + 1) % k == 0 for k in (log_every, check_every))


@dataclass
class Training:
    """Settings of a run."""

    rank: tuple[int, ...]
    divergence: str = "kl"
    iterations: int = 100
    tol: float = 1e-5
    patience: int = 5
    warmup: int = 0
    log_every: int = 1
    check_every: int = 1
    semantic_every: int = 0
    semantic_key: str = "average_rank_score"
    shared: tuple[tuple[int, int], ...] = ()
    transitive: bool = True
    share: float = 1.0
    share_warmup: int = 0
    normalise: bool = False
    seed: int = 42
    checkpoint_every: int = 0


@dataclass
class Result:
    core: np.ndarray
    factors: list[np.ndarray]
    errors: list[tuple[int, float]] = field(default_factory=list)
    fitness: list[tuple[int, dict]] = field(default_factory=list)
    iterations: int = 0
    stopped: str = "iterations"


def partners(n: int, shared: tuple[tuple[int, int], ...], transitive: bool) -> dict[int, list[int]]:
    """Which modes take over a mode's factor: its whole group, or only the modes linked to it directly."""
    if transitive:
        return {m: [x for x in g if x != m] for g in groups(n, list(shared)) for m in g if len(g) > 1}
    out: dict[int, list[int]] = {}
    for a, b in shared:
        out.setdefault(a, []).append(b)
        out.setdefault(b, []).append(a)
    return out


def train(cells: Cells, t: Training, start: Result | None = None, evaluate: Callable[[np.ndarray, list[np.ndarray]], dict] | None = None, checkpoint: Callable[[int, Result], None] | None = None, new_best: Callable[[Result], None] | None = None) -> Result:
    """Sweeps factors in order (each sees the ones before it updated), then the core, until a rule stops it.

    Reconstruction: ``patience`` checks after the warm-up with a change below ``tol``. Semantics: as many
    evaluations that don't pass the best value by ``tol``; then the best model is returned, not the last.
    Errors are those of the whole tensor, also where updates use a share of it.
    """
    if t.divergence not in ("kl", "fr"):
        raise ValueError("divergence must be kl or fr")
    if len(t.rank) != cells.n:
        raise ValueError(f"{len(t.rank)} ranks for {cells.n} modes")
    rank = tuple(min(r, s) for r, s in zip(t.rank, cells.shape))
    core, factors = (start.core, list(start.factors)) if start else initial(cells.shape, rank, t.seed)
    out = Result(core, factors, list(start.errors) if start else [], list(start.fitness) if start else [])
    first = start.iterations if start else 0
    links = partners(cells.n, t.shared, t.transitive)
    best_value, best = max((f[t.semantic_key] for _, f in out.fitness), default=0.0), None
    idle = semantic_idle = 0
    last = out.errors[-1][1] if out.errors else None
    for i in range(first, t.iterations):
        now = cells.part(t.share, t.seed, i) if t.share < 1 and i >= t.share_warmup else cells
        for m in range(cells.n):
            factors[m] = update_factor(now, core, factors, m, t.divergence)
            for other in links.get(m, []):
                factors[other] = factors[m]
        core = update_core(now, core, factors, t.divergence)
        error = relative_error(cells, core, factors, t.divergence) if log_step(i, t.log_every, t.check_every) else None
        if t.normalise:
            core, factors = normalised(core, factors)
        out.core, out.factors, out.iterations = core, list(factors), i + 1
        if error is not None:
            out.errors.append((i, error))
        if t.check_every > 0 and (i + 1) % t.check_every == 0:
            if last is not None and i >= t.warmup:
                idle = idle + 1 if abs(last - error) < t.tol else 0
            last = error
            if idle >= t.patience:
                out.stopped = "reconstruction"
                break
        if evaluate and t.semantic_every > 0 and (i + 1) % t.semantic_every == 0:
            found = evaluate(core, factors)
            if t.semantic_key not in found:
                raise KeyError(f"the evaluation gives no {t.semantic_key}")
            out.fitness.append((i, found))
            gain = found[t.semantic_key] - best_value
            if gain > 0:
                best_value, best = found[t.semantic_key], (core, list(factors), i + 1)
                if new_best:
                    new_best(out)
            semantic_idle = semantic_idle + 1 if gain < t.tol else 0
            if semantic_idle >= t.patience:
                out.stopped = "semantics"
                break
        if checkpoint and t.checkpoint_every and (i + 1) % t.checkpoint_every == 0:
            checkpoint(i + 1, out)
    if best:
        out.core, out.factors, out.iterations = best
    return out
