"""Embedding near-duplicates by an epsilon grid order join.

On unit vectors a cosine of at least t is a distance of at most eps = sqrt(2 - 2t). Vectors are projected
on the leading principal axes (which never lengthens a distance), ordered by the grid cells of side eps
they fall in, and cut into sequences of that order. The vectors of one cell of a sequence are a leaf
(where they lie apart, several), with a centre and a radius over all components. Two sequences meet only if two of their leaves may lie within eps, which is found from the leaves alone in single precision; so
the vectors of a sequence travel only where it has partners, and once for each group of sequences that it has
them in. Sequences that meet are joined by halving both and skipping distant halves, down to pieces whose
near leaves are compared as a matrix product. A task reports how many vectors each vector links with and
what falls together, never the pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import Forest, components, grouped
from .runtime import Scratch, tune

THRESHOLD = 0.93
#: Principal axes of the grid, four bits of a cell's number each; vectors of a sequence; leaves compared as
#: one matrix product, and held at a time against those of another sequence.
AXES, SEQUENCE, PIECE, MEET = 16, 512, 64, 4096
#: Neighbouring sequences that are shipped together.
GROUP = 64
SALTS = 8
#: What rounding may take from a distance between centres in single precision.
SLACK = 1e-4


def unit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, dim, unit) of usable vectors; unit: doubles of length one, in bytes."""
    for batch in batches:
        ids, labels, units, dims = [], [], [], []
        for i, label, e in zip(batch.column("vec_id").to_pylist(), batch.column("label").to_pylist(), batch.column("embedding")):
            if i is None or label is None or not e.is_valid or e.values.null_count or not len(e.values):
                continue
            v = e.values.to_numpy(zero_copy_only=False).astype(np.float64)
            top = np.abs(v).max()
            if not np.isfinite(v).all() or top == 0:
                continue
            v = v / top
            v = v / np.sqrt(v @ v) + 0.0
            ids.append(i)
            labels.append(label)
            dims.append(len(v))
            units.append(v.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.int64()), pa.array(dims, pa.int32()), pa.array(units, pa.binary())], names=["vec_id", "label", "dim", "unit"])


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def moment_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(dim, i, j, value): sums of products of components, and with j = -1 of components, i = -1 the count."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for d in np.unique(dims).tolist():
            x = _matrix(batch.column("unit").filter(pa.array(dims == d)), d)
            x = np.concatenate((np.ones((len(x), 1)), x), 1)
            total[d] = total.get(d, 0) + x.T @ x
    for d, m in total.items():
        i, j = np.indices(m.shape)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(m.size, d, np.int32)), pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(m.ravel())], names=["dim", "i", "j", "value"])


def principal_axes(units: DataFrame) -> dict[int, np.ndarray]:
    """For each length of vector its leading principal axes, from all vectors; dim * dim sums reach the driver."""
    sums = units.select("dim", "unit").mapInArrow(moment_rows, "dim int, i int, j int, value double").groupBy("dim", "i", "j").agg(F.sum("value").alias("value"))
    table = sums.toPandas()
    out = {}
    for d, rows in table.groupby("dim"):
        m = np.zeros((d + 1, d + 1))
        m[rows["i"], rows["j"]] = rows["value"]
        mean = m[0, 1:] / m[0, 0]
        _, vectors = np.linalg.eigh(m[1:, 1:] / m[0, 0] - np.outer(mean, mean))
        out[int(d)] = np.ascontiguousarray(vectors[:, ::-1][:, :AXES])
    return out


def cells_of(x: np.ndarray, axes: np.ndarray, eps: float) -> np.ndarray:
    """The grid cell of each row, the leading axis in the highest bits. Cells beyond the eighth from the origin
    are numbered as that one, which only makes it larger."""
    at = np.clip(np.floor(x @ axes / eps), -8, 7).astype(np.int64) + 8
    out = np.zeros(len(x), np.int64)
    for k in range(at.shape[1]):
        out = (out << 4) | at[:, k]
    return out


def cell_rows(axes: dict[int, np.ndarray], eps: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds the grid cell to (label, dim, unit, id, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            cells = np.zeros(batch.num_rows, np.int64)
            for d in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == d)
                cells[rows] = cells_of(_matrix(batch.column("unit").take(pa.array(rows)), d), axes[d], eps)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells)], names=[*batch.schema.names, "cell"])

    return run


@dataclass
class Leaves:
    """Consecutive rows of a sequence: leaf i holds rows limits[i] to limits[i + 1], within radius of its centre."""

    limits: np.ndarray
    centres: np.ndarray
    radii: np.ndarray


def leaf_order(x: np.ndarray, axes: np.ndarray, eps: float) -> tuple[np.ndarray, Leaves]:
    """The rows in the order of their cells, and the leaves: rows of one cell, parted where they are wide.

    A wide cell's rows within eps / 2 of its first row are a leaf, and so on with the rest.
    """
    cells = cells_of(x, axes, eps)
    order = np.argsort(cells, kind="stable")
    x, cells = x[order], cells[order]
    begin = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1])))
    limits = np.concatenate((begin, [len(x)])).tolist()
    leaf, count = np.zeros(len(x), np.int64), 0
    for a, b in zip(limits[:-1], limits[1:]):
        rest = np.arange(a, b)
        while len(rest):
            y = x[rest]
            close = np.zeros(1, bool) if len(rest) == 1 else ((y - y[0]) ** 2).sum(1) <= eps * eps / 4
            close[0] = True
            leaf[rest[close]] = count
            rest, count = rest[~close], count + 1
    again = np.argsort(leaf, kind="stable")
    order, x, counts = order[again], x[again], np.bincount(leaf)
    begin = np.cumsum(counts) - counts
    centres = (np.add.reduceat(x, begin) / counts[:, None]).astype(np.float32)
    away = np.sqrt(((x - np.repeat(centres, counts, 0)) ** 2).sum(1))
    return order, Leaves(np.concatenate((begin, [len(x)])), centres, np.maximum.reduceat(away, begin).astype(np.float32))


def near(a: np.ndarray, ra: np.ndarray, b: np.ndarray, rb: np.ndarray, eps: float) -> np.ndarray:
    """Which balls (centres, radii) may hold points within eps of each other."""
    square = (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)
    reach = ra[:, None] + rb + np.float32(eps + SLACK)
    return square <= reach * reach + np.float32(SLACK)


def sequence_rows(axes: dict[int, np.ndarray], eps: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Runs of SEQUENCE vectors of one label and length in grid order, each as one row with its box and leaves.

    grp numbers GROUP neighbouring sequences of one label and length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key: tuple[int, int] | None = None
        count = done = 0
        task = TaskContext.get().partitionId() << 32

        def row() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            x = np.frombuffer(b"".join(t.column("unit").to_pylist()), np.float64).reshape(t.num_rows, key[1])
            at = np.pad(x @ axes[key[1]], ((0, 0), (0, AXES - axes[key[1]].shape[1])))
            order, leaves = leaf_order(x, axes[key[1]], eps)
            ids, n = (t.column(c).to_numpy().astype(np.int64)[order].tobytes() for c in ("id", "n"))
            values = [int(t.column("id")[0].as_py()), key[0], key[1], task + group, at.min(0).tolist(), at.max(0).tolist(), ids, n, x[order].tobytes(), leaves.limits.astype(np.int32).tobytes(), leaves.centres.tobytes(), leaves.radii.tobytes()]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), *[pa.binary()] * 6]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=["seq", "label", "dim", "grp", "lo", "hi", "ids", "n", "units", "limits", "centres", "radii"])

        group = 0
        for batch in batches:
            labels, dims = batch.column("label").to_numpy(), batch.column("dim").to_numpy()
            at = 0
            while at < batch.num_rows:
                now = (int(labels[at]), int(dims[at]))
                if held and (now != key or count == SEQUENCE):
                    yield row()
                    held, count, done = [], 0, done + 1
                    if now != key or done == GROUP:
                        group, done = group + 1, 0
                key = now
                other = np.flatnonzero((labels[at:] != now[0]) | (dims[at:] != now[1]))
                to = min(at + SEQUENCE - count, at + int(other[0]) if len(other) else batch.num_rows)
                held.append(batch.slice(at, to - at))
                count += to - at
                at = to
        if held:
            yield row()

    return run


SEQUENCES = "seq long, label long, dim int, grp long, lo array<double>, hi array<double>, ids binary, n binary, units binary, limits binary, centres binary, radii binary"


def _leaves(group: pa.Table, i: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(group.column("centres")[i].as_py(), np.float32).reshape(-1, group.column("dim")[i].as_py()), np.frombuffer(group.column("radii")[i].as_py(), np.float32)


def meet_rows(eps: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(g, h, seq, seq2) of sequences of groups g and h that have leaves within eps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, ["g", "h"]):
            g, h = group.column("g")[0].as_py(), group.column("h")[0].as_py()
            side, seq = group.column("grp").to_numpy(), group.column("seq").to_numpy()
            left, right = np.flatnonzero(side == g), np.flatnonzero(side == h)
            leaves = {i: _leaves(group, i) for i in {*left.tolist(), *right.tolist()}}
            sizes = np.array([len(leaves[i][1]) for i in right.tolist()])
            stacks = np.split(right, np.flatnonzero(np.diff(np.cumsum(sizes) // MEET)) + 1)
            a, b = [], []
            for some in stacks:
                centres, radii = (np.concatenate([leaves[i][k] for i in some.tolist()]) for k in (0, 1))
                begin = np.cumsum([0, *(len(leaves[i][1]) for i in some.tolist())])[:-1]
                for i in left.tolist():
                    met = np.logical_or.reduceat(near(*leaves[i], centres, radii, eps).any(0), begin)
                    found = [s for s in seq[some[met]].tolist() if g != h or s >= seq[i]]
                    a += [int(seq[i])] * len(found)
                    b += found
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ([g] * len(a), [h] * len(a), a, b)], names=["g", "h", "seq", "seq2"])

    return run


def join_pair(x: np.ndarray, y: np.ndarray, lx: Leaves, ly: Leaves, nx: np.ndarray, ny: np.ndarray, same: bool, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray, Forest]:
    """Links of two sequences: how many vectors each row of x and of y links with (weights n), and what
    falls together (rows of x, then rows of y). same: y is x, whose rows don't meet themselves."""
    cx, cy = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
    forest, base = Forest(len(x) + (0 if same else len(y))), 0 if same else len(x)
    met = near(lx.centres, lx.radii, ly.centres, ly.radii, eps_of(threshold))
    x32 = x.astype(np.float32)
    y32 = x32 if same else y.astype(np.float32)

    def rows_of(leaves: Leaves, some: np.ndarray) -> np.ndarray:
        return np.concatenate([np.arange(leaves.limits[i], leaves.limits[i + 1]) for i in some.tolist()])

    def compare(a: int, b: int, c: int, d: int) -> None:
        part, inner = met[a:b, c:d], same and a == c
        left, right = rows_of(lx, a + np.flatnonzero(part.any(1))), rows_of(ly, c + np.flatnonzero(part.any(0)))
        # single precision tells what is surely no link
        if not (x32[left] @ y32[right].T >= threshold - 1e-5).any():
            return
        hit = x[left] @ y[right].T >= threshold
        if inner:
            hit &= left[:, None] != right
        if not hit.any():
            return
        cx[left] += hit @ ny[right]
        if not inner:
            cy[right] += nx[left] @ hit
        rows, columns = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
        hit, left, right = hit[np.ix_(rows, columns)], left[rows], right[columns]
        far = len(left) + len(right)
        low, high = np.arange(len(left)), np.full(len(right), far)
        while True:  # smallest row reachable
            new_high = np.minimum(high, np.where(hit, low[:, None], far).min(0))
            new_low = np.minimum(low, np.where(hit, new_high, far).min(1))
            if (new_low == low).all() and (new_high == high).all():
                break
            low, high = new_low, new_high
        for i, r in zip(left.tolist(), left[low].tolist()):
            forest.join(i, r)
        for i, r in zip((right + base).tolist(), left[high].tolist()):
            forest.join(i, r)

    def walk(a: int, b: int, c: int, d: int) -> None:
        if (same and a > c) or not met[a:b, c:d].any():
            return
        if b - a <= PIECE and d - c <= PIECE:
            compare(a, b, c, d)
            return
        halves = lambda p, q: [(p, q)] if q - p <= PIECE else [(p, p + (q - p) // 2), (p + (q - p) // 2, q)]
        for p, q in halves(a, b):
            for r, s in halves(c, d):
                walk(p, q, r, s)

    if len(x) and len(y):
        walk(0, len(lx.radii), 0, len(ly.radii))
    if same:
        cx = cx + cy
        cy = cy[:0]
    return cx, cy, forest


def link_rows(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(a, b, n): with b null, vector a links with n more vectors; else a and b fall together.

    A group of rows holds the sequences of two groups; ``partners`` says which of them a sequence is joined with.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, ["g", "h"]):
            number = {s: i for i, s in enumerate(group.column("seq").to_pylist())}

            def parts(i: int) -> tuple[np.ndarray, Leaves, np.ndarray, np.ndarray]:
                g = lambda c, kind: np.frombuffer(group.column(c)[i].as_py(), kind)  # noqa: B023, E731
                return g("units", np.float64).reshape(-1, group.column("dim")[i].as_py()), Leaves(g("limits", np.int32), *_leaves(group, i)), g("n", np.int64), g("ids", np.int64)  # noqa: B023

            for s, i in number.items():
                x = None
                for other in group.column("partners")[i].as_py():
                    x = x or parts(i)
                    y = x if other == s else parts(number[other])
                    cx, cy, forest = join_pair(x[0], y[0], x[1], y[1], x[2], y[2], other == s, threshold)
                    every = x[3] if other == s else np.concatenate((x[3], y[3]))
                    count = cx if other == s else np.concatenate((cx, cy))
                    some = np.flatnonzero(count)
                    if not len(some):
                        continue
                    root = np.array([forest.find(j) for j in some.tolist()], np.int64)
                    joined = some != root
                    a = np.concatenate((every[some], every[some[joined]]))
                    b = pa.array(np.concatenate((np.zeros(len(some), np.int64), every[root[joined]])), mask=np.arange(len(a)) < len(some))
                    n = np.concatenate((count[some], np.zeros(int(joined.sum()), np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array(a), b, pa.array(n)], names=["a", "b", "n"])

    return run


def eps_of(threshold: float) -> float:
    return float(np.sqrt((2 - 2 * threshold) * (1 + 1e-9) + 1e-12))


def near_duplicates(spark: SparkSession, vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    Linked are vectors of equal label and equal length whose cosine, in double precision, is at least the
    threshold. Null, empty and zero vectors, those with null or non-finite components, and rows without label
    or vec_id link with nothing; a row without vec_id has no component and is kept. Repeated rows count as
    vectors of their own in n_links. An empty table gives no row. Other columns are not read.
    """
    tune(spark)
    scratch = Scratch(spark)
    eps = eps_of(threshold)
    source = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    units = scratch.save(source.mapInArrow(unit_rows, "vec_id long, label long, dim int, unit binary").withColumn("digest", F.md5("unit")), "ego-units")
    key = ["label", "dim", "digest"]
    classes = units.groupBy(*key).agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n"))
    classes = scratch.save(classes, "ego-classes")
    # one vector of each class, with its weight
    member = units.join(classes.select(F.col("id").alias("vec_id"), *key, "n"), ["vec_id", *key]).dropDuplicates(["vec_id", *key])
    member = member.select("label", "dim", "unit", F.col("vec_id").alias("id"), "n")
    member = scratch.save(member, "ego-distinct")
    axes = principal_axes(member)
    order = ["label", "dim", "cell", "id"]
    ordered = member.mapInArrow(cell_rows(axes, eps), "label long, dim int, unit binary, id long, n long, cell long")
    runs = ordered.repartitionByRange(*order).sortWithinPartitions(*order)
    sequences = scratch.save(runs.mapInArrow(sequence_rows(axes, eps), SEQUENCES), "ego-sequences")

    # groups of sequences whose boxes lie within eps, found through stripes of the first axis
    edge = lambda f, c: F.array(*[f(F.col(c)[k]) for k in range(AXES)]).alias(c)
    box = sequences.groupBy("label", "dim", "grp").agg(edge(F.min, "lo"), edge(F.max, "hi"))
    stripe = lambda c: F.floor(F.element_at(c, 1) / eps)
    left = box.withColumnRenamed("grp", "g").withColumn("s", F.explode(F.sequence(stripe("lo"), stripe("hi"))))
    right = box.select(F.col("grp").alias("h"), "label", "dim", F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    right = right.withColumn("s", F.explode(F.sequence(stripe("lo2") - 1, stripe("hi2") + 1)))
    gap = F.zip_with(F.zip_with("lo2", "hi", lambda a, b: a - b), F.zip_with("lo", "hi2", lambda a, b: a - b), lambda a, b: F.greatest(a, b, F.lit(0.0)))
    far = F.aggregate(gap, F.lit(0.0), lambda total, g: total + g * g)
    pairs = left.join(right, ["label", "dim", "s"]).filter((F.col("g") <= F.col("h")) & (far <= eps * eps * (1 + 1e-9))).select("g", "h").distinct()
    # of these, sequences that have leaves within eps: only leaves are shipped
    sides = pairs.select("g", "h", F.explode(F.array_distinct(F.array("g", "h"))).alias("grp"))
    leaves = sides.join(sequences.select("grp", "seq", "dim", "centres", "radii"), "grp").repartition("g", "h").sortWithinPartitions("g", "h")
    met = scratch.save(leaves.select("g", "h", "grp", "seq", "dim", "centres", "radii").mapInArrow(meet_rows(eps), "g long, h long, seq long, seq2 long"), "ego-met")
    # and of these the vectors, once for each two groups
    none = F.array().cast("array<long>")
    asked = met.groupBy("g", "h", "seq").agg(F.collect_list("seq2").alias("p")).union(met.select("g", "h", "seq2", none.alias("p")).distinct())
    asked = asked.groupBy("g", "h", "seq").agg(F.flatten(F.collect_list("p")).alias("partners"))  # GROUP at most
    heavy = asked.join(sequences.select("seq", "dim", "ids", "n", "units", "limits", "centres", "radii"), "seq").repartition("g", "h").sortWithinPartitions("g", "h")
    found = scratch.save(heavy.mapInArrow(link_rows(threshold), "a long, b long, n long"), "ego-links")

    salted = classes.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    light = units.select("vec_id", *key, F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int").alias("salt"))
    placed = scratch.save(light.join(salted, [*key, "salt"]).select("vec_id", "id", "n"), "ego-members")
    edges = found.filter("b IS NOT NULL").select("a", "b").union(placed.filter("vec_id <> id").select(F.col("vec_id").alias("a"), F.col("id").alias("b")))
    component = scratch.save(components(edges, scratch, "ego-components"), "ego-component").withColumnRenamed("node", "vec_id")
    links = found.filter("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("more"))
    # the links of a row: its copies, and the vectors its class links with
    counted = placed.join(links, "id", "left").select("vec_id", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"))
    usable = counted.groupBy("vec_id").agg(F.max("n_links").alias("n_links"))
    bad = F.array_contains(F.transform("embedding", lambda v: F.coalesce(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(True))), True)
    zero = F.coalesce(F.size(F.filter("embedding", lambda v: v != 0)) <= 0, F.lit(True))
    out = source.withColumn("alone", F.col("label").isNull() | F.col("embedding").isNull() | F.coalesce(bad, F.lit(True)) | zero)
    out = out.select("vec_id", "alone").join(usable, "vec_id", "left").join(component, "vec_id", "left")
    smallest = F.when(F.col("alone"), F.col("vec_id")).otherwise(F.coalesce("component", "vec_id"))
    out = out.select("vec_id", F.when(F.col("alone"), F.lit(0)).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"), smallest.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True)))


ORACLE_SQL = """
WITH RECURSIVE usable AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS MATERIALIZED (
  SELECT a.vec_id AS x, b.vec_id AS y FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id
  AND list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e)) >= 0.93),
reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x),
least AS (SELECT x AS vec_id, min(y) AS component_id FROM reach GROUP BY x),
degree AS (SELECT x AS vec_id, count(*) AS n FROM link GROUP BY x)
SELECT e.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN least c USING (vec_id) LEFT JOIN degree d USING (vec_id)
"""
