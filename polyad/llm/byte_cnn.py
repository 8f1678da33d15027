"""Quality classifier: a convolutional network over bytes, in numpy.

Each byte has a learned vector; learned filters of eight bytes stand at every fourth byte. A chunk is 512
bytes and shares 64 with the next; chunks cover the whole document. A filter's strongest response in a
chunk is the chunk's feature. The mean and the maximum over the chunks go through a small layer to one
probability. Windows and chunks are worked on in stretches, so a text of any length takes a few times its
own size.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import tune
from .textvec import Texts, slices

WIDTH, STEP, CELL, CHUNK_CELLS, CHUNK_STEP = 8, 4, 64, 8, 7
FILTERS, DIM, HIDDEN = 48, 8, 16
PER_CELL = CELL // STEP

#: Cells worked on at a time.
STRETCH = 2048

#: Labelled documents to learn from, at most, each with its whole text.
MOST_ROWS = 4_000

Model = dict[str, np.ndarray]


def fresh(seed: int = 2) -> Model:
    r = np.random.default_rng(seed)
    normal = lambda scale, *shape: r.normal(0, scale, shape).astype(np.float32)
    return {
        "bytes": normal(0.5, 256, DIM),
        "filters": normal((2 / (WIDTH * DIM)) ** 0.5, WIDTH * DIM, FILTERS),
        "shift": np.zeros(FILTERS, np.float32),
        "hidden": normal((2 / (2 * FILTERS)) ** 0.5, 2 * FILTERS, HIDDEN),
        "hidden_shift": np.zeros(HIDDEN, np.float32),
        "last": normal((1 / HIDDEN) ** 0.5, HIDDEN),
        "last_shift": np.zeros(1, np.float32),
    }


class Layout:
    """Texts as zero-padded runs of cells, and the chunks over them."""

    def __init__(self, t: Texts) -> None:
        size = np.diff(t.off)
        cells = (size + WIDTH + CELL - 1) // CELL
        first = np.cumsum(cells) - cells
        self.total = int(cells.sum())
        self.buffer = np.zeros(self.total * CELL + WIDTH, np.uint8)
        self.buffer[np.arange(len(t.data)) + np.repeat(first * CELL - t.off[:-1], size)] = t.data
        # where each cell's text ends, in bytes of the buffer: windows that start there or later look at nothing
        self.end = np.repeat(first * CELL + size, cells)
        chunks = np.maximum(1, -(-(cells - 1) // CHUNK_STEP))
        self.of = np.repeat(np.arange(t.n), chunks)
        self.begin = np.cumsum(chunks) - chunks
        number = np.arange(len(self.of)) - np.repeat(self.begin, chunks)
        start = np.repeat(first, chunks) + number * CHUNK_STEP
        last = np.repeat(first + cells - 1, chunks)
        self.cells = np.minimum(start[:, None] + np.arange(CHUNK_CELLS), last[:, None])
        self.chunks = chunks


def _windows(m: Model, x: Layout, start: np.ndarray) -> np.ndarray:
    """The vectors of the WIDTH bytes from each start on."""
    return m["bytes"][x.buffer[start[:, None] + np.arange(WIDTH)]].reshape(len(start), WIDTH * DIM)


def forward(m: Model, x: Layout, keep: bool = False) -> tuple[np.ndarray, dict]:
    """The logit of each text; what the backward pass needs."""
    cell = np.empty((x.total, FILTERS), np.float32)
    best = np.empty((x.total, FILTERS), np.uint8) if keep else None
    for a in range(0, x.total, STRETCH):
        b = min(a + STRETCH, x.total)
        start = np.arange(a * PER_CELL, b * PER_CELL) * STEP
        out = _windows(m, x, start) @ m["filters"]
        out += m["shift"]
        np.maximum(out, 0, out=out)
        out[start >= np.repeat(x.end[a:b], PER_CELL)] = 0
        out = out.reshape(b - a, PER_CELL, FILTERS)
        cell[a:b] = out.max(1)
        if keep:
            best[a:b] = out.argmax(1)
    chunk = np.empty((len(x.of), FILTERS), np.float32)
    position = np.empty(chunk.shape, np.int64) if keep else None
    for a in range(0, len(x.of), STRETCH):
        cells = x.cells[a : a + STRETCH]
        near = cell[cells]
        chunk[a : a + STRETCH] = near.max(1)
        if keep:
            which = np.take_along_axis(cells, near.argmax(1), 1)
            position[a : a + STRETCH] = which * PER_CELL + best[which, np.arange(FILTERS)]
    mean = np.add.reduceat(chunk, x.begin) / x.chunks[:, None].astype(np.float32)
    top = np.maximum.reduceat(chunk, x.begin)
    doc = np.concatenate((mean, top), 1)
    hidden = np.maximum(doc @ m["hidden"] + m["hidden_shift"], 0)
    logit = hidden @ m["last"] + m["last_shift"][0]
    return logit, {"chunk": chunk, "top": top, "doc": doc, "hidden": hidden, "position": position} if keep else {}


def backward(m: Model, x: Layout, kept: dict, slope: np.ndarray) -> Model:
    """Gradients for the given slope of the loss at each logit."""
    g: Model = {}
    g["last"], g["last_shift"] = kept["hidden"].T @ slope, slope.sum(keepdims=True)
    up = slope[:, None] * m["last"] * (kept["hidden"] > 0)
    g["hidden"], g["hidden_shift"] = kept["doc"].T @ up, up.sum(0)
    doc = up @ m["hidden"].T
    chunk = (doc[:, :FILTERS] / x.chunks[:, None])[x.of]
    tied = (kept["chunk"] == kept["top"][x.of]).astype(np.float32)
    chunk = chunk + doc[x.of, FILTERS:] * tied / np.add.reduceat(tied, x.begin)[x.of]
    chunk *= kept["chunk"] > 0
    g["filters"], g["bytes"] = np.zeros_like(m["filters"]), np.zeros_like(m["bytes"])
    for a in range(0, len(chunk), STRETCH // 8):
        part, start = chunk[a : a + STRETCH // 8], kept["position"][a : a + STRETCH // 8] * STEP
        window = _windows(m, x, start.ravel()).reshape(*start.shape, WIDTH * DIM)
        g["filters"] += np.einsum("cf,cfk->kf", part, window)
        back = (part[:, :, None] * m["filters"].T).reshape(*part.shape, WIDTH, DIM)
        codes = x.buffer[start[:, :, None] + np.arange(WIDTH)].ravel()
        g["bytes"] += np.stack([np.bincount(codes, back[..., d].ravel(), 256) for d in range(DIM)], 1).astype(np.float32)
    g["shift"] = chunk.sum(0)
    return g


def train(texts: list[bytes], good: np.ndarray, epochs: int = 6, batch: int = 32, rate: float = 4e-3, seed: int = 3) -> Model:
    """A model fitted by Adam on the cross entropy to the labels of (compressed) texts."""
    m, r = fresh(), np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in m.items()}
    second = {k: np.zeros_like(v) for k, v in m.items()}
    step, steps = 0, epochs * -(-len(texts) // batch)
    for _ in range(epochs):
        order = r.permutation(len(texts))
        for k in range(0, len(order), batch):
            rows = order[k : k + batch]
            x = Layout(Texts(pa.array([zlib.decompress(texts[i]) for i in rows], pa.binary()).cast(pa.string())))
            logit, kept = forward(m, x, keep=True)
            slope = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - good[rows]) / len(rows)).astype(np.float32)
            step += 1
            now = rate * (1 - step / (steps + 1))
            for name, g in backward(m, x, kept, slope).items():
                first[name] += 0.1 * (g - first[name])
                second[name] += 0.001 * (g * g - second[name])
                m[name] -= (now * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return m


def score_rows(m: Model | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Replaces the last column, a text, by its score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *names, text = batch.schema.names
            for part in slices(batch, text, 1 << 18):
                if m is None:
                    score = np.full(part.num_rows, 0.5)
                else:
                    logit, _ = forward(m, Layout(Texts(part.column(text))))
                    score = 1 / (1 + np.exp(-np.clip(logit.astype(np.float64), -500, 500)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(score)], names=[*names, "score"])

    return run


def held_out(doc_id: Column) -> Column:
    """The fold that nothing is learned from; rows without id aren't in it."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> Model | None:
    """A model of at most ``most_rows`` labelled documents outside the held-out fold; None without any.

    Of several texts of one id the smallest counts, so that no id comes to the driver more than once.
    """
    marked = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").filter(~held_out(F.col("doc_id")))
    marked = marked.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min("quality").alias("_q"))
    sample = F.broadcast(marked.orderBy(F.xxhash64("_id"), "_id").limit(most_rows))  # at most 4,000 rows of 12 bytes
    texts = docs.select(F.col("doc_id").cast("long").alias("_d"), F.coalesce("text", F.lit("")).alias("_t"))
    found = texts.join(sample, F.col("_d") == F.col("_id")).groupBy("_d", "_q").agg(F.min("_t").alias("_t"))
    # one partition at a time comes to the driver, where texts stay compressed
    rows = sorted((r["_d"], r["_q"], zlib.compress(r["_t"].encode())) for r in found.toLocalIterator())
    if not rows:
        return None
    return train([t for *_, t in rows], np.array([q for _, q, _ in rows], np.float32))


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row.

    The score depends on the text's bytes alone; a null text counts as empty. Repeated rows and rows without
    doc_id are scored like any other. Of several labels of one id the smallest counts. Without labels every
    score is 0.5. An empty table gives no row. Other columns are not read.
    """
    tune(spark)
    m = fit(docs, labels)
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(score_rows(m), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
