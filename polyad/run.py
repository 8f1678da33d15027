"""The stages of a run from the command line: python -m polyad.run STAGE --flags.

vectors: texts to n-gram tables. population: role tuples to association tensors. decomposition: a tensor to a
model, evaluated, checkpointed and resumed. Each stage leaves its settings, its result and a line of the run
log with UTC time and elapsed seconds; what is there already isn't made again unless asked for.
"""

from __future__ import annotations

import logging
import sys
import time
from collections.abc import Sequence
from dataclasses import asdict, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Decomposition, Ingest, Population, ngram_orders, parsed, resolve_dataset
from .operators import evaluate
from .operators.assoc import Populated, populate
from .operators.model import Tucker, vocabulary_lists
from .operators.tucker import Cells, Result, Training, train
from .operators.vocab import groups, in_vocabulary, normalised
from .ship import ship
from .sources import store
from .streaming.ingest import progress, start_ingest, text_stream

log = logging.getLogger("polyad")


def _rows(spark: SparkSession, name: str) -> DataFrame:
    path, _ = resolve_dataset(name)
    return spark.read.parquet(path)


def vectors(spark: SparkSession, c: Ingest) -> str:
    """Texts of a folder to one table for each n-gram order; a second call takes up new files only."""
    began = time.time()
    path, _ = resolve_dataset(c.dataset)
    folder = c.folder().rpartition("/")[0]
    texts = text_stream(spark, path, spark.read.parquet(path).schema)
    query = start_ingest(texts, ngram_orders(c.type), folder, f"{folder}/_checkpoint", text=c.text_column, longest=c.longest_text, rows_per_file=c.rows_per_file, target_rows=c.target_rows)
    query.awaitTermination()
    counts = {n: spark.read.parquet(f"{folder}/{n}-gram").count() for n in ngram_orders(c.type) if store.exists(spark, f"{folder}/{n}-gram")}
    store.write_json(spark, f"{folder}/meta.json", {"rows": counts, "batches": progress(query), "config": asdict(c)})
    store.log_run(spark, f"{folder}/runs", stage="vectors", run=c.run_id(), rows=counts, seconds=round(time.time() - began, 1))
    return folder


def population(spark: SparkSession, c: Population) -> Populated:
    """Role tuples to tensors of all methods and vocabulary sizes; sizes that are stored already are kept."""
    began = time.time()
    folder = f"{c.data_dir}/tensors"
    if store.exists(spark, f"{folder}/about.json"):
        found = store.read_populated(spark, folder)
        if set(c.top_ks) <= set(found.top_ks) and found.roles == list(c.roles):
            return found
    p = populate(_rows(spark, c.dataset), list(c.roles), c.top_ks, list(c.shared))
    store.write_populated(p, folder, overwrite=True)
    p.release()
    store.write_json(spark, f"{folder}/config.json", asdict(c))
    store.log_run(spark, f"{c.data_dir}/runs", stage="population", run=c.run_id(), total=p.total, seconds=round(time.time() - began, 1))
    return store.read_populated(spark, folder)


def _evaluation(spark: SparkSession, c: Decomposition, p: Populated, words: list[list[str]]):
    """A function that scores a core and factors on sampled tuples; None without tuples."""
    if not c.evaluation_path:
        return None
    rows = normalised(_rows(spark, c.evaluation_path), p.roles)
    if c.known_only:
        rows = in_vocabulary(rows, p.vocab.filter(F.col("idx") < c.dim), p.roles, c.dim).filter("known").select(*p.roles)
    sample = evaluate.sample(rows, p.roles, c.evaluation_rows, c.seed).persist()
    return lambda core, factors: evaluate.evaluate(Tucker(core, factors, words, p.roles), sample, c.temperature)


def decomposition(spark: SparkSession, c: Decomposition) -> Tucker:
    """Trains on a stored tensor, from the furthest fitting checkpoint with --resume."""
    began, paths = time.time(), c.paths()
    if not c.overwrite and not store.missing(spark, {"model": f"{paths['model']}/state.json"}):
        return store.read_model(spark, paths["model"])
    p = store.read_populated(spark, f"{c.data_dir}/tensors")
    words = vocabulary_lists(p.vocab.filter(F.col("idx") < c.dim), p.roles)
    if len(c.rank) != len(p.roles):
        c = replace(c, rank=c.rank[:1] * len(p.roles))
    cells = Cells(store.read_tensor(spark, f"{c.data_dir}/tensors", c.method, c.dim), tuple(map(len, words)))
    start = None
    if c.resume and (found := store.latest_checkpoint(spark, paths["checkpoints"], c.structure())):
        start = found[0]
        log.info("resumed after %d iterations", start.iterations)
    training = Training(c.rank, c.divergence, c.iterations, c.tol, c.patience, c.warmup, c.log_every, c.check_every, c.semantic_every, c.semantic_key, c.shared, c.transitive, c.share, c.share_warmup, c.normalise, c.seed, c.checkpoint_every)
    score = _evaluation(spark, c, p, words)

    def checkpoint(i: int, r: Result) -> None:
        store.write_checkpoint(spark, paths["checkpoints"], i, r, words, p.roles, c.structure())
        log.info("iteration %d: error %s", i, r.errors[-1][1] if r.errors else None)

    def best(r: Result) -> None:
        store.write_result(spark, paths["best"], r, words, p.roles)

    store.write_json(spark, paths["config.json"], asdict(c))
    out = train(cells, training, start, score, checkpoint, best if c.save_best else None)
    cells.release()
    model = store.write_result(spark, paths["model"], out, words, p.roles)
    found = score(out.core, out.factors) if score else {}
    store.log_run(spark, paths["runs.jsonl"], stage="decomposition", run=c.run_id(), iterations=out.iterations, stopped=out.stopped, error=out.errors[-1][1] if out.errors else None, linked=groups(len(c.rank), list(c.shared)), seconds=round(time.time() - began, 1), **{k: float(v) if isinstance(v, np.floating) else v for k, v in found.items()})
    return model


STAGES = {"vectors": (Ingest, vectors), "population": (Population, population), "decomposition": (Decomposition, decomposition)}


def main(argv: Sequence[str], spark: SparkSession | None = None) -> object:
    if not argv or argv[0] not in STAGES:
        raise SystemExit(f"usage: python -m polyad.run {{{','.join(STAGES)}}} --flags")
    kind, stage = STAGES[argv[0]]
    settings = parsed(kind, argv[1:])
    handlers: list[logging.Handler] = [logging.StreamHandler()]
    if getattr(settings, "log_path", ""):
        handlers.append(logging.FileHandler(settings.log_path))  # what is said is in the file too
    logging.basicConfig(level=logging.INFO, handlers=handlers, format="%(asctime)s %(message)s")
    spark = spark or SparkSession.builder.getOrCreate()
    ship(spark)
    return stage(spark, settings)


if __name__ == "__main__":
    main(sys.argv[1:])
