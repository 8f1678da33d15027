"""Tensors, vocabularies, models, extensions and run logs as Parquet and JSON."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid
from datetime import UTC, datetime

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scores import LOWEST
from ..operators.assoc import METHODS, Populated
from ..operators.extend import EXTENSION, combined
from ..operators.model import Tucker
from ..operators.tucker import Result


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p) and fs.getFileStatus(p).isDirectory())


def children(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir); unset in local sessions: a
    temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="polyad-scratch-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/polyad/{name}-{uuid.uuid4().hex}"


def missing(spark: SparkSession, wanted: dict[str, str]) -> list[str]:
    """The names whose paths don't exist yet: what is still to compute."""
    return [name for name, path in wanted.items() if not exists(spark, path)]


def append_csv(df: DataFrame, folder: str) -> None:
    """Further CSV files with a header each; existing ones stay."""
    df.write.mode("append").option("header", True).csv(folder)


def write_rows(df: DataFrame, path: str, rows_per_file: int = 5_000_000, mode: str = "append") -> None:
    """Sharded zstd Parquet. Appending never touches existing shards."""
    df.write.mode(mode).option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(path)


def write_orders(tables: dict[int, DataFrame], folder: str, **options) -> None:
    """One folder for each n-gram order."""
    for n, df in tables.items():
        write_rows(df, f"{folder}/{n}-gram", **options)


def write_populated(p: Populated, folder: str, overwrite: bool = False) -> None:
    """cells by top_k with all seven methods as columns, the vocabulary, and a description."""
    mode = "overwrite" if overwrite else "ignore"
    p.cells.write.mode(mode).partitionBy("top_k").parquet(f"{folder}/cells")
    p.vocab.write.mode(mode).parquet(f"{folder}/vocab")
    write_json(p.cells.sparkSession, f"{folder}/about.json", {"roles": p.roles, "total": p.total, "top_ks": list(p.top_ks)})


def read_populated(spark: SparkSession, folder: str) -> Populated:
    about = read_json(spark, f"{folder}/about.json")
    return Populated(spark.read.parquet(f"{folder}/vocab"), spark.read.parquet(f"{folder}/cells"), about["roles"], about["total"], tuple(about["top_ks"]))


def read_tensor(spark: SparkSession, folder: str, method: str, k: int) -> DataFrame:
    """(i0, ..., value) of one method; the top_k is a partition, other methods' columns aren't read."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}, not {method!r}")
    p = read_populated(spark, folder)
    if k not in p.top_ks:
        raise ValueError(f"there is no top_k of {k}, only {p.top_ks}")
    return p.tensor(method, k).filter(F.col("value") > LOWEST)


def write_model(spark: SparkSession, model: Tucker, path: str, mode: str = "overwrite") -> None:
    model.factor_table(spark).write.mode(mode).partitionBy("role").parquet(f"{path}/factors")
    model.core_table(spark).write.mode(mode).parquet(f"{path}/core")
    write_json(spark, f"{path}/about.json", {"roles": model.roles})


def read_model(spark: SparkSession, path: str) -> Tucker:
    roles = read_json(spark, f"{path}/about.json")["roles"]
    core_rows = np.array([list(r) for r in spark.read.parquet(f"{path}/core").collect()])
    at = core_rows[:, :-1].astype(int)
    core = np.zeros(tuple(at.max(0) + 1))
    core[tuple(at.T)] = core_rows[:, -1]
    factors, vocab = [], []
    table = spark.read.parquet(f"{path}/factors")
    for r in roles:
        rows = sorted(table.filter(F.col("role") == r).select("idx", "token", "vec").collect())
        vocab.append([x["token"] for x in rows])
        factors.append(np.array([x["vec"] for x in rows]))
    return Tucker(core, factors, vocab, roles)


def write_checkpoint(spark: SparkSession, folder: str, iteration: int, result: Result, vocab: list[list[str]], roles: list[str], config: dict) -> None:
    """iter=<n> beside the others, with its errors and the settings it may be continued under."""
    path = f"{folder}/iter={iteration:08d}"
    write_model(spark, Tucker(result.core, result.factors, vocab, roles), f"{path}/model")
    write_json(spark, f"{path}/state.json", {"iteration": iteration, "errors": result.errors, "fitness": result.fitness, "config": config})


def latest_checkpoint(spark: SparkSession, folder: str, config: dict) -> tuple[Result, Tucker] | None:
    """The furthest checkpoint whose settings are the same; unfinished ones have no state and are passed over."""
    for name in reversed([c for c in children(spark, folder) if c.startswith("iter=")]):
        path = f"{folder}/{name}"
        if not exists(spark, f"{path}/state.json"):
            continue
        state = read_json(spark, f"{path}/state.json")
        if state["config"] != json.loads(json.dumps(config)):
            continue
        model = read_model(spark, f"{path}/model")
        errors = [(int(i), float(e)) for i, e in state["errors"]]
        return Result(model.core, model.factors, errors, [(int(i), f) for i, f in state["fitness"]], state["iteration"]), model
    return None


def write_result(spark: SparkSession, path: str, result: Result, vocab: list[list[str]], roles: list[str]) -> Tucker:
    """The model with its errors and fitness beside it."""
    model = Tucker(result.core, result.factors, vocab, roles)
    write_model(spark, model, path)
    write_json(spark, f"{path}/state.json", {"iteration": result.iterations, "stopped": result.stopped, "errors": result.errors, "fitness": result.fitness})
    return model


def read_trained(spark: SparkSession, folder: str, iteration: int | None = None) -> Tucker:
    """A run's model: of the given iteration, else the finished one, else the best, else the furthest checkpoint."""
    if iteration is not None:
        return read_model(spark, f"{folder}/checkpoints/iter={iteration:08d}/model")
    for name in ("model", "best"):
        if exists(spark, f"{folder}/{name}/about.json"):
            return read_model(spark, f"{folder}/{name}")
    found = [c for c in children(spark, f"{folder}/checkpoints") if exists(spark, f"{folder}/checkpoints/{c}/state.json")]
    if not found:
        raise FileNotFoundError(f"{folder} holds no model")
    return read_model(spark, f"{folder}/checkpoints/{found[-1]}/model")


def write_extension(extension: DataFrame, path: str, mode: str = "overwrite") -> None:
    extension.orderBy("role", F.desc("cnt"), "token").write.mode(mode).parquet(path)


def read_extension(spark: SparkSession, path: str, model: Tucker, existing: DataFrame | None = None, overwrite: bool = False) -> DataFrame:
    """A stored extension, checked against the model's roles and ranks, merged with an existing one."""
    found = spark.read.schema(EXTENSION).parquet(path)
    for row in found.groupBy("role").agg(F.min(F.size("vec")).alias("low"), F.max(F.size("vec")).alias("high")).collect():
        rank = model.core.shape[model.role(row["role"])]
        if (row["low"], row["high"]) != (rank, rank):
            raise ValueError(f"extensions of {row['role']} have {row['low']} to {row['high']} components, the model {rank}")
    return combined(existing, found, overwrite) if existing is not None else found


def write_json(spark: SparkSession, path: str, value: object) -> None:
    """Written beside and renamed, so that readers see all of it or nothing."""
    fs, p = _fs(spark, path)
    _, temporary = _fs(spark, f"{path}.tmp")
    out = fs.create(temporary, True)
    out.write(bytearray(json.dumps(value, ensure_ascii=False, indent=2).encode()))
    out.close()
    fs.delete(p, False)
    fs.rename(temporary, p)


def read_json(spark: SparkSession, path: str):
    return json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))


def cached_json(spark: SparkSession, path: str, make, refresh: bool = False):
    """A stored object, made and stored where it is missing."""
    if not refresh and exists(spark, path):
        if not isinstance(found := read_json(spark, path), dict):
            raise ValueError(f"{path} holds no object")
        return found
    value = make()
    write_json(spark, path, value)
    return value


def log_run(spark: SparkSession, folder: str, **entry: object) -> None:
    """Appends one JSON record with a UTC time."""
    record = {"timestamp": datetime.now(UTC).isoformat(timespec="seconds"), **entry}
    spark.createDataFrame([(json.dumps(record),)], "value string").write.mode("append").text(folder)
