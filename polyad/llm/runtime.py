"""Session settings and scratch tables shared by the operators of this package."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..ship import ship

#: Rows and bytes in one Arrow batch: bound what a Python worker holds, whatever the partition's size.
ARROW_ROWS = 4096
ARROW_BYTES = "16m"


def tune(spark: SparkSession) -> None:
    """The package on the executors, and small Arrow batches, since texts may be long."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where it is unset a local session (tests) gets a temporary one; a cluster is refused, since its executors
    could not read a folder of this machine.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="polyad-scratch-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def clear(spark: SparkSession) -> None:
    """Removes all intermediate tables of this package; results that still read them are lost."""
    delete_path(spark, f"{shared_dir(spark)}/polyad")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/polyad/{name}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, {}

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = new_path(self.spark, name)
        df.write.mode("overwrite").parquet(path)
        self.drop(name)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if name in self.paths:
                delete_path(self.spark, self.paths.pop(name))
