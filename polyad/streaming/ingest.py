"""Streaming ingest: new text files become n-gram tables; checkpoints hold the position, so nothing is
read twice or lost, and sentences are identified by document and place, so no state is carried."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import ngrams, sentences, tokens, usable_texts


def text_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 16) -> DataFrame:
    """New Parquet files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def ngram_rows(texts: DataFrame, n: int, key: str = "doc_id", text: str = "text", longest: int | None = None) -> DataFrame:
    """Texts to (key, sent_pos, w1..wn); the same expressions for batches and streams."""
    split = sentences(usable_texts(texts, text, longest), key, text)
    return ngrams(tokens(split).select(key, "sent_pos", "tokens"), n)


def start_ingest(texts: DataFrame, orders: tuple[int, ...], folder: str, checkpoint: str, key: str = "doc_id", text: str = "text", longest: int | None = None, rows_per_file: int = 5_000_000, target_rows: int | None = None) -> StreamingQuery:
    """Writes each order's n-grams of the available data; one pass over a micro-batch's tokens serves all orders.

    A repeated micro-batch replaces its own folder (batch=<id>), which makes the write idempotent. Once
    ``target_rows`` rows of the first order are written, later batches write nothing.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if target_rows is not None:
            jvm = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{orders[0]}-gram")
            fs = jvm.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
            if fs.exists(jvm) and spark.read.parquet(f"{folder}/{orders[0]}-gram").filter(F.col("batch") != batch_id).count() >= target_rows:
                return
        words = tokens(sentences(usable_texts(batch, text, longest), key, text)).select(key, "sent_pos", "tokens").persist()
        try:
            for n in orders:
                out = ngrams(words, n).write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", rows_per_file)
                out.parquet(f"{folder}/{n}-gram/batch={batch_id}")
        finally:
            words.unpersist()

    return texts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_counts(rows: DataFrame, roles: list[str]) -> DataFrame:
    """Marginal counts of a stream (complete output): partial sums per batch, state by (role, token)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.col(r).alias("token")) for r in roles])).alias("x")
    return rows.select(pairs).groupBy("x.role", "x.token").agg(F.count(F.lit(1)).alias("cnt"))


def write_counts(counts: DataFrame, folder: str) -> str:
    """Runs a complete-output stream over the available data, one table a micro-batch; the last one's folder."""
    last = []

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")
        last.append(f"{folder}/batch={batch_id}")

    counts.writeStream.foreachBatch(write).outputMode("complete").option("checkpointLocation", f"{folder}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return last[-1]


def progress(query: StreamingQuery) -> list[dict]:
    """What each micro-batch of a stream read and how fast: (batch, rows, rows_per_second)."""
    return [{"batch": p["batchId"], "rows": p["numInputRows"], "rows_per_second": p["processedRowsPerSecond"]} for p in query.recentProgress]
