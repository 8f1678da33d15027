"""Mixing sources to target weights by systematic sampling.

A source's documents stand in one order, each with the same expected number of copies (the source's
target over its size). The prefix sum of these numbers plus one offset per source crosses an integer
as often as the document is emitted. Documents are ordered by size, which keeps the taken words within
about one longest document of the target.

Positions are found without sorting a source in one task: documents are counted by (source, size,
bucket of the id, range of ids), the counts are prefix-summed by size and then within a size, and only the
documents of one such cell are numbered together: those of a bucket among 2**SPAN consecutive ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runtime import Scratch, tune
from .textvec import Texts, slices

CELLS = 64
#: Bits of the ids that are numbered together.
SPAN = 22
MOST = 3
WEIGHTS = (1, 2, 3)


def _hex(value: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(value.cast("binary")), 1, digits), 16, 10).cast("long")


def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the last column, a text, by its number of words."""
    for batch in batches:
        *names, text = batch.schema.names
        for part in slices(batch, text):
            t = Texts(part.column(text)).split()
            size = pa.array(np.diff(t.word_off).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), size], names=[*names, "size"])


def targets(sizes: DataFrame) -> DataFrame:
    """Targets of sources (source, source_size), one row each.

    The sources in code point order, null last, weigh 1, 2, 3 and so on again; together they get the sum
    of all sizes by weight. A target above three times its source's size stops there and the excess is
    shared anew, which here is one threshold on 3 * size / weight. There is one row a source, so that the
    windows over all of them run in one task.
    """
    w = F.when(F.col("i") % 3 == 0, 3.0).otherwise((F.col("i") % 3).cast("double"))
    ranked = sizes.withColumn("i", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).withColumn("weight", w)
    cap = F.col("source_size").cast("double") * MOST
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("i"))
    everything = Window.partitionBy(F.lit(0))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (
        ranked.withColumn("cap", cap)
        .withColumn("total", F.sum(F.col("source_size").cast("double")).over(everything))
        .withColumn("left_size", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("left_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left_size") / F.col("left_weight"))
        .withColumn("capped", F.col("level") * F.col("weight") >= F.col("cap"))
        .withColumn("free_level", F.min(F.when(~F.col("capped"), F.struct("i", "level"))).over(everything))
    )
    level = level.withColumn("share", F.max(F.when(~F.col("capped"), F.col("level"))).over(everything))
    return level.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("share") * F.col("weight")).alias("target"))


def plan_copies(spark: SparkSession, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, source, digest (of the text), size, source_size, target and copies of every row."""
    tune(spark)
    light = docs.select("doc_id", "source", F.xxhash64("text").alias("digest"), "text").mapInArrow(word_counts, "doc_id long, source string, digest long, size long")
    # rows without doc_id are spread by their texts
    cell = F.coalesce(_hex(F.col("doc_id").cast("string"), 4) % CELLS, F.pmod("digest", F.lit(CELLS)))
    span = F.shiftright(F.coalesce("doc_id", "digest"), SPAN)
    light = scratch.save(light.withColumns({"cell": cell, "span": span}), "mix-sizes")
    # one key for a null source, another for each name: joins then are plain equi-joins
    key = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))
    light = light.withColumn("k", key)
    place = ["k", "size", "cell", "span"]
    cells = light.groupBy(*place).agg(F.count(F.lit(1)).alias("n"), F.first("source").alias("source"))
    by_size = cells.groupBy("k", "size").agg(F.sum("n").alias("n"), F.first("source").alias("source"))
    sizes = by_size.groupBy("k").agg(F.first("source").alias("source"), F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goal = targets(sizes).select(F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source"))).alias("k"), "source_size", "target")
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    smaller = by_size.select("k", "size", before(Window.partitionBy("k").orderBy("size")).alias("smaller"))
    start = cells.select(*place, before(Window.partitionBy("k", "size").orderBy("cell", "span")).alias("before")).join(smaller, ["k", "size"])
    offset = F.coalesce(_hex(F.col("source"), 12) / F.lit(float(1 << 48)), F.lit(0.5))
    at = F.row_number().over(Window.partitionBy(*place).orderBy("doc_id", "digest"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return (
        light.withColumn("at", at)
        .join(start, place)
        .join(goal, "k")
        .withColumn("at", F.col("at") + F.col("before") + F.col("smaller"))
        .withColumn("copies", (F.floor(rate * F.col("at") + offset) - F.floor(rate * (F.col("at") - 1) + offset)).cast("long"))
        .select("doc_id", "source", "digest", "size", "source_size", "target", "copies")
    )


def mix(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken (words in the mix, repeats counted) of every row.

    A null text has no words. A null source is a source of its own, last in order. Rows of one source
    with the same size are told apart by doc_id alone: repeated rows stand side by side and a rerun gives
    the same rows. A source without words has target 0 and gives no copies. An empty table gives none.
    Other columns are not read.
    """
    plan = plan_copies(spark, docs, Scratch(spark))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mix_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents, each as often as the mix takes it; all columns stay.

    Rows of equal doc_id (or none), source and text share their copies: the number for them is spread over
    the rows by rounding down, the first rows getting one more.
    """
    scratch = Scratch(spark)
    name = next(f"_mix{i}" for i in range(99) if not any(c.startswith(f"_mix{i}") for c in docs.columns))
    same = ["doc_id", "source", "digest"]
    plan = plan_copies(spark, docs, scratch).groupBy(*same).agg(F.sum("copies").alias("c"), F.count(F.lit(1)).alias("n"))
    plan = scratch.save(plan, "mix-plan")
    known = plan.select(*[F.col(c).alias(f"{name}{c}") for c in [*same, "c", "n"]])
    met = docs["doc_id"].cast("long").eqNullSafe(known[f"{name}doc_id"]) & docs["source"].eqNullSafe(known[f"{name}source"]) & (F.xxhash64(docs["text"]) == known[f"{name}digest"])
    # the narrow side is hashed: texts cross once and aren't sorted, at every size alike
    joined = docs.join(known.hint("shuffle_hash"), met)
    columns, c, n, row = [F.col(f"`{c}`") for c in docs.columns], F.col(f"{name}c"), F.col(f"{name}n"), F.col(f"{name}row")

    def repeated(rows: DataFrame, times: Column) -> DataFrame:
        return rows.withColumn(f"{name}t", F.explode(F.array_repeat(F.lit(0), times.cast("int")))).select(*columns)

    if not plan.filter("n > 1").limit(1).count():
        return repeated(joined, c)
    # only rows that share all three are numbered, in the order of their other columns
    order = Window.partitionBy(f"{name}doc_id", f"{name}source", f"{name}digest").orderBy(*[F.col(f"`{f.name}`") for f in docs.schema if f.dataType.typeName() not in ("map", "variant") and f.name not in ("text", "source", "doc_id")] or [F.lit(0)])
    shared = joined.filter(n > 1).withColumn(f"{name}row", F.row_number().over(order) - 1)
    return repeated(joined.filter(n == 1), c).union(repeated(shared, F.floor(c / n) + (row < c % n).cast("int")))


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         (('0x' || substr(md5(doc_id::VARCHAR), 1, 4))::BIGINT) % 64 AS cell FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS i FROM sources),
weighed AS (SELECT *, (CASE WHEN i % 3 = 0 THEN 3 ELSE i % 3 END)::DOUBLE AS weight, source_size::DOUBLE * 3 AS cap FROM ranked),
levels AS (SELECT *, (sum(source_size::DOUBLE) OVER () - coalesce(sum(cap) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM weighed WINDOW w AS (ORDER BY cap / weight, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
share AS (SELECT max(level) AS share FROM levels WHERE level * weight < cap),
goal AS (SELECT source, source_size, CASE WHEN level * weight >= cap THEN cap ELSE share * weight END AS target FROM levels CROSS JOIN share),
placed AS (SELECT d.doc_id, d.size, g.source_size, g.target,
    CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS rate,
    coalesce(('0x' || substr(md5(d.source), 1, 12))::BIGINT / 281474976710656.0, 0.5) AS shift,
    row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.cell, d.doc_id) AS pos
  FROM sized d JOIN goal g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, ((floor(rate * pos + shift) - floor(rate * (pos - 1) + shift)) * size)::BIGINT AS taken FROM placed
"""
