"""Frame rows: blueprints of a frame's elements, one canonical slot order, and filled argument slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import MISSING

ARGUMENTS = 5


def priority(kind: Column) -> Column:
    k = F.lower(F.coalesce(kind, F.lit("unknown")))
    return F.when(k == "core", 0).when(k == "core-unexpressed", 1).when(k == "extra-thematic", 2).when(k == "peripheral", 3).otherwise(4)


def element_frequency(exemplars: DataFrame) -> DataFrame:
    """(frame, element, freq): exemplars (frame, element, spans array) with at least one span."""
    return exemplars.groupBy("frame", "element").agg(F.count_if(F.size("spans") > 0).alias("freq"))


def blueprint(elements: DataFrame, frequency: DataFrame | None = None, slots: int = 6) -> DataFrame:
    """(frame, element, pos): core elements first, then others while there are fewer than ``slots``.

    elements (frame, element, kind). Order within each part: priority of the kind, falling frequency, name.
    """
    rows = elements.join(frequency, ["frame", "element"], "left") if frequency is not None else elements.withColumn("freq", F.lit(0))
    core = F.lower(F.coalesce("kind", F.lit("unknown"))).startswith("core")
    rows = rows.select("frame", "element", core.alias("core"), priority(F.col("kind")).alias("priority"), F.coalesce("freq", F.lit(0)).alias("freq"))
    order = Window.partitionBy("frame").orderBy(F.desc("core"), "priority", F.desc("freq"), "element")
    rows = rows.withColumn("pos", F.row_number().over(order) - 1)
    return rows.filter(F.col("core") | (F.col("pos") < slots)).select("frame", "element", "core", "pos")


def canonical_orders(blueprints: DataFrame, slots: int = 6) -> DataFrame:
    """(frame, slot, element): elements by their most common position anywhere, then how common they are, then name.

    A frame has slots - 1 places; places without an element are absent and filled with the missing mark later.
    Of equally common positions the lowest counts.
    """
    cut = blueprints.filter(F.col("pos") < slots - 1).select("frame", "element", "pos")
    at = cut.groupBy("element", "pos").agg(F.count(F.lit(1)).alias("n"))
    usual = at.groupBy("element").agg(F.min(F.struct(-F.col("n"), "pos"))["pos"].alias("usual"), F.sum("n").alias("freq"))
    order = Window.partitionBy("frame").orderBy("usual", F.desc("freq"), "element")
    return cut.join(usual, "element").select("frame", (F.row_number().over(order) - 1).alias("slot"), "element")


def target_word(sentence: Column, start: Column) -> Column:
    """The first word from a position on, without punctuation around it."""
    rest = F.split(F.trim(F.substring(sentence, start + 1, F.length(sentence))), r"\s+")[0]
    word = F.regexp_replace(rest, r"^\p{Punct}+|\p{Punct}+$", "")
    return F.when(start.isNull() | (F.coalesce(rest, F.lit("")) == ""), F.lit(MISSING)).otherwise(word)


def frame_rows(detected: DataFrame, orders: DataFrame) -> DataFrame:
    """(sent_id, frame_name, target, arg1..arg5) of detected frames (sent_id, frame_name, target, elements map)."""
    order = orders.groupBy(F.col("frame").alias("frame_name")).agg(F.map_from_entries(F.collect_list(F.struct("slot", "element"))).alias("order"))
    joined = detected.join(order, "frame_name", "left")
    fill = lambda j: F.coalesce(F.col("elements")[F.col("order")[F.lit(j)]], F.lit(MISSING)).alias(f"arg{j + 1}")
    return joined.select("sent_id", "frame_name", F.coalesce("target", F.lit(MISSING)).alias("target"), *map(fill, range(ARGUMENTS)))
