"""A bounded bitmap of ids, broadcast so that rows no id can match need not be sent anywhere.

It has 16 bits an id, and at most MOST_BITS, so a broadcast of at most MOST_BITS / 64 rows whatever the number of
ids. A clear bit is certain; a set bit may be another id's, so rows with one still go to the join that decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_BITS, MOST_BITS = 1 << 16, 1 << 27


def bits_for(n: int) -> int:
    """Bits for n ids: a power of two."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (16 * n - 1).bit_length())) if n else LEAST_BITS


def _word(key: str, bits: int) -> Column:
    return F.expr(f"cast(pmod(xxhash64({key}), {bits}) div 64 as int)")


def _bit(key: str, bits: int) -> Column:
    return F.expr(f"shiftleft(1L, cast(pmod(xxhash64({key}), {bits}) % 64 as int))")


def marked(rows: DataFrame, key: str, ids: DataFrame, id_: str, flag: str) -> DataFrame:
    """The rows with a boolean column ``flag``: whether the bigint ``key`` may be among the ids. A null key isn't.

    ids is counted first, so it should be a written table.
    """
    bits = bits_for(ids.count())
    words = ids.select(_word(id_, bits).alias(f"{flag}_w"), _bit(id_, bits).alias(f"{flag}_b")).groupBy(f"{flag}_w").agg(F.bit_or(f"{flag}_b").alias(f"{flag}_b"))
    joined = rows.withColumn(f"{flag}_k", F.when(F.col(key).isNotNull(), _word(key, bits))).join(F.broadcast(words), F.col(f"{flag}_k") == F.col(f"{flag}_w"), "left")
    hit = F.coalesce(F.col(f"{flag}_b").bitwiseAND(_bit(key, bits)) != 0, F.lit(False))
    return joined.withColumn(flag, hit).drop(f"{flag}_k", f"{flag}_w", f"{flag}_b")
