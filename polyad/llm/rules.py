"""Quality rules: measured statistics, fixed limits, and a learned decision list.

Sequential covering: a rule grows condition by condition (one statistic against one threshold) by
information gain on two thirds of the labelled rows still uncovered, loses its last conditions where the
other third says so, and is taken if it is precise on both; rows it covers leave, and the next rule is
grown. The ordered rules become one Spark conditional expression.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import tune
from .textvec import Texts, in_text, slices, windows

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_upper", "n_marks", "n_digits", "n_distinct_words", "n_lines")
STATS = BASE + EXTRA
STRUCT = T.StructType([T.StructField(s, T.LongType()) for s in STATS])

#: Labelled rows the rules are learned from, at most (those of the smallest id hashes).
MOST_ROWS = 20_000

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"!?\"'()[]{}.,;:-_/\\@^~+=`")] = True


def measure(column: pa.Array) -> np.ndarray:
    """The statistics of each text, in the order of STATS."""
    t = Texts(column).split()
    n_words = np.diff(t.word_off)
    own = (t.data & 0xC0) != 0x80
    hashes, docs = t.word_hashes(), t.doc_of_word()

    seen, at = windows(hashes, docs, 3)
    _, which, count = np.unique(in_text(seen, docs[at]), return_inverse=True, return_counts=True)
    repeated = np.zeros(len(hashes) + 2, bool)
    for j in range(3):
        repeated[at[count[which] > 1] + j] = True

    # lines: ranges between line feeds and text limits
    feed = np.flatnonzero(t.data == 10)
    starts = np.sort(np.concatenate((t.off[:-1], feed + 1)))
    ends = np.sort(np.concatenate((feed, t.off[1:])))
    n_lines = t.per_text(t.data == 10) + 1
    of = np.repeat(np.arange(t.n), n_lines)
    wordy = np.searchsorted(t.starts, ends) > np.searchsorted(t.starts, starts)
    lines, line_of = in_text(t.hashes(starts[wordy], ends[wordy]), of[wordy]), of[wordy]
    _, first = np.unique(lines, return_index=True)
    again = np.ones(len(lines), bool)
    again[first] = False

    _, first = np.unique(in_text(hashes, docs), return_index=True)
    latin = np.zeros(len(t.data), bool)
    latin[1:] = (t.data[:-1] == 0xC3) & (t.data[1:] >= 0x80) & (t.data[1:] <= 0x9E)
    upper = ((t.data >= 65) & (t.data <= 90)) | latin
    count_of = lambda rows: np.bincount(rows, minlength=t.n)
    return np.stack(
        [
            n_words,
            t.per_text(t.is_word & own),
            t.per_text(_SYMBOL[t.data]),
            count_of(line_of[again]),
            count_of(docs[repeated[: len(docs)]]),
            t.per_text(upper),
            t.per_text(_MARK[t.data]),
            t.per_text((t.data >= 48) & (t.data <= 57)),
            count_of(docs[first]),
            count_of(line_of),
        ],
        1,
    ).astype(np.int64)


def _sliced(column: pa.Array, limit: int = 1 << 20) -> Iterator[pa.Array]:
    for part in slices(pa.RecordBatch.from_arrays([column], names=["t"]), "t", limit):
        yield part.column("t")


@F.arrow_udf(STRUCT)
def stats_udf(text: pa.Array) -> pa.Array:
    rows = [measure(part) for part in _sliced(text)]
    table = np.concatenate(rows) if rows else np.zeros((0, len(STATS)), np.int64)
    return pa.StructArray.from_arrays([pa.array(table[:, i]) for i in range(len(STATS))], names=list(STATS))


#: What conditions look at: numerator, denominator (both statistics); a ratio is taken in thousandths.
RATIOS = {
    "symbols": ("n_symbols", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "upper": ("n_upper", "word_chars"),
    "marks": ("n_marks", "word_chars"),
    "digits": ("n_digits", "word_chars"),
    "distinct": ("n_distinct_words", "n_words"),
    "word_length": ("word_chars", "n_words"),
    "words": ("n_words", None),
}


@dataclass(frozen=True)
class Condition:
    """ratio > threshold or ratio <= threshold, in thousandths (plain counts as they are)."""

    ratio: str
    above: bool
    threshold: int

    def column(self, stat: dict[str, Column]) -> Column:
        a, b = RATIOS[self.ratio]
        left, right = (stat[a] * 1000, stat[b] * self.threshold) if b else (stat[a], F.lit(self.threshold))
        return left > right if self.above else left <= right

    def holds(self, ratios: dict[str, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        a, b = ratios[self.ratio]
        return (a > b * self.threshold) == self.above

    def __str__(self) -> str:
        return f"{self.ratio} {'>' if self.above else '<='} {self.threshold}"


def _ratios(table: np.ndarray) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    col = {s: table[:, i] for i, s in enumerate(STATS)}
    return {k: (col[a] * 1000, col[b]) if b else (col[a], np.ones(len(table), np.int64)) for k, (a, b) in RATIOS.items()}


def learn(table: np.ndarray, bad: np.ndarray, precision: float = 0.95, least: int = 8, conditions: int = 4, cuts: int = 64, rules: int = 24) -> list[tuple[Condition, ...]]:
    """Rules that cover the rows marked bad; ``precision`` and ``least`` covered rows are asked of each."""
    ratios = _ratios(table)
    value = {k: a / np.maximum(b, 1) for k, (a, b) in ratios.items()}
    prune = np.arange(len(table)) % 3 == 2
    open_ = np.ones(len(table), bool)
    found: list[tuple[Condition, ...]] = []

    def covers(rule: list[Condition]) -> np.ndarray:
        out = open_.copy()
        for c in rule:
            out &= c.holds(ratios)
        return out

    def quality(rows: np.ndarray) -> tuple[int, int]:
        return int((rows & bad).sum()), int((rows & ~bad).sum())

    while len(found) < rules and (open_ & bad).sum() >= least:
        rule: list[Condition] = []
        now = open_ & ~prune
        while len(rule) < conditions:
            p, n = quality(now)
            if not p or not n:
                break
            best, gain = None, 1e-9
            for k, v in value.items():
                for cut in np.unique(np.quantile(v[now & bad], np.linspace(0, 1, cuts), method="nearest").round().astype(np.int64)):
                    for c in (Condition(k, True, int(cut) - 1), Condition(k, False, int(cut) + 1)):
                        p1, n1 = quality(now & c.holds(ratios))
                        g = p1 * (np.log2(p1 / (p1 + n1)) - np.log2(p / (p + n))) if p1 else 0
                        if g > gain:
                            best, gain = c, g
            if best is None:
                break
            rule.append(best)
            now &= best.holds(ratios)

        def worth(r: list[Condition]) -> float:
            p, n = quality(covers(r) & prune)
            return (p - n) / max(p + n, 1)

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule.pop()
        p, n = quality(covers(rule)) if rule else (0, 1)
        q, m = quality(covers(rule) & prune) if rule else (0, 1)
        if p < least or p < precision * (p + n) or q < precision * (q + m):
            break
        found.append(tuple(rule))
        open_ &= ~covers(rule)
    return found


def verdict(rules: list[tuple[Condition, ...]], stat: dict[str, Column]) -> Column:
    """True: keep. The first rule that applies rejects; without one the text is kept."""
    out = F
    for rule in rules:
        applies = rule[0].column(stat)
        for c in rule[1:]:
            applies = applies & c.column(stat)
        out = out.when(applies, F.lit(False))
    return out.otherwise(F.lit(True)) if rules else F.lit(True)


def base_failed(stat: dict[str, Column]) -> Column:
    return (stat["n_words"] < 50) | (stat["n_repeat_words"] * 100 > stat["n_words"] * 50)


def learn_rules(spark: SparkSession, docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> list[tuple[Condition, ...]]:
    """Rules from at most ``most_rows`` labelled documents that the fixed limits leave.

    Of several labels of one id the smallest counts, of several texts the one of the least statistics; rows
    without label or id teach nothing.
    """
    tune(spark)
    marked = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min("quality").alias("_q"))
    sample = F.broadcast(marked.orderBy(F.xxhash64("_id"), "_id").limit(most_rows))  # at most 20,000 rows of 12 bytes
    texts = docs.select(F.col("doc_id").cast("long").alias("_d"), F.col("text").alias("_t"))
    measured = texts.join(sample, F.col("_d") == F.col("_id")).select("_d", "_q", stats_udf("_t").alias("s"))
    rows = measured.groupBy("_d", "_q").agg(F.min("s").alias("s")).select("_d", "_q", "s.*").toPandas()
    rows = rows.sort_values(["_d", *STATS]).reset_index(drop=True)
    table, bad = rows[list(STATS)].to_numpy(np.int64), rows["_q"].to_numpy() == 0
    left = (table[:, 0] >= 50) & (table[:, 4] * 100 <= table[:, 0] * 50)
    order = np.random.default_rng(5).permutation(int(left.sum()))
    return learn(table[left][order], bad[left][order])


def judge(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the statistics, base_failed and kept of every row.

    A null or empty text has no words, so it fails. Repeated rows and rows without doc_id are judged each by its
    own text. Without labels nothing is learned and the fixed limits alone decide. An empty table gives no
    row. Other columns are not read.
    """
    rules = learn_rules(spark, docs, labels)
    measured = docs.select("doc_id", stats_udf("text").alias("s")).select("doc_id", "s.*")
    stat = {s: F.col(s) for s in STATS}
    failed = base_failed(stat)
    return measured.select("doc_id", *STATS, failed.alias("base_failed"), (~failed & verdict(rules, stat)).alias("kept"))


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are kept; all columns stay."""
    rules = learn_rules(spark, docs, labels)
    name = next(f"_stats{i}" for i in range(99) if f"_stats{i}" not in docs.columns)
    stat = {s: F.col(f"{name}.{s}") for s in STATS}
    return docs.withColumn(name, stats_udf(docs["text"])).filter(~base_failed(stat) & verdict(rules, stat)).drop(name)
