"""Best-fit packing of token sequences by exact-complement hashing.

Only lengths decide where a piece can go, and there are at most ``room`` of them. So the plan is made
from the histogram of lengths, whatever the number of pieces. An index holds, for every sum up to ``room``, a
pair and a triple of available lengths that give it. For the longest length left, its gap is looked up as one
length, a pair and a triple, and what fills it exactly is used as many times as all counts allow; where
no such combination is left, the longest length that fits follows (best fit). A plan step says: from sequence
s on, n sequences hold these lengths in this order. Pieces of a length are numbered, and the number finds
the step.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runtime import Scratch, tune
from .textvec import LOWER, SPACE, U64, Texts, mix, slices

ROOM = 4096
END = 1
#: Pieces of one length that are numbered together.
CELL_PIECES = 200_000

_KIND = np.full(256, 3, np.uint8)
_KIND[SPACE] = 0
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[48:58] = 2
_KIND[0xC3] = 1


class WordTokenizer:
    """Token ids of texts under a vocabulary whose tokens never cross white space.

    Texts are cut at white space, words of ASCII and Latin-1 letters further at the cuts the vocabulary's
    own splitting makes, and every distinct piece is encoded once by the library and remembered under its
    64-bit hash (two pieces of a cache of two million share one with probability 1e-7). Words with other characters, with
    apostrophes or special strings go to the library as they are, so the ids are those of the whole text.
    """

    most = 1_500_000

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.plain = Tokenizer.from_file(path)
        from tokenizers import normalizers

        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.clear()

    def clear(self) -> None:
        self.keys, self.slot = np.zeros(0, U64), np.zeros(0, np.int64)
        self.lens, self.at, self.ids, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1 << 16, np.int32), 0

    def units(self, t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lowers t.data in place where the word allows; starts, ends and 'as it is' flags of the units."""
        data = t.data
        t.split()
        kind = _KIND[data]
        after_c3 = np.zeros(len(data), bool)
        after_c3[1:] = data[:-1] == 0xC3
        latin = after_c3 & (data >= 0x80) & (data != 0x97) & (data != 0xB7)
        kind[latin] = 1
        odd = ((data >= 0x80) & (data != 0xC3) & ~latin) | (data == 39)
        bar = np.zeros(len(data), bool)
        bar[:-1] = (data[:-1] == 60) & (data[1:] == 124)
        total = np.concatenate(([0], np.cumsum(odd | bar)))
        whole = total[t.ends] > total[t.starts]
        lowered = LOWER[data]
        up = latin & (data < 0x9F)
        lowered[up] += 0x20
        flag = np.zeros(len(data) + 1, np.int8)
        flag[t.starts[whole]] += 1
        flag[t.ends[whole]] -= 1
        inside = np.cumsum(flag[:-1], dtype=np.int8).astype(bool)
        t.data = np.where(inside, data, lowered)
        first = np.zeros(len(data), bool)
        first[t.starts] = True
        cut = np.zeros(len(data), bool)
        cut[1:] = ((kind[1:] != kind[:-1]) | (kind[1:] == 2)) & ~inside[1:]
        starts = np.flatnonzero(t.is_word & (first | cut))
        last = np.concatenate((starts[1:], [len(data)]))
        word = np.searchsorted(t.starts, starts, "right") - 1
        ends = np.minimum(last, t.ends[word]) if len(starts) else starts
        return starts, ends, whole[word] if len(starts) else np.zeros(0, bool)

    def _encode(self, units: list[bytes], whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and ids, unit after unit."""
        lens, parts = np.zeros(len(units), np.int64), [None] * len(units)
        if (odd := np.flatnonzero(whole)).size:
            for i, e in zip(odd, self.whole.encode_batch_fast([units[i].decode("utf-8", "replace") for i in odd], add_special_tokens=False)):
                parts[i] = e.ids
                lens[i] = len(parts[i])
        plain = np.flatnonzero(~whole)
        for k in range(0, len(plain), 128):
            group = plain[k : k + 128]
            e = self.plain.encode(b" ".join([units[i] for i in group]).decode(), add_special_tokens=False)
            ids, n = e.ids, np.bincount(np.asarray(e.word_ids, np.int64), minlength=len(group))
            to = np.cumsum(n).tolist()
            lens[group] = n
            for i, a, b in zip(group, [0, *to], to):
                parts[i] = ids[a:b]
        flat = np.fromiter((x for p in parts for x in p), np.int32, int(lens.sum()))
        return lens, flat

    def __call__(self, t: Texts) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and the texts' limits in them."""
        starts, ends, whole = self.units(t)
        keys = t.hashes(starts, ends)
        keys = np.where(whole, mix(keys ^ U64(0x77)), keys)
        distinct, first, which = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.keys) > self.most:
            self.clear()
        at = np.searchsorted(self.keys, distinct)
        found = np.zeros(len(distinct), bool)
        ok = at < len(self.keys)
        found[ok] = self.keys[at[ok]] == distinct[ok]
        if (new := np.flatnonzero(~found)).size:
            i = first[new]
            lens, flat = self._encode([t.data[a:b].tobytes() for a, b in zip(starts[i], ends[i])], whole[i])
            while self.used + len(flat) > len(self.ids):
                self.ids = np.concatenate((self.ids, np.zeros(len(self.ids), np.int32)))
            self.ids[self.used : self.used + len(flat)] = flat
            slots = len(self.lens) + np.arange(len(new))
            self.at = np.concatenate((self.at, self.used + np.cumsum(lens) - lens))
            self.lens = np.concatenate((self.lens, lens))
            self.used += len(flat)
            self.keys = np.insert(self.keys, at[new], distinct[new])
            self.slot = np.insert(self.slot, at[new], slots)
            at = np.searchsorted(self.keys, distinct)
        slot = self.slot[at][which] if len(distinct) else np.zeros(0, np.int64)
        lens = self.lens[slot]
        upto = np.concatenate(([0], np.cumsum(lens)))
        take = np.repeat(self.at[slot] - upto[:-1], lens) + np.arange(upto[-1])
        return self.ids[take], upto[np.searchsorted(starts, t.off)]


_tokenizers: dict[str, WordTokenizer] = {}


def piece_rows(path: str, room: int = ROOM) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (doc_id, piece, start, length, ids_crc32, mark) of documents (doc_id, text). mark: any number, which
    tells equal rows apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizers.get(path) or _tokenizers.setdefault(path, WordTokenizer(path))
        for batch in batches:
            for part in slices(batch, "text"):
                ids, limits = tokenizer(Texts(part.column("text")))
                ids = ids.astype("<u4")
                rows: list[tuple[int, int, int, int, int]] = []
                limits = limits.tolist()
                for d in range(part.num_rows):
                    doc = np.append(ids[limits[d] : limits[d + 1]], np.uint32(END)).astype("<u4")
                    for p, s in enumerate(range(0, len(doc), room)):
                        piece = doc[s : s + room]
                        rows.append((d, p, s, len(piece), zlib.crc32(piece)))
                d, p, s, n, c = map(np.array, zip(*rows))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(d)), pa.array(p, pa.int32()), pa.array(s, pa.int64()), pa.array(n, pa.int64()), pa.array(c, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"]).append_column("mark", pa.array(d, pa.int32()))

    return run


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, mark int"


class Sums:
    """An index of the sums of one, two and three available lengths.

    pair[s]: the longer length of a pair that gives s; triple[s]: a length that with a pair gives s; 0 where there
    is none. Lengths only ever run out, so an entry that was 0 stays so, and one that names a length which
    has run out is looked for anew when it is asked for. keep: whether a failure is for good, which it isn't
    while lengths are held back for a try.
    """

    def __init__(self, left: np.ndarray) -> None:
        self.left, room = left, len(left) - 1
        self.pair, self.triple = np.zeros(room + 1, np.int64), np.zeros(room + 1, np.int64)
        have = np.flatnonzero(left)
        for a in have.tolist():  # rising, so that the longest length that gives a sum stays
            b = have[(have <= a) & (have <= room - a)]
            self.pair[a + (b if left[a] > 1 else b[b < a])] = a
        some = np.flatnonzero(self.pair)
        for a in have.tolist():
            self.triple[a + some[some <= room - a]] = a

    def search(self, total: int) -> tuple[int, int] | None:
        """A pair of available lengths, the longer one as long as possible."""
        a = np.arange(total - 1, (total - 1) // 2, -1)
        ok = (self.left[a] > 0) & (self.left[total - a] > 0) & ((2 * a != total) | (self.left[a] > 1))
        return (int(a[ok.argmax()]), total - int(a[ok.argmax()])) if len(a) and ok.any() else None

    def two(self, total: int, keep: bool) -> tuple[int, int] | None:
        a = int(self.pair[total])
        if not a:
            return None
        if self.left[a] > (2 * a == total) and self.left[total - a] > 0:
            return a, total - a
        found = self.search(total)
        if found or keep:
            self.pair[total] = found[0] if found else 0
        return found

    def three(self, total: int, keep: bool) -> tuple[int, int, int] | None:
        have = np.flatnonzero(self.left[: int(self.triple[total]) + 1])[::-1]
        have = have[(3 * have >= total) & (have < total - 1)]
        for a in have[self.pair[total - have] > 0].tolist():
            rest = self.two(total - a, keep)
            if rest and self.left[a] <= rest.count(a):  # the pair takes what there is of it
                self.left[a] -= 1
                rest = self.search(total - a)
                self.left[a] += 1
            if rest:
                self.triple[total] = a
                return (a, *rest)
        if keep:
            self.triple[total] = 0
        return None

    def exact(self, total: int, keep: bool = True) -> tuple[int, ...] | None:
        """One, two or three available lengths of this sum."""
        if self.left[total] > 0:
            return (total,)
        return self.two(total, keep) or self.three(total, keep)


def plan(counts: np.ndarray, room: int = ROOM) -> list[tuple[int, tuple[int, ...]]]:
    """Steps (times, lengths) that use up counts[length] pieces of each length 1..room.

    Each step is repeated while all its lengths last, so steps are few: every one uses up a length
    or what an exact combination can give.
    """
    left = counts.astype(np.int64).copy()
    steps: list[tuple[int, tuple[int, ...]]] = []

    def use(lengths: tuple[int, ...]) -> None:
        need = np.bincount(lengths, minlength=room + 1)
        some = np.flatnonzero(need)
        times = int((left[some] // need[some]).min())
        left[some] -= times * need[some]
        steps.append((times, lengths))

    sums = Sums(left)
    for longest in range(room, 0, -1):
        while left[longest] > 0:
            if longest == room:
                use((longest,))
                continue
            left[longest] -= 1
            found = sums.exact(room - longest)
            chosen = [longest]
            if found:
                chosen += found
            else:
                gap = room - longest
                taken = left.copy()
                while gap > 0 and (fit := np.flatnonzero(taken[: gap + 1])).size:
                    chosen.append(int(fit[-1]))
                    taken[fit[-1]] -= 1
                    gap -= int(fit[-1])
                    # once a few pieces stand, the rest may close exactly
                    if gap and len(chosen) < 64:
                        keep, left[:] = left.copy(), taken
                        rest = sums.exact(gap, keep=False)
                        left[:] = keep
                        if rest:
                            chosen += rest
                            break
            left[longest] += 1
            use(tuple(chosen))
    return steps


def placed_rows(steps: list[tuple[int, tuple[int, ...]]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Turns the last two columns (length, number among that length) into sequence_id and offset."""
    table: dict[int, list[tuple[int, int, int]]] = {}
    given: dict[int, int] = {}
    sequence = 0
    for times, lengths in steps:
        offset = 0
        for n in lengths:
            table.setdefault(n, []).append((given.get(n, 0), sequence, offset))
            given[n] = given.get(n, 0) + times
            offset += n
        sequence += times
    found = {n: tuple(np.array(x, np.int64) for x in zip(*rows)) for n, rows in table.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(c).to_numpy() for c in ("length", "number"))
            where, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length).tolist():
                rows = np.flatnonzero(length == n)
                begin, seq, off = found[n]
                i = np.searchsorted(begin, number[rows], "right") - 1
                where[rows], offset[rows] = seq[i] + number[rows] - begin[i], off[i]
            names = batch.schema.names[:-1]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(where), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return run


def pack(spark: SparkSession, docs: DataFrame, vocabulary: str, room: int = ROOM) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end token alone. Only documents longer than ``room`` are cut. Repeated
    rows and rows without doc_id are documents of their own. Equal lengths are interchangeable; among
    them pieces are numbered by doc_id and piece. An empty table gives no row. Other columns are not read.
    """
    tune(spark)
    scratch = Scratch(spark)
    pieces = docs.select("doc_id", "text").mapInArrow(piece_rows(vocabulary, room), PIECES)
    pieces = scratch.save(pieces, "pack-pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most room rows
    counted = np.zeros(room + 1, np.int64)
    for length, n in counts.items():
        counted[length] = n
    # a frequent length is numbered in many cells
    parts = spark.createDataFrame([(length, -(-n // CELL_PIECES)) for length, n in counts.items()], "length long, parts long")
    cell = F.pmod(F.xxhash64("doc_id", "piece", "mark"), F.col("parts")).alias("cell")
    pieces = pieces.join(F.broadcast(parts), "length").select("doc_id", "piece", "start", "length", "ids_crc32", cell)
    cells = pieces.groupBy("length", "cell").agg(F.count(F.lit(1)).alias("n"))
    steps = plan(counted, room)
    run = Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    start = cells.select("length", "cell", F.coalesce(F.sum("n").over(run), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "cell").orderBy("doc_id", "piece")
    numbered = pieces.withColumn("at", F.row_number().over(within) - 1).join(start, ["length", "cell"])
    numbered = numbered.select("doc_id", "piece", "start", "ids_crc32", "length", (F.col("at") + F.col("before")).alias("number"))
    out = numbered.mapInArrow(placed_rows(steps), "doc_id long, piece int, start long, ids_crc32 long, length long, sequence_id long, offset long")
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
