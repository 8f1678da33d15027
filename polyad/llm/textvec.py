"""Words of many texts at once: numpy over the UTF-8 bytes of an Arrow column.

Words are maximal runs of bytes other than U+0020 and U+0009 to U+000D. Those bytes never occur
inside a multi-byte character, so no text is decoded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of text treated at a time; a longer text is a slice of its own. Bytes hashed at a time: what stands
#: between the steps stays in the processor's cache.
SLICE_BYTES, HASH_BYTES = 1 << 20, 1 << 15

_rng = np.random.default_rng(20_24_11)
_CODE = _rng.integers(1, 1 << 63, 256, dtype=U64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def _power_tables() -> tuple[np.ndarray, np.ndarray]:
    """HASH_BYTES + 1 powers of the base and of its inverse modulo 2**64."""
    if not _powers:
        for base in (_BASE, _INVERSE):
            out = np.full(HASH_BYTES + 1, base, U64)
            out[0] = 1
            np.multiply.accumulate(out, out=out)
            _powers.append(out)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Texts:
    """The bytes of several texts, their limits, and on demand their words."""

    def __init__(self, column: pa.Array, lower: bool = False) -> None:
        column = pc.fill_null(column, "").cast(pa.large_string())
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        n = len(column)
        _, limits, data = column.buffers()
        off = np.frombuffer(limits, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
        self.n, self.off = n, off - off[0]
        self.data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
        if lower:
            self.data = LOWER[self.data]

    def split(self, separators: np.ndarray = SPACE) -> Texts:
        """Fills starts, ends (of words in the bytes) and word_off (of texts in the words)."""
        word = ~separators[self.data]
        before, after = np.zeros(len(word), bool), np.zeros(len(word), bool)
        before[1:], after[:-1] = word[:-1], word[1:]
        full = self.off[1:] > self.off[:-1]
        before[self.off[:-1][full]] = False
        after[self.off[1:][full] - 1] = False
        self.is_word = word
        self.starts = np.flatnonzero(word & ~before)
        self.ends = np.flatnonzero(word & ~after) + 1
        self.word_off = np.searchsorted(self.starts, self.off)
        return self

    def _sums_at(self, *places: np.ndarray) -> list[np.ndarray]:
        """Sums of code times power of the base over the bytes before each place; places rise."""
        power, _ = _power_tables()
        out, total, size = [np.zeros(len(at), U64) for at in places], U64(0), len(self.data)
        for begin in range(0, size + 1, HASH_BYTES):
            end = min(begin + HASH_BYTES, size + 1)
            scale = U64(pow(_BASE, begin, 1 << 64))
            piece = _CODE.take(self.data[begin:end])
            piece *= power[: len(piece)]
            local = np.zeros(len(piece) + 1, U64)
            np.cumsum(piece, out=local[1:])
            local *= scale
            local += total
            for at, sums in zip(places, out):
                a, b = np.searchsorted(at, (begin, end))
                sums[a:b] = local.take(at[a:b] - begin)
            total = local[-1]
        return out

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte ranges; equal bytes give equal hashes wherever they stand. Both limits rise."""
        _, inverse = _power_tables()
        with np.errstate(over="ignore"):
            before, out = self._sums_at(starts, ends)
            out -= before
            for begin in range(0, len(self.data) + 1, HASH_BYTES):
                a, b = np.searchsorted(starts, (begin, begin + HASH_BYTES))
                out[a:b] *= inverse.take(starts[a:b] - begin) * U64(pow(_INVERSE, begin, 1 << 64))
        return mix(out + (ends - starts).astype(U64))

    def word_hashes(self) -> np.ndarray:
        return self.hashes(self.starts, self.ends)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), np.diff(self.word_off))

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each text have the flag."""
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return total[self.off[1:]] - total[self.off[:-1]]

    def word_bytes(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def windows(hashes: np.ndarray, docs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words of one text, and the positions of their first words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    at = np.flatnonzero(docs[:n] == docs[k - 1 :])
    out = hashes[at]
    for j in range(1, k):
        out = mix(out * U64(0x9E3779B97F4A7C15) + hashes[at + j])
    return out, at


def in_text(hashes: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Keys equal only for equal hashes in the same text."""
    return mix(hashes ^ mix(docs.astype(U64) + U64(0x51ED2701)))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts whose texts hold about ``limit`` bytes; together they are the whole batch."""
    if not batch.num_rows:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + limit, "right")))
        yield batch.slice(at, to - at)
        at = to
