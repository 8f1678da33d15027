"""Elias-Fano coded monotone sequences in memory-mapped files, searched many keys at a time.

A sequence is stored in parts, one for each range of keys, so that tasks build it side by side: every part
is coded by itself, and the parts' words lie one after the other in one file. A value's low bits are
packed; its high part is written in unary, a one for each value and a zero for each step. A directory holds
the number of zeros before every word.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

import numpy as np

U64 = np.uint64
ONE = U64(1)
#: Keys looked up at a time: what stands between the steps of a look-up stays in the processor's cache.
BLOCK = 1 << 14


def low_width(universe: int, n: int) -> int:
    return max(0, (universe // max(n, 1)).bit_length() - 1)


def pack_low(values: np.ndarray, width: int) -> np.ndarray:
    """The lowest ``width`` bits of each value, one after the other, in 64-bit words."""
    if not width or not len(values):
        return np.zeros(0, U64)
    out = []
    for k in range(0, len(values), 1 << 14):
        v = values[k : k + (1 << 14)]
        v = np.concatenate((v, np.zeros(-len(v) % 64, U64)))
        bits = np.unpackbits(v.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :width]
        out.append(np.packbits(bits.ravel(), bitorder="little").view("<u8"))
    return np.concatenate(out).astype(U64)


def encode(values: np.ndarray, width: int, universe: int) -> tuple[np.ndarray, np.ndarray]:
    """Low words and high words of sorted values below ``universe``."""
    high = (values >> U64(width)).astype(np.int64)
    size = (universe >> width) + 1 + len(values)
    bits = np.zeros(size + (-size) % 64, np.uint8)
    bits[high + np.arange(len(values))] = 1
    return pack_low(values, width), np.packbits(bits, bitorder="little").view("<u8").astype(U64)


@dataclass
class Part:
    """A coded range of keys [begin, begin + universe) with n values."""

    begin: int
    universe: int
    n: int
    width: int
    low_words: int
    high_words: int


class Sequence:
    """All parts of one sequence, mapped from ``stem``.low, .high and .zeros."""

    def __init__(self, stem: str) -> None:
        with open(f"{stem}.json") as f:
            parts = [Part(**p) for p in json.load(f)]
        column = lambda name, kind: np.array([getattr(p, name) for p in parts], kind)
        before = lambda x: np.concatenate(([0], np.cumsum(x)))[: len(parts) + 1].astype(np.int64)
        self.begin, self.width = column("begin", U64), column("width", np.int64)
        self.last = np.array([p.universe - 1 for p in parts], U64)
        self.entry, self.low_at, self.high_at = before(column("n", np.int64)), before(column("low_words", np.int64)), before(column("high_words", np.int64))
        self.n = int(self.entry[-1])
        load = lambda end: mapped(f"{stem}.{end}", U64)
        self.low, self.high, self.zeros = load("low"), load("high"), load("zeros")
        # what a look-up asks of a part: its first bit, the zeros before it, its last bucket, and what to add to
        # its bits for entries
        first = self.high_at[:-1]
        self.first_bit, self.zeros_at = first * 64, self.zeros[first].astype(np.int64)
        self.top = (self.high_at[1:] - first) * 64 - np.diff(self.entry) - 1
        self.low_bit = self.low_at[:-1] * 64 - self.entry[:-1] * self.width

    def _select_zero(self, k: np.ndarray) -> np.ndarray:
        """Bit positions of the k-th zeros (from 0) of the high words."""
        word = np.searchsorted(self.zeros, k.view(U64), "right") - 1
        return word * 64 + select_bit(~self.high.take(word, mode="clip"), k - self.zeros.take(word, mode="clip").view(np.int64))

    def _ones_before(self, bit: np.ndarray) -> np.ndarray:
        """How many ones stand without a gap before each bit position; -1 where they fill the bit's word."""
        within = (bit & 63).view(U64)
        gaps = ~self.high.take(bit >> 6, mode="clip") & ((ONE << within) - ONE)
        for shift in (1, 2, 4, 8, 16, 32):
            gaps |= gaps >> U64(shift)
        return np.where(gaps == 0, -1, within.astype(np.int64) - np.bitwise_count(gaps).astype(np.int64))

    def _low_bits(self, bit: np.ndarray, width: np.ndarray) -> np.ndarray:
        """The numbers of ``width`` bits that begin at the given bits of the low words."""
        if not len(self.low):
            return np.zeros(len(bit), U64)
        word, shift = bit >> 6, (bit & 63).view(U64)
        x = self.low.take(word, mode="clip")
        x >>= shift
        word += 1
        y = self.low.take(word, mode="clip")
        y <<= ONE  # in two steps, as a shift by 64 isn't defined
        y <<= U64(63) - shift
        x |= y
        x &= (ONE << width.view(U64)) - ONE
        return x

    def successor(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each key the number of values below it, and whether it is a value itself."""
        at, found = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        for k in range(0, len(keys) if self.n else 0, BLOCK):
            at[k : k + BLOCK], found[k : k + BLOCK] = self._successor(keys[k : k + BLOCK])
        return at, found

    def _successor(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        part = np.maximum(np.searchsorted(self.begin, keys, "right") - 1, 0)
        begin, entry = self.begin.take(part), self.entry.take(part)
        under, rest = keys < begin, keys - begin
        beyond = ~under & (rest > self.last.take(part))  # in a gap between parts
        rest[under | beyond] = 0
        wide = self.width.take(part)
        width = wide.view(U64)
        # zeros before a part: those of all words before it
        bucket = np.minimum((rest >> width).view(np.int64), self.top.take(part))
        zero = self.zeros_at.take(part) + bucket
        shift = self.first_bit.take(part) - entry
        zero_bit = self._select_zero(zero)
        end = zero_bit - shift - bucket
        # a bucket begins where the zero before it stands: mostly in the word of its own zero
        run = self._ones_before(zero_bit)
        start = end - run
        far = np.flatnonzero(run < 0)
        start[far] = entry[far]
        far = far[bucket[far] > 0]
        start[far] = self._select_zero(zero[far] - 1) - shift[far] - (bucket[far] - 1)
        low = rest & ((ONE << width) - ONE)
        found = np.zeros(len(keys), bool)
        lo = start.copy()
        # Within buckets: values are spread evenly, so every other guess is by proportion, the others halve what
        # is left. Columns: row, part's width, its first bit, lo and hi, the values below and above them, key.
        at = np.flatnonzero(start < end)
        wide, bit, a, b, key = (x.take(at) for x in (wide, self.low_bit.take(part), start, end, low))
        under_, over_ = np.zeros(len(at), U64), ONE << wide.view(U64)
        turn = 0
        while len(at):
            if turn & 1:
                mid = (a + b) >> 1
            else:
                mid = np.minimum(a + ((b - a) * ((key - under_) / (over_ - under_))).astype(np.int64), b - 1)
            value = self._low_bits(bit + mid * wide, wide)
            less, same = value < key, value == key
            a, b = np.where(less, mid + 1, a), np.where(less, b, mid)
            on = a < b
            on &= ~same
            lo[at] = np.where(same, mid, a)
            found[at[same]] = True
            go = np.flatnonzero(on)
            under_, over_ = np.where(less, value + ONE, under_), np.where(less, over_, value)
            at, wide, bit, a, b, key, under_, over_ = (x.take(go) for x in (at, wide, bit, a, b, key, under_, over_))
            turn += 1
        lo[beyond] = self.entry[part[beyond] + 1]
        lo[under] = entry[under]
        found &= ~(under | beyond)
        return lo, found

    def access(self, entry: np.ndarray) -> np.ndarray:
        """The values of the given entries."""
        out = np.zeros(len(entry), U64)
        for k in range(0, len(entry), BLOCK):
            out[k : k + BLOCK] = self._access(entry[k : k + BLOCK])
        return out

    def _access(self, entry: np.ndarray) -> np.ndarray:
        part = np.searchsorted(self.entry, entry, "right") - 1
        i, at = entry - self.entry[part], self.high_at[part]
        base = self.zeros[at].astype(np.int64)
        ones = lambda k: (k - at) * 64 - (self.zeros[k].astype(np.int64) - base)
        lo, hi = at.copy(), self.high_at[part + 1] - 1
        while (lo < hi).any():
            mid = (lo + hi + 1) >> 1
            right = ones(mid) <= i
            lo, hi = np.where(right, mid, lo), np.where(right, hi, mid - 1)
        rank, bits, bit = i - ones(lo), self.high[lo].copy(), np.zeros(len(entry), np.int64)
        for half in (32, 16, 8, 4, 2, 1):
            count = np.bitwise_count(bits & U64((1 << half) - 1)).astype(np.int64)
            over = rank >= count
            rank = np.where(over, rank - count, rank)
            bit += over * half
            bits = np.where(over, bits >> U64(half), bits)
        high = ((lo - at) * 64 + bit - i).astype(U64)
        width = self.width[part]
        return self.begin[part] + ((high << width.astype(U64)) | self._low_bits(self.low_at[part] * 64 + (entry - self.entry[part]) * width, width))


    def span(self, a: int, b: int) -> np.ndarray:
        """The values of entries a to b, one after the other."""
        out = [np.zeros(0, U64)]
        for i in range(int(np.searchsorted(self.entry, a, "right")) - 1, len(self.begin)):
            first, n = int(self.entry[i]), int(self.entry[i + 1] - self.entry[i])
            if first >= b:
                break
            values = decode(self.low[self.low_at[i] : self.low_at[i + 1]], self.high[self.high_at[i] : self.high_at[i + 1]], int(self.width[i]), n)
            out.append(values[max(a - first, 0) : b - first] + self.begin[i])
        return np.concatenate(out)


_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
#: Position of the k-th one in each byte.
_IN_BYTE = np.array([[*np.flatnonzero(b), *[0] * 8][:8] for b in _BYTE], np.int64)
_SPREAD, _HIGH = U64(0x0101010101010101), U64(0x8080808080808080)


def select_bit(bits: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The position of the k-th one (from 0) of each word, by byte sums."""
    s = bits - ((bits >> U64(1)) & U64(0x5555555555555555))
    s = (s & U64(0x3333333333333333)) + ((s >> U64(2)) & U64(0x3333333333333333))
    s = ((s + (s >> U64(4))) & U64(0x0F0F0F0F0F0F0F0F)) * _SPREAD
    # bytes whose sum up to their end is at most k
    over = ((k.astype(U64) * _SPREAD) | _HIGH) - s
    shift = np.minimum(np.bitwise_count(over & _HIGH), 7).astype(U64) << U64(3)
    before = ((s << U64(8)) >> shift) & U64(0xFF)
    byte = ((bits >> shift) & U64(0xFF)).astype(np.int64)
    return shift.astype(np.int64) + _IN_BYTE[byte, np.minimum(k - before.astype(np.int64), 7)]


def decode(low: np.ndarray, high: np.ndarray, width: int, n: int) -> np.ndarray:
    """The n values of a coded part, less its begin."""
    ones = np.flatnonzero(np.unpackbits(np.asarray(high).view(np.uint8), bitorder="little"))[:n]
    out = (ones - np.arange(n)).astype(U64) << U64(width)
    if width:
        for k in range(0, n, 1 << 14):
            m = min(1 << 14, n - k)
            words = np.asarray(low[k * width // 64 : ((k + m) * width + 63) // 64])
            bits = np.unpackbits(words.view(np.uint8), bitorder="little")[: m * width].reshape(m, width)
            out[k : k + m] |= np.packbits(np.pad(bits, ((0, 0), (0, 64 - width))), axis=1, bitorder="little").view("<u8").ravel()
    return out


def mapped(path: str, kind: type) -> np.ndarray:
    """A file's numbers, mapped into memory; a plain view, which is read faster than a memmap's own."""
    return np.asarray(np.memmap(path, kind, "r")) if os.path.getsize(path) else np.zeros(0, kind)


def write_part(path: str, begin: int, universe: int, values: np.ndarray) -> dict:
    """Codes one part (sorted values, less ``begin``) into path.low, path.high and path.zeros; its description."""
    width = low_width(universe, len(values))
    low, high = encode(values, width, universe)
    save(f"{path}.low", low)
    save(f"{path}.high", high)
    zeros = 64 - np.bitwise_count(high).astype(np.int64)
    save(f"{path}.zeros", (np.cumsum(zeros) - zeros).astype(U64))
    return vars(Part(int(begin), int(universe), len(values), width, len(low), len(high)))


def save(path: str, values: np.ndarray) -> None:
    """All or nothing, and the same for every attempt of a task."""
    temporary = f"{path}.{os.getpid()}.{os.urandom(4).hex()}"
    values.tofile(temporary)
    os.replace(temporary, path)
