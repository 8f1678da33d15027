"""Language-model scores from an Elias-Fano n-gram trie.

Level 1 holds the words (sorted hashes), level 2 the successors of each word, level 3 the successors of
each pair. Monotone pointers tell where on level 2 the successors of each word begin; a word of level 3 is
stored by its rank among the successors of the word before it, so keys are small. Levels and pointers are
Elias-Fano sequences in memory-mapped files of the shared folder, with counts on levels 1 and 2 and
smoothed, quantised log probabilities on levels 2 and 3. Smoothing is by a Dirichlet prior: the counts of a
context plus the next lower order's distribution as some occurrences more, so a context needs no more than
its total. That of a pair is its count, since every text ends with a token that begins no context. Each
level's prior is the one of GRID under which all its training tokens are likeliest, each left out of the counts.

Counting runs in sorted blocks of integers: each task counts what it reads and sends, for every range of
keys, one block; a range's task merges them and writes its part of the level. Ranges are as many as tokens
ask for, and cut where they are frequent, so a frequent word's successors are shared among several. All
pairs and triples are stored, all counts are exact.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .elias_fano import Sequence, decode, mapped, save, write_part
from .runtime import new_path, tune
from .textvec import U64, Texts, mix, slices

#: Priors to choose from.
GRID = 2.0 ** np.arange(-2, 13)
#: log10 probabilities from -12 to 0 in 255 steps.
STEP = 12 / 255
#: Distinct keys a task holds before it sends them; tokens a range is made for; bytes of text treated at a time.
HELD, RANGE_TOKENS, SLICE = 1_500_000, 6_000_000, 1 << 22

END = mix(np.array([0x456E64], U64))[0]


def held_out(doc_id: Column) -> Column:
    """The fold that nothing is learned from; rows without id aren't in it."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 1, F.lit(False))


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's words and its end, and the texts' limits in them."""
    t = Texts(column, lower=True).split()
    limits = t.word_off + np.arange(t.n + 1)
    out = np.full(limits[-1], END, U64)
    if len(t.starts):
        out[np.arange(len(t.starts)) + t.doc_of_word()] = t.word_hashes()
    return out, limits


def squeeze(keys: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted keys as differences, byte planes apart, so that compression finds the zeros."""
    planes = lambda x: x.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()
    return planes(np.diff(keys, prepend=U64(0))), planes(counts)


def unsqueeze(keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = lambda b: np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view("<u8").ravel()
    return np.cumsum(planes(keys).astype(U64), dtype=U64), planes(counts).astype(np.int64)


def merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    return k[first], np.add.reduceat(c, first) if len(k) else c


class Level:
    """One level of a trie on disk: its sequence and what is stored beside each entry."""

    def __init__(self, folder: str, level: int) -> None:
        self.sequence = Sequence(f"{folder}/{level}")
        self.pointers = Sequence(f"{folder}/{level}.ptr") if level == 2 else None
        with open(f"{folder}/{level}.kinds.json") as f:
            self.beside = {name: mapped(f"{folder}/{level}.{name}", np.dtype(kind)) for name, kind in json.load(f).items()}


class Trie:
    """The levels built so far, and the look-ups they allow."""

    def __init__(self, folder: str, levels: int) -> None:
        with open(f"{folder}/totals-{levels}.json") as f:
            self.total = json.load(f)
        self.levels = [Level(folder, i) for i in range(1, levels + 1)]

    def words(self, hashes: np.ndarray) -> np.ndarray:
        """Word ids, -1 for words that were not seen."""
        distinct, which = np.unique(hashes, return_inverse=True)
        at, found = self.levels[0].sequence.successor(distinct)
        return np.where(found, at, -1)[which]

    def pairs(self, ids: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each token its pair's place on level 2 (with the token before; -1: none), and the pair's
        rank among the successors of that token."""
        place, rank = np.full(len(ids), -1, np.int64), np.zeros(len(ids), np.int64)
        at = np.flatnonzero(inner & (ids >= 0) & (np.concatenate(([-1], ids[:-1])) >= 0))
        if not len(at):
            return place, rank
        size = self.total["words"]
        distinct, which = np.unique(ids[at - 1].astype(U64) * U64(size) + ids[at].astype(U64), return_inverse=True)
        pos, found = self.levels[1].sequence.successor(distinct)
        before, group = np.unique(distinct // U64(size), return_inverse=True)
        start = self.levels[1].pointers.access(before.astype(np.int64)).astype(np.int64)
        place[at] = np.where(found, pos, -1)[which]
        rank[at] = (pos - start[group])[which]
        return place, rank

    def triple_keys(self, place: np.ndarray, rank: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens whose two pairs are known, and the triples' keys."""
        before = np.concatenate(([-1], place[:-1]))
        at = np.flatnonzero(inner & (place >= 0) & (before >= 0))
        return at, (before[at].astype(U64) << U64(self.total["rank_bits"])) | rank[at].astype(U64)

    def unigram(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts and probabilities of words by id."""
        count = np.where(ids >= 0, self.levels[0].beside["count"][np.maximum(ids, 0)] if self.total["words"] else 0, 0).astype(np.float64)
        return count, (count + 0.5) / (self.total["tokens"] + 0.5 * (self.total["words"] + 1))


    def context_and_lower(self, level: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For sorted keys of a level: occurrences of their contexts, and probabilities under the lower order."""
        if level == 2:
            size = U64(self.total["words"])
            return self.unigram((keys // size).astype(np.int64))[0], self.unigram((keys % size).astype(np.int64))[1]
        bits = U64(self.total["rank_bits"])
        pair, rank = (keys >> bits).astype(np.int64), (keys & ((U64(1) << bits) - U64(1))).astype(np.int64)
        if not len(pair):
            return np.zeros(0), np.zeros(0)
        # the pair of the last two words, found through the middle word's pointer
        first = int(pair[0])
        middle, which = np.unique((self.levels[1].sequence.span(first, int(pair[-1]) + 1) % U64(self.total["words"])).astype(np.int64), return_inverse=True)
        start = self.levels[1].pointers.access(middle).astype(np.int64)[which]
        return self.levels[1].beside["count"][pair].astype(np.float64), VALUES[self.levels[1].beside["code"][start[pair - first] + rank]]


def code_of(p: np.ndarray) -> np.ndarray:
    return np.clip(np.round((np.log10(p) + 12) / STEP), 0, 255).astype(np.uint8)


VALUES = 10.0 ** (np.arange(256) * STEP - 12)


def left_out(counts: np.ndarray, context: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """For each prior of GRID the log likelihood of a level's tokens, each without its own occurrence."""
    c, n, q = (x.astype(np.float32) for x in (counts - 1, context - 1, lower))
    return np.array([float((counts * (np.log(c + np.float32(m) * q) - np.log(n + np.float32(m)))).sum(dtype=np.float64)) for m in GRID])


_open: dict[tuple[str, int], Trie] = {}


def opened(folder: str, levels: int) -> Trie:
    if (folder, levels) not in _open:
        _open.clear()
        _open[folder, levels] = Trie(folder, levels)
    return _open[folder, levels]


def keys_of(folder: str, level: int, column: pa.Array) -> np.ndarray:
    """What level ``level`` counts in some texts."""
    hashes, limits = tokens(column)
    if level == 1:
        return hashes
    trie = opened(folder, level - 1)
    inner = np.ones(len(hashes), bool)
    inner[limits[:-1]] = False
    ids = trie.words(hashes)
    if level == 2:
        at = np.flatnonzero(inner)
        return ids[at - 1].astype(U64) * U64(trie.total["words"]) + ids[at].astype(U64)
    place, rank = trie.pairs(ids, inner)
    return trie.triple_keys(place, rank, inner & np.concatenate(([False], inner[:-1])))[1]


def counted_rows(folder: str, level: int, cuts: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks (part, keys, counts) of documents (text); part i holds keys from cuts[i] on."""

    def flush(keys: list[np.ndarray], counts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        k, c = merge(keys, counts)
        to = np.searchsorted(k, cuts[1:])
        for i, (a, b) in enumerate(zip([0, *to.tolist()], [*to.tolist(), len(k)])):
            if a < b:
                x, y = squeeze(k[a:b], c[a:b])
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([x], pa.binary()), pa.array([y], pa.binary())], names=["part", "keys", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                k, c = np.unique(keys_of(folder, level, part.column("text")), return_counts=True)
                keys.append(k)
                counts.append(c)
                held += len(k)
                if held > 2 * HELD:
                    k, c = merge(keys, counts)
                    if len(k) > HELD:
                        yield from flush([k], [c])
                        keys, counts, held = [], [], 0
                    else:
                        keys, counts, held = [k], [c], len(k)
        if held:
            yield from flush(keys, counts)

    return run


BLOCKS = "part int, keys binary, counts binary"


def built_rows(folder: str, level: int, cuts: np.ndarray, end: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Merges the blocks of parts and writes them; (part, about): about tells what is written, as JSON.

    marks: stretches of the part as (first key on level 1, else first entry; entries; occurrences), a frequent
    entry by itself, from which the next level's cuts follow.
    """

    def write(i: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        begin, last = int(cuts[i]), int(cuts[i + 1]) if i + 1 < len(cuts) else end
        path = f"{folder}/{level}-{i}"
        about = {"part": write_part(path, begin, max(last - begin, 1), keys - U64(begin)), "total": int(counts.sum()), "most": int(counts.max(initial=0))}
        about["kind"] = np.min_scalar_type(about["most"]).str
        save(f"{path}.count", counts.astype(about["kind"]))
        if level == 2:
            about["ptr"] = write_pointers(path, begin, last, opened(folder, 1).total["words"], keys)
        if level > 1:
            about["left_out"] = left_out(counts, *opened(folder, level - 1).context_and_lower(level, keys)).tolist()
        if level < 3:
            weight = np.where(keys == END, 0, counts) if level == 1 else counts  # nothing follows an end
            upto = np.cumsum(weight)
            at = np.searchsorted(upto, np.linspace(0, upto[-1], 64, endpoint=False), "right") if len(keys) else np.zeros(0, np.int64)
            edge = np.unique(np.concatenate(([0], at, at + 1, [len(keys)])))
            edge = edge[edge <= len(keys)]
            about["marks"] = [[int(a), int(b - a), int(weight[a:b].sum())] for a, b in zip(edge[:-1], edge[1:])]
        return pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([json.dumps(about)])], names=["part", "about"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, counts = -1, [], []
        for batch in batches:
            for i, k, c in zip(*(batch.column(x).to_pylist() for x in ("part", "keys", "counts"))):
                if i != now and keys:
                    yield write(now, *merge(keys, counts))
                    keys, counts = [], []
                now = i
                k, c = unsqueeze(k, c)
                keys.append(k)
                counts.append(c)
                if len(keys) > 16 and sum(map(len, keys[1:])) > len(keys[0]):
                    k, c = merge(keys, counts)
                    keys, counts = [k], [c]
        if keys:
            yield write(now, *merge(keys, counts))

    return run


def write_pointers(path: str, begin: int, end: int, words: int, keys: np.ndarray) -> dict:
    """For the words whose first possible key is in [begin, end): where among the keys their successors begin."""
    first = np.arange(-(-begin // max(words, 1)), -(-end // max(words, 1)), dtype=U64) * U64(words)
    return write_part(f"{path}.ptr", 0, len(keys) + 1, np.searchsorted(keys, first).astype(U64))


def settled_rows(folder: str, level: int, kind: str, prior: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Puts parts (their plan as JSON) where they belong in the level's files, with the probabilities under the
    prior; any attempt writes the same."""

    def put(target: str, at: int, data: np.ndarray) -> None:
        with open(f"{folder}/{target}", "r+b") as f:
            f.seek(at * data.itemsize)
            f.write(memoryview(np.ascontiguousarray(data)).cast("B"))

    def sequence(source: str, target: str, p: dict, at: dict) -> None:
        for name, rise in (("low", 0), ("high", 0), ("zeros", at["zeros"])):
            data = np.fromfile(f"{folder}/{source}.{name}", U64)
            put(f"{target}.{name}", at["low" if name == "low" else "high"], data + U64(rise) if rise else data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.column("plan").to_pylist():
                plan = json.loads(row)
                source, p, at = f"{level}-{plan['i']}", plan["part"], plan["at"]
                if "ptr" in plan:
                    sequence(f"{source}.ptr", f"{level}.ptr", plan["ptr"], plan["ptr_at"])
                if p is None:
                    continue
                sequence(source, str(level), p, at)
                counts = np.fromfile(f"{folder}/{source}.count", plan["kind"])
                if level < 3:
                    put(f"{level}.count", at["n"], counts.astype(kind))
                if level > 1:
                    keys = decode(np.fromfile(f"{folder}/{source}.low", U64), np.fromfile(f"{folder}/{source}.high", U64), p["width"], p["n"]) + U64(p["begin"])
                    context, lower = opened(folder, level - 1).context_and_lower(level, keys)
                    put(f"{level}.code", at["n"], code_of((counts + prior * lower) / (context + prior)))
            yield batch.slice(0, 0)

    return run


def _places(parts: list[dict | None]) -> list[dict]:
    """Where each part's words, entries and zeros begin."""
    at, out = {"low": 0, "high": 0, "n": 0, "zeros": 0}, []
    for p in parts:
        out.append(dict(at))
        if p:
            at = {"low": at["low"] + p["low_words"], "high": at["high"] + p["high_words"], "n": at["n"] + p["n"], "zeros": at["zeros"] + 64 * p["high_words"] - p["n"]}
    return [*out, at]


def _build(spark: SparkSession, docs: DataFrame, folder: str, level: int, cuts: np.ndarray, end: int) -> tuple[list[dict], float]:
    """Counts, writes and settles one level; what its parts tell, and the prior."""
    blocks = docs.mapInArrow(counted_rows(folder, level, cuts), BLOCKS)
    spread = blocks.repartitionById(len(cuts), F.col("part")).sortWithinPartitions("part")
    rows = {r["part"]: json.loads(r["about"]) for r in spread.mapInArrow(built_rows(folder, level, cuts, end), "part int, about string").collect()}
    found = [rows[i] for i in sorted(rows)]
    prior = float(GRID[int(np.sum([r["left_out"] for r in found], 0).argmax())]) if level > 1 and found else 1.0
    kind = np.min_scalar_type(max((r["most"] for r in found), default=0)).str
    places = dict(zip([*sorted(rows), None], _places([rows[i]["part"] for i in sorted(rows)])))
    files = {f"{level}.{name}": places[None][name if name == "low" else "high"] * 8 for name in ("low", "high", "zeros")}
    if level < 3:
        files[f"{level}.count"] = places[None]["n"] * np.dtype(kind).itemsize
    if level > 1:
        files[f"{level}.code"] = places[None]["n"]
    plans = {i: {"i": i, "part": r["part"], "at": places[i], "kind": r["kind"]} for i, r in rows.items()}
    if level == 2:
        # a range without pairs still has words to point for
        words = opened(folder, 1).total["words"]
        ends = [*map(int, cuts[1:]), end if words else 0]
        pointers = [rows[i]["ptr"] if i in rows else write_pointers(f"{folder}/2-{i}", int(cuts[i]), ends[i], words, np.zeros(0, U64)) for i in range(len(cuts))]
        at, entries = _places(pointers), 0
        for i, p in enumerate(pointers):
            p["begin"], entries = entries, entries + (rows[i]["part"]["n"] if i in rows else 0)
            plans[i] = plans.get(i, {"i": i, "part": None, "at": None}) | {"ptr": p, "ptr_at": at[i]}
        files |= {f"2.ptr.{name}": at[-1][name if name == "low" else "high"] * 8 for name in ("low", "high", "zeros")}
        with open(f"{folder}/2.ptr.json", "w") as f:
            json.dump(pointers, f)
    for name, size in files.items():
        with open(f"{folder}/{name}", "wb") as f:
            f.truncate(size)
    with open(f"{folder}/{level}.json", "w") as f:
        json.dump([r["part"] for r in found], f)
    with open(f"{folder}/{level}.kinds.json", "w") as f:
        json.dump({1: {"count": kind}, 2: {"count": kind, "code": "|u1"}, 3: {"code": "|u1"}}[level], f)
    if plans:
        table = spark.createDataFrame([(json.dumps(p),) for p in plans.values()], "plan string").repartition(len(plans))
        table.mapInArrow(settled_rows(folder, level, kind, prior), "plan string").collect()
        for name in os.listdir(folder):
            if name.startswith(f"{level}-"):
                os.remove(f"{folder}/{name}")
    return found, prior


def _cuts(marks: list[list[int]], parts: int, key_at: Callable[[int, int, float], int]) -> np.ndarray:
    """Keys that part the marks' weight evenly; the first is 0. key_at: (first entry, entries, share within them)."""
    weight = np.array([m[2] for m in marks], np.float64)
    if not weight.sum():
        return np.zeros(1, U64)
    edge = np.concatenate(([0], np.cumsum(weight)))
    goal = np.linspace(0, edge[-1], parts + 1)[1:-1]
    at = np.clip(np.searchsorted(edge, goal, "right") - 1, 0, len(marks) - 1)
    share = np.clip((goal - edge[at]) / np.maximum(weight[at], 1e-9), 0, 1)
    return np.array(sorted({0, *(key_at(marks[i][0], marks[i][1], s) for i, s in zip(at.tolist(), share.tolist()))}), U64)


def _all_marks(rows: list[dict]) -> list[list[int]]:
    """The marks of all parts, entries counted from the level's first."""
    out, base = [], 0
    for r in rows:
        out += [[base + m[0], m[1], m[2]] for m in r["marks"]]
        base += r["part"]["n"]
    return out


def local(path: str) -> str:
    """The shared folder as tasks see it: it must be mounted, since levels are memory-mapped."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError(f"spark.checkpoint.dir must be a mounted folder, not {path}")
    return path


def build(spark: SparkSession, docs: DataFrame) -> str:
    """Counts the documents (text) and writes a trie of three levels; its folder."""
    tune(spark)
    url = new_path(spark, "trie")
    folder = local(url)
    os.makedirs(folder)
    docs = docs.select("text")
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total: dict[str, int | float] = {}

    def note(level: int, **found: int | float) -> None:
        total.update(found)
        with open(f"{folder}/totals-{level}.json", "w") as f:
            json.dump(total, f)

    parts = max(least, docs.rdd.getNumPartitions() // 2)
    rows, _ = _build(spark, docs, folder, 1, np.array([(i << 64) // parts for i in range(parts)], U64), 1 << 64)
    size, n = sum(r["part"]["n"] for r in rows), sum(r["total"] for r in rows)
    if size >= 1 << 32:
        raise OverflowError(f"{size} distinct words: two of them don't fit into 64 bits")
    most = max((r["most"] for r in rows), default=0)
    note(1, words=size, tokens=n)
    parts = max(least, -(-n // RANGE_TOKENS))
    # pairs of a word are as many as its occurrences; a frequent word alone in its mark is cut by successor
    after = lambda a, k, s: (a + int(s * k)) * size if k > 1 else a * size + int(s * size)
    rows, prior = _build(spark, docs, folder, 2, _cuts(_all_marks(rows), parts, after), max(size * size, 1))
    pairs = sum(r["part"]["n"] for r in rows)
    # a word has at most as many successors as it occurs, and as there are words
    bits = min(size, most).bit_length()
    if pairs << bits >= 1 << 64:
        raise OverflowError(f"{pairs} distinct pairs of {size} words: three words don't fit into 64 bits")
    note(2, pairs=pairs, rank_bits=bits, pair_prior=prior)
    rows, prior = _build(spark, docs, folder, 3, _cuts(_all_marks(rows), parts, lambda a, k, s: (a + int(s * k)) << bits), max(pairs, 1) << bits)
    note(3, triples=sum(r["part"]["n"] for r in rows), triple_prior=prior)
    return url


def score_rows(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of (doc_id, held_out, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                trie = opened(folder, 3)
                hashes, limits = tokens(part.column("text"))
                inner = np.ones(len(hashes), bool)
                inner[limits[:-1]] = False
                ids = trie.words(hashes)
                count, p1 = trie.unigram(ids)
                place, rank = trie.pairs(ids, inner)
                before = np.concatenate(([0.0], count[:-1]))
                pair_prior, triple_prior = trie.total["pair_prior"], trie.total["triple_prior"]
                prior = np.where(inner, pair_prior / (before + pair_prior), 1.0)
                code = trie.levels[1].beside["code"]
                p = np.where(place >= 0, VALUES[code[np.maximum(place, 0)]] if len(code) else 0, prior * p1)
                inner2 = inner & np.concatenate(([False], inner[:-1]))
                context = np.concatenate(([-1], place[:-1]))
                at = np.flatnonzero(inner2 & (context >= 0))
                if len(at):
                    total = trie.levels[1].beside["count"][context[at]].astype(np.float64)
                    p[at] *= triple_prior / (total + triple_prior)
                    at, keys = trie.triple_keys(place, rank, inner2)
                    keys, which = np.unique(keys, return_inverse=True)
                    where, known = trie.levels[2].sequence.successor(keys)
                    stored = trie.levels[2].beside["code"]
                    known &= len(stored) > 0
                    hit = known[which]
                    p[at[hit]] = VALUES[stored[where[which][hit]]]
                sums = lambda x: np.add.reduceat(x, limits[:-1])
                n = np.diff(limits)
                arrays = [n, sums((count > 0).astype(np.int64)), np.full(len(n), trie.total["tokens"], np.int64), sums(np.log10(p1)), sums(np.log10(p))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), *map(pa.array, arrays)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    A null or empty text is its end token alone. Repeated rows count each time they stand; rows without
    doc_id are learned from. With nothing to learn from every token has the probability 1 of the one unknown
    word. An empty table gives no row. Other columns are not read.
    """
    folder = build(spark, docs.filter(~held_out(F.col("doc_id"))))
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(score_rows(local(folder)), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
