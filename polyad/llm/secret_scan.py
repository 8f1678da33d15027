"""Secret scans: fixed patterns, and random strings by token efficiency.

A vocabulary of byte pairs learned from real text spends few characters a token on random strings. Runs
of 20 or more token characters with letters and digits are encoded; a run with fewer than two
characters a token is a secret, unless it is a known kind of digest or identifier. Where the whole run
isn't one, the same is asked of every part of it between separators and of neighbouring parts joined.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import tune

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{32,}")
RUN = re.compile(rb"[A-Za-z0-9+/_=-]{20,}")
STEMS = (b"passw", b"secret", b"token", b"api_key", b"apikey")

#: Digests (by length in hex) and UUIDs: not secrets by themselves.
DIGEST = re.compile(rb"(?:[0-9a-f]+|[0-9A-F]+)\Z")
DIGEST_LENGTHS = {32, 40, 48, 56, 64, 96, 128}
UUID = re.compile(rb"[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}\Z")
LEAST_CHARS_A_TOKEN = 2.0
#: Of digits in hex alone: random ones take 1.66 on average.
HEX_CHARS_A_TOKEN = 2.5
LEAST_CHARS = 20
HEX_RUN = re.compile(rb"[0-9A-Fa-f]{20,}\Z")
PIECE = re.compile(rb"[=/_-]+|[^=/_-]+")
#: Characters encoded at a time: a longer string's tokens are those of its stretches.
STRETCH = 4096
ANY_UUID = re.compile(rb"(?<![^=/_-])[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}(?![^=/_-])")

_encodings: dict[str, object] = {}


def encoding(path: str) -> object:
    """The vocabulary of a .tiktoken file, without special tokens."""
    if path not in _encodings:
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def mixed(s: bytes) -> bool:
    return bool(re.search(rb"[0-9]", s) and re.search(rb"[A-Za-z]", s))


def is_known(s: bytes) -> bool:
    return bool((len(s) in DIGEST_LENGTHS and DIGEST.match(s)) or UUID.match(s))


def excess(s: bytes, path: str) -> float:
    """Characters that a string lacks to be as long as its tokens ask of text: above 0 if it is random."""
    least = HEX_CHARS_A_TOKEN if HEX_RUN.match(s) and mixed(s) else LEAST_CHARS_A_TOKEN
    encode = encoding(path).encode_ordinary
    return least * sum(len(encode(s[k : k + STRETCH].decode())) for k in range(0, len(s), STRETCH)) - len(s)


def random_parts(run: bytes, path: str) -> list[tuple[int, int]]:
    """(start, end) of the random strings in a run of token characters, wherever it stands.

    That is the run itself, or else the joined parts of the most excess, and so on to their left and right.
    Separators are tokens of their own, so the excess of joined parts is the sum of theirs.
    """
    if not mixed(run) or is_known(run):
        return []
    if excess(run, path) > 0:
        return [(0, len(run))]
    uuids = [m.span() for m in ANY_UUID.finditer(run)]
    pieces = [(m.start(), m.end(), m.group()) for m in PIECE.finditer(run)]
    stretches, u = [[]], 0
    for start, end, s in pieces:
        while u < len(uuids) and uuids[u][1] <= start:
            u += 1
        if (u < len(uuids) and uuids[u][0] < end) or is_known(s):
            stretches.append([])
        else:
            stretches[-1].append((start, end, excess(s, path), s[:1] not in b"=/_-", bool(re.search(rb"[0-9]", s)), bool(re.search(rb"[A-Za-z]", s))))
    out = []
    todo = [x for x in stretches if x]
    while todo:
        x = todo.pop()
        if x[-1][1] - x[0][0] < LEAST_CHARS:
            continue
        sums = [0.0]
        for p in x:
            sums.append(sums[-1] + p[2])
        best, low, nxt, digit, letter = (0.0, 0, 0), -1, 0, -1, -1
        for j, p in enumerate(x):
            digit, letter = j if p[4] else digit, j if p[5] else letter
            # starts that leave enough characters, a letter and a digit
            while nxt <= min(digit, letter) and p[1] - x[nxt][0] >= LEAST_CHARS:
                if x[nxt][3] and (low < 0 or sums[nxt] <= sums[low]):
                    low = nxt
                nxt += 1
            if low >= 0 and p[3] and sums[j + 1] - sums[low] > best[0]:
                best = (sums[j + 1] - sums[low], low, j + 1)
        if best[0] > 0:
            _, i, j = best
            out.append((x[i][0], x[j - 1][1]))
            todo += [y for y in (x[:i], x[j:]) if y]
    return sorted(out)


def find(text: bytes, path: str) -> list[tuple[int, int, str, int]]:
    """(start, end, kind, start of the secret itself) in bytes, by start and kind."""
    out = []
    low = text.lower()
    if any(s in low for s in STEMS):
        out += [(m.start(), m.end(), "assign", m.start(2)) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    if b"AKIA" in text:
        out += [(m.start(), m.end(), "access", m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), "hex", m.start()) for m in HEX.finditer(text)]
    base, k = sorted(out), 0
    reach = list(itertools.accumulate((b for _, b, _, _ in base), max))
    for m in RUN.finditer(text):
        # base spans that begin before the run's end; the furthest of their ends tells whether one touches it
        while k < len(base) and base[k][0] < m.end():
            k += 1
        if not k or reach[k - 1] <= m.start():
            out += [(m.start() + a, m.start() + b, "random", m.start() + a) for a, b in random_parts(m.group(), path)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def spans_udf(path: str):
    names = ["n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"]

    @F.arrow_udf("struct<n_assign: bigint, n_access: bigint, n_hex: bigint, n_random: bigint, base_sha256: string, spans: string>")
    def scan(text: pa.Array) -> pa.Array:
        rows = []
        for s in text.cast(pa.large_binary()):
            b = s.as_py() or b""
            found, at, chars = [], 0, 0
            spans = find(b, path)
            place = {}
            for x in sorted({x for s in spans for x in s[:2]}):
                chars += len(b[at:x].decode("utf-8", "replace"))
                at = x
                place[x] = chars
            found = [(f"{kind}:{place[start]}:{place[end]}", kind) for start, end, kind, _ in spans]
            base = ",".join(s for s, kind in found if kind != "random")
            count = [sum(kind == k for _, kind in found) for k in KINDS]
            rows.append((*count, hashlib.sha256(base.encode()).hexdigest(), ",".join(s for s, _ in found)))
        columns = list(zip(*rows)) if rows else [()] * 6
        return pa.StructArray.from_arrays([pa.array(c, pa.int64() if i < 4 else pa.string()) for i, c in enumerate(columns)], names=names)

    return scan


def scan(spark: SparkSession, docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256 and spans of every row.

    A null or empty text has no spans: counts 0, an empty list, and the digest of the empty string. A random
    string that touches a span of a fixed pattern is not listed again. Repeated rows and rows without
    doc_id are scanned like any other; an empty table gives no row. Other columns are not read.
    """
    tune(spark)
    return docs.select("doc_id", spans_udf(vocabulary)("text").alias("s")).select("doc_id", "s.*")


MASK = b"[SECRET]"


def mask(text: bytes, path: str) -> bytes | None:
    """The text with every secret (of an assignment: its value) replaced; None where there is none."""
    parts, at = [], 0
    for a, b in sorted((a, b) for _, b, _, a in find(text, path)):
        if b > at:
            parts += [text[at:a], MASK] if a >= at else []
            at = b
    return b"".join([*parts, text[at:]]) if at else None


def mask_secrets(spark: SparkSession, docs: DataFrame, vocabulary: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark; n_chars, where there is one, follows."""
    tune(spark)

    @F.arrow_udf("string")
    def masked(text: pa.Array) -> pa.Array:
        return pa.array([mask(b, vocabulary) if (b := s.as_py()) else None for s in text.cast(pa.large_binary())], pa.binary()).cast(pa.string())

    name = next(f"_masked{i}" for i in range(99) if f"_masked{i}" not in docs.columns)
    out = docs.withColumn(name, masked(docs["text"]))
    changed = {"text": F.coalesce(F.col(name), F.col("text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col(name).isNotNull(), F.length(name)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.withColumns(changed).drop(name)
