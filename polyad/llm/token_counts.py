"""Token counts through a digest cache.

Contents are joined by digest, together with the digest of the tokenizer's file, to the counts stored so
far. Of every content that is missing one row is encoded; its count is appended to the cache. The content
is the text as it stands (null: empty): any other normalisation could change a count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import Scratch, new_path, tune
from .textvec import U64, Texts, slices

CACHE = "digest binary, tokenizer string, n_bytes long, n_tokens long"
LIMIT = 4096


def tokenizer_version(path: str) -> str:
    """Digest of the vocabulary file and of the library that reads it."""
    library = __import__("sentencepiece" if path.endswith(".model") else "tokenizers")
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + f"{library.__name__} {library.__version__}".encode()).hexdigest()


def content_digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


class PieceCounter:
    """Token counts under a SentencePiece BPE model whose pieces hold white space only in front.

    No piece then crosses from a word to the space after it, and a line feed that no piece holds parts
    tokens as well. A text of words set apart by single spaces or line feeds is the sum of its words, each
    distinct one encoded once by the library and remembered under its 64-bit hash. Every other text
    (double, leading or trailing separators, carriage returns, the space mark itself) is encoded whole.
    """

    most = 2_000_000

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        bpe = all("▁" not in p.lstrip("▁") and "\n" not in p for p in pieces)
        probe = self.model.encode("a\nb  c") == self.model.encode("a") + self.model.encode("\nb")[1:] + self.model.encode(" c")
        self.by_words = bpe and probe
        self.keys, self.counts = np.zeros(0, U64), np.zeros(0, np.int32)

    def _count(self, texts: list[str]) -> np.ndarray:
        return np.fromiter(map(len, self.model.encode(texts, num_threads=1)), np.int64, len(texts))

    def __call__(self, column: pa.Array) -> np.ndarray:
        t = Texts(column)
        out = np.zeros(t.n, np.int64)
        if not self.by_words:
            return self._count([x or "" for x in column.to_pylist()])
        separator = np.zeros(256, bool)
        separator[[10, 32]] = True
        t.split(separator)
        data, off = t.data, t.off
        mark = np.zeros(len(data), bool)
        mark[: len(data) - 2] = (data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81) if len(data) > 2 else False
        mark |= data == 13
        mark |= data == 0
        n_words, n_gaps = np.diff(t.word_off), t.per_text(~t.is_word)
        # single separators between words only: one gap fewer than words
        plain = (n_words > 0) & (n_gaps == n_words - 1) & (t.per_text(mark) == 0)
        filled = off[1:] > off[:-1]
        for edge in (off[:-1][filled], off[1:][filled] - 1):
            plain[np.flatnonzero(filled)[~t.is_word[edge]]] = False
        gaps = np.concatenate(([0], np.cumsum(~t.is_word)))
        between = gaps[t.starts[1:]] - gaps[t.ends[:-1]] if len(t.starts) else np.zeros(0, np.int64)
        # the gap in front of each word but a text's first must be one byte
        wide = np.zeros(len(t.starts), bool)
        wide[1:] = between > 1
        first = np.zeros(len(t.starts), bool)
        first[t.word_off[:-1][n_words > 0]] = True
        bad = np.concatenate(([0], np.cumsum(wide & ~first)))
        plain &= bad[t.word_off[1:]] == bad[t.word_off[:-1]]
        if (whole := np.flatnonzero(~plain)).size:
            out[whole] = self._count([x or "" for x in column.take(pa.array(whole)).to_pylist()])
        docs = t.doc_of_word()
        use = np.flatnonzero(plain[docs]) if len(docs) else docs
        starts, ends = t.starts[use], t.ends[use]
        line = ~first[use] & (data[np.maximum(starts, 1) - 1] == 10)
        keys = t.hashes(np.where(line, starts - 1, starts), ends)
        distinct, at, which = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.keys) > self.most:
            self.keys, self.counts = np.zeros(0, U64), np.zeros(0, np.int32)
        place = np.searchsorted(self.keys, distinct)
        ok = place < len(self.keys)
        ok[ok] = self.keys[place[ok]] == distinct[ok]
        if (new := np.flatnonzero(~ok)).size:
            i = at[new]
            words = [("\n" if f else "") + data[a:b].tobytes().decode() for f, a, b in zip(line[i], starts[i], ends[i])]
            # "\nword" gives the space mark in front, the line feed and the word; the mark isn't in the text
            counts = self._count(words) - line[i]
            self.keys = np.insert(self.keys, place[new], distinct[new])
            self.counts = np.insert(self.counts, place[new], counts)
            place = np.searchsorted(self.keys, distinct)
        each = self.counts[place][which] if len(distinct) else np.zeros(0, np.int64)
        return out + np.bincount(docs[use], each, t.n).astype(np.int64)


class JsonCounter:
    """Token counts under a tokenizers file, each text whole; special strings as the library's default."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def __call__(self, column: pa.Array) -> np.ndarray:
        return np.array([len(e.ids) for e in self.tokenizer.encode_batch_fast([x or "" for x in column.to_pylist()], add_special_tokens=False)], np.int64)


_counters: dict[str, PieceCounter | JsonCounter] = {}


def count_rows(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _counters:
            _counters[path] = (PieceCounter if path.endswith(".model") else JsonCounter)(path)
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("digest"), part.column("n_bytes"), pa.array(_counters[path](part.column("text")))], names=["digest", "n_bytes", "n_tokens"])

    return run


def count_tokens(spark: SparkSession, docs: DataFrame, vocabulary: str, cache_path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit of every row.

    ``cache_path``: a Parquet folder that keeps counts from call to call (one writer at a time); None: a new
    one for this call. A null or empty text has no bytes and the count of the empty text. Repeated rows
    and rows without doc_id are counted like any other. An empty table gives no row and appends nothing.
    Other columns are not read.

    Texts cross the network once at most: a row is chosen for each missing digest by (doc_id, digest) from a
    narrow table, and only the chosen rows' texts are encoded. Rows with equal doc_id and digest hold one
    text; of them the encoding partition keeps one.
    """
    tune(spark)
    scratch = Scratch(spark)
    version = tokenizer_version(vocabulary)
    cache_path = cache_path or new_path(spark, "token-cache")
    spark.createDataFrame([], CACHE).write.mode("append").parquet(cache_path)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), content_digest(F.col("text")).alias("digest"), "text")
    light = scratch.save(rows.select("doc_id", "digest", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")), "token-digests")
    known = spark.read.schema(CACHE).parquet(cache_path).filter(F.col("tokenizer") == version).select("digest")
    misses = light.groupBy("digest").agg(F.min(F.coalesce("doc_id", F.lit(-(2**63)))).alias("id")).join(known, "digest", "left_anti")
    chosen = (
        rows.withColumn("id", F.coalesce("doc_id", F.lit(-(2**63))))
        .join(misses.hint("shuffle_hash"), ["id", "digest"], "left_semi")
        .select("digest", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    )
    counted = chosen.mapInArrow(count_rows(vocabulary), "digest binary, n_bytes long, n_tokens long")
    counted.dropDuplicates(["digest"]).select("digest", F.lit(version).alias("tokenizer"), "n_bytes", "n_tokens").write.mode("append").parquet(cache_path)
    counts = spark.read.schema(CACHE).parquet(cache_path).filter(F.col("tokenizer") == version).dropDuplicates(["digest"]).select("digest", "n_tokens")
    return light.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
