"""MinHash near-duplicates: banding, signature verification, full-set confirmation, components.

Texts with equal shingle sets fall together by a 128-bit digest of the set; the rest works on one text of
each set. Banded minima give buckets. First every bucket member is held against the bucket's smallest id
(a star: linear in the members), by signature and then by full set. Buckets whose members are then in one
component are done. In the others, members of different components are compared in blocks, so that no
link is lost and no list of pairs is written. A block reports links only. Sets more than a quarter apart in
size can't link, so a member meets only those of its own class of sizes and of the next one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bitmap import marked
from .graph import Forest, components, grouped
from .runtime import Scratch, tune
from .textvec import U64, Texts, in_text, mix, slices, windows

#: A pair at the threshold of 0.8 shares no band with probability (1 - 0.8^4)^20 = 3e-5.
BANDS, ROWS = 20, 4
MINIMA = BANDS * ROWS
#: Of 80 minima; a pair at the threshold has fewer equal with probability 1e-5.
AGREE = 48
PERCENT = 80
#: Rows compared at a time in one task: a hub's members by set, a bucket's by signature.
FAN, BLOCK = 64, 1024
#: Copies of a hub's minima: one for so many members of its buckets.
HUB_MEMBERS = 4096
SALTS = 8
#: Sizes of linked sets differ by 100 / PERCENT at most: by one step of this logarithm.
SIZE_STEP = 0.2232

_rng = np.random.default_rng(80)
_A = _rng.integers(1, 1 << 63, MINIMA, dtype=U64) * U64(2) + U64(1)
_B = _rng.integers(0, 1 << 63, MINIMA, dtype=U64)


def shingles(column: pa.Array) -> tuple[Texts, np.ndarray, np.ndarray]:
    """The 2-word shingles of texts as hashes (with repeats) and the texts they belong to.

    A single word is a shingle of its own; a text without words has none.
    """
    t = Texts(column, lower=True).split()
    words, docs = t.word_hashes(), t.doc_of_word()
    pairs, at = windows(words, docs, 2)
    single = t.word_off[:-1][np.diff(t.word_off) == 1]
    keys, of = np.concatenate((pairs, mix(words[single] ^ U64(0x1F)))), np.concatenate((docs[at], docs[single]))
    order = np.argsort(of, kind="stable")
    return t, keys[order], of[order]


def signed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n_shingles, hi, lo, minima) of documents (doc_id, text)."""
    for batch in batches:
        for part in slices(batch, "text"):
            t, keys, docs = shingles(part.column("text"))
            _, once = np.unique(in_text(keys, docs), return_index=True)
            once.sort()
            keys, docs = keys[once], docs[once]
            n = np.bincount(docs, minlength=t.n)
            full = np.flatnonzero(n)
            begin = np.searchsorted(docs, full)
            digest = np.zeros((2, t.n), U64)
            minima = np.zeros((t.n, MINIMA), np.uint32)
            if len(full):
                for i, salt in enumerate((0x3C6E, 0x1B87)):
                    digest[i, full] = np.add.reduceat(mix(keys ^ U64(salt << 20)), begin)
                for i in range(MINIMA):
                    minima[full, i] = np.minimum.reduceat((keys * _A[i] + _B[i]) >> U64(32), begin).astype(np.uint32)
            raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * MINIMA), t.n, [None, pa.py_buffer(minima.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n.astype(np.int64)), *(pa.array(d.view(np.int64)) for d in digest), raw], names=["doc_id", "n_shingles", "hi", "lo", "minima"])


SIGNED = "doc_id long, n_shingles long, hi long, lo long, minima binary"


def _signatures(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), MINIMA)


def alike_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, c) whose minima agree often enough."""
    for batch in batches:
        same = (_signatures(batch.column("left")) == _signatures(batch.column("right"))).sum(1) >= AGREE if batch.num_rows else np.zeros(0, bool)
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(same)), batch.column("c").filter(pa.array(same))], names=["a", "c"])


def set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the last column, a text, by its sorted shingle set in bytes."""
    for batch in batches:
        *names, text = batch.schema.names
        for part in slices(batch, text):
            t, keys, docs = shingles(part.column(text))
            order = np.lexsort((keys, docs))
            keys, docs = keys[order], docs[order]
            first = np.ones(len(keys), bool)
            first[1:] = (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])
            keys, docs = keys[first], docs[first]
            cut = np.searchsorted(docs, np.arange(t.n + 1))
            sets = pa.array([keys[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), sets], names=[*names, "keys"])


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets overlap as much as a link asks."""
    if min(len(x), len(y)) * 100 < PERCENT * max(len(x), len(y)):
        return False
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    common = int((y[at] == x).sum()) if len(y) else 0
    return common > 0 and 100 * common >= PERCENT * (len(x) + len(y) - common)


def star_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) between a group's hub (its first row) and its members."""
    for group in grouped(batches, ["c", "salt"]):
        ids, hub = group.column("id").to_pylist(), group.column("c")[0].as_py()
        sets = [np.frombuffer(x, U64) for x in group.column("keys").to_pylist()]
        hubs = [s for i, s in zip(ids, sets) if i == hub]
        found = [i for i, s in zip(ids, sets) if i != hub and any(linked(s, h) for h in hubs)]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array([hub] * len(found), pa.int64())], names=["a", "b"])


def _candidates(group: pa.Table) -> np.ndarray:
    """Pairs of rows of a block group to compare by set, as row numbers.

    A group holds the members of a size class and of the next; a pair of the next class alone is another group's.
    """
    sig, comp = _signatures(group.column("minima")), group.column("comp").to_numpy()
    ids, band, center = group.column("doc_id").to_numpy(), group.column("band")[0].as_py(), group.column("center")[0].as_py()
    side, i, j = group.column("block").to_numpy(), group.column("i")[0].as_py(), group.column("j")[0].as_py()
    own = group.column("size").to_numpy() == group.column("low")[0].as_py()
    left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
    out = []
    for x in left:
        if ids[x] == center:
            continue
        y = right[(comp[right] != comp[x]) & (ids[right] != center) & ((i != j) | (right > x)) & (own[right] | own[x])]
        if not len(y):
            continue
        same = sig[y] == sig[x]
        keep = same.sum(1) >= AGREE
        y, same = y[keep], same[keep]
        if len(y):
            # a pair belongs to the first band it shares
            first = same.reshape(len(y), BANDS, ROWS).all(2).argmax(1)
            out += [(x, z) for z in y[first == band]]
    return np.array(out, np.int64).reshape(-1, 2)


BLOCK_KEYS = ["key", "band", "low", "i", "j"]


def suspect_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every block group, the rows that some other row may link with."""
    for group in grouped(batches, BLOCK_KEYS):
        rows = np.unique(_candidates(group))
        if len(rows):
            yield from group.take(pa.array(rows)).combine_chunks().to_batches()


def block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of block groups, as many as it takes to join what they join."""
    for group in grouped(batches, BLOCK_KEYS):
        sets = [np.frombuffer(x, U64) for x in group.column("keys").to_pylist()]
        ids, comp = group.column("doc_id").to_pylist(), group.column("comp").to_pylist()
        number = {c: k for k, c in enumerate(dict.fromkeys(comp))}
        forest, found = Forest(len(number)), []
        for x, y in _candidates(group).tolist():
            a, b = number[comp[x]], number[comp[y]]
            if forest.find(a) != forest.find(b) and linked(sets[x], sets[y]):
                forest.join(a, b)
                found.append((ids[x], ids[y]))
        a, b = zip(*found) if found else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _with_sets(docs: DataFrame, rows: DataFrame, key: str, schema: str) -> DataFrame:
    """The rows (a written table) with the shingle set of the document whose id is in ``key``.

    Texts that no row asks for stay where they are, but for a few that the bitmap can't tell apart. The
    join hashes the narrow side, so that texts aren't sorted.
    """
    texts = marked(docs.select(F.col("doc_id").alias("_id"), "text"), "_id", rows, key, "_maybe").filter("_maybe").drop("_maybe")
    joined = texts.join(rows.hint("shuffle_hash"), rows[key] == texts["_id"]).select(*rows.columns, "text")
    return joined.mapInArrow(set_rows, schema)


def _star_links(docs: DataFrame, signed: DataFrame, pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """Which of the pairs (a, c, parts) are links; c may be the hub of many, so it stands ``parts`` times."""
    half = signed.select("doc_id", "minima")
    salt = F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("salt")
    hubs = pairs.select("c", "parts").distinct().withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    hubs = half.select(F.col("doc_id").alias("c"), F.col("minima").alias("right")).join(hubs.hint("shuffle_hash"), "c")
    pairs = half.select(F.col("doc_id").alias("a"), F.col("minima").alias("left")).join(pairs.select("a", "c", "parts", salt).hint("shuffle_hash"), "a")
    pairs = pairs.join(hubs, ["c", "parts", "salt"])
    pairs = scratch.save(pairs.select("a", "c", "left", "right").mapInArrow(alike_rows, "a long, c long").distinct(), "minhash-alike")
    spread = pairs.groupBy("c").agg(F.ceil(F.count(F.lit(1)) / FAN).cast("int").alias("n"))
    members = pairs.join(spread, "c").select("c", F.pmod(F.xxhash64("a"), F.col("n")).cast("int").alias("salt"), F.col("a").alias("id"))
    hubs = members.select("c", "salt").distinct().withColumn("id", F.col("c"))
    rows = _with_sets(docs, scratch.save(members.union(hubs), "minhash-members"), "id", "c long, salt int, id long, keys binary")
    return rows.repartition("c", "salt").sortWithinPartitions("c", "salt").mapInArrow(star_rows, "a long, b long")


def near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    A null or empty text, or one of white space, has no shingle and links with nothing. Rows that share a
    doc_id are one document to the links; each returns its own n_shingles. Without doc_id a row links with
    nothing, has no component and is kept. Of equal ids and texts all rows are kept or none. An empty table
    gives no row. Other columns are not read.
    """
    tune(spark)
    scratch = Scratch(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = scratch.save(docs.mapInArrow(signed_rows, SIGNED), "minhash-signed")
    usable = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")

    digest = ["hi", "lo", "n_shingles"]
    classes = usable.groupBy(*digest).agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    classes = classes.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS))))).drop("n")
    copies = usable.select("doc_id", *digest, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt")).join(classes, [*digest, "salt"])
    copies = scratch.save(copies.filter("doc_id <> first").select("doc_id", *digest, "first"), "minhash-copies")
    distinct = usable.join(copies, ["doc_id", *digest], "left_anti").select("doc_id", "minima", "n_shingles")

    band = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band")
    bands = distinct.select("doc_id", "minima", band)
    bands = bands.select("doc_id", "band", F.xxhash64(F.expr(f"substring(minima, band * {4 * ROWS} + 1, {4 * ROWS})"), "band").alias("key"))
    buckets = bands.groupBy("key", "band").agg(F.min("doc_id").alias("center"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    crowded = scratch.save(bands.join(buckets, ["key", "band"]), "minhash-buckets")

    parts = F.max(F.ceil(F.col("n") / HUB_MEMBERS).cast("int")).alias("parts")
    stars = crowded.filter("doc_id <> center").groupBy(F.col("doc_id").alias("a"), F.col("center").alias("c")).agg(parts)
    links = scratch.save(_star_links(docs, signed, stars, scratch), "minhash-links")

    first = scratch.save(components(links, scratch, "minhash-first"), "minhash-stars")
    seen = crowded.join(first.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("comp", F.coalesce("component", "doc_id")).drop("component")
    open_ = seen.groupBy("key", "band").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("key", "band")
    seen = seen.join(open_, ["key", "band"]).filter("n > 2").select("key", "band", "doc_id", "comp", "center")
    seen = seen.join(distinct.select("doc_id", F.floor(F.log("n_shingles") / SIZE_STEP).cast("int").alias("size")), "doc_id")
    # a member stands in the group of its size class and in that of the class before
    seen = seen.withColumn("low", F.explode(F.array(F.col("size") - 1, F.col("size"))))
    crowd = seen.groupBy("key", "band", "low").agg(F.count(F.lit(1)).alias("m"), F.min("size").alias("least")).filter("m > 1 AND least = low")
    seen = seen.join(crowd.select("key", "band", "low", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")), ["key", "band", "low"])
    seen = seen.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    seen = seen.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    seen = seen.select("key", "band", "low", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "size", "doc_id", "comp", "center")
    seen = distinct.select("doc_id", "minima").join(seen.hint("shuffle_hash"), "doc_id").select("key", "band", "low", "i", "j", "block", "size", "doc_id", "comp", "center", "minima")
    kinds = "key long, band int, low int, i int, j int, block int, size int, doc_id long, comp long, center long, minima binary"
    grouping = [F.col(c) for c in BLOCK_KEYS]
    suspects = scratch.save(seen.repartition(*grouping).sortWithinPartitions(*grouping).mapInArrow(suspect_rows, kinds), "minhash-suspects")
    more = _with_sets(docs, suspects, "doc_id", f"{kinds}, keys binary")
    more = scratch.save(more.repartition(*grouping).sortWithinPartitions(*grouping).mapInArrow(block_rows, "a long, b long"), "minhash-more")

    edges = links.union(more).union(copies.select(F.col("doc_id").alias("a"), F.col("first").alias("b")))
    last = scratch.save(components(edges, scratch, "minhash-last"), "minhash-components").withColumnRenamed("node", "doc_id")
    scratch.drop("minhash-buckets", "minhash-suspects", "minhash-alike", "minhash-members", "minhash-more", "minhash-links", "minhash-copies", "minhash-stars")
    out = signed.select("doc_id", "n_shingles").join(last, "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def _comparable(docs: DataFrame) -> list[str]:
    """Columns that tell rows apart, for dropDuplicates: maps and the like stand as JSON."""
    from pyspark.sql.types import ArrayType, DataType, MapType, StructType

    def plain(t: DataType) -> bool:
        if isinstance(t, ArrayType):
            return plain(t.elementType)
        if isinstance(t, StructType):
            return all(plain(f.dataType) for f in t)
        return not isinstance(t, MapType) and t.typeName() != "variant"

    return [f.name for f in docs.schema if not plain(f.dataType)]


def keep_first(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents without those that have a smaller id in their component; all columns stay.

    Of rows that share a doc_id and every other value one stays; rows without doc_id all stay, equal ones too.
    """
    scratch = Scratch(spark)
    found = scratch.save(near_duplicates(spark, docs), "minhash-kept")
    asked = found.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_asked")).agg(F.bool_or(~F.col("kept")).alias("_gone"), (F.count(F.lit(1)) > 1).alias("_again"))
    asked = scratch.save(asked.filter("_gone OR _again"), "minhash-asked")
    name = next(f"_at{i}" for i in range(99) if not any(c.startswith(f"_at{i}") for c in docs.columns))
    told = marked(docs.withColumn(f"{name}id", F.col("doc_id").cast("long")), f"{name}id", asked, "_asked", name)
    info = asked.select(F.col("_asked").alias(f"{name}asked"), F.col("_gone").alias(f"{name}gone"), F.col("_again").alias(f"{name}again"))
    joined = told.filter(name).join(info.hint("shuffle_hash"), F.col(f"{name}id") == F.col(f"{name}asked"), "left").filter(~F.coalesce(f"{name}gone", F.lit(False)))
    again = F.coalesce(f"{name}again", F.lit(False))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rest = told.filter(~F.col(name)).select(*columns)
    if asked.filter("_again").limit(1).count():  # only rows whose id stands on several rows are held against each other
        odd = {f"{name}j{i}": F.to_json(F.struct(F.col(f"`{c}`")), {"ignoreNullFields": "false"}) for i, c in enumerate(_comparable(docs))}
        keys = [c for c in docs.columns if c not in _comparable(docs)] + list(odd)
        twins = joined.filter(again).withColumns(odd) if odd else joined.filter(again)
        return rest.union(joined.filter(~again).select(*columns)).union(twins.dropDuplicates(keys).select(*columns))
    return rest.union(joined.select(*columns))
