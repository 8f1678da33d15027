import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from polyad.llm import mixing, packing, token_counts
from polyad.llm.queries import vocabulary

WORDS, PIECES, BYTES = vocabulary("word_bpe_49k.json"), vocabulary("piece_bpe_32k.model"), vocabulary("byte_bpe_50k.json")
ODD = [None, "", " ", "\n", "a", " a", "a ", "a  b", "a\nb", "a \nb", "a\n\nb", "▁a b", "it's  don't", "tab\there", "cr\r\nline;\r\n", "<|endoftext|> x", "<s>a</s>", "É́ é b", "日本 語", "x" * 5000, "a\x00b", "1234 12a", "ﬁ ½ ²", "ÀÉ×÷ß"]


def texts(n, seed=1):
    rng = random.Random(seed)
    return [" ".join(rng.choice(["the", "Étude", "don't", "x1", "foo,", "…", "zzqx"]) + rng.choice(["", "\n", "s"]) for _ in range(int(rng.paretovariate(0.7) * 30) % 4000)) for _ in range(n)]


def test_packing(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    all_texts = ODD + texts(120) + ["word " * 20_000]
    rows = [(i, t, 9) for i, t in enumerate(all_texts)] + [(None, "a b", 1), (5, "a b", 1), (5, "a b", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int").repartition(3)
    out = packing.pack(spark, df, WORDS).collect()
    want = Counter()
    for i, t, _ in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for p, s in enumerate(range(0, len(ids), 4096)):
            want[i, p, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    places = defaultdict(list)
    for r in out:
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():  # gapless from 0, at most 4096
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(places) <= -(-sum(r.length for r in out) // 4096) + 1
    assert packing.pack(spark, df.limit(0), WORDS).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_everything(seed):
    r = np.random.default_rng(seed)
    room = [50, 4096, 300, 7, 1000, 4096][seed]
    lengths = np.clip(r.lognormal(np.log(room / 6), 1, 3000).astype(int), 1, room)
    counts = np.bincount(lengths, minlength=room + 1)
    steps = packing.plan(counts, room)
    used = np.zeros(room + 1, int)
    for times, pieces in steps:
        assert sum(pieces) <= room and times > 0
        np.add.at(used, list(pieces), times)
    assert (used == counts).all()
    assert sum(t for t, _ in steps) <= -(-lengths.sum() // room) * 1.01 + 1


def test_mix(spark):
    rng = random.Random(3)
    rows = [(i, " ".join("w" * rng.randrange(1, 4) for _ in range(rng.randrange(0, 90))), rng.choice(["a", "a", "a", "b", "Z", "é", None]), i) for i in range(900)]
    rows += [(None, "x y", "a", 1), (7, *rows[7][1:3], 1), (7, *rows[7][1:3], 1), (2000, None, "only null", 0), (2001, "w " * 5000, "long", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, target long").repartition(5)
    out = mixing.mix(spark, df)
    got = sorted(map(tuple, out.collect()), key=str)
    assert got == sorted(map(tuple, mixing.mix(spark, df.repartition(2)).collect()), key=str)  # reruns agree
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    totals, largest = Counter(), Counter()
    for i, t, s, _ in rows:
        totals[s] += size(t)
        largest[s] = max(largest[s], size(t))
    names = sorted(totals, key=lambda s: (s is None, (s or "").encode()))
    goal, capped = {}, set()
    while True:
        free = [s for s in names if s not in capped]
        rest = sum(totals.values()) - sum(3 * totals[s] for s in capped)
        weight = {s: names.index(s) % 3 + 1 for s in free}
        goal = {s: 3.0 * totals[s] if s in capped else rest * weight[s] / sum(weight.values()) for s in names}
        over = {s for s in free if goal[s] > 3 * totals[s]}
        if not over:
            break
        capped |= over
    source_of = {i: s for i, _, s, _ in rows}
    taken = Counter()
    for doc, n, source_size, target, took in got:
        s = source_of[doc]
        assert source_size == totals[s] and target == pytest.approx(goal[s]) and 0 <= took <= 3 * n
        taken[s] += took
    for s in names:
        assert abs(taken[s] - goal[s]) <= largest[s] + 1e-6
    assert mixing.mix(spark, df.limit(0)).count() == 0
    copies = mixing.mix_documents(spark, df)
    assert copies.columns == df.columns
    repeated = Counter()
    for r in copies.collect():
        repeated[source_of[r.doc_id]] += size(r.text)
    assert repeated == +taken


def test_token_counts(spark, tmp_path):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    all_texts = ODD + texts(60) + ["word " * 6000, "a " * 3]
    rows = [(i, t, b"x") for i, t in enumerate(all_texts)] + [(None, "a b", None), (None, "a b", None), (5, "a b", None), (5, "c", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest binary").repartition(3)
    cache = f"{tmp_path}/cache"
    want = Counter((i, len((t or "").encode()), len(library.encode(t or "")), len(library.encode(t or "")) > 4096) for i, t, _ in rows)
    for _ in range(2):
        assert Counter(map(tuple, token_counts.count_tokens(spark, df, PIECES, cache).collect())) == want
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("digest").distinct().count() == len({t or "" for _, t, _ in rows})
    token_counts.count_tokens(spark, df.limit(0), PIECES, cache)
    more = spark.createDataFrame([(1, "new text"), (2, "a b")], "doc_id long, text string")
    assert token_counts.count_tokens(spark, more, PIECES, cache).count() == 2
    assert spark.read.parquet(cache).count() == stored.count() + 1
    # another tokenizer shares the cache, not the counts
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(BYTES)
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(spark, more, BYTES, cache).collect()}
    assert got == {1: len(other.encode("new text").ids), 2: len(other.encode("a b").ids)}


def test_sums_find_what_is_there():
    r = np.random.default_rng(2)
    for _ in range(40):
        room = int(r.integers(6, 40))
        left = np.where(r.random(room + 1) < 0.25, r.integers(1, 3, room + 1), 0)
        left[0] = 0
        sums = packing.Sums(left)
        for _ in range(12):
            bag = [x for x in range(1, room + 1) for _ in range(int(left[x]))]
            can = {t for t in bag} | {bag[i] + bag[j] for i in range(len(bag)) for j in range(i)} | {bag[i] + bag[j] + bag[k] for i in range(len(bag)) for j in range(i) for k in range(j)}
            for total in range(1, room + 1):
                found = sums.exact(total)
                assert (found is not None) == (total in can), (total, left)
                assert found is None or (sum(found) == total and all(left[x] >= found.count(x) for x in found))
            if bag:  # something runs out
                left[bag[int(r.integers(len(bag)))]] -= 1


def test_frequent_lengths_and_no_ids(spark, monkeypatch):
    monkeypatch.setattr(packing, "CELL_PIECES", 7)
    rows = [(None, "a b")] * 120 + [(1, "a b")] * 30 + [(2, "w " * 9000)] + [(i, "x y z") for i in range(60)]
    out = packing.pack(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), WORDS).collect()
    assert len({(r.sequence_id, r.offset) for r in out}) == len(out) == 210 + sum(r.doc_id == 2 and r.length > 20 for r in out)
    ends = defaultdict(list)
    for r in out:
        ends[r.sequence_id].append((r.offset, r.offset + r.length))
    assert all(a[1] == b[0] for e in map(sorted, ends.values()) for a, b in zip(e, e[1:])) and all(sorted(e)[0][0] == 0 for e in ends.values())


def test_mixing_without_ids_and_with_repeated_ones(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SPAN", 2)
    rows = [(None, f"w{i} x", "a", {"k": i}) for i in range(40)] + [(None, "same text", "a", {"k": 1})] * 20 + [(7, "p q r", s, None) for s in ("a", "b", None)] + [(i, "v " * 30, "b", None) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _mix0 map<string,int>")
    mixed, copies = mixing.mix(spark, df).collect(), mixing.mix_documents(spark, df)
    assert len(mixed) == len(rows) and copies.columns == df.columns
    assert sum(r.taken for r in mixed) == sum(len(r.text.split()) for r in copies.collect())
