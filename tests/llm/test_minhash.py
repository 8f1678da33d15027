import random
import re

import pytest

from polyad.llm import minhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return set(zip(words, words[1:])) if len(words) > 1 else {tuple(words)} if words else set()


def brute(rows):
    sets = {}
    for i, text in rows:
        sets.setdefault(i, []).append(shingle_set(text))
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(x for x in sets if x is not None)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                up[max(find(a), find(b))] = min(find(a), find(b))
    return sorted(((i, len(shingle_set(t)), find(i) if i is not None else None) for i, t in rows), key=str)


def run(spark, rows):
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    out = minhash.near_duplicates(spark, df).collect()
    assert all(r.kept == (r.component_id is None or r.doc_id == r.component_id) for r in out)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=str)


def chain(rng, n, words, step):
    text = [str(rng.random()) for _ in range(words)]
    for _ in range(n):
        yield " ".join(text)
        for _ in range(step):
            text[rng.randrange(words)] = str(rng.random())


def test_matches_brute_force(spark):
    rng = random.Random(5)
    texts = [None, "", " \n\t", "One", "one", "ONE two", "one\ttwo", "two one", "É é", "é é"]
    for _ in range(12):  # copies, chains that only link step by step, near misses
        texts += list(chain(rng, rng.randrange(2, 9), rng.choice([12, 40, 200]), rng.choice([0, 1, 3, 4, 8])))
    hub = list(chain(rng, 1, 60, 0))[0].split()
    for _ in range(90):  # a hot group around one text
        t = list(hub)
        for _ in range(rng.randrange(0, 7)):
            t[rng.randrange(len(t))] = str(rng.random())
        texts.append(" ".join(t))
    rng.shuffle(texts)
    rows = list(enumerate(texts)) + [(None, "one two"), (None, None), (3, texts[3]), (5, "one two")]
    assert run(spark, rows) == brute(rows)


def test_no_rows(spark):
    assert run(spark, []) == []


def test_hot_bucket_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng = random.Random(6)
    texts = list(chain(rng, 60, 30, 1)) + list(chain(rng, 40, 30, 2))
    rows = list(enumerate(texts))
    assert run(spark, rows) == brute(rows)


def test_stage_keeps_columns(spark):
    df = spark.createDataFrame([(1, "a b c", "x"), (2, "a b c", "y"), (3, "q", None), (3, "q", None), (None, "a b c", "z")], "doc_id long, text string, _id string")
    out = minhash.keep_first(spark, df)
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect()), key=str) == [(1, "a b c", "x"), (3, "q", None), (None, "a b c", "z")]


@pytest.mark.parametrize("n", [0, 1])
def test_long_text(spark, n):
    long = " ".join(str(i) for i in range(200_000))
    rows = [(1, long), (2, long + " x"), (3, "y " * 300_000)]
    assert [c for _, _, c in run(spark, rows[n:])] == ([1, 1, 3] if not n else [2, 3])


def test_second_row_of_an_id_is_a_copy(spark):
    rng = random.Random(10)
    hub = [str(rng.random()) for _ in range(60)]

    def altered(words, n):
        words = list(words)
        for at in rng.sample(range(60), n):
            words[at] = str(rng.random())
        return words

    rows = [(i, " ".join(altered(hub, 7))) for i in range(150)]  # smallest of the buckets, linked with nothing
    # a pair that only the comparison in blocks finds; its first id's other text is a copy
    rows += [(1000, " ".join(hub)), (2000, " ".join(altered(hub, 2))), (1000, "a copied text"), (500, "a copied text")]
    assert run(spark, rows) == brute(rows)


def test_rows_without_id_stay_beside_repeated_ids(spark):
    rows = [(None, "a b c", {"k": 1}), (None, "a b c", {"k": 1}), (7, "x y", {"k": 1}), (7, "x y", {"k": 1}), (7, "x y", {"k": 2}), (8, "x y", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>")
    got = sorted(((r.doc_id, r.text, r.m) for r in minhash.keep_first(spark, df).collect()), key=str)
    assert got == sorted([rows[0], rows[1], rows[2], rows[4]], key=str)
    plain = df.drop("m")
    assert sorted(map(tuple, minhash.keep_first(spark, plain).collect()), key=str) == sorted([(None, "a b c")] * 2 + [(7, "x y")], key=str)


def test_sizes_at_the_limit_meet(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4)
    rng = random.Random(21)
    hub = [str(rng.random()) for _ in range(81)]
    rows = []
    for i in range(40):  # share bands with the smallest id, link with others of a quarter more or less
        t = hub[: 65 + (i * 7) % 37]
        for _ in range(i % 9):
            t[rng.randrange(len(t))] = str(rng.random())
        rows.append((i, " ".join(t)))
    assert run(spark, rows) == brute(rows)
