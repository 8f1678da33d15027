import random
from collections import Counter

import pytest

import corpus_pipeline
from polyad.llm import minhash, mixing, packing, rules, secret_scan

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9)))
    rows, labels = [], []
    for i in range(240):
        words = [word() for _ in range(90)]
        if i % 6 == 0:
            words = [w + "$$$" for w in words]
        if i % 10 == 3:
            words[5] = "password=" + word() + "1234567x"
        if i % 7 == 1 and rows:
            words = rows[-1][1].split()
            words[0] = word()
        text = " ".join(words)
        rows.append((i, text, "en", f"s{i % 3}" if i % 11 else None, len(text), None))
        labels.append((i, int(i % 6 != 0), 0))
    rows += [(None, rows[1][1], None, None, None, "n"), (500, None, None, "s0", 0, None), (501, "", "en", "s1", 0, None), (7, *rows[7][1:])]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, held = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, before, folder).persist()
        held.append((name, before.collect(), docs.collect()))
        assert name == "best-fit packing" or docs.columns == columns
    (_, a, b), (_, _, c), (_, _, d), (_, _, e), (_, _, f) = held
    judged = {r.doc_id: r.kept for r in rules.judge(spark, spark.createDataFrame(a, SCHEMA), spark.read.parquet(f"{folder}/labels.parquet")).collect()}
    assert Counter(r.doc_id for r in b) == Counter(r.doc_id for r in a if judged[r.doc_id])
    found = {r.doc_id: r.kept for r in minhash.near_duplicates(spark, spark.createDataFrame(b, SCHEMA)).collect()}
    assert Counter(r.doc_id for r in c) == Counter({r.doc_id for r in b if found[r.doc_id]})
    vocabulary = corpus_pipeline.vocabulary("byte_bpe_50k.tiktoken")
    masked = {r.doc_id: (secret_scan.mask(r.text.encode(), vocabulary) or r.text.encode()).decode() for r in c}
    assert {r.doc_id: r.text for r in d} == masked and any("[SECRET]" in t for t in masked.values())
    mixed = mixing.mix(spark, spark.createDataFrame(d, SCHEMA)).collect()
    assert Counter(r.doc_id for r in e) == +Counter({r.doc_id: r.taken // r.size for r in mixed})
    packed = packing.pack(spark, spark.createDataFrame(e, SCHEMA), corpus_pipeline.vocabulary("word_bpe_49k.json")).collect()
    assert Counter((r.doc_id, r.ids_crc32) for r in f) == Counter((r.doc_id, r.ids_crc32) for r in packed)
    assert Counter(tuple(r)[:5] for r in corpus_pipeline.run(spark, folder).collect()) == Counter(tuple(r)[:5] for r in f)


def test_empty(spark, folder, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
