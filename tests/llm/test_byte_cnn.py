import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from polyad.llm import byte_cnn as C
from polyad.llm.textvec import Texts, slices


def scores(model, texts, limit=1 << 18):
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    return np.concatenate([C.forward(model, C.Layout(Texts(p.column("text"))))[0] for p in slices(batch, "text", limit)])


def brute(m, text):
    """One text, chunk by chunk and window by window."""
    data = (text or "").encode()
    padded = data + bytes(C.WIDTH + C.CELL)
    cells = (len(data) + C.WIDTH + C.CELL - 1) // C.CELL
    value = np.zeros((cells, C.FILTERS))
    for p in range(0, len(data), C.STEP):
        window = m["bytes"][list(padded[p : p + C.WIDTH])].ravel()
        value[p // C.CELL] = np.maximum(value[p // C.CELL], np.maximum(window @ m["filters"] + m["shift"], 0))
    chunks = [value[s : s + C.CHUNK_CELLS].max(0) for s in range(0, max(1, cells - 1), C.CHUNK_STEP)]
    doc = np.concatenate((np.mean(chunks, 0), np.max(chunks, 0)))
    return np.maximum(doc @ m["hidden"] + m["hidden_shift"], 0) @ m["last"] + m["last_shift"][0]


def test_forward_matches_brute_force():
    rng = random.Random(1)
    texts = [None, "", "a", "é" * 31, "x" * 56, "x" * 57, "y" * 504, "z" * 505] + ["".join(rng.choice("ab cé.\n") for _ in range(rng.randrange(3000))) for _ in range(20)]
    m = C.fresh()
    want = [brute(m, t) for t in texts]
    for limit in (1, 500, 1 << 20):  # neighbours don't change a score
        assert np.allclose(scores(m, texts, limit), want, atol=1e-4)


def test_gradients():
    texts, y = ["hello world " * 60, "?", "123 456"], np.array([1, 0, 1], np.float32)
    m, x = C.fresh(), C.Layout(Texts(pa.array(["hello world " * 60, "?", "123 456"])))
    loss = lambda: float(np.sum(np.logaddexp(0, z := C.forward(m, x)[0].astype(float)) - y * z))
    logit, kept = C.forward(m, x, keep=True)
    g = C.backward(m, x, kept, (1 / (1 + np.exp(-logit)) - y).astype(np.float32))
    for name, at in (("last", 3), ("hidden", (5, 2)), ("filters", (7, 9)), ("shift", 4), ("bytes", (101, 1))):
        was, eps = m[name][at], 2e-3
        m[name][at] = was + eps
        up = loss()
        m[name][at] = was - eps
        down = loss()
        m[name][at] = was
        assert (up - down) / (2 * eps) == pytest.approx(float(np.asarray(g[name])[at]), abs=2e-2, rel=0.1)


def test_held_out_accuracy_and_columns(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 8))) + ("&&#" if bad else "")
        rows.append((i, " ".join(word() for _ in range(80)), i, None))
        labels.append((i, int(not bad), 0))
    rows += [(None, None, 1, "x"), (700, "", 1, "x"), (700, "", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int, _id string")
    labelled = spark.createDataFrame([*labels, (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    out = C.classify(spark, docs, labelled)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    out = out.collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    test = [r for r in out if r.held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in test)
    assert np.mean([r.predicted == (r.doc_id % 5 != 0) for r in test if r.doc_id < 600]) > 0.97
    assert {r.score for r in C.classify(spark, docs, labelled.limit(0)).collect()} == {0.5}
    assert C.classify(spark, docs.limit(0), labelled).count() == 0


def test_long_labelled_texts_teach(spark, monkeypatch):
    rng = random.Random(6)
    seen = []
    monkeypatch.setattr(C, "train", lambda texts, good: seen.extend(len(zlib.decompress(t)) for t in texts) or C.fresh())
    texts = ["w" * n for n in (130_000, 5, 1_000_000)] + ["".join(rng.choice("abc ") for _ in range(50)) for _ in range(30)]
    rows = list(enumerate(texts)) + [(0, "z")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(len(texts))], "doc_id long, quality int, toxic int")
    C.fit(docs, labels)
    taught = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 3 != 1]
    assert sorted(seen) == sorted(len(texts[i]) for i in taught)  # the smaller text of id 0, every id once


def test_very_long_text():
    rng = random.Random(7)
    m, text = C.fresh(), "".join(rng.choice("ab cé.\n") for _ in range(200_000))
    assert np.allclose(scores(m, [text, "x"]), [brute(m, text), brute(m, "x")], atol=1e-4)
    assert np.isfinite(scores(m, ["long text " * 1_600_000])).all()
